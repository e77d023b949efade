"""Requests to a judge: long pages in chunks, items packed into posts, and the key of an answer.

Limits count UTF-8 bytes of compact JSON for packing and characters for content.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import clamp, split_lines
from wayfare.operators.judging import Mode

# The limits of a request and the names in it, which its key is made of.
CONTENT_LIMIT = 40_000
STATE_BYTES, REQUEST_BYTES, MARGIN = 64_000, 128_000, 1_024
PREVIEW_LIMIT, FRONTMATTER_LIMIT = 600, 1_200
HEADINGS, HEADING_LIMIT, LEADS, LEAD_LIMIT = 40, 80, 30, 60
OPTIONS = 254
PAGE, CHOICE, NONE = "file_relevance", "link_choice", "none"


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_len(value: object) -> int:
    return len(compact(value).encode())


# ---- previews --------------------------------------------------------------------


@dataclass(frozen=True)
class LinkContext:
    """What a link's judge is shown of the target."""

    previews: bool = True
    frontmatter: bool = True
    headings: bool = True
    leads: bool = True
    two_hop: bool = True


def bounded_previews(previews: DataFrame, context: LinkContext = LinkContext()) -> DataFrame:
    """Previews cut to the limits, as columns: titles and paragraphs by characters, frontmatter
    by whole fields and JSON bytes, headings and distinct leads by number and length.  What
    ``context`` does not show is empty; without previews there is no row."""
    if not context.previews:
        previews = previews.where(F.lit(False))
    hidden = [c for c in ("frontmatter", "headings", "leads") if not getattr(context, c)]
    previews = previews.withColumns({c: F.slice(c, 1, 0) for c in hidden})
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(f"\n[cut after {n} characters]"))).otherwise(c)
    cost = lambda f: F.octet_length(F.to_json(F.struct(f["key"].alias("key"), f["value"].alias("value")))) + 1
    empty = F.array().cast("array<struct<key:string,value:string>>")
    fields = F.aggregate(
        "frontmatter",
        F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), empty.alias("kept")),
        lambda s, f: F.struct(
            (s["used"] + cost(f)).alias("used"),
            (s["open"] & (s["used"] + cost(f) <= FRONTMATTER_LIMIT)).alias("open"),
            F.when(s["open"] & (s["used"] + cost(f) <= FRONTMATTER_LIMIT), F.concat(s["kept"], F.array(f))).otherwise(s["kept"]).alias("kept"),
        ),
    )["kept"]
    return previews.select(
        "path",
        cut(F.col("title"), PREVIEW_LIMIT).alias("title"),
        fields.alias("frontmatter"),
        cut(F.col("first_paragraph"), PREVIEW_LIMIT).alias("first_paragraph"),
        F.transform(F.slice("headings", 1, HEADINGS), lambda h: cut(h, HEADING_LIMIT)).alias("headings"),
        F.transform(F.slice(F.array_distinct("leads"), 1, LEADS), lambda x: cut(x, LEAD_LIMIT)).alias("leads"),
    )


# ---- chunks ----------------------------------------------------------------------


def chunks(text: str, sections: list[tuple[int, int]], limit: int = CONTENT_LIMIT) -> list[tuple[int, int]]:
    """Line ranges that tile a page, each of at most ``limit`` characters where the heading tree allows it.

    ``sections`` are first and last lines in page order (parents hold their children).  A
    page too long is cut at its sections, a section too long at its own, and neighbours that
    fit together are joined again.
    """
    lines = split_lines(text)
    last = max(len(lines), 1)
    size = [0]
    for i, line in enumerate(lines):
        size.append(size[-1] + len(line) + (1 if i + 1 < len(lines) or text.endswith("\n") else 0))
    chars = lambda a, z: size[min(z, len(lines))] - size[min(a - 1, len(lines))]
    if chars(1, last) <= limit:
        return [(1, last)]
    pieces: list[tuple[int, int]] = []

    def cut(first: int, end: int, inside: list[tuple[int, int]]) -> None:
        at = first
        while inside:
            child, rest = inside[0], inside[1:]
            nested = [s for s in rest if s[0] <= child[1]]
            inside = rest[len(nested) :]
            if at < child[0]:
                pieces.append((at, child[0] - 1))
            if nested and chars(*child) > limit:
                cut(child[0], child[1], nested)
            else:
                pieces.append(child)
            at = child[1] + 1
        if at <= end:
            pieces.append((at, end))

    cut(1, last, sections)
    merged: list[tuple[int, int]] = []
    for a, z in pieces:
        if merged and chars(merged[-1][0], merged[-1][1]) + chars(a, z) <= limit:
            merged[-1] = (merged[-1][0], z)
        else:
            merged.append((a, z))
    return merged


# ---- posts -----------------------------------------------------------------------


@dataclass
class Post:
    body: dict
    sections: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Packer:
    """Builds the posts of one page.  ``endpoint`` and ``model`` only name who is asked."""

    mode: Mode
    endpoint: str = ""
    model: str = ""
    two_hop: bool = True

    def _score(self) -> dict:
        return {"type": "score", "instructions": self.mode.page_question, "criteria": list(self.mode.levels)}

    def _section(self, i: int) -> dict:
        return {"type": "noul", "instructions": self.mode.section_question.replace("{index}", str(i)), "criteria": {"true": self.mode.section_yes, "false": self.mode.section_no}}

    def _link(self, i: int) -> dict:
        m = self.mode
        question = (m.link_question_far if self.two_hop else m.link_question).replace("{index}", str(i))
        instructions = {"rules": list(m.rules), "question": question} if m.rules else question
        return {"type": "noul", "instructions": instructions, "criteria": {"true": m.link_yes_far if self.two_hop else m.link_yes, "false": m.link_no}}

    def _state(self, query: str, file: dict, sections: list, links: list) -> dict:
        return {"query": query, **({"reader": self.mode.reader} if self.mode.reader else {}), "file": file, "sections": sections, "links": links}

    def pack(self, query: str, page: dict) -> list[Post]:
        """Posts of a page: next-fit.  ``page``: ``path, title, text, sections, links``;
        sections as ``heading, level, first, last``, links as ``anchor, sentence, heading, target, line, preview``.

        A post closes when the next item would break the state's or the request's
        bytes; where not even the cheapest previewed link fits, the chunk's links go without previews.
        """
        sections = [{"heading": s["heading"], "level": s["level"], "lines": [s["first"], s["last"]]} for s in page["sections"]]
        links = [{k: x.get(k) for k in ("anchor", "sentence", "heading", "target")} | ({"target_preview": x["preview"]} if x.get("preview") else {"target_preview": None}) for x in page["links"]]
        longest = max(json_len(q) for q in (self._score(), self._section(0), self._link(0)))
        lines = split_lines(page["text"])
        posts: list[Post] = []
        for first, last in chunks(page["text"], [(s["first"], s["last"]) for s in page["sections"]]):
            content = "\n".join(lines[first - 1 : last]) + ("\n" if last < len(lines) or page["text"].endswith("\n") else "")
            file = {"path": page["path"], "title": page["title"], "content": clamp(content, CONTENT_LIMIT)}
            base = json_len(query) + json_len(file)
            own_sections = [i for i, s in enumerate(page["sections"]) if first <= s["first"] <= last]
            own_links = [i for i, x in enumerate(page["links"]) if first <= x["line"] <= last]
            previewed = [json_len(links[i]) for i in own_links if links[i]["target_preview"] is not None]
            if previewed and base + longest + min(previewed) > STATE_BYTES:
                for i in own_links:
                    links[i]["target_preview"] = None
            items = [("s", i, json_len(sections[i]) + 1, self._section(i), f"section_{n}") for n, i in enumerate(own_sections)]
            items += [("l", i, json_len(links[i]) + 1, self._link(i), f"link_{n}") for n, i in enumerate(own_links)]
            shares: list[list[tuple[str, int]]] = [[]]
            state, asked = 0, json_len(self._score())
            for kind, i, cost, question, name in items:
                price = json_len(question) + json_len(name) + 2
                fits = base + state + cost + longest + MARGIN <= STATE_BYTES and base + state + cost + asked + price + MARGIN <= REQUEST_BYTES
                if shares[-1] and not fits:
                    shares.append([])
                    state = asked = 0
                shares[-1].append((kind, i))
                state, asked = state + cost, asked + price
            for n, share in enumerate(shares):
                posts.append(self._post(query, file, sections, links, share, n == 0))
        return posts

    def _post(self, query: str, file: dict, sections: list, links: list, share: list, scored: bool) -> Post:
        s, x = [i for k, i in share if k == "s"], [i for k, i in share if k == "l"]
        questions = {PAGE: self._score()} if scored else {}
        questions |= {f"section_{n}": self._section(n) for n in range(len(s))} | {f"link_{n}": self._link(n) for n in range(len(x))}
        body = {"state": self._state(query, file, [sections[i] for i in s], [links[i] for i in x]), "model": self.model, "questions": dict(sorted(questions.items()))}
        return Post(body, s, x)

    def pack_choices(self, query: str, file: dict, options: list[tuple[int, str]]) -> list[Post]:
        """Choice posts: at most ``OPTIONS`` options and a none each, within the state's bytes."""
        posts, chunk = [], []
        question = self.mode.choice_question_far if self.two_hop else self.mode.choice_question
        fixed = json_len({"type": "choice", "instructions": question, "criteria": {NONE: self.mode.link_no}}) + json_len([NONE, self.mode.link_no])
        base, used = json_len(query) + json_len(file), fixed

        def close() -> None:
            criteria = {str(n): text for n, (_, text) in enumerate(chunk)} | {NONE: self.mode.link_no}
            body = {"state": self._state(query, file, [], []), "model": self.model, "questions": {CHOICE: {"type": "choice", "instructions": question, "criteria": dict(sorted(criteria.items()))}}}
            posts.append(Post(body, [], [i for i, _ in chunk]))

        for index, text in options:
            cost = json_len([str(len(chunk)), text])
            if chunk and (len(chunk) >= OPTIONS or base + used + cost + MARGIN > STATE_BYTES):
                close()
                chunk, used = [], fixed
            chunk.append((index, text))
            used += cost
        if chunk:
            close()
        return posts

    def key(self, posts: list[Post], keep: dict | None = None) -> str:
        """sha256 of the compact JSON of endpoint and posts (and of the keep rule of choice posts)."""
        value = [self.endpoint, {"posts": [{"body": p.body} for p in posts]}] + ([keep] if keep is not None else [])
        return hashlib.sha256(compact(value).encode()).hexdigest()


def pack_table(pages: DataFrame, packer: Packer) -> DataFrame:
    """``path, post, sections, links, questions, bytes`` of every page (``query, path, title, text, sections, links``).

    Packing keeps a running state along a page, so each page is one call in an Arrow batch.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.to_dict("records"):
                page["sections"] = list(page["sections"] if page["sections"] is not None else [])
                page["links"] = list(page["links"] if page["links"] is not None else [])
                for n, post in enumerate(packer.pack(page["query"], page)):
                    rows.append((page["path"], n, post.sections, post.links, len(post.body["questions"]), json_len(post.body)))
            yield pd.DataFrame(rows, columns=["path", "post", "sections", "links", "questions", "bytes"])

    return pages.mapInPandas(run, "path string, post int, sections array<int>, links array<int>, questions int, bytes long")


def assign_by_line(chunk_rows: DataFrame, items: DataFrame, key: str = "path") -> DataFrame:
    """Items with the chunk that holds their line: a range condition under the equi-join on the page."""
    c = chunk_rows.select(F.col(key).alias("k_"), "chunk", F.col("first").alias("a_"), F.col("last").alias("z_"))
    return items.join(c, (F.col(key) == F.col("k_")) & F.col("line").between(F.col("a_"), F.col("z_"))).drop("k_", "a_", "z_")
