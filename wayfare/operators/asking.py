"""A judge that asks questions: a page becomes posts, posts get replies, replies become one judgment.

What a link's target shows is bounded by a ``LinkContext``, ``Packer`` writes the posts in the words of a ``Mode``, an
answerer replies to each, and the replies of a page are merged.  With a ``ShareRule`` a page's links are
options of shared questions and judged against each other.  With a store only requests that it does not hold are answered.

An answerer is any function from a post's body to a reply: ``answers`` by question (``level`` and ``confidence``,
``yes``, or ``shares`` by option) and ``input_tokens, output_tokens, latency_ms, model``.  It runs where the posts are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import plain_terms
from wayfare.operators.judging import DEFAULT_MODE, MODES, Judge, Mode, ShareRule, choice_keep, merge_answers, normalize_shares
from wayfare.operators.parse import previews
from wayfare.operators.request import CHOICE, NONE, PAGE, LinkContext, Packer, bounded_previews, compact
from wayfare.plans.tables import materialize
from wayfare.sources.store import JudgmentStore

Answerer = Callable[[dict], dict]

# Fixed values of the retry rule.
RETRIED, ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, TIMEOUT = (429, 529), 3, 0.25, 30.0, 120.0


class NoAnswer(RuntimeError):
    """A judge that could not be asked, or whose reply lacks an answer."""


# ---- answerers -------------------------------------------------------------------


def lexical_answerer(body: dict) -> dict:
    """A deterministic reply: every question's answer is the share of the query's terms in the text it is about
    (a page's content, a section's lines, a link's words and what is shown of its target)."""
    state = body["state"]
    wanted = list(dict.fromkeys(t for t in plain_terms(state["query"]) if len(t) >= 3))

    def share(text: str) -> float:
        held = set(plain_terms(text))
        return sum(t in held for t in wanted) / len(wanted) if wanted else 0.0

    content = state["file"].get("content", "")  # a choice is asked without it
    lines = content.split("\n")
    headed = next((s for s in state["sections"] if s["heading"]), None)
    top = next((i for i, line in enumerate(lines) if headed and headed["heading"] in line), None)
    before = headed["lines"][0] - 1 - top if headed and top is not None else 0  # lines of the page above its content's first

    def text_of(name: str) -> str:
        kind, _, n = name.partition("_")
        if kind == "section":
            first, last = state["sections"][int(n)]["lines"]
            return "\n".join(lines[max(first - 1 - before, 0) : max(last - before, 0)])
        return " ".join(_words(state["links"][int(n)]))

    answers: dict[str, dict] = {}
    for name, question in body["questions"].items():
        if name == PAGE:
            answers[name] = {"level": share(content) * (len(question["criteria"]) - 1), "confidence": 1.0}
        elif question["type"] == "choice":
            raw = {k: share(text) for k, text in question["criteria"].items() if k != NONE}
            raw[NONE] = 1.0 - max(raw.values(), default=0.0)
            answers[name] = {"shares": raw}
        else:
            answers[name] = {"yes": share(text_of(name))}
    return {"answers": answers, "input_tokens": -(-len(compact(body)) // 4), "output_tokens": 0, "latency_ms": 0, "model": "lexical"}


def _words(value: object) -> Iterator[str]:
    """All strings in a JSON value, without its keys and paths."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _words(v)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k not in ("target", "key"):
                yield from _words(v)


def remote_answerer(send: Callable[[str], tuple[int, dict, str]], wait: Callable[[float], None] = time.sleep) -> Answerer:
    """An answerer over a sender of JSON text that gives status, headers and body.

    A judge that is busy is asked again, twice at most: after what it says in ``retry-after``, else after a quarter of a
    second that doubles; never later than half a minute.
    """

    def answer(body: dict) -> dict:
        text = compact(body)
        for attempt in range(ATTEMPTS):
            status, headers, reply = send(text)
            if status == 200:
                return json.loads(reply)
            if status not in RETRIED or attempt + 1 == ATTEMPTS:
                break
            named = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            pause = float(named) if named.strip().isdigit() else FIRST_WAIT * 2**attempt
            wait(min(pause, LONGEST_WAIT))
        raise NoAnswer(f"status {status}")

    return answer


def http_sender(endpoint: str, token: str) -> Callable[[str], tuple[int, dict, str]]:
    """A sender that posts to an endpoint with a bearer token."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def send(text: str) -> tuple[int, dict, str]:
        request = Request(endpoint, text.encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
        try:
            with urlopen(request, timeout=TIMEOUT) as r:
                return r.status, dict(r.headers), r.read().decode()
        except HTTPError as e:
            return e.code, dict(e.headers), ""

    return send


# ---- requests --------------------------------------------------------------------


@dataclass(frozen=True)
class Asking:
    """How pages are asked about.  With ``keep`` links are judged against each other."""

    mode: Mode = MODES[DEFAULT_MODE]
    context: LinkContext = LinkContext()
    keep: ShareRule | None = None
    answer: Answerer = lexical_answerer
    endpoint: str = ""
    model: str = ""

    @property
    def packer(self) -> Packer:
        return Packer(self.mode, self.endpoint, self.model, self.context.two_hop)


def _plain(value: object) -> object:
    """Nested rows of a batch as JSON values."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if value is None:
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


_POSTS = "array<struct<body:string,sections:array<int>,links:array<int>>>"
_INFO = "info_sections array<struct<heading:string,first:int,last:int>>, info_links array<struct<target:string,in_root:boolean>>"


def _option(link: dict) -> str:
    """What an option of a choice says of a link."""
    return "\n".join([" | ".join(x for x in (link["anchor"], link["sentence"], link["heading"], link["target"]) if x), *(_words(link["preview"]) if link["preview"] else ())])


def _packed(asking: Asking):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = asking.packer
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                page = {"path": row["path"], "title": row["title"], "text": row["text"], "sections": _plain(row["sections"]) or [], "links": _plain(row["links"]) or []}
                if asking.keep is None:
                    posts, key = packer.pack(row["query"], page), None
                else:
                    posts = packer.pack(row["query"], {**page, "links": []})
                    options = [(i, _option(x)) for i, x in enumerate(page["links"]) if x["in_root"]]
                    posts += packer.pack_choices(row["query"], {"path": page["path"], "title": page["title"]}, options)
                    key = {"floor": asking.keep.least, "k": asking.keep.times_even}
                info = [{k: s[k] for k in ("heading", "first", "last")} for s in page["sections"]], [{k: x[k] for k in ("target", "in_root")} for x in page["links"]]
                listed = [{"body": compact(p.body), "sections": p.sections, "links": p.links} for p in posts]
                rows.append((row["query_id"], row["path"], packer.key(posts, key), listed, *info))
            yield pd.DataFrame(rows, columns=["query_id", "path", "key", "posts", "info_sections", "info_links"])

    return run


def requests(asked: DataFrame, parsed: DataFrame, pages: DataFrame, queries: DataFrame, asking: Asking) -> DataFrame:
    """``query_id, path, key, posts`` of asked rows (``query_id, path``), with what the answers are about."""
    own = parsed.join(F.broadcast(asked.select("path").distinct()), "path", "left_semi")  # a round's pages
    shown = bounded_previews(previews(parsed), asking.context)
    shown = shown.select(F.col("path").alias("target"), F.struct(*[c for c in shown.columns if c != "path"]).alias("preview"))
    links = own.select("path", F.posexplode("links").alias("pos", "l")).select("path", "pos", "l.*")
    targets = links.where("in_root").select("target").distinct()
    links = links.join(shown.join(targets, "target", "left_semi"), "target", "left")
    link = F.struct("pos", "anchor", "sentence", "heading", "target", "line", "in_root", F.when(F.col("in_root"), F.col("preview")).alias("preview"))
    # structs with arrays in them have an order of their own, so places are sorted apart
    lists = links.groupBy("path").agg(F.collect_list(link).alias("any_order"))
    lists = lists.select("path", F.array_sort("any_order", lambda a, b: a["pos"] - b["pos"]).alias("links"))
    rows = asked.select("query_id", "path").distinct().join(queries.select("query_id", "query"), "query_id")
    rows = rows.join(own.select("path", "title", "sections"), "path").join(pages.select("path", "text"), "path").join(lists, "path", "left")
    return rows.mapInPandas(_packed(asking), f"query_id string, path string, key string, posts {_POSTS}, {_INFO}")


# ---- replies ---------------------------------------------------------------------

_REPLY = (
    "key string, post int, level double, confidence double, sections array<struct<index:int,score:double>>, links array<struct<index:int,scent:double>>, "
    "questions int, input_tokens long, output_tokens long, latency_ms long, model string, error string"
)


def read_reply(body: dict, reply: dict, sections: list[int], links: list[int]) -> dict:
    """One post's reply as a row; an answer that is missing or of another kind is an error.  Of a choice, index -1 is none."""
    got = reply.get("answers", {})
    out: dict = {"level": None, "confidence": None, "sections": [], "links": []}

    def value(name: str, kind: str) -> object:
        found = got.get(name, {})
        if kind not in found:
            raise NoAnswer(f"no {kind} for {name}")
        return found[kind]

    for name in body["questions"]:
        if name == PAGE:
            out["level"], out["confidence"] = float(value(name, "level")), got[name].get("confidence")
        elif name == CHOICE:
            shares = value(name, "shares")
            for n, index in [*enumerate(links), (NONE, -1)]:
                if str(n) not in shares:
                    raise NoAnswer(f"no share of option {n}")
                out["links"].append({"index": index, "scent": float(shares[str(n)])})
        else:
            kind, _, n = name.partition("_")
            score = float(value(name, "yes"))
            if kind == "section":
                out["sections"].append({"index": sections[int(n)], "score": score})
            else:
                out["links"].append({"index": links[int(n)], "scent": score})
    counts = {k: int(reply.get(k) or 0) for k in ("input_tokens", "output_tokens", "latency_ms")}
    return {**out, **counts, "questions": len(body["questions"]), "model": reply.get("model"), "error": None}


def _replied(answer: Answerer):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _REPLY.replace("<index:int,score:double>", "").replace("<index:int,scent:double>", "").split(", ")]
        for batch in batches:
            rows = []
            for key, post, body, sections, links in zip(batch["key"], batch["post"], batch["body"], batch["sections"], batch["links"]):
                body = json.loads(body)
                try:
                    row = read_reply(body, answer(body), list(sections), list(links))
                except (NoAnswer, OSError, ValueError) as e:
                    row = {"level": None, "confidence": None, "sections": [], "links": [], "questions": len(body["questions"]), "input_tokens": 0, "output_tokens": 0, "latency_ms": 0, "model": None, "error": str(e) or type(e).__name__}
                rows.append({"key": key, "post": post, **row})
            yield pd.DataFrame(rows, columns=columns)

    return run


def answered(asked: DataFrame, asking: Asking) -> DataFrame:
    """``key, judgment, detail, error`` of requests: every post is answered once, wherever it lies."""
    each = asked.select("key", F.posexplode("posts").alias("post", "p")).select("key", "post", "p.body", "p.sections", "p.links")
    replies = materialize(each.mapInPandas(_replied(asking.answer), _REPLY), "replies")
    links = replies.select("key", "post", F.explode("links").alias("l")).select("key", "post", "l.index", F.col("l.scent").alias("share"))
    if asking.keep is not None:
        by = ["key", "post"]
        options = normalize_shares(links.withColumn("is_none", F.col("index") < 0), by)
        links = choice_keep(options, by, asking.keep, position="index")
    else:
        links = links.withColumn("keep", F.lit(True))
    judged = links.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("index", F.struct(F.col("share").alias("scent"), "keep")))).alias("by_place"))
    failed = replies.groupBy("key").agg(F.min("error").alias("error"))
    merged = merge_answers(replies, len(asking.mode.levels) - 1, ["key"]).drop("links")
    rows = asked.select("key", "info_sections", "info_links").join(failed, "key").join(merged, "key", "left").join(judged, "key", "left")
    sections = F.transform("sections", lambda s: F.struct(*[F.element_at("info_sections", s["index"] + 1)[c].alias(c) for c in ("heading", "first", "last")], s["score"].alias("score")))
    place = lambda i: F.try_element_at("by_place", i)
    each_link = F.transform(
        "info_links", lambda x, i: F.struct(x["target"].alias("target"), place(i)["scent"].alias("scent"), F.coalesce(place(i)["keep"], F.lit(False)).alias("keep"), x["in_root"].alias("in_root"))
    )
    whole = F.size("sections") == F.size("info_sections")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("relevance").isNull(), "the page was not scored").when(~whole, "a section was not answered")
    detail = F.struct("model", "questions", "requests", (F.col("relevance") * F.lit(float(len(asking.mode.levels) - 1))).alias("relevance_level"), F.col("confidence").alias("relevance_confidence"), "input_tokens", "output_tokens", "latency_ms")
    return rows.select("key", F.struct("relevance", sections.alias("sections"), each_link.alias("links")).alias("judgment"), detail.alias("detail"), error.alias("error"))


def asking_judge(parsed: DataFrame, pages: DataFrame, queries: DataFrame, asking: Asking = Asking(), store: JudgmentStore | None = None) -> Judge:
    """The judge: judgment rows with ``requests, input_tokens, latency_ms, bought`` and ``error`` where a page could not be judged."""
    held = store or JudgmentStore(parsed.sparkSession, None)

    def judge(asked: DataFrame) -> DataFrame:
        wanted = materialize(requests(asked, parsed, pages, queries, asking), "requests")
        rows = held.judge(wanted, lambda missing: answered(missing, asking))
        return rows.select(
            "query_id", "path", "judgment.relevance", "judgment.sections", "judgment.links", F.size("posts").alias("requests"), "detail.input_tokens", "detail.latency_ms", "bought", "error"
        )

    judge.name = "choice" if asking.keep else "noul"
    return judge
