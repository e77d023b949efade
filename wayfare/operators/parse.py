"""Pages to nested rows: titles, frontmatter, sections and resolved links.

The scanner runs over Arrow batches; resolving link targets is relational.
A wikilink by name is an equi-join with an index of file names, one by path an
equi-join of its candidates with the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions import text as tx
from wayfare.operators import markdown
from wayfare.plans.tables import materialize

_RAW_LINKS = (
    "array<struct<pos:int,kind:string,target:string,name:string,by_stem:boolean,candidates:array<string>,"
    "anchor:string,sentence:string,heading:string,line:int>>"
)
_RAW = f"path string, title string, frontmatter {schema.FRONTMATTER}, sections {schema.SECTIONS}, first_paragraph string, raw_links {_RAW_LINKS}"


def _raw_link(pos: int, link: markdown.RawLink, found: markdown.Scan, directory: str) -> dict | None:
    out = {"pos": pos, "kind": link.kind, "target": None, "name": None, "by_stem": None, "candidates": None, "anchor": link.anchor}
    out |= {"sentence": link.sentence, "heading": None if link.heading is None else found.headings[link.heading].text, "line": link.line}
    if link.kind == "markdown":
        out["target"] = tx.resolve_markdown(link.dest, directory)
        return out if out["target"] is not None else None
    dest = tx.trim(link.dest.split("#", 1)[0])
    if not dest or tx.is_external(dest) or dest.startswith("/"):
        return None
    if "/" not in dest:
        return out | {"name": dest, "by_stem": tx.extension(dest) is None}
    names = [dest] if tx.is_page(dest) else [f"{dest}.md", f"{dest}.txt"]
    return out | {"candidates": [tx.normalize(tx.join_path(directory, n)) for n in names]}


def scan_page(path: str, text: str) -> dict:
    """One page as a row of ``_RAW``."""
    found = markdown.scan(text)
    h1 = next((h.text for h in found.headings if h.level == 1), None)
    title = found.title if found.title is not None else h1 if h1 is not None else tx.file_stem(path)
    links = [_raw_link(i, x, found, tx.parent(path)) for i, x in enumerate(found.links)]
    return {
        "path": path,
        "title": title,
        "frontmatter": [{"key": k, "value": v} for k, v in found.frontmatter],
        "sections": [{"heading": h, "level": n, "first": a, "last": z} for h, n, a, z in markdown.sections(found, text)],
        "first_paragraph": found.first_paragraph,
        "raw_links": [x for x in links if x is not None],
    }


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "title", "frontmatter", "sections", "first_paragraph", "raw_links"]
    for batch in batches:
        yield pd.DataFrame([scan_page(p, t) for p, t in zip(batch["path"], batch["text"])], columns=columns)


def scan_pages(pages: DataFrame) -> DataFrame:
    """``pages(path, text)`` scanned, links not yet resolved.  Rows without path or text are left out."""
    return pages.where("path is not null and text is not null").select("path", "text").mapInPandas(_scan, _RAW)


def name_index(pages: DataFrame) -> DataFrame:
    """``name, by_stem, named``: the page each file name and stem stands for (``.md`` first, then path order)."""
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    rank = F.struct((~F.lower("path").endswith(".md")).alias("other"), parts.alias("parts"), F.col("path").alias("named"))
    both = pages.select(F.explode(F.array(F.struct(file.alias("name"), F.lit(False).alias("by_stem")), F.struct(stem.alias("name"), F.lit(True).alias("by_stem")))).alias("k"), rank.alias("rank"))
    return both.groupBy("k.name", "k.by_stem").agg(F.min("rank")["named"].alias("named"))


def resolve_links(scanned: DataFrame, pages: DataFrame) -> DataFrame:
    """``path, pos, target, anchor, sentence, heading, line, in_root, kind``: one row a link that resolves."""
    links = scanned.select("path", F.explode("raw_links").alias("l")).select("path", "l.*")
    names = name_index(pages.select("path"))
    markdown_links = links.where("target is not null")
    by_name = links.where("name is not null").join(names, ["name", "by_stem"]).withColumn("target", F.col("named")).drop("named")
    listed = links.where("candidates is not null").select("*", F.posexplode("candidates").alias("choice", "candidate"))
    exists = listed.join(pages.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    by_path = exists.groupBy("path", "pos").agg(F.min_by("candidate", "choice").alias("target"), *[F.first(c).alias(c) for c in ("kind", "anchor", "sentence", "heading", "line")])
    columns = ["path", "pos", "target", "anchor", "sentence", "heading", "line", "kind"]
    out = markdown_links.select(columns).unionByName(by_name.select(columns)).unionByName(by_path.select(columns))
    return out.withColumn("in_root", ~tx.out_of_root(F.col("target")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(path, text)`` to parsed rows; links in document order.

    Every page is scanned once: what the scanner gives is written to the shared folder, and links are resolved from there.
    """
    scanned = materialize(scan_pages(pages), "scanned")
    entry = F.struct("pos", "target", "anchor", "sentence", "heading", "line", "in_root", "kind")
    lists = resolve_links(scanned, pages).groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    no_pos = F.transform("l", lambda x: x.dropFields("pos"))
    return (
        scanned.select("path", "title", "frontmatter", "sections", "first_paragraph")
        .join(lists, "path", "left")
        .withColumn("links", F.coalesce(no_pos, F.array().cast(schema.LINKS)))
        .drop("l")
    )


def previews(parsed: DataFrame) -> DataFrame:
    """What a link's judge sees of its target."""
    headings = F.transform(F.filter("sections", lambda s: s["level"].isin(2, 3)), lambda s: s["heading"])
    leads = F.transform(F.filter("links", lambda x: x["in_root"]), lambda x: x["anchor"])
    return parsed.select("path", "title", "frontmatter", "first_paragraph", headings.alias("headings"), leads.alias("leads"))


DEEPEST = 6


def section_ranges(headings: DataFrame, key: str = "path") -> DataFrame:
    """Relational section ranges: ``key, level, line, last_line`` to the line each section ends on.

    One pass over a page's headings from the last line up: for each level (0, before any heading, to 6) the nearest later
    heading of that level or a higher one.
    """
    later = Window.partitionBy(key).orderBy(F.col("line").desc()).rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.array(*[F.min(F.when(F.col("level") <= n, F.col("line"))).over(later) for n in range(DEEPEST + 1)])
    following = F.element_at(nearest, F.least(F.col("level"), F.lit(DEEPEST)).cast("int") + 1)
    rows = headings.select(key, "level", "line", "last_line", F.coalesce(following - 1, F.col("last_line")).alias("ends"))
    return rows.groupBy(key, "level", "line", "last_line").agg(F.first("ends").alias("ends"))  # repeated rows once; no further shuffle


def first_links(links: DataFrame, source: str = "path", target: str = "target", position: str = "pos") -> DataFrame:
    """One row for each source and target: the first by position."""
    others = [c for c in links.columns if c not in (source, target)]
    return links.groupBy(source, target).agg(*[F.min_by(c, position).alias(c) for c in others])


def keep_column(column: Column) -> Column:
    """A missing keep verdict counts as yes."""
    return F.coalesce(column, F.lit(True))
