"""Link-graph statistics."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.plans.tables import Scratch

BUCKETS = ((0, "0"), (1, "1"), (2, "2"), (4, "3-4"), (9, "5-9"), (19, "10-19"), (49, "20-49"))


def link_counts(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, words, headings and links of a corpus: by kind, resolved, broken and outside the root."""
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    corpus = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
    headings = parsed.agg(F.coalesce(F.sum(F.size(F.filter("sections", lambda s: s["heading"].isNotNull()))), F.lit(0)).alias("headings"))
    links = parsed.select(F.explode("links").alias("l")).select("l.*")
    known = pages.select(F.col("path").alias("target"), F.lit(True).alias("exists"))
    there = F.coalesce("exists", F.lit(False))
    counts = links.join(known, "target", "left").agg(
        F.count("*").alias("links"),
        F.count_if(F.col("kind") == "markdown").alias("markdown"),
        F.count_if(F.col("kind") == "wikilink").alias("wikilink"),
        F.count_if(F.col("in_root") & there).alias("resolved"),
        F.count_if(F.col("in_root") & ~there).alias("broken"),
        F.count_if(~F.col("in_root")).alias("outside"),
    )
    return corpus.crossJoin(headings).crossJoin(counts)  # one row each


def edges(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct edges without self-links."""
    return links.where(F.col(source) != F.col(target)).select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()


def degrees(edge_rows: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """``node, out_degree, in_degree`` of every node, zero included."""
    both = edge_rows.select(F.col("source").alias("n_"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edge_rows.select(F.col("target").alias("n_"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    counts = both.groupBy("n_").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select(F.col(node).alias("node")).join(counts, F.col("node") == F.col("n_"), "left").select("node", zero("out_degree"), zero("in_degree"))


def degree_stats(degree_rows: DataFrame) -> DataFrame:
    """min, median, mean and max by direction."""
    long = degree_rows.select(F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("d")), F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("d")))).alias("x")).select("x.*")
    return long.groupBy("direction").agg(F.min("d").alias("min"), F.median("d").alias("median"), F.avg("d").alias("mean"), F.max("d").alias("max"))


def degree_bucket(degree: Column) -> Column:
    out = F.when(degree <= BUCKETS[0][0], BUCKETS[0][1])
    for most, name in BUCKETS[1:]:
        out = out.when(degree <= most, name)
    return out.otherwise("50+")


def degree_histogram(degree_rows: DataFrame) -> DataFrame:
    """Nodes by bucket of degree and direction."""
    out = degree_rows.groupBy(F.lit("out").alias("direction"), degree_bucket(F.col("out_degree")).alias("bucket")).agg(F.count("*").alias("nodes"))
    into = degree_rows.groupBy(F.lit("in").alias("direction"), degree_bucket(F.col("in_degree")).alias("bucket")).agg(F.count("*").alias("nodes"))
    return out.unionByName(into)


def orphans(edge_rows: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes no edge leads to."""
    return nodes.select(F.col(node).alias("node")).join(edge_rows.select(F.col("target").alias("node")), "node", "left_anti")


def bfs_depth(edge_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``node, depth`` of every node reachable from ``entries(node)``: edges are written once, then frontier by
    frontier, each a written table; every eighth round the tables so far become one."""
    scratch = Scratch(edge_rows.sparkSession, "bfs")
    steps = scratch.table(edge_rows.select("source", "target"), "edges")
    frontier = scratch.table(entries.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    parts, seen = [frontier], frontier
    for depth in count(1):
        reached = frontier.join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = scratch.table(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            scratch.drop(steps, frontier)
            return seen
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = scratch.table(seen, "seen")
            scratch.drop(*[p for p in parts if p is not frontier])
            parts = [seen]


def depth_histogram(depths: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes by hop count; null counts the unreachable."""
    return nodes.select(F.col(node).alias("node")).join(depths, "node", "left").groupBy("depth").agg(F.count("*").alias("nodes"))


def strong_components(edge_rows: DataFrame) -> DataFrame:
    """``node, scc`` of nodes that lie on a cycle, by colouring: the largest node id spreads
    forwards as a colour, then each colour's root collects, backwards and within the colour,
    the nodes of its component.  Trimming takes nodes without way in or out away first.
    Every step is a join over written tables; nothing is collected."""
    scratch = Scratch(edge_rows.sparkSession, "scc")
    left = scratch.table(edge_rows.select("source", "target"), "left")
    found: list[DataFrame] = []
    while True:
        left = _trim(left, scratch)
        if left.isEmpty():
            break
        nodes = left.select(F.col("source").alias("node")).unionByName(left.select(F.col("target").alias("node"))).distinct()
        color = scratch.table(nodes.select("node", F.col("node").alias("color"), F.lit(True).alias("moved")), "color")
        while not color.where("moved").isEmpty():
            came = color.where("moved").join(left, F.col("node") == F.col("source")).groupBy(F.col("target").alias("to")).agg(F.max("color").alias("c"))
            step = color.join(came, F.col("node") == F.col("to"), "left").select("node", F.greatest("color", F.coalesce("c", "color")).alias("color"), F.coalesce(F.col("c") > F.col("color"), F.lit(False)).alias("moved"))
            before, color = color, scratch.table(step, "color")
            scratch.drop(before)
        inside = left.join(color.select(F.col("node").alias("s"), F.col("color").alias("cs")), F.col("source") == F.col("s")).join(
            color.select(F.col("node").alias("t"), F.col("color").alias("ct")), F.col("target") == F.col("t")
        )
        inside = inside.where("cs = ct").select(F.col("target").alias("source"), F.col("source").alias("target"))
        members = bfs_depth(inside, color.where("node = color").select("node"))
        found.append(scratch.table(members.select("node").join(color.drop("moved"), "node").select("node", F.col("color").alias("scc")), "found"))
        gone = found[-1].select("node")
        before = left
        left = scratch.table(left.join(gone, F.col("source") == F.col("node"), "left_anti").join(gone, F.col("target") == F.col("node"), "left_anti"), "left")
        scratch.drop(before, color)
        if len(found) == 8:
            merged = scratch.table(_union(found), "found")
            scratch.drop(*found)
            found = [merged]
    scratch.drop(left)
    return _union(found) if found else edge_rows.limit(0).select(F.col("source").alias("node"), F.col("source").alias("scc"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _trim(edge_rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between nodes that have both a way in and a way out, repeated while it helps."""
    n = edge_rows.count()
    while n:
        into = edge_rows.select(F.col("target").alias("x")).distinct()
        out = edge_rows.select(F.col("source").alias("x")).distinct()
        kept = edge_rows.join(into, F.col("source") == F.col("x"), "left_semi").join(out, F.col("target") == F.col("x"), "left_semi")
        kept = scratch.table(kept, "trim")
        m = kept.count()
        scratch.drop(edge_rows)
        edge_rows = kept
        if m == n:
            break
        n = m
    return edge_rows


def largest_scc(edge_rows: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Size of the largest strongly connected component (1 when there is no cycle, 0 without nodes)."""
    sizes = strong_components(edge_rows).groupBy("scc").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    alone = nodes.select(F.col(node)).limit(1).agg(F.count("*").alias("one"))
    return sizes.crossJoin(alone).select(F.coalesce("n", "one").cast("long").alias("largest_scc"))


def statistics(parsed: DataFrame, pages: DataFrame, entries: list[str] | None = None) -> dict:
    """Everything about a corpus's link graph as one nested value: counts, degrees with histograms, orphans, depths from
    the entries (``index.md``, else ``README.md``) and the largest strong component.  Only aggregates reach the driver."""
    scratch = Scratch(pages.sparkSession, "graph")
    links = parsed.select(F.col("path").alias("source"), F.explode("links.target").alias("target"))
    known = links.join(pages.select(F.col("path").alias("target")), "target", "left_semi")
    edge_rows = scratch.table(edges(known), "edges")
    nodes = pages.select(F.col("path").alias("node"))
    counts = link_counts(parsed, pages).first().asDict()
    degree_rows = scratch.table(degrees(edge_rows, nodes), "degrees")
    spread: dict[str, dict] = {r["direction"]: {k: r[k] for k in ("min", "median", "mean", "max")} | {"histogram": {}} for r in degree_stats(degree_rows).collect()}
    names = [name for _, name in BUCKETS] + ["50+"]
    for r in sorted(degree_histogram(degree_rows).collect(), key=lambda r: names.index(r["bucket"])):
        spread[r["direction"]]["histogram"][r["bucket"]] = r["nodes"]
    if entries is None:
        there = {r["node"] for r in nodes.where(F.col("node").isin("index.md", "README.md")).collect()}
        entries = [p for p in ("index.md", "README.md") if p in there][:1]
    starts = pages.sparkSession.createDataFrame([(p,) for p in entries], "node string").join(nodes, "node", "left_semi")
    depths = {r["depth"]: r["nodes"] for r in depth_histogram(bfs_depth(edge_rows, starts), nodes).collect()}
    out = {
        **{k: counts[k] for k in ("pages", "words", "headings")},
        "links": {"total": counts["links"], **{k: counts[k] for k in ("markdown", "wikilink", "resolved", "broken", "outside")}},
        "edges": edge_rows.count(),
        **{f"{d}_degree": spread.get(d) for d in ("out", "in")},
        "orphans": orphans(edge_rows, nodes).count(),
        "depth": {"entry": entries, "histogram": {str(k): depths[k] for k in sorted(x for x in depths if x is not None)}, "unreachable": depths.get(None, 0)},
        "largest_scc": largest_scc(edge_rows, nodes).first()[0],
    }
    scratch.keep_only()
    return out
