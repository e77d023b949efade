"""Registered queries over the driver's tables, each beside the SQL it must agree with.

Money is averaged in whole cents: their sums are exact in doubles, in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import text as tx
from wayfare.operators import experiment, graph, judging, metrics, parse, ranking, readlist, walk
from wayfare.plans.tables import Scratch, materialize, table
from wayfare.sources.records import best_piece
from wayfare.streaming.trace import trace_summary

QUERY = "the hated and tionwhst pathetic worthless idiot"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(column, digits: int = 6):
    return F.round(column, digits)


# ---- ranking ---------------------------------------------------------------------

_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: len(t) >= 3)"
_DOC_TERMS = f"SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents"


@_register(
    f"""
    WITH q AS (SELECT DISTINCT unnest({_TERMS.format(f"'{QUERY}'")}) AS term),
    d AS (SELECT doc_id, term, count(*) AS n FROM ({_DOC_TERMS}) GROUP BY ALL)
    SELECT doc_id, count(*) AS terms_matched, CAST(sum(n) AS BIGINT) AS occurrences,
           CAST(row_number() OVER (ORDER BY count(*) DESC, sum(n) DESC, doc_id) AS INT) AS rank
    FROM d JOIN q USING (term) GROUP BY doc_id QUALIFY rank <= 25
    """
)
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("q", QUERY)], "query_id string, query string")
    out = ranking.keyword_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), q, 25, "doc_id", F.col("doc_id"))
    return out.select("doc_id", "terms_matched", "occurrences", "rank")


@_register(
    f"""
    WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
    d AS (SELECT doc_id, term, count(*) AS n FROM ({_DOC_TERMS}) GROUP BY ALL)
    SELECT item_id, doc_id, count(*) AS terms_matched, CAST(sum(n) AS BIGINT) AS occurrences,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, sum(n) DESC, doc_id) AS INT) AS rank
    FROM d JOIN q USING (term) GROUP BY item_id, doc_id QUALIFY rank <= 10
    """
)
def keyword_topk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = ranking.keyword_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), q, 10, "doc_id", F.col("doc_id"))
    return out.select(F.col("query_id").alias("item_id"), "doc_id", "terms_matched", "occurrences", "rank")


@_register(
    f"""
    WITH q AS (SELECT DISTINCT unnest({_TERMS.format(f"'{QUERY}'")}) AS term), d AS (SELECT DISTINCT doc_id, term FROM ({_DOC_TERMS}))
    SELECT doc_id, round(count(*)::DOUBLE / (SELECT count(*) FROM q), 6) AS score FROM d JOIN q USING (term) GROUP BY doc_id
    """
)
def lexical_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("q", QUERY)], "query_id string, query string")
    return judging.lexical_scores(table(spark, sf_dir, "documents"), q, ["doc_id"]).select("doc_id", _r("score").alias("score"))


@_register("SELECT lang, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def read_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(tx.reading_tokens(F.sum(F.length("text"))).alias("tokens"))


_RANGES_SQL = "SELECT doc_id, 1 + doc_id % 3 AS first, 2 + doc_id % 5 AS last FROM documents UNION ALL SELECT doc_id, 2, 4 + doc_id % 2 FROM documents"


def _ranges(docs: DataFrame) -> DataFrame:
    """Two overlapping line ranges a document."""
    a = docs.select("doc_id", (1 + F.col("doc_id") % 3).alias("first"), (2 + F.col("doc_id") % 5).alias("last"))
    return a.unionByName(docs.select("doc_id", F.lit(2).cast("long").alias("first"), (4 + F.col("doc_id") % 2).alias("last")))


@_register(
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line,
                      len(string_split(text, chr(10))) AS n FROM documents),
    r AS ({_RANGES_SQL})
    SELECT doc_id, CAST(sum(length(body) + CASE WHEN line < n THEN 1 ELSE 0 END) AS BIGINT) AS chars, count(*) AS lines FROM l
    WHERE NOT (line = n AND body = '') AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.line BETWEEN r.first AND r.last) GROUP BY doc_id
    """
)
def range_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.coverage(docs, _ranges(docs), "doc_id")


@_register(
    f"""
    WITH r AS ({_RANGES_SQL}), w AS (SELECT doc_id, doc_id % 7 AS first, 1 + doc_id % 7 AS last FROM documents)
    SELECT doc_id, first, last FROM w WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.first <= r.last AND r.first <= w.last)
    """
)
def range_overlap_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    wanted = docs.select("doc_id", (F.col("doc_id") % 7).alias("first"), (1 + F.col("doc_id") % 7).alias("last"))
    return ranking.overlapping(wanted, _ranges(docs), ["doc_id"])


# ---- metrics ---------------------------------------------------------------------

_GOLD_SQL = "SELECT d.source AS query_id, d.doc_id AS page, 1 AS first, 5 AS last FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1"
_HITS_SQL = "SELECT source AS query_id, doc_id AS page, 1 + doc_id % 9 AS first, 3 + doc_id % 9 AS last, n_chars FROM documents WHERE n_chars > 800"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs.join(good, "doc_id").select("query_id", F.col("doc_id").alias("page"), F.lit(1).cast("long").alias("first"), F.lit(5).cast("long").alias("last"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars > 800")
    return docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("page"), (1 + F.col("doc_id") % 9).alias("first"), (3 + F.col("doc_id") % 9).alias("last"), "n_chars")


_SCORES_SQL = f"""
    WITH w AS ({_GOLD_SQL}), v AS ({_HITS_SQL}), r AS (SELECT * FROM v WHERE n_chars > 2000),
    s AS (SELECT w.query_id, count(DISTINCT w.page) AS gold, count(*) AS parts,
            count(DISTINCT CASE WHEN r.page IS NOT NULL THEN w.page END) AS found,
            count(DISTINCT CASE WHEN v.page IS NOT NULL THEN w.page END) AS reached,
            count(*) FILTER (r.page IS NOT NULL AND w.first <= r.last AND r.first <= w.last) AS parts_found
          FROM w LEFT JOIN v ON v.query_id = w.query_id AND v.page = w.page LEFT JOIN r ON r.query_id = w.query_id AND r.page = w.page GROUP BY w.query_id),
    n AS (SELECT query_id, count(*) AS visited, count(*) FILTER (n_chars > 2000) AS returned FROM v GROUP BY query_id),
    t AS (SELECT s.*, coalesce(visited, 0) AS visited, coalesce(returned, 0) AS returned FROM s LEFT JOIN n USING (query_id)),
    m AS (SELECT query_id, gold, returned, visited, found, reached, parts, parts_found, found::DOUBLE / gold AS recall,
            CASE WHEN returned = 0 THEN 0 ELSE found::DOUBLE / returned END AS precision,
            CASE WHEN visited = 0 THEN 0 ELSE found::DOUBLE / visited END AS precision_visited,
            parts_found::DOUBLE / parts AS section_recall, gold - reached AS unreached FROM t)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _hits(spark, sf_dir)
    got = seen.where("n_chars > 2000")
    return metrics.rates(metrics.score_lists(_gold(spark, sf_dir), got, seen, got))


@_register(
    _SCORES_SQL
    + "SELECT query_id, gold, returned, visited, found, reached, parts, parts_found, round(recall, 6) AS recall, round(precision, 6) AS precision, "
    "round(precision_visited, 6) AS precision_visited, round(section_recall, 6) AS section_recall, unreached FROM m"
)
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scored(spark, sf_dir)
    return out.withColumns({c: _r(c) for c in ("recall", "precision", "precision_visited", "section_recall")})


@_register(
    _SCORES_SQL
    + "SELECT round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, round(avg(precision_visited), 6) AS mean_precision_visited, "
    "round(avg(section_recall), 6) AS mean_section_recall, count(*) AS runs FROM m"
)
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.means(_scored(spark, sf_dir))
    return out.select(*[_r(c).alias(c) for c in out.columns if c != "runs"], "runs")


@_register(f"SELECT query_id, page FROM ({_GOLD_SQL}) EXCEPT SELECT query_id, page FROM ({_HITS_SQL})")
def unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unreached(_gold(spark, sf_dir), _hits(spark, sf_dir))


@_register(
    "SELECT round(avg(n / (SELECT count(*)::DOUBLE FROM documents)), 9) AS floor, CAST(count(*) * ceil((SELECT sum(length(text)) FROM documents) / 4.0) AS BIGINT) AS corpus_tokens "
    f"FROM (SELECT query_id, count(DISTINCT page) AS n FROM ({_GOLD_SQL}) GROUP BY query_id)"
)
def corpus_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    out = metrics.corpus_floor(_gold(spark, sf_dir), size["n"], size["c"])
    return out.select(_r("floor", 9).alias("floor"), "corpus_tokens")


_ARRIVALS_SQL = "SELECT user_id, event_id, (value % 1.0) AS scent, (value * 0.37 % 1.0) AS relevance, event_type = 'purchase' AS wanted, (value % 1.0) >= 0.6 AND event_id % 3 <> 0 AS followed FROM events WHERE value IS NOT NULL AND value >= 0"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null and value >= 0")
    scent = F.col("value") % F.lit(1.0)
    return e.select(
        "user_id",
        "event_id",
        scent.alias("scent"),
        (F.col("value") * 0.37 % F.lit(1.0)).alias("relevance"),
        (F.col("event_type") == "purchase").alias("wanted"),
        ((scent >= 0.6) & (F.col("event_id") % 3 != 0)).alias("followed"),
    )


@_register(
    f"SELECT CAST(least(floor(scent * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(scent), 6) AS mean_scent, round(avg(relevance), 6) AS mean_relevance, "
    f"round(avg(wanted::INT), 6) AS wanted_share FROM ({_ARRIVALS_SQL}) GROUP BY 1"
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration(_arrivals(spark, sf_dir))
    return out.select("bin", "n", *[_r(c).alias(c) for c in ("mean_scent", "mean_relevance", "wanted_share")])


@_register(
    f"SELECT CAST(least(floor(scent * 10), 9) AS INT) AS bin, count(*) AS n, count(*) FILTER (followed) AS followed, "
    f"coalesce(round((count(*) FILTER (followed AND wanted))::DOUBLE / nullif(count(*) FILTER (followed), 0), 6), 0) AS wanted_when_followed FROM ({_ARRIVALS_SQL}) GROUP BY 1"
)
def calibration_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_links(_arrivals(spark, sf_dir)).withColumn("wanted_when_followed", _r("wanted_when_followed"))


@_register(
    f"""SELECT count(*) FILTER (followed) AS followed, count(*) FILTER (NOT followed) AS passed,
    round((count(*) FILTER (followed AND wanted))::DOUBLE / count(*) FILTER (followed), 6) AS followed_wanted,
    round((count(*) FILTER (NOT followed AND wanted))::DOUBLE / count(*) FILTER (NOT followed), 6) AS passed_wanted,
    count(*) FILTER (NOT followed AND scent >= 0.6) AS passed_but_cleared FROM ({_ARRIVALS_SQL})"""
)
def follow_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.follow_decision(_arrivals(spark, sf_dir), 0.6).withColumns({c: _r(c) for c in ("followed_wanted", "passed_wanted")})


@_register(
    f"SELECT user_id, CAST(t.threshold AS DOUBLE) AS threshold, count(*) FILTER (scent >= t.threshold) AS kept, count(*) FILTER (scent >= t.threshold AND wanted) AS found, "
    f"count(*) FILTER (wanted) AS gold FROM ({_ARRIVALS_SQL}), (SELECT unnest([0.5, 0.6, 0.7, 0.8]) AS threshold) t GROUP BY ALL"
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arrivals(spark, sf_dir).withColumnRenamed("scent", "score")
    return metrics.threshold_sweep(a, ["user_id"])


@_register(
    "SELECT l_returnflag AS mode, count(*) AS served, count(*) FILTER (l_linestatus = 'O') AS bought, CAST(sum(l_linenumber) AS BIGINT) AS requests, "
    "CAST(sum(l_quantity) AS BIGINT) AS input_tokens, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS bought_tokens, round(avg(round(l_extendedprice * 100)), 4) AS mean_latency_ms, "
    "round(sum(l_linenumber)::DOUBLE / count(*), 6) AS requests_per_answer, round(sum(l_quantity) * 0.042 / 1000000, 9) AS cost, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS models FROM lineitem GROUP BY 1"
)
def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"),
        F.col("l_linenumber").alias("requests"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.round(F.col("l_extendedprice") * 100).alias("latency_ms"),
        (F.col("l_linestatus") == "O").alias("bought"),
        F.col("l_linestatus").alias("model"),
    )
    return metrics.spend(a, ["mode"]).withColumns({"mean_latency_ms": _r("mean_latency_ms", 4), "requests_per_answer": _r("requests_per_answer"), "cost": _r("cost", 9), "models": F.array_join("models", ",")})


# ---- ranking of sections -----------------------------------------------------------

_SECTIONS_SQL = "SELECT l_orderkey, list({'score': l_discount * 10, 'first': CAST(l_linenumber AS INT)}) AS sections FROM lineitem GROUP BY l_orderkey"


def _order_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    section = F.struct((F.col("l_discount") * 10).alias("score"), F.col("l_linenumber").cast("int").alias("first"))
    return li.groupBy("l_orderkey").agg(F.collect_list(section).alias("sections"))


@_register(
    f"SELECT o_orderkey, o_totalprice >= 400000 OR len(list_filter(sections, lambda s: s.score >= 0.95)) > 0 AS earns FROM orders JOIN ({_SECTIONS_SQL}) ON l_orderkey = o_orderkey"
)
def earns_a_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 400000, 1.0).otherwise(0.0).alias("relevance"))
    joined = orders.join(_order_sections(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", readlist.earns_a_place(0.95).alias("earns"))


@_register(
    "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_discount * 10 DESC, l_linenumber) AS lines FROM lineitem WHERE l_discount * 10 >= 0.6 GROUP BY l_orderkey"
)
def rank_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _order_sections(spark, sf_dir).select("l_orderkey", readlist.rank_sections("sections", 0.6).alias("s"))
    return out.where(F.size("s") > 0).select("l_orderkey", F.array_join(F.transform("s", lambda s: s["first"].cast("string")), ",").alias("lines"))


# ---- links and graphs --------------------------------------------------------------

_LINKS_SQL = """SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_linenumber AS pos, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_discount * 10 END AS scent,
    l_suppkey % 5 <> 0 AS in_root, CAST(l_linenumber % 4 AS INT) AS depth, l_partkey % 13 = 0 AS settled, l_partkey % 17 = 0 AS queued FROM lineitem"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("o"), "l_orderkey").alias("source"),
        F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_discount") * 10).alias("scent"),
        (F.col("l_suppkey") % 5 != 0).alias("in_root"),
        (F.col("l_linenumber") % 4).cast("int").alias("depth"),
        (F.col("l_partkey") % 13 == 0).alias("settled"),
        (F.col("l_partkey") % 17 == 0).alias("queued"),
    )


@_register(
    f"""SELECT CASE WHEN NOT in_root THEN 'out-of-root' WHEN scent IS NULL THEN 'unjudged' WHEN NOT (scent BETWEEN 0 AND 1 AND scent >= 0.3) THEN 'below-threshold'
    WHEN depth + 1 > 3 THEN 'past-depth' WHEN settled THEN 'already-reached' WHEN queued THEN 'already-queued' ELSE 'followed' END AS disposition, count(*) AS n FROM ({_LINKS_SQL}) GROUP BY 1"""
)
def link_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.disposition_census(walk.disposition(_links(spark, sf_dir), 0.3, 3))


@_register(f"SELECT source, target, min(pos) AS pos, min(round(coalesce(scent, -1), 6)) AS scent FROM (SELECT *, min(pos) OVER (PARTITION BY source, target) AS first_ FROM ({_LINKS_SQL})) WHERE pos = first_ GROUP BY ALL")
def dedupe_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select("source", "target", "pos", _r(F.coalesce("scent", F.lit(-1.0))).alias("scent"))
    first = parse.first_links(links.withColumn("at", F.struct("pos", "scent")), "source", "target", "at")
    return first.select("source", "target", "pos", "scent")


_EDGES_SQL = """SELECT DISTINCT 'c' || o_custkey AS source, 's' || l_suppkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0"""
_NODES_SQL = "SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    buys = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(name("c", "o_custkey").alias("source"), name("s", "l_suppkey").alias("target"))
    lies = t("supplier").select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"))
    nation = t("nation")
    up = nation.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))
    down = nation.where("n_nationkey % 2 = 0").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    return graph.edges(buys.unionByName(lies).unionByName(up).unionByName(down))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for p, name, key in (("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("n", "nation", "n_nationkey"), ("r", "region", "r_regionkey")):
        part = table(spark, sf_dir, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("node"))
        out = part if out is None else out.unionByName(part)
    return out


_DEGREES_SQL = f"""e AS ({_EDGES_SQL}), v AS ({_NODES_SQL}), g AS (SELECT node, (SELECT count(*) FROM e WHERE source = node) AS o, (SELECT count(*) FROM e WHERE target = node) AS i FROM v),
    d AS (SELECT 'out' AS direction, o AS d FROM g UNION ALL SELECT 'in', i FROM g)"""


@_register(f"WITH {_DEGREES_SQL} SELECT direction, min(d) AS min, median(d) AS median, round(avg(d), 6) AS mean, max(d) AS max FROM d GROUP BY direction")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.degree_stats(graph.degrees(_edges(spark, sf_dir), _nodes(spark, sf_dir)))
    return out.withColumn("mean", _r("mean"))


@_register(
    f"""WITH {_DEGREES_SQL} SELECT direction, CASE WHEN d = 0 THEN '0' WHEN d = 1 THEN '1' WHEN d = 2 THEN '2' WHEN d <= 4 THEN '3-4' WHEN d <= 9 THEN '5-9' WHEN d <= 19 THEN '10-19'
    WHEN d <= 49 THEN '20-49' ELSE '50+' END AS bucket, count(*) AS nodes FROM d GROUP BY ALL"""
)
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_histogram(graph.degrees(_edges(spark, sf_dir), _nodes(spark, sf_dir)))


@_register(f"SELECT node FROM ({_NODES_SQL}) WHERE node NOT IN (SELECT target FROM ({_EDGES_SQL}))")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_edges(spark, sf_dir), _nodes(spark, sf_dir))


@_register(
    f"""WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM b JOIN e ON source = node WHERE depth < 12)
    SELECT depth, count(*) AS nodes FROM (SELECT v.node, min(depth) AS depth FROM ({_NODES_SQL}) v LEFT JOIN b ON b.node = v.node GROUP BY v.node) GROUP BY depth"""
)
def reachable_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("c1",)], "node string")
    return graph.depth_histogram(graph.bfs_depth(_edges(spark, sf_dir), start), _nodes(spark, sf_dir))


_SCENT_SQL = "(40 + (length(source) * 7 + length(target) * 13 + CAST(substr(target, 2) AS INT) * 31) % 59) / 100.0::DOUBLE"


def _scented(edges: DataFrame) -> DataFrame:
    mix = (F.length("source") * 7 + F.length("target") * 13 + F.substring("target", 2, 20).cast("int") * 31) % 59
    return edges.withColumn("scent", (40 + mix) / F.lit(100.0))


@_register(
    f"""WITH RECURSIVE e AS (SELECT source, target, {_SCENT_SQL} AS scent FROM ({_EDGES_SQL})),
    q AS (SELECT DISTINCT source AS query_id FROM e WHERE source LIKE 'c%'),
    b AS (SELECT query_id, query_id AS path, 1.0::DOUBLE AS score, 0 AS hops FROM q
          UNION SELECT query_id, target, score * scent, hops + 1 FROM b JOIN e ON source = path WHERE hops < 6 AND scent >= 0.6)
    SELECT query_id, path, round(max(score), 9) AS path_score FROM b GROUP BY ALL"""
)
def best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every customer that a link leaves, the best product of scents to each page."""
    edges = _scented(_edges(spark, sf_dir)).where("scent >= 0.6 or source like 'c%'")
    edges = materialize(edges, "edges")
    starts = edges.where("source like 'c%'").select(F.col("source").alias("query_id"), F.col("source").alias("path")).distinct()
    return walk.closure(edges.where("scent >= 0.6"), starts).select("query_id", "path", _r("path_score", 9).alias("path_score"))


@_register(
    f"""WITH RECURSIVE e AS ({_EDGES_SQL}), reach AS (SELECT source AS a, target AS b FROM e WHERE source IN (SELECT target FROM e) UNION SELECT a, target FROM reach JOIN e ON source = b)
    SELECT CAST(coalesce(max(n), 1) AS BIGINT) AS largest_scc FROM (SELECT x.a, count(*) AS n FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"""
)
def largest_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_scc(_edges(spark, sf_dir), _nodes(spark, sf_dir))


def _links_by_page(edges: DataFrame) -> DataFrame:
    link = F.struct("target", "scent", F.lit(True).alias("keep"), F.lit(True).alias("in_root"))
    return _scented(edges).groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_list(link)).alias("links"))


def _judged() -> list:
    """What the region ``r`` says of a page with ``links``."""
    empty = F.array().cast("array<struct<target:string,scent:double,keep:boolean,in_root:boolean>>")
    number = F.substring("path", 2, 20).cast("int")
    relevance = (F.pmod(number * 37 + F.col("r") * 11, F.lit(100)) / 100.0).alias("relevance")
    sections = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit(1).alias("first"), F.lit(9).alias("last"), relevance.alias("score")))
    return [relevance, sections.alias("sections"), F.coalesce("links", empty).alias("links")]


def _walk_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Judgments of every page for each region's query, and the customers it starts from: every one, dealt to the queries."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("q"), F.col("r_regionkey")).alias("query_id"), F.col("r_regionkey").cast("int").alias("r"))
    sinks = _nodes(spark, sf_dir).select(F.col("node").alias("path")).join(_links_by_page(_edges(spark, sf_dir)), "path", "left")
    judgments = sinks.crossJoin(F.broadcast(regions)).select("query_id", "path", *_judged())  # a region is a query: five in all
    entries = table(spark, sf_dir, "customer").select(F.concat(F.lit("q"), F.col("c_custkey") % 5).alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("path"))
    return judgments, entries


def _walks(spark: SparkSession, sf_dir: str, config: walk.WalkConfig) -> DataFrame:
    """Walks over the judgments of ``_walk_inputs``, each made where a walk asks for its page: links are the same for every query."""
    _, entries = _walk_inputs(spark, sf_dir)
    scratch = Scratch(spark, "walk-edges")
    edges = scratch.table(_edges(spark, sf_dir), "edges")
    nodes = _nodes(spark, sf_dir).select(F.col("node").alias("path"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("q"), F.col("r_regionkey")).alias("query_id"), F.col("r_regionkey").cast("int").alias("r")).distinct()

    def judge(asked: DataFrame) -> DataFrame:
        near = edges.join(asked.select(F.col("path").alias("source")).distinct(), "source", "left_semi")
        return asked.join(nodes, "path", "left_semi").join(_links_by_page(near), "path", "left").join(F.broadcast(regions), "query_id").select(*asked.columns, *_judged())

    found = walk.grouped_walk(judge, entries, config)
    scratch.drop(edges)
    return found


@_register()
def grouped_walk_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir, walk.WalkConfig(max_files=25, max_depth=6, fanout=8, threshold=0.6))


@_register()
def grouped_walk_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir, walk.WalkConfig(max_files=None, max_depth=4, fanout=1, threshold=0.5, beam=8))


@_register()
def reading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = readlist.split_results(grouped_walk_budgeted(spark, sf_dir), 0.6)
    return results.select("query_id", "path", "relevance", "path_score", "depth", "via", "sections")


@_register(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM l GROUP BY page_id"""
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


# ---- judging -----------------------------------------------------------------------

_OPTIONS_SQL = "SELECT user_id, event_id AS position, abs(value) AS share, event_id % 10 = 0 AS is_none FROM events WHERE value IS NOT NULL"


@_register(
    f"""WITH o AS ({_OPTIONS_SQL}), s AS (SELECT user_id, position, is_none, CASE WHEN abs(sum(share) OVER w - 1) > 1e-6 AND sum(share) OVER w > 0 THEN share / sum(share) OVER w ELSE share END AS share
        FROM o WINDOW w AS (PARTITION BY user_id)),
    k AS (SELECT *, max(CASE WHEN is_none THEN share END) OVER w AS nn, max(CASE WHEN NOT is_none THEN share END) OVER w AS top, count(*) OVER w AS n,
        row_number() OVER (PARTITION BY user_id, is_none ORDER BY share DESC, position) AS rn FROM s WINDOW w AS (PARTITION BY user_id))
    SELECT user_id, position, round(share, 9) AS share, coalesce(top > nn AND (share >= greatest(0.02, least(3.0 / n, 0.5)) OR rn = 1), false) AS keep FROM k WHERE NOT is_none"""
)
def choice_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    options = e.select("user_id", F.col("event_id").alias("position"), F.abs("value").alias("share"), (F.col("event_id") % 10 == 0).alias("is_none"))
    out = judging.choice_keep(judging.normalize_shares(options, ["user_id"]), ["user_id"])
    return out.select("user_id", "position", _r("share", 9).alias("share"), "keep")


@_register("SELECT o_orderstatus AS model, round(sum(o_totalprice) / 1000000 * 0.042, 6) AS cost FROM orders GROUP BY 1")
def judge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(_r(judging.cost_usd(F.sum("o_totalprice"))).alias("cost"))


@_register()
def pack_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of every document with a section for each of its lines."""
    from wayfare.operators.request import Packer, pack_table

    docs = table(spark, sf_dir, "documents").where("text is not null")
    n = F.size(F.split("text", "\n", -1))
    sections = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("line "), i).alias("heading"), F.lit(1).alias("level"), i.alias("first"), i.alias("last")))
    links = F.array().cast("array<struct<anchor:string,sentence:string,heading:string,target:string,line:int>>")
    pages = docs.select(F.lit(QUERY).alias("query"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("title"), "text", sections.alias("sections"), links.alias("links"))
    return pack_table(pages, Packer(judging.MODES["useful-for"]))


# ---- experiments and logs ------------------------------------------------------------


@_register("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(round(value, 6), event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL")
def ledger_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "event_id", _r("value").alias("value"), F.col("event_id").alias("line"))
    return experiment.ledger_last(e, ["user_id", "event_type"]).drop("line")


@_register(
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS pops, count(DISTINCT event_id // 100) FILTER (event_type = 'purchase') AS files,
    count(*) FILTER (event_type = 'view') AS followed, max(event_id) AS duration_ms FROM events GROUP BY user_id"""
)
def trace_summary_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users read as walk traces: clicks as pops, views as followed links, purchases as results."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "popped").when(F.col("event_type") == "view", "admitted").when(F.col("event_type") == "purchase", "result").otherwise("other")
    null = lambda t: F.lit(None).cast(t)
    events = e.select("user_id", kind.alias("event"), F.floor(F.col("event_id") / 100).cast("string").alias("path"), null("string").alias("reason"), null("boolean").alias("cached"), null("boolean").alias("earned_a_place"), F.col("event_id").alias("t_ms"))
    return trace_summary(events, ["user_id"]).select("user_id", "pops", "files", "followed", "duration_ms")


_RUNS_SQL = "SELECT o_orderpriority AS condition, 'q' || (o_custkey % 7) AS query_id, o_orderstatus AS category, round(o_totalprice * 100) AS value, o_orderkey % 9 <> 0 AS ok FROM orders"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("condition"),
        F.concat(F.lit("q"), F.col("o_custkey") % 7).alias("query_id"),
        F.col("o_orderstatus").alias("category"),
        F.create_map(F.lit("price"), F.round(F.col("o_totalprice") * 100)).alias("metrics"),
        (F.col("o_orderkey") % 9 != 0).alias("ok"),
        F.lit(None).cast("string").alias("model_asked_for"),
    )


@_register(
    f"""SELECT CASE WHEN grouping(query_id) = 0 THEN 'query' WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS level, condition, query_id, category, 'price' AS metric,
    round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS least, round(max(value), 4) AS most, count(*) AS n
    FROM ({_RUNS_SQL}) WHERE ok GROUP BY GROUPING SETS ((condition), (condition, query_id), (condition, category))"""
)
def grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.grouped_stats(_runs(spark, sf_dir)).withColumns({c: _r(c, 4) for c in ("mean", "sd", "least", "most")})


@_register(f"SELECT condition, count(*) FILTER (NOT ok) AS failed FROM ({_RUNS_SQL}) GROUP BY 1")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.failed_runs(_runs(spark, sf_dir))


_PENDING_SQL = """WITH j AS (SELECT 'n' || n_nationkey AS query_id, r_name AS condition, CAST(k.k AS INT) AS repeat FROM nation, region, (SELECT unnest([1, 2, 3]) AS k) k
    UNION ALL SELECT 'n' || n_nationkey, r_name || '-cold', 1 FROM nation, region),
    d AS (SELECT DISTINCT 'n' || c_nationkey AS query_id, r_name AS condition, CAST(c_custkey % 4 AS INT) AS repeat FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    """


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    q = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("query_id"), F.col("n_nationkey").alias("seq"))
    c = region.select(F.col("r_name").alias("condition"), F.col("r_regionkey").alias("seq"))
    homes = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    done = homes.select(F.concat(F.lit("n"), "c_nationkey").alias("query_id"), F.col("r_name").alias("condition"), (F.col("c_custkey") % 4).cast("int").alias("repeat")).distinct()
    return experiment.pending_jobs(q, c, 3, done, cold=1)


@_register(_PENDING_SQL + "SELECT query_id, condition, repeat FROM j EXCEPT SELECT query_id, condition, repeat FROM d")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir).drop("seq")


@_register(
    _PENDING_SQL
    + """, p AS (SELECT * FROM j EXCEPT SELECT * FROM d),
    m AS (SELECT r_name AS condition, avg(CASE WHEN s_suppkey % 2 = 0 AND r_name <> 'ASIA' THEN s_acctbal END) AS same, avg(s_acctbal) AS any_ FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT p.condition, count(*) AS jobs, round(any_value(coalesce(same, any_, 0)), 6) AS each, round(count(*) * any_value(coalesce(same, any_, 0)), 6) AS total, any_value(coalesce(same, any_)) IS NULL AS is_floor
    FROM p LEFT JOIN m ON m.condition = p.condition GROUP BY 1"""
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    paid = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    costs = paid.select(F.col("r_name").alias("condition"), F.col("s_acctbal").alias("cost_usd"), F.when((F.col("s_suppkey") % 2 == 0) & (F.col("r_name") != "ASIA"), "here").otherwise("there").alias("wiki"))
    return experiment.estimate(_pending(spark, sf_dir), costs, "here").withColumns({"each": _r("each"), "total": _r("total")})


@_register(
    "WITH p AS (SELECT role, conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, arg_max(turn, n * 1000 - turn) AS turn, max(n) AS n FROM p GROUP BY conv_id"
)
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return best_piece(c, ["conv_id"], "n", "turn").select("conv_id", "turn", "n")


@_register(
    """WITH w AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1), g AS (SELECT doc_id, source FROM documents WHERE n_chars > 1500)
    SELECT coalesce(a.source, b.source) AS query_id, coalesce(round(h::DOUBLE / a.n, 6), 0) AS recall, coalesce(round(h::DOUBLE / b.n, 6), 0) AS precision
    FROM (SELECT source, count(*) n FROM w GROUP BY 1) a FULL JOIN (SELECT source, count(*) n FROM g GROUP BY 1) b ON a.source = b.source
    LEFT JOIN (SELECT w.source, count(*) h FROM w JOIN g USING (doc_id) GROUP BY 1) c ON c.source = coalesce(a.source, b.source)"""
)
def set_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("page"), "n_chars")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page"))
    out = experiment.set_rates(d.where("n_chars > 1500"), d.join(good, "page", "left_semi"))
    return out.select("query_id", _r("recall").alias("recall"), _r("precision").alias("precision"))


@_register(
    """WITH now AS (SELECT o_orderkey AS k, CAST(o_orderkey % 50 + 100 AS BIGINT) AS t FROM orders), old AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
    SELECT count(*) AS entries, CAST(sum(t) AS BIGINT) AS input_tokens, round(sum(t) * 0.042 / 1000000, 9) AS cost FROM now WHERE k NOT IN (SELECT k FROM old)"""
)
def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    now = o.select(F.col("o_orderkey").alias("key"), F.struct((F.col("o_orderkey") % 50 + 100).cast("long").alias("input_tokens")).alias("detail"))
    return experiment.store_diff(now, now.where("key % 3 = 0")).withColumn("cost", _r("cost", 9))


@_register(
    """WITH h AS (SELECT l_orderkey AS path, CAST(l_linenumber AS INT) AS line, CAST(1 + l_suppkey % 3 AS INT) AS level FROM lineitem)
    SELECT a.path, a.level, a.line, 8 AS last_line, CAST(coalesce(min(b.line) - 1, 8) AS INT) AS ends FROM h a LEFT JOIN h b ON a.path = b.path AND b.line > a.line AND b.level <= a.level GROUP BY a.path, a.level, a.line"""
)
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    h = li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("int").alias("line"), (1 + F.col("l_suppkey") % 3).cast("int").alias("level"), F.lit(8).alias("last_line"))
    return parse.section_ranges(h).withColumn("ends", F.col("ends").cast("int"))


@_register(
    """WITH p AS (SELECT doc_id, 'src/' || source || '/' || doc_id || '.md' AS path, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
    SELECT p.path, 'Page ' || p.doc_id AS title, CAST(2 AS INT) AS n_sections, CAST(CASE WHEN k.path IS NULL THEN 1 ELSE 2 END AS INT) AS n_links,
           'src/' || p.source || '/' || (p.doc_id * 7) % 100 || '.md' || coalesce(' ' || k.path, '') AS targets
    FROM p LEFT JOIN p k ON k.doc_id = p.doc_id % 50"""
)
def parse_generated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as linked markdown pages, parsed back: titles, sections, resolved links.

    Their texts hold no markdown, so what is parsed is what was written around them.
    """
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    target = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.pmod(F.col("doc_id") * 7, F.lit(100)), F.lit(".md"))
    body = F.concat(F.lit("# Page "), "doc_id", F.lit("\n\n"), "text", F.lit("\n\n## More\n\nSee [next](../../"), target, F.lit(") and [["), F.pmod("doc_id", F.lit(50)), F.lit("]].\n"))
    pages = d.select(F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"), body.alias("text"))
    parsed = parse.parse_pages(pages)
    targets = F.array_join(F.transform("links", lambda x: x["target"]), " ")
    return parsed.select("path", "title", F.size("sections").alias("n_sections"), F.size("links").alias("n_links"), targets.alias("targets"))
