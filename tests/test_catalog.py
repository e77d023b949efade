"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from wayfare.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows  # held against brute force below
        return
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())


def _naive_walk(links, entries, max_files, max_depth, threshold, beam):
    """One page at a time: the strongest route left, ties to the smaller path."""
    key = lambda p: p.split("/")
    closed, best, waiting, turns = {}, {}, set(), {}

    def take(path, score, depth):
        closed[path] = (score, depth)
        for target, scent in links.get(path, ()):
            if scent >= threshold and depth + 1 <= max_depth and target not in closed and (target not in best or best[target][0] < score * scent):
                best[target] = (score * scent, depth + 1)
                waiting.add(target)

    closed.update(dict.fromkeys(entries))
    for e in sorted(entries, key=key):
        take(e, 1.0, 0)
    while waiting and (max_files is None or len(closed) - len(entries) < max_files):
        path = min(waiting, key=lambda p: (-best[p][0], key(p)))
        waiting.discard(path)
        score, depth = best[path]
        if beam is not None and turns.get(depth, 0) >= beam:
            continue
        turns[depth] = turns.get(depth, 0) + 1
        take(path, score, depth)
    return closed


@pytest.mark.parametrize("name, limits", [("grouped_walk_budgeted", (25, 6, 0.6, None)), ("grouped_walk_beam", (None, 4, 0.5, 8)), ("reading_lists", (25, 6, 0.6, None))])
def test_walks_equal_a_naive_walk(spark, name, limits):
    judgments, entries = catalog._walk_inputs(spark, SF)
    pages, starts = {}, {}
    for r in judgments.collect():
        pages.setdefault(r.query_id, {})[r.path] = (r.relevance, [(x.target, x.scent) for x in r.links])
    for r in entries.collect():
        starts.setdefault(r.query_id, set()).add(r.path)
    want = {}
    for q, e in starts.items():
        for path, (score, depth) in _naive_walk({p: x[1] for p, x in pages[q].items()}, e, *limits).items():
            if name != "reading_lists" or pages[q][path][0] >= 0.6:
                want[q, path] = (score, depth)
    assert {(r.query_id, r.path): (r.path_score, r.depth) for r in catalog.queries()[name](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["grouped_walk_beam", "grouped_walk_budgeted", "reading_lists"])
def test_walks_judge_only_pages_they_ask_for(spark, monkeypatch, name):
    """No table of every page for every query is handed over."""
    seen = []
    whole = catalog.walk.grouped_walk
    monkeypatch.setattr(catalog.walk, "grouped_walk", lambda judgments, entries, config: seen.append(judgments) or whole(judgments, entries, config))
    monkeypatch.setattr(catalog.walk, "_whole_walk", None)
    assert catalog.queries()[name](spark, SF).columns and all(map(callable, seen)) and seen


def test_reading_lists_judge_entries_and_reached_pages_once(spark, monkeypatch):
    """What is judged for a query are its own entries and some pages about its walk, not every page for every query."""
    asked = []

    def counted(judgments, entries, config):
        if not callable(judgments):
            asked.append(judgments.select("query_id", "path"))
            return whole(judgments, entries, config)

        def judge(pages):
            asked.append(spark.createDataFrame(pages.select("query_id", "path").collect(), "query_id string, path string"))
            return judgments(pages)

        return whole(judge, entries, config)

    whole = catalog.walk.grouped_walk
    monkeypatch.setattr(catalog.walk, "grouped_walk", counted)
    sf = SF.replace("sf0.001", "sf0.01")
    rows = catalog.queries()["reading_lists"](spark, sf).collect()
    pages = [(r.query_id, r.path) for part in asked for r in part.collect()]
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert len(pages) == len(set(pages)) < 1.5 * customers and {(r.query_id, r.path) for r in rows} <= set(pages)


def test_posts_hold_every_line_once(spark):
    from wayfare.operators.request import REQUEST_BYTES

    lines = {str(r.doc_id): len(r.text.split("\n")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    posts = {}
    for r in catalog.queries()["pack_posts"](spark, SF).orderBy("path", "post").collect():
        assert r.questions == len(r.sections) + len(r.links) + (r.post == 0) and r.bytes <= REQUEST_BYTES
        posts.setdefault(r.path, []).extend(r.sections)
    assert posts == {p: list(range(n)) for p, n in lines.items()}


def test_core_queries_without_the_training_data_operators(monkeypatch):
    """A library that those need is not there: the core's queries are."""
    import sys
    import warnings

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("wayfare.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "wayfare.llm", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
