"""Parsing, judging, metrics, graphs, sources and logs over small tables."""

import json
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from wayfare.functions import text as tx
from wayfare.operators import experiment, graph, judging, metrics, parse, ranking, request
from wayfare.operators.walk import WalkConfig
from wayfare.plans import render
from wayfare.plans.run import EntryIgnored, Options, run_query
from wayfare.sources import pages as ps
from wayfare.sources import records
from wayfare.sources.ignore import IgnoreError, IgnoreRules
from wayfare.sources.store import JudgmentStore, calls, location, read_entries
from wayfare.streaming.trace import best_paths, stream_trace, streaming_counts, trace_summary

GARDEN = {
    "index.md": "---\ntitle: Garden\n---\n# Garden\n\nSee [beds](beds/README.md), [[sowing]] and [shed](../shed.md).\n",
    "beds/README.md": "# Beds\n\nOverview of the beds.\n\n## Raised beds\n\n[frost](frost.md#x) and [gone](compost.md).\n\n### Covers\n\nTen nights.\n",
    "beds/frost.md": "## Frost dates\n\nLast frosts. See [[log/sowing]] or [[../log/sowing]].\n",
    "log/sowing.md": "# The sowing log\n\nEvery row. [[books]] [w](last%20week.md)\n",
    "log/books.md": "# Books\n",
    "log/books.txt": "plain\n",
    "log/last week.md": "# Last week\n",
    ".hidden/x.md": "# no\n",
    "log/picture.png": "no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("garden")
    for path, text in GARDEN.items():
        file = base / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def corpus(spark, root):
    return ps.load_corpus(spark, root).cache()


def test_paths():
    assert tx.normalize("a/./b/../c") == "a/c" and tx.normalize("../a/../../b") == "../../b"
    assert tx.relative_to_root("wiki", "wiki/notes/x.md") == "notes/x.md" and tx.relative_to_root("wiki/a", "wiki/x.md") == "../x.md"
    assert tx.from_root("wiki", "../x.md") == "x.md"
    assert sorted(["notes-old/y", "notes/x"], key=tx.components) == ["notes/x", "notes-old/y"]
    assert tx.resolve_markdown("a%20b.md#c", "d") == "d/a b.md" and tx.resolve_markdown("a%zz.txt", "") == "a%zz.txt"
    assert [tx.resolve_markdown(x, "") for x in ("http://a/b.md", "/x.md", "x.png", "#a", "")] == [None] * 5
    assert tx.split_lines("a\n\x0bb\n") == ["a", "\x0bb"] and tx.trim("\x1c a ") == "\x1c a"


def test_listing_and_revision(spark, root, corpus):
    assert [r.path for r in ps.list_pages(spark, root).collect()] == ["beds/README.md", "beds/frost.md", "index.md", "log/books.md", "log/books.txt", "log/last week.md", "log/sowing.md"]
    assert len(ps.revision(corpus)) == 64
    bad = spark.createDataFrame([("a.md", b"\xff\xfe"), ("b.md", b"ok")], "path string, content binary")
    good, failed = ps.read_pages(bad)
    assert [r.path for r in good.collect()] == ["b.md"] and failed.first().error == "not UTF-8"


def test_parsed_pages(corpus):
    got = {r.path: r for r in parse.parse_pages(corpus).collect()}
    assert got["index.md"].title == "Garden" and got["beds/frost.md"].title == "frost"
    assert [(x.target, x.in_root, x.kind) for x in got["index.md"].links] == [("beds/README.md", True, "markdown"), ("log/sowing.md", True, "wikilink"), ("../shed.md", False, "markdown")]
    assert [x.target for x in got["beds/frost.md"].links] == ["log/sowing.md"]
    assert [x.target for x in got["log/sowing.md"].links] == ["log/books.md", "log/last week.md"]
    previews = {r.path: r for r in parse.previews(parse.parse_pages(corpus)).collect()}
    assert previews["beds/README.md"].headings == ["Raised beds", "Covers"] and previews["index.md"].leads == ["beds", "sowing"]


def test_section_ranges_equal_the_scanner(spark):
    levels = [2, 3, 1, 2, 2, 4, 3, 1, 6, 5]
    text = "".join(f"{'#' * n} H{i}\n\nbody\n\n" for i, n in enumerate(levels))
    from wayfare.operators import markdown

    want = {(n, a, z) for _, n, a, z in markdown.sections(markdown.scan(text), text)}
    rows = spark.createDataFrame([("p", n, 1 + 4 * i, 4 * len(levels)) for i, n in enumerate(levels)], "path string, level int, line int, last_line int")
    assert {(r.level, r.line, r.ends) for r in parse.section_ranges(rows).collect()} == want


def test_ignore_rules(spark):
    rules = IgnoreRules.of("private/\n!private/open.md\n*.log\n!keep.log\n/top/*.md\na/**/z.txt\n")
    want = {"private/open.md": True, "x.log": True, "keep.log": False, "top/a.md": True, "top/b/a.md": False, "a/b/z.txt": True, "../private/x": False, "q.md": False}
    assert {p: rules.matched(p) for p in want} == want
    rows = spark.createDataFrame([(p,) for p in want], "path string").withColumn("i", rules.predicate(F.col("path")))
    assert {r.path: r.i for r in rows.collect()} == want
    with pytest.raises(IgnoreError):
        IgnoreRules.of("[a")
    assert IgnoreRules.load("/nonexistent/rules") == IgnoreRules.none()


def test_run_query(spark, corpus):
    found = run_query(spark, corpus, Options("beds covers", ("index.md",), threshold=0.3, walk=WalkConfig(threshold=0.3)))
    assert found.exit_code == 0 and "beds/README.md" in [r["path"] for r in found.results]
    assert json.loads(render.render(found, "json"))["query"] == found.query
    with pytest.raises(EntryIgnored):
        run_query(spark, corpus, Options("q", ("index.md",), ignore=IgnoreRules.of("index.md")))


def test_share_rule(spark):
    """Against the rule by hand: the cut is the evened share within its bounds, the largest stays, staying beats all."""
    cases = {"a": ([0.5, 0.3, 0.01], 0.19), "b": ([0.2, 0.2], 0.6), "c": ([0.4, 0.4], 0.2), "d": ([0.01, 0.02], 0.005), "e": ([0.09] * 9 + [0.1], 0.05), "f": ([0.3, 0.3], 0.3)}
    rows = [(q, i, s, False) for q, (shares, none) in cases.items() for i, s in enumerate(shares)] + [(q, 99, none, True) for q, (_, none) in cases.items()]
    options = spark.createDataFrame(rows, "q string, position int, share double, is_none boolean")
    for rule in (judging.ShareRule(), judging.ShareRule(least=0.095, times_even=1)):
        got = judging.choice_keep(options, ["q"], rule).collect()
        for q, (shares, none) in cases.items():
            cut = min(0.5, rule.times_even / (len(shares) + 1))
            cut = max(cut, rule.least)
            want = [max(shares) > none and (x >= cut or i == shares.index(max(shares))) for i, x in enumerate(shares)]
            assert [r.keep for r in sorted(got, key=lambda r: r.position) if r.q == q] == want, (q, rule)


def test_merge_answers(spark):
    ddl = "query_id string, path string, post int, level double, confidence double, sections array<struct<index:int,score:double>>, links array<struct<index:int,scent:double>>, questions int, input_tokens long, output_tokens long, latency_ms long, model string"
    rows = [("q", "p", 0, 1.0, 0.5, [(1, 0.2)], [], 2, 10, 1, 5, "m"), ("q", "p", 1, 2.0, 0.9, [(0, 0.1)], [(0, 0.7)], 3, 20, 1, 6, "m"), ("q", "p", 2, None, None, [], [], 1, 1, 1, 1, "m")]
    r = judging.merge_answers(spark.createDataFrame(rows, ddl), 3).first()
    assert (r.relevance, r.confidence, r.requests, r.input_tokens) == (pytest.approx(2 / 3), 0.9, 3, 31) and [s["index"] for s in r.sections] == [0, 1]


def test_chunks_tile_long_pages():
    text = "".join(f"# S{i}\n" + "x" * 90 + "\n" + (f"## T{i}\n" + "y" * 400 + "\n") for i in range(12))
    from wayfare.operators import markdown

    sections = [(a, z) for _, _, a, z in markdown.sections(markdown.scan(text), text)]
    out = request.chunks(text, sections, 600)
    assert out[0][0] == 1 and out[-1][1] == len(tx.split_lines(text)) and all(a[1] + 1 == b[0] for a, b in zip(out, out[1:]))
    sizes = [sum(len(x) + 1 for x in tx.split_lines(text)[a - 1 : z]) for a, z in out]
    assert max(sizes) <= 600 and request.chunks("a\nb", [], 600) == [(1, 2)]


def test_packing_stays_within_limits_and_keys_are_stable(spark):
    packer = request.Packer(judging.MODES["about"], "endpoint", "model")
    page = {"path": "p.md", "title": "P", "text": "l\n" * 500, "sections": [{"heading": "h" * 300, "level": 1, "first": i + 1, "last": i + 1} for i in range(500)], "links": [{"anchor": "a", "sentence": "s", "heading": None, "target": "t.md", "line": 3, "preview": None}]}
    posts = packer.pack("query", page)
    assert len(posts) > 1 and sorted(i for p in posts for i in p.sections) == list(range(500)) and [i for p in posts for i in p.links] == [0]
    assert all(request.json_len(p.body["state"]) <= request.STATE_BYTES and request.json_len(p.body) <= request.REQUEST_BYTES for p in posts)
    assert [request.PAGE in p.body["questions"] for p in posts] == [True] + [False] * (len(posts) - 1)
    assert packer.key(posts) == packer.key(packer.pack("query", page)) != packer.key(packer.pack("other", page))
    options = packer.pack_choices("q", {"path": "p"}, [(i, "text") for i in range(600)])
    assert [len(p.links) for p in options] == [254, 254, 92]
    assert judging.custom_mode("c", " x ").name == "c" and judging.WORDINGS["reader"](judging.MODES["about"]).reader
    with pytest.raises(ValueError):
        judging.custom_mode("c", "  ")


def test_bounded_previews(spark):
    ddl = "path string, title string, frontmatter array<struct<key:string,value:string>>, first_paragraph string, headings array<string>, leads array<string>"
    rows = [("p", "t" * 700, [("k", "v" * 1000), ("k2", "w" * 1000), ("k3", "x")], None, ["h" * 100] * 50, ["a", "a", "b"])]
    r = request.bounded_previews(spark.createDataFrame(rows, ddl)).first()
    assert r.title == tx.clamp("t" * 700, 600) and [f.key for f in r.frontmatter] == ["k"] and len(r.headings) == 40 and r.leads == ["a", "b"]


def test_store(spark, tmp_path):
    asked = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, n int")
    judged = spark.sparkContext.accumulator(0)

    def answer(missing):
        count = F.udf(lambda n: judged.add(1) or f"j{n}")  # a judge that counts what it is asked
        return missing.select("key", count("n").alias("judgment"), F.lit("d").alias("detail"), F.when(F.col("key") == "k4", "down").alias("error"))

    store = JudgmentStore(spark, str(tmp_path / "s"))
    first = store.judge(asked, answer)
    assert calls(first).first().asDict() == {"served": 2, "calls": 2} and first.count() == 2 and judged.value == 2
    more = asked.unionByName(spark.createDataFrame([("k3", 3), ("k3", 3), ("k4", 4)], "key string, n int"))
    again = store.judge(more, answer)
    assert {r.key: (r.judgment, r.bought) for r in again.collect()}["k1"] == ("j1", False) and again.count() == 5
    assert judged.value == 4
    assert {r.key for r in store.entries().collect()} == {"k1", "k2", "k3"}, "a failure is not kept"
    assert calls(JudgmentStore(spark, None).judge(asked, answer)).first().calls == 2
    assert location({"XDG_CACHE_HOME": "/x", "WAYFARE_STORE": " "}) == "/x/wayfare"
    with pytest.raises(LookupError):
        location({})
    folder = tmp_path / "entries"
    folder.mkdir()
    (folder / "aa.json").write_text(json.dumps({"format": 3, "judgment": {"relevance": 0.5, "sections": [{"heading": "h", "lines": [1, 2], "score": 0.1}], "links": []}, "detail": {"model": "m", "input_tokens": 5}}))
    (folder / "bb.json").write_text(json.dumps({"format": 2, "judgment": {"relevance": 0.5}}))
    (folder / "cc.json").write_text('{"format": 3, "judg')
    assert [(r.key, r.judgment.relevance) for r in read_entries(spark, str(folder)).collect()] == [("aa", 0.5)]


def test_ranges(spark):
    pages = spark.createDataFrame([("p", "ab\nc\n\nd"), ("q", "")], "path string, text string")
    assert [(r.path, r.line, r.chars) for r in ranking.page_lines(pages).orderBy("path", "line").collect()] == [("p", 1, 3), ("p", 2, 2), ("p", 3, 1), ("p", 4, 1)]
    ranges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 2, 2)], "path string, first int, last int")
    assert ranking.coverage(pages, ranges).collect()[0].asDict() == {"path": "p", "chars": 6, "lines": 3}


def test_keyword_topk(spark):
    pages = spark.createDataFrame([("b/x", "Foo_bar notes, note! NOTE"), ("b-c", "note"), ("z", "nothing")], "path string, text string")
    q = spark.createDataFrame([("q", "Note of notes")], "query_id string, query string")
    assert [(r.path, r.terms_matched, r.occurrences) for r in ranking.keyword_topk(pages, q, 5).orderBy("rank").collect()] == [("b/x", 2, 3), ("b-c", 1, 1)]


def test_labels(spark):
    wanted = spark.createDataFrame([("q", "p", None, None, None), ("q", "p", "A", None, None), ("q", "p", "D", None, None), ("q", "p", "N", None, None), ("q", "p", None, 2, 99), ("q", "x", None, None, None)], "query_id string, page string, heading string, first int, last int")
    sections = spark.createDataFrame([("p", "A", 3, 4), ("p", "D", 5, 5), ("p", "D", 6, 6)], "page string, heading string, first int, last int")
    pages = spark.createDataFrame([("p", 9)], "page string, lines int")
    got = [(r.first, r.last, r.error) for r in metrics.label_parts(wanted, sections, pages).collect()]
    assert {g for g in got if g[2] is None} == {(1, 9, None), (3, 4, None)} and len([g for g in got if g[2]]) == 4


def test_graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("a", "a")]
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = graph.edges(spark.createDataFrame(pairs, "source string, target string"))
    assert edges.count() == 7
    assert {r.node: r.depth for r in graph.bfs_depth(edges, nodes.where("node = 'a'")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert {r.depth: r.nodes for r in graph.depth_histogram(graph.bfs_depth(edges, nodes.where("node = 'a'")), nodes).collect()}[None] == 2
    sccs = {}
    for r in graph.strong_components(edges).collect():
        sccs.setdefault(r.scc, set()).add(r.node)
    assert sorted(map(sorted, sccs.values())) == [["a", "b", "c"], ["d", "e"]]
    assert graph.largest_scc(edges, nodes).first()[0] == 3
    assert {r.node for r in graph.orphans(edges, nodes).collect()} == {"f", "g"}


def test_depth_has_no_limit(spark, monkeypatch):
    frame = MagicMock()  # its operations give itself, and 1,500 frontiers have rows
    for name in ("select", "distinct", "withColumn", "join", "unionByName"):
        getattr(frame, name).return_value = frame
    frontiers = iter(range(1_500))
    frame.isEmpty.side_effect = lambda: next(frontiers, None) is None
    monkeypatch.setattr(graph, "Scratch", lambda *_: MagicMock(table=lambda df, label: df))
    graph.bfs_depth(frame, frame)
    assert next(frontiers, None) is None


def test_components_of_rings_and_chains(spark):
    """A ring of 12 with a chord and a tail, and a pair that leads to it."""
    pairs = [(i, (i + 1) % 12) for i in range(12)] + [(12, 13), (5, 12), (50, 51), (51, 50), (51, 3)]
    name = lambda i: f"n{i:02d}"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "source string, target string")
    sizes = sorted(r["count"] for r in graph.strong_components(edges).groupBy("scc").count().collect())
    assert sizes == [2, 12]
    depth = {r.node: r.depth for r in graph.bfs_depth(edges, spark.createDataFrame([(name(0),)], "node string")).collect()}
    assert depth[name(11)] == 11 and depth[name(13)] == 7 and len(depth) == 14


def test_graph_statistics(corpus):
    got = graph.statistics(parse.parse_pages(corpus), corpus)
    assert got["pages"] == 7 and got["links"] == {"total": 8, "markdown": 5, "wikilink": 3, "resolved": 6, "broken": 1, "outside": 1}
    assert got["edges"] == 6 and got["depth"] == {"entry": ["index.md"], "histogram": {"0": 1, "1": 2, "2": 3}, "unreachable": 1}
    assert got["orphans"] == 2 and got["largest_scc"] == 1 and got["out_degree"]["histogram"] == {"0": 3, "1": 2, "2": 2}
    assert "| depth, unreachable | 1 |" in render.graph_table(got)


def test_link_counts(corpus):
    r = graph.link_counts(parse.parse_pages(corpus), corpus).first()
    assert (r.pages, r.links, r.markdown, r.wikilink, r.resolved, r.broken, r.outside) == (7, 8, 5, 3, 6, 1, 1)


def test_experiments(spark):
    rows = spark.createDataFrame([("q1", "c", "x", 1, "w", True, {"m": 1.0}, None), ("q1", "c", "x", 2, "w", True, {"m": 3.0}, None), ("q2", "c", "x", 1, "w", False, {"m": 9.0}, None), ("q1", "c", "agent-a", 1, "w", True, {"m": 2.0}, "M")], "query_id string, category string, condition string, repeat int, wiki string, ok boolean, metrics map<string,double>, model_asked_for string")
    stats = {(r.level, r.condition, r.query_id): (r.mean, r.sd, r.n) for r in experiment.grouped_stats(rows).collect()}
    assert stats["overall", "x", None] == (2.0, pytest.approx(2**0.5), 2) and stats["query", "agent-a@M", "q1"] == (2.0, None, 1)
    ledger = spark.createDataFrame([("w", "q2", "x", 2, None, "o", True, 0.1), ("w", "q3", "x", 1, None, "o", None, None), ("v", "q4", "x", 1, None, "o", True, 0.5)], "wiki string, query string, condition string, repeat int, model string, out string, ok boolean, cost_usd double")
    key = lambda df: {(r.query_id, r.condition, r.repeat) for r in df.collect()}
    assert key(experiment.done_set(rows, ledger, "w", "M")) == {("q1", "x", 1), ("q1", "x", 2), ("q2", "x", 1), ("q1", "agent-a", 1), ("q2", "x", 2)}
    assert ("q2", "x", 1) not in key(experiment.done_set(rows, ledger, "w", "M", retry_failed=True))
    labels = spark.createDataFrame([("fine label",), ("a/b",), ("x" * 65,), ("one two three four five",)], "l string")
    assert [r[0] for r in labels.select(experiment.label_problem(F.col("l"))).collect()] == [None, "looks like a path", "longer than 64 characters", "more than 4 words"]
    conditions = spark.createDataFrame([("list-t0.4",), ("x-t2",), ("x",)], "c string")
    assert [r[0] for r in conditions.select(experiment.condition_threshold(F.col("c"))).collect()] == [0.4, None, None]
    assert render.cell(0.001234, None, 1) == "0.001234 (n=1)" and render.cell(1.5, 0.25, 2) == "1.50 ± 0.25 (n=2)"


def test_gold_sets(spark, tmp_path):
    good = {"queries": [{"id": "a", "query": "q?", "mode": "about", "entry": "i.md", "expected": ["p.md", {"path": "r.md", "heading": "H"}, {"path": "s.md", "lines": [2, 5]}]}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(good))
    queries, wanted = records.read_gold(spark, str(path))
    assert queries.first().query_id == "a" and sorted((r.page, r.heading, r.first, r.last) for r in wanted.collect())[1:] == [("r.md", "H", None, None), ("s.md", None, 2, 5)]
    for change in ({"query": " "}, {"mode": "x"}, {"expected": []}, {"entry": None}):
        path.write_text(json.dumps({"queries": [{**good["queries"][0], **change}]}))
        with pytest.raises(records.BadRecord):
            records.read_gold(spark, str(path))
    path.write_text(json.dumps({"queries": [{"id": "a", "query": "q", "entry": ["x.md", "y.md"], "wanted": ["p.md"]}, {"id": "b", "query": "r", "entry": "z.md", "expected": ["p.md"], "category": "c"}]}))
    queries, entries, wanted = records.read_gold_lenient(spark, str(path))
    assert (queries.count(), entries.count(), wanted.count()) == (2, 3, 2)
    assert records.read_gold_lenient(spark, str(path), ["b"])[1].first().path == "z.md"
    with pytest.raises(records.BadRecord):
        records.read_gold_lenient(spark, str(path), ["nope"])


EVENTS = [
    {"event": "started", "t_ms": 0, "query": "q"}, {"event": "popped", "t_ms": 1, "path": "a", "depth": 0, "via": []}, {"event": "requested", "t_ms": 2, "path": "a"},
    {"event": "answered", "t_ms": 3, "path": "a", "cached": False}, {"event": "admitted", "t_ms": 4, "source": "a", "target": "b", "scent": 0.9},
    {"event": "pruned", "t_ms": 5, "source": "a", "target": "c", "reason": "beam"}, {"event": "pruned", "t_ms": 6, "source": "a", "target": "d", "reason": "ignored"},
    {"event": "result", "t_ms": 7, "path": "a", "earned_a_place": True}, {"event": "popped", "t_ms": 8, "path": "b", "depth": 1, "via": ["a"]}, {"event": "unheard-of", "t_ms": 9},
]


def test_numbered_lines_over_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    lines = [f"line {i} " + "x" * (i % 97) if i % 5 else "" for i in range(4000)]
    path.write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")
    try:
        rows = records.numbered_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        assert sorted((r.line, r.value) for r in rows.collect()) == [(i + 1, x) for i, x in enumerate(lines) if x]
    finally:
        spark.conf.set(key, before)


def test_trace_file_and_buying(spark, tmp_path):
    heard = []
    live = records.TraceFile(str(tmp_path / "t.jsonl"), heard.append)
    for e in EVENTS[:4]:
        live(e)
    assert [json.loads(x)["event"] for x in (tmp_path / "t.jsonl").read_text().splitlines()] == [e["event"] for e in EVENTS[:4]]
    broken = records.TraceFile(str(tmp_path / "no" / "t.jsonl"), heard.append)
    broken(EVENTS[0])
    broken(EVENTS[1])
    assert len(heard) == 1
    ledger, rows = str(tmp_path / "ledger"), str(tmp_path / "rows")
    job = {"wiki": "w", "query": "q", "condition": "c", "repeat": 1, "model": None, "out": "o"}
    seen = []

    def measure(j):
        seen.append(records.read_ledger(spark, ledger).collect()[0].ok)  # under way
        return {"query_id": "q", "ok": True, "cost_usd": 0.25, "metrics": {}}

    records.buy(job, measure, ledger, rows)
    assert seen == [None] and [(r.ok, r.cost_usd) for r in records.read_ledger(spark, ledger).collect()] == [(True, 0.25)]
    assert records.read_runs(spark, rows).first().ok is True
    with pytest.raises(ZeroDivisionError):
        records.buy({**job, "repeat": 2}, lambda j: 1 / 0, ledger, rows)
    assert {r.repeat: r.ok for r in records.read_ledger(spark, ledger).collect()} == {1: True, 2: False} and len(open(rows).readlines()) == 1


def test_traces(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("\n\n".join(json.dumps(e) for e in EVENTS) + '\n{"event": "pop')
    events = records.read_trace(spark, str(path))
    s = trace_summary(events).first()
    assert (s.files, s.pops, s.requests, s.answered, s.bought, s.cached, s.followed, s.passed_over, s.dropped, s.earned, s.duration_ms) == (1, 2, 1, 1, 1, 0, 1, 1, 1, 1, 8)
    assert [(r.path, r.source, r.target, r.scent) for r in best_paths(events).collect()] == [("b", "a", "b", 0.9)]
    assert "<script" not in render.safe_json({"x": "</script><script>"})
    page = render.replay_page(EVENTS, s.asDict())
    assert page.count("<script") == 2 and "\\u003c" not in page
    path.write_text('{"event": "popped"}\nnot json\n{"event": "popped"}\n')
    with pytest.raises(records.BadRecord):
        records.read_trace(spark, str(path))
    path.write_text("\n")
    with pytest.raises(records.BadRecord):
        records.read_trace(spark, str(path))


def test_streamed_trace(spark, tmp_path):
    from wayfare import schema

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({**e, "query": "q"}) for e in EVENTS))
    counts = streaming_counts(stream_trace(spark, str(source), schema.TRACE), ["query"])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("wayfare_trace").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("wayfare_trace").first()
    assert (r.pops, r.followed, r.dropped, r.passed_over, r.earned) == (2, 1, 1, 1, 1)


def test_streamed_runs_are_forgotten(spark, tmp_path):
    """With a start time and a watermark, old runs are given out once and leave the state; late events of theirs change nothing."""
    from wayfare import schema

    source = tmp_path / "in"
    source.mkdir()
    ddl = schema.TRACE + ", started_at timestamp"
    counts = streaming_counts(stream_trace(spark, str(source), ddl), ["query"], "started_at", "10 minutes")
    q = counts.writeStream.outputMode("append").format("memory").queryName("wayfare_runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i, (run, hour) in enumerate((("a", 1), ("b", 2), ("a", 1), ("c", 3))):
        (source / f"{i}.json").write_text("\n".join(json.dumps({**e, "query": run, "started_at": f"2024-01-01T0{hour}:00:00Z"}) for e in EVENTS))
        q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert sorted((r.query, r.pops) for r in spark.table("wayfare_runs").collect()) == [("a", 2), ("b", 2)] and left == 1


def test_ledger_and_logs(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    line = {"wiki": "w", "query": "q", "condition": "c", "repeat": 1, "out": "o"}
    path.write_text("\n".join(json.dumps(x) for x in (line, {**line, "ok": True, "cost_usd": 0.2}, {**line, "repeat": 2})))
    got = {r.repeat: r.ok for r in records.read_ledger(spark, str(path)).collect()}
    assert got == {1: True, 2: None} and records.read_ledger(spark, str(tmp_path / "none")).count() == 0
    path.write_text(json.dumps(line) + "\noops\n")
    with pytest.raises(records.BadRecord, match=":2:"):
        records.read_ledger(spark, str(path))
    use = lambda i, out, tool=None, file=None: {"type": "assistant", "session_id": "S", "message": {"id": i, "model": "m", "usage": {"input_tokens": 2, "output_tokens": out}, "content": [{"type": "tool_use", "name": tool, "input": {"file_path": file}}] if tool else []}}
    path.write_text("\n".join([json.dumps(use("a", 3)), json.dumps(use("a", 9, "Read", "/w/x.md")), "junk", json.dumps(use("b", 1, "Glob"))]))
    t = records.agent_transcript(spark, str(path), "/w").first()
    assert (t.model, t.turns, t.output_tokens, t.tool_uses, t.files_read) == ("m", 2, 10, 2, ["x.md"])
    denied = {"type": "user", "message": {"content": [{"type": "tool_result", "is_error": True}]}}
    result = {"type": "result", "is_error": False, "total_cost_usd": 0.5, "usage": {"input_tokens": 4, "output_tokens": 6}, "result": 'text\n["/w/a.md", "./b.md"]'}
    path.write_text("\n".join(json.dumps(x) for x in (use("a", 3, "Read", "/w/x.md"), {**use("s", 1, "Read", "/w/y.md"), "parent_tool_use_id": "t"}, denied, {"type": "system", "subtype": "task_started"}, result)))
    r = records.agent_stream(spark, str(path), "/w").first()
    assert (r.session_id, r.cost_usd, r.input_tokens, r.tool_uses, r.files_read, r.denials, r.subagents, r.tools) == ("S", 0.5, 4, 1, ["x.md"], 1, 1, {"Read": 1})
    assert records.relied_on(r.answer, "/w") == ["a.md", "b.md"] and records.relied_on("none [1, 2]", "/w") is None


def test_stored_lists(spark):
    body = {"results": [{"path": "p", "sections": [{"lines": [1, 3]}, {"lines": [2, 5]}]}, {"path": "p", "sections": [{"lines": [9, 9]}]}]}
    rows = spark.createDataFrame([("l", json.dumps(body))], "list_id string, json string")
    assert [(r.page, r.first, r.last) for r in records.list_ranges(rows).collect()] == [("p", 1, 3), ("p", 2, 5)]


def test_command_line(root, capsys, spark, tmp_path, monkeypatch):
    from wayfare import cli

    monkeypatch.setenv("WAYFARE_STORE", str(tmp_path / "store"))
    run = ["run", "frost dates", f"{root}/index.md", "--root", root, "--threshold", "0.4", "--trace", str(tmp_path / "t.jsonl")]
    assert cli.main([*run, "--format", "md"]) in (0, 1)
    first = capsys.readouterr().out
    assert first.startswith("# Reading list: frost dates")
    s = trace_summary(records.read_trace(spark, str(tmp_path / "t.jsonl"))).first()
    assert s.answered == s.bought == s.files > 1 and s.cached == 0
    assert cli.main([*run, "--format", "md"]) in (0, 1)
    assert "0 calls" in capsys.readouterr().out
    s = trace_summary(records.read_trace(spark, str(tmp_path / "t.jsonl"))).first()
    assert s.answered == s.cached == s.requests > 1, "every answer was kept"
    assert cli.main([*run, "--no-cache", "--format", "md"]) in (0, 1)
    assert capsys.readouterr().out == first
    assert cli.main(["run", "q", "x", "--threshold", "3"]) == 2
    assert cli.main(["graph", root, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out.split("\n", 0)[0])["pages"] == 7
    assert cli.main(["score-file", "frost dates", f"{root}/beds/frost.md", "--root", root, "--no-cache"]) == 0
    assert capsys.readouterr().out.startswith("relevance 1.00")


def test_views(spark, corpus):
    from wayfare.sources import views

    views.register_folder(spark, "/root/testdata/sf0.001", ("nation", "region"))
    views.register({"parsed_pages": parse.parse_pages(corpus)})
    assert spark.sql("select count(*) from nation join region on n_regionkey = r_regionkey").first()[0] == 25
    assert spark.sql("select count(*) from parsed_pages where title = 'Garden'").first()[0] == 1
