import random

import pytest

from wayfare.operators import walk as w
from wayfare.operators.readlist import reading_list
from wayfare.plans import render

# The judged pages of the published example walk (page: relevance, scents of its links), whose order and paths the walk must give.
JUDGED = {
    "index.md": (0.62, {"payments/README.md": 0.86, "payments/cutoffs.md": 0.41, "payments/settlement.md": 0.33, "notes/ledger.md": 0.28, "../outside.md": 0.74, "payments/missing.md": 0.19}),
    "payments/README.md": (0.81, {"payments/settlement.md": 0.94, "notes/ledger.md": 0.72, "payments/cutoffs.md": 0.40}),
    "payments/settlement.md": (0.94, {"payments/cutoffs.md": 0.86}),
    "payments/cutoffs.md": (0.71, {"payments/settlement.md": 0.68}),
    "notes/ledger.md": (0.55, {"payments/settlement.md": 0.44, "notes/weekly review.md": 0.83, "notes/reading.txt": 0.77, "notes/reading.md": 0.71}),
    "notes/weekly review.md": (0.52, {}),
    "notes/reading.md": (0.48, {}),
    "notes/reading.txt": (0.30, {"notes/ledger.md": 0.35}),
}


def pages(graph):
    def judge(paths):
        return {p: w.Page(graph[p][0], [], [w.Link(t, s, True, not t.startswith("..")) for t, s in graph[p][1].items()]) for p in paths if p in graph}

    return judge


def run(graph, entries=("a",), **config):
    return w.walk(list(entries), pages(graph), w.WalkConfig(**{"max_files": None, "max_depth": None, "threshold": 0.0, **config}))


def test_golden_walk():
    state = w.walk(["index.md"], pages(JUDGED), w.WalkConfig(12, 6, 4, 0.6))
    assert [v.path for v in state.visits] == [
        "payments/settlement.md", "payments/README.md", "payments/cutoffs.md", "index.md", "notes/ledger.md", "notes/weekly review.md", "notes/reading.md", "notes/reading.txt",
    ]
    assert state.calls == 8
    by = {v.path: v for v in state.visits}
    assert by["payments/cutoffs.md"].via == ("index.md", "payments/README.md", "payments/settlement.md")
    assert [x.reason for x in by["payments/cutoffs.md"].links] == [w.ALREADY_REACHED]
    assert {x.target: x.reason for x in by["index.md"].links}["../outside.md"] == w.OUT_OF_ROOT
    found = reading_list(state, "q", "useful-for", "table", 0.6, "wiki")
    assert found.exit_code == 0 and found.results[0]["path"] == "wiki/payments/settlement.md"
    text = render.to_markdown(found)
    assert text.startswith("# Reading list: q\n\nCriterion: useful-for; 8 files visited, 8 calls\n\n## 1. `wiki/payments/settlement.md`\n\nrelevance 0.94; scent 0.94; via `wiki/index.md` -> `wiki/payments/README.md`\n\n- nothing above --threshold\n")
    assert "    wiki/payments/settlement.md  followed; scent 0.94; relevance 0.94" in render.to_tree(found)


def test_best_path_wins_and_ties_go_to_the_first():
    g = {"a": (1, {"b": 0.9, "c": 0.5}), "b": (1, {"c": 0.9}), "c": (1, {})}
    assert {v.path: (v.path_score, v.via) for v in run(g).visits}["c"] == (0.9 * 0.9, ("a", "b"))
    g = {"a": (1, {"b": 0.5, "c": 0.5}), "b": (1, {"d": 0.5}), "c": (1, {"d": 0.5}), "d": (1, {})}
    assert {v.path: v.via for v in run(g).visits}["d"] == ("a", "b")


def test_every_reason():
    g = {"a": (1, {"b": 0.9, "../x": 0.9, "c": 0.2, "n": None, "b2": 0.8}), "b": (1, {"a": 0.9, "d": 0.9, "b2": 0.5}), "b2": (1, {"e": 0.9}), "d": (1, {})}
    state = run(g, threshold=0.3, max_depth=1)
    reasons = {(v.path, x.target): x.reason for v in state.visits for x in v.links}
    assert reasons["a", "../x"] == w.OUT_OF_ROOT and reasons["a", "c"] == w.BELOW_THRESHOLD and reasons["a", "n"] == w.UNJUDGED and reasons["b", "d"] == w.PAST_DEPTH
    state = run(g, threshold=0.3, max_files=1, fanout=1)
    assert [(e["target"], e["reason"]) for e in state.events if e["event"] == "pruned" and e["reason"] == w.MAX_FILES] == [("b2", w.MAX_FILES), ("d", w.MAX_FILES)]
    reasons = {(v.path, x.target): x.reason for v in state.visits for x in v.links}
    assert reasons["b", "a"] == w.ALREADY_REACHED and reasons["b", "b2"] == w.ALREADY_QUEUED


@pytest.mark.parametrize("scent", [1.5, -0.1, float("nan")])
def test_scents_that_are_no_probability_are_never_followed(scent):
    assert not w.admits(scent, True, 0.0) and not w.admits(scent, True, None)


def test_entries_are_free_and_failures_cost_no_budget():
    g = {"a": (1, {"x": 0.9, "b": 0.8, "c": 0.7}), "b": (1, {}), "c": (1, {})}
    state = run(g, ("a", "b2", "a"), max_files=1)
    assert {v.path for v in state.visits} == {"a", "b"} and [f[0] for f in state.failed] == ["b2", "x"]


def test_beam_drops_for_good():
    g = {"a": (1, {f"b{i}": 0.9 - i / 100 for i in range(5)}), **{f"b{i}": (1, {"z": 0.5}) for i in range(5)}, "z": (1, {})}
    state = run(g, beam=2, fanout=1)
    assert {v.path for v in state.visits} == {"a", "b0", "b1", "z"}


def _random(rng, n):
    return {str(i): (rng.random(), {str(rng.randrange(n)): rng.random() for _ in range(rng.randrange(4))}) for i in range(n)}


def test_fanout_changes_nothing_without_a_beam():
    rng = random.Random(4)
    for _ in range(300):
        g = _random(rng, rng.randrange(2, 14))
        cfg = {"max_files": rng.choice([None, 3, 6]), "max_depth": rng.choice([None, 2, 3]), "threshold": 0.3}
        one, many = run(g, ("0",), fanout=1, **cfg), run(g, ("0",), fanout=rng.choice([2, 4, 8]), **cfg)
        view = lambda s: [(v.path, v.path_score, v.via, [(x.target, x.reason) for x in v.links]) for v in s.visits]
        assert view(one) == view(many)


def test_grouped_rounds_and_closure_agree(spark):
    rng = random.Random(9)
    graphs = {f"q{i}": _random(rng, 10) for i in range(6)}
    rows = [(q, p, rel, [], [(t, s, True, True) for t, s in links.items()]) for q, g in graphs.items() for p, (rel, links) in g.items()]
    ddl = "query_id string, path string, relevance double, sections array<struct<heading:string,first:int,last:int,score:double>>, links array<struct<target:string,scent:double,keep:boolean,in_root:boolean>>"
    judged = spark.createDataFrame(rows, ddl)
    entries = spark.createDataFrame([(q, "0") for q in graphs], "query_id string, path string")
    config = w.WalkConfig(None, None, 8, 0.3)
    want = {(q, v.path): v.path_score for q, g in graphs.items() for v in w.walk(["0"], pages(g), config).visits}
    grouped = {(r.query_id, r.path): r.path_score for r in w.grouped_walk(judged, entries, config).collect()}
    rounds = w.round_walk(spark, {q: ["0"] for q in graphs}, lambda asked: judged.join(asked, ["query_id", "path"], "left_semi"), config)
    assert grouped == want and {(q, v.path): v.path_score for q, s in rounds.items() for v in s.visits} == want
    edges = judged.selectExpr("query_id", "path as source", "explode(links) as l").selectExpr("query_id", "source", "l.target", "l.scent").where("scent >= 0.3")
    closed = {(r.query_id, r.path): r.path_score for r in w.closure(edges, entries).collect()}
    assert closed == pytest.approx(want)


def test_closure_runs_until_nothing_improves(spark):
    n = 34
    links = [(str(i), str(i + 1), 1.0) for i in range(n)] + [("0", str(n), 0.5), (str(n), "0", 1.0), ("0", "x", 1.5), ("x", "0", 1.5)]
    edges = spark.createDataFrame(links, "source string, target string, scent double")
    entries = spark.createDataFrame([("q", "0")], "query_id string, path string")
    assert {r.path: r.path_score for r in w.closure(edges, entries).collect()} == {str(i): 1.0 for i in range(n + 1)}


@pytest.mark.parametrize("config", [w.WalkConfig(3, 3, 2, 0.3), w.WalkConfig(None, 3, 1, 0.3, beam=2), w.WalkConfig(6, None, 4, None), w.WalkConfig(2, 0, 8, 0.3), w.WalkConfig(40, 9, 3, 0.2, beam=5)])
def test_grouped_walks_equal_walks_one_by_one(spark, config):
    """Entries that link to entries, repeated links, odd scents, pages without a judgment, far more routes than a try is given."""
    rng = random.Random(config.fanout)
    name = lambda i: f"{'/' * (i % 7 == 0)}d{i % 3}/{i}"
    scent = lambda: rng.choice([None, float("nan"), 1.5, 1.0, 0.5, 0.5, rng.random(), rng.random(), rng.random()])
    judged, starts = {}, {}
    for q in range(5):
        n = 90 if q < 3 else 12
        links = lambda: [(name(rng.randrange(n)), scent(), rng.choice([True, True, None, False]), rng.random() < 0.9) for _ in range(rng.randrange(9))]  # noqa: B023, E731
        judged[f"q{q}"] = {name(i): (rng.random(), [("h", 1, 2, rng.random())] * rng.randrange(3), links()) for i in range(n) if rng.random() < (0.15 if q == 2 and i > 40 else 0.9)}
        starts[f"q{q}"] = [name(i) for i in rng.sample(range(n), 30 if q < 3 else 2)]
    ddl = "query_id string, path string, relevance double, sections array<struct<heading:string,first:int,last:int,score:double>>, links array<struct<target:string,scent:double,keep:boolean,in_root:boolean>>"
    rows = spark.createDataFrame([(q, p, *x) for q, found in judged.items() for p, x in found.items()], ddl)
    entries = spark.createDataFrame([(q, p) for q, found in starts.items() for p in [*found, found[0], None]], "query_id string, path string")
    want = {}
    for q, found in judged.items():
        one = {p: w._page({"relevance": r, "sections": [dict(zip(("heading", "first", "last", "score"), s, strict=True)) for s in ss], "links": [dict(zip(("target", "scent", "keep", "in_root"), x, strict=True)) for x in ll]}) for p, (r, ss, ll) in found.items()}
        out = w.walk(sorted(starts[q]), lambda paths: {p: one[p] for p in paths if p in one}, config)  # noqa: B023
        for v in out.visits:
            want[q, v.path] = (v.relevance, v.scent, v.path_score, v.depth, v.via, tuple(s["score"] for s in v.sections), tuple(tuple(vars(x).values()) for x in v.links), out.calls)
    got = w.grouped_walk(rows, entries, config).collect()
    assert len(got) == len(want)
    assert {(r.query_id, r.path): (r.relevance, r.scent, r.path_score, r.depth, tuple(r.via), tuple(s.score for s in r.sections), tuple(map(tuple, r.links)), r.calls) for r in got} == want
