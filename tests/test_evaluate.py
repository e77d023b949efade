import json

import pytest

from wayfare.operators.judging import MEASURED_WORDINGS, MODES, choice_judge, keyword_judge, table_judge
from wayfare.operators.parse import parse_pages
from wayfare.operators.walk import WalkConfig
from wayfare.plans import evaluate as ev
from wayfare.streaming.trace import trace_summary


def test_evaluation_and_report(spark):
    text = {
        "i.md": "# Index\n\n[red apples](a.md) and [blue sky](b.md)\n",
        "a.md": "# Red apples\n\nred apples here\n\n## More\n\n[red pears](c.md)\n",
        "b.md": "# Blue sky\n",
        "c.md": "# Red pears\n\nred\n",
    }
    pages = spark.createDataFrame(list(text.items()), "path string, text string").cache()
    queries = spark.createDataFrame([("r", "red apples"), ("b", "blue sky")], "query_id string, query string")
    wanted = spark.createDataFrame([("r", "a.md", 1, 3), ("r", "c.md", 1, 3), ("b", "b.md", 1, 1)], "query_id string, page string, first int, last int")
    judge = keyword_judge(parse_pages(pages), pages, queries)
    found = ev.evaluate(spark, pages, queries, {"r": ["i.md"], "b": ["i.md"]}, wanted, judge, ev.grid((5, 1, 5), (0.5,)), WalkConfig(threshold=0.5))
    means = {r.budget: r for r in found.means.collect()}
    assert means[5].mean_recall == 1.0 and means[1].mean_recall == 0.25 and means[5].runs == 2
    assert found.unreached.count() == 0
    assert {r.budget: r.read_tokens for r in found.read.collect()}[5] > 0
    text = ev.report(found)
    assert text.startswith("# Evaluation") and "## Keyword baseline" in text and "## Cost" in text
    assert {r.budget: (r.served, r.bought) for r in found.spent.collect()} == {1: (4, 4), 5: (7, 7)}
    scents = spark.createDataFrame([("previews", "a", 0.5), ("no-previews", "a", 0.2)], "policy string, target string, scent double")
    assert ev.scents_by_policy(scents).first().asDict() == {"target": "a", "no-frontmatter": None, "no-previews": 0.2, "previews": 0.5}


def test_a_walks_trace_sums_up(spark):
    from tests.test_walk import JUDGED, pages
    from wayfare import schema
    from wayfare.operators import walk as w

    state = w.walk(["index.md"], pages(JUDGED), w.WalkConfig(12, 6, 4, 0.6))
    events = state.trace("q", "about", 0.6)
    s = trace_summary(spark.createDataFrame([{**e, "sections": [], "links": []} for e in events], schema.TRACE)).first()
    assert (s.files, s.answered, s.requests, s.earned) == (8, 8, 8, 4)
    assert s.pops >= 8  # a path held back is popped again


def test_ablations_are_walked(spark):
    text = {
        "i.md": "# Index\n\n[one](a.md) and [two](b.md) and [three](c.md)\n",
        "a.md": "---\ntopic: red apples\n---\n# One\n\nfruit\n",
        "b.md": "# Two\n\nfruit\n\n## Red apples\n",
        "c.md": "# Three\n\nfruit\n\n[red apples](a.md)\n",
    }
    pages = spark.createDataFrame(list(text.items()), "path string, text string").cache()
    queries = spark.createDataFrame([("r", "red apples")], "query_id string, query string")
    wanted = spark.createDataFrame([("r", p, 1, 3) for p in ("a.md", "b.md", "c.md")], "query_id string, page string, first int, last int")
    judge_for = ev.lexical_policies(pages, queries)
    scents = {r.target: r.asDict() for r in ev.entry_scents(spark.createDataFrame([("r", "i.md")], "query_id string, path string"), judge_for).collect()}
    assert scents["a.md"] == {"target": "a.md", "no-frontmatter": 0.0, "no-previews": 0.0, "previews": 1.0}
    entries, setting = {"r": ["i.md"]}, ev.Setting(5, 0.5)
    found = ev.ablations(spark, pages, queries, entries, wanted, judge_for, setting, WalkConfig(threshold=0.5))
    seen = {(r.experiment, r.policy): round(r.mean_recall, 2) for r in found.collect()}
    assert seen["contexts", "full"] == 1.0 and seen["contexts", "no-headings"] == 0.67 and seen["contexts", "bare"] == 0.33
    assert seen["previews", "no-previews"] == 0.0 and seen["relative", "choice"] == 0.0 and seen["relative", "choice, previews"] > 0 and len(seen) == 12
    asked = []
    judge = lambda p: asked.append(p.mode(ev.WORDINGS["path"](MODES["about"])).link_question if p.wording is None else p.wording) or judge_for(ev.Policy())
    ev.ablations(spark, pages, queries, entries, wanted, judge, setting, WalkConfig(threshold=0.5), ("wordings",))
    assert asked[1:] == list(MEASURED_WORDINGS)
    with pytest.raises(ValueError):
        judge_for(ev.Policy(wording="path"))


def test_choice_judges_links_against_each_other(spark):
    links = [("a", 0.6, True, True), ("b", 0.3, True, True), ("c", None, True, True), ("d", 0.01, True, True)]
    ddl = "query_id string, path string, relevance double, sections array<struct<heading:string,first:int,last:int,score:double>>, links array<struct<target:string,scent:double,keep:boolean,in_root:boolean>>"
    rows = spark.createDataFrame([("q", "p", 1.0, [], links), ("q", "none", 1.0, [], [("a", 0.4, True, True)]), ("q", "end", 1.0, [], [])], ddl)
    got = {r.path: [(x.target, x.scent, x.keep) for x in r.links] for r in choice_judge(table_judge(rows))(rows.select("query_id", "path")).collect()}
    total = 0.6 + 0.3 + 0.01 + 0.4
    assert got["p"] == [("a", pytest.approx(0.6 / total), True), ("b", pytest.approx(0.3 / total), False), ("c", None, False), ("d", pytest.approx(0.01 / total), False)]
    assert got["none"] == [("a", 0.4, False)] and got["end"] == []


def test_the_command_line_uses_its_options(tmp_path, capsys, spark):
    from wayfare import cli

    (tmp_path / "i.md").write_text("# I\n\n[red apples](a.md)\n\n[red](b.md)\n")
    for name in "ab":
        (tmp_path / f"{name}.md").write_text("# Fruit\n\nred apples\n")
    found = {}
    for scorer in ("noul", "choice"):
        assert cli.main(["run", "red apples", f"{tmp_path}/i.md", "--root", str(tmp_path), "--scorer", scorer, "--threshold", "0", "--no-cache"]) == 0
        found[scorer] = {x["path"].rsplit("/", 1)[-1] for x in json.loads(capsys.readouterr().out)["results"]}
    assert found == {"noul": {"a.md", "b.md", "i.md"}, "choice": {"a.md", "i.md"}}
