"""Judging by questions: what is asked, what is made of the replies, retries, and ablations that ask."""

import json

import pytest

from wayfare.operators import asking as a
from wayfare.operators.judging import MODES, WORDINGS, ShareRule, custom_mode
from wayfare.operators.parse import parse_pages
from wayfare.operators.request import LinkContext, Packer
from wayfare.operators.walk import WalkConfig
from wayfare.plans import evaluate as ev
from wayfare.plans.run import Options, run_query
from wayfare.sources.ignore import IgnoreRules

TEXT = {
    "i.md": "# Index\n\nOn fruit. See [one](a.md) and [two](b.md).\n\n## More\n\n[three](c.md) and [out](../x.md)\n",
    "a.md": "---\ntopic: red apples\n---\n# One\n\nfruit\n\n[four](d.md)\n",
    "b.md": "# Two\n\nfruit\n\n## Red apples\n",
    "c.md": "# Three\n\nfruit\n\n[red apples](a.md)\n",
    "d.md": "# Four\n\nred apples\n",
}


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame(list(TEXT.items()), "path string, text string").cache()
    return pages, parse_pages(pages).cache(), spark.createDataFrame([("q", "red apples")], "query_id string, query string")


def posts(spark, corpus, asking, path="i.md"):
    pages, parsed, queries = corpus
    row = a.requests(spark.createDataFrame([("q", path)], "query_id string, path string"), parsed, pages, queries, asking).first()
    return row.key, [json.loads(p.body) for p in row.posts]


def test_every_setting_changes_the_posts(spark, corpus):
    mode = MODES["useful-for"]
    settings = {
        "plain": a.Asking(),
        "mode": a.Asking(MODES["about"]),
        "criterion": a.Asking(custom_mode("custom", "grows on trees")),
        "wording": a.Asking(WORDINGS["section-legacy"](mode)),
        "no previews": a.Asking(context=LinkContext(previews=False)),
        "no headings": a.Asking(context=LinkContext(headings=False)),
        "no leads": a.Asking(context=LinkContext(leads=False)),
        "one hop": a.Asking(context=LinkContext(two_hop=False)),
        "choice": a.Asking(context=LinkContext(previews=False), keep=ShareRule()),
        "choice, floor": a.Asking(context=LinkContext(previews=False), keep=ShareRule(least=0.1)),
    }
    keys = {name: posts(spark, corpus, s)[0] for name, s in settings.items()}
    assert len(set(keys.values())) == len(keys)
    page = {"path": "p.md", "title": "P", "text": "# P\n", "sections": [{"heading": "P", "level": 1, "first": 1, "last": 1}], "links": [{"anchor": "a", "sentence": "s", "heading": "P", "target": "t.md", "line": 1, "preview": None}]}
    worded = [Packer(change(mode)) for change in [lambda m: m, *WORDINGS.values()]]
    assert len({p.key(p.pack("q", page)) for p in worded}) == len(worded)
    key, bodies = posts(spark, corpus, a.Asking())
    assert keys["plain"] == key
    body = bodies[0]
    shown = {x["target"]: x["target_preview"] for x in body["state"]["links"]}
    assert shown["../x.md"] is None and shown["b.md"]["headings"] == ["Red apples"] and shown["c.md"]["leads"] == ["red apples"]
    assert "grows on trees" in json.dumps(posts(spark, corpus, settings["criterion"])[1])


def test_replies_become_judgments(spark, corpus):
    pages, parsed, queries = corpus
    asked = spark.createDataFrame([("q", p) for p in ("i.md", "d.md", "nowhere.md")], "query_id string, path string")
    got = {r.path: r for r in a.asking_judge(parsed, pages, queries)(asked).collect()}
    assert set(got) == {"i.md", "d.md"} and got["d.md"].relevance == 1.0 and got["d.md"].error is None and got["d.md"].bought
    assert [(s.heading, s.first, s.last, s.score) for s in got["d.md"].sections] == [("Four", 1, 3, 1.0)]
    assert [(x.target, x.scent, x.in_root) for x in got["i.md"].links] == [("a.md", 1.0, True), ("b.md", 1.0, True), ("c.md", 1.0, True), ("../x.md", 0.0, False)]
    bare = a.Asking(context=LinkContext(previews=False), keep=ShareRule())
    links = {x.target: (x.scent, x.keep) for x in a.asking_judge(parsed, pages, queries, bare)(asked).where("path = 'i.md'").first().links}
    assert links["../x.md"] == (None, False) and links["a.md"] == (0.0, False)


def test_long_pages_are_asked_about_in_parts(spark):
    text = "".join(f"# Part {i}\n\n" + ("red apples\n" if i == 7 else "plain words\n") * 400 for i in range(12))
    pages = spark.createDataFrame([("p.md", text)], "path string, text string")
    queries = spark.createDataFrame([("q", "red apples")], "query_id string, query string")
    row = a.asking_judge(parse_pages(pages), pages, queries)(queries.selectExpr("query_id", "'p.md' as path")).first()
    assert row.requests > 1 and row.relevance == 1.0 and [s.score for s in row.sections] == [float(i == 7) for i in range(12)]


def test_a_page_fails_whose_reply_lacks_an_answer(spark, corpus):
    pages, parsed, queries = corpus

    def partly(body):
        reply = a.lexical_answerer(body)
        if body["state"]["file"]["path"] == "a.md":
            del reply["answers"]["section_0"]
        return reply

    found = run_query(spark, pages, Options("red apples", ("i.md",), threshold=0.3, walk=WalkConfig(threshold=0.3), answer=partly))
    assert "a.md" not in {f["path"] for f in [*found.results, *found.walked]} and found.visited == 3
    with pytest.raises(a.NoAnswer):
        a.read_reply({"questions": {a.CHOICE: {}}}, {"answers": {a.CHOICE: {"shares": {"0": 1.0}}}}, [], [4])


def test_ignored_links_are_heard_of(spark, corpus):
    heard = []
    run_query(spark, corpus[0], Options("red apples", ("i.md",), threshold=0.3, walk=WalkConfig(threshold=0.3), ignore=IgnoreRules.of("b.md")), listen=heard.append)
    assert ("i.md", "b.md", "ignored") in {(e.get("source"), e.get("target"), e.get("reason")) for e in heard}
    assert [e["event"] for e in heard][0] == "started" and heard[-1]["event"] == "result" and "b.md" not in {e.get("path") for e in heard}


def test_a_busy_judge_is_asked_again():
    replies = [(429, {"Retry-After": "2"}, ""), (529, {}, ""), (200, {}, '{"answers": {}}')]
    waits, sent = [], []
    assert a.remote_answerer(lambda t: sent.append(t) or replies[len(sent) - 1], waits.append)({"x": 1}) == {"answers": {}}
    assert waits == [2.0, 0.5] and sent == ['{"x":1}'] * 3
    for status, asked in ((429, 3), (400, 1)):
        waits.clear()
        sent.clear()
        with pytest.raises(a.NoAnswer):
            a.remote_answerer(lambda t: sent.append(t) or (status, {"retry-after": "99"}, ""), waits.append)({})
        assert len(sent) == asked and waits == [30.0] * (asked - 1)


def test_policies_that_ask(spark, corpus):
    pages, _, queries = corpus
    judge_for = ev.asking_policies(pages, queries)
    asked = spark.createDataFrame([("q", "i.md")], "query_id string, path string")
    scents = {r.target: (r["previews"], r["no-frontmatter"], r["no-previews"]) for r in ev.entry_scents(asked, judge_for).collect()}
    assert scents["a.md"] == (1.0, 0.0, 0.0) and scents["b.md"] == (1.0, 1.0, 0.0)
