"""Evaluation of walks against a gold set: budgets, threshold sweep, ablations, baselines, calibration and a report.

All queries of a setting walk together (``round_walk``); what they visited becomes
tables, and every figure is a DataFrame operation over those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import metrics, ranking
from wayfare.operators.asking import Answerer, Asking, asking_judge, lexical_answerer
from wayfare.operators.judging import MEASURED_WORDINGS, MODES, WORDINGS, Judge, Mode, ShareRule, choice_judge, cost_usd, keyword_judge
from wayfare.operators.parse import parse_pages, previews
from wayfare.operators.request import LinkContext, bounded_previews
from wayfare.operators.walk import CHOICE_BEAM, Outcome, WalkConfig, round_walk
from wayfare.plans.render import markdown_table, signed_percent
from wayfare.plans.tables import materialize

BUDGETS = (10, 25)

#: Settings that experiments compare, each as what it changes.
PREVIEW_POLICIES = {"previews": LinkContext(), "no-frontmatter": LinkContext(frontmatter=False), "no-previews": LinkContext(previews=False)}
CONTEXTS = {
    "full": LinkContext(),
    "no-headings": LinkContext(headings=False),
    "no-leads": LinkContext(leads=False),
    "one-hop": LinkContext(two_hop=False),
    "bare": LinkContext(headings=False, leads=False, two_hop=False),
}

@dataclass(frozen=True)
class Policy:
    """How links are judged: what is shown of targets, in which wording, and with ``keep`` against each other."""

    context: LinkContext = LinkContext()
    wording: str | None = None
    keep: ShareRule | None = None

    def mode(self, mode: Mode) -> Mode:
        return WORDINGS[self.wording](mode) if self.wording else mode


RELATIVE = {
    "noul": Policy(),
    "choice": Policy(LinkContext(previews=False), keep=ShareRule()),
    "choice, previews": Policy(keep=ShareRule()),
    "choice, previews, k=1": Policy(keep=ShareRule(times_even=1)),
}
EXPERIMENTS = {
    "previews": {k: Policy(c) for k, c in PREVIEW_POLICIES.items()},
    "contexts": {k: Policy(c) for k, c in CONTEXTS.items()},
    "relative": RELATIVE,
    "wordings": {"plain": Policy()} | {w: Policy(wording=w) for w in MEASURED_WORDINGS},
}
#: Experiments of which a judge that is asked no questions can answer every row, but for the far question of "one-hop".
LEXICAL = ("previews", "contexts", "relative")
ALL = tuple(EXPERIMENTS)


@dataclass(frozen=True)
class Setting:
    """One column of the grid: a budget and a threshold for links and sections alike."""

    max_files: int
    threshold: float

    def config(self, base: WalkConfig) -> WalkConfig:
        return replace(base, max_files=self.max_files, threshold=None if base.threshold is None else self.threshold)


def grid(budgets=BUDGETS, thresholds=(0.6,)) -> list[Setting]:
    """Budgets sorted and distinct, each with every threshold."""
    return [Setting(b, t) for b in sorted(set(budgets)) for t in thresholds]


_VISITS = "budget int, threshold double, query_id string, page string, scent double, relevance double, depth int, returned boolean, calls long, sections array<struct<first:int,last:int,score:double>>"
SPENT = ("served", "bought", "requests", "input_tokens", "bought_tokens", "latency_ms")
_LINKS = "budget int, threshold double, query_id string, source string, target string, scent double, followed boolean, reason string"


def visit_rows(states: dict[str, Outcome], setting: Setting) -> tuple[list, list]:
    visits, links = [], []
    for q, s in states.items():
        for v in s.visits:
            good = [(x["first"], x["last"], x["score"]) for x in v.sections if x["score"] >= setting.threshold]
            visits.append((setting.max_files, setting.threshold, q, v.path, v.scent, v.relevance, v.depth, v.relevance >= setting.threshold or bool(good), s.calls, good))
            links += [(setting.max_files, setting.threshold, q, v.path, x.target, x.scent, x.followed, x.reason) for x in v.links]
    return visits, links


@dataclass
class Findings:
    """Tables of an evaluation; every frame but ``visits`` and ``links`` has a row a setting or a bin."""

    visits: DataFrame
    links: DataFrame
    scores: DataFrame
    means: DataFrame
    read: DataFrame
    keyword: DataFrame
    calibration: DataFrame
    links_calibration: DataFrame
    decision: DataFrame
    unreached: DataFrame
    spent: DataFrame


def evaluate(
    spark: SparkSession, pages: DataFrame, queries: DataFrame, entries: dict[str, list[str]], wanted: DataFrame, judge: Judge, settings: list[Setting], base: WalkConfig = WalkConfig()
) -> Findings:
    """Walk every query in every setting and score what came back.

    ``queries``: ``query_id, query``; ``wanted``: ``query_id, page, first, last``.  The rows that reach
    the driver are at most the walks' budgets.
    """
    visits, links, paid = [], [], []
    for setting in settings:
        walked = round_walk(spark, entries, judge, setting.config(base))
        v, x = visit_rows(walked, setting)
        visits += v
        links += x
        total = sum((o.spent for o in walked.values()), Counter())
        paid.append((setting.max_files, setting.threshold, *[int(total[k]) for k in SPENT]))
    seen = spark.createDataFrame(visits, _VISITS)
    judged = spark.createDataFrame(links, _LINKS)
    by = ["budget", "threshold"]
    frames, read = [], []
    for s in settings:
        own = seen.where((F.col("budget") == s.max_files) & (F.col("threshold") == s.threshold))
        got = own.where("returned")
        ranges = got.select("query_id", "page", F.explode("sections").alias("s")).select("query_id", "page", "s.first", "s.last")
        scored = metrics.rates(metrics.score_lists(wanted, got, own, ranges))
        frames.append(scored.withColumns({"budget": F.lit(s.max_files), "threshold": F.lit(s.threshold)}))
        keyed = ranges.select(F.concat_ws("\n", "query_id", "page").alias("path"), "first", "last", "query_id", "page")
        texts = keyed.select("path", "page").distinct().join(pages.select(F.col("path").alias("page"), "text"), "page").select("path", "text")
        chars = ranking.coverage(texts, keyed.select("path", "first", "last"))
        whole = got.join(pages.select(F.col("path").alias("page"), F.length("text").alias("n")), "page").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole_chars"))
        sums = chars.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).crossJoin(whole)  # one row each
        read.append(
            sums.select(
                F.lit(s.max_files).alias("budget"), F.lit(s.threshold).alias("threshold"), F.ceil(F.col("chars") / 4).alias("read_tokens"), "lines", F.ceil(F.col("whole_chars") / 4).alias("whole_tokens")
            )
        )
    scores, reads = frames[0], read[0]
    for f, r in zip(frames[1:], read[1:]):
        scores, reads = scores.unionByName(f), reads.unionByName(r)
    most = max(s.max_files for s in settings)
    hits = ranking.keyword_topk(pages, queries, most).select("query_id", F.col("path").alias("page"))
    nothing = wanted.select("query_id", "page", "first", "last").limit(0)
    keyword = metrics.means(metrics.rates(metrics.score_lists(wanted, hits, hits, nothing)))
    gold = wanted.select("query_id", "page").distinct().withColumn("wanted", F.lit(True))
    arrivals = seen.where("scent is not null").join(gold, ["query_id", "page"], "left").na.fill(False, ["wanted"])
    to_pages = judged.where("scent is not null").join(pages.select(F.col("path").alias("target")), "target", "left_semi")
    links_wanted = to_pages.join(gold.withColumnRenamed("page", "target"), ["query_id", "target"], "left").na.fill(False, ["wanted"])
    return Findings(
        seen,
        judged,
        scores,
        metrics.means(scores, by),
        reads,
        keyword,
        metrics.calibration(arrivals),
        metrics.calibration_links(links_wanted),
        metrics.follow_decision(links_wanted, settings[0].threshold),
        metrics.unreached(wanted, seen.select("query_id", "page")),
        spark.createDataFrame(paid, "budget int, threshold double, " + ", ".join(f"{k} long" for k in SPENT)).select(
            "budget", "threshold", *SPENT, metrics.share(F.col("requests"), F.col("served")).alias("requests_per_answer"), metrics.share(F.col("latency_ms"), F.col("served")).alias("mean_latency_ms"),
            cost_usd(F.col("input_tokens")).alias("cost_usd"),
        ),
    )


def lexical_policies(pages: DataFrame, queries: DataFrame) -> Callable[[Policy], Judge]:
    """The lexical judge under each policy.  It is asked no questions, so a wording is an error and
    one or two hops are the same to it."""
    parsed = materialize(parse_pages(pages), "parsed")

    def judge_for(policy: Policy) -> Judge:
        if policy.wording:
            raise ValueError(f"the lexical judge is asked no questions: {policy.wording}")
        judge = keyword_judge(parsed, pages, queries, bounded_previews(previews(parsed), policy.context))
        return judge if policy.keep is None else choice_judge(judge, policy.keep)

    return judge_for


def asking_policies(pages: DataFrame, queries: DataFrame, mode: Mode = MODES["useful-for"], answer: Answerer = lexical_answerer) -> Callable[[Policy], Judge]:
    """A judge that asks, under each policy: its wording in the questions, its context in the previews and posts, and with
    a share rule links as options of one question."""
    parsed = materialize(parse_pages(pages), "parsed")
    return lambda policy: asking_judge(parsed, pages, queries, Asking(policy.mode(mode), policy.context, policy.keep, answer))


def ablations(
    spark: SparkSession, pages: DataFrame, queries: DataFrame, entries: dict[str, list[str]], wanted: DataFrame, judge_for: Callable[[Policy], Judge], setting: Setting,
    base: WalkConfig = WalkConfig(), experiments: tuple[str, ...] = LEXICAL,
) -> DataFrame:
    """``experiment, policy`` and the means of the walks in ``setting`` under that policy's judge.

    ``judge_for`` makes the judge of a policy; one that asks questions packs them with
    ``Packer(policy.mode(mode), two_hop=policy.context.two_hop)``.  A policy that stands in several
    experiments is walked once.
    """
    done: dict[Policy, DataFrame] = {}
    out = None
    for experiment in experiments:
        for n, (name, policy) in enumerate(EXPERIMENTS[experiment].items()):
            if policy not in done:
                config = base if policy.keep is None else replace(base, threshold=None, beam=base.beam or CHOICE_BEAM)
                done[policy] = evaluate(spark, pages, queries, entries, wanted, judge_for(policy), [setting], config).means
            row = done[policy].withColumns({"experiment": F.lit(experiment), "n": F.lit(n), "policy": F.lit(name)})
            out = row if out is None else out.unionByName(row)
    return out.select("experiment", "n", "policy", *[c for c in out.columns if c not in ("experiment", "n", "policy")])


def entry_scents(asked: DataFrame, judge_for: Callable[[Policy], Judge]) -> DataFrame:
    """The link scents of one asked page (``query_id, path``) under each preview policy."""
    out = None
    for name, policy in EXPERIMENTS["previews"].items():
        rows = judge_for(policy)(asked).select(F.lit(name).alias("policy"), F.explode("links").alias("l")).select("policy", "l.target", "l.scent")
        out = rows if out is None else out.unionByName(rows)
    return scents_by_policy(out)


def scents_by_policy(judgments: DataFrame) -> DataFrame:
    """One page's link scents side by side, a column a policy.  ``judgments``: ``policy, target, scent``."""
    return judgments.groupBy("target").pivot("policy", sorted(PREVIEW_POLICIES)).agg(F.max("scent"))


def _table(df: DataFrame, *order: str) -> str:
    rows = df.orderBy(*order).collect()  # a row a setting or a bin
    digits = lambda c: 6 if c.startswith("cost") else 2
    return markdown_table(df.columns, [[f"{v:.{digits(c)}f}" if isinstance(v, float) else v for c, v in zip(df.columns, r)] for r in rows])


def report(found: Findings, ablated: DataFrame | None = None, scents: DataFrame | None = None) -> str:
    """A markdown report of an evaluation, with what ``ablations`` and ``entry_scents`` gave."""
    means = found.means.orderBy("budget", "threshold").collect()
    parts = ["# Evaluation", "", "## Means", "", _table(found.means, "budget", "threshold"), "## Reading", "", _table(found.read, "budget", "threshold")]
    if len(means) > 1:
        base = means[0]
        rows = [[m["budget"], m["threshold"], signed_percent(m["mean_recall"], base["mean_recall"]), signed_percent(m["mean_precision"], base["mean_precision"])] for m in means[1:]]
        parts += ["## Against the first setting", "", markdown_table(["budget", "threshold", "recall", "precision"], rows)]
    parts += ["## Cost", "", _table(found.spent, "budget", "threshold")]
    if ablated is not None:
        for experiment in EXPERIMENTS:
            rows = ablated.where(F.col("experiment") == experiment).drop("experiment")
            if not rows.isEmpty():
                parts += [f"## By policy: {experiment}", "", _table(rows, "n")]
    if scents is not None:
        parts += ["## Scents of the entry page's links by policy", "", _table(scents, "target")]
    parts += ["## Keyword baseline", "", _table(found.keyword, "runs"), "## Arrivals by scent", "", _table(found.calibration, "bin"), "## Links by scent", "", _table(found.links_calibration, "bin")]
    parts += ["## Followed and passed links", "", _table(found.decision, "followed"), f"{found.unreached.count()} wanted pages were never visited.", ""]
    return "\n".join(parts)
