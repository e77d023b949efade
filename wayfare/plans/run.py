"""One query end to end: pages, judge, walk, reading list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.text import relative_to_root
from wayfare.operators.asking import Answerer, Asking, asking_judge, lexical_answerer
from wayfare.operators.judging import DEFAULT_MODE, MODES, WORDINGS, Judge, Mode, ShareRule, custom_mode
from wayfare.operators.parse import parse_pages
from wayfare.operators.readlist import ReadingList, reading_list
from wayfare.operators.request import LinkContext
from wayfare.operators.walk import WalkConfig, round_walk
from wayfare.plans.tables import materialize
from wayfare.sources.ignore import IgnoreRules
from wayfare.sources.store import JudgmentStore


class EntryIgnored(ValueError):
    """An entry page is excluded by the ignore rules."""


class NothingJudged(RuntimeError):
    """No page of the walk could be judged."""


@dataclass(frozen=True)
class Options:
    """One query.  ``criterion`` is a criterion in free text in place of a named ``mode``; with ``keep`` a page's links
    are judged against each other; ``store`` is the folder of judged answers (None: every answer is asked for)."""

    query: str
    entries: tuple[str, ...]
    root: str = ""
    mode: str = DEFAULT_MODE
    threshold: float = 0.6
    walk: WalkConfig = field(default_factory=WalkConfig)
    ignore: IgnoreRules = field(default_factory=IgnoreRules)
    keep: ShareRule | None = None
    criterion: str | None = None
    wording: str | None = None
    context: LinkContext = LinkContext()
    answer: Answerer = lexical_answerer
    store: str | None = None

    def asked_mode(self) -> Mode:
        mode = MODES[self.mode] if self.criterion is None else custom_mode("custom", self.criterion)
        return WORDINGS[self.wording](mode) if self.wording else mode


def without_ignored(parsed: DataFrame, rules: IgnoreRules) -> DataFrame:
    """Parsed pages whose links to ignored targets are gone, before any preview or judging; ``ignored`` lists those targets."""
    if not rules.rules:
        return parsed.withColumn("ignored", F.array().cast("array<string>"))
    links = parsed.select("path", F.posexplode("links").alias("pos", "l")).withColumn("out", rules.predicate(F.col("l.target")))
    kept = F.sort_array(F.collect_list(F.when(~F.col("out"), F.struct("pos", "l"))))
    dropped = F.array_sort(F.collect_set(F.when(F.col("out"), F.col("l.target"))))
    lists = links.groupBy("path").agg(kept.alias("k"), dropped.alias("ignored"))
    lists = lists.select("path", F.transform("k", lambda x: x["l"]).alias("kept"), "ignored")
    out = parsed.join(lists, "path", "left").withColumn("links", F.coalesce("kept", "links")).drop("kept")
    return out.withColumn("ignored", F.coalesce("ignored", F.array().cast("array<string>")))


def run_query(spark: SparkSession, pages: DataFrame, options: Options, judge: Judge | None = None, listen: Callable[[dict], None] | None = None) -> ReadingList:
    """A reading list over ``pages(path, text)``.

    Pages are judged by questions in the options' mode, wording and context, answered by ``options.answer`` or found in the
    store, unless a judge is given.  ``listen`` gets every event of the walk as it happens.
    """
    entries = [relative_to_root(options.root, e) if options.root else e for e in options.entries]
    for e in entries:
        if options.ignore.matched(e):
            raise EntryIgnored(e)
    if not 0 <= options.threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    mode = options.asked_mode()
    parsed = materialize(without_ignored(parse_pages(pages), options.ignore), "parsed")
    if judge is None:
        queries = spark.createDataFrame([("q", options.query)], "query_id string, query string")
        judge = asking_judge(parsed, pages, queries, Asking(mode, options.context, options.keep, options.answer), JudgmentStore(spark, options.store))
    dropped = parsed.select("path", "ignored")
    judged = (lambda asked: judge(asked).join(dropped, "path", "left")) if options.ignore.rules else judge
    if listen is not None:
        listen({"event": "started", "query": options.query, "mode": mode.name, "threshold": options.threshold})
    found = round_walk(spark, {"q": entries}, judged, options.walk, options.ignore.matched, listen)["q"]
    if not found.visits:
        raise NothingJudged(options.query)
    out = reading_list(found, options.query, mode.name, getattr(judge, "name", "custom"), options.threshold, options.root)
    if listen is not None:
        for event in found.trace(options.query, mode.name, options.threshold):
            if event["event"] == "result":
                listen(event)
    return out
