"""Experiment bookkeeping: what is left to buy, what it will cost, and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_USD = 5.0
AGENT_PREFIX = "agent"


def pending_jobs(queries: DataFrame, conditions: DataFrame, repeats: int, done: DataFrame, cold: int = 0) -> DataFrame:
    """``query_id, condition, repeat, seq`` not in ``done``, in order of repeat, query and condition.

    The first ``cold`` repeats also have every condition's ``-cold`` form.  The
    product is of parameters (queries x repeats x conditions), not of data.
    """
    rounds = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    jobs = queries.select("query_id", F.col("seq").alias("q_")).crossJoin(conditions.select("condition", F.col("seq").alias("c_"))).select("*", rounds)
    warm = jobs.withColumn("cold_", F.lit(0))
    if cold:
        chilled = jobs.where(F.col("repeat") <= cold).withColumn("condition", F.concat("condition", F.lit("-cold"))).withColumn("cold_", F.lit(1))
        warm = warm.unionByName(chilled)
    key = ["query_id", "condition", "repeat"]
    left = warm.join(done.select(*key), key, "left_anti")
    return left.withColumn("seq", F.struct("repeat", "q_", "c_", "cold_")).drop("q_", "c_", "cold_")


def is_agent(condition: Column) -> Column:
    return condition.startswith(AGENT_PREFIX)


def model_identity(condition: Column, model: Column) -> Column:
    """A model tells runs apart only under agent conditions."""
    return F.when(is_agent(condition), model)


def ledger_last(lines: DataFrame, key: list[str], order: str = "line") -> DataFrame:
    """The last line of each key."""
    rest = [c for c in lines.columns if c not in key]
    last = F.max_by(F.struct(*rest), order)
    return lines.groupBy(*key).agg(last.alias("last_")).select(*key, "last_.*")


def done_set(rows: DataFrame, ledger: DataFrame, wiki: str, model: str | None, retry_failed: bool = False) -> DataFrame:
    """Keys that need not be bought again: finished rows and ledger entries of this corpus revision and model.

    Ledger entries still in flight (``ok`` null) are not done; with ``retry_failed`` neither are failures.
    """
    own = lambda df, asked: df.where((F.col("wiki") == wiki) & (~is_agent(F.col("condition")) | F.col(asked).eqNullSafe(F.lit(model))))
    good = F.col("ok") if retry_failed else F.col("ok").isNotNull()
    a = own(rows, "model_asked_for").where(good).select("query_id", "condition", "repeat")
    b = own(ledger, "model").where(good).select(F.col("query").alias("query_id"), "condition", "repeat")
    return a.unionByName(b).distinct()


def estimate(pending: DataFrame, costs: DataFrame, wiki: str) -> DataFrame:
    """``condition, jobs, each, total, is_floor``: the mean cost on this revision, else on any;
    ``is_floor`` where none is known, so the sum is a lower bound."""
    mean = costs.where("cost_usd is not null").groupBy("condition").agg(F.avg(F.when(F.col("wiki") == wiki, F.col("cost_usd"))).alias("same"), F.avg("cost_usd").alias("any"))
    each = F.coalesce("same", "any")
    jobs = pending.groupBy("condition").agg(F.count("*").alias("jobs"))
    return jobs.join(mean, "condition", "left").select("condition", "jobs", F.coalesce(each, F.lit(0.0)).alias("each"), (F.col("jobs") * F.coalesce(each, F.lit(0.0))).alias("total"), each.isNull().alias("is_floor"))


def needs_confirmation(total: float, most: float = MOST_USD) -> bool:
    return total > most


def grouped_stats(rows: DataFrame) -> DataFrame:
    """Mean, sample deviation (null for one), least, most and count of every metric of finished runs:
    by condition overall, by query and by category (grouping sets).  ``level`` names the grouping."""
    label = F.concat_ws("@", "condition", model_identity(F.col("condition"), F.col("model_asked_for")))
    long = rows.where("ok").select(label.alias("condition"), "query_id", "category", F.explode("metrics").alias("metric", "value"))
    statistics = """
        SELECT CASE WHEN grouping(query_id) = 0 THEN 'query' WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS level,
               condition, query_id, category, metric,
               avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS least, max(value) AS most, count(*) AS n
        FROM {runs}
        GROUP BY GROUPING SETS ((condition, metric), (condition, metric, query_id), (condition, metric, category))
        """
    return long.sparkSession.sql(statistics, runs=long)


def failed_runs(rows: DataFrame) -> DataFrame:
    label = F.concat_ws("@", "condition", model_identity(F.col("condition"), F.col("model_asked_for")))
    return rows.groupBy(label.alias("condition")).agg(F.count_if(~F.col("ok")).alias("failed"))


def set_rates(got: DataFrame, wanted: DataFrame, by: str = "query_id", item: str = "page") -> DataFrame:
    """``by, recall, precision`` of sets; 0 on empty ones."""
    from wayfare.operators.metrics import share

    g, w = got.select(by, item).distinct(), wanted.select(by, item).distinct()
    one = lambda df, n: df.groupBy(by).agg(F.count("*").alias(n))
    joined = one(w, "gold").join(one(g, "got"), by, "full").join(one(g.join(w, [by, item], "left_semi"), "hit"), by, "left").na.fill(0)
    return joined.select(by, share(F.col("hit"), F.col("gold")).alias("recall"), share(F.col("hit"), F.col("got")).alias("precision"))


def paired_rows(rows: DataFrame, needs: str) -> DataFrame:
    """The latest finished ``needs`` run of each query and repeat, for runs that build on it."""
    order = Window.partitionBy("query_id", "repeat").orderBy(F.desc("seq"))
    return rows.where(F.col("ok") & (F.col("condition") == needs)).withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def condition_threshold(condition: Column) -> Column:
    """The value of a ``...-t<N>`` condition, null unless in 0 to 1."""
    value = F.regexp_extract(condition, r"-t([0-9.]+)$", 1).try_cast("double")
    return F.when(value.between(0, 1), value)


def label_problem(label: Column) -> Column:
    """Why a label may not be published (null: it may): path-like, over 64 characters, over 4 words."""
    return (
        F.when(label.rlike(r"[/\\]|\.(md|txt)$"), "looks like a path")
        .when(F.length(label) > 64, "longer than 64 characters")
        .when(F.size(F.filter(F.split(label, r"\s+"), lambda w: w != "")) > 4, "more than 4 words")
    )


def store_diff(now: DataFrame, before: DataFrame, key: str = "key") -> DataFrame:
    """Tokens and cost of stored answers that were not there before."""
    from wayfare.operators.metrics import PRICE_PER_TOKEN

    new = now.join(before.select(key), key, "left_anti")
    tokens = F.coalesce(F.sum("detail.input_tokens"), F.lit(0))
    return new.agg(F.count("*").alias("entries"), tokens.alias("input_tokens"), (tokens * PRICE_PER_TOKEN).alias("cost"))


def store_merge(into: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    """Entries of both; where a key is in both, the one already there stays."""
    return into.unionByName(more.join(into.select(key), key, "left_anti"))
