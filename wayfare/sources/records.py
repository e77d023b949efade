"""JSON and JSONL sources: gold sets, traces, run rows, ledgers, agent logs, stored lists."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.operators.experiment import ledger_last


class BadRecord(ValueError):
    """A source that does not hold what it should."""


# ---- gold sets -----------------------------------------------------------------


def _gold(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    queries = F.variant_get("v", "$.queries", "array<variant>")
    return whole.select(F.posexplode(queries).alias("seq", "q"))


def _string(field: str) -> Column:
    return F.try_variant_get("q", f"$.{field}", "string")


def read_gold(spark: SparkSession, path: str, modes: tuple[str, ...] = ("about", "useful-for", "answers")) -> tuple[DataFrame, DataFrame]:
    """(queries, wanted): ``query_id, query, mode, entry, note`` and ``query_id, page, heading, first, last``.

    Blank queries, unknown modes, repeated ids and repeated or missing expected pages are errors.
    """
    raw = _gold(spark, path)
    queries = raw.select("seq", _string("id").alias("query_id"), _string("query").alias("query"), _string("mode").alias("mode"), _string("entry").alias("entry"), _string("note").alias("note"))
    expected = raw.select(_string("id").alias("query_id"), F.explode(F.try_variant_get("q", "$.expected", "array<variant>")).alias("e"))
    is_text = F.schema_of_variant("e") == "STRING"
    get = lambda p, t: F.when(~is_text, F.try_variant_get("e", p, t))
    wanted = expected.select(
        "query_id",
        F.when(is_text, F.try_variant_get("e", "$", "string")).otherwise(get("$.path", "string")).alias("page"),
        get("$.heading", "string").alias("heading"),
        get("$.lines[0]", "int").alias("first"),
        get("$.lines[1]", "int").alias("last"),
    )
    checks = (
        ("a blank query", queries.where("query is null or trim(query) = ''")),
        ("an unknown mode", queries.where(~F.col("mode").isin(*modes))),
        ("a repeated id", queries.groupBy("query_id").count().where("count > 1")),
        ("no entry", queries.where("entry is null")),
        ("no expected page", queries.join(wanted, "query_id", "left_anti")),
        ("a repeated expected page", wanted.groupBy("query_id", "page", "heading", "first", "last").count().where("count > 1")),
    )
    if queries.isEmpty():
        raise BadRecord(f"{path}: no queries")
    for what, rows in checks:
        bad = rows.select("query_id").first()
        if bad is not None:
            raise BadRecord(f"{path}: {bad['query_id']}: {what}")
    return queries, wanted


def read_gold_lenient(spark: SparkSession, path: str, only: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, entries, wanted) of a harness set: ``wanted`` or ``expected``, one or many entries, optional category and mode."""
    raw = _gold(spark, path)
    queries = raw.select("seq", _string("id").alias("query_id"), _string("category").alias("category"), _string("query").alias("query"), _string("mode").alias("mode"))
    many = F.try_variant_get("q", "$.entry", "array<string>")
    entries = raw.select(_string("id").alias("query_id"), F.explode(F.coalesce(many, F.when(_string("entry").isNotNull(), F.array(_string("entry"))), F.array().cast("array<string>"))).alias("path"))
    listed = F.coalesce(F.try_variant_get("q", "$.wanted", "array<string>"), F.try_variant_get("q", "$.expected", "array<string>"))
    wanted = raw.select(_string("id").alias("query_id"), F.explode(listed).alias("page"))
    if only is not None:
        asked = spark.createDataFrame([(x,) for x in only], "query_id string")
        unknown = asked.join(queries, "query_id", "left_anti").first()
        if unknown is not None:
            raise BadRecord(f"no query {unknown['query_id']}")
        queries, entries, wanted = (df.join(asked, "query_id", "left_semi") for df in (queries, entries, wanted))
    return queries, entries, wanted


# ---- JSONL -----------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of the non-blank lines of a file (or of a folder's files by name), numbered in file order.

    Files are read in splits by many tasks.  A line's number is its place in its split, which the reader's ids
    count, after the lines of the splits before it: a row a split.
    """
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("lineSep", "\n").text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select(F.col("split").alias("of"), (before - F.col("first")).alias("shift"))
    numbered = rows.join(F.broadcast(offsets), F.col("split") == F.col("of"))  # a row a split of a file
    return numbered.where(F.trim("value") != "").select((F.col("id") + F.col("shift") + 1).alias("line"), "value")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a trace, ``line`` first.  Unknown events are left out; a broken last line is
    dropped (a run may have been stopped); a broken line before it is an error, and so is an empty trace."""
    lines = numbered_lines(spark, path)
    rows = lines.select("line", F.from_json("value", f"{schema.TRACE}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("e"))
    last = rows.agg(F.max("line")).first()[0]
    broken = rows.where((F.col("e.broken").isNotNull() | F.col("e").isNull()) & (F.col("line") < F.lit(last))).first()
    if broken is not None:
        raise BadRecord(f"{path}:{broken['line']}: not an event")
    events = rows.where(F.col("e.broken").isNull() & F.col("e").isNotNull()).select("line", "e.*").drop("broken")
    events = events.where(F.col("event").isin("started", "popped", "requested", "answered", "admitted", "pruned", "result"))
    if events.isEmpty():
        raise BadRecord(f"{path}: no events")
    return events


def write_trace(events: DataFrame, path: str) -> None:
    """Events as JSON lines; nulls are left out and the commit protocol keeps lines whole."""
    events.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


class TraceFile:
    """A trace written while a walk runs: one whole line an event, with milliseconds since the start.

    A write that fails is undone as far as the file allows, reported once through ``warn``, and nothing more is written.
    """

    def __init__(self, path: str, warn: Callable[[str], None]):
        self._path, self._warn, self._begin = path, warn, time.monotonic()
        self._open = True
        self._put(lambda f: f.truncate(0))

    def __call__(self, event: dict) -> None:
        line = json.dumps({k: v for k, v in {**event, "t_ms": int((time.monotonic() - self._begin) * 1000)}.items() if v is not None}, ensure_ascii=False) + "\n"
        self._put(lambda f: f.write(line.encode()))

    def _put(self, write: Callable) -> None:
        if not self._open:
            return
        try:
            with open(self._path, "ab", buffering=0) as f:
                at = f.seek(0, 2)
                try:
                    write(f)
                except OSError:
                    f.truncate(at)
                    raise
        except OSError as e:
            self._open = False
            self._warn(f"no more of the trace is written: {e}")


def append_line(path: str, row: dict) -> None:
    """One JSON line at the end of a file."""
    with open(path, "ab", buffering=0) as f:
        f.write((json.dumps(row, ensure_ascii=False) + "\n").encode())


def buy(job: dict, measure: Callable[[dict], dict], ledger: str, rows: str) -> dict:
    """Buy one run so that a stop at any point is visible: the ledger says it is under way, the run is
    measured, its row is appended, and the ledger says how it ended and what it cost.

    ``job``: ``wiki, query, condition, repeat, model, out``; ``measure`` gives a run row with ``ok`` and perhaps ``cost_usd``.
    A measurement that raises is a failed run: the ledger says so, no row is written, and the error goes on.
    """
    entry = {k: job.get(k) for k in ("wiki", "query", "condition", "repeat", "model", "out")}
    append_line(ledger, entry)
    try:
        row = measure(job)
    except Exception:
        append_line(ledger, {**entry, "ok": False})
        raise
    append_line(rows, {k: v for k, v in row.items() if k != "cost_usd"})
    append_line(ledger, {**entry, "ok": bool(row.get("ok")), "cost_usd": row.get("cost_usd")})
    return row


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run rows with ``seq`` in file order; ``detail`` stays JSON text."""
    return numbered_lines(spark, path).select(F.col("line").alias("seq"), F.from_json("value", schema.RUN_ROW).alias("r")).select("seq", "r.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each key and model; a malformed line is an error with its number, no file is an empty ledger."""
    from pyspark.errors import AnalysisException

    try:
        lines = numbered_lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema.LEDGER)
    rows = lines.select("line", F.from_json("value", schema.LEDGER).alias("r"), F.is_variant_null(F.try_parse_json("value")).alias("parsed"))
    bad = rows.where(F.col("parsed").isNull() | F.col("r.query").isNull()).orderBy("line").first()
    if bad is not None:
        raise BadRecord(f"{path}:{bad['line']}: not a ledger line")
    return ledger_last(rows.select("line", "r.*"), ["wiki", "query", "condition", "repeat", "model"]).drop("line")


# ---- agent logs ------------------------------------------------------------------


def _path_in(wiki: str, path: Column) -> Column:
    return F.regexp_replace(path, f"^(?:\\Q{wiki.rstrip('/')}\\E/)?(?:\\./)?", "")


def agent_stream(spark: SparkSession, path: str, wiki: str) -> DataFrame:
    """One row of an agent's event stream: session, model, last answer, cost, token totals, tool uses, denials, files read, subagents."""
    v = numbered_lines(spark, path).select("line", F.parse_json("value").alias("v"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    rows = v.select(
        "line", "v", get("$.type").alias("type"), get("$.subtype").alias("subtype"), get("$.session_id").alias("session"), get("$.parent_tool_use_id").isNull().alias("own")
    )
    blocks = rows.where("own").select("line", "type", F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    bget = lambda p, t="string": F.try_variant_get("b", p, t)
    uses = blocks.where((F.col("type") == "assistant") & (bget("$.type") == "tool_use")).select(bget("$.name").alias("tool"), bget("$.input.file_path").alias("file"))
    tools = uses.groupBy("tool").agg(F.count("*").alias("n"))
    used = uses.agg(F.count("*").alias("tool_uses"), F.array_sort(F.collect_set(F.when(F.col("tool") == "Read", _path_in(wiki, F.col("file"))))).alias("files_read"))
    by_tool = tools.where("tool is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    denied = blocks.where((F.col("type") == "user") & (bget("$.type") == "tool_result")).agg(F.count_if(F.coalesce(bget("$.is_error", "boolean"), F.lit(False))).alias("denials"))
    tokens = lambda name: F.coalesce(F.sum(F.when(F.col("type") == "result", F.try_variant_get("v", f"$.usage.{name}", "long"))), F.lit(0)).alias(name)
    is_result = F.col("type") == "result"
    last = lambda p, t: F.max_by(F.when(is_result, F.try_variant_get("v", p, t)), F.when(is_result, F.col("line")))
    main = rows.agg(
        F.count_if(is_result).alias("results"),
        F.min_by("session", F.when(F.col("session").isNotNull(), F.col("line"))).alias("session_id"),
        F.min_by(F.try_variant_get("v", "$.message.model", "string"), F.when((F.col("type") == "assistant") & F.col("own"), F.col("line"))).alias("model"),
        F.coalesce(last("$.result", "string"), F.lit("")).alias("answer"),
        F.coalesce(last("$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.coalesce(last("$.total_cost_usd", "double"), F.lit(0.0)).alias("cost_usd"),
        *[tokens(n) for n in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
    )
    if main.first()["results"] == 0:
        raise BadRecord(f"{path}: no line of type result")
    started = rows.where("type = 'system' and subtype = 'task_started'").agg(F.count("*").alias("subagents"))
    return main.crossJoin(used).crossJoin(by_tool).crossJoin(denied).crossJoin(started)  # one row each


def agent_transcript(spark: SparkSession, path: str, wiki: str) -> DataFrame:
    """One row of a transcript: of each message the piece with most output tokens counts (the first of equals);
    lines that are not JSON are skipped."""
    v = numbered_lines(spark, path).select("line", F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    rows = v.where((get("$.type") == "assistant") & get("$.message.id").isNotNull())
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    pieces = rows.select("line", get("$.message.id").alias("id"), get("$.message.model").alias("model"), *[F.coalesce(get(f"$.message.usage.{n}", "long"), F.lit(0)).alias(n) for n in names])
    turns = best_piece(pieces, ["id"], "output_tokens", "line")
    total = turns.agg(F.count("*").alias("turns"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    model = pieces.agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).alias("model"))
    blocks = rows.select(F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    uses = blocks.where(F.try_variant_get("b", "$.type", "string") == "tool_use")
    file = F.when(F.try_variant_get("b", "$.name", "string") == "Read", _path_in(wiki, F.try_variant_get("b", "$.input.file_path", "string")))
    used = uses.agg(F.count("*").alias("tool_uses"), F.array_sort(F.collect_set(file)).alias("files_read"))
    return model.crossJoin(total).crossJoin(used)


def best_piece(pieces: DataFrame, key: list[str], by: str, order: str) -> DataFrame:
    """Of each key the row with the greatest ``by``, the first by ``order`` on ties."""
    rest = [c for c in pieces.columns if c not in key]
    return pieces.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), (-F.col(order)).alias("first"))).alias("p")).select(*key, "p.*")


def relied_on(answer: str, wiki: str) -> list[str] | None:
    """The last JSON array of strings in an answer, as paths in the corpus; None without one."""
    decoder = json.JSONDecoder()
    for at in range(len(answer) - 1, -1, -1):
        if answer[at] != "[":
            continue
        try:
            value, _ = decoder.raw_decode(answer, at)
        except ValueError:
            continue
        if all(isinstance(x, str) for x in value):
            base = wiki.rstrip("/") + "/"
            return [x.removeprefix(base).removeprefix("./") for x in value]
    return None


# ---- stored reading lists ----------------------------------------------------------


def list_ranges(lists: DataFrame, column: str = "json") -> DataFrame:
    """``list_id, page, first, last`` of the results of reading lists stored as JSON (first entry of a path counts)."""
    parsed = lists.select("list_id", F.from_json(column, "results array<struct<path:string,sections:array<struct<lines:array<int>>>>>").alias("r"))
    files = parsed.select("list_id", F.posexplode("r.results").alias("pos", "f")).select("list_id", "pos", "f.*")
    first = Window.partitionBy("list_id", "path").orderBy("pos")
    files = files.withColumn("n_", F.row_number().over(first)).where("n_ = 1")
    sections = files.select("list_id", F.col("path").alias("page"), F.explode("sections").alias("s"))
    return sections.select("list_id", "page", F.col("s.lines")[0].alias("first"), F.col("s.lines")[1].alias("last"))
