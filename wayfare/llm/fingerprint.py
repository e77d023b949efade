"""Canonical exact digests, with DataFrame and SQL functions only.

A text's canonical form is its compatibility normal form, case-folded and
normalised again, with every run of white space one space and none at the ends.
Its digest is 128 bits of xxhash64 (two chained seeds).  Rows are grouped by
digest, and within a group of several rows the canonical bytes themselves are
grouped: should two different forms share a digest, the later ones in byte order
get a suffix, so equal fingerprints always mean equal canonical bytes.

Defined results: a null text is an empty one; equal texts have equal
fingerprints whatever their rows; rows that repeat an id follow each other by
hash of the text; null ids come first; the next row after the last is the first, for
a single row itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wayfare.llm.common import materialize

#: Rows of a range in which neighbours are found by one sort.
ROWS_PER_RANGE = 2_000
MOST_RANGES = 65_536
MOST_NAMED_RANGES = 4_096
#: Most digests sent to every executor (32 characters each).
BROADCAST_ROWS = 1_000_000


def _fold(text: Column) -> Column:
    """Compatibility composition, full case folding, composition again, by the JVM's Unicode library.

    Text in ASCII only needs no tables: lower case is its whole folding.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(again)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null: empty."""
    return F.trim(F.regexp_replace(_fold(F.coalesce(text, F.lit(""))), r"[\s\x{85}\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """128 bits of a canonical form as 32 hexadecimal digits."""
    words = [F.xxhash64(F.lit(salt), form) for salt in ("wayfare-a", "wayfare-b")]
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the digest of a text column; the form is a column of its own first, so it is made once."""
    return rows.withColumn("form_", canonical(F.col(text))).withColumn(name, digest(F.col("form_"))).drop("form_")


def collisions(docs: DataFrame) -> DataFrame:
    """``digest, form, variant`` of canonical forms that share a digest with a smaller one (variant 1 up).

    First rows are counted by digest, then only groups of several rows compare
    bytes.  Equal forms meet in the task that read them (partial aggregation),
    so a group of copies of any size costs one row a task.  Digests of such groups are
    broadcast up to ``BROADCAST_ROWS``; beyond, the same join is shuffled.
    """
    own = docs.select(canonical(F.col("text")).alias("form")).select(digest(F.col("form")).alias("digest"), "form")
    several = materialize(own.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "several")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    forms = own.join(several, "digest", "left_semi").groupBy("digest", "form").agg(F.count("*").alias("n"))
    spread = forms.groupBy("digest").agg(F.count("*").alias("forms")).where("forms > 1").select("digest")
    ranked = forms.join(spread, "digest").withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    return materialize(ranked.where("variant > 0").select("digest", "form", "variant"), "collisions")


def _with_variant(rows: DataFrame, digest_name: str, form: Column, found: DataFrame, name: str) -> DataFrame:
    other = found.select(F.col("digest").alias("d_"), F.col("form").alias("f_"), F.col("variant").alias("v_"))
    # a join takes columns only, as the form is made by a call that Spark holds to be random
    joined = rows.withColumn("own_form_", form).join(other, (F.col(digest_name) == F.col("d_")) & (F.col("own_form_") == F.col("f_")), "left")
    suffix = F.when(F.col("v_").isNotNull(), F.concat(F.lit("-"), F.col("v_").cast("string"))).otherwise(F.lit(""))
    return joined.withColumn(name, F.concat(digest_name, suffix)).drop("own_form_", "d_", "f_", "v_")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form")).withColumn("digest", digest(F.col("form")))
    found = collisions(docs)
    if found.isEmpty():
        return rows.select("doc_id", F.col("digest").alias("fingerprint"))
    return _with_variant(rows, "digest", F.col("form"), found, "fingerprint").select("doc_id", "fingerprint")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, group_id``: the smallest id with the same fingerprint."""
    prints = fingerprints(docs)
    groups = prints.groupBy(F.col("fingerprint").alias("of_")).agg(F.min("doc_id").alias("group_id"))
    return prints.join(groups, F.col("fingerprint") == F.col("of_")).drop("of_")


def _ranges(docs: DataFrame) -> tuple[list, int]:
    """Smallest ids of ranges of about ``ROWS_PER_RANGE`` rows: existing ids, at most ``MOST_RANGES``."""
    n = docs.agg(F.count("doc_id").alias("n")).first()["n"]
    if not n:
        return [], 0
    k = max(1, min(MOST_RANGES, -(-n // ROWS_PER_RANGE)))
    if not isinstance(docs.schema["doc_id"].dataType, NumericType):
        return _ranges_of_names(docs, n, min(k, MOST_NAMED_RANGES)), n
    cuts = [F.lit(i / k) for i in range(1, k)]
    row = docs.agg(
        F.min("doc_id").alias("low"),
        (F.percentile_approx("doc_id", F.array(*cuts), F.lit(max(10_000, 10 * k))) if cuts else F.array(F.min("doc_id"))).alias("cuts"),
    ).first()
    return sorted({row["low"], *row["cuts"]}), n


def _ranges_of_names(docs: DataFrame, n: int, k: int) -> list:
    """Cuts between ids that are no numbers: quantiles of about 20 ids a range, drawn by hash, and the smallest."""
    every = max(1, n // (20 * k))
    ids = docs.select("doc_id").where("doc_id is not null").where(F.pmod(F.xxhash64(F.lit("cuts"), "doc_id"), F.lit(every)) == 0).distinct().orderBy("doc_id").limit(40 * k)
    drawn = [r["doc_id"] for r in ids.collect()]
    low = docs.agg(F.min("doc_id").alias("low")).first()["low"]
    return sorted({low, *(drawn[i * len(drawn) // k] for i in range(k) if drawn)})


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``docs`` with, for each name, the value of ``columns`` in the next row by ascending id, in a circle.

    Rows are dealt into ranges of ids and sorted there.  The first id of every
    range is also dealt, as a look-ahead, into the range before (the very first into
    the last), so no range needs to see another and texts are shuffled once.
    """
    bounds, _ = _ranges(docs)
    tie = F.xxhash64("text")
    if len(bounds) > 1:
        table, size = F.lit(bounds), F.lit(len(bounds))
        # binary search by descending steps, without a join
        steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])

        def step(at: Column, width: Column) -> Column:
            to = at + width
            return F.when((to <= size) & (F.element_at(table, F.least(to, size)) <= F.col("doc_id")), to).otherwise(at)

        found = F.aggregate(steps, F.lit(1), step)
        home = F.coalesce(found, F.lit(1))
        cut = F.coalesce(F.element_at(table, home) == F.col("doc_id"), F.lit(False)) & (home > 1)
    else:
        home, cut = F.lit(1), F.lit(False)
    placed = docs.withColumn("range_", home).withColumn("cut_", cut)
    own = F.struct(F.col("range_").alias("range"), F.lit(0).alias("ahead"))
    before = F.struct((F.col("range_") - 1).alias("range"), F.lit(1).alias("ahead"))
    dealt = placed.withColumn("at_", F.explode(F.when(F.col("cut_"), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(*docs.columns, F.col("at_.range").alias("range_"), F.col("at_.ahead").alias("ahead_"))
    low = F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(bounds[0])) if bounds else F.lit(True)
    first = docs.where(low).orderBy(F.col("doc_id").asc_nulls_first(), tie, F.col("text")).limit(1)
    last = F.lit(max(1, len(bounds)))
    dealt = dealt.unionByName(first.withColumn("range_", last).withColumn("ahead_", F.lit(2)))
    order = Window.partitionBy("range_").orderBy("ahead_", F.col("doc_id").asc_nulls_first(), tie, F.col("text"))
    out = dealt.withColumns({name: F.lead(value).over(order) for name, value in columns.items()})
    return out.where("ahead_ = 0").drop("range_", "ahead_")


def _alike(a: str, b: str, text_a: str, text_b: str) -> Column:
    """1 if two texts of a row have the same canonical form: where their digests agree, the forms themselves are compared."""
    return F.when(F.col(a) == F.col(b), canonical(F.col(text_a)) == canonical(F.col(text_b))).otherwise(F.lit(False)).cast("double")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every text, its edited text and the next text, compared by fingerprint.

    The edited text has its last quarter replaced by the start of the next text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(with_digest(rows, "text", "own"), {"next_text": F.col("text"), "next_own": F.col("own")})
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - tail).cast("int")), F.substring(F.col("next_text"), F.lit(1), tail))
    out = with_digest(near.withColumn("edited", edited), "edited", "edited_own")
    found = collisions(docs)
    if not found.isEmpty():  # two forms share 128 bits: tell them apart by their bytes
        for column, form in (("own", "text"), ("edited_own", "edited"), ("next_own", "next_text")):
            out = _with_variant(out, column, canonical(F.col(form)), found, "v").drop(column).withColumnRenamed("v", column)
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("edited_own").alias("edited_fingerprint"),
        _alike("own", "edited_own", "text", "edited").alias("near_edited"),
        _alike("own", "next_own", "text", "next_text").alias("near_next"),
    )
