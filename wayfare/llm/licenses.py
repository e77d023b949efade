"""License scans by ordered signature rules, with DataFrame and SQL functions only.

A text becomes its words (ASCII lower case, one space between).  A rule is a hand-written
pattern over words with a keyword that every match contains, a label and a tier (``license_rules``);
rules come in priority order.  Only texts with a stem that some keyword holds are looked at, and
in those only rules whose keyword is present run.  Matches are intervals; one is
suppressed if it lies within another of the same or a stronger tier (of equal
intervals the first rule stays).  Everything is row-wise: no shuffle, no join.

Defined results: a null text is an empty one, with no words, empty labels and score 0;
a place counts once for each phrase that stands there; repeated rows each give
a row; texts of any length are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm import license_rules as table
from wayfare.llm.common import ascii_lower
from wayfare.llm.license_rules import CONFIDENCE, STEMS

#: What separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.6


@dataclass(frozen=True)
class Rule:
    pattern: str
    keyword: str
    label: str
    tier: int


#: An operand after the identifier, or after an operator of the same expression (``MIT OR Apache-2.0``), at most 60 characters on.
_OPERAND = "(?:(?<=spdx license identifier (?:{0}))|(?<=spdx license identifier [a-z0-9 ]{{1,60}} (?:or|and|with) (?:{0})))"


def rules() -> list[Rule]:
    """All rules in priority order: by tier, then as they are written."""
    tags = [Rule(f"(?:{p}){_OPERAND.format(p)}", "spdx license identifier", label, table.TAG) for label, p in table.TAGS]
    others = ((table.TEXT, table.TEXTS), (table.NOTICE, table.NOTICES), (table.VERSIONED, table.VERSIONS), (table.NAME, table.NAMES))
    return tags + [Rule(p, keyword, label, tier) for tier, listed in others for label, keyword, p in listed]


def words_text(text: Column) -> Column:
    """The words of a text with a space around each; no words: the empty string."""
    text = F.coalesce(text, F.lit(""))
    # where every character is one byte, lower case is that of A-Z alone
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    spaced = F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")
    return F.when(spaced == " ", F.lit("")).otherwise(spaced)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _pattern(words: str) -> str:
    return f"(?<= )(?:{words})(?= )"


def _base(spaced: Column, n_words: Column) -> dict[str, Column]:
    """Places of the base phrases: how many, the first and last word, the labels."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        here = F.contains(spaced, F.lit(f" {phrase} "))
        pieces = F.split(spaced, _pattern(phrase), -1)
        counts.append(F.when(here, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(here, _spaces(F.element_at(pieces, 1)) - 1))
        lasts.append(F.when(here, n_words - len(phrase.split()) - (_spaces(F.element_at(pieces, -1)) - 1)))
        labels.append(F.when(here, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return {
        "n_base": total.cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_list": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


_MATCHES = "array<struct<first:int,last:int,tier:int,rule:int,label:string>>"
#: A fold that appends copies its array each time, so long arrays are folded in pieces of this size.
_PIECE = 256


def _fold_in_pieces(values: Column, start: Column, advance, inner) -> Column:
    """A running state over ``values`` in time near-linear in their number.

    ``advance(state, piece)`` gives the state after a piece; ``inner(state, piece)``
    what a piece contributes, given the state before it.
    """
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_PIECE)).cast("int")), lambda j: F.slice(values, j * _PIECE + 1, F.lit(_PIECE))
    )
    before = F.aggregate(
        pieces,
        F.struct(start.alias("state"), F.array_remove(F.array(start), start).alias("out")),
        lambda s, piece: F.struct(advance(s["state"], piece).alias("state"), F.concat(s["out"], F.array(s["state"])).alias("out")),
    )["out"]
    return F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), before.alias("state")), lambda z: inner(z["state"], z["piece"])))


def _hits(spaced: Column, rules: list[Rule]) -> Column:
    """Of every rule whose keyword is there: its number, what it matched and what stands between.  Patterns are literals, so each is compiled once."""
    each = []
    for number, rule in enumerate(rules):
        pattern = F.lit(_pattern(rule.pattern))
        found = F.regexp_extract_all(spaced, pattern, F.lit(0))
        hit = F.struct(F.lit(number).alias("rule"), F.lit(rule.tier).alias("tier"), F.lit(rule.label).alias("label"), found.alias("found"), F.split(spaced, pattern, -1).alias("pieces"))
        each.append(F.when(F.contains(spaced, F.lit(rule.keyword)), hit))
    return F.array_compact(F.array(*each))


def _intervals(hit: Column) -> Column:
    """Matches of one rule as (first word, -last word, tier, rule, label)."""
    found, pieces = hit["found"], hit["pieces"]
    # one space stands before each word, so spaces count words
    pairs = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(found)), _spaces).alias("gap"), F.transform(found, _spaces).alias("size"))

    def inner(state: Column, piece: Column) -> Column:
        return F.aggregate(
            piece,
            F.struct(state.alias("at"), F.array().cast(_MATCHES).alias("out")),
            lambda s, p: F.struct(
                (s["at"] + p["gap"] + p["size"]).alias("at"),
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            (s["at"] + p["gap"] - 1).alias("first"),
                            (-(s["at"] + p["gap"] + p["size"] - 1)).alias("last"),
                            hit["tier"].alias("tier"),
                            hit["rule"].alias("rule"),
                            hit["label"].alias("label"),
                        )
                    ),
                ).alias("out"),
            ),
        )["out"]

    total = lambda state, piece: F.aggregate(piece, state, lambda at, p: at + p["gap"] + p["size"])
    return F.when(F.size(found) > 0, _fold_in_pieces(pairs, F.lit(0), total, inner)).otherwise(F.array().cast(_MATCHES))


def _surviving(sorted_matches: Column) -> Column:
    """One sweep over matches by (first, -last, tier, rule): a match within an
    earlier one of its tier or a stronger one goes.  The state is the farthest end
    seen by each tier."""

    def reach(ends: Column, m: Column) -> Column:
        return F.transform(ends, lambda e, i: F.when(i == m["tier"], F.greatest(e, -m["last"])).otherwise(e))

    def inner(state: Column, piece: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            covered = F.array_max(F.slice(s["ends"], F.lit(1), m["tier"] + 1)) >= -m["last"]
            return F.struct(reach(s["ends"], m).alias("ends"), F.when(covered, s["kept"]).otherwise(F.concat(s["kept"], F.array(m))).alias("kept"))

        return F.aggregate(piece, F.struct(state.alias("ends"), F.array().cast(_MATCHES).alias("kept")), step)["kept"]

    start = F.array(*[F.lit(-1)] * len(CONFIDENCE))
    return _fold_in_pieces(sorted_matches, start, lambda ends, piece: F.aggregate(piece, ends, reach), inner)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    ``spans`` are the surviving matches: first word, number of words, label, tier.
    """
    spaced = F.col("spaced")
    rows = docs.select("doc_id", words_text(F.col("text")).alias("spaced"))
    rows = rows.withColumn("n_words", F.greatest(_spaces(spaced) - 1, F.lit(0)).cast("long"))
    rows = rows.withColumns(_base(spaced, F.col("n_words")))
    none = F.array().cast(_MATCHES)
    gate = F.contains(spaced, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        gate = gate | F.contains(spaced, F.lit(stem))
    matches = F.flatten(F.transform(_hits(spaced, rules()), _intervals))
    rows = rows.withColumn("matches", F.when(gate, F.array_sort(matches)).otherwise(none))
    rows = rows.withColumn("kept", F.when(F.size("matches") > 0, _surviving(F.col("matches"))).otherwise(none))
    worth = F.array_max(F.transform("kept", lambda m: F.element_at(F.lit(list(CONFIDENCE)), m["tier"] + 1)))
    spans = F.transform(
        "kept",
        lambda m: F.struct(m["first"].alias("first_word"), (-m["last"] - m["first"] + 1).alias("words"), m["label"].alias("label"), m["tier"].alias("tier")),
    )
    all_labels = F.array_sort(F.array_distinct(F.concat("base_list", F.transform("kept", lambda m: m["label"]))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.coalesce(F.greatest(worth, F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE))), F.lit(0.0)).alias("score"),
        spans.alias("spans"),
    )
