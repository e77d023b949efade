"""The reading list: which visited pages earn a place, and how they are ordered."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import from_root
from wayfare.operators.walk import Outcome, Visit


def earns_a_place(threshold: float, relevance: Column | str = "relevance", sections: Column | str = "sections") -> Column:
    """The page or one of its sections reaches the threshold."""
    relevance = F.col(relevance) if isinstance(relevance, str) else relevance
    return (relevance >= threshold) | F.coalesce(F.exists(sections, lambda s: s["score"] >= threshold), F.lit(False))


def rank_sections(sections: Column | str, threshold: float) -> Column:
    """Sections at the threshold or above, strongest first, then by line."""
    good = F.filter(sections, lambda s: s["score"] >= threshold)
    return F.array_sort(
        good,
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0),
    )


def split_results(visited: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(results with ranked sections, pages walked through)."""
    earns = earns_a_place(threshold)
    return visited.where(earns).withColumn("sections", rank_sections("sections", threshold)), visited.where(~earns)


@dataclass
class ReadingList:
    query: str
    mode: str
    scorer: str
    visited: int
    calls: int
    results: list[dict]
    walked: list[dict]

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def exit_code(self) -> int:
        """0 if some result was reached by a link, else 1."""
        return 0 if any(r["via"] for r in self.results) else 1


def _file(visit: Visit, root: str, threshold: float | None) -> dict:
    spell = lambda p: from_root(root, p)
    sections = visit.sections if threshold is None else sorted((s for s in visit.sections if s["score"] >= threshold), key=lambda s: (-s["score"], s["first"]))
    return {
        "path": spell(visit.path),
        "relevance": visit.relevance,
        "scent": visit.scent,
        "path_score": visit.path_score,
        "depth": visit.depth,
        "via": [spell(p) for p in visit.via],
        "sections": [{"heading": s["heading"], "lines": [s["first"], s["last"]], "score": s["score"]} for s in sections],
        "links": [{"target": spell(x.target), "scent": x.scent, "keep": x.keep, "in_root": x.in_root, "followed": x.followed, "reason": x.reason} for x in visit.links],
    }


def reading_list(state: Outcome, query: str, mode: str, scorer: str, threshold: float, root: str = "") -> ReadingList:
    """A finished walk as a reading list, paths spelled from ``root``."""
    earns = lambda v: v.relevance >= threshold or any(s["score"] >= threshold for s in v.sections)
    return ReadingList(
        query,
        mode,
        scorer,
        len(state.visits),
        state.calls,
        [_file(v, root, threshold) for v in state.visits if earns(v)],
        [_file(v, root, None) for v in state.visits if not earns(v)],
    )
