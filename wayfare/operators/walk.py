"""The budgeted best-first walk over a link graph, for one query or for many at once.

A route's score is the product of the scents along it.  The walk always takes
the strongest route that is left (the smaller page on ties), judges its page, and offers
the page's links.  Scents above 1 or below 0 are never admitted,
so a page is closed by its best route, as in Dijkstra's search.

``explore`` is one walk as a generator: it yields the pages to judge and is sent their judgments.
``grouped_walk`` runs one exact walk a query, in parallel over queries, on judgments
that stay tables: entries are settled by joins, and only what follows is walked.  ``round_walk`` asks for judgments only of pages that are reached,
one distributed call a round for all queries together.  ``closure`` is the
relational form for walks without budget, beam or depth limit.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from itertools import count
from math import isnan

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions.text import components
from wayfare.plans.tables import Scratch

# Reasons a link was not followed.
BELOW_THRESHOLD, NOT_KEPT, UNJUDGED, OUT_OF_ROOT, PAST_DEPTH = "below-threshold", "not-kept", "unjudged", "out-of-root", "past-depth"
ALREADY_REACHED, ALREADY_QUEUED, IGNORED, BEAM, MAX_FILES = "already-reached", "already-queued", "ignored", "beam", "max-files"
REASONS = (BELOW_THRESHOLD, NOT_KEPT, UNJUDGED, OUT_OF_ROOT, PAST_DEPTH, ALREADY_REACHED, ALREADY_QUEUED, IGNORED, BEAM, MAX_FILES)

CHOICE_BEAM = 8  # of a walk whose links are judged against each other


@dataclass(frozen=True)
class WalkConfig:
    """``threshold`` None admits by the judge's own keep verdict.  ``max_files`` None: no budget; ``beam`` None: no beam."""

    max_files: int | None = 25
    max_depth: int | None = 6
    fanout: int = 8
    threshold: float | None = 0.6
    beam: int | None = None


@dataclass
class Link:
    target: str
    scent: float | None = None
    keep: bool = True
    in_root: bool = True
    followed: bool = False
    reason: str | None = None


@dataclass
class Page:
    """A judged page: its own relevance, sections with scores, and links in document order.

    ``error``: it could not be judged.  ``posts``: how many requests that took (none where it could not be read).
    """

    relevance: float = 0.0
    sections: list[dict] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    error: str | None = None
    posts: int = 1
    cached: bool = False
    latency_ms: int | None = None
    input_tokens: int = 0


@dataclass(frozen=True)
class Route:
    """A way to a page: ``via`` are the pages before it."""

    path: str
    score: float = 1.0
    depth: int = 0
    scent: float | None = None
    via: tuple[str, ...] = ()

    def rank(self) -> tuple:
        """Strongest first, then the smaller path."""
        return (-self.score, components(self.path))

    def on(self, link: Link) -> Route:
        return Route(link.target, self.score * link.scent, self.depth + 1, link.scent, (*self.via, self.path))


@dataclass
class Visit:
    path: str
    relevance: float
    scent: float | None
    path_score: float
    depth: int
    via: tuple[str, ...]
    sections: list[dict]
    links: list[Link]


@dataclass
class Outcome:
    """A finished walk: visits by relevance, failures by path, answers bought and what they took, and what happened in order
    (``listen`` hears it as it happens)."""

    visits: list[Visit] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)
    calls: int = 0
    events: list[dict] = field(default_factory=list)
    spent: Counter = field(default_factory=Counter)
    listen: Callable[[dict], None] | None = None

    def note(self, event: str, **fields) -> None:
        self.events.append({"event": event, "t_ms": len(self.events), **fields})
        if self.listen is not None:
            self.listen(self.events[-1])

    def pay(self, page: Page) -> None:
        """Add up what an answer took, and what it cost if it was not stored."""
        self.calls += not page.cached
        sums = {"served": 1, "bought": not page.cached, "requests": page.posts, "input_tokens": page.input_tokens, "latency_ms": page.latency_ms or 0}
        self.spent.update(sums | {"bought_tokens": 0 if page.cached else page.input_tokens})

    def pruned(self, source: str, target: str, scent: float | None, reason: str) -> None:
        self.note("pruned", source=source, target=target, scent=scent, reason=reason)

    def trace(self, query: str, mode: str, threshold: float) -> list[dict]:
        """All events with a start and a result a visited page; ``t_ms`` counts events."""
        out = [{"event": "started", "query": query, "mode": mode, "threshold": threshold}, *self.events]
        for v in self.visits:
            earned = v.relevance >= threshold or any(s["score"] >= threshold for s in v.sections)
            out.append({"event": "result", "path": v.path, "relevance": v.relevance, "earned_a_place": earned})
        return [{**e, "t_ms": i} for i, e in enumerate(out)]


def admits(scent: float, keep: bool, threshold: float | None) -> bool:
    """Admission; a scent outside 0 to 1 (or not a number) never passes."""
    if isnan(scent) or not 0.0 <= scent <= 1.0:
        return False
    return keep if threshold is None else scent >= threshold


def unique_links(links: list[Link]) -> list[Link]:
    """One link a target, the first in the page."""
    seen: dict[str, Link] = {}
    for link in links:
        seen.setdefault(link.target, link)
    return list(seen.values())


@dataclass
class _State:
    """What a walk knows of one page: its best route so far, a judgment not used yet, and whether it is closed."""

    route: Route | None = None
    page: Page | None = None
    closed: bool = False


class _Short(Exception):
    """The walk comes to routes that its table was not given."""


class _Table:
    """The states of a walk's pages, and a queue of routes over them.

    A route in the queue counts while its page is open and has no better one; others are skipped when they come up.
    """

    def __init__(self, config: WalkConfig):
        self.config = config
        self.states: defaultdict[str, _State] = defaultdict(_State)
        self._queue: list[tuple[tuple, int, Route]] = []
        self._serial = count()
        self.turns: Counter[int] = Counter()  # pages closed at each depth
        self.spent = 0
        self.rest: tuple | None = None  # rank of the first route, of depth 1, that was left out

    def room(self) -> float:
        return float("inf") if self.config.max_files is None else self.config.max_files - self.spent

    def put(self, route: Route) -> None:
        heapq.heappush(self._queue, (route.rank(), next(self._serial), route))

    def head(self) -> Route | None:
        """The strongest route that counts."""
        while self._queue:
            route = self._queue[0][2]
            state = self.states[route.path]
            if not state.closed and state.route.score <= route.score:
                return route
            heapq.heappop(self._queue)
        return None

    def pick(self, out: Outcome) -> list[Route]:
        """The next round: as many routes as the fanout and the budget allow.  A depth whose beam is full gives none, for good."""
        picked: list[Route] = []
        turns = Counter(self.turns)
        while len(picked) < min(self.config.fanout, self.room()):
            route = self.head()
            if self.rest is not None and (route is None or route.rank() >= self.rest):
                if self.config.beam is None or turns[1] < self.config.beam:
                    raise _Short
                self.rest = None  # the beam drops them all
                continue
            if route is None:
                break
            heapq.heappop(self._queue)
            if self.config.beam is not None and turns[route.depth] >= self.config.beam:
                out.pruned(route.via[-1], route.path, route.scent, BEAM)
                continue
            turns[route.depth] += 1
            picked.append(route)
            out.note("popped", path=route.path, path_score=route.score, depth=route.depth, via=list(route.via))
        return picked

    def refuse(self, route: Route, link: Link) -> str | None:
        """Why a link of the page at ``route`` is passed over; None once its target is queued."""
        if not link.in_root:
            return OUT_OF_ROOT
        if link.scent is None:
            return UNJUDGED
        if not admits(link.scent, link.keep, self.config.threshold):
            return NOT_KEPT if self.config.threshold is None else BELOW_THRESHOLD
        if self.config.max_depth is not None and route.depth >= self.config.max_depth:
            return PAST_DEPTH
        state, found = self.states[link.target], route.on(link)
        if state.closed:
            return ALREADY_REACHED
        if state.route is not None and state.route.score >= found.score:
            return ALREADY_QUEUED
        state.route = found
        self.put(found)
        return None

    def close(self, path: str, out: Outcome) -> None:
        """Use a page's judgment, on its best route (a better one than that it was picked for may have come up)."""
        state = self.states[path]
        route, page = state.route, state.page
        state.closed, state.page = True, None
        self.turns[route.depth] += route.depth > 0
        if page.error is not None:
            out.failed.append((path, page.error))
            return
        self.spent += route.depth > 0
        for target in page.ignored:
            out.pruned(path, target, None, IGNORED)
        links = [Link(x.target, x.scent, x.keep, x.in_root) for x in unique_links(page.links)]
        for link in links:
            link.reason = self.refuse(route, link)
            link.followed = link.reason is None
            if link.followed:
                out.note("admitted", source=path, target=link.target, scent=link.scent)
            else:
                out.pruned(path, link.target, link.scent, link.reason)
        out.visits.append(Visit(path, page.relevance, route.scent, route.score, route.depth, route.via, page.sections, links))

    def finish(self, out: Outcome) -> None:
        """Report what the budget cut off and what was judged in vain."""
        left = sorted((r for _, _, r in self._queue if not self.states[r.path].closed and self.states[r.path].route is r), key=lambda r: components(r.path))
        for route in left:
            out.pruned(route.via[-1], route.path, route.scent, MAX_FILES)
        out.failed += [(p, s.page.error) for p, s in self.states.items() if s.page is not None and s.page.error is not None]
        out.visits.sort(key=lambda v: (-v.relevance, components(v.path)))
        out.failed.sort(key=lambda f: components(f[0]))


def explore(
    entries: list[str], config: WalkConfig, ignored: Callable[[str], bool] = lambda _: False, listen: Callable[[dict], None] | None = None
) -> Generator[list[str], dict[str, Page], Outcome]:
    """One walk.  Yields the paths to judge, is sent their pages, and returns the outcome."""
    out, table = Outcome(listen=listen), _Table(config)
    starts = sorted(dict.fromkeys(e for e in entries if not ignored(e)), key=components)
    for path in starts:  # closed at once, so that no link to an entry is followed
        table.states[path] = _State(Route(path), closed=True)
        out.note("popped", path=path, path_score=1.0, depth=0, via=[])

    size = max(config.fanout, 1)
    for begin in range(0, len(starts), size):
        yield from _judge(table, starts[begin : begin + size], out)
        for path in starts[begin : begin + size]:
            table.close(path, out)
    return (yield from _follow(table, out))


def _judge(table: _Table, paths: list[str], out: Outcome) -> Generator[list[str], dict[str, Page], None]:
    ask = [p for p in paths if table.states[p].page is None]
    got = (yield ask) if ask else {}
    for path in ask:
        page = table.states[path].page = got.get(path) or Page(error="not judged", posts=0)
        for post in range(page.posts):
            out.note("requested", path=path, post_index=post)
        if page.error is None:
            out.pay(page)
            latency = {} if page.latency_ms is None else {"latency_ms": page.latency_ms}
            out.note("answered", path=path, relevance=page.relevance, cached=page.cached, sections=page.sections, **latency)


def _follow(table: _Table, out: Outcome) -> Generator[list[str], dict[str, Page], Outcome]:
    """The walk over what is queued."""
    while picked := table.pick(out):
        yield from _judge(table, [r.path for r in picked], out)
        for route in picked:
            ahead = table.head()
            if ahead is not None and ahead.rank() < route.rank():
                table.put(route)  # what this round's answers brought up goes first; the judgment waits
            else:
                table.close(route.path, out)
    table.finish(out)
    return out


def walk(entries: list[str], pages: Callable[[list[str]], dict[str, Page]], config: WalkConfig, ignored: Callable[[str], bool] = lambda _: False) -> Outcome:
    """A whole walk; ``pages`` judges a list of paths."""
    steps = explore(entries, config, ignored)
    answers = None
    while True:
        try:
            answers = pages(steps.send(answers))
        except StopIteration as end:
            return end.value


# ---- distributed forms ---------------------------------------------------------

_OUT = f"{schema.VISITED}, calls long"
_STEP = f"{_OUT}, wanted boolean"
_VISIT_COLUMNS = ["query_id", "path", "relevance", "scent", "path_score", "depth", "via", "sections", "links", "calls"]
_LINKS = "array<struct<target:string,scent:double,keep:boolean,in_root:boolean>>"


def _page(row: dict) -> Page:
    """A judgment row; ``error, requests, bought, latency_ms, ignored`` where the judge gives them."""
    if row.get("error") is not None:
        return Page(error=row["error"], posts=row.get("requests") or 0)
    links = []
    for x in row["links"] if row["links"] is not None else []:
        scent = None if x["scent"] is None or pd.isna(x["scent"]) else float(x["scent"])
        links.append(Link(x["target"], scent, x.get("keep") is None or bool(x["keep"]), x.get("in_root") is None or bool(x["in_root"])))
    sections = [dict(s) for s in (row["sections"] if row.get("sections") is not None else [])]
    posts = row.get("requests")
    return Page(
        float(row["relevance"]), sections, links, list(row.get("ignored") or []), posts=1 if posts is None else int(posts), cached=row.get("bought") is False, latency_ms=row.get("latency_ms"),
        input_tokens=int(row.get("input_tokens") or 0),
    )


def _visits(query_id, found: Outcome) -> list[tuple]:
    return [
        (query_id, v.path, v.relevance, v.scent, v.path_score, v.depth, list(v.via), v.sections, [vars(x) for x in v.links], found.calls)
        for v in found.visits
    ]


Judge = Callable[[DataFrame], DataFrame]


def grouped_walk(judgments: DataFrame | Judge, entries: DataFrame, config: WalkConfig) -> DataFrame:
    """One exact walk a query.

    ``judgments``: ``query_id, path, relevance, sections, links`` with links of
    ``target, scent, keep, in_root``; or a function that adds the last three to those rows of a table of
    ``query_id, path`` (and other columns) that have a judgment.  ``entries``: ``query_id, path``.

    Entries are all closed before a link is followed, in the order of their paths, so what becomes of their links
    are joins and one running maximum a target; their pages never meet in one task.  From there each query walks in a task of its own over
    its strongest routes.  A page that it lacks ends its try: the pages of all queries are fetched by one join and the
    tries begin again.  A walk without budget and beam visits all that it can reach, so there a
    query's judgments meet in one task.
    """
    if config.max_files is None and config.beam is None and not callable(judgments):
        return _whole_walk(judgments, entries, config)
    judge = judgments if callable(judgments) else lambda asked: judgments.select("query_id", "path", "relevance", "sections", "links").join(asked, ["query_id", "path"]).dropDuplicates(["query_id", "path"])
    scratch = Scratch(entries.sparkSession, "walk")
    starts = entries.select("query_id", "path").where("query_id IS NOT NULL AND path IS NOT NULL").distinct()
    starts = scratch.table(starts.orderBy("query_id", _components("path"), "path").withColumn("place", F.monotonically_increasing_id()), "starts")
    first = scratch.table(_plain(judge(starts)).select("query_id", "path", "place", "relevance", "sections", "links"), "first")
    followed, closed = _entry_links(scratch, starts, first, config)
    steps, calls = _tries(scratch, judge, starts, first, followed, config)
    marks = followed.groupBy("place").agg(F.collect_list("target").alias("to_"))
    marks = marks.withColumn("closed_", F.lit(None).cast("array<string>")) if closed is None else marks.join(closed, "place", "full")

    def fate(x: Column) -> Column:
        refused = NOT_KEPT if config.threshold is None else BELOW_THRESHOLD
        return (
            F.when(~x["in_root"], OUT_OF_ROOT)
            .when(x["scent"].isNull(), UNJUDGED)
            .when(~_admitted(x, config), refused)
            .when(F.lit(config.max_depth is not None and config.max_depth <= 0), PAST_DEPTH)
            .when(F.array_contains("closed_", x["target"]), ALREADY_REACHED)
            .when(F.array_contains("to_", x["target"]), None)
            .otherwise(ALREADY_QUEUED)
        )

    links = F.transform("links", lambda x: F.struct(x["target"].alias("target"), x["scent"].alias("scent"), x["keep"].alias("keep"), x["in_root"].alias("in_root"), fate(x).alias("reason")))
    links = F.transform(links, lambda x: F.struct(x["target"], x["scent"], x["keep"], x["in_root"], x["reason"].isNull().alias("followed"), x["reason"]))
    visits = first.join(marks, "place", "left").select(
        "query_id", "path", "relevance", F.lit(None).cast("double").alias("scent"), F.lit(1.0).alias("path_score"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("via"), "sections", links.alias("links"),
    )
    for step in steps:
        visits = visits.unionByName(step.where("NOT wanted AND path IS NOT NULL").drop("wanted", "calls"))
    return visits.join(calls, "query_id")


def _components(path: str) -> Column:
    """``components`` of a column, to order by."""
    parts = F.filter(F.split(path, "/"), lambda c: ~c.isin("", "."))
    return F.when(F.startswith(F.col(path), F.lit("/")), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def _plain(judged: DataFrame) -> DataFrame:
    """Judgments as ``_page`` reads them: one link a target, no number for a scent that is none."""
    names = judged.schema["links"].dataType.elementType.names
    yes = lambda x, name: F.coalesce(x[name], F.lit(True)) if name in names else F.lit(True)
    number = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    links = F.transform("links", lambda x: F.struct(x["target"].alias("target"), number(x["scent"]).alias("scent"), yes(x, "keep").alias("keep"), yes(x, "in_root").alias("in_root")))
    sections = F.transform("sections", lambda s: F.struct(*[s[n].alias(n) for n in ("heading", "first", "last", "score")])).cast(schema.SECTION_SCORES)
    targets = F.transform("links", lambda x: x["target"])
    once = F.filter("links", lambda x, i: F.coalesce(F.array_position(targets, x["target"]) == i + 1, F.lit(True)))
    none = lambda kind: F.array().cast(kind)
    out = judged.withColumn("links", F.coalesce(links, none(_LINKS))).withColumn("sections", F.coalesce(sections, none(schema.SECTION_SCORES)))
    return out.withColumn("links", F.when(F.size(F.array_distinct(targets)) == F.size("links"), F.col("links")).otherwise(once)).withColumn("relevance", number(F.col("relevance")))


def _admitted(x: Column, config: WalkConfig) -> Column:
    return x["scent"].between(0.0, 1.0) & (x["keep"] if config.threshold is None else x["scent"] >= config.threshold)


def _entry_links(scratch: Scratch, starts: DataFrame, first: DataFrame, config: WalkConfig) -> tuple[DataFrame, DataFrame | None]:
    """The entries' links that are followed (``query_id, target, scent, place``), and by ``place`` the other entries that links lead to, if any do.

    A link is followed if it is stronger than every link to its target before it; of equal ones only the first can be."""
    ready = config.max_depth is None or config.max_depth > 0
    open_ = F.filter("links", lambda x: F.lit(ready) & x["in_root"] & x["target"].isNotNull() & F.coalesce(_admitted(x, config), F.lit(False)))
    offers = first.select("query_id", "place", F.explode(open_).alias("x")).select("query_id", "place", "x.target", "x.scent")
    best = offers.groupBy("query_id", "target", "scent").agg(F.min("place").alias("place"))
    known = starts.select("query_id", F.col("path").alias("target"), F.lit(True).alias("closed"))
    best = scratch.table(best.join(known, ["query_id", "target"], "left"), "offers")
    before = Window.partitionBy("query_id", "target").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    stronger = best.where("closed IS NULL").withColumn("before", F.max("scent").over(before)).where("before IS NULL OR scent > before")
    followed = scratch.table(stronger.select("query_id", "target", "scent", "place"), "followed")
    reached = best.where("closed").select("query_id", "target").distinct()
    closed = None
    if not reached.isEmpty():
        closed = scratch.table(offers.join(reached, ["query_id", "target"], "left_semi").groupBy("place").agg(F.collect_set("target").alias("closed_")), "closed")
    scratch.drop(best)
    return followed, closed


def _tries(scratch: Scratch, judge: Judge, starts: DataFrame, first: DataFrame, followed: DataFrame, config: WalkConfig) -> tuple[list[DataFrame], DataFrame]:
    """The walks from the routes that the entries queued: what each round of tries gave, and the calls of each query.

    A try has the strongest routes of its query, and those to pages that its known pages link to; it ends as ``_Short`` where it comes to others."""
    targets = followed.groupBy("query_id", "target").agg(F.max("scent").alias("scent"), F.max("place").alias("place"))  # the last link followed is the strongest
    queued = targets.join(starts.select("place", F.col("path").alias("source")), "place").withColumnRenamed("target", "path")
    queued = scratch.table(queued.select("query_id", "path", "scent", "source", "place"), "queued")
    order = Window.partitionBy("query_id").orderBy(F.desc("scent"), _components("path"), "place", "path")
    bounds = [x for x in (config.max_files, config.beam) if x is not None]
    size = 2 * min(bounds) + 8 if bounds else 1 << 30
    strongest = lambda: scratch.table(queued.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size + 1), "strongest")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _try(key[0], rows.to_dict("records"), config, size)

    top = strongest()
    asked, known, steps = scratch.table(top.where(F.col("n") <= size).select("query_id", "path"), "asked"), None, []
    while True:
        got = asked.join(_plain(judge(asked)).select("query_id", "path", "relevance", "sections", "links", F.lit(True).alias("found")), ["query_id", "path"], "left")
        got = scratch.table(got, "got")
        to = got.select("query_id", "path", F.explode("links.target").alias("target"))
        closed = to.join(starts.select("query_id", F.col("path").alias("target")), ["query_id", "target"]).groupBy("query_id", "path").agg(F.collect_set("target").alias("closed"))
        got = got.join(closed, ["query_id", "path"], "left")
        before, known = known, scratch.table(got if known is None else known.unionByName(got), "known")
        scratch.drop(before)
        linked = known.select("query_id", F.explode("links.target").alias("path")).distinct()
        more = queued.join(F.broadcast(linked), ["query_id", "path"], "left_semi").join(top.select("query_id", "path"), ["query_id", "path"], "left_anti")
        routes = top.unionByName(more, allowMissingColumns=True)
        rows = routes.unionByName(known, allowMissingColumns=True)
        if steps:
            rows = rows.join(steps[-1].where("wanted").select("query_id").distinct(), "query_id", "left_semi")
        steps.append(scratch.table(rows.groupBy("query_id").applyInPandas(run, _STEP), "tries"))
        wanted = steps[-1].where("wanted")
        kinds = {r.more for r in wanted.select(F.isnull("path").alias("more")).distinct().collect()}
        if not kinds:
            break
        scratch.drop(asked)
        asked = scratch.table(wanted.where("path IS NOT NULL").select("query_id", "path"), "asked")
        if True in kinds:
            size, before = size * 8, top
            top = strongest()
            scratch.drop(before)
    paid = first.groupBy("query_id").agg(F.count("*").alias("calls"))
    for step in steps:
        paid = paid.unionByName(step.where("NOT wanted AND path IS NULL").select("query_id", "calls"))
    calls = scratch.table(paid.groupBy("query_id").agg(F.sum("calls").alias("calls")), "calls")
    scratch.drop(starts, queued, top, known, asked)
    return steps, calls


def _try(query_id, rows: list[dict], config: WalkConfig, size: int) -> pd.DataFrame:
    """One try: the visits and a row of the calls, or the pages that it lacks (no path: routes)."""
    table, out, pages = _Table(config), Outcome(), {}
    for r in rows:
        if r["source"] is None:
            pages[r["path"]] = r
            for target in r["closed"] if r["closed"] is not None else []:
                table.states[target] = _State(Route(target), closed=True)
    routes = sorted((r for r in rows if r["source"] is not None), key=lambda r: (-r["scent"], components(r["path"]), r["place"], r["path"]))
    for r in routes:
        route = Route(r["path"], r["scent"], 1, r["scent"], (r["source"],))
        table.states[route.path] = _State(route)
        table.put(route)
        if r["n"] == size + 1:
            table.rest = route.rank()
    steps, answers = _follow(table, out), None
    lacks: list[str | None] = []
    try:
        while not lacks:
            paths = steps.send(answers)
            answers = {p: _page(pages[p]) if pages[p]["found"] is True else Page(error="no judgment", posts=0) for p in paths if p in pages}
            lacks += [p for p in paths if p not in pages]
    except StopIteration:
        found = [(*v, False) for v in [*_visits(query_id, out), (query_id, *[None] * 8, out.calls)]]
        return pd.DataFrame(found, columns=[*_VISIT_COLUMNS, "wanted"], dtype=object)
    except _Short:
        lacks = [None]
    else:  # and what may be next
        ahead = dict.fromkeys(r.path for _, _, r in heapq.nsmallest(size, table._queue) if not table.states[r.path].closed and r.path not in pages)
        lacks = list(dict.fromkeys([*lacks, *ahead]))
    return pd.DataFrame([(query_id, p, *[None] * 8, True) for p in lacks], columns=[*_VISIT_COLUMNS, "wanted"], dtype=object)


def _whole_walk(judgments: DataFrame, entries: DataFrame, config: WalkConfig) -> DataFrame:
    """Walks over all of a query's judgments, in one task a query."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["path"].notna()]
        at = {path: i for i, path in enumerate(rows["path"])}
        columns = {c: rows[c].to_numpy() for c in ("path", "relevance", "sections", "links")}
        one = lambda i: _page({c: v[i] for c, v in columns.items()})  # noqa: E731  only pages that are reached become objects
        starts = list(rows["entries"].iloc[0])
        found = walk(starts, lambda paths: {p: one(at[p]) if p in at else Page(error="no judgment", posts=0) for p in paths}, config)
        return pd.DataFrame(_visits(key[0], found), columns=_VISIT_COLUMNS)

    starts = entries.groupBy("query_id").agg(F.array_sort(F.collect_set("path")).alias("entries"))
    wanted = judgments.select("query_id", "path", "relevance", "sections", "links").join(starts, "query_id")
    return wanted.groupBy("query_id").applyInPandas(run, _OUT)


def round_walk(
    spark, entries: dict[str, list[str]], judge: Callable[[DataFrame], DataFrame], config: WalkConfig, ignored: Callable[[str], bool] = lambda _: False,
    listen: Callable[[dict], None] | None = None,
) -> dict[str, Outcome]:
    """Walks of many queries in rounds: the driver keeps the queues, and each round's
    paths of all queries are judged by one distributed call.

    ``judge`` turns ``query_id, path`` rows into judgment rows.  What comes back
    a round is at most ``fanout`` pages a query.
    """
    walks = {q: explore(paths, config, ignored, listen) for q, paths in entries.items()}
    done: dict[str, Outcome] = {}

    def step(q: str, answers: dict[str, Page] | None) -> list[str]:
        try:
            return walks[q].send(answers)
        except StopIteration as end:
            done[q] = end.value
            return []

    asked = {q: paths for q in walks if (paths := step(q, None))}
    while asked:
        got: dict[str, dict[str, Page]] = {q: {} for q in asked}
        rows = [(q, path) for q, paths in asked.items() for path in paths]
        for row in judge(spark.createDataFrame(rows, "query_id string, path string")).toLocalIterator():
            r = row.asDict(recursive=True)
            got[r["query_id"]][r["path"]] = _page(r)
        asked = {q: paths for q, pages in got.items() if (paths := step(q, pages))}
    return {q: done[q] for q in entries}


def closure(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``query_id, path, path_score`` of every page some admitted path reaches: the best product of scents.

    ``edges``: ``source, target, scent`` (admitted links), with ``query_id`` where scents differ
    by query.  Edges are written once.  A round joins the rows that improved with them and merges what it finds
    into one table, until nothing improves: links whose scent is
    no probability are not admitted, so no cycle improves a score and the rounds end.  Only for walks
    without budget, beam or binding depth.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    edges = scratch.table(edges.where("scent >= 0 AND scent <= 1"), "edges")
    start = entries.select("query_id", "path", F.lit(1.0).alias("path_score")).distinct()
    best = scratch.table(start.withColumn("improved", F.lit(True)), "best")
    on = F.col("path") == F.col("source")
    steps = edges
    if "query_id" in edges.columns:
        steps = edges.withColumnRenamed("query_id", "of_")
        on = on & (F.col("query_id") == F.col("of_"))
    while not best.where("improved").isEmpty():
        found = best.where("improved").join(steps, on).select("query_id", F.col("target").alias("path"), (F.col("path_score") * F.col("scent")).alias("path_score"))
        both = best.select("query_id", "path", "path_score", F.col("path_score").alias("old")).unionByName(found.withColumn("old", F.lit(None).cast("double")))
        merged = both.groupBy("query_id", "path").agg(F.max("path_score").alias("path_score"), F.max("old").alias("old"))
        improved = F.col("old").isNull() | (F.col("path_score") > F.col("old"))
        before, best = best, scratch.table(merged.select("query_id", "path", "path_score", improved.alias("improved")), "best")
        scratch.drop(before)
    scratch.drop(edges)
    return best.drop("improved")


def disposition(links: DataFrame, threshold: float, max_depth: int) -> DataFrame:
    """The ordered reasons as one column expression, for link rows that carry
    ``in_root, scent, depth`` and whether the target is ``settled`` or ``queued`` already."""
    scent = F.col("scent")
    admitted = ~F.isnan(scent) & (scent >= 0) & (scent <= 1) & (scent >= threshold)
    reason = (
        F.when(~F.col("in_root"), OUT_OF_ROOT)
        .when(scent.isNull(), UNJUDGED)
        .when(~admitted, BELOW_THRESHOLD)
        .when(F.col("depth") + 1 > max_depth, PAST_DEPTH)
        .when(F.col("settled"), ALREADY_REACHED)
        .when(F.col("queued"), ALREADY_QUEUED)
    )
    return links.withColumn("reason", reason)
