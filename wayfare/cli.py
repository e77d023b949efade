"""Command line: ``python -m wayfare.cli QUERY ENTRY... --root DIR``, ``play TRACE``, ``score-file``, ``graph``.

Exit codes: 0 some result was reached by a link, 1 none was, 2 an error.
"""

from __future__ import annotations

import argparse
import os
import sys

from wayfare.operators.judging import DEFAULT_MODE, MODES, WORDINGS, ShareRule
from wayfare.operators.request import LinkContext
from wayfare.operators.walk import CHOICE_BEAM, WalkConfig
from wayfare.plans import render
from wayfare.sources.ignore import IgnoreError, IgnoreRules

FANOUT = 8


def threshold(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must be between 0 and 1")
    return value


def _judging(p: argparse.ArgumentParser) -> None:
    """What a page is asked, of ``run`` and ``score-file``."""
    p.add_argument("--root", default=".")
    p.add_argument("--mode", default=DEFAULT_MODE, choices=sorted(MODES))
    p.add_argument("--criteria", help="file whose text becomes the criterion")
    p.add_argument("--wording", choices=sorted(WORDINGS))
    p.add_argument("--scorer", choices=("noul", "choice"), default="noul", help="links judged one by one, or against each other")
    p.add_argument("--previews", action="store_true", help="with choice: show options' targets")
    p.add_argument("--no-preview-headings", action="store_true")
    p.add_argument("--no-preview-leads", action="store_true")
    p.add_argument("--one-hop-links", action="store_true", help="ask about the page behind a link only, not about those it links to")
    p.add_argument("--share-floor", type=threshold, default=ShareRule.least)
    p.add_argument("--share-k", type=int, default=ShareRule.times_even)
    p.add_argument("--no-cache", action="store_true", help="neither read nor keep judged answers")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wayfare")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="walk from entry pages and print a reading list")
    run.add_argument("query")
    run.add_argument("entries", nargs="+")
    _judging(run)
    run.add_argument("--max-files", type=int, default=25)
    run.add_argument("--max-depth", type=int, default=6)
    run.add_argument("--threshold", type=threshold, default=0.6)
    run.add_argument("--beam", type=int)
    run.add_argument("--ignore", help="file of gitignore rules")
    run.add_argument("--trace", help="file for the walk's events, written as they happen")
    run.add_argument("--format", choices=("json", "md", "tree"), default="json")
    play = sub.add_parser("play", help="a trace as one HTML page")
    play.add_argument("trace")
    play.add_argument("--out")
    score = sub.add_parser("score-file", help="sections and links of one page with their scores")
    score.add_argument("query")
    score.add_argument("file")
    _judging(score)
    graph = sub.add_parser("graph", help="link-graph statistics")
    graph.add_argument("root")
    graph.add_argument("--entry", action="append", help="page that depths are counted from (default: index.md, else README.md)")
    graph.add_argument("--format", choices=("json", "md"), default="md")
    return p


def _asked(args, spark) -> dict:
    """The options that say what is asked, from the flags."""
    from wayfare.sources.store import location

    criterion = None
    if args.criteria:
        with open(args.criteria, encoding="utf-8") as f:
            criterion = f.read()
    choice = args.scorer == "choice"
    context = LinkContext(previews=args.previews or not choice, headings=not args.no_preview_headings, leads=not args.no_preview_leads, two_hop=not args.one_hop_links)
    return {
        "root": args.root,
        "mode": args.mode,
        "criterion": criterion,
        "wording": args.wording,
        "context": context,
        "keep": ShareRule(args.share_floor, args.share_k) if choice else None,
        "store": None if args.no_cache else os.path.join(location(os.environ), "judgments"),
    }


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("wayfare").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return {"run": _run, "play": _play, "score-file": _score_file, "graph": _graph}[args.command](args)
    except (ValueError, RuntimeError, OSError, LookupError, IgnoreError) as e:
        print(f"wayfare: {e}", file=sys.stderr)
        return 2


def _run(args) -> int:
    from wayfare.plans.run import Options, run_query
    from wayfare.sources.pages import load_corpus
    from wayfare.sources.records import TraceFile

    choice = args.scorer == "choice"
    beam = args.beam if args.beam is not None else CHOICE_BEAM if choice else None
    walk = WalkConfig(args.max_files, args.max_depth, FANOUT, None if choice else args.threshold, beam)
    rules = IgnoreRules.load(args.ignore) if args.ignore else IgnoreRules.none()
    spark = _session()
    options = Options(args.query, tuple(args.entries), threshold=args.threshold, walk=walk, ignore=rules, **_asked(args, spark))
    options.asked_mode()  # a bad criterion is an error before anything is read
    listen = TraceFile(args.trace, lambda m: print(f"wayfare: {m}", file=sys.stderr)) if args.trace else None
    found = run_query(spark, load_corpus(spark, args.root), options, listen=listen)
    sys.stdout.write(render.render(found, args.format))
    return found.exit_code


def _play(args) -> int:
    from wayfare.sources.records import read_trace
    from wayfare.streaming.trace import trace_summary

    events = read_trace(_session(), args.trace)
    summary = trace_summary(events).first().asDict()
    page = render.replay_page([{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in events.orderBy("line").toLocalIterator()], summary)
    if args.out == "-":
        sys.stdout.write(page)
    else:
        with open(args.out or args.trace.rsplit(".", 1)[0] + ".html", "w", encoding="utf-8") as f:
            f.write(page)
    return 0


def _score_file(args) -> int:
    from wayfare.functions.text import relative_to_root
    from wayfare.operators.asking import Asking, asking_judge
    from wayfare.operators.parse import parse_pages
    from wayfare.plans.run import Options
    from wayfare.sources.pages import load_corpus
    from wayfare.sources.store import JudgmentStore

    spark = _session()
    options = Options(args.query, (), **_asked(args, spark))
    pages = load_corpus(spark, args.root)
    queries = spark.createDataFrame([("q", args.query)], "query_id string, query string")
    asked = spark.createDataFrame([("q", relative_to_root(args.root, args.file))], "query_id string, path string")
    asking = Asking(options.asked_mode(), options.context, options.keep)
    row = asking_judge(parse_pages(pages), pages, queries, asking, JudgmentStore(spark, options.store))(asked).first()
    if row is None or row["error"] is not None:
        raise ValueError(f"no page {args.file}" if row is None else f"{args.file}: {row['error']}")
    sections = sorted(row["sections"], key=lambda s: (-s["score"], s["first"]))
    links = sorted(row["links"], key=lambda x: (x["scent"] is None, -(x["scent"] or 0.0), x["target"]))
    print(f"relevance {render.two(row['relevance'])}\n")
    print(render.markdown_table(["score", "lines", "section"], [[render.two(s["score"]), f"{s['first']}-{s['last']}", s["heading"] or "(preamble)"] for s in sections]))
    print(render.markdown_table(["scent", "target"], [["-" if x["scent"] is None else render.two(x["scent"]), x["target"]] for x in links]))
    return 0


def _graph(args) -> int:
    import json

    from wayfare.operators.graph import statistics
    from wayfare.operators.parse import parse_pages
    from wayfare.sources.pages import load_corpus

    pages = load_corpus(_session(), args.root)
    found = statistics(parse_pages(pages), pages, args.entry)
    print(json.dumps(found, indent=2, ensure_ascii=False) if args.format == "json" else render.graph_table(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
