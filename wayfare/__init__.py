"""Finding what to read in linked document collections, on Spark."""

from wayfare.functions.text import from_root, relative_to_root
from wayfare.operators.asking import Asking, asking_judge, http_sender, lexical_answerer, remote_answerer
from wayfare.operators.judging import DEFAULT_MODE, MODES, WORDINGS, Judge, Mode, ShareRule, custom_mode, keyword_judge, table_judge
from wayfare.operators.parse import parse_pages, previews, resolve_links
from wayfare.operators.readlist import ReadingList, earns_a_place, rank_sections, reading_list, split_results
from wayfare.operators.request import LinkContext, Packer
from wayfare.operators.walk import REASONS, WalkConfig, closure, grouped_walk, round_walk
from wayfare.plans.render import render, replay_page
from wayfare.plans.run import Options, run_query
from wayfare.sources.ignore import IgnoreRules
from wayfare.sources.pages import list_pages, load_corpus, read_pages, revision
from wayfare.sources.records import read_gold, read_gold_lenient, read_ledger, read_runs, read_trace, write_trace
from wayfare.sources.store import JudgmentStore
from wayfare.streaming.trace import best_paths, streaming_counts, trace_summary

__all__ = [
    "DEFAULT_MODE", "MODES", "REASONS", "WORDINGS", "Asking", "IgnoreRules", "Judge", "JudgmentStore", "LinkContext", "Mode", "Options", "Packer", "ReadingList", "ShareRule", "WalkConfig",
    "asking_judge", "best_paths", "closure", "custom_mode", "earns_a_place", "from_root", "grouped_walk", "http_sender", "keyword_judge", "lexical_answerer", "list_pages", "load_corpus", "parse_pages", "previews", "rank_sections",
    "read_gold", "read_gold_lenient", "read_ledger", "read_pages", "read_runs", "read_trace", "reading_list", "relative_to_root", "remote_answerer", "render", "replay_page", "resolve_links", "revision",
    "round_walk", "run_query", "split_results", "streaming_counts", "table_judge", "trace_summary", "write_trace",
]
