"""Views of a reading list (markdown, tree, JSON), of a trace (HTML) and of metric tables."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Decimal

from wayfare.operators.readlist import ReadingList

INDENT = 2


def two(value: float) -> str:
    """Two decimals of the exact binary value, ties to even."""
    return str(Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def count(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def reached(file: dict) -> str:
    """Why a file is listed: its relevance and the links that led to it."""
    head = f"relevance {two(file['relevance'])}"
    if not file["via"]:
        return head + "; entry file"
    scent = "" if file["scent"] is None else f"; scent {two(file['scent'])}"
    return head + scent + "; via " + " -> ".join(f"`{p}`" for p in file["via"])


def to_json(found: ReadingList) -> str:
    return json.dumps(found.as_dict(), indent=2, ensure_ascii=False)


def to_markdown(found: ReadingList) -> str:
    out = [f"# Reading list: {found.query}", "", f"Criterion: {found.mode}; {count(found.visited, 'file')} visited, {count(found.calls, 'call')}"]
    for rank, file in enumerate(found.results, 1):
        out += ["", f"## {rank}. `{file['path']}`", "", reached(file), ""]
        rows = [f"- lines {s['lines'][0]}-{s['lines'][1]}, score {two(s['score'])}, {s['heading'] if s['heading'] is not None else '(preamble)'}" for s in file["sections"]]
        out += rows or ["- nothing above --threshold"]
    return "\n".join(out) + "\n"


def to_tree(found: ReadingList) -> str:
    """The walk's links: each visited file once, under the file whose link reached it."""
    files = {f["path"]: f for f in [*found.results, *found.walked]}

    def parent(file: dict) -> str | None:
        above = files.get(file["via"][-1]) if file["via"] else None
        if above is not None and any(x["followed"] and x["target"] == file["path"] for x in above["links"]):
            return above["path"]
        return None

    def scent(value: float | None) -> str:
        return "scent unknown" if value is None else f"scent {two(value)}"

    out = [f"{found.query} ({found.mode}); {count(found.visited, 'file')} visited, {count(found.calls, 'call')}", ""]
    roots = sorted((f for f in files.values() if parent(f) is None), key=lambda f: f["path"])
    stack = [(f, 0, reached(f) if f["via"] else f"entry file; relevance {two(f['relevance'])}") for f in reversed(roots)]
    while stack:
        file, depth, note = stack.pop()
        if isinstance(file, str):
            out.append(" " * INDENT * depth + f"{file}  {note}")
            continue
        out.append(" " * INDENT * depth + f"{file['path']}  {note}")
        rows = []
        for link in sorted(file["links"], key=lambda x: (x["scent"] is None, -(x["scent"] or 0.0), x["target"])):
            below = files.get(link["target"]) if link["followed"] else None
            if below is not None and parent(below) == file["path"]:
                rows.append((below, depth + 1, f"followed; {scent(link['scent'])}; relevance {two(below['relevance'])}"))
            else:
                mark = "followed" if link["followed"] else "already reached" if link["reason"] == "already-reached" else "pruned"
                rows.append((link["target"], depth + 1, f"{mark}; {scent(link['scent'])}"))
        stack += reversed(rows)
    return "\n".join(out) + "\n"


def render(found: ReadingList, view: str) -> str:
    return {"json": to_json, "md": to_markdown, "tree": to_tree}[view](found)


def safe_json(value: object) -> str:
    """JSON that can stand inside a script element."""
    text = json.dumps(value, ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


_PAGE = """<!doctype html>
<meta charset="utf-8">
<title>Walk replay</title>
<style>body{font:14px/1.5 sans-serif;margin:2em;max-width:60em}li.pruned{color:#888}li.result{font-weight:600}progress{width:100%}</style>
<h1 id="query"></h1><p id="summary"></p><progress id="at" value="0"></progress><ol id="events"></ol>
<script type="application/json" id="data">__DATA__</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent);
const started = data.events.find(e => e.event === "started") || {};
document.getElementById("query").textContent = started.query || "Walk replay";
document.getElementById("summary").textContent = Object.entries(data.summary).map(([k, v]) => k + " " + v).join(", ");
const bar = document.getElementById("at"), list = document.getElementById("events");
bar.max = data.events.length;
let i = 0;
const next = () => {
  if (i >= data.events.length) return;
  const e = data.events[i++], li = document.createElement("li");
  li.className = e.event;
  li.textContent = e.event + " " + (e.path || (e.source ? e.source + " -> " + e.target : "")) + (e.reason ? " (" + e.reason + ")" : "");
  list.append(li);
  bar.value = i;
  setTimeout(next, 30);
};
next();
</script>
"""


def replay_page(events: list[dict], summary: dict) -> str:
    """One self-contained page that plays a trace."""
    return _PAGE.replace("__DATA__", safe_json({"events": events, "summary": summary}))


def markdown_table(headers: list[str], rows: list[list[object]]) -> str:
    lines = ["| " + " | ".join(headers) + " |", "| " + " | ".join("---" for _ in headers) + " |"]
    return "\n".join(lines + ["| " + " | ".join(str(c) for c in row) + " |" for row in rows]) + "\n"


def graph_table(found: dict) -> str:
    """The statistics of a link graph as a markdown table, a row a figure."""
    rows: list[list[object]] = []

    def add(name: str, value: object) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                add(f"{name}, {k}" if name else k, v)
        else:
            shown = ", ".join(value) or "-" if isinstance(value, list) else f"{value:.1f}" if isinstance(value, float) else value
            rows.append([name.replace("_", " "), "-" if shown is None else shown])

    add("", found)
    return markdown_table(["figure", "value"], rows)


def signed_percent(now: float, base: float) -> str:
    """Change against a base; a dash where the base is 0."""
    return "—" if base == 0 else f"{(now - base) / base * 100:+.0f}%"


def ratio(now: float, base: float) -> str:
    return "—" if base == 0 else f"{now / base:.1f}×"


def cell(mean: float | None, sd: float | None, n: int) -> str:
    """``mean ± sd (n=…)``; six decimals for values below 0.01."""
    if mean is None or not n:
        return "—"
    digits = 6 if 0 < abs(mean) < 0.01 else 2
    spread = "" if sd is None else f" ± {sd:.{digits}f}"
    return f"{mean:.{digits}f}{spread} (n={n})"
