"""A markdown scanner: one pass over a page gives headings, links and block texts.

Blocks are read line by line with a stack of containers; the inline content of
a leaf block is then read with the usual rules for code spans, links, images,
emphasis, raw HTML and references.  What is kept is what the reading-list engine needs:
display text, headings with lines, and links with the text around them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from wayfare.functions.text import collapse, split_lines, trim


@dataclass
class Heading:
    level: int
    line: int
    text: str = ""


@dataclass
class RawLink:
    kind: str  # markdown or wikilink
    dest: str
    anchor: str
    sentence: str
    heading: int | None
    line: int
    order: tuple[int, int]


@dataclass
class Scan:
    frontmatter: list[tuple[str, str]] = field(default_factory=list)
    title: str | None = None
    body_line: int = 1  # first line after the frontmatter
    lines: int = 0
    headings: list[Heading] = field(default_factory=list)
    links: list[RawLink] = field(default_factory=list)
    first_paragraph: str | None = None


def split_frontmatter(lines: list[str]) -> tuple[list[tuple[str, str]], str | None, int]:
    """Fields, title and number of lines of a leading ``---`` fence (0: there is none)."""
    if not lines or trim(lines[0].rstrip("\r")) != "---":
        return [], None, 0
    fields: list[tuple[str, str]] = []
    title = None
    for i, line in enumerate(lines[1:], 2):
        text = line.rstrip("\r")
        if trim(text) in ("---", "..."):
            return fields, title, i
        key, colon, value = text.partition(":")
        key, value = trim(key), trim(value)
        if len(value.encode()) >= 2 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        if colon and key and not key.startswith("#"):
            if key == "title" and title is None and value:
                title = value
            fields.append((key, value))
    return [], None, 0


# ---- block texts ---------------------------------------------------------------

_WIKI = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)
_BREAK = re.compile(r"[.!?](?= |$)")


def sentence_around(text: str, offset: int) -> str:
    """From the sentence end before ``offset`` to the next one."""
    begin = 0
    end = len(text)
    for m in _BREAK.finditer(text):
        if m.start() < offset:
            begin = m.end() + 1
        else:
            end = m.end()
            break
    return trim(text[begin:end])


class _Block:
    """Text of one innermost block as it arrives, with the links found in it."""

    def __init__(self, index: int, kind: str):
        self.index, self.kind = index, kind
        self.text = ""
        self._open: list[tuple[str, int]] = []  # linkable pieces not yet scanned for wikilinks, with the lines they begin on
        self.links: list[tuple[str, str, str, int, int | None, int]] = []

    def add(self, text: str, line: int, linkable: bool, heading: int | None) -> None:
        if not linkable:
            self.settle(heading)
            self._append(text)
            return
        self._open.append((text, line))

    def _append(self, text: str) -> None:
        text = collapse(text)
        if text.startswith(" ") and (not self.text or self.text.endswith(" ")):
            text = text[1:]
        self.text += text

    def settle(self, heading: int | None) -> None:
        """Scan what is open for wikilinks and append it; nothing after this joins a link begun before."""
        if not self._open:
            return
        pieces, self._open = self._open, []
        text = "".join(t for t, _ in pieces)
        if "[[" not in text:
            self._append(text)
            return
        begins = list(accumulate((len(t) for t, _ in pieces), initial=0))

        def line_of(offset: int) -> int:
            i = bisect_right(begins, offset) - 1
            return pieces[i][1] + text.count("\n", begins[i], offset)

        at = 0
        for m in _WIKI.finditer(text):
            target, bar, alias = m[1].partition("|")
            target = trim(collapse(target))
            anchor = trim(collapse(alias)) if bar else trim(target.split("#", 1)[0])
            if not target:
                continue
            self._append(text[at : m.start()])
            self.links.append(("wikilink", target, anchor, len(self.text), heading, line_of(m.start())))
            self._append(anchor)
            at = m.end()
        self._append(text[at:])


class _Collector:
    """Turns block and inline events into a ``Scan``."""

    def __init__(self, scan: Scan):
        self.scan = scan
        self._stack: list[_Block] = []
        self._next = 0
        self._heading: int | None = None
        self._verbatim = 0

    def push(self, kind: str) -> None:
        self._stack.append(_Block(self._next, kind))
        self._next += 1

    def _top(self) -> _Block:
        if not self._stack:
            self.push("loose")
        return self._stack[-1]

    def heading(self, level: int, line: int) -> None:
        self.scan.headings.append(Heading(level, line))
        self._heading = len(self.scan.headings) - 1
        self.push("heading")

    def pop(self) -> None:
        block = self._stack.pop()
        block.settle(self._heading)
        text = block.text.rstrip(" ")
        if block.kind == "heading":
            self.scan.headings[self._heading].text = trim(text)
        for kind, dest, anchor, offset, heading, line in block.links:
            sentence = sentence_around(text, min(offset, len(text)))
            self.scan.links.append(RawLink(kind, dest, anchor, sentence, heading, line, (block.index, offset)))
        if block.kind == "paragraph" and text and self.scan.first_paragraph is None:
            self.scan.first_paragraph = text

    def text(self, text: str, line: int, linkable: bool = True) -> None:
        self._top().add(text, line, linkable and not self._verbatim, self._heading)

    def barrier(self) -> None:
        if self._stack:
            self._stack[-1].settle(self._heading)

    def open_link(self) -> int:
        self._top().settle(self._heading)
        self._verbatim += 1
        return len(self._top().text)

    def close_link(self, dest: str, offset: int, line: int) -> None:
        self._verbatim -= 1
        block = self._top()
        block.links.append(("markdown", dest, trim(block.text[offset:]), offset, self._heading, line))

    def image(self, step: int) -> None:
        self._verbatim += step

    def finish(self) -> None:
        while self._stack:
            self.pop()
        self.scan.links.sort(key=lambda x: x.order)


# ---- inline content --------------------------------------------------------------

_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_TAG = re.compile(
    r"<(?:[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][\w-]*\s*|!--.*?--|\?.*?\?|![A-Za-z][^>]*|!\[CDATA\[.*?\]\])>",
    re.DOTALL,
)
_PLAIN = re.compile(r"[^\\`<&*_~\[\]!]+")  # what means nothing in inline content
_RUNS = {c: re.compile(re.escape(c) + "+") for c in "`*_~"}
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TITLE = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"
_OPEN_DESTINATION = re.compile(r"\(\s*")
_ANGLED = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
_CLOSE_DESTINATION = re.compile(rf"(?:\s+{_TITLE})?\s*\)", re.DOTALL)
_REFERENCE_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_REFERENCE = re.compile(rf" {{0,3}}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE})?[ \t]*(?:\n|$)", re.DOTALL)


def _unescape(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def _label(text: str) -> str:
    return collapse(text.strip()).casefold()


@dataclass
class _Node:
    kind: str  # text, code, html, open, close, delimiter
    text: str
    at: int
    image: bool = False
    dest: str = ""
    live: bool = True
    opens: bool = False
    closes: bool = False


def _inline_destination(text: str, at: int) -> tuple[str, int] | None:
    """Destination and end of ``(dest "title")`` that starts at ``at``."""
    m = _OPEN_DESTINATION.match(text, at)
    if not m:
        return None
    at = m.end()
    if text.startswith("<", at):
        m = _ANGLED.match(text, at)
        if not m:
            return None
        dest, at = m[1], m.end()
    else:
        begin, depth = at, 0
        while at < len(text) and text[at] > " " and text[at] != "\x7f":
            if text[at] == "\\" and at + 1 < len(text) and text[at + 1] in _PUNCTUATION:
                at += 2
                continue
            if text[at] == "(":
                depth += 1
            elif text[at] == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        if depth:
            return None
        dest = text[begin:at]
    m = _CLOSE_DESTINATION.match(text, at)
    return (_unescape(dest), m.end()) if m else None


def _tokens(text: str, references: dict[str, str]) -> list[_Node]:
    nodes: list[_Node] = []
    brackets: list[int] = []
    buffer: list[str] = []
    begin = 0

    def flush() -> None:
        if buffer:
            nodes.append(_Node("text", "".join(buffer), begin))
            buffer.clear()

    at = 0
    unclosed: set[int] = set()  # lengths of backtick runs that no later run closes
    while at < len(text):
        if not buffer:
            begin = at
        if m := _PLAIN.match(text, at):
            buffer.append(m[0])
            at = m.end()
            continue
        c = text[at]
        if c == "\\" and at + 1 < len(text) and (text[at + 1] in _PUNCTUATION or text[at + 1] == "\n"):
            if text[at + 1] == "\n":
                at += 1
                continue
            buffer.append(text[at + 1])
            at += 2
        elif c == "`":
            run = _RUNS[c].match(text, at)[0]
            close = None
            if len(run) not in unclosed:
                close = next((m for m in _RUNS[c].finditer(text, at + len(run)) if len(m[0]) == len(run)), None)
            if close:
                flush()
                code = text[at + len(run) : close.start()].replace("\n", " ")
                if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" "):
                    code = code[1:-1]
                nodes.append(_Node("code", code, at))
                at = close.end()
            else:
                unclosed.add(len(run))
                buffer.append(run)
                at += len(run)
        elif c == "<" and (m := _AUTOLINK.match(text, at)):
            flush()
            nodes += [_Node("open", "", at, dest=m[1]), _Node("code", m[1], at), _Node("close", "", at)]
            at = m.end()
        elif c == "<" and (m := _TAG.match(text, at)):
            flush()
            nodes.append(_Node("html", m[0], at))
            at = m.end()
        elif c == "&" and (m := _ENTITY.match(text, at)):
            buffer.append(html.unescape(m[0]))
            at = m.end()
        elif c in "*_~":
            run = _RUNS[c].match(text, at)[0]
            flush()
            before, after = text[at - 1 : at] or " ", text[at + len(run) : at + len(run) + 1] or " "
            left = not after.isspace() and (not _is_punct(after) or before.isspace() or _is_punct(before))
            right = not before.isspace() and (not _is_punct(before) or after.isspace() or _is_punct(after))
            opens = left and (c != "_" or not right or _is_punct(before))
            closes = right and (c != "_" or not left or _is_punct(after))
            if c == "~" and len(run) > 2:
                opens = closes = False
            nodes.append(_Node("delimiter", run, at, opens=opens, closes=closes))
            at += len(run)
        elif c == "[" or (c == "!" and text.startswith("[", at + 1)):
            flush()
            image = c == "!"
            nodes.append(_Node("text", "![" if image else "[", at, image=image))
            brackets.append(len(nodes) - 1)
            at += 2 if image else 1
        elif c == "]":
            flush()
            at = _close_bracket(text, at, nodes, brackets, references)
        else:
            buffer.append(c)
            at += 1
    flush()
    return nodes


def _is_punct(c: str) -> bool:
    return c in _PUNCTUATION or unicodedata.category(c)[0] in "PS"


def _close_bracket(text: str, at: int, nodes: list[_Node], brackets: list[int], references: dict[str, str]) -> int:
    if not brackets:
        nodes.append(_Node("text", "]", at))
        return at + 1
    opened = brackets.pop()
    node = nodes[opened]
    if not node.live:
        nodes.append(_Node("text", "]", at))
        return at + 1
    inner = text[node.at + len(node.text) : at]
    found = _inline_destination(text, at + 1)
    if found is None:
        m = _REFERENCE_LABEL.match(text, at + 1)
        label = _label(m[1]) if m and m[1].strip() else _label(inner)
        if label in references:
            found = references[label], (m.end() if m else at + 1)
    if found is None:
        nodes.append(_Node("text", "]", at))
        return at + 1
    dest, end = found
    _emphasis(nodes, opened + 1)
    nodes[opened] = _Node("open", "", node.at, image=node.image, dest=dest)
    nodes.append(_Node("close", "", at, image=node.image))
    if not node.image:  # links do not nest
        for i in brackets:
            if not nodes[i].image:
                nodes[i].live = False
    return end


def _emphasis(nodes: list[_Node], start: int) -> None:
    """Take away the delimiters that pair up; the rest stay as text."""
    openers: list[int] = []
    for i in range(start, len(nodes)):
        node = nodes[i]
        if node.kind != "delimiter":
            continue
        mark = node.text[:1]
        while node.closes and node.text:
            pair = next(
                (
                    k
                    for k in reversed(openers)
                    if nodes[k].text[:1] == mark
                    and not (mark == "~" and len(nodes[k].text) != len(node.text))
                    and not (
                        mark != "~"
                        and (nodes[k].closes or node.opens)
                        and (len(nodes[k].text) + len(node.text)) % 3 == 0
                        and (len(nodes[k].text) % 3 or len(node.text) % 3)
                    )
                ),
                None,
            )
            if pair is None:
                break
            used = len(node.text) if mark == "~" else 2 if min(len(nodes[pair].text), len(node.text)) >= 2 else 1
            nodes[pair].text, node.text = nodes[pair].text[used:], node.text[used:]
            del openers[openers.index(pair) + (1 if nodes[pair].text else 0) :]
        if node.opens and node.text:
            openers.append(i)
    for i in range(start, len(nodes)):
        if nodes[i].kind == "delimiter":
            nodes[i].kind = "text"


def _inline(out: _Collector, lines: list[tuple[int, str]], references: dict[str, str]) -> None:
    """Emit the inline content of a leaf block given as numbered lines."""
    text = "\n".join(t.strip(" \t") for _, t in lines)
    starts = list(accumulate((len(t) + 1 for t in text.split("\n")), initial=0))

    def line_at(offset: int) -> int:
        return lines[min(bisect_right(starts, offset) - 1, len(lines) - 1)][0]

    nodes = _tokens(text, references)
    _emphasis(nodes, 0)
    opened: list[tuple[_Node, int]] = []
    for node in nodes:
        if node.kind == "html":
            out.barrier()
        elif node.kind == "code":
            out.text(node.text, line_at(node.at), linkable=False)
        elif node.kind == "open" and node.image:
            out.image(1)
        elif node.kind == "close" and node.image:
            out.image(-1)
        elif node.kind == "open":
            opened.append((node, out.open_link()))
        elif node.kind == "close":
            link, offset = opened.pop()
            out.close_link(link.dest, offset, line_at(link.at))
        elif node.text:
            out.text(node.text, line_at(node.at))


# ---- blocks ----------------------------------------------------------------------

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>[ \t]?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)([ \t]*)")
_HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    "h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_STARTS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I), None),
)
_HTML_ALONE = re.compile(rf" {{0,3}}(?:{_TAG.pattern})[ \t]*$", re.DOTALL)
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _untab(line: str) -> str:
    head = re.match(r"[ \t]*", line)[0]
    return head.expandtabs(4) + line[len(head) :] if "\t" in head else line


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    cells = re.split(r"(?<!\\)\|", row)
    return [c.replace("\\|", "|").strip() for c in (cells[:-1] if cells and not cells[-1].strip() and len(cells) > 1 else cells)]


#: What a line of a block other than a paragraph, a table or an indented block begins with.
_BLOCK_START = re.compile(r" {0,3}[#`~*_>+\-<\d]")


def _interrupts(line: str, in_item: bool = False) -> bool:
    """Whether a line ends a paragraph without a blank line."""
    if not _BLOCK_START.match(line):
        return False
    if _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or any(s.match(line) for s, _ in _HTML_STARTS):
        return True
    fence = _FENCE.match(line)
    if fence and not (fence[2][0] == "`" and "`" in fence[3]):
        return True
    item = _ITEM.match(line)
    return bool(item and line[item.end() :].strip() and (item[2] in "-+*" or item[2][:-1] == "1" or in_item))


def _blocks(out: _Collector, lines: list[tuple[int, str]], references: dict[str, str], tight: bool = False) -> None:
    i = 0
    while i < len(lines):
        number, raw = lines[i]
        line = _untab(raw)
        if not line.strip(" \t\r"):
            i += 1
        elif line.startswith("    "):
            i = _indented(out, lines, i)
        elif not _BLOCK_START.match(line):
            i = _text(out, lines, i, line, references, tight)
        elif m := _ATX.match(line):
            out.heading(len(m[1]), number)
            body = m[2] or ""
            _inline(out, [(number, "" if re.fullmatch("#+", body) else body)], references)
            out.pop()
            i += 1
        elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
            i = _fenced(out, lines, i, m)
        elif _RULE.match(line):
            i += 1
        elif _QUOTE.match(line):
            i = _quote(out, lines, i, references)
        elif _ITEM.match(line):
            i = _list(out, lines, i, references)
        elif (end := _html_end(lines, i, line)) is not None:
            out.barrier()
            i = end
        else:
            i = _text(out, lines, i, line, references, tight)


def _text(out: _Collector, lines: list[tuple[int, str]], i: int, line: str, references: dict[str, str], tight: bool) -> int:
    """A table or a paragraph."""
    if i + 1 < len(lines) and "|" in line and _DELIMITER_ROW.match(lines[i + 1][1].rstrip("\r")) and len(_cells(line)) == len(_cells(lines[i + 1][1])):
        return _table(out, lines, i, references)
    return _paragraph(out, lines, i, references, tight)


def _indented(out: _Collector, lines: list[tuple[int, str]], i: int) -> int:
    while i < len(lines) and (_untab(lines[i][1]).startswith("    ") or not lines[i][1].strip()):
        if lines[i][1].strip():
            out.text(_untab(lines[i][1])[4:] + "\n", lines[i][0])
        i += 1
    return i


def _fenced(out: _Collector, lines: list[tuple[int, str]], i: int, opened: re.Match) -> int:
    close = re.compile(rf" {{0,3}}{re.escape(opened[2][0])}{{{len(opened[2])},}}[ \t\r]*$")
    i += 1
    while i < len(lines) and not close.match(lines[i][1]):
        out.text(lines[i][1] + "\n", lines[i][0])
        i += 1
    return i + 1


def _html_end(lines: list[tuple[int, str]], i: int, line: str) -> int | None:
    for start, stop in _HTML_STARTS:
        if start.match(line):
            if stop is None:
                break
            while i < len(lines) and not stop.search(lines[i][1]):
                i += 1
            return i + 1
    else:
        if not _HTML_ALONE.match(line) or _AUTOLINK.match(line.strip()):
            return None
    while i < len(lines) and lines[i][1].strip():
        i += 1
    return i


def _quote(out: _Collector, lines: list[tuple[int, str]], i: int, references: dict[str, str]) -> int:
    inner: list[tuple[int, str]] = []
    while i < len(lines):
        number, line = lines[i]
        m = _QUOTE.match(_untab(line))
        if m:
            inner.append((number, _untab(line)[m.end() :]))
        elif inner and inner[-1][1].strip() and line.strip() and not _interrupts(_untab(line)) and not inner[-1][1].startswith("    ") and not _ATX.match(inner[-1][1]):
            inner.append((number, line.lstrip()))  # a lazy line of the paragraph
        else:
            break
        i += 1
    _blocks(out, inner, references)
    return i


def _list(out: _Collector, lines: list[tuple[int, str]], i: int, references: dict[str, str]) -> int:
    marker = _ITEM.match(_untab(lines[i][1]))[2][-1]
    items: list[list[tuple[int, str]]] = []
    loose = False
    while i < len(lines):
        line = _untab(lines[i][1])
        m = _ITEM.match(line)
        if not m or m[2][-1] != marker or _RULE.match(line):
            break
        pad = len(m[3].expandtabs(4))
        width = len(m[1]) + len(m[2]) + (pad if 1 <= pad <= 4 and line[m.end() :].strip() else 1)
        item = [(lines[i][0], line[min(width, m.end()) if pad <= 4 else width :])]
        i += 1
        blank = False
        while i < len(lines):
            line = _untab(lines[i][1])
            if not line.strip():
                if blank and len(item) == 1 and not item[0][1].strip():
                    break
                blank = True
                item.append((lines[i][0], ""))
            elif len(line) - len(line.lstrip(" ")) >= width:
                item.append((lines[i][0], line[width:]))
                blank = False
            elif not blank and not _interrupts(line, True) and not _ITEM.match(line):
                item.append((lines[i][0], line.lstrip()))
            else:
                break
            i += 1
        trailing = False
        while len(item) > 1 and not item[-1][1].strip():
            item.pop()
            trailing = True
        more = i < len(lines) and (n := _ITEM.match(_untab(lines[i][1]))) and n[2][-1] == marker
        loose |= any(not t.strip() for _, t in item[1:]) and _separates(item) or bool(trailing and more)
        items.append(item)
    for item in items:
        out.push("item")
        _blocks(out, item, references, tight=not loose)
        out.pop()
    return i


def _separates(item: list[tuple[int, str]]) -> bool:
    """Whether a blank line stands between two direct children of an item (not inside a nested list or a fence)."""
    fence = None
    for (_, before), (_, after) in zip(item, item[1:] + [(0, "")]):
        m = _FENCE.match(before)
        if fence is None and m:
            fence = m[2][0]
        elif fence is not None and m and m[2][0] == fence and not m[3].strip():
            fence = None
        if fence is None and not before.strip() and after.strip() and not after.startswith(" "):
            return True
    return False


def _table(out: _Collector, lines: list[tuple[int, str]], i: int, references: dict[str, str]) -> int:
    width = len(_cells(lines[i][1]))
    rows = [lines[i]]
    i += 2
    while i < len(lines) and lines[i][1].strip() and not _interrupts(_untab(lines[i][1])):
        rows.append(lines[i])
        i += 1
    for number, row in rows:
        for cell in (_cells(row) + [""] * width)[:width]:
            out.push("cell")
            _inline(out, [(number, cell)], references)
            out.pop()
    return i


def _paragraph(out: _Collector, lines: list[tuple[int, str]], i: int, references: dict[str, str], tight: bool) -> int:
    held = [lines[i]]
    i += 1
    level = 0
    while i < len(lines) and lines[i][1].strip(" \t\r"):
        line = _untab(lines[i][1])
        setext = _SETEXT.match(line.rstrip("\r"))
        if setext:
            level = 1 if setext[1][0] == "=" else 2
            i += 1
            break
        if _interrupts(line):
            break
        held.append(lines[i])
        i += 1
    held = _without_references(held)
    if not held:
        return i
    if level:
        out.heading(level, held[0][0])
        _inline(out, held, references)
        out.pop()
    elif tight:
        _inline(out, held, references)
        out.text(" ", held[-1][0])
    else:
        out.push("paragraph")
        _inline(out, held, references)
        out.pop()
    return i


def _without_references(held: list[tuple[int, str]]) -> list[tuple[int, str]]:
    if not held[0][1].lstrip(" ").startswith("["):
        return held
    text = "\n".join(t.rstrip("\r") for _, t in held)
    while m := _REFERENCE.match(text):
        held = held[m[0].rstrip("\n").count("\n") + 1 :]
        text = text[m.end() :]
    return held


def _references(lines: list[str]) -> dict[str, str]:
    """Link reference definitions of the whole page; the first of a label wins."""
    found: dict[str, str] = {}
    if not any("]:" in x for x in lines):
        return found
    text = "\n".join(re.sub(r"^(?: {0,3}>[ ]?)+", "", x) for x in lines)
    for m in re.finditer(rf"(?:(?<=\n)|\A){_REFERENCE.pattern}", text, re.DOTALL):
        found.setdefault(_label(m[1]), _unescape(m[2][1:-1] if m[2].startswith("<") else m[2]))
    return found


def scan(text: str) -> Scan:
    """Everything the engine reads from one page."""
    lines = split_lines(text)
    fields, title, skipped = split_frontmatter(lines)
    out = Scan(fields, title, skipped + 1, len(lines))
    body = [(n, t.rstrip("\r")) for n, t in enumerate(lines[skipped:], skipped + 1)]
    collector = _Collector(out)
    _blocks(collector, body, _references([t for _, t in body]))
    collector.finish()
    return out


def sections(found: Scan, text: str) -> list[tuple[str | None, int, int, int]]:
    """Heading, level, first and last line of each section; what stands before the first heading is one without heading.

    A section ends before the next heading of its level or a higher one, so a parent holds its children.
    """
    out: list[tuple[str | None, int, int, int]] = []
    first = found.headings[0].line if found.headings else found.lines + 1
    body = min(found.body_line, max(found.lines, 1))
    before = split_lines(text)[found.body_line - 1 : first - 1]
    if first - 1 >= body and any(trim(x) for x in before):
        out.append((None, 0, body, first - 1))
    ends: list[int] = []
    nearest = [found.lines + 1] * 7  # of each level, the line of the next heading of that level or a higher one
    for h in reversed(found.headings):
        ends.append(nearest[h.level] - 1)
        nearest[h.level :] = [h.line] * (7 - h.level)
    out += [(h.text, h.level, h.line, end) for h, end in zip(found.headings, reversed(ends))]
    return out
