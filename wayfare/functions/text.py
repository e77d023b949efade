"""Text, line and path helpers: pure Python for the parser, column builders for plans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space; Python's ``str.isspace`` also accepts U+001C to U+001F.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{WHITE_SPACE}]+")
_STRIP = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
PAGE_EXTENSIONS = ("md", "txt")


def trim(text: str) -> str:
    return text.strip(_STRIP)


def collapse(text: str) -> str:
    """Runs of white space as one space."""
    return _SPACES.sub(" ", text)


def plain_terms(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def split_lines(text: str) -> list[str]:
    """Lines without their newline; a trailing newline opens no line."""
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


# ---- paths -------------------------------------------------------------------


def components(path: str) -> list[str]:
    """Path components, which is what paths are ordered by."""
    head = ["/"] if path.startswith("/") else []
    return head + [c for c in path.split("/") if c not in ("", ".")]


def normalize(path: str) -> str:
    """``.`` and ``..`` resolved lexically; leading ``..`` stay."""
    out: list[str] = []
    for c in components(path):
        if c == ".." and out and out[-1] not in ("..", "/"):
            out.pop()
        else:
            out.append(c)
    return "/" + "/".join(out[1:]) if out[:1] == ["/"] else "/".join(out)


def join_path(base: str, path: str) -> str:
    return path if path.startswith("/") or not base else f"{base}/{path}"


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def relative_to_root(root: str, path: str) -> str:
    """``path`` as link targets are spelled: normal, relative to ``root``."""
    a, b = components(normalize(root)), components(normalize(path))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return "/".join([".."] * (len(a) - n) + b[n:])


def from_root(root: str, path: str) -> str:
    """Inverse of ``relative_to_root``: the path as the caller spells it."""
    return normalize(join_path(root, path))


def extension(path: str) -> str | None:
    """What follows the last dot of the file name; a name that only starts with a dot has none."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem and name != ".." else None


def file_stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    ext = extension(name)
    return name[: -len(ext) - 1] if ext is not None else name


def is_page(path: str) -> bool:
    return (extension(path) or "").lower() in PAGE_EXTENSIONS


def escapes_root(target: str) -> bool:
    return target.startswith("/") or target == ".." or target.startswith("../")


def is_external(dest: str) -> bool:
    """Whether a destination starts with ``scheme:``."""
    return re.match(r"[A-Za-z0-9+.\-]+:", dest) is not None


def decode_percent(dest: str) -> str:
    """Valid ``%xx`` decoded, others kept; bytes that are not UTF-8 replaced."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), dest.encode("utf-8", "surrogatepass"))
    return raw.decode("utf-8", "replace")


def resolve_markdown(dest: str, directory: str) -> str | None:
    """The page a markdown link names, or None when it names no local page."""
    path = trim(decode_percent(dest).split("#", 1)[0])
    if not path or is_external(path) or path.startswith("/") or not is_page(path):
        return None
    return normalize(join_path(directory, path))


def clamp(text: str, limit: int) -> str:
    """At most ``limit`` characters, with a note where text was cut."""
    return text if len(text) <= limit else f"{text[:limit]}\n[cut after {limit} characters]"


# ---- columns -----------------------------------------------------------------


def path_key(path: Column) -> Column:
    """Sort key of a path: its components, not its characters."""
    return F.split(path, "/")


def reading_tokens(chars: Column) -> Column:
    """Tokens of a number of characters to read: four a token, rounded up."""
    return F.ceil(chars / F.lit(4)).cast("long")


def tenth(score: Column) -> Column:
    """Decile bin 0 to 9 of a score in 0 to 1."""
    return F.least(F.floor(score * 10), F.lit(9)).cast("int")


def terms(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters and digits of at least ``least`` characters, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def out_of_root(target: Column) -> Column:
    return F.startswith(target, F.lit("/")) | (F.element_at(F.split(target, "/"), 1) == "..")
