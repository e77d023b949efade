"""Path exclusion by gitignore rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class IgnoreError(ValueError):
    """The rules cannot be read."""


@dataclass(frozen=True)
class _Rule:
    pattern: str
    negated: bool
    folders_only: bool


def _translate(glob: str) -> str:
    """One pattern body (no leading ``!`` or trailing ``/``) as a regular expression over a relative path."""
    anchored = "/" in glob
    body = glob.lstrip("/") if glob.startswith("/") else glob
    out = "" if anchored else "(?:.*/)?"
    i = 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out += ".+"
            i += 2
        elif c == "*":
            out += "[^/]*"
            while i < len(body) and body[i] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[":
            end = i + 1 + (body[i + 1 : i + 2] in ("!", "^"))
            end = body.find("]", end + 1)
            if end < 0:
                raise IgnoreError(f"unclosed character class in {glob!r}")
            inner = body[i + 1 : end]
            inner = ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\")
            out += f"(?!/)[{inner}]"
            i = end + 1
        elif c == "\\":
            if i + 1 == len(body):
                raise IgnoreError(f"trailing backslash in {glob!r}")
            out += re.escape(body[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    return out


def parse_rules(text: str) -> list[_Rule]:
    rules = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("#"):
            continue
        line = re.sub(r"(?<!\\)\s+$", "", line)
        negated = line.startswith("!")
        body = line[1:] if negated else line
        folders = body.endswith("/")
        body = body.rstrip("/") if folders else body
        if not body:
            continue
        try:
            re.compile(pattern := _translate(body))
        except re.error as e:
            raise IgnoreError(f"bad pattern {line!r}: {e}") from e
        rules.append(_Rule(pattern, negated, folders))
    return rules


@dataclass(frozen=True)
class IgnoreRules:
    """Rules in file order; the last that matches a level decides it."""

    rules: tuple[_Rule, ...] = ()

    @staticmethod
    def none() -> IgnoreRules:
        return IgnoreRules()

    @staticmethod
    def of(text: str) -> IgnoreRules:
        return IgnoreRules(tuple(parse_rules(text)))

    @staticmethod
    def load(path: str) -> IgnoreRules:
        """Rules of a file; no file means no rules, anything else unreadable is an error."""
        try:
            with open(path, encoding="utf-8") as f:
                return IgnoreRules.of(f.read())
        except FileNotFoundError:
            return IgnoreRules()
        except (OSError, UnicodeError) as e:
            raise IgnoreError(f"{path}: {e}") from e

    def matched(self, path: str) -> bool:
        """Whether a path below the root is ignored: from the root down, the first level
        whose last matching rule ignores it settles the matter."""
        if path.startswith(("/", "../")) or path == "..":
            return False
        parts = path.split("/")
        for depth in range(1, len(parts) + 1):
            level = "/".join(parts[:depth])
            for rule in reversed(self.rules):
                if rule.folders_only and depth == len(parts):
                    continue
                if re.fullmatch(rule.pattern, level, re.DOTALL):
                    if not rule.negated:
                        return True
                    break
        return False

    def predicate(self, path: Column) -> Column:
        """``matched`` as a column, one call a batch; false everywhere without rules."""
        if not self.rules:
            return F.lit(False)
        own = self

        @F.pandas_udf("boolean")
        def ignored(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: p is not None and own.matched(p)).astype(bool)

        return ignored(path)
