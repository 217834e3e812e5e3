"""Ignore rules of a source tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

FILES = (".gitignore", ".ignore", ".loamline_ignore")


@dataclass(frozen=True)
class Rule:
    expression: re.Pattern
    negated: bool
    directories_only: bool


def _translate(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + r"/.+", i + 3
        elif c == "*":
            out, i = out + r"[^/]*", i + 1
        elif c == "?":
            out, i = out + r"[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def rule(line: str) -> Rule | None:
    """The rule of one line; null for blank lines and comments."""
    text = line.rstrip("\n\r")
    text = re.sub(r"(?<!\\)\s+$", "", text)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    directories_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    body = _translate(text.lstrip("/"))
    return Rule(re.compile(("" if anchored else r"(?:.*/)?") + body + r"\Z", re.S), negated, directories_only)


def rules(text: str) -> list[Rule]:
    return [r for line in text.split("\n") if (r := rule(line))]


def ignored(relative: list[tuple[str, list[Rule]]], is_directory: bool) -> bool:
    """Whether rules leave a path out; ``relative``: its path from each directory with rules, outermost first."""
    for path, found in reversed(relative):
        for r in reversed(found):
            if (is_directory or not r.directories_only) and r.expression.match(path):
                return not r.negated
    return False
