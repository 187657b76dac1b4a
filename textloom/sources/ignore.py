"""Ignore files: patterns as git reads them, nested folders inheriting from those above."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

#: Kinds of ignore files; where several kinds have a rule for a path, the larger one decides, wherever its file stands.
USER, EXCLUDE, GIT, PLAIN, OWN = range(5)


class Pattern(NamedTuple):
    """One line: a regular expression on paths below the file's folder, whether it takes back, whether it means folders only."""

    regex: str
    negated: bool
    folders: bool


def pattern_of(line: str) -> Pattern | None:
    """None for blank and comment lines."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    out, at = [], 0
    while at < len(line):
        c = line[at]
        if line.startswith("**/", at) and (at == 0 or line[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
            continue
        if line[at:] == "**" and at and line[at - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := line.find("]", at + 2)) > 0:
            body = line[at + 1 : end]
            body = "^" + body[1:] if body.startswith("!") else body
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            at = end
        elif c == "\\" and at + 1 < len(line):
            at += 1
            out.append(re.escape(line[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return Pattern(("" if anchored else "(?:.*/)?") + "".join(out), negated, folders)


@lru_cache(maxsize=65536)
def compiled(regex: str) -> re.Pattern[str]:
    return re.compile(regex, re.S)


class Rule(NamedTuple):
    """A pattern with the kind of its file and the folder below which it holds (with a slash; empty: all)."""

    kind: int
    folder: str
    regex: str
    negated: bool
    folders: bool


@dataclass(frozen=True)
class Rules:
    """Rules of a folder and those above, in order: of equally ranked ones the last that fits decides."""

    rules: tuple[Rule, ...] = ()

    def read(self, path: str, folder: str, kind: int) -> "Rules":
        """With a file's patterns, which hold below `folder`."""
        if not os.path.isfile(path):
            return self
        with open(path, encoding="utf-8", errors="replace") as lines:
            found = tuple(Rule(kind, f"{folder}/" if folder else "", *made) for line in lines if (made := pattern_of(line)))
        return Rules(self.rules + found)

    def below(self, folder: str, top: str, names: dict[str, int]) -> "Rules":
        """With the ignore files (name to kind) that stand in this folder."""
        rules = self
        for name, kind in names.items():
            rules = rules.read(os.path.join(top, folder, name), folder, kind)
        return rules

    def ignored(self, path: str, is_folder: bool) -> bool:
        best: Rule | None = None
        for rule in reversed(self.rules):
            if (best is None or rule.kind > best.kind) and path.startswith(rule.folder) and (is_folder or not rule.folders) and compiled(rule.regex).fullmatch(path, len(rule.folder)):
                best = rule
        return best is not None and not best.negated
