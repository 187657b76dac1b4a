"""Dependencies of lockfiles: name and version pairs, sorted and unique.

Formats whose entries stand on one line are column expressions; those with state across lines are
read by an Arrow function that sees whole files.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEPENDENCIES
from . import text as X
from .paths import file_name

BLANK = r"(?U)^\s+|\s+$"


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, BLANK, "")


def _pairs(pairs: Column) -> Column:
    return F.array_sort(F.array_distinct(pairs))


def go_sum(content: Column) -> Column:
    """`module version hash` lines; `/go.mod` behind a version goes."""
    rows = F.filter(F.transform(X.lines(content), _trim), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    cut = F.filter(F.transform(rows, lambda s: F.split(s, r"(?U)\s+")), lambda f: F.size(f) >= 2)
    return _pairs(F.transform(cut, lambda f: F.struct(F.get(f, F.lit(0)).alias("name"), F.regexp_replace(F.get(f, F.lit(1)), r"/go\.mod$", "").alias("version"))))


def pnpm(content: Column) -> Column:
    """Keys `name@version:`; quotes, a leading slash, `(peer)` and `_hash` go."""
    rows = F.filter(F.transform(X.lines(content), _trim), lambda s: F.endswith(s, F.lit(":")) & F.contains(s, F.lit("@")) & ~F.startswith(s, F.lit("#")))

    def key(s: Column) -> Column:
        bare = F.regexp_replace(_trim(F.regexp_replace(s, "(?<!:):+$", "")), "^'+|(?<!')'+$", "")
        bare = F.regexp_replace(F.regexp_replace(bare, '^"+|(?<!")"+$', ""), "^/", "")
        return _trim(F.regexp_replace(bare, r"\(.*$", ""))

    pair = r"(?s)^(.+)@([^@]*)$"
    made = F.transform(F.transform(rows, key), lambda k: F.struct(F.regexp_extract(k, pair, 1).alias("name"), F.regexp_replace(F.regexp_extract(k, pair, 2), "_.*$", "").alias("version")))
    return _pairs(F.filter(made, lambda d: (d["name"] != "") & (d["version"] != "")))


QUOTED = re.compile(r'^"([^"]*)"|^\'([^\']*)\'')
TOML_FIELD = re.compile(r"^(name|version)\s*=\s*(.*)$")


def _lines(content: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in content.removesuffix("\n").split("\n")] if content else []


def toml_packages(content: str) -> set[tuple[str, str]]:
    """[[package]] tables; any other header ends one, and a package needs both fields."""
    found: set[tuple[str, str]] = set()
    open_table, fields = False, {}
    for raw in [*_lines(content), "["]:
        row = raw.strip()
        if row.startswith("["):
            if {"name", "version"} <= fields.keys():
                found.add((fields["name"], fields["version"]))
                fields = {}
            open_table = row == "[[package]]"
        elif open_table and (m := TOML_FIELD.match(row)) and (q := QUOTED.match(m[2].strip())):
            fields[m[1]] = q[1] if q[1] is not None else q[2]
    return found


VERSION = re.compile(r'"version"\s*:\s*"((?:[^"\\]|\\.)*)"')
MODULE = re.compile(r'"node_modules/([^"]*)"')
ENTRY = re.compile(r'^\s*"([^"]+)"\s*:.*\{\s*$')


def npm_packages(content: str) -> set[tuple[str, str]]:
    """The packages map of newer files, the innermost module name counting; else the dependencies of older ones."""
    found: set[tuple[str, str]] = set()
    _, there, rest = content.partition('"packages"')
    marks = list(MODULE.finditer(rest)) if there else []
    for m, nxt in zip(marks, [*marks[1:], None], strict=False):
        name = m[1].rpartition("node_modules/")[2]
        version = VERSION.search(rest, m.end(), nxt.start() if nxt else len(rest))
        if name and version:
            found.add((name, version[1]))
    if found:
        return found
    name = None
    for row in _lines(content.partition('"dependencies"')[2]):
        entry = ENTRY.match(row)
        if entry and entry[1] not in ("dependencies", "requires", "packages"):
            name = entry[1]
        if name and row.strip().startswith('"version"') and (version := VERSION.search(row)):
            found.add((name, version[1]))
            name = None
    return found


def yarn_packages(content: str) -> set[tuple[str, str]]:
    """Headers at the margin name a package before the last @ of their first spec; the next version line is its."""
    found: set[tuple[str, str]] = set()
    name = None
    for row in _lines(content):
        bare = row.strip()
        if not bare or bare.startswith("#"):
            continue
        if row[0] not in " \t" and bare.endswith(":"):
            spec = bare.rstrip(":").split(",")[0].strip().strip('"').strip("'")
            name = spec.rpartition("@")[0] or None
        elif name and bare.startswith("version"):
            for sign in (" ", ":"):
                if sign in bare:
                    found.add((name, bare.split(sign, 1)[1].strip().strip('"').strip("'")))
                    name = None
                    break
    return found


STATEFUL = {"Cargo.lock": toml_packages, "poetry.lock": toml_packages, "package-lock.json": npm_packages, "yarn.lock": yarn_packages}


@F.pandas_udf(DEPENDENCIES)
def _stateful(name: pd.Series, content: pd.Series) -> pd.Series:
    def read(n: str, c: str):
        pairs = sorted(STATEFUL[n](c), key=lambda p: (p[0].encode(), p[1].encode())) if n in STATEFUL and c is not None else None
        return None if pairs is None else [{"name": a, "version": b} for a, b in pairs]

    return pd.Series([read(n, c) for n, c in zip(name, content, strict=True)])


def dependencies(path: Column, content: Column) -> Column:
    """By file name; null for a lockfile without a reader. Only files with state across lines reach Python."""
    name = file_name(path)
    return F.when(name == "go.sum", go_sum(content)).when(name == "pnpm-lock.yaml", pnpm(content)).otherwise(_stateful(F.when(name.isin(*STATEFUL), name), F.when(name.isin(*STATEFUL), content)))
