"""Lexical highlighting of code lines into (text, kind) spans."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed word lists.
HASH_COMMENTS = frozenset("python toml yaml sh bash zsh".split())
CONSTANTS = frozenset("true false null None nil undefined True False".split())
TYPES = {
    "rust": "u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str Self",
    "go": "int int32 int64 uint uint32 uint64 string byte error float32 float64 bool",
    **dict.fromkeys(("c", "cpp", "java"), "int long float double void char bool boolean auto size_t"),
    "typescript": "string number boolean any unknown never void",
}
SCRIPT = "function const let var return if else for while import export from default class extends interface type async await try catch finally throw new this typeof instanceof"
KEYWORDS = {
    "rust": "as break const continue crate else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while async await dyn",
    "python": "def class return import from as if elif else for while try except finally with async await yield lambda pass raise is in not and or",
    "toml": "name version edition dependencies workspace",
    "go": "func package import type struct interface return if else for range switch case default var const go chan select defer",
    **dict.fromkeys(("typescript", "javascript", "tsx", "jsx"), SCRIPT),
}
OTHER = "fn func def class struct import return if else"
TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|`(?:[^`\\]|\\.)*(?:`|\\?\Z))"""
    r"|(?P<word>[^\W\d]\w*)|(?P<number>[0-9][\w.]*)|(?P<punct>[^\w\"'`/#]+|.)",
    re.S,
)


@cache
def words(lang: str) -> tuple[frozenset[str], frozenset[str]]:
    """Keywords and types."""
    return frozenset(KEYWORDS.get(lang, OTHER).split()), frozenset(TYPES.get(lang, "").split())


def spans(line: str, lang: str) -> list[tuple[str, str]]:
    """Spans whose texts join to the line: blank, comment, string, keyword, type, constant, name, number, punct."""
    rest = line.lstrip()
    out = [(line[: len(line) - len(rest)], "blank")] if len(rest) < len(line) else []
    marks = ("#",) if lang in HASH_COMMENTS else ("//", "/*")
    keywords, types = words(lang if lang in KEYWORDS or lang in TYPES else "")
    at = 0
    while at < len(rest):
        if rest.startswith(marks, at):
            return [*out, (rest[at:], "comment")]
        m = TOKEN.match(rest, at)
        kind, text = m.lastgroup, m[0]
        if kind == "word":
            kind = "keyword" if text in keywords else "type" if text[0].isupper() or text in types else "constant" if text in CONSTANTS else "name"
        out.append((text, kind))
        at = m.end()
    return out


def highlighted(line: pa.Array, lang: pa.Array) -> pa.Array:
    """Lists of (text, kind) structs. Sources repeat their lines, so each distinct pair of a batch is read once and its list repeated."""
    line, lang = (pc.fill_null(x.cast(pa.string()), "").dictionary_encode() for x in (line, lang))
    many = max(1, len(lang.dictionary))
    pairs, places = np.unique(line.indices.to_numpy().astype(np.int64) * many + lang.indices.to_numpy(), return_inverse=True)
    lines, langs = line.dictionary.to_pylist(), lang.dictionary.to_pylist()
    read = [spans(lines[k // many], langs[k % many]) for k in pairs.tolist()]
    ends = np.cumsum([0, *map(len, read)], dtype=np.int32)
    parts = [pa.array([s[k] for row in read for s in row], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["text", "kind"])).take(pa.array(places))


@F.arrow_udf(T.ArrayType(T.StructType().add("text", "string").add("kind", "string")))
def highlight(line: pa.Array, lang: pa.Array) -> pa.Array:
    return highlighted(line, lang)
