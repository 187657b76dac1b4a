"""Column expressions for formatting: fences, JSON strings, numbers, sizes, gauges, literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_newline(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def fence(text: Column) -> Column:
    """Backticks, one more than the longest run in the text and three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)


def json_escape(text: Column) -> Column:
    """Escapes of a JSON string: the short ones, and lower-case \\u00xx for other controls."""
    out = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    rare = out
    for code in range(32):
        if chr(code) not in "\n\r\t\b\f":
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(F.regexp_like(out, F.lit(r"[\x00-\x1f]")), rare).otherwise(out)


def grouped(n: Column) -> Column:
    """18420 -> 18,420."""
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """245, 1.2k, 18k, 1.2M; digits are cut off, not rounded."""
    s = lambda c: c.cast("string")
    div = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    return (
        F.when(n < 1_000, s(n))
        .when(n < 10_000, F.concat(s(div(n, 1_000)), F.lit("."), s(div(n % 1_000, 100)), F.lit("k")))
        .when(n < 1_000_000, F.concat(s(div(n, 1_000)), F.lit("k")))
        .otherwise(F.concat(s(div(n, 1_000_000)), F.lit("."), s(div(n % 1_000_000, 100_000)), F.lit("M")))
    )


def _size(n: Column, mega: str) -> Column:
    b = n.cast("double")
    # halves go to the even digit
    show = lambda pattern, unit: F.format_string(pattern, F.bround(b / F.lit(float(unit)), int(pattern[2])))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, show("%.1f KB", 1 << 10)).when(n < 1 << 30, show(mega, 1 << 20)).otherwise(show("%.2f GB", 1 << 30))


def size_short(n: Column) -> Column:
    """512 B, 124.5 KB, 3.2 MB, 1.00 GB."""
    return _size(n, "%.1f MB")


def size_long(n: Column) -> Column:
    """As in the stats line: two decimals from megabytes on."""
    return _size(n, "%.2f MB")


def digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def gauge(used: Column, limit: Column, cells: int = 12) -> Column:
    """struct(ratio, bar, colour, over): how full a context window is."""
    ratio = F.when(limit == 0, F.lit(0.0)).otherwise(used.cast("double") / limit.cast("double"))
    filled = F.least(F.lit(cells), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)) * cells).cast("int"))
    colour = F.when(ratio >= 1.0, "red").when(ratio >= 0.9, "light_red").when(ratio >= 0.7, "yellow").otherwise("green")
    return F.struct(ratio.alias("ratio"), F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled)).alias("bar"), colour.alias("colour"), (ratio > 1.0).alias("over"))


def tail_fit(path: Column, width: int) -> Column:
    """The last `width` characters at most, with an ellipsis in front of a cut path."""
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(width - 1))))


def expand_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit("    "))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line feed makes no empty last line."""
    cut = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(cut, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


PREVIEW_BYTES = 256 * 1024


def preview(text: Column, most: int = PREVIEW_BYTES) -> Column:
    """struct(shown, truncated): at most so many bytes, cut back to a whole character."""
    raw = text.cast("binary")
    follows = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    keep = F.lit(most - 3)
    for back in (2, 1, 0):  # a byte that begins a character is the last but none of those shown
        keep = F.when(follows(most + 1 - back), keep).otherwise(F.lit(most - back))
    long = F.octet_length(text) > most
    cut = F.substring(raw, F.lit(1), keep).cast("string")
    return F.struct(F.when(long, cut).otherwise(text).alias("shown"), long.alias("truncated"))


SIZE_UNITS = {"": 1.0, "B": 1.0, **{u: 1024.0**k for k, c in enumerate("KMG", 1) for u in (c, f"{c}B", f"{c}IB")}}
TOKEN_UNITS = {"": 1.0, "K": 1e3, "M": 1e6}


def _literal(text: str, units: dict[str, float], positive: bool) -> int:
    m = re.fullmatch(r"\s*([^a-zA-Z]*?)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].upper() not in units:
        raise ValueError(f"not a size: {text!r}")
    value = float(m[1])
    if value < 0 or positive and value == 0:
        raise ValueError(f"must be positive: {text!r}")
    return int(value * units[m[2].upper()])


def parse_size(text: str) -> int:
    """'500KB', '1.5MB', '1024': bytes, units of 1024."""
    return _literal(text, SIZE_UNITS, False)


def parse_budget(text: str) -> int:
    """'50k', '1m', '50000': tokens, units of 1000, over zero."""
    return _literal(text, TOKEN_UNITS, True)


def size_of(text: Column) -> Column:
    """parse_size as a column; null for what isn't a size."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2))
    table = F.create_map(*[F.lit(x) for kv in SIZE_UNITS.items() for x in kv])
    return F.when(number != "", F.floor(number.try_cast("double") * F.try_element_at(table, unit)).cast("bigint"))
