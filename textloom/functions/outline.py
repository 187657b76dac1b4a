"""Code outlines: declarations stay, bodies go.

A source is read line by line. For brace languages a generator of (line, depth) drives one routine
with a per-language test for declarations; Python goes by indentation. Braces count wherever they
stand, in strings and comments too, and the other known quirks are kept on purpose: outlines must
equal those users have today.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import language_hint

STUB = " { /* ... */ }"
BRACE_LANGUAGES = ("go", "typescript", "javascript", "tsx", "jsx", "c", "cpp", "java", "kotlin", "swift", "csharp")
OUTLINED = ("rust", "python", *BRACE_LANGUAGES)

# Fixed tests for the start of a function, on the trimmed line.
RUST = re.compile(r"(pub(\((crate|super)\))? )?fn |(pub |pub\(crate\) )?async fn |(pub )?(const|unsafe|extern) fn |(?!//).* fn ", re.S)
GO = re.compile(r"func ")
SCRIPT = re.compile(r"(export )?(async )?function |(export )?const .* => |constructor\(.*\{\Z|(?!class |interface |type ).*\(.*\{\Z", re.S)
TYPED = re.compile(r"(?!struct |class |interface |enum |#|//)(?=.*(\{\Z|\())(.*(public |private |protected |void |int |bool |auto )|func? )", re.S)
STARTS = {"rust": RUST, "go": GO, **dict.fromkeys(("typescript", "javascript", "tsx", "jsx"), SCRIPT), **dict.fromkeys(("c", "cpp", "java", "kotlin", "swift", "csharp"), TYPED)}


def split_lines(source: str) -> list[str]:
    """Lines without their ends; one final line feed starts no line."""
    if not source:
        return []
    return [x[:-1] if x.endswith("\r") else x for x in source.removesuffix("\n").split("\n")]


def brace_outline(source: str, starts: re.Pattern[str]) -> str:
    """Outline of a brace language. Depth never falls below zero; a body ends where depth falls below the one it began at."""
    out: list[str] = []
    depth, body = 0, None
    rows = iter(split_lines(source))
    for row in rows:
        if body is not None:
            depth = max(0, depth + row.count("{") - row.count("}"))
            if depth < body:
                body = None
            continue
        if not starts.match(row.strip()):
            depth = max(0, depth + row.count("{") - row.count("}"))
            out.append(row)
            continue
        head = [row]
        while not ("{" in head[-1] or ";" in head[-1]) and (more := next(rows, None)) is not None:
            head.append(more)
        whole = "\n".join(head)
        front, brace, rest = whole.partition("{")
        if not brace:
            out.append(whole)
            continue
        out.append(front.rstrip() + STUB)
        rise = 1 + rest.count("{") - rest.count("}")
        if rise > 0:
            body = depth + 1
            depth += rise
    return "".join(f"{x}\n" for x in out)


def python_outline(source: str) -> str:
    """Functions keep their signature and an ellipsis; what is indented deeper than one goes, docstring included."""
    out: list[str] = []
    hide = -1  # indentation of the function whose body is being left out
    rows = iter(split_lines(source))
    for row in rows:
        bare = row.strip()
        if not bare:
            if hide < 0:
                out.append("")
            continue
        indent = len(row.encode()) - len(row.lstrip().encode())
        if hide >= 0 and indent > hide:
            continue
        hide = -1
        if not bare.startswith(("def ", "async def ")):
            out.append(row)
            continue
        head = [row]
        while not head[-1].rstrip().endswith(":") and (more := next(rows, None)) is not None:
            head.append(more)
        out += [*head, " " * (indent + 4) + "..."]
        hide = indent
    return "".join(f"{x}\n" for x in out)


def outline_text(source: str | None, language: str) -> str | None:
    """Other languages pass through unchanged."""
    if source is None or language not in OUTLINED:
        return source
    return python_outline(source) if language == "python" else brace_outline(source, STARTS[language])


@F.pandas_udf(T.StringType())
def _outline(source: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([outline_text(s, lang) for s, lang in zip(source, language, strict=True)])


#: Filters on the result must not be moved below it, for that would read every source twice.
_once = _outline.asNondeterministic()


def outline(content: Column, path: Column) -> Column:
    """Outline by the path's language; only sources that have one reach Python."""
    lang = language_hint(path)
    wanted = lang.isin(*OUTLINED)
    return F.when(wanted, _once(F.when(wanted, content), lang)).otherwise(content)
