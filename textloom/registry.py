"""SQL names for the engine's functions: `register(spark)`, then use them in `spark.sql`.

Native functions have one definition, the column expression; its SQL text becomes a SQL function's
body, so Catalyst sees through it and the two can't differ. Functions with state across lines
become the Arrow functions that the DataFrame API uses; plus the table functions and the data source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import frames, highlight, lines, lockfiles, outline, paths, prompts, redact, text, tokens, workflow
from .schema import PROFILES
from .sources.repo_tree import RepoTree

#: Operators, which print like functions; in back-ticks they are the names of such.
OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(<=>|<=|>=|!=|=|<|>|\+|-|\*|/|%|&|\||\^|~|!|and|or|not)(?=\()", re.S)

TEXT = {"t": "STRING"}
PATH = {"p": "STRING"}
#: name: parameters and the expression of them.
NATIVE: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    **{name: (PATH, getattr(paths, name)) for name in ("file_name", "extension", "is_lockfile", "is_svg", "is_minified", "is_sensitive", "has_binary_extension", "should_skip", "is_hidden", "language_hint", "compression_tier")},
    "path_depth": (PATH, paths.depth),
    "path_parts": (PATH, paths.parts),
    "redact_secrets": (TEXT, redact.redact_secrets),
    "count_secrets": (TEXT, redact.count_secrets),
    "token_estimate": (TEXT, tokens.estimate),
    "token_count": (TEXT | {"profile": "STRING"}, lambda t, profile: tokens.scaled(tokens.estimate(t), F.coalesce(*[F.when(profile == p[0], F.lit(p[2])) for p in PROFILES]))),
    "markdown_fence": (TEXT, text.fence),
    "json_escape": (TEXT, text.json_escape),
    "expand_tabs": (TEXT, text.expand_tabs),
    "text_lines": (TEXT, text.lines),
    "text_preview": (TEXT, text.preview),
    "prompt_clean": (TEXT, prompts.strip_fillers),
    "prompt_condensed": (TEXT, prompts.condense),
    "prompt_shots": (TEXT, prompts.shots),
    "prompt_lens": (TEXT, lambda t: prompts.specs(t, prompts.LENS)),
    "prompt_lighting": (TEXT, lambda t: prompts.specs(t, prompts.LIGHTING)),
    "size_text": ({"n": "BIGINT"}, text.size_long),
    "line_range": ({"data": "BINARY", "starts": "ARRAY<BIGINT>", "first": "INT", "count": "INT"}, lines.line_range),
}


def sql_of(expression: Column) -> str:
    """The SQL text of a column expression."""
    return OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", expression._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Register everything in this session; gives the names."""
    for name, (parameters, function) in NATIVE.items():
        body = function(*[F.col(p) for p in parameters])
        typed = spark.createDataFrame([], ", ".join(f"{p} {kind}" for p, kind in parameters.items())).select(body.alias("x"))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {kind}' for p, kind in parameters.items())}) RETURNS {typed.schema[0].dataType.simpleString()} RETURN {sql_of(body)}")

    arrow = {"outline_text": outline._outline, "highlight_line": highlight.highlight, "workflow_summary": workflow.manifest, "frame_sharpness": frames.frame_sharpness, "lock_dependencies": lockfiles._stateful, "line_starts": lines.line_starts}
    for name, function in arrow.items():
        spark.udf.register(name, function)
    tables = {"pgm_frames": frames.PgmFrames, "pgm_chunks": frames.PgmChunks}
    for name, function in tables.items():
        spark.udtf.register(name, function)
    spark.dataSource.register(RepoTree)
    return [*NATIVE, *arrow, *tables, RepoTree.name()]
