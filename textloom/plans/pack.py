"""The whole pack: filter, read, transform, count, fit, format. Narrow until the budget and the final text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lockfiles, outline, paths, redact, tokens, workflow
from ..operators import budget as fit
from ..operators import files as ops
from ..operators import format as shape
from ..schema import PackOptions, format_name
from ..sources.listing import Walk, list_tree, with_contents
from ..sources.repo_tree import git_status
from ..staging import spread


def _renamed(path: Column, extension: str) -> Column:
    """The path with another extension behind its stem."""
    return F.concat(F.regexp_replace(path, r"(?s)(?<=[^/])\.[^./]*$", ""), F.lit("." + extension))


def transformed(files: DataFrame, options: PackOptions) -> DataFrame:
    """Redaction, then summaries of lockfiles and workflows, else outlines: one projection, no shuffle.

    A lockfile without a reader drops out when lockfiles are summarised; a summary over the size
    limit does, too, while outlines aren't measured again.
    """
    path, content = F.col("path"), F.col("content")
    out = files.withColumn("content", redact.redact_secrets(content)) if options.redact_secrets else files
    # a summary takes the place of an outline, and such a file isn't marked as outlined
    summarised: Column = F.lit(False)
    if options.summary_locks:
        lock = paths.is_lockfile(path)
        json = ~lock & (paths.ascii_lower(paths.extension(path)) == "json") & workflow.is_workflow(content)
        readable = lock & paths.file_name(path).isin(*paths.PARSED_LOCKFILES)
        out = out.withColumn("deps", F.when(readable, shape.manifest(lockfiles.dependencies(path, content)))).withColumn("graph", F.when(json, workflow.manifest(F.when(json, content))))
        out = out.filter(~lock | F.col("deps").isNotNull()).withColumn("summary", F.coalesce("deps", "graph"))
        out = out.withColumn("path", F.when(F.col("deps").isNotNull(), _renamed(path, "deps.txt")).when(F.col("graph").isNotNull(), _renamed(path, "workflow.txt")).otherwise(path))
        summarised = F.col("summary").isNotNull()
        if options.max_file_size is not None:
            out = out.filter(~summarised | (F.octet_length("summary") <= options.max_file_size))
        out = out.withColumn("content", F.coalesce("summary", "content"))
    if options.outline:
        out = out.withColumn("content", F.when(summarised, F.col("content")).otherwise(outline.outline(F.col("content"), F.col("path")))).withColumn("is_outlined", ~summarised)
    out = out.withColumn("path_parts", paths.parts(F.col("path"))).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return out.select(files.columns)


def packed_files(files: DataFrame, options: PackOptions | None = None, changed: DataFrame | None = None) -> DataFrame:
    """The files of a pack, from a FILE relation with text content."""
    options = options or PackOptions()
    own = ops.changed_only(files, changed) if changed is not None else files
    own = own.filter(ops.path_filter(options)).filter(ops.size_filter(options))
    own = transformed(spread(own) if options.budget is not None else own, options)
    count = lambda c: tokens.counted(c, options.token_profile, options.encoder)
    if options.count_tokens and options.budget is None:
        own = own.withColumn("token_count", count(F.col("content")))
    if options.budget is not None:
        # the estimate costs nothing twice; a real encoder's counts are taken along
        own = own.withColumn("token_count", F.lit(None).cast("bigint") if options.encoder is None else count(F.col("content")))
        fitted = fit.fit_budget(own, options.budget, outline.outline(F.col("content"), F.col("path")), count=count).filter("kept")
        own = fitted.select(
            *[c for c in own.columns if c not in ("content", "size_bytes", "token_count", "is_outlined")],
            F.octet_length("content_fit").cast("bigint").alias("size_bytes"), F.col("content_fit").alias("content"), F.col("tokens_fit").alias("token_count"), (F.col("is_outlined") | F.col("outlined")).alias("is_outlined"),
        ).select(own.columns)
    return own


def pack(files: DataFrame, options: PackOptions | None = None, changed: DataFrame | None = None, repos: DataFrame | None = None) -> DataFrame:
    """(repo_id, document): one text per repository in the asked format; those of `repos` without a file get the empty pack."""
    options = options or PackOptions()
    return shape.documents(packed_files(files, options, changed), format_name(options.format), repos=repos)


def tree_files(spark: SparkSession, root: str, options: PackOptions | None = None, ignore_file: str = ".packignore", gitignore: bool = True, changed: DataFrame | None = None) -> DataFrame:
    """FILE relation of a source tree, binary and non-UTF-8 files left out.

    The tree is listed first; only files that the path rules, the size limit and the change set leave are opened.
    """
    options = options or PackOptions()
    meta = list_tree(spark, root, Walk(options.max_depth, options.include_hidden, gitignore, (ignore_file,) if ignore_file else ()))
    meta = ops.changed_only(meta, changed) if changed is not None else meta
    rows = with_contents(meta.filter(ops.path_filter(options)).filter(ops.size_filter(options)))
    rows = rows.filter(ops.text_filter(F.col("content")))
    return rows.select("repo_id", "path", "path_parts", "size_bytes", F.col("content").cast("string").alias("content"), F.lit(None).cast("bigint").alias("token_count"), F.lit(False).alias("is_outlined"))


def changed_files(spark: SparkSession, root: str, staged: bool = False) -> DataFrame:
    return ops.git_changes(git_status(spark, root), staged)
