"""File relations from tables, filters on them, change sets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import PackOptions


def as_files(rows: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """A FILE relation from any table."""
    return rows.select(
        repo.alias("repo_id"), path.alias("path"), paths.parts(path).alias("path_parts"), F.octet_length(content).cast("bigint").alias("size_bytes"),
        content.alias("content"), F.lit(None).cast("bigint").alias("token_count"), F.lit(False).alias("is_outlined"),
    )


def path_filter(options: PackOptions) -> Column:
    """All rules on the path alone, cheapest first: depth, hidden, skip rules, excludes, includes."""
    path = F.col("path")
    keep = ~paths.should_skip(path, options.summary_locks)
    if options.max_depth is not None:
        keep = (paths.depth(path) <= options.max_depth) & keep
    if not options.include_hidden:
        keep = keep & ~paths.is_hidden(path)
    if options.exclude:
        keep = keep & ~paths.matches_any(path, options.exclude)
    if options.include:
        keep = keep & paths.matches_any(path, options.include)
    return keep


def size_filter(options: PackOptions) -> Column:
    """The raw size limit; lockfiles that will be summarised are exempt."""
    if options.max_file_size is None:
        return F.lit(True)
    small = F.col("size_bytes") <= options.max_file_size
    return small | paths.is_lockfile(F.col("path")) if options.summary_locks else small


def is_binary(data: Column, limit: int = 8192) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(data, 1, limit)) > 0


def text_filter(data: Column) -> Column:
    """Neither binary nor invalid UTF-8."""
    return ~is_binary(data) & F.is_valid_utf8(data.cast("string"))


def changed_only(files: DataFrame, changed: DataFrame, most: int = 200_000) -> DataFrame:
    """Files whose path is in the change set (one column, path). The set is broadcast if it has at most `most` rows."""
    small = changed.select("path").distinct()
    return files.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, "path", "left_semi")


def skipped(files: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Files that a pack left out."""
    return files.join(kept.select(*keys), list(keys), "left_anti")


def summary(files: DataFrame, repo: str | None = None) -> DataFrame:
    """file_count, total_bytes, total_tokens, of all or by repository."""
    total = [F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.sum("token_count").alias("total_tokens")]
    return files.groupBy(repo).agg(*total) if repo else files.agg(*total)


def git_changes(lines: DataFrame, staged: bool = False, line: str = "line") -> DataFrame:
    """(path): change set of `git status --porcelain` lines.

    Of a rename the new name counts; quotes around a name go. Deleted and ignored files don't
    count; with `staged` only what stands in the index does.
    """
    text = F.col(line)
    x, y = F.substring(text, 1, 1), F.substring(text, 2, 1)
    if staged:
        wanted = ~x.isin(" ", "?", "!", "D") & (y != "D")
    else:
        wanted = ((x != " ") | (y != " ")) & ~x.isin("!", "D") & ~y.isin("!", "D")
    named = F.trim(F.regexp_replace(F.substring(text, 4, 1 << 20), "^.* -> ", ""))
    bare = F.regexp_replace(named, '^"(.*)"$', "$1")
    return lines.filter((F.octet_length(text) >= 4) & wanted).select(bare.alias("path")).filter("path != ''").distinct()
