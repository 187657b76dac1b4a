"""Output: a block per file, and whole packs by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from . import order
from .tree import draw


def xml_block(path: Column, content: Column, outlined: Column) -> Column:
    """<file path="..">, the content as it is with a final line feed, </file>."""
    mark = F.when(outlined, '" outline="true">\n').otherwise('">\n')
    return F.concat(F.lit('<file path="'), path, mark, text.with_newline(content), F.lit("</file>\n"))


def markdown_block(path: Column, content: Column) -> Column:
    f = text.fence(content)
    return F.concat(F.lit("## File: "), path, F.lit("\n\n"), f, paths.language_hint(path), F.lit("\n"), text.with_newline(content), f, F.lit("\n"))


#: What stands before a call's number.
CALL = '  {\n    "role": "tool",\n    "tool_call_id": "call_read_file_'


def tool_rest(path: Column, content: Column) -> Column:
    """A tool message behind its number."""
    return F.concat(F.lit('",\n    "name": "read_file",\n    "path": "'), text.json_escape(path), F.lit('",\n    "content": "'), text.json_escape(content), F.lit('"\n  }'))


def tool_block(path: Column, content: Column, number: Column) -> Column:
    """A tool message as JSON, without what separates it from the next."""
    return F.concat(F.lit(CALL), number.cast("string"), tool_rest(path, content))


#: Rows that repeat a path stand in this order.
DIGEST = "__digest"


def numbered(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Adds number: the 1-based place of each row in path order; rows that repeat a path follow one another by their contents' digests."""
    content = F.md5(F.coalesce(F.col("content"), F.lit(""))) if "content" in files.columns else F.lit("")
    return order.numbered(files.withColumn(DIGEST, content), repo, ["path_parts", DIGEST], "numbered").drop(DIGEST)


def block_of(kind: str) -> Column:
    """A file's block; for tool calls the part behind the number."""
    path, content = F.col("path"), F.col("content")
    if kind == "tool-call":
        return tool_rest(path, content)
    return xml_block(path, content, F.coalesce(F.col("is_outlined"), F.lit(False))) if kind == "xml" else markdown_block(path, content)


def blocks(files: DataFrame, kind: str = "xml", repo: str = "repo_id") -> DataFrame:
    """(repo, path, path_parts, block), a row per file; `operators.parts` writes repositories too large for one text."""
    if kind == "tool-call":
        return numbered(files, repo).select(repo, "path", "path_parts", tool_block(F.col("path"), F.col("content"), F.col("number")).alias("block"))
    return files.select(repo, "path", "path_parts", block_of(kind).alias("block"))


def documents(files: DataFrame, kind: str = "xml", repo: str = "repo_id", repos: DataFrame | None = None) -> DataFrame:
    """(repo, document): one text per repository, blocks in path order behind the drawn tree.

    One aggregation gathers paths and blocks; the tree is drawn from the same rows. A text is one
    row, so a repository must fit a row (2 GB); beyond that use `operators.parts`. Repositories listed in
    `repos` that have no file get the empty pack; others have no row.
    """
    digest = F.md5(F.coalesce(F.col("content"), F.lit(""))).alias("digest")
    rows = F.array_sort(F.collect_list(F.struct("path_parts", digest, "path", block_of(kind).alias("block"))))
    gathered = files.groupBy(repo).agg(rows.alias("rows"))
    if kind == "tool-call":
        calls = F.transform("rows", lambda x, i: F.concat(F.lit(CALL), (i + 1).cast("string"), x["block"]))  # a number is a place in path order
        packs = gathered.select(repo, F.concat(F.lit("[\n"), F.array_join(calls, ",\n"), F.lit("\n]\n")).alias("document"))
    else:
        before, after = ("<repository_structure>\n", "</repository_structure>\n\n") if kind == "xml" else ("# Repository Structure\n\n```\n", "```\n\n# Repository Files\n\n")
        named = F.transform(F.filter("rows", lambda x: ~x["path"].isin("", ".")), lambda x: x["path_parts"])
        drawn = gathered.select(repo, draw(named).alias("tree"), F.array_join(F.transform("rows", lambda x: x["block"]), "\n").alias("body"))
        packs = drawn.select(repo, F.concat(F.lit(before), "tree", F.lit(after), "body").alias("document"))
    if repos is None:
        return packs
    return order.same_keys(repos.select(repo).distinct(), packs, [repo], "left").select(repo, F.coalesce("document", F.lit(EMPTY[kind])).alias("document"))


#: Packs without a file.
EMPTY = {"xml": "<repository_structure>\n.\n</repository_structure>\n", "markdown": "# Repository Structure\n\n```\n.\n```\n\n# Repository Files\n", "tool-call": "[]\n"}


def manifest(dependencies: Column) -> Column:
    """`name @ version` lines of a sorted dependency array."""
    return F.concat_ws("", F.transform(dependencies, lambda d: F.concat(d["name"], F.lit(" @ "), d["version"], F.lit("\n"))))


def stats_line(count: Column, size: Column, tokens: Column) -> Column:
    """`42 files (142.6 KB, 38120 tokens)`; tokens may be null."""
    return F.concat(count.cast("string"), F.lit(" files ("), text.size_long(size), F.when(tokens.isNotNull(), F.concat(F.lit(", "), tokens.cast("string"), F.lit(" tokens"))).otherwise(""), F.lit(")"))


def preview(outlined_paths: Column, shown: int = 5) -> Column:
    """The first paths of a sorted array and how many more there are."""
    more = F.size(outlined_paths) - shown
    return F.concat(F.array_join(F.slice(outlined_paths, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
