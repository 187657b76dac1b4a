"""Packs of any size as part files.

A pack is a sequence of pieces, each ending in a line feed: the lines of the drawn tree, then a block per
file, with what stands around them. Pieces are stored in ranges of (repository, place), numbered
there, and every range is written as one text file by one task. A manifest says which bytes of
which part belong to which repository, and where they stand in its document: put together in order,
they are the text that `format.documents` gives. No task holds a repository, and none of its
rows is larger than a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import format as shape
from .order import RANGE, bases, before, ranged, same_keys
from .tree import tree_lines

#: Sections of a document, in order.
OPENING, TREE, MIDDLE, BLOCKS, CLOSING = range(5)
PLACE = ["section", "key", "digest"]


def pieces(files: DataFrame, kind: str = "xml", repo: str = "repo_id") -> DataFrame:
    """(repo, section, key, digest, text): what a document is made of, without separators and call numbers. Rows that repeat a path stand by their contents' digests."""
    none = F.array().cast("array<string>")
    digest = F.md5(F.coalesce(F.col("content"), F.lit(""))).alias("digest")
    repos = files.select(repo).distinct()
    fixed = lambda section, text: repos.select(repo, F.lit(section).alias("section"), none.alias("key"), F.lit("").alias("digest"), F.lit(text).alias("text"))
    own = files.select(repo, F.lit(BLOCKS).alias("section"), F.col("path_parts").alias("key"), digest, shape.block_of(kind).alias("text"))
    if kind == "tool-call":
        return fixed(OPENING, "[").unionByName(own).unionByName(fixed(CLOSING, "]"))
    before_tree, after_tree = ("<repository_structure>", "</repository_structure>\n") if kind == "xml" else ("# Repository Structure\n\n```", "```\n\n# Repository Files\n")
    drawn = tree_lines(files, repo).select(repo, F.lit(TREE).alias("section"), F.col("node").alias("key"), F.lit("").alias("digest"), F.col("line").alias("text"))
    return fixed(OPENING, before_tree + "\n.").unionByName(drawn).unionByName(fixed(MIDDLE, after_tree)).unionByName(own.withColumn("text", F.regexp_replace("text", r"\n\z", "")))


def _text(kind: str, number: Column, count: Column) -> Column:
    """A piece with its number and what separates it from the next; the writer adds the line feed."""
    block = F.col("section") == BLOCKS
    if kind == "tool-call":
        return F.when(block, F.concat(F.lit(shape.CALL), number.cast("string"), F.col("text"), F.when(number < count, ",").otherwise(""))).otherwise(F.col("text"))
    return F.when(block & (number < count), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))


def write_parts(files: DataFrame, path: str, kind: str = "xml", repo: str = "repo_id") -> DataFrame:
    """Writes `path`/parts/range_no=N/*.txt and `path`/manifest; returns the manifest.

    (repo, range_no, start, length, at): `length` bytes of part `range_no` from `start` on are bytes `at` and
    following of the repository's document. A repository has a row for each part it has a piece in. `path` must not exist.
    """
    spark = files.sparkSession
    # pieces read the files three times, so what the files are made from is read once before
    kept = staged(files.select(repo, "path", "path_parts", "content", "is_outlined"), "pack-files")
    stored = ranged(pieces(kept, kind, repo), repo, F.struct(*PLACE), "pack-pieces")
    block = (F.col("section") == BLOCKS).cast("long")
    counts = stored.groupBy(repo).agg(F.sum(block).alias("n"))
    numbered = same_keys(before(stored, repo, [F.col(c) for c in PLACE], block), counts, [repo])
    rows = numbered.select(repo, RANGE, *PLACE, _text(kind, F.col("before") + 1, F.col("n")).alias("value"))
    # a range is sorted by its task on the way to its file
    rows.repartition(spark.sparkContext.defaultParallelism * 4, RANGE).sortWithinPartitions(RANGE, repo, *PLACE).select(RANGE, "value").write.partitionBy(RANGE).text(f"{path}/parts")
    size = (F.octet_length("value") + 1).cast("long")
    lengths = rows.groupBy(repo, RANGE).agg(F.sum(size).alias("length"))
    at = bases(rows, repo, size).withColumnRenamed("base", "at")
    # within a part, repositories follow one another: sums over (part, repository)
    inside = before(lengths.withColumnRenamed(RANGE, "part").withColumn(RANGE, F.lit(0)), "part", [F.col(repo)], F.col("length")).drop(RANGE).withColumnsRenamed({"part": RANGE, "before": "start"})
    same_keys(inside, at, [repo, RANGE]).select(repo, RANGE, F.col("start").cast("long"), "length", F.col("at").cast("long")).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(repo columns of the manifest, at, body): the pieces of documents that a written pack holds, one row per part and repository; concatenated by `at` they are the documents."""
    number = F.regexp_extract("path", r"/range_no=(\d+)/[^/]*$", 1).cast("int")
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/parts").select(number.alias(RANGE), "content")
    manifest = spark.read.parquet(f"{path}/manifest")
    cut = F.substring(F.col("content"), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    return manifest.join(parts, RANGE).select(*[c for c in manifest.columns if c not in (RANGE, "start", "length")], cut.alias("body"))
