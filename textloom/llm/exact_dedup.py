"""Exact deduplication by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of `block_bytes` bytes. The distinct blocks are sorted and numbered,
so equal blocks, and only those, share an integer name. Adjacent names are then paired, the
distinct pairs are sorted and numbered in turn, and so on until one name is left for a document.
Documents that end at the same level with the same name are equal, byte for byte: no hash decides.

What travels: the block contents are shuffled once, pre-aggregated, to be named. Documents look
names up by two 64-bit hashes of a block; the naming table itself proves that no two distinct
blocks share such a pair (otherwise the next seed is taken), so the look-up is exact. Levels above
move integers only. A group of any size is met by partial aggregates and by joins that the
adaptive planner can split, never by one task that holds the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged
from .survivors import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does just that, and faster, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _blocks(norm: Column, size: int) -> Column:
    """The text's blocks as binary; an empty text has one empty block."""
    raw = norm.cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(norm) - 1) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _keys(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Number distinct rows: sorted in each hash partition, partition number in the high bits."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Table (h1, h2, name) of all distinct blocks, and the seed under which (h1, h2) is a key."""
    seed = 0
    while True:
        blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block"))
        h1, h2 = _keys(F.col("block"), seed)
        distinct = blocks.select(h1.alias("h1"), h2.alias("h2"), "block").distinct()
        names = staged(_numbered(distinct, "block").select("h1", "h2", "name"), "block-names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            return names, seed
        seed += 1


def _pair_names(rest: DataFrame) -> DataFrame:
    """One naming round: documents with about half as many names each."""
    half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
    pairs = rest.select(
        "doc_id", "text_sha256", "copies",
        F.posexplode(F.transform(half, lambda i: F.struct(
            F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias("pos", "pair"),
    ).select("doc_id", "text_sha256", "copies", "pos", "pair.a", "pair.b")
    names = staged(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
    named = pairs.join(names, ["a", "b"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("doc_id", "text_sha256", "copies").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def text_identities(docs: DataFrame, text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Collision-free identity of each normalised text.

    Returns (doc_id, text_sha256, copies, level, name): rows with the same (level, name) have equal
    texts and no others do. `copies` counts rows that repeat both doc_id and text; they share one
    row here. A null text counts as empty. `text_sha256` is carried for reports; besides keying a
    document's own rows it decides nothing.
    """
    texts = docs.select("doc_id", fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    names, seed = _block_names(texts, block_bytes)

    def keyed(b: Column) -> Column:
        h1, h2 = _keys(b, seed)
        return F.struct(h1.alias("h1"), h2.alias("h2"))

    cut = texts.select(
        "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.posexplode(F.transform(_blocks(F.col("norm"), block_bytes), keyed)).alias("pos", "k"),
    ).select("doc_id", "text_sha256", "pos", "k.h1", "k.h2")
    named = cut.join(names, ["h1", "h2"])
    ordered = F.array_sort(F.collect_set(F.struct("pos", "name")))
    rest = staged(
        named.groupBy("doc_id", "text_sha256").agg(
            F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"),
            F.transform(ordered, lambda x: x["name"]).alias("names")),
        "names-0")
    done, level = [], 0
    while True:
        done.append(rest.filter(F.size("names") == 1).select("doc_id", "text_sha256", "copies", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = rest.filter(F.size("names") > 1)
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        level += 1
        rest = staged(_pair_names(rest), f"names-{level}")


def exact_duplicates(docs: DataFrame, text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), a row per input row.

    Of equal texts the largest doc_id stays (ties: every row that repeats it). Null texts equal
    empty ones. A null doc_id never wins over a number; in a group without any number keep_id is
    null and its rows stay. An empty table gives an empty result; other columns are not read.
    """
    ids = text_identities(docs, text_col, block_bytes)
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = staged(groups, "groups")  # a plain scan on this side lets the adaptive planner split a hot group of the join
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return (
        ids.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts; all columns stay.

    The row with the largest doc_id stays, one without a doc_id only in a group without any; of rows that repeat it, one.
    """
    ids = text_identities(docs, text_col)
    groups = staged(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id")), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    judged = staged(ids.join(groups, ["level", "name"]).select("doc_id", F.col("text_sha256").alias("text_key"), "copies", stays.alias("stays")).filter("not stays or copies > 1"), "exact-judged")
    again = judged.filter("stays").withColumn("copy", F.explode(F.array_repeat(F.lit(0), 2)))  # told apart from those that stand once
    return without(docs, judged.filter(~F.col("stays")), again, F.sha2(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256), text_col)
