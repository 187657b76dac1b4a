"""Taking rows out of a table by what they are: doc_id and text, whether doc_ids are missing or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import SMALL, staged

KEY = "__text_key"


def text_key(text: Column) -> Column:
    """Points at a text; a null text has a key of its own."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def without(docs: DataFrame, gone: DataFrame, stays: DataFrame, key: Column, text_col: str = "text") -> DataFrame:
    """`docs` without the rows of `gone` (doc_id, text_key), and with one row for each that `stays` (doc_id, text_key) repeats.

    `key` is the documents' text_key. Rows that repeat doc_id and key are one: the copy with the
    smallest text is kept, picked by partial aggregates. Deletions meet the documents by doc_id and
    key, so neither a missing nor a repeated doc_id takes other rows along; at most SMALL of them are broadcast.
    """
    match = lambda df: df.select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__gone_key"))
    small = lambda df: F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
    keyed = docs.withColumn(KEY, key)
    on = [keyed["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")), F.col(KEY) == F.col("__gone_key")]
    repeats = staged(match(stays.groupBy("doc_id", "text_key").count().filter("count > 1")), "repeats")
    out = staged(match(gone).distinct().union(repeats), "gone")
    left = keyed.join(small(out), on, "left_anti").select(docs.columns)
    if repeats.isEmpty():
        return left
    again = keyed.join(small(repeats), on, "left_semi")
    first = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce(F.col(text_col), F.lit(""))).alias("row")
    return left.union(again.groupBy(F.col("doc_id").alias("__doc_id"), KEY).agg(first).select("row.*"))
