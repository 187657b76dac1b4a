"""Order within a repository of any size: rows are stored in ranges, and only a range is ever sorted by one task.

Rows of (repo, key) are range-partitioned and written with the number of their range. Sums by
(repo, range) are small; running sums over these give what stands before a range, and only inside a
range does a window look at rows. A repository that holds a third of all rows is spread over as
many ranges as any other rows would be. A missing repo is a repository like any other: all joins here
are null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

RANGE = "range_no"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which a null key meets null keys; the keys appear once."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    out = left.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


def ranged(rows: DataFrame, repo: str, key: Column, tag: str, stored: bool = False) -> DataFrame:
    """`rows` stored in order of (repo, key), with the number of the range that a row is in. Equal keys share a range.

    They are stored as they come first, unless they are `stored`: ranges are sampled, and what the rows are made from should be read once.
    """
    return staged((rows if stored else staged(rows, tag)).repartitionByRange(repo, key).withColumn(RANGE, F.spark_partition_id()), f"{tag}-ranged")


def bases(stored: DataFrame, repo: str, value: Column) -> DataFrame:
    """(repo, range_no, base): sum of `value` over the repository's earlier ranges."""
    sums = stored.groupBy(repo, RANGE).agg(F.sum(value).alias("base_sum"))
    earlier = Window.partitionBy(repo).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(repo, RANGE, F.coalesce(F.sum("base_sum").over(earlier), F.lit(0)).alias("base"))


def before(stored: DataFrame, repo: str, order: list[Column], value: Column) -> DataFrame:
    """`stored` (from `ranged` by the same order) with before: sum of `value` over the repository's earlier rows.

    Rows that are equal in `order` follow one another in any order.
    """
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(repo, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return same_keys(stored.withColumn("inside", inside), bases(stored, repo, value), [repo, RANGE]).withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside")


def last_spent(stored: DataFrame, repo: str, key: str, value: str, need: DataFrame) -> DataFrame:
    """(repo, cut): walking a repository's rows by `key`, largest first, the key at which `value` has added up to its `need`.

    need: (repo, need). The walk takes a row while the sum before it is below the need, so the rows
    taken are those with key >= cut. Repositories whose need isn't positive have no row here.
    `stored` comes from `ranged` by descending key.
    """
    spent = same_keys(bases(stored, repo, F.col(value)), need.filter("need > 0"), [repo]).filter("base < need")
    at = spent.groupBy(repo).agg(F.max(RANGE).alias(RANGE), F.max("base").alias("base"), F.max("need").alias("need"))
    inside = Window.partitionBy(repo).orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = same_keys(stored, at, [repo, RANGE]).withColumn("spent", F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.filter("spent < need").groupBy(repo).agg(F.min(key).alias("cut"))


def numbered(rows: DataFrame, repo: str, order: list[str], tag: str = "places") -> DataFrame:
    """`rows` with number: the 1-based place of each row of a repository by the columns `order`; rows equal in all of these are numbered one after another.

    The rows are stored as they are, contents included, and moved once: to their ranges.
    """
    stored = ranged(rows, repo, F.struct(*order), tag)
    return before(stored, repo, [F.col(c) for c in order], F.lit(1)).withColumn("number", F.col("before") + 1).drop("before", RANGE)
