"""Intermediate tables in the folder that all executors share.

A stage that is costly, or whose rows must not change when a lost executor's tasks run again, is
written here as Parquet and read back: that cuts the lineage at files which outlive any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: A table of at most so many rows may be broadcast.
SMALL = 200_000
_made: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("textloom_scope", default=None)
#: Nodes of a logical plan whose rows have been dealt out already, or stand in the driver.
DEALT = frozenset("Join Aggregate Sort Window WindowGroupLimit Repartition RepartitionByExpression RebalancePartitions Distinct Deduplicate LocalRelation LogicalRDD FlatMapGroupsInPandas FlatMapGroupsInArrow FlatMapCoGroupsInPandas FlatMapCoGroupsInArrow GlobalLimit".split())


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Unset, a session on one machine gets a temporary folder; a cluster must name one."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/textloom-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that this thread makes inside; an outer scope gets them, too, when it ends."""
    made: list[str] = []
    outer, token = _scope.get(), _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        if outer is not None:
            outer += made


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder once and return the written table."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(plan) -> bool:
    """Whether the rows of a plan come from more than scans; nodes are told by their types, so names of columns don't matter."""
    children = plan.children()
    return plan.getClass().getSimpleName() in DEALT or any(_dealt(children.apply(k)) for k in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """A plain scan that Spark reads in fewer tasks than there are cores, dealt over all cores; anything else as it is.

    Files of a single row group can't be split, and costly work on their rows would keep one core busy.
    Large tables have more splits than cores and are never moved.
    """
    if df.isStreaming or _dealt(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows, each of which makes much work, dealt over all cores whatever their scan looks like.

    A row group is read by one task. Millions of keys fit into one, and of the splits that Spark makes of its file all others are empty,
    so that the number of splits says nothing. The rows should hold the few columns that are needed, for all of them are moved.
    """
    return df if df.isStreaming else df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def held() -> frozenset[str]:
    """What this process has written here and not deleted."""
    return frozenset(_made)


def clear(spark: SparkSession, keep: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> int:
    """Delete what this process has written here (of that, `only` these), but for `keep`; once results derived from it are stored."""
    conf = spark._jsc.hadoopConfiguration()
    gone = [name for name in _made if name not in keep and (only is None or name in only)]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _made.remove(name)
    return len(gone)
