"""Streams of files: stages that look at one row run as they are; packs need whole repositories, which are kept in a table.

The state of a packing stream is a folder of Parquet tables, one per micro-batch, in shared storage: a repository may arrive
over any number of batches, its contents never pass through a state store or one task, and only repositories that a
batch touches are packed again. A batch that is run again after a failure writes its own table anew and gives the same packs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import same_keys
from ..plans.pack import packed_files
from ..plans.pack import pack as pack_batch
from ..schema import PackOptions


def transform_stream(files: DataFrame, options: PackOptions) -> DataFrame:
    """Filters, redaction, summaries, outlines and counts on a streaming FILE relation; a budget isn't row-wise."""
    if options.budget is not None:
        raise ValueError("a budget needs whole repositories: use pack_stream")
    return packed_files(files, options)


def pack_stream(files: DataFrame, options: PackOptions, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Pack every micro-batch as a whole and hand (documents, batch id) to `sink`; rows of a repository must come in one batch."""
    return files.writeStream.foreachBatch(lambda batch, number: sink(pack_batch(batch, options), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BATCH = "__batch"


def arrived(spark: SparkSession, state: str, batch: int) -> DataFrame:
    """The files of all batches up to this one. Of a path the latest row counts, within a batch the one with the larger content; a null content takes the path away."""
    rows = spark.read.parquet(f"{state}/{BATCH}=*").withColumn(BATCH, F.regexp_extract(F.input_file_name(), rf"{BATCH}=(\d+)/", 1).cast("long")).filter(F.col(BATCH) <= batch)
    names = [c for c in rows.columns if c != BATCH]
    latest = F.max_by(F.struct(*names), F.struct(BATCH, F.col("content").isNull(), "content")).alias("row")
    return rows.groupBy("repo_id", "path").agg(latest).select("row.*").filter("content IS NOT NULL")


def pack_changes(files: DataFrame, options: PackOptions, sink: Callable[[DataFrame, int], None], state: str, checkpoint: str) -> StreamingQuery:
    """Packs repositories as they grow: after each micro-batch `sink` gets (documents, batch id) of the repositories that it touched.

    `state` is a folder that all executors share; it keeps every file that has come, so delete it with `checkpoint`. However the
    files are split into batches, the last document of a repository is the one that a pack of all of them gives. A repository whose files are all taken
    away gets the empty pack.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state}/{BATCH}={number}")
        touched = spark.read.parquet(f"{state}/{BATCH}={number}").select("repo_id").distinct()
        if not touched.isEmpty():
            own = same_keys(arrived(spark, state, number), touched, ["repo_id"], "left_semi")
            sink(pack_batch(own, options, repos=touched), number)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
