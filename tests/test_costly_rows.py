"""Rows that each make much work are dealt over the cores, and work that repeats is done once."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.functions import highlight
from textloom.plans import catalogue

LINES = ["fn f() {", "}", "", None, "  let s: str = 'é'; // n", "}", "x", "fn f() {"]
LANGS = ["rust", "rust", "c", "rust", "java", "go", None, "elvish"]


def test_highlight_reads_a_line_once(monkeypatch):
    calls, own = [], highlight.spans
    monkeypatch.setattr(highlight, "spans", lambda line, lang: calls.append((line, lang)) or own(line, lang))
    got = highlight.highlighted(pa.array(LINES * 3), pa.array(LANGS * 3))
    assert [[(s["text"], s["kind"]) for s in row] for row in got.to_pylist()] == [own(a or "", b or "") for a, b in zip(LINES, LANGS, strict=True)] * 3
    assert len(calls) == len(set(calls)) == len({(a or "", b or "") for a, b in zip(LINES, LANGS, strict=True)})
    assert len(highlight.highlighted(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_highlight_column(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(LINES, LANGS, strict=True))], "k int, line string, lang string")
    got = {r["k"]: [tuple(s) for s in r["x"]] for r in df.select("k", highlight.highlight("line", "lang").alias("x")).collect()}
    assert got == {k: highlight.spans(a or "", b or "") for k, (a, b) in enumerate(zip(LINES, LANGS, strict=True))}


@pytest.mark.parametrize("name", ["highlight_lines", "outline_rust", "outline_generic", "lock_cargo"])
def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path, name):
    # one row group, of which Spark makes several splits: all rows are in one of them
    rows = 40_000
    pq.write_table(pa.table({"p_partkey": pa.array(range(rows), pa.int64()), "p_size": pa.array([k % 50 for k in range(rows)], pa.int32()), "p_name": pa.array([f"{k * 7919:064b}" * 8 for k in range(rows)])}), tmp_path / "part.parquet", compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        sizes = [r["count"] for r in catalogue.queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4
