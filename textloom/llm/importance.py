"""Quality by importance resampling.

Target text (rows labelled good) and raw text (all rows) are each modelled as a bag of hashed
n-grams. A document's importance is the ratio of the two models' likelihoods; adding Gumbel noise
to the logarithms and taking the k largest draws k documents without replacement in proportion to
importance. The noise is a hash of doc_id, so a draw can be repeated. The k-th largest key is found
exactly by counting keys in ever narrower ranges, not by sorting the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import spread, staged

BUCKETS = 10_000
#: Target rows the target model is fitted on, lowest hash of doc_id first.
TARGET = 10_000
SEED = 7
#: Ranges that one counting round tells apart.
RANGES = 1024


def _classes() -> np.ndarray:
    """0 white space and controls, 1 letters, digits and any byte of a longer character, 2 other signs."""
    kind = np.full(256, 2, dtype=np.uint8)
    kind[:33] = 0
    kind[127] = 0
    for c in range(128):
        if chr(c).isalnum():
            kind[c] = 1
    kind[128:] = 1
    return kind


KIND = _classes()
POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)


def hashed_ngrams(text: str | None) -> np.ndarray:
    """Buckets of the unigrams and bigrams of words and runs of signs, A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.int64)
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    kind = KIND[raw]
    first = np.concatenate(([True], kind[1:] != kind[:-1]))
    starts = np.flatnonzero(first)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    sums = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63], starts)[kind[starts] > 0]
    if not len(sums):
        return np.empty(0, dtype=np.int64)
    one = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] >> np.uint64(3))
    two = (two ^ (two >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (np.concatenate((one, two)) >> np.uint64(17)).astype(np.int64) % BUCKETS


def _count(rows: DataFrame) -> dict[str, np.ndarray]:
    """Bucket counts over all rows ('raw') and over rows with is_target ('target'); the driver gets 2 * BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(hashed_ngrams(text.as_py()), minlength=BUCKETS)
                sums[0] += n
                if target:
                    sums[1] += n
        for k in range(2):
            at = np.flatnonzero(sums[k])
            columns = np.full(len(at), k, dtype=np.int64), at, sums[k][at]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["model", "bucket", "n"])

    counted = rows.mapInArrow(run, "model long, bucket long, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect()
    out = {"raw": np.zeros(BUCKETS), "target": np.zeros(BUCKETS)}
    for r in counted:
        out["target" if r["model"] else "raw"][r["bucket"]] = r["n"]
    return out


def log_ratio(docs: DataFrame, target_ids: list[int], text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight): log of target over raw likelihood, a row per input row; 0 for a text without words."""
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i, True) for i in target_ids], "target_id long, is_target boolean")  # at most TARGET rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = own.join(F.broadcast(ids), own["doc_id"] == ids["target_id"], "left").select("text", "is_target")
    counts = _count(marked)
    p = {k: (v + 1) / (v.sum() + BUCKETS) for k, v in counts.items()}
    ratio = spark.sparkContext.broadcast(np.log(p["target"]) - np.log(p["raw"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [hashed_ngrams(t.as_py()) for t in batch.column(1)]
            n = pa.array([len(g) for g in grams], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([float(ratio.value[g].sum()) for g in grams], pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return spread(own).mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The exact k-th largest value of a double column: rounds of counts in RANGES ranges each."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0  # rows over the range in question
    while low < high:
        inside = rows.filter(F.col(key).between(low, high))
        width = (high - low) / RANGES
        # a range of a few neighbouring numbers is told apart by value: it has no more than RANGES of them
        fine = width == 0 or width <= math.ulp(max(abs(low), abs(high)))
        place = F.col(key) if fine else F.least(F.floor((F.col(key) - low) / width), F.lit(RANGES - 1))
        counted = inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()
        for r in sorted(counted, key=lambda r: -r["place"]):
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return high


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept), a row per input row; round(share * rows) rows are kept.

    share defaults to the share of good rows among the labelled ones: as many documents are drawn
    as are expected to be good. Texts without words have weight 0. Equal keys at the limit (rows
    that repeat a doc_id) are kept together. Rows with a null doc_id share one noise value. Without
    good labels the target model is flat, and without labels all rows are kept.
    """
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n_good, n_all = good.agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)), F.count("*")).first()
    ids = [r["doc_id"] for r in good.filter("quality > 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET).collect()]
    share = share if share is not None else (n_good or 0) / n_all if n_all else 1.0
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = staged(log_ratio(docs, ids).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit))), "weights")
    total = rows.count()
    k = round(share * total)
    if k <= 0 or not total:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(rows, "gumbel_key", k)))
