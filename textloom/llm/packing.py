"""Sum-of-squares packing of documents into sequences of `size` tokens.

The rule: put each piece where the sum, over residual gaps g, of the squared number of open bins
with gap g becomes smallest. It is applied piece by piece, longest first, to every piece; a bin is opened only
when none has room (weighing a new bin by the rule, too, took 12903 sequences where this takes 12863,
the lower bound, on the lengths of the 0.1 GB table).

Spark encodes the texts once (written to the shared folder). Pieces that fill a sequence are one by
themselves. The others are dealt by hash into shards of about SHARD pieces, each packed by a task of
its own: a shard's rows (lengths and keys, no ids) are bounded whatever the corpus and however often
a length occurs, and no plan has to be sent anywhere. Sharding costs the few bins that each shard leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .scratch import spread, staged

SIZE = 4096
#: Pieces of a shard, on average.
SHARD = 50_000


def place(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece, in the given order; lengths are 1 to `size`.

    Of the open bins with room, the gap is chosen by the change of the sum of squares that the
    piece makes: 2 (n[g-s] - n[g] + 1) for a gap g, 1 - 2 n[s] for one that it closes, n[g] being
    the number of open bins with gap g. Ties take the smallest gap, then the bin opened (or filled) last.
    """
    open_bins = np.zeros(size + 1, dtype=np.int64)
    held: list[list[int]] = [[] for _ in range(size + 1)]  # bins by gap
    never = np.iinfo(np.int64).max
    bins, offsets, opened = [], [], 0
    for s in lengths:
        gaps = open_bins[s:size]
        gap = size
        if len(gaps):
            after = open_bins[: size - s].copy()  # at gap 0 no bin is open
            delta = 2 * (after - gaps + 1)
            delta[0] = 1 - 2 * gaps[0]
            delta[gaps == 0] = never
            best = int(delta.argmin())
            if gaps[best]:
                gap = s + best
        if gap == size:
            own, opened = opened, opened + 1
        else:
            own = held[gap].pop()
            open_bins[gap] -= 1
        bins.append(own)
        offsets.append(size - gap)
        if gap > s:
            held[gap - s].append(own)
            open_bins[gap - s] += 1
    return bins, offsets


def encoded_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = SIZE, text_col: str = "text") -> DataFrame:
    """(doc_id, copy_key, piece, start, length, ids): each text's ids (little-endian uint32) and the end id, cut into pieces."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("copy_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, row = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId() << 33
        cols: list[list] = [[] for _ in schema]
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode([text.as_py()])[0] + end
                row += 1
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    ids = raw[at : at + 4 * size]
                    for c, v in zip(cols, (doc_id, row, k, k * size, len(ids) // 4, ids), strict=True):
                        c.append(v)
                held += len(raw)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
                    cols, held = [[] for _ in schema], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return spread(own).mapInArrow(run, "doc_id long, copy_key long, piece int, start long, length long, ids binary")


def placed(pieces: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """`pieces` (doc_id, copy_key, piece, length, ids_crc32, start) with sequence_id and offset.

    `pieces` must be a stored table. Order in a shard: longest first, then doc_id, row and piece.
    Sequences have no gaps: offset is the sum of the lengths placed before.
    """
    keys = ["doc_id", "copy_key", "piece", "start", "length", "ids_crc32"]
    own = pieces.select(*keys)
    short = own.filter(F.col("length") < size)
    n = max(1, -(-short.count() // shard))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy_key", "piece"), F.lit(n)).cast("int"))
    out = pa.schema([("doc_id", pa.int64()), ("copy_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(rows: pa.Table) -> pa.Table:
        by = pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("copy_key", "ascending"), ("piece", "ascending")])
        rows = rows.take(by)
        bins, offsets = place(rows["length"].to_pylist(), size)
        ids = np.array(bins, dtype=np.int64) * n + rows["shard"][0].as_py()  # even: whole sequences have the odd numbers
        return rows.drop_columns("shard").append_column("sequence_id", pa.array(2 * ids)).append_column("offset", pa.array(offsets, pa.int64())).cast(out)

    packs = dealt.groupBy("shard").applyInArrow(pack, "doc_id long, copy_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = own.filter(F.col("length") == size).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packs.unionByName(full)


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row per piece.

    A null or empty text is one piece, the end id alone. Only documents over `size` tokens are cut.
    Repeated rows are packed each. A null doc_id stays null. An empty table gives an empty result.
    """
    table = staged(encoded_pieces(docs, vocabulary, end_id, size), "pieces")
    rows = placed(table.withColumn("ids_crc32", F.crc32("ids")), size)
    if with_ids:
        rows = rows.join(table.select("copy_key", "piece", "ids"), ["copy_key", "piece"])
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
