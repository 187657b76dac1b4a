"""Importance resampling towards a target by a dictionary of distinct features.

Features are the runs of one and two words. Documents are read in chunks of bounded size. A chunk
counts its features as numbers, and hands two things on: its distinct features as strings with their
counts, dealt into parts by the strings, and each document's counts of the chunk's feature numbers.
In a part every distinct string of the corpus meets its counts from all chunks, is counted as a whole
and hashed once; each chunk gets back the buckets of its own strings and turns its documents' feature
counts into bucket counts, which are stored. Once the buckets of all parts are added up, their gains
are known and joined to these.

A feature travels once per chunk and not once per occurrence, so the most common word of the corpus is
as light as any other, and no task holds more than a chunk or a part. Strings decide which features
are the same; the number that deals them into parts only says where they meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .decontaminate import TABLE
from .scratch import spread, staged

BUCKETS = 10_000
#: Bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 12_000_000
#: Percent of the documents of at least LEAST words that are drawn.
PERCENT, LEAST = 25, 20
SEED = 7
#: Strings that are hashed at a time.
SLICE = 50_000
#: Compression of the strings.
LEVEL = 6
#: Kinds of a chunk's rows: features of raw text, features of target text, counts of documents.
RAW, TARGET, DOCUMENTS = 0, 1, 2

PIECE = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int64()), ("body", pa.binary()), ("counts", pa.binary())])
#: A document with its buckets, or (is_row: false) all that a part counts by bucket.
COUNTED = pa.schema([("is_row", pa.bool_()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
WEIGHED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers as `width` bytes each; the bytes of one place stand together, for they are alike."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def packed(numbers: np.ndarray) -> bytes:
    """Compressed whole numbers of at least 0, behind a byte that says how many bytes each takes."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.compress(planes(numbers, width), 3)


def unpacked(data: bytes) -> np.ndarray:
    return from_planes(zstandard.decompress(data[1:]), data[0])


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, A-Z lower-cased, and how many each text has."""
    raw = np.frombuffer(b"".join([t.translate(TABLE) for t in texts]), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    inside = raw != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.append(0, ends[:-1])
    first = first[first < len(raw)]
    begins[first] = inside[first]  # a text begins anew, whatever stands before it
    at, held = np.flatnonzero(begins), np.cumsum(inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    offsets = np.append(held[at] - 1, held[-1:])
    del held, begins
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(raw[inside])]) if len(at) else pa.array([], pa.large_binary())
    return words, np.diff(np.searchsorted(at, np.append(0, ends)))


def _dealt(words: list[bytes], left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    """The part of each feature of one word (right is -1) or two."""
    own = np.array([zlib.adler32(w) * 2654435761 + zlib.crc32(w) for w in words], dtype=np.uint64)
    mixed = own[left] * np.uint64(0x9E3779B97F4A7C15) + np.where(right < 0, np.uint64(0), (own[right] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values in ascending order, the values so ordered (in their own memory), and where each distinct one begins.

    Value and place fit one number unless both are large; sorting these is several times faster than sorting places.
    """
    bits = max(1, len(values)).bit_length()
    if int(values.max(initial=0)).bit_length() + bits < 63:
        values <<= bits
        values += np.arange(len(values), dtype=np.int32 if bits < 32 else np.int64)
        values.sort()
        order = (values & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
        values >>= bits
    else:
        order = np.argsort(values, kind="stable")
        values = values[order]
    return order, values, np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def chunk_pieces(chunk: int, keys: list[int | None], texts: list[bytes], parts: int, kind: int) -> Iterator[tuple]:
    """PIECE rows of one chunk of (doc_id, text).

    Features are numbered in order of (part, left word, right word), so the buckets that come back part by part are in order of these
    numbers. A part's strings end in line feeds, which no word holds.
    """
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # by name, so that neighbours share their beginnings
    names = coded.dictionary.take(pa.array(order))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    ids = place[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.empty(0, np.int64)
    del words, coded
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    doc = np.concatenate((doc, doc[pair]))
    width = len(order) + 1
    codes = np.empty(len(doc), dtype=np.int64)  # left word, right word plus one (none: 0)
    np.multiply(ids, width, out=codes[: len(ids)])
    codes[len(ids) :] = codes[pair]
    codes[len(ids) :] += ids[pair + 1]
    codes[len(ids) :] += 1
    del ids, pair
    order, codes, first = in_order(codes)
    doc = doc[order]
    del order
    counts = np.diff(np.append(first, len(codes)))
    left, right = np.divmod(codes[first], width)
    right -= 1
    del codes
    part = _dealt(names.to_pylist(), left, right, parts)
    by_part = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    local = np.empty(len(first), dtype=np.int32)
    local[by_part] = np.arange(len(first), dtype=np.int32)
    number = np.repeat(local, counts) if kind == RAW else local
    counts = counts[by_part]
    del local
    end = pa.scalar(b"\n", pa.large_binary())
    for p, (a, b) in enumerate(pairwise(np.searchsorted(part[by_part], np.arange(parts + 1)).tolist())):
        if b > a:
            one, two = left[by_part[a:b]], right[by_part[a:b]]
            tail = pc.if_else(pa.array(two < 0), end, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), names.take(pa.array(np.maximum(two, 0))), end, pa.scalar(b"", pa.large_binary())))
            lines = pc.binary_join_element_wise(names.take(pa.array(one)), tail, pa.scalar(b"", pa.large_binary()))
            begin, stop = np.frombuffer(lines.buffers()[1], "<i8")[[lines.offset, lines.offset + len(lines)]]
            yield kind, chunk, p, zstandard.compress(memoryview(lines.buffers()[2])[begin:stop], LEVEL), packed(counts[a:b])
    if kind == RAW:
        # ids, whether there is one, words and distinct features by document; then its feature numbers as steps from one to the next
        del left, right, part, by_part
        cells = doc.astype(np.int64)
        cells *= max(1, len(first))
        cells += number
        del doc, number
        cells.sort()
        begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
        n = np.diff(np.append(begin, len(cells)))
        whose, feature = np.divmod(cells[begin], max(1, len(first)))
        del cells, begin
        held = np.bincount(whose, minlength=len(texts))
        steps = np.diff(feature, prepend=0)
        starts = (np.cumsum(held) - held)[held > 0]
        steps[starts] = feature[starts]
        head = np.concatenate(([k or 0 for k in keys], [k is not None for k in keys], sizes, held)).astype(np.int64)
        yield DOCUMENTS, chunk, -1 - chunk, packed(np.concatenate(([len(texts)], head, steps))), packed(n)
    pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, parts: int, kind: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """PIECE rows of (doc_id, text as binary): in each task, one chunk after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, keys, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or b""
                if texts and held + len(body) > chunk_bytes:
                    for row in chunk_pieces(chunk, keys, texts, parts, kind):
                        yield from _table([row], PIECE).to_batches()
                    chunk, keys, texts, held = chunk + 1, [], [], 0
                keys.append(key)
                texts.append(body)
                held += len(body)
        if texts:
            for row in chunk_pieces(chunk, keys, texts, parts, kind):
                yield from _table([row], PIECE).to_batches()

    return docs.mapInArrow(run, _ddl(PIECE))


def count_part(group: pa.Table) -> pa.Table:
    """PIECE rows from those of one part: each distinct string counted over all chunks and hashed once.

    A chunk gets the buckets of its strings in this part as its body; a row of kind TARGET holds what the part has counted by bucket, in
    raw and in target text, under a chunk number of its own below zero. Documents are handed on.
    """
    rows = group.to_pylist()
    if rows[0]["kind"] == DOCUMENTS:
        return group
    data = np.frombuffer(b"".join([zstandard.decompress(r["body"]) for r in rows]), np.uint8)
    sizes = [len(unpacked(r["counts"])) for r in rows]
    stops = np.flatnonzero(data == 10)
    offsets = np.append(0, stops - np.arange(len(stops)))
    every = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(data[data != 10])]).dictionary_encode()
    del data, stops, offsets
    hashed = np.empty(len(every.dictionary), dtype=np.uint16)
    for a in range(0, len(hashed), SLICE):
        hashed[a : a + SLICE] = [zlib.crc32(s) % BUCKETS for s in every.dictionary.slice(a, SLICE).to_pylist()]
    own = hashed[every.indices.to_numpy(zero_copy_only=False)]
    del every
    sums = np.zeros((2, BUCKETS), dtype=np.int64)
    out: list[tuple] = []
    for r, mine in zip(rows, np.split(own, np.cumsum(sizes)[:-1]), strict=True):
        np.add.at(sums[r["kind"]], mine, unpacked(r["counts"]))
        if r["kind"] == RAW:
            out.append((RAW, r["chunk"], r["part"], packed(mine), b""))
    out.append((TARGET, -1 - rows[0]["part"], rows[0]["part"], packed(sums.ravel()), b""))
    pa.default_memory_pool().release_unused()
    return _table(out, PIECE)


def count_documents(group: pa.Table) -> pa.Table:
    """COUNTED rows of one chunk: its documents' feature counts, as counts by bucket. What a part has counted is one row."""
    rows = group.to_pylist()
    if rows[0]["kind"] == TARGET:
        return _table([(False, None, None, None, rows[0]["body"], None)], COUNTED)
    own = [unpacked(r["body"]) for r in sorted((r for r in rows if r["kind"] == RAW), key=lambda r: r["part"])]
    documents = next(r for r in rows if r["kind"] == DOCUMENTS)
    body, n = unpacked(documents["body"]), unpacked(documents["counts"])
    size = int(body[0])
    ids, has_id, words, held = body[1 : 4 * size + 1].reshape(4, size)
    run = np.cumsum(body[4 * size + 1 :])
    starts = np.cumsum(held) - held
    feature = run - np.repeat(np.append(0, run)[starts], held)
    # the same cells by document and bucket; counts of features that share a bucket are added
    cell = np.repeat(np.arange(size), held) * BUCKETS + (np.concatenate(own)[feature] if own else feature)
    order, cell, first = in_order(cell)
    counts = np.add.reduceat(n[order], first) if len(cell) else n
    whose, bucket = np.divmod(cell[first], BUCKETS)
    ends = np.cumsum(np.bincount(whose, minlength=size)).tolist()
    step = np.diff(bucket, prepend=0)
    begin = [a for a, b in pairwise([0, *ends]) if b > a]
    step[begin] = bucket[begin]
    features = words + np.maximum(words - 1, 0)
    spans = list(pairwise([0, *ends]))
    return pa.Table.from_arrays(
        [
            pa.array(np.ones(size, dtype=bool)), pa.array(ids, mask=has_id == 0), pa.array(words), pa.array(features),
            pa.array([planes(step[a:b], 2) for a, b in spans], pa.binary()), pa.array([planes(counts[a:b], 4) for a, b in spans], pa.binary()),
        ], schema=COUNTED,
    )


def gains(counted: DataFrame) -> np.ndarray:
    """Gain of each bucket, from at most BUCKETS rows that the driver gets; 0 where neither text has the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for body in batch.column(0):
                sums += unpacked(body.as_py()).reshape(2, BUCKETS)
        held = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[0, held]), pa.array(sums[1, held])], names=["bucket", "s", "t"])

    parts = counted.filter(~F.col("is_row")).select("buckets").mapInArrow(run, "bucket long, s long, t long")
    found = parts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow().to_pylist()
    all_s, all_t = sum(r["s"] for r in found), sum(r["t"] for r in found)
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = np.floor(1000 * np.log((r["t"] + 1.0) * (all_s + float(BUCKETS)) / ((r["s"] + 1.0) * (all_t + float(BUCKETS)))))
    return out


def weights(docs: DataFrame, target: DataFrame, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row per input row: the floored mean gain of a document's features, 0 without any.

    `target` needs a text only. There are as many parts as the session has shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    both = pieces(raw, parts, RAW, chunk_bytes).union(pieces(wanted, parts, TARGET, chunk_bytes))
    known = both.groupBy("part").applyInArrow(count_part, _ddl(PIECE))
    counted = staged(known.groupBy("chunk").applyInArrow(count_documents, _ddl(COUNTED)), "feature-counts")
    gain = spark.sparkContext.broadcast(gains(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, features, buckets, counts = batch.columns
            sums = [int(gain.value[np.cumsum(from_planes(b.as_py(), 2))] @ from_planes(n.as_py(), 4)) for b, n in zip(buckets, counts, strict=True)]
            each = np.array(sums, dtype=np.int64) // np.maximum(features.to_numpy(zero_copy_only=False), 1)
            yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(each, pa.int64())], schema=WEIGHED)

    return counted.filter("is_row").select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, _ddl(WEIGHED))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row per input row.

    score is the weight plus Gumbel noise made from doc_id. Of the documents of at least `least` words,
    `percent` in a hundred are drawn: the highest scores, ties to the smaller doc_id, a missing one last;
    rows that repeat a doc_id and score by fewer features. rank is the place in this order, null for rows
    that aren't drawn. Null texts have no words. An empty table gives an empty result; without target text every gain is a raw count's.
    """
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(unit)))
    rows = staged(weights(docs, target, text_col, chunk_bytes).withColumn("score", (F.col("weight") + noise).cast("long")), "feature-weights")
    long_enough = rows.filter(F.col("n_words") >= least)
    most = percent * long_enough.count() // 100
    keyed = long_enough.withColumns({"all": F.lit(0), "high": -F.col("score"), "no_id": F.col("doc_id").isNull()})
    placed = numbered(keyed, "all", ["high", "no_id", "doc_id", "n_features", "weight"], "feature-order").select(*rows.columns, F.when(F.col("number") <= most, F.col("number")).cast("long").alias("rank"))
    return placed.union(rows.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
