"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of the normalised items is small and broadcast; training words stream through it
while the longest match that ends at each word is tracked. Items are taken in blocks of at most
`block_words` words: one automaton per block, one pass over the documents per block, so neither the
driver nor a task ever holds more than a block. With one block (the usual case) the operator is a
single scan without a shuffle; with more, rows are stored with a key and the passes' hits are merged by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .scratch import spread, staged

#: ASCII that is no digit and no letter becomes a space, A-Z become a-z; other bytes stay.
TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
WINDOW = 13
BLOCK_WORDS = 200_000
#: A document is contaminated when at least one word in this many is hit.
SHARE = 20

#: Key that stored rows get when there are several blocks.
KEY = "__decontaminate_row"
HITS = pa.schema([("row_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
HITS_DDL = "row_key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(words: list[bytes], sam: SuffixAutomaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged hit spans and hit items of one document: only runs of known words enter the automaton."""
    if len(words) < sam.shortest or not sam.vocab:
        return [], set()
    get = sam.vocab.get
    ids = np.array([get(w, -1) for w in words], dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= sam.shortest
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        got, found = sam.scan(ids[a:b].tolist())
        spans += [(a + x, a + y) for x, y in got]
        items |= found
    return merged(spans), items


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[dict[tuple[str, int], list[bytes]]]:
    """Blocks of item parts (id, part), read one after another; an item without words or without an id has no window.

    Rows that share an id are parts of one item. A text of more words than a block is cut into
    parts that overlap by a window less one word, so no window is lost and a block stays a block.
    """
    block: dict[tuple[str, int], list[bytes]] = {}
    held, part = 0, 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(row["text"])
        if not words or row["item_id"] is None:
            continue
        most = max(block_words, window)
        cuts = [words] if len(words) <= most else [words[a : a + block_words + window - 1] for a in range(0, len(words) - window + 1, block_words)]
        for cut in cuts:
            if block and held + len(cut) > block_words:
                yield block
                block, held = {}, 0
            part += 1
            block[row["item_id"], part] = cut
            held += len(cut)
    if block:
        yield block


def _pass(rows: DataFrame, sam: SuffixAutomaton) -> DataFrame:
    """(row_key, n_words, spans, items) of (row_key, text): one block of items against all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(sam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                spans, items = find_hits(words, sam)
                out.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted({sam.items[k][0] for k in items})))
            n, spans, items = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip((n, spans, items), list(HITS)[1:], strict=True))], schema=HITS)

    return rows.mapInArrow(run, HITS_DDL)


def _several(rows: DataFrame, blocks: Iterator[dict], window: int) -> DataFrame:
    """As `_pass`, for any number of blocks: a pass for each, hits merged by row_key. `rows` must be a stored table."""
    found = None
    for block in blocks:  # one automaton at a time
        hits = _pass(rows, SuffixAutomaton(block, window))
        hits = staged(hits if found is None else hits.filter(F.size("items") > 0), "hits")
        found = hits if found is None else found.union(hits)
    gathered = found.groupBy("row_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def joined(spans: pd.Series) -> pd.Series:
        return spans.map(lambda own: [{"start": a, "end": b} for a, b in merged([(int(x["start"]), int(x["end"])) for x in own])])

    return gathered.withColumn("spans", joined("spans"))


def _keyed_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Hits by row, and the stored rows (all columns and row_key) that they belong to; None: one pass did, and row_key is doc_id."""
    blocks = item_blocks(benchmark, block_words, window)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        return _pass(spread(docs.select(F.col("doc_id").cast("long").alias("row_key"), F.col(text_col).alias("text"))), SuffixAutomaton(first, window)), None
    rows = staged(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
    return _several(rows.select(F.col(KEY).alias("row_key"), F.col(text_col).alias("text")), chain([first, second], blocks), window), rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit, contaminated), a row per input row.

    spans: merged hit spans in word positions; items: ids (as strings, sorted) of the items with a
    window in the text; contaminated: n_hit > 0 and SHARE * n_hit >= n_words. A null or empty text
    has no words and no hits. An empty benchmark hits nothing. Rows that repeat a doc_id or have
    none get a row each. The number of blocks changes nothing in the result: with several, rows are
    stored with a key of their own, by which the passes' hits are merged.
    """
    hits, rows = _keyed_hits(docs, benchmark, window, block_words, text_col)
    if rows is None:
        hits = hits.withColumnRenamed("row_key", "doc_id")
    else:
        ids = rows.select(F.col(KEY).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
        hits = hits.join(ids, "row_key").select("doc_id", "n_words", "spans", "items")
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def cut_spans(text: str, spans: list[tuple[int, int]], longest: int, share: float, n_words: int) -> str | None:
    """The text without hit spans longer than `longest` words; None if over `share` of its words are hit."""
    if n_words and sum(b - a for a, b in spans) > share * n_words:
        return None
    cut = [(a, b) for a, b in spans if b - a > longest]
    if not cut:
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in cut:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, longest: int | None = None, share: float | None = None, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without contaminated rows; all columns stay.

    By default the contract's rule decides (1 / SHARE of the words). With `longest`, rows over the
    coverage `share` (default 1 / SHARE) go, and hit spans over that length are cut out of the texts of
    the others. Null and empty texts stay. Rows are judged one by one, repeated or without doc_id alike,
    whatever the number of blocks.
    """
    most = share if share is not None else 1 / SHARE

    def judged(text: str | None, n_words: int, spans: list[tuple[int, int]]) -> tuple[bool, str | None]:
        hit = sum(b - a for a, b in spans)
        if not hit or text is None:
            return True, text
        if longest is None:
            return hit * SHARE < n_words, text
        new = cut_spans(text, spans, longest, most, n_words)
        return new is not None, new

    blocks = item_blocks(benchmark, block_words, window)
    first, second = next(blocks, {}), next(blocks, None)
    at = docs.columns.index("text")

    def kept(batch: pa.RecordBatch, texts: list, keep: list[bool]) -> pa.RecordBatch:
        if longest is not None:
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch.filter(pa.array(keep, pa.bool_()))

    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for batch in batches:
                keep, texts = [], []
                for value in batch.column(at):
                    text = value.as_py()
                    words = words_of(text)
                    stays, new = judged(text, len(words), find_hits(words, sam)[0])
                    keep.append(stays)
                    texts.append(new if longest is not None else None)
                yield kept(batch, texts, keep)

        return spread(docs).mapInArrow(run, docs.schema)

    rows = staged(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
    hits = _several(rows.select(F.col(KEY).alias("row_key"), "text"), chain([first, second], blocks), window)
    hits = staged(hits.filter(F.size("spans") > 0).select(F.col("row_key").alias(KEY), F.struct("n_words", "spans").alias(f"{KEY}_hits")), "hit-rows")
    joined = rows.join(hits, KEY, "left").select(*docs.columns, f"{KEY}_hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(docs_columns)).to_pylist()
            out = [judged(t.as_py(), h["n_words"], [(x["start"], x["end"]) for x in h["spans"]]) if h else (True, t.as_py() if longest is not None else None) for t, h in zip(batch.column(at), found, strict=True)]
            yield kept(batch.select(docs_columns), [new for _, new in out], [stays for stays, _ in out])

    docs_columns = list(range(len(docs.columns)))
    return joined.mapInArrow(cut, docs.schema)


def digest(items: list[str]) -> str:
    """sha256 of comma-joined ids, as the contract's query reports it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
