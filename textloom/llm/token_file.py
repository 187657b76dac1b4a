"""Token-id files: independent zstandard frames with a trailing seek table.

File layout (the public "zstandard seekable format", so any zstd tool can decompress it):

    frame 0 | frame 1 | ... | skippable frame with the document index | skippable frame with the seek table

Each data frame holds the ids (little-endian uint16 or uint32) of some whole documents and carries
zstandard's own content checksum; the seek table repeats a checksum per frame (low 32 bits of
XXH64 of the decompressed bytes). The document index, itself compressed, lists doc_id, frame, byte
offset in the frame and token count. A reader fetches the tail, then only the frames it needs.

Writing: ranges of doc_id are cut by quantiles, as many as the bytes of text ask for. Texts are encoded
where they are read; two (or four) bytes an id travel once to the range's task, which sorts them and
writes files of bounded size through the file system of the shared folder (local, HDFS or an object
store, by its URI). Every attempt writes under names of its own and the driver lists only files that a
finished task reports, so a task that runs again does no harm; what others have left is deleted.
The driver sees one manifest row per file, turns token counts into offsets and stores the manifest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder, id_width
from .scratch import new_path, spread

# Fixed values of the seekable format: magic numbers and the flag for checksums.
SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_SKIPPABLE, INDEX_MAGIC = 0x184D2A50, 0x544B4958
#: Bytes of ids after which a frame is closed; a document is never split over frames.
FRAME_BYTES = 1 << 18
#: Pieces that an encoder keeps here, and as many of the generation before: no other stage shares its workers.
PIECES = 400_000
#: Bytes of text of a range, at which a task sorts and writes its ids, and the most ranges that quantiles are taken for.
RANGE_BYTES, MOST_RANGES = 1 << 25, 10_000
#: Bytes of ids after which a file is closed and the next one begun.
FILE_BYTES = 1 << 28
MANIFEST = "manifest.jsonl"
WIDTHS = {2: "<u2", 4: "<u4"}
INDEX = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u8"), ("n_tokens", "<u8")])


class TokenFileWriter:
    """Streams documents into a sink with `write(bytes)`; memory is one frame and 28 bytes a document."""

    def __init__(self, sink, width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.width, self.limit = sink, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames = array("L")
        self.index = tuple(array(c) for c in "qqqq")
        self.part: list[bytes] = []
        self.held = self.written = self.n_tokens = 0

    def add(self, doc_id: int, ids: np.ndarray | bytes) -> None:
        """ids: numbers, or their bytes at this file's width."""
        raw = ids if isinstance(ids, bytes) else ids.astype(WIDTHS[self.width]).tobytes()
        n = len(raw) // self.width
        for column, value in zip(self.index, (doc_id, len(self.frames) // 3, self.held, n), strict=True):
            column.append(value)
        self.part.append(raw)
        self.held += len(raw)
        self.written += len(raw)
        self.n_tokens += n
        if self.held >= self.limit:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.part)
        data = self.pack.compress(raw)
        self.sink.write(data)
        self.frames.extend((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.part, self.held = [], 0

    def finish(self) -> None:
        if self.part:
            self._close_frame()
        rows = np.empty(len(self.index[0]), dtype=INDEX)
        for name, column in zip(INDEX.names, self.index, strict=True):
            rows[name] = np.frombuffer(column, dtype=np.int64) if len(column) else []
        index = self.pack.compress(rows.tobytes())
        self.sink.write(struct.pack("<II", INDEX_SKIPPABLE, len(index) + 8) + struct.pack("<II", INDEX_MAGIC, self.width) + index)
        table, n = np.array(self.frames, dtype="<u4").tobytes(), len(self.frames) // 3
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", n, CHECKSUMS, SEEK_MAGIC))


class TokenFileReader:
    """Random access to a token file: `source` has seek, read and size."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - 12 * n - 8
        raw = self._at(table_at + 8, 12 * n)
        self.frames = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64))).astype(np.int64)
        at = int(self.starts[-1])
        kind, length, magic, self.width = struct.unpack("<IIII", self._at(at, 16))
        if kind != INDEX_SKIPPABLE or magic != INDEX_MAGIC:
            raise ValueError("no document index")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(at + 16, length - 8)), dtype=INDEX)
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """Decompressed bytes of frame k, checked; the last one is kept."""
        if self.held[0] != k:
            packed, size, check = self.frames[k]
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, raw)
        return self.held[1]

    def entry(self, row: int) -> np.ndarray:
        """Ids of the document in this row of the index."""
        _, k, at, n = self.index[row].tolist()
        return np.frombuffer(self.frame(k), dtype=WIDTHS[self.width], count=n, offset=at).astype(np.uint32)

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of the first document of this id; only its frame is decompressed."""
        row = np.flatnonzero(self.index["doc_id"] == doc_id)
        if not len(row):
            raise KeyError(doc_id)
        return self.entry(int(row[0]))


@dataclass(frozen=True)
class TokenFiles:
    """Files in ascending doc_id order: (path, n_docs, n_tokens, first token's place in the whole)."""

    root: str
    files: list[tuple[str, int, int, int]]

    def store(self) -> None:
        system, folder = _open(self.root)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write("".join(json.dumps(f) + "\n" for f in self.files).encode())

    @staticmethod
    def load(root: str) -> TokenFiles:
        system, folder = _open(root)
        with system.open_input_file(f"{folder}/{MANIFEST}") as source:
            return TokenFiles(root, [tuple(json.loads(line)) for line in source.read().decode().splitlines()])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def range_bounds(docs: DataFrame, text_col: str, range_bytes: int = RANGE_BYTES) -> list[int]:
    """Smallest doc_ids of all ranges but the first. Quantiles of doc_id, so ranges hold about as many rows each; any bounds give right files."""
    size = F.octet_length(F.col(text_col)).cast("long")
    n_bytes, n_rows = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("doc_id")).first()
    n = min(MOST_RANGES, 1 + (n_bytes + 16 * n_rows) // range_bytes)
    if n < 2:
        return []
    cut = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    return sorted(set(cut))


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, root: str, files: int | None = None, text_col: str = "text", range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Encode every text and write the ids, the end id after each, in doc_id order under `root`.

    A null text is an empty one. Rows with a null doc_id are left out, for there is no place for
    them in the order. Rows that repeat a doc_id stand next to each other, sorted by their ids' bytes. An
    empty table gives no files. Files go to a folder of this run's own below `root`; the manifest in `root` names those of the last run, and
    what else lies there is left alone. `files`: at least so many ranges; a file is closed at `file_bytes` of ids.
    """
    spark = docs.sparkSession
    run = f"run-{uuid.uuid4().hex}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    if files is not None:
        range_bytes = max(1, own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).first()[0] // files)
    bounds = range_bounds(own, "text", range_bytes)
    shared, width = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64)), id_width(vocabulary, end_id)
    schema = pa.schema([("range_no", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, PIECES, width)
        end, rows, held = np.array([end_id], dtype=WIDTHS[width]).tobytes(), [], 0

        def made() -> pa.RecordBatch:
            doc_ids = np.array([d for d, _ in rows], dtype=np.int64)
            ranges = np.searchsorted(shared.value, doc_ids, side="right").astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(doc_ids), pa.array([raw for _, raw in rows], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode([text.as_py()])[0] + end
                rows.append((doc_id, raw))
                held += len(raw)
                if held > 1 << 24:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    ranged = spread(own).mapInArrow(encode, "range_no int, doc_id long, ids binary").repartitionById(len(bounds) + 1, F.col("range_no")).sortWithinPartitions("range_no", "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(f"{root}/{run}")
        scheme = root.split("://")[0] + "://" if "://" in root else ""
        out = sink = name = None
        done: list[tuple[str, int, int, int, int]] = []

        def close() -> None:
            out.finish()
            sink.close()
            done.append((scheme + name, first, len(done), len(out.index[0]), out.n_tokens))

        first = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    name = f"{folder}/ids-{uuid.uuid4().hex}.tok"
                    sink, first = system.open_output_stream(name), doc_id
                    out = TokenFileWriter(sink, width)
                out.add(doc_id, ids.as_py())
                if out.written >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["path", "first", "seq", "n_docs", "n_tokens"])

    # a doc_id is in one range only, so files of a range follow each other and ranges never mix
    rows = sorted(ranged.mapInArrow(write, "path string, first long, seq long, n_docs long, n_tokens long").collect(), key=lambda r: (r["first"], r["seq"]))
    found, start = [], 0
    for r in rows:
        found.append((r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    written = TokenFiles(root, found)
    written.store()
    _tidy(written, run)
    return written


def _tidy(written: TokenFiles, run: str) -> None:
    """Delete token files of this run that attempts have left which didn't finish or weren't the first to; no other run's and no foreign files."""
    from pyarrow import fs

    system, folder = _open(f"{written.root}/{run}")
    known = {p.rsplit("/", 1)[-1] for p, *_ in written.files}
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.startswith("ids-") and info.base_name.endswith(".tok") and info.base_name not in known:
            system.delete_file(info.path)


def read_token_files(spark: SparkSession, written: TokenFiles, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files.

    start counts the ids of all documents before; ids_crc32 is over little-endian uint32 ids.
    """
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    listing = spark.createDataFrame(written.files, "path string, n_docs long, n_tokens long, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as source:
                    reader = TokenFileReader(source)
                    step = 500 if with_ids else 20_000
                    for a in range(0, len(reader.index), step):
                        rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                        for k in range(a, min(a + step, len(reader.index))):
                            ids = reader.entry(k)
                            rows["doc_id"].append(int(reader.index["doc_id"][k]))
                            rows["start"].append(start)
                            rows["n_tokens"].append(len(ids))
                            rows["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                            if with_ids:
                                rows["ids"].append(ids.astype(np.int32))
                            start += len(ids)
                        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return listing.repartition(max(1, len(written.files))).mapInArrow(run, ddl)


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the token files into the shared folder and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, vocabulary, end_id, new_path(spark, "tokens")))
