"""Sharpness of grey frames and the sharpest frame of a clip; a reader of PGM streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = re.compile(rb"\s*P5(?:\s|#[^\n]*(?:\n|\Z))*([0-9]+)(?:\s|#[^\n]*(?:\n|\Z))*([0-9]+)(?:\s|#[^\n]*(?:\n|\Z))*([0-9]+)\s")


def sharpness(pixels: bytes, width: int, height: int) -> float:
    """Variance of the Laplacian of the smoothed middle (60 % of both sides from 8 pixels on); 0 for what is no frame."""
    if width < 3 or height < 3 or len(pixels) < width * height:
        return 0.0
    grey = np.frombuffer(pixels, dtype=np.uint8, count=width * height).reshape(height, width).astype(np.int64)
    edged = np.pad(grey, 1, mode="edge")
    around = sum(edged[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - grey
    smooth = (8 * grey + around + 8) >> 4
    if width >= 8 and height >= 8:
        w, h = max(3, width * 6 // 10), max(3, height * 6 // 10)
        x, y = (width - w) // 2, (height - h) // 2
        smooth = smooth[y : y + h, x : x + w]
    lap = smooth[:-2, 1:-1] + smooth[2:, 1:-1] + smooth[1:-1, :-2] + smooth[1:-1, 2:] - 4 * smooth[1:-1, 1:-1]
    n = float(lap.size)
    return max(0.0, float((lap * lap).sum()) / n - (float(lap.sum()) / n) ** 2)


@F.pandas_udf(T.DoubleType())
def frame_sharpness(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([sharpness(bytes(p) if p is not None else b"", int(w), int(h)) for p, w, h in zip(pixels, width, height, strict=True)], dtype="float64")


def sharpest(frames: DataFrame, score: str = "sharpness", clip: str = "clip_id", idx: str = "frame_idx") -> DataFrame:
    """(clip, frame_idx, sharpness) of the sharpest frame; the first of equals. One partial aggregate, no sort."""
    best = F.max_by(F.struct(F.col(idx).alias("i"), F.col(score).alias("s")), F.struct(F.col(score), F.negative(F.col(idx))))
    return frames.groupBy(clip).agg(best.alias("b")).select(clip, F.col("b.i").alias(idx), F.greatest(F.col("b.s"), F.lit(0.0)).alias(score))


def pgm_frames(stream: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(index, width, height, pixels) of concatenated P5 frames; ends at the first malformed one."""
    at, k = 0, 0
    while m := HEADER.match(stream, at):
        width, height, most = map(int, m.groups())
        end = m.end() + width * height
        if not width or not height or not 0 < most < 256 or end > len(stream):
            return
        yield k, width, height, bytes(stream[m.end() : end])
        at, k = end, k + 1


@F.udtf(returnType=T.StructType().add("frame_idx", "integer").add("width", "integer").add("height", "integer").add("pixels", "binary"))
class PgmFrames:
    """Table function over one stream."""

    def eval(self, stream: bytes):
        yield from pgm_frames(bytes(stream) if stream is not None else b"")


#: A header that isn't over yet may go on in the next chunk; one that is longer than this is malformed.
LONGEST_HEADER = 1 << 16


class OpenFrames:
    """Reads one stream that comes in chunks. Between chunks it holds the frame that is open, and no more."""

    def __init__(self) -> None:
        self.left = bytearray()
        self.count = 0
        self.ended = False
        self.wanted = 0  # bytes that the open frame needs, once its header is read

    def feed(self, chunk: bytes | None, last: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
        """The frames that this chunk completes; `last` says that no chunk follows."""
        if self.ended:
            return
        self.left += chunk or b""
        at = 0
        while len(self.left) - at >= self.wanted:
            self.wanted = 0
            m = HEADER.match(self.left, at)
            # a header at the very end may be cut off: in its last number, or before the byte behind it
            if m is None:
                self.ended = last or len(self.left) - at > LONGEST_HEADER
                break
            width, height, most = map(int, m.groups())
            if not width or not height or not 0 < most < 256:
                self.ended = True
                break
            end = m.end() + width * height
            if end > len(self.left):
                self.ended, self.wanted = last, end - at
                break
            yield self.count, width, height, bytes(self.left[m.end() : end])
            at, self.count = end, self.count + 1
        del self.left[:at]
        if self.ended:
            self.left.clear()


@F.udtf(returnType=T.StructType().add("clip_id", "string").add("frame_idx", "integer").add("width", "integer").add("height", "integer").add("pixels", "binary"))
class PgmChunks:
    """Table function over rows (clip_id, chunk): TABLE(...) PARTITION BY clip_id ORDER BY the chunks' numbers. Frames may go on from chunk to chunk."""

    def __init__(self) -> None:
        self.clip: str | None = None
        self.open = OpenFrames()

    def eval(self, row: Row):
        self.clip = None if row["clip_id"] is None else str(row["clip_id"])
        for frame in self.open.feed(bytes(row["chunk"]) if row["chunk"] is not None else None):
            yield self.clip, *frame

    def terminate(self):
        for frame in self.open.feed(None, last=True):
            yield self.clip, *frame


def chunked_frames(chunks: DataFrame, clip: str = "clip_id", number: str = "chunk_no", chunk: str = "chunk") -> DataFrame:
    """(clip_id, frame_idx, width, height, pixels) of streams that lie in rows (clip, number, chunk).

    A clip is read by one task, chunk by chunk, and only its open frame is held; a stream needn't fit a row. Chunks may be null or empty.
    """
    rows = chunks.select(F.col(clip).cast("string").alias("clip_id"), F.col(number).alias("chunk_no"), F.col(chunk).alias("chunk"))
    return PgmChunks(rows.asTable().partitionBy("clip_id").orderBy("chunk_no"))


def quantised(values: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """An array of floats as grey levels 0..255."""
    return F.transform(values, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") - low) / (high - low) * 255).cast("int"))))


def grid_sharpness(levels: Column, side: int) -> Column:
    """`sharpness` of a square frame given as an array of levels, as a native expression for small sides."""
    w = max(3, side * 6 // 10) if side >= 8 else side
    first = (side - w) // 2 if side >= 8 else 0
    at = lambda y, x: F.get(levels, F.lit(min(max(y, 0), side - 1) * side + min(max(x, 0), side - 1)))
    smooth = {}
    for y in range(first, first + w):
        for x in range(first, first + w):
            around = sum((at(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx), F.lit(8))
            smooth[y, x] = F.shiftright(at(y, x) * 8 + around, 4)
    inner = range(first + 1, first + w - 1)
    laps = F.array(*[smooth[y - 1, x] + smooth[y + 1, x] + smooth[y, x - 1] + smooth[y, x + 1] - smooth[y, x] * 4 for y in inner for x in inner])
    n = float(len(inner) ** 2)
    total = F.aggregate(laps, F.lit(0), lambda a, v: a + v).cast("double")
    squares = F.aggregate(laps, F.lit(0), lambda a, v: a + v * v).cast("double")
    return F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))
