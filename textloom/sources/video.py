"""Tail frames of video files through the ffmpeg tools, and the sharpest one as a still.

The tools are called where the file is (an executor, for a table of paths on shared storage). They are optional: without
them the functions raise `ToolMissing`.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.frames import pgm_frames, sharpness

#: Seconds of the tail that are looked at, and the wider window for a soft one; the least sharpness of a good frame.
TAIL, WIDER, SHARP = 0.5, 1.5, 12.0
WIDTH = 320


class ToolMissing(RuntimeError):
    """ffmpeg isn't installed here."""


def _run(*args: str) -> subprocess.CompletedProcess:
    if shutil.which(args[0]) is None:
        raise ToolMissing(f"{args[0]} isn't installed")
    return subprocess.run(args, capture_output=True, check=False)


def duration(path: str) -> float | None:
    """Seconds, or None where the probe isn't installed or can't tell."""
    try:
        out = _run("ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path)
        seconds = float(out.stdout.decode().strip())
    except (ToolMissing, ValueError):
        return None
    return seconds if 0 < seconds < float("inf") else None


def scored_tail(path: str, seconds: float) -> list[float]:
    """Sharpness of each grey frame of the last seconds, scaled to WIDTH."""
    out = _run("ffmpeg", "-v", "error", "-sseof", f"-{seconds:.3f}", "-i", path, "-vf", f"scale={WIDTH}:-1", "-f", "image2pipe", "-vcodec", "pgm", "-")
    if out.returncode and not out.stdout:
        raise ValueError(f"no frames decoded from {path}: {out.stderr.decode(errors='replace').strip()}")
    return [sharpness(pixels, w, h) for _, w, h, pixels in pgm_frames(out.stdout)]


def tails(path: str) -> Iterator[tuple[float, list[float]]]:
    """(seconds, sharpness of each frame) of ever wider windows at the end, decoded as they are asked for; none is wider than the video."""
    whole = duration(path)
    usable = whole if whole and whole > 0.05 else float("inf")
    for seconds in dict.fromkeys(min(s, usable) for s in (TAIL, WIDER)):
        yield seconds, scored_tail(path, seconds)


def sharpest_tail(path: str, least: float = SHARP) -> tuple[int, float, float]:
    """(frame index, sharpness, seconds from the end) of the best frame; a wider window counts if the best so far is soft and it holds one as sharp."""
    found = None
    for seconds, scores in tails(path):
        top = max(scores, default=-1.0)
        if scores and (found is None or top >= found[1]):
            at = scores.index(top)
            found = at, top, max(0.04, seconds * (len(scores) - at) / len(scores))
        if found and found[1] >= least:
            break
    if found is None:
        raise ValueError(f"no frames in the tail of {path}")
    return found


def anchor(path: str, still: str | None = None, least: float = SHARP) -> tuple[str, int, float]:
    """(still, frame index, sharpness): writes `<stem>.anchor.png` beside the video unless named otherwise; the first frame where seeking gives none."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    index, score, back = sharpest_tail(path, least)
    still = still or os.path.splitext(path)[0] + ".anchor.png"
    grab = lambda *seek: _run("ffmpeg", "-y", "-v", "error", *seek, "-i", path, "-frames:v", "1", still)
    for done in (grab(*seek) for seek in (("-sseof", f"-{back:.3f}"), ())):
        if not done.returncode and os.path.exists(still):
            return still, index, score
    raise ValueError(f"no still written for {path}: {done.stderr.decode(errors='replace').strip()}")


def anchors(videos: DataFrame, path: str = "path", least: float = SHARP) -> DataFrame:
    """(path, still, frame_idx, sharpness, error) for a table of paths; a file that fails has its reason in error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch[path]:
                try:
                    rows.append((p, *anchor(p, least=least), None))
                except (OSError, ValueError) as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "still", "frame_idx", "sharpness", "error"])

    return videos.select(path).mapInPandas(run, "path string, still string, frame_idx int, sharpness double, error string")
