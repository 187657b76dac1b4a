"""Things that come in pieces: chunked streams of frames, streams of files, logs of selections, lines by offset."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import frames, lines, text
from textloom.operators import selection_log
from textloom.plans import pack
from textloom.schema import FILE, PackOptions
from textloom.streaming.rows import pack_changes

from test_pack import relation

STREAM = b"P5\n# first\n3 2\n255\n" + b"P5 9 9" + b"P5 2 1 # c\n 255\n\n\n" + b"\nP5 1 1 9 Z" + b"P5\t4 1 255 ABCD"


@pytest.mark.parametrize("tail", [b"", b"P5 2 2 255 ab", b"P5 0 1 255 ", b"P5 1 1 256 x", b"P6 1 1 255 x", b"P5 1 1", b"\n#"])
def test_any_cut_of_a_stream(tail):
    stream = STREAM + tail
    want = list(frames.pgm_frames(stream))
    assert len(want) == 4
    rng = random.Random(3)
    for _ in range(60):
        cuts = sorted(rng.randrange(len(stream) + 1) for _ in range(rng.randint(0, 12)))
        reader, got = frames.OpenFrames(), []
        for a, b in zip([0, *cuts], [*cuts, len(stream)]):
            got += reader.feed(stream[a:b])
        got += reader.feed(None, last=True)
        assert got == want


def test_chunks_as_a_table(spark):
    rows = [(clip, k, STREAM[a : a + size] or None) for clip, size in (("a", 3), ("b", 7), (None, 1000)) for k, a in enumerate(range(0, len(STREAM) + size, size))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "clip_id string, chunk_no int, chunk binary")
    got = sorted(((r["clip_id"] or "", r["frame_idx"], r["width"], r["height"], bytes(r["pixels"])) for r in frames.chunked_frames(df.repartition(3)).collect()))
    assert got == sorted((clip or "", *f) for clip in ("a", "b", None) for f in frames.pgm_frames(STREAM))
    assert frames.chunked_frames(df.limit(0)).count() == 0


def test_long_frame_in_small_chunks():
    big = b"P5 2000 1000 255 " + bytes(2_000_000)
    reader, got = frames.OpenFrames(), []
    for a in range(0, len(big), 500):
        got += reader.feed(big[a : a + 500])
    assert [f[:3] for f in got] == [(0, 2000, 1000)] and not reader.left


def sequential(paths, on, log, filters):
    """The log in one loop over all files."""
    state = dict(on)
    for _, action, node, name in log:
        shown = [p for p in paths if name is None or (name in filters and filters[name](p))]
        scope = [p for p in shown if action != "toggle" or p.split("/")[: len(node)] == node]
        if action == "invert":
            state.update({p: not state[p] for p in scope})
        else:
            select = not all(state[p] for p in scope)
            state.update(dict.fromkeys(scope, select))
    return state


def test_selection_log_is_the_loop(spark):
    rng = random.Random(11)
    paths = [f"d{k % 5}/s{k % 7}/f{k}.rs" for k in range(120)] + ["top.md", "d0/only.py"]
    tests = {"third": lambda p: len(p) % 3 == 0, "md": lambda p: p.endswith(".md")}
    columns = {"third": F.length("path") % 3 == 0, "md": F.endswith("path", F.lit(".md"))}
    nodes = sorted({tuple(p.split("/")[:k]) for p in paths for k in range(1, 4)}) + [("none",)]
    repos, wanted, logs, rows = ["a", "b", None], {}, [], []
    for repo, length in zip(repos, (500, 3, 60)):
        on = {p: rng.random() < 0.5 for p in paths}
        log = []
        for step in range(length):
            action = rng.choice(["toggle"] * 8 + ["toggle_all", "invert"])
            log.append((step, action, list(rng.choice(nodes)) if action == "toggle" else None, rng.choice([None, None, None, "third", "md", "other"])))
        wanted |= {(repo, p): v for p, v in sequential(paths, on, log, tests).items()}
        logs += [(repo, *entry) for entry in log]
        rows += [(repo, p, p.split("/"), on[p], "kept") for p in paths]
    rng.shuffle(logs)
    files = spark.createDataFrame([*rows, ("quiet", "x", ["x"], None, "k")], "repo_id string, path string, path_parts array<string>, selected boolean, home string").withColumnRenamed("home", "note")
    log = spark.createDataFrame([*logs, ("ghost", 1, "invert", None, None)], "repo_id string, step int, action string, node array<string>, filter string")
    got = selection_log.replay(files, log, columns)
    assert got.columns == files.columns
    assert {(r["repo_id"], r["path"]): r["selected"] for r in got.collect()} == wanted | {("quiet", "x"): False}
    assert selection_log.replay(files, log.limit(0)).filter("selected").count() == files.filter("selected").count()
    assert selection_log.replay(files.limit(0), log, columns).count() == 0


def test_line_ranges(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "a", "a\n", "é\r\nb\n\n", "x" * 100_000 + "\ny"] + ["".join(rng.choice("ab\n\r") for _ in range(rng.randrange(40))) for _ in range(30)]
    asked = [(t, a, n) for t in texts for a, n in ((1, 1), (2, 3), (0, 2), (99, 1), (1, 0))]
    data = F.col("t").cast("binary")
    df = spark.createDataFrame(asked, "t string, a int, n int").withColumn("starts", lines.line_starts(data)).select("*", lines.line_range(data, F.col("starts"), F.col("a"), F.col("n")).alias("cut"), text.lines(F.col("t")).alias("all"))
    for r in df.collect():
        if r["t"] is None:
            assert r["cut"] is None and r["starts"] is None
            continue
        whole = r["t"].encode().splitlines(keepends=True) if "\r" not in r["t"] else [x + b"\n" for x in r["t"].encode().split(b"\n")]
        if "\r" in r["t"]:
            whole[-1] = whole[-1][:-1]
            whole = [x for x in whole if x]
        assert len(r["starts"]) == len(whole) == len(r["all"])
        first = max(r["a"], 1) - 1
        assert bytes(r["cut"]) == b"".join(whole[first : first + r["n"]])


def test_any_split_into_batches(spark, tmp_path):
    rng = random.Random(6)
    every = [(repo, f"d{k % 3}/f{k}.{rng.choice(['rs', 'py', 'svg'])}", "fn f() {\n" + "x" * rng.randrange(60) + "\n}\n") for repo in ("a", "b", "c") for k in range(8)]
    gone = [("c", p, None) for r, p, _ in every if r == "c"]
    later = [("a", every[0][1], "fn changed() {}\n")]
    make = lambda rows: spark.createDataFrame([(r, p, p.split("/"), len(c or ""), c, None, False) for r, p, c in rows], FILE)
    final = {(r, p): c for r, p, c in [*every, *later, *gone]}
    options = PackOptions(budget=90)
    want = {r["repo_id"]: r["document"] for r in pack.pack(make([(r, p, c) for (r, p), c in final.items() if c is not None]), options).collect()}
    for trial, cuts in enumerate(([], [5, 11], sorted(rng.sample(range(1, 24), 4)))):
        source = tmp_path / f"in{trial}"
        bounds = [0, *cuts, len(every)]
        batches = [every[a:b] for a, b in zip(bounds, bounds[1:])] + [later, gone]
        for k, rows in enumerate(batches):
            make(rows).coalesce(1).write.parquet(str(source / f"{k:03d}"))
        stream = spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        got, packed = {}, []
        pack_changes(stream, options, lambda df, n: [got.__setitem__(r["repo_id"], r["document"]) or packed.append((n, r["repo_id"])) for r in df.collect()], str(tmp_path / f"state{trial}"), str(tmp_path / f"cp{trial}")).awaitTermination(300)
        assert {r: d for r, d in got.items() if r != "c"} == want
        assert "<file" not in got["c"]
        assert len([x for x in packed if x[1] == "b"]) == sum(any(r == "b" for r, _, _ in rows) for rows in batches)
