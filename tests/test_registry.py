"""Functions under SQL names give what the column expressions give."""

import random

from pyspark.sql import functions as F

from textloom import registry

TEXTS = [None, "", "a\n", "Please create a video of a fox; cut to a drone shot on 85mm at golden hour. Then f/1.4, please.", "key sk-" + "a1B2" * 6 + " x", "```` `", "\t\x01\"\\\r\nq", "x" * 300_000, "é😀" * 20, "it's -- just 'quoted'", "a=b(c) and (d) or not(e)"]
PATHS = [None, "", "a/b.rs", "a/Cargo.lock", "docs/x.md", "tests/t_test.go", ".env.local", "x/.hid/y.PNG", "a.min.js", "src/main.rs", "b/logo.SVG", "no_ext", "a/b/c.tar.gz", "it's/a(b).py"]


def test_sql_names_are_the_expressions(spark):
    names = registry.register(spark)
    assert len(names) == len(set(names)) and len(registry.NATIVE) > 25
    rng = random.Random(1)
    starts = lambda s: [0] + [k + 1 for k, c in enumerate(s.encode()[:-1]) if c == 10] if s else []
    values = {"t": TEXTS, "p": PATHS, "profile": ["claude", "cl100k", "nobody", None], "n": [0, 5, 1023, 5_000_000, 10**12, None], "first": [0, 1, 2, 9], "count": [0, 1, 3]}
    for name, (parameters, function) in registry.NATIVE.items():
        rows = []
        for k in range(40):
            t = rng.choice(TEXTS)
            own = {p: (t.encode() if t is not None else None) if p == "data" else starts(t) if p == "starts" else values[p][k % len(values[p])] if k < len(values[p]) else rng.choice(values[p]) for p in parameters}
            rows.append(tuple(own[p] for p in parameters))
        df = spark.createDataFrame(rows, ", ".join(f"{p} {kind}" for p, kind in parameters.items()))
        got = df.select(F.expr(f"{name}({', '.join(parameters)})").alias("sql"), function(*[F.col(p) for p in parameters]).alias("own"))
        assert all(r["sql"] == r["own"] for r in got.collect()), name


def test_chunks_by_sql(spark):
    registry.register(spark)
    stream = b"P5 2 1 255 abP5 1 1 255 c"
    spark.createDataFrame([("k", n, stream[a : a + 4]) for n, a in enumerate(range(0, len(stream), 4))], "clip_id string, n int, chunk binary").createOrReplaceTempView("clips_in_chunks")
    got = spark.sql("SELECT frame_idx, width, pixels FROM pgm_chunks(TABLE(clips_in_chunks) PARTITION BY clip_id ORDER BY n)").collect()
    assert sorted((r[0], r[1], bytes(r[2])) for r in got) == [(0, 2, b"ab"), (1, 1, b"c")]
