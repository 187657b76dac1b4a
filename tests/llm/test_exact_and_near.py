"""op8, op10: duplicates against brute force."""

import hashlib

import brute
import numpy as np
import pytest
from cases import HARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, queries, simhash


def expected_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.lower_ascii(t), []).append(d)
    out = []
    for d, t in rows:
        norm = brute.lower_ascii(t)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        out.append((d, keep, len(groups[norm]), keep is None or d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8, 4096])
def test_exact_groups(docs_of, block):
    rows = HARD + [(20 + k, "ab" * 9 + "c" * (k % 3)) for k in range(7)] + [(40, "AB" * 9), (41, "é" * 5 + "Ab"), (42, "É" * 5 + "ab"), (43, "x" * 70_000 + "y"), (44, "X" * 70_000)]
    if block == 8:  # very long texts take many levels of naming at this size; one stays
        rows = [(d, t) for d, t in rows if t is None or len(t) < 1000] + [(50, "long " * 2000), (51, "LONG " * 2000), (52, "long " * 1999 + "lonG!")]
    got = exact_dedup.exact_duplicates(docs_of(rows, clash=True), block_bytes=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_groups(rows)


def test_exact_query(spark, sf_dir, sample):
    got = queries.op8_exact_dedup(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_groups(sample)


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_drop_keeps_columns(hard):
    left = exact_dedup.drop_exact_duplicates(hard)
    assert left.columns == hard.columns
    ids = [r["doc_id"] for r in left.collect()]
    # a null text equals an empty one with a number and goes; of repeated rows one stays
    assert 6 in ids and 4 not in ids and 5 not in ids and ids.count(None) == 1 and 3 in ids and ids.count(11) == 1


REPEATS = [(1, "same words in this one"), (1, "another text with the same number"), (2, "Same Words in this one"), (None, "same words in this one"), (None, "only here"), (None, "only here"), (3, "twice"), (3, "twice"), (None, None), (None, "")]


def test_rows_are_judged_one_by_one(docs_of):
    """Missing and repeated doc_ids: each group keeps one row, and no other text goes with it."""
    df = docs_of(REPEATS, clash=True)
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert [(d, (t or "").lower()) for d, t in got] == sorted([(1, "another text with the same number"), (2, "same words in this one"), (3, "twice"), (None, "only here"), (None, "")], key=str)
    near = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert near == sorted([(1, "another text with the same number"), (1, "same words in this one"), (3, "twice"), (None, "only here"), (None, "")], key=str)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len(by) == 7 and sum(v is None for v in by.values()) == 2


def test_simhash_query(spark, sf_dir, sample):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert got == brute.simhash(sample)


def test_simhash_hard(hard):
    rows = [(d, t) for d, t in HARD if d is not None]
    want = brute.simhash(rows)
    got = simhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD)
    for r in got:
        if r["doc_id"] is not None:
            assert (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) == want[r["doc_id"]]
    left = [r["doc_id"] for r in simhash.drop_near_duplicates(hard).collect()]
    assert 4 in left and 5 not in left and left.count(None) == 1 and left.count(11) == 1


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def components_by_hand(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius)
            m = min(label[j] for j in near)
            for j in near:
                label[j] = min(label[j], m)
    return label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=150, unique=True), st.integers(0, 2))
def test_tiles_are_exact(values, radius):
    fps = np.array(values, dtype=np.uint64)
    got, want = simhash.local_components(fps, radius), components_by_hand(fps, radius)
    assert len({(a, b) for a, b in zip(got.tolist(), want, strict=True)}) == len(set(got.tolist())) == len(set(want))


def test_crowded_homes(spark, monkeypatch):
    """Homes over the tile size are split and still give every link; a long chain is one component."""
    rng = np.random.default_rng(5)
    near = [int(x) for x in rng.integers(0, 1 << 12, 60)]
    chain = [sum(1 << b for b in range(20, 20 + k)) | 1 << 62 for k in range(0, 36, 3)]
    fps = sorted({*near, *chain})
    monkeypatch.setattr(simhash, "TILE", 8)
    nodes = spark.createDataFrame([(f, 100 + k) for k, f in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    tiles = simhash.tile_plan(nodes.withColumn("home", F.lit(1)), 3).select("tile", F.size("partners").alias("n")).distinct().collect()
    assert len(tiles) > 5 and min(r["n"] for r in tiles) < len(tiles) - 2  # tiles of far counts never meet
    monkeypatch.setattr(simhash, "TILE", 4096)
    assert {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, parts=6)).collect()} == got
    want = components_by_hand(np.array(fps, dtype=np.uint64), 3)
    least = {}
    for k, lab in enumerate(want):
        least[lab] = min(least.get(lab, 10**9), 100 + k)
    assert {100 + k: least[lab] for k, lab in enumerate(want) if least[lab] != 100 + k} == got


def test_one_count_in_many_tiles(spark, monkeypatch):
    """A population count with more rows than a tile is cut by hash, and every pair of its parts still meets."""
    monkeypatch.setattr(simhash, "TILE", 6)
    fps = [1 << a | 1 << b for a in range(12) for b in range(a)] + [7 << 40 | 1 << k for k in range(10)]
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    want = components_by_hand(np.array(fps, dtype=np.uint64), 3)
    least = {}
    for k, lab in enumerate(want):
        least[lab] = min(least.get(lab, 10**9), k)
    assert {k: least[lab] for k, lab in enumerate(want) if least[lab] != k} == got


def test_segments_follow_the_number_of_nodes():
    assert [simhash.segments_for(n) for n in (0, 10**6, 4 * 10**6, 10**9, 10**11)] == [4, 4, 4, 5, 6]
