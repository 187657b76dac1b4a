"""Clustering, resampling by a dictionary of features, and mixing, against plain versions."""

import random

import numpy as np
import pytest
from cases import HARD
from hypothesis import given, settings
from hypothesis import strategies as st

import brute_mixing as plain
from textloom.llm import ball_tree, clustering, dictionary, mixing

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, v string, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in rows], VECTORS)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 6), st.sampled_from([1, 3, 1000, 1 << 26]), st.integers(0, 10**6))
def test_trees_assign_exactly(n, k, dims, most, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-most, most + 1, size=(n, dims))
    points[rng.integers(0, n, n // 3)] = points[0]
    centroids = rng.integers(-most, most + 1, size=(k, dims))
    tree, order = ball_tree.build(points, leaf=2)
    apart = ((points[:, None, :] - centroids[None]) ** 2).sum(-1)
    of, distance = ball_tree.labels(tree, centroids)
    assert (of == apart.argmin(1)[order]).all() and (distance == apart.min(1)[order]).all()
    counts, sums = ball_tree.gathered(tree, centroids)
    for c in range(k):
        own = points[apart.argmin(1) == c]
        assert counts[c] == len(own) and (sums[c] == own.sum(0)).all()


def test_balls_are_assigned_whole():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-9000, 9000, size=(8, 16))
    points = np.concatenate([c + rng.integers(-9, 10, size=(300, 16)) for c in centroids])
    tree, _ = ball_tree.build(points)
    balls, _, rows, _ = ball_tree.nearest(tree, centroids)
    assert len(rows) < 100 and len(balls) < 60


def test_clusters_equal_plain(spark):
    rng = random.Random(5)
    some = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(150)]
    rows = [(i, [float(np.float32(x)) for x in some[rng.randrange(150)]]) for i in range(220)]
    rows += [(300, None), (301, [0.5] * 63), (302, [0.5] * 65), (303, [0.5] * 63 + [None]), (304, [0.5] * 63 + [float("nan")]), (305, [0.5] * 63 + [float("-inf")]), (None, [0.25] * 64), (7, [0.125] * 64), (7, [0.125] * 64)]
    want, centroids = plain.clusters(rows, k=12, rounds=3)
    got = clustering.clustered(vectors(spark, rows), k=12, rounds=3, block=50).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    total = {}
    for _, c, d in want:
        total[c] = total.get(c, 0) + d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (total[r["cluster"]], sum(total.values()))
    import hashlib

    assert {r["cluster"]: r["centroid_sha256"] for r in got} == {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in total}


def test_clusters_of_few_and_none(spark):
    assert clustering.clustered(vectors(spark, [])).count() == 0
    assert clustering.clustered(vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    one = clustering.clustered(vectors(spark, [(1, [0.1] * 64), (2, [0.1] * 64)])).collect()
    assert [(r["cluster"], r["distance"]) for r in one] == [(0, 0), (0, 0)]
    lost = clustering.clustered(vectors(spark, [(None, [0.1] * 64)])).collect()
    assert [(r["vec_id"], r["cluster"]) for r in lost] == [(None, None)]
    with pytest.raises(Exception, match="a component of"):
        clustering.clustered(vectors(spark, [(1, [1e9] * 64)])).collect()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4] is None, r[4] or 0))


def items(spark, texts):
    return spark.createDataFrame([(str(k), t, 0) for k, t in enumerate(texts)], "item_id string, text string, chunk int")


@pytest.mark.parametrize("chunk_bytes", [1, 3000, dictionary.CHUNK_BYTES])
def test_resample_equals_plain(spark, sample, docs_of, chunk_bytes):
    docs = (sample[:60] if chunk_bytes == 1 else sample) + HARD[:7] + HARD[9:]
    wanted = [t for _, t in sample[5:12]] + [None, "", "Only THIS one, only this"]
    got = dictionary.drawn(docs_of(docs, clash=True), items(spark, wanted), chunk_bytes=chunk_bytes).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert order(map(tuple, got)) == order(plain.resample(docs, wanted))


def test_resample_of_hard_rows(spark, hard, empty):
    got = dictionary.drawn(hard, items(spark, ["word word"]), percent=100, least=0).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert order(map(tuple, got)) == order(plain.resample(HARD, ["word word"], percent=100, least=0))
    assert dictionary.drawn(empty, items(spark, ["a"])).count() == 0
    assert {r["weight"] for r in dictionary.drawn(hard, items(spark, [])).collect() if r["n_features"] == 0} == {0}


def test_packed_numbers():
    for values in ([], [0], [5, 0, 255], [256, 1], [1 << 40, 3]):
        assert dictionary.unpacked(dictionary.packed(np.array(values, dtype=np.int64))).tolist() == values


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab -é\n", max_size=12), max_size=8))
def test_words_of_many_texts(texts):
    words, sizes = dictionary.split_words([t.encode() for t in texts])
    want = [plain.features(t)[0] for t in texts]
    assert [w.decode() for w in words.to_pylist()] == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def sourced(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", "d") for i, t, s in rows], "doc_id long, text string, source string, size string, place string")


def check_mix(spark, rows):
    got = mixing.mixed(sourced(spark, rows)).collect()
    count = lambda t: len([w for w in __import__("re").split("[ \t-\r]+", t or "") if w])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, count(t)) for i, t, _ in rows)
    sizes, longest = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        longest[s] = max(longest.get(s, 0), count(t))
    want = plain.mix_targets(sizes)
    by_target = {}
    for s, aim in want.items():
        by_target.setdefault((sizes[s], round(aim, 6)), []).append(s)
    taken = {}
    for r in got:
        key = r["source_size"], round(r["target"], 6)
        assert key in by_target and r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[key] = taken.get(key, 0) + r["taken"]
    for key, own in by_target.items():
        assert abs(taken[key] - key[1] * len(own)) <= sum(longest[s] for s in own) + 1e-6
    return got


def test_mix_targets_and_copies(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 2, 3, 40, 400])), rng.choice(["a"] * 20 + ["b", "c", "d", "é", None])) for k in range(900)]
    rows += [(None, "x y", "a"), (None, None, None), (3, "x y", "b"), (3, "x y", "b"), (5000, None, "empty"), (5001, "", "empty")]
    first = check_mix(spark, rows)
    rng.shuffle(rows)
    again = mixing.mixed(sourced(spark, rows)).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(key, again)) == sorted(map(key, first))


def test_mix_of_hard_rows(spark, hard, empty):
    check_mix(spark, [(i, t, None) for i, t in HARD])
    assert mixing.mixed(empty).count() == 0
    assert [r["copies"] for r in mixing.mixed(sourced(spark, [(1, None, "a"), (2, "", "b")])).collect()] == [0, 0]
