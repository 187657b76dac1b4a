"""Plain versions of the clustering, resampling and mixing contracts, written apart from the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

from brute import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clusters(rows, k=40, rounds=5):
    """rows: (vec_id, vector or None). Returns (vec_id, cluster, distance) and the centroids, in input order of the kept rows."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def assign():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centroids)) if centroids else (None, None)
            out.append((i, c, d, v))
        return out

    for _ in range(rounds):
        groups = {}
        for _, c, _, v in assign():
            groups.setdefault(c, []).append(v)
        for c, own in groups.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, d) for i, c, d, _ in assign()], centroids


def features(text):
    w = WORD.findall(lower_ascii(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resample(docs, items, percent=25, least=20, buckets=10000, seed=7):
    """docs: (doc_id, text). Rows (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in items:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, f)]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = percent * len(able) // 100
    return [(*r[:4], k if k <= most else None) for k, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if r[4] < least]


def mix_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """{source: target}, sharing the excess step by step."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    share, capped = percent * sum(sizes.values()) / 100, set()
    while True:
        left = share - sum(most * sizes[x] for x in capped)
        total = sum(w[x] for x in names if x not in capped)
        aim = {x: most * sizes[x] if x in capped else left * w[x] / total for x in names}
        over = {x for x in names if x not in capped and aim[x] >= most * sizes[x]}
        if not over:
            return aim
        capped |= over
        if len(capped) == len(names):
            return {x: most * sizes[x] for x in names}
