"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Strings are words as they stand in sentences, with look-alike signs read as letters, other signs
dropped and a mark at either end. Two strings are compared by their common subsequences of four
symbols, each occurrence weighted by DECAY to the power of the symbols it spans (at most SPAN), so
letters put in or left out lower the similarity but don't remove it. Subsequences are hashed to
SLOTS features. The kernel is divided by the square roots of the total weight a string of each
length can have, which keeps it positive semidefinite.

Words of labelled sentences carry the sentence's label. Landmarks are picked among them; the
Nystroem map turns a word into its kernel values with the landmarks, whitened; a squared-hinge
linear SVM separates toxic from clean occurrences of all words of the sample. Tasks map the words once and
store that; in each Newton step they sum up their words' normal equations, and the driver, which never holds a
word but the landmarks, solves for one coefficient a landmark. As the decision is linear in the landmarks'
kernels, it folds into one weight per feature, and a word's score is a sum over its subsequences:
whole texts are scored at a cost in proportion to their distinct words. A text's score is a
logistic function of its two most toxic words.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spread, staged

#: Labelled documents of each class that are read for fitting, lowest hash of doc_id first; each is read whole.
SAMPLE = 3000
LANDMARKS = 320
#: Tasks that sum up normal equations; the driver gets three times LANDMARKS squared numbers of each.
SUMS = 32
#: Words that are mapped at a time.
BLOCK = 2000
#: Landmarks are less alike than this (cosine of their kernel).
ALIKE_MOST = 0.8
DECAY = 0.8
RIDGE = 0.2
#: Standard deviations that a word's count in toxic texts is lowered by: rare words count little, frequent ones nearly whole.
CHANCE = 1.4
SPAN = 6
ALPHABET = 64
EDGE_MARK = ALPHABET - 1
SLOTS = 1 << 20
#: Words scored and kept per Python worker.
CACHE = 400_000
FLOOR = -1.0
THRESHOLD = 0.7

# Fixed look-alikes.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_symbols: dict[int, int] = {}


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c.isalpha():
        return 27 + ord(c) % (EDGE_MARK - 27)
    return 0


class _Table(dict):
    """Code point to symbol, for str.translate-like use; filled as needed."""

    def __missing__(self, c: str) -> int:
        self[c] = v = _symbol(ALIKE.get(c, c))
        return v


TABLE = _Table()
TO_SYMBOL = bytes(max(0, c - 96) for c in range(256))
MARK = bytes([EDGE_MARK])


def cleaned(word: str) -> bytes:
    """Symbols of a word. Look-alikes count only beside letters, so numbers aren't words."""
    low = word.lower()
    if low.isascii() and low.isalpha():
        return MARK + low.encode().translate(TO_SYMBOL) + MARK
    if not any(c.isalpha() for c in low):
        return b""
    low = low.rstrip("!$@.,;:?") if low[-1:] in "!$@.,;:?" else low
    return MARK + bytes(s for s in map(TABLE.__getitem__, low) if s) + MARK


OFFSETS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def _lengths_mass(longest: int = 64) -> np.ndarray:
    """Square root of the summed squared weights of all subsequences in a string of each length."""
    mass = np.zeros(longest + 1)
    for n in range(longest + 1):
        mass[n] = sum(DECAY ** (2 * (k + 1)) * max(0, n - k) for *_, k in OFFSETS)
    return np.sqrt(np.maximum(mass, 1e-9))


MASS = _lengths_mass()
#: Longer strings are divided as strings of this length, so an insult inside a long string still shows.
LONG = 14


def flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols in one array with SPAN zeros behind each string, the strings' starts, their lengths."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(size + SPAN)))[:-1].astype(np.int64)
    out = np.zeros(int((size + SPAN).sum()) + SPAN, dtype=np.int64)
    if len(strings):
        where = np.repeat(starts - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))
        out[where] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    return out, starts, size


def features(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions, slots, weight) for every set of offsets; zeros never take part."""
    n = len(symbols) - SPAN
    packed = symbols.astype(np.uint32)
    for i, j, k in OFFSETS:
        at = np.flatnonzero((symbols[:n] > 0) & (symbols[k : n + k] > 0))
        code = ((packed[at] * np.uint32(64) + packed[at + i]) * np.uint32(64) + packed[at + j]) * np.uint32(64) + packed[at + k]
        yield at, ((code * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64), DECAY ** (k + 1)


def norms(sizes: np.ndarray) -> np.ndarray:
    return MASS[np.clip(sizes, 4, LONG)]


def _cells(strings: list[bytes], column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, column, weight) of every subsequence whose slot has a column, by string."""
    symbols, starts, _ = flat(strings)
    owner = np.searchsorted(starts, np.arange(len(symbols)), side="right") - 1
    rows, cols, weights = [], [], []
    for at, slots, w in features(symbols):
        col = column[slots]
        known = col >= 0
        rows.append(owner[at[known]])
        cols.append(col[known])
        weights.append(np.full(int(known.sum()), w))
    row = np.concatenate(rows)
    by = np.argsort(row, kind="stable")
    return row[by], np.concatenate(cols)[by], np.concatenate(weights)[by]


def kernel(strings: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel matrix, strings by landmarks."""
    known = np.unique(np.concatenate([slots for _, slots, _ in features(flat(landmarks)[0])]))
    column = np.full(SLOTS, -1, dtype=np.int64)
    column[known] = np.arange(len(known))
    size = lambda x: np.array([len(s) for s in x], dtype=np.int64)
    right = np.zeros((len(known), len(landmarks)))
    row, col, weight = _cells(landmarks, column)
    np.add.at(right, (col, row), weight)
    right = (right / norms(size(landmarks))).astype(np.float32)
    out = np.zeros((len(strings), len(landmarks)))
    for a in range(0, len(strings), 128):
        part = strings[a : a + 128]
        row, col, weight = _cells(part, column)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[a + row[first]] = np.add.reduceat(right[col] * weight[:, None].astype(np.float32), first, axis=0)
        out[a : a + len(part)] /= norms(size(part))[:, None]
    return out


def unlike(strings: list[bytes], most: int) -> list[int]:
    """Places of up to `most` strings, in order, leaving out those too like one taken before."""
    like = np.hstack([kernel(strings, strings[a : a + 80]) for a in range(0, len(strings), 80)]) if strings else np.empty((0, 0))
    own = np.sqrt(np.maximum(np.diag(like), 1e-9))
    like = like / own[:, None] / own
    out: list[int] = []
    for k in range(len(strings)):
        if len(out) == most:
            break
        if not out or like[k, out].max() < ALIKE_MOST:
            out.append(k)
    return out


def aims(n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of words as toxic and as clean, from the numbers of clean and toxic texts that hold them, of so many in all.

    A word in toxic sentences is toxic as far as chance doesn't explain its count there, and clean sentences don't have it as often.
    """
    share = n / total
    foul = np.maximum(0, (n[:, 1] - CHANCE * np.sqrt(n[:, 1])) / total[1] - 2 * share[:, 0])
    clean = np.where(n.sum(axis=1) > 0, share[:, 0] + 1 / total.sum(), 0)
    return foul * 1000, clean * 1000


def equations(phi: np.ndarray, foul: np.ndarray, clean: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What these words add to the normal equations of a Newton step from `w` (last coefficient: intercept) on the squared hinge loss: left side, and right side as the last column."""
    rows = np.hstack((phi.astype(np.float64), np.ones((len(phi), 1))))
    decided = rows @ w
    as_foul, as_clean = np.where(decided < 1, foul, 0), np.where(decided > -1, clean, 0)
    weight = as_foul + as_clean
    on = weight > 0
    rows = rows[on]
    return np.hstack(((rows * weight[on, None]).T @ rows, (rows.T @ (as_foul - as_clean)[on])[:, None]))


def newton(sums: Callable[[list[np.ndarray]], list[np.ndarray]], n: int, models: int, ridge: float = RIDGE, rounds: int = 30) -> list[np.ndarray]:
    """Linear SVMs by Newton steps; `sums` gives the normal equations of all words from the models' coefficients."""
    keep = ridge * np.eye(n)
    keep[-1, -1] = 1e-6
    ws = [np.zeros(n) for _ in range(models)]
    for _ in range(rounds):
        new = [np.linalg.solve(keep + both[:, :n], both[:, n]) for both in sums(ws)]
        done = all(np.allclose(a, b, atol=1e-6) for a, b in zip(new, ws, strict=True))
        ws = new
        if done:
            break
    return ws


@dataclass
class ToxicityModel:
    """weights: by feature slot; bias of a word; a, b, c: logistic of the two highest word scores."""

    weights: np.ndarray
    bias: float
    logistic: tuple[float, float, float] = (3.0, 0.0, 0.0)

    def words(self, words: list[str]) -> np.ndarray:
        """SVM decision of each word, at least FLOOR."""
        out = np.full(len(words), FLOOR)
        strings = [cleaned(w) for w in words]
        have = [k for k, s in enumerate(strings) if len(s) >= 4]
        if have:
            symbols, starts, sizes = flat([strings[k] for k in have])
            sums = np.zeros(len(symbols))
            for at, codes, w in features(symbols):
                sums[at] += w * self.weights[codes]
            out[have] = np.maximum(FLOOR, np.add.reduceat(sums, starts) / norms(sizes) + self.bias)
        return out

    def score(self, first: float, second: float) -> float:
        a, b, c = self.logistic
        return float(1 / (1 + np.exp(-np.clip(a * first + b * second + c, -30, 30))))


#: Scores everything alike, below the threshold.
UNFITTED = ToxicityModel(np.zeros(SLOTS, dtype=np.float32), FLOOR, (0.0, 0.0, -3.0))


class Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.cache = model, {}

    def tops(self, texts: list[str | None]) -> list[tuple[float, float]]:
        """The two highest word scores of each text, repeats counting; single letters in a row are one word."""
        split = [_tokens(t) for t in texts]
        need = set().union(*split) if split else set()
        new = list(need.difference(self.cache))
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self.cache.update(zip(part, self.model.words(part).tolist(), strict=True))
        get, out = self.cache.__getitem__, []
        for words in split:
            best = second = FLOOR
            for v in map(get, words):
                if v > second:
                    best, second = (v, best) if v > best else (best, v)
            out.append((best, second))
        if len(self.cache) > CACHE:
            self.cache = {}
        return out


def _tokens(text: str | None) -> list[str]:
    words = text.split() if text else []
    lone = [k for k, w in enumerate(words) if len(w) == 1]
    if len(lone) >= 3:
        run: list[str] = []
        for k, at in enumerate(lone):
            run.append(words[at])
            if k + 1 == len(lone) or lone[k + 1] != at + 1:
                if len(run) >= 3:
                    words.append("".join(run))
                run = []
    return words


_scorers: dict[int, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """Fit on at most SAMPLE documents of each class; `usable` is a condition on doc_id.

    Labels without a doc_id or a value teach nothing; of several labels of a doc_id the highest counts, and every row
    of `docs` that has the id is read. Ties in the hash go by doc_id, ties in word counts by the word.

    Words are counted and mapped, and texts scored, on the executors; the driver receives the landmarks' candidates, the
    normal equations of each task and two numbers a document. The logistic function is fitted on scores of texts that the words' SVM
    hasn't seen: each half of the sample is scored by a model of the other half, over the same landmarks. Without both classes the model scores everything alike, below the threshold.
    """
    spark = docs.sparkSession
    by_doc = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [r for y in (0, 1) for r in by_doc.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not picked:
        return UNFITTED
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id long, toxic int")  # at most 2 * SAMPLE rows
    group = 2 * F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int") + F.col("toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(group.alias("g"), "text")
    sample = staged(texts, "toxicity-sample")
    sizes = np.zeros(4, dtype=np.int64)
    for r in sample.groupBy("g").count().collect():
        sizes[r["g"]] = r["count"]
    totals = of_models(sizes, sizes)
    if not totals[0].min():
        return UNFITTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                words, n = word_counts(part.column(1).to_pylist(), part.column(0).to_pylist(), 4)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array(x, pa.int64()) for x in n)], names=["word", "n0", "n1", "n2", "n3"])

    sums = [F.sum(f"n{g}").alias(f"n{g}") for g in range(4)]
    counted = staged(sample.mapInArrow(count, "word binary, n0 long, n1 long, n2 long, n3 long").groupBy("word").agg(*sums), "toxicity-words")
    clean, foul = F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")
    odds = F.log((foul + 0.5) / F.lit(float(totals[0][1] + 1))) - F.log((clean + 0.5) / F.lit(float(totals[0][0] + 1)))
    known = counted.select("word", (clean + foul).alias("n"), odds.alias("odds"))
    telling = known.filter("odds > 0.5").orderBy((F.col("odds") * F.sqrt("n")).desc(), F.col("n").desc(), "word").limit(3 * LANDMARKS).collect()
    common = known.filter("odds < 0.5").orderBy(F.col("n").desc(), "word").limit(2 * LANDMARKS).collect()
    marks = landmarks([bytes(r["word"]) for r in telling], [bytes(r["word"]) for r in common])
    if not marks:
        return UNFITTED
    whiten = whitening(marks)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                phi = (kernel(part.column(0).to_pylist(), marks) @ whiten).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in phi], pa.binary()), *part.columns[1:]], names=["phi", "n0", "n1", "n2", "n3"])

    cores = spark.sparkContext.defaultParallelism
    # each task sends its sums to the driver, so there are at most SUMS of them however finely the table is split
    rows = staged(counted.repartition(cores, "word").mapInArrow(mapped, "phi binary, n0 long, n1 long, n2 long, n3 long"), "toxicity-map").coalesce(min(cores, SUMS))
    width = len(marks) + 1

    def summed(ws: list[np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [np.zeros((width, width + 1)) for _ in ws]
            for batch in batches:
                for a in range(0, len(batch), BLOCK):
                    part = batch.slice(a, BLOCK)
                    phi = np.frombuffer(b"".join(part.column(0).to_pylist()), "<f4").reshape(-1, width - 1)
                    n = np.array([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                    for both, own, total, w in zip(out, of_models(n, sizes), totals, ws, strict=True):
                        both += equations(phi, *aims(own.T.astype(np.float64), total), w)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ws)), pa.int32()), pa.array([b.tobytes() for b in out], pa.binary())], names=["model", "sums"])

        found = [np.zeros((width, width + 1)) for _ in ws]
        for r in rows.mapInArrow(run, "model int, sums binary").collect():
            found[r["model"]] += np.frombuffer(r["sums"]).reshape(width, width + 1)
        return found

    model, *halves = [folded(marks, whiten, w) for w in newton(summed, width, len(totals))]
    shared = spark.sparkContext.broadcast(halves)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in shared.value]
        for batch in batches:
            groups = batch.column(0).to_pylist()
            found = [scorers[g // 2].tops([text.as_py()])[0] for g, text in zip(groups, batch.column(1), strict=True)]
            first, second = ([t[k] for t in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([g % 2 for g in groups], pa.int32()), pa.array(first, pa.float64()), pa.array(second, pa.float64())], names=["toxic", "first", "second"])

    tops = sample.mapInArrow(score, "toxic int, first double, second double").orderBy("toxic", "first", "second").collect()
    model.logistic = logistic(np.array([(r["first"], r["second"]) for r in tops]), np.array([r["toxic"] for r in tops], dtype=np.float64))
    return model


def of_models(groups: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """(clean, toxic) numbers for the model of all texts, and for either half those of the other half; of all, where that has no text of a class.

    groups: numbers by 2 * half + toxic, sizes: texts by the same.
    """
    both = groups[:2] + groups[2:]
    return [both, *(groups[g : g + 2] if sizes[g : g + 2].min() else both for g in (2, 0))]


def word_counts(texts: list[str], groups: list[int], n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct cleaned words, and in how many texts of each group they stand."""
    place: dict[bytes, int] = {}
    counts = [array("i") for _ in range(n_groups)]
    for text, g in zip(texts, groups, strict=True):
        for word in {cleaned(w) for w in set(_tokens(text))}:
            if len(word) >= 4:
                k = place.setdefault(word, len(place))
                if k == len(counts[0]):
                    for c in counts:
                        c.append(0)
                counts[g][k] += 1
    return list(place), np.array([np.frombuffer(c, dtype=np.int32) for c in counts]).reshape(n_groups, len(place))


def fit_texts(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit on texts and their labels in this process, as `fit` does with tables."""
    groups = [2 * ((k // 2 + y) % 2) + y for k, y in enumerate(toxic)]
    sizes = np.bincount(groups, minlength=4)
    totals = of_models(sizes, sizes)
    if not totals[0].min():
        return UNFITTED
    words, n = word_counts(texts, groups, 4)
    by = sorted(range(len(words)), key=words.__getitem__)
    words, n = [words[k] for k in by], n[:, by].astype(np.float64)
    clean, foul = n[0] + n[2], n[1] + n[3]
    odds = np.log((foul + 0.5) / (totals[0][1] + 1)) - np.log((clean + 0.5) / (totals[0][0] + 1))
    rank = np.lexsort((-(clean + foul), -odds * np.sqrt(clean + foul)))
    telling = [words[k] for k in rank if odds[k] > 0.5][: 3 * LANDMARKS]
    common = [words[k] for k in np.argsort(-(clean + foul), kind="stable") if odds[k] < 0.5][: 2 * LANDMARKS]
    marks = landmarks(telling, common)
    if not marks:
        return UNFITTED
    whiten = whitening(marks)
    phi = (kernel(words, marks) @ whiten).astype(np.float32)
    weights = [aims(own.T, total) for own, total in zip(of_models(n, sizes), totals, strict=True)]
    ws = newton(lambda ws: [equations(phi, *weight, w) for weight, w in zip(weights, ws, strict=True)], len(marks) + 1, len(totals))
    model, *halves = [folded(marks, whiten, w) for w in ws]
    scorers = [Scorer(m) for m in halves]
    tops = [scorers[g // 2].tops([text])[0] for g, text in zip(groups, texts, strict=True)]
    model.logistic = logistic(np.array(tops), np.array(toxic, dtype=np.float64))
    return model


def landmarks(telling: list[bytes], common: list[bytes]) -> list[bytes]:
    """Of the most telling words of toxic sentences and of frequent clean ones those that are unlike each other."""
    own = [telling[k] for k in unlike(telling, LANDMARKS // 2)]
    return own + [common[k] for k in unlike(common, LANDMARKS - len(own))]


def whitening(marks: list[bytes]) -> np.ndarray:
    k_mm = kernel(marks, marks)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T


def folded(marks: list[bytes], whiten: np.ndarray, w: np.ndarray) -> ToxicityModel:
    """Coefficients of landmarks as weights of features."""
    table = np.zeros(SLOTS)
    symbols, starts, sizes = flat(marks)
    owner = np.searchsorted(starts, np.arange(len(symbols)), side="right") - 1
    scale = (whiten @ w[:-1]) / norms(sizes)
    for at, codes, weight in features(symbols):
        np.add.at(table, codes, weight * scale[owner[at]])
    return ToxicityModel(table.astype(np.float32), float(w[-1]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two highest scores, slightly regularised; neither may count against toxicity."""
    use = [0, 1]
    while True:
        z = np.hstack((x[:, use], np.ones((len(x), 1))))
        w, keep = np.zeros(z.shape[1]), np.array([0.1] * len(use) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if len(use) == 1 or min(w[:2]) >= 0:
            found = dict(zip(use, w, strict=False))
            return float(max(0.0, found.get(0, 0.0))), float(max(0.0, found.get(1, 0.0))), float(w[-1])
        use = [int(np.argmax(w[:2]))]


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """(doc_id, score), a row per input row, repeated or without doc_id alike; texts without words (null, empty) get the score of no toxic word.

    Only doc_id and the text are read, so other columns may have any name. Equal texts have equal scores. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorers.get(id(shared.value)) or Scorer(shared.value)
        _scorers.clear()
        _scorers[id(shared.value)] = scorer
        for batch in batches:
            out: list[float] = []
            for a in range(0, len(batch), 500):
                out += [scorer.model.score(*t) for t in scorer.tops(batch.column(1).slice(a, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, score double")


def learnable(folds: int = 3, held_out: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(False))
