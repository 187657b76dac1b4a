"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed character bigrams and trigrams, learned from labelled
rows. A document is a mixture: expectation-maximisation estimates the share of each language in a
set from the likelihoods of its n-grams, and the set itself grows one language at a time while the
penalised log-likelihood rises. The prediction is the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spread

BITS = 15
BUCKETS = 2 << BITS
#: Expected number of labelled rows, of each language, that the model is fitted on.
SAMPLE = 3000
#: Languages that a model may have; BUCKETS numbers each stand on the driver and in every worker.
MOST = 256
ROUNDS = 10
#: Log-likelihood that another language must add, per log of the n-gram count: overlapping n-grams overstate gains.
PENALTY = 12.0
#: Share at which a second language's gain is probed.
PROBE = 0.05
UNKNOWN = "und"

_alpha: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x33480)]))
    return _alpha[0][np.minimum(points, 0x3347F)]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letters' bigrams and trigrams; anything else is one space. Empty without letters."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.concatenate((np.zeros(1, np.uint32), np.where(_is_letter(points), points, 0), np.zeros(1, np.uint32))).astype(np.uint32)
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + points[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate((two >> np.uint32(32 - BITS), (three >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)))
    counts = np.bincount(both, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities by bucket (rows) and language (columns)."""

    langs: tuple[str, ...]
    logp: np.ndarray

    def mixture(self, at: np.ndarray, counts: np.ndarray, members: list[int]) -> tuple[float, np.ndarray]:
        """Log-likelihood and shares of a set of languages after EM."""
        if len(members) == 1:
            return float(counts @ self.logp[at, members[0]]), np.ones(1)
        p = np.exp(self.logp[np.ix_(at, members)]).astype(np.float64)
        share, n = np.full(len(members), 1 / len(members)), counts.sum()
        for _ in range(ROUNDS):
            joint = p * share
            total = joint.sum(axis=1)
            share = (counts / total) @ joint / n
        return float(counts @ np.log(p @ share)), share

    def gains_at_most(self, at: np.ndarray, counts: np.ndarray, first: int) -> np.ndarray:
        """Upper bounds on what each other language can add to the log-likelihood of `first` alone.

        The log-likelihood is concave in the other's share s, so it lies under its tangents at 0 and at
        PROBE. Where it falls at PROBE, its top is no higher than where these two cross; else the
        tangent at 0 bounds it. No other language can pass what the bound rules out, so EM isn't run for it.
        """
        p = np.exp(self.logp[at], dtype=np.float64)
        ratio = p / p[:, first, None] - 1
        rise = counts @ ratio  # slope at 0
        mixed = 1 + PROBE * ratio
        value, slope = counts @ np.log(mixed), counts @ (ratio / mixed)
        with np.errstate(divide="ignore", invalid="ignore"):
            crossing = np.clip((value - PROBE * slope) / (rise - slope), 0, PROBE)
        return np.where(rise <= 0, 0.0, np.where(slope < 0, rise * crossing, rise))

    def predict(self, text: str | None, bounded: bool = True) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, score, shares of the chosen set); the bound saves time only."""
        at, counts = ngram_counts(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0, []
        single = counts @ self.logp[at]
        order = np.argsort(-single, kind="stable")
        chosen, best, share = [int(order[0])], float(single[order[0]]), np.ones(1)
        cost = PENALTY * np.log(counts.sum() + 1)
        others = [int(k) for k in order[1:]]
        if bounded and others:  # the first step alone: its answer is nearly always that no language joins
            most = self.gains_at_most(at, counts, chosen[0])
            hopeful = [k for k in others if most[k] > cost * (1 - 1e-9)]
        else:
            hopeful = others
        while hopeful:
            tried = [(*self.mixture(at, counts, [*chosen, k]), k) for k in hopeful]
            value, new, k = max(tried, key=lambda x: (x[0], -x[2]))
            if value - best <= cost:
                break
            chosen, best, share = [*chosen, k], value, new
            others.remove(k)
            hopeful = others
        top = int(np.argmax(share))
        second = float(single[order[1]]) if len(order) > 1 else -np.inf
        margin = (float(single[order[0]]) - second) / np.sqrt(counts.sum())
        score = float(share[top]) * float(1 - 0.5 * np.exp(-max(0.0, margin)))
        return self.langs[chosen[top]], score, sorted(((self.langs[k], float(s)) for k, s in zip(chosen, share, strict=True)), key=lambda x: -x[1])


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, most: int = MOST) -> LanguageModel:
    """Fit on about `sample` usable labelled rows of each language, picked by a hash of doc_id.

    More than `most` different labels are an error, so the model's size has a bound: a number for each of BUCKETS and language.

    Rows without text, language or doc_id teach nothing; rows that repeat a doc_id are taken or left together. n-grams are counted on the executors; the driver receives at most BUCKETS counts a language.
    """
    rows = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"lang has more than {most} values: not a column of languages, or `most` must be raised")
    if not sizes:
        return LanguageModel((), np.empty((BUCKETS, 0), np.float32))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, -(-sample * 1_000_000 // n)))])
    taken = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(limit, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, counts = ngram_counts(text.as_py())
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += counts
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = taken.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sizes))
    table = np.full((BUCKETS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        table[own["bucket"].to_numpy(dtype=np.int64), k] += own["n"].to_numpy(dtype=np.float64)
    half = BUCKETS // 2
    table[:half] /= table[:half].sum(axis=0)
    table[half:] /= table[half:].sum(axis=0)
    return LanguageModel(langs, np.log(table).astype(np.float32))


def languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, shares), a row per input row, repeated or without doc_id alike; `und` and 0 for texts without letters.

    Only doc_id and the text are read. Languages that explain a text equally well: the first in alphabetical order.
    An empty table gives an empty result; a model without languages calls every text `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            lang, score, shares = zip(*found, strict=True) if found else ((), (), ())
            shares = [[{"lang": a, "share": b} for a, b in s] for s in shares]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((lang, score, shares), kinds, strict=True))], names=["doc_id", "lang_pred", "score", "shares"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def with_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` with the predicted language in `lang`, without rows whose language is unknown or, given `keep`, not listed there.

    All columns stay in place. Rows are judged one by one, repeated or without doc_id alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, to = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [shared.value.predict(t.as_py())[0] for t in batch.column(at)]
            named = batch.set_column(to, batch.schema.field(to), pa.array(langs, batch.schema.field(to).type))
            yield named.filter(pa.array([x != UNKNOWN and (keep is None or x in keep) for x in langs], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def learnable(folds: int = 4, held_out: int = 2) -> Column:
    """Rows whose crc32(doc_id as text) leaves another remainder than the held-out one; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(False))
