"""op3, op6, op9: learned operators on held-out rows and on hard input."""

import re
import zlib
from collections import Counter

import numpy as np
from cases import HARD
from pyspark.sql import functions as F

from textloom.llm import importance, language, queries, toxicity


def test_language_held_out(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op9_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.97


def model():
    texts = {"en": "the quick brown fox and the other thing with that", "de": "der schnelle braune fuchs und das andere ding mit dem", "fr": "le renard brun rapide et une autre chose avec cela"}
    table = np.full((language.BUCKETS, 3), 0.5)
    langs = tuple(sorted(texts))
    for k, lang in enumerate(langs):
        at, n = language.ngram_counts(texts[lang] * 3)
        table[at, k] += n
    return language.LanguageModel(langs, np.log(table / table.sum(axis=0)).astype(np.float32)), texts


def test_language_mixture(spark, hard, empty):
    m, texts = model()
    for lang, t in texts.items():
        assert m.predict(t)[0] == lang
    both = m.predict(texts["en"] * 6 + " " + texts["de"] * 3)
    assert both[0] == "en" and {x for x, _ in both[2]} == {"en", "de"} and abs(dict(both[2])["de"] - 1 / 3) < 0.15
    for t in (None, "", " 12 !? \n"):
        assert m.predict(t) == ("und", 0.0, [])
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(hard, m).filter("doc_id is not null").collect()}
    assert got[1] == got[2] == got[3] == got[10] == "und" and got[4] != "und" and got[7] != "und"
    left = language.with_language(hard, m)
    assert left.columns == hard.columns and left.count() == len(HARD) - 5
    named = {r["doc_id"]: r["lang"] for r in left.collect()}
    assert all(named[d] == got[d] for d in named if d is not None)  # the prediction takes the place of the label
    assert language.with_language(hard, m, keep=("xx",)).count() == 0
    assert language.languages(empty, m).count() == 0
    nothing = language.fit(empty, language.learnable())
    assert nothing.langs == () and nothing.predict("text")[0] == "und"
    assert language.fit(hard.withColumn("lang", F.lit(None).cast("string")), language.learnable()).langs == ()


INSULTS = ["grobnik", "vratuul", "mizzerk"]


def toxic_corpus(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["the", "on", "er", "ti", "an", "re", "in", "ou", "st", "ha"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)]
        y = int(k % 5 == 0)
        if y:
            for w in rng.choice(INSULTS, 3):
                words.insert(int(rng.integers(0, 40)), str(w))
        rows.append((" ".join(words), y))
    return rows


def test_toxicity_generalises():
    train = toxic_corpus(400, 1)
    m = toxicity.fit_texts([t for t, _ in train], [y for _, y in train])
    scorer = toxicity.Scorer(m)
    test = toxic_corpus(200, 2)
    p = np.array([m.score(*x) for x in scorer.tops([t for t, _ in test])])
    y = np.array([y for _, y in test])
    assert ((p >= toxicity.THRESHOLD) == y).mean() > 0.98
    clean = "the onerti anre inou sthaon the ertian reonin "
    hidden = ["gr.ob.nik", "GROBNIK!!", "v r a t u u l", "mizz3rk", "grobnikes", "grobbnik"]
    scores = {w: m.score(*scorer.tops([f"{clean}{w} {clean}{w} {clean}"])[0]) for w in hidden}
    base = m.score(*scorer.tops([clean])[0])
    assert all(s > base for s in scores.values()), scores
    assert all(scores[w] >= toxicity.THRESHOLD for w in hidden[:4]), scores


def plain_kernel(one, other):
    """By definition: common sequences of four symbols within the span, over the strings' masses."""
    from itertools import combinations

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                key = bytes(s[k] for k in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    def mass(n):
        n = min(max(n, 4), toxicity.LONG)
        return sum(toxicity.DECAY ** (2 * (at[3] + 1)) for k in range(n) for at in combinations(range(min(toxicity.SPAN, n - k)), 4) if at[0] == 0) ** 0.5

    a, b = weights(one), weights(other)
    return sum(v * b.get(k, 0) for k, v in a.items()) / mass(len(one)) / mass(len(other))


def test_toxicity_scores_are_the_plain_ones(spark):
    """The fit on tables is the fit in one process; its coefficients are the optimum; scores follow from the kernel by definition."""
    train = toxic_corpus(150, 4)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, (t, _) in enumerate(train)] + [(900, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(train)] + [(900, 0)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    halves = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).alias("h")).collect()}
    order = [(t, y, halves[k]) for k, (t, y) in enumerate(train)] + [(None, 0, halves[900])]
    mine = toxicity.fit(docs, labels, F.lit(True))
    # the same in this process, with the same halves
    groups = [2 * h + y for _, y, h in order]
    words, n = toxicity.word_counts([t for t, _, _ in order], groups, 4)
    sizes = np.bincount(groups, minlength=4)
    both, total = n[:2] + n[2:], sizes[:2] + sizes[2:]
    odds = np.log((both[1] + 0.5) / (total[1] + 1)) - np.log((both[0] + 0.5) / (total[0] + 1))
    by = sorted(range(len(words)), key=lambda k: (-odds[k] * np.sqrt(both[:, k].sum()), -both[:, k].sum(), words[k]))
    telling = [words[k] for k in by if odds[k] > 0.5][: 3 * toxicity.LANDMARKS]
    common = sorted((k for k in range(len(words)) if odds[k] < 0.5), key=lambda k: (-both[:, k].sum(), words[k]))[: 2 * toxicity.LANDMARKS]
    marks = toxicity.landmarks(telling, [words[k] for k in common])
    whiten = toxicity.whitening(marks)
    phi = np.array([[plain_kernel(w, m) for m in marks] for w in words]) @ whiten
    foul, clean = toxicity.aims(both.T.astype(float), total)
    assert (foul > 0).any() and (clean > 0).all()
    (w,) = toxicity.newton(lambda ws: [toxicity.equations(phi, foul, clean, ws[0])], len(marks) + 1, 1)
    rows = np.hstack((phi, np.ones((len(phi), 1))))
    decided = rows @ w
    slope = rows.T @ (-np.maximum(0, 1 - decided) * foul + np.maximum(0, 1 + decided) * clean) + np.append(toxicity.RIDGE * w[:-1], 1e-6 * w[-1])
    assert np.abs(slope).max() < 1e-6 * (foul.sum() + clean.sum())
    symbols_to_text = {toxicity.cleaned(x): x for t, _, _ in order for x in (t or "").split()}
    texts = [symbols_to_text[x] for x in words]
    assert np.allclose(mine.words(texts), np.maximum(toxicity.FLOOR, decided), atol=2e-3)
    # a text's score is the logistic of its two highest words
    a, b, c = mine.logistic
    want = {}
    value = dict(zip(texts, mine.words(texts)))
    for k, (t, _, _) in enumerate(order[:-1]):
        top = sorted((value.get(x, toxicity.FLOOR) for x in t.split()), reverse=True)[:2]
        want[k] = 1 / (1 + np.exp(-(a * top[0] + b * top[1] + c)))
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, mine).collect()}
    assert all(abs(scores[k] - v) < 1e-9 for k, v in want.items())


def test_toxicity_with_one_half_lacking_a_class(spark):
    from pyspark.sql import functions as F

    train = toxic_corpus(40, 5)
    halves = {r["id"]: r["h"] for r in spark.range(40).select("id", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).alias("h")).collect()}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(train)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y if halves[k] else 0) for k, (_, y) in enumerate(train)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert np.isfinite(model.weights).all() and np.isfinite(model.logistic).all()
    blank = spark.createDataFrame([(0, "1 2 3"), (1, "a b")], "doc_id long, text string")
    assert toxicity.fit(blank, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"), F.lit(True)).score(9.0, 9.0) < toxicity.THRESHOLD


def test_toxicity_hard(spark, hard, empty):
    m = toxicity.fit_texts(*map(list, zip(*toxic_corpus(60, 3), strict=True)))
    got = toxicity.toxicity(hard, m).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, m).count() == 0
    labels = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int")
    none = toxicity.fit(hard, labels, toxicity.learnable())
    assert none.score(1.0, 1.0) < toxicity.THRESHOLD


def test_toxicity_query(spark, sf_dir):
    got = queries.op3_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_kernel_is_positive():
    words = [toxicity.cleaned(w) for w in ("grobnik", "grobnika", "onerti", "the", "anre", "vratuul", "ouou")]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, k.T, atol=1e-6) and np.linalg.eigvalsh((k + k.T) / 2).min() > -1e-6 and k[0, 1] > k[0, 2]


def test_folded_weights_are_the_kernel():
    """A word's folded score equals the SVM's decision from its kernel values with the landmarks."""
    marks = [toxicity.cleaned(w) for w in ("grobnik", "onerti", "vratuul", "the")]
    beta = np.array([1.5, -0.4, 2.0, -1.0])
    table = np.zeros(toxicity.SLOTS)
    symbols, starts, sizes = toxicity.flat(marks)
    owner = np.searchsorted(starts, np.arange(len(symbols)), side="right") - 1
    for at, codes, weight in toxicity.features(symbols):
        np.add.at(table, codes, weight * (beta / toxicity.norms(sizes))[owner[at]])
    words = ["grobnik", "grob.nik", "xgrobnikx", "onerti", "vratul", "zzz", "thethe"]
    got = toxicity.ToxicityModel(table, -0.1).words(words)
    want = toxicity.kernel([toxicity.cleaned(w) for w in words], marks) @ beta - 0.1
    assert np.allclose(got, np.maximum(toxicity.FLOOR, want), atol=1e-5)


def test_kernel_counts_subsequences():
    """Against the definition: common sequences of four symbols within SPAN, weighted by the symbols they span."""
    from itertools import combinations

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                key = bytes(s[k] for k in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    words = [toxicity.cleaned(w) for w in ("grobnik", "grabnik", "groobnik", "the", "onerti")]
    k, sizes = toxicity.kernel(words, words), np.array([len(w) for w in words])
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = weights(a), weights(b)
            assert np.isclose(k[i, j], sum(v * y.get(key, 0) for key, v in x.items()) / (toxicity.norms(sizes)[i] * toxicity.norms(sizes)[j]), rtol=1e-5)


def test_toxicity_held_out(spark):
    """Recall and clean documents on labelled rows that the fit hasn't seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, toxicity.learnable())
    seen = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), m).join(labels, "doc_id").collect()
    held = [(r["score"] >= toxicity.THRESHOLD, r["toxic"]) for r in seen if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([p for p, y in held if y]) > 0.88 and np.mean([p for p, y in held if not y]) < 0.012


def plain_log_ratio(docs, good):
    """Importance written out: counts by bucket of words and word pairs over all and over the target rows."""
    mask = (1 << 64) - 1

    def buckets(text):
        ones = []
        for w in re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode().lower()):
            h = sum((b + 1) * pow(0x100000001B3, (i & 63) + 1, 1 << 64) for i, b in enumerate(w)) & mask
            ones.append(((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask)
        pairs = []
        for a, b in zip(ones, ones[1:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 & mask) ^ b >> 3
            pairs.append(((h ^ h >> 31) * 0x94D049BB133111EB) & mask)
        return [(h >> 17) % importance.BUCKETS for h in ones + pairs]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(buckets(t))
        if d in good:
            target.update(buckets(t))
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + importance.BUCKETS)
    return {d: sum(np.log(p(target, b)) - np.log(p(raw, b)) for b in buckets(t)) for d, t in docs}


def test_importance_is_the_plain_one(spark, docs_of, sample):
    """Weights against counts written out; the draw takes the k largest keys, whose noise is Gumbel and follows doc_id alone."""
    rows = [(d, t) for d, t in sample if t is not None and len(t) < 3000][:60] + [(9001, None), (9002, ""), (9003, "A-b a!! b")]
    good = {d for d, _ in rows[::4]}
    labels = spark.createDataFrame([(d, int(d in good)) for d, _ in rows], "doc_id long, quality int")
    got = importance.resampled(docs_of(rows), labels, share=0.3).collect()
    want = plain_log_ratio(rows, good)
    assert all(abs(r["log_weight"] - want[r["doc_id"]]) < 1e-6 for r in got)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    k = round(0.3 * len(rows))
    assert all(r["kept"] == (r["gumbel_key"] >= keys[k - 1]) for r in got) and sum(r["kept"] for r in got) == k
    other = importance.resampled(docs_of([(d, "x y") for d, _ in rows]), labels, share=0.3).collect()
    noise = {r["doc_id"]: r["gumbel_key"] - r["log_weight"] for r in got}
    assert all(abs(noise[r["doc_id"]] - (r["gumbel_key"] - r["log_weight"])) < 1e-9 for r in other)
    many = importance.resampled(docs_of([(d, None) for d in range(4000)]), labels, share=0.5).toPandas()["gumbel_key"]
    assert abs(many.mean() - 0.5772) < 0.08 and abs(many.std() - np.pi / np.sqrt(6)) < 0.08


def test_importance(spark, sf_dir):
    got = queries.op6_importance(spark, sf_dir)
    rows = {r["doc_id"]: r for r in got.collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    share = sum(q > 0 for q in quality.values()) / len(quality)
    assert sum(r["kept"] for r in rows.values()) == round(share * len(rows))
    assert min(r["gumbel_key"] for r in rows.values() if r["kept"]) > max(r["gumbel_key"] for r in rows.values() if not r["kept"])
    good = [rows[d]["kept"] for d, q in quality.items() if q]
    assert np.mean(good) > 0.95
    again = {r["doc_id"]: r["gumbel_key"] for r in queries.op6_importance(spark, sf_dir).collect()}
    assert all(abs(again[d] - r["gumbel_key"]) < 1e-9 for d, r in rows.items())


def test_importance_hard(spark, hard, empty):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = importance.resampled(hard, labels, share=0.5).collect()
    assert len(got) == len(HARD) and all(r["log_weight"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert importance.resampled(empty, none).count() == 0
    assert all(r["kept"] for r in importance.resampled(hard, none).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.normal(0, 1, 300), [5.0] * 40, [-1e9, 1e9])).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 30, 41, 200, len(values)):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    for values in ([1.0, 1.0, float(np.nextafter(1, 2))], [0.0, 5e-324, -5e-324], [7.0] * 5, [1e300, -1e300, float(np.nextafter(1e300, 0))]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert [importance.kth_largest(df, "x", k + 1) for k in range(len(values))] == sorted(values, reverse=True)
