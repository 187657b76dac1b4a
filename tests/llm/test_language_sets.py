"""op9: a set of languages grows as long as the penalty allows, whatever the number and ranks of its members."""

import numpy as np

from textloom.llm import language

WORDS = {"a": "ababa bacab", "d": "deded fedef", "g": "gigig hihig", "k": "kokol lokok", "m": "munum nunum", "p": "pyryp ryryp"}


def model():
    table = np.full((language.BUCKETS, len(WORDS)), 0.5)
    for k, words in enumerate(WORDS.values()):
        at, n = language.ngram_counts(f"{words} " * 50)
        table[at, k] += n
    return language.LanguageModel(tuple(WORDS), np.log(table / table.sum(axis=0)).astype(np.float32))


def test_every_language_can_join():
    m = model()
    for n in range(1, len(WORDS) + 1):
        mixed = " ".join(f"{words} " * (40 + 5 * (n - k)) for k, words in enumerate(list(WORDS.values())[:n]))
        lang, score, shares = m.predict(mixed)
        assert lang == "a" and 0 < score <= 1 and {x for x, _ in shares} == set(list(WORDS)[:n])
        assert abs(sum(s for _, s in shares) - 1) < 1e-6
        total = sum(40 + 5 * (n - k) for k in range(n))
        assert all(abs(dict(shares)[x] - (40 + 5 * (n - k)) / total) < 0.03 for k, x in enumerate(list(WORDS)[:n]))


def test_penalty_ends_the_set():
    assert {x for x, _ in model().predict((WORDS["a"] + " ") * 40 + WORDS["m"][:2])[2]} == {"a"}


def test_bound_changes_nothing(sample):
    """With and without the bound, EM chooses the same sets, on real texts and on mixtures of them."""
    m = real_model(sample)
    texts = [t for _, t in sample if t]
    texts = texts[:80] + [a[:400] + " " + b[:300] for a, b in zip(texts, reversed(texts), strict=True)][:80] + [a[:60] for a in texts[:40]]
    for text in texts:
        a, b = m.predict(text), m.predict(text, bounded=False)
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and [x for x, _ in a[2]] == [x for x, _ in b[2]]
    at, n = language.ngram_counts(texts[100])
    first = int(np.argmax(n @ m.logp[at]))
    for k in range(len(m.langs)):
        if k != first:
            assert m.mixture(at, n, [first, k])[0] - float(n @ m.logp[at, first]) <= m.gains_at_most(at, n, first)[k] + 1e-6


def real_model(sample):
    """Four languages made of rotated halves of the sample's letters and the sample itself."""
    texts = [t.lower() for _, t in sample if t]
    turned = [t.translate({97 + k: 97 + (k + s) % 26 for k in range(26)}) for s in (0, 0, 5, 11) for t in texts[s : 60 + s]]
    table = np.full((language.BUCKETS, 4), 0.5)
    for k, text in enumerate(turned):
        at, n = language.ngram_counts(text)
        table[at, k * 4 // len(turned)] += n
    return language.LanguageModel(("a", "b", "c", "d"), np.log(table / table.sum(axis=0)).astype(np.float32))


def test_em_is_the_plain_one():
    """Shares and likelihood of a set equal those of EM written out token by token."""
    m = model()
    at, n = language.ngram_counts((WORDS["a"] + " ") * 7 + (WORDS["g"] + " ") * 3)
    tokens = [b for b, c in zip(at.tolist(), n.tolist(), strict=True) for _ in range(c)]
    members, share = [0, 2, 3], [1 / 3] * 3
    for _ in range(language.ROUNDS):
        sums = [0.0] * 3
        for t in tokens:
            p = [share[j] * np.exp(float(m.logp[t, k])) for j, k in enumerate(members)]
            sums = [a + x / sum(p) for a, x in zip(sums, p, strict=True)]
        share = [x / len(tokens) for x in sums]
    like = sum(np.log(sum(s * np.exp(float(m.logp[t, k])) for s, k in zip(share, members, strict=True))) for t in tokens)
    got = m.mixture(at, n, members)
    assert np.allclose(got[1], share, atol=1e-6) and abs(got[0] - like) < 1e-3


def test_too_many_languages_are_an_error(spark):
    import pytest

    rows = spark.createDataFrame([(k, "some words of a text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="not a column of languages"):
        language.fit(rows, language.learnable(), most=3)
    assert len(language.fit(rows, language.learnable()).langs) > 3
