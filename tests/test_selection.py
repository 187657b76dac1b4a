"""Fuzzy matching and scoring against brute force; inputs on which a naive pattern backtracks or overflows."""

import itertools
import random
import time

from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.operators import budget, selection
from textloom.operators import format as shape

from test_pack import relation


def best_by_enumeration(path, term):
    """All ways to place the letters."""
    low = path if any(c.isupper() for c in term) else path.lower()
    best = None
    for places in itertools.combinations(range(len(path)), len(term)):
        if any(low[i] != c for i, c in zip(places, term)):
            continue
        score = 0
        for k, i in enumerate(places):
            score += selection.LETTER
            if i == 0 or path[i - 1] in "/_-. ":
                score += selection.BOUNDARY
            elif path[i - 1].islower() and path[i].isupper():
                score += selection.HUMP
            if k and i == places[k - 1] + 1:
                score += selection.RUN
            elif k:
                score -= selection.GAP + (i - places[k - 1] - 2) * selection.LONGER
        best = score if best is None else max(best, score)
    return best


def test_score_is_the_best_alignment(spark):
    rng = random.Random(3)
    paths = ["".join(rng.choice("abAB/_-.") for _ in range(rng.randint(0, 11))) for _ in range(150)] + ["", "aB", "src/main.rs"]
    for pattern in ("a", "ab", "aab", "aB b", "ba a"):
        rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", selection.fuzzy_match(F.col("path"), pattern).alias("hit"), selection.fuzzy_score(F.col("path"), pattern).alias("score")).collect()
        for r in rows:
            parts = [best_by_enumeration(r["path"], term) for term in pattern.split()]
            want = None if None in parts else sum(parts)
            assert (r["score"], r["hit"]) == (want, want is not None), (pattern, r)


def test_best_match(spark):
    files = relation(spark, {"src/main.rs": "", "src/domain.rs": "", "some/arc.rs": "", "docs/a.md": ""})
    assert [tuple(r) for r in selection.best_match(files, "src ma").select("repo_id", "path").collect()] == [("r", "src/main.rs")]
    assert selection.best_match(files, "Src").count() == 0
    assert selection.best_match(files, "  ").select("path").collect()[0][0] == "docs/a.md"


def test_long_paths_match_in_linear_time(spark):
    path = "a" * 200_000
    began = time.perf_counter()
    row = spark.createDataFrame([(path,), (path + "b",), ("x\ny",)], "path string").select(selection.fuzzy_match(F.col("path"), "aaaaab"), selection.fuzzy_match(F.col("path"), "xy")).collect()
    assert [tuple(r) for r in row] == [(False, False), (True, False), (False, True)]
    assert time.perf_counter() - began < 20


def test_many_fillers(spark):
    texts = ["please generate a video of " * 100_000 + "a cat", "Please create, a dog", "please create a video of: please create -- x", "i want to see a hen", "a" + " " * 200_000 + "b", "a" + "." * 200_000 + "b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.strip_fillers(F.col("t"))).collect()]
    assert got == ["a cat", "a dog", "x", "a hen", texts[4], texts[5]]
    assert spark.createDataFrame([(texts[5],)], "t string").select(prompts.shots(F.col("t"))).head()[0] == [texts[5]]


def test_missing_repository_has_a_budget(spark):
    rows = relation(spark, {"a.rs": "x" * 400, "b.rs": "y" * 400}, repo=None)
    for files in (rows, rows.union(relation(spark, {"a.rs": "x" * 400}))):
        kept = {(r["repo_id"], r["path"]): r["kept"] for r in budget.fit_budget(files, 120).collect()}
        assert kept[None, "b.rs"] is False and kept[None, "a.rs"] is True and kept.get(("r", "a.rs"), True)


def test_repeated_paths_are_numbered_alike(spark):
    once = [(None, "a"), ("r", "a"), ("r", "a"), ("r", "b"), ("r", "a")]
    files = spark.createDataFrame([(repo, p, [p], 1, "z" if k == 1 else "y", None, False) for k, (repo, p) in enumerate(once)], "repo_id string, path string, path_parts array<string>, size_bytes bigint, content string, token_count bigint, is_outlined boolean")
    blocks = shape.blocks(files, "tool-call").collect()
    assert len(blocks) == 5
    for row in shape.documents(files, "tool-call").collect():
        own = sorted((b["block"] for b in blocks if b["repo_id"] == row["repo_id"]), key=lambda b: int(b.split("call_read_file_")[1].split('"')[0]))
        assert row["document"] == "[\n" + ",\n".join(own) + "\n]\n"
    assert shape.documents(files, "tool-call", repos=files).count() == 2
