"""Selection algebra over files: toggling, inverting and filtering as column expressions.

A scope is a boolean column: the files below a node, or those that a filter shows. Toggling selects
the whole scope unless every file of it is already selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def under(parts: Column, node: list[str]) -> Column:
    """The file is the node or stands below it."""
    return F.slice(parts, 1, len(node)) == F.array(*[F.lit(x) for x in node])


def toggle(files: DataFrame, scope: Column, repo: str = "repo_id") -> DataFrame:
    """`selected` after toggling the files in scope; others keep theirs."""
    inside = F.coalesce(scope, F.lit(False))
    full = files.filter(inside).groupBy(repo).agg(F.bool_and("selected").alias("scope_full"))
    flipped = F.when(inside, ~F.coalesce(F.col("scope_full"), F.lit(False))).otherwise(F.col("selected"))
    return files.join(full, repo, "left").withColumn("selected", flipped).select(files.columns)


def toggle_all(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    return toggle(files, F.lit(True), repo)


def chosen(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """The selected files in the order in which a scan lists them: by path, component by component."""
    return files.filter("selected").drop("selected").orderBy(repo, "path_parts")


def invert(files: DataFrame, scope: Column | None = None) -> DataFrame:
    """`selected` turned over in scope."""
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    return files.withColumn("selected", F.when(inside, ~F.col("selected")).otherwise(F.col("selected")))


#: What a matching letter gives; more where a name or a part of one begins, and right behind the letter before it.
LETTER, BOUNDARY, HUMP, RUN = 16, 10, 8, 6
#: What the first letter left out between two matching ones costs, and each further one.
GAP, LONGER = 4, 1


def _quoted(c: str) -> str:
    return "\\" + c if c in r"\.[]{}()*+-?^$|&" else c


def _terms(path: Column, pattern: str) -> list[tuple[str, Column]]:
    """The terms of a pattern, each with the subject it is compared with: terms without A-Z ignore the case of A-Z, others don't."""
    return [(term, path if any("A" <= c <= "Z" for c in term) else paths.ascii_lower(path)) for term in pattern.split()]


def fuzzy_match(path: Column, pattern: str) -> Column:
    """Every term's letters occur in the path in order. Each letter is taken at its first place, so a path is read once per term."""
    found = F.lit(True)
    for term, subject in _terms(path, pattern):
        body = "".join(f"[^{_quoted(a)}]*+{_quoted(a)}" for a in term)
        found = found & F.regexp_like(subject, F.lit(f"(?s)^{body}"))
    return found


def _best_alignment(subject: Column, path: Column, term: str) -> Column:
    """The best score of the term's letters in order in `subject`, null if they don't occur.

    One pass over the letters. `at` holds, for each letter of the term, the best score of the term up to
    it with it standing right here; `gap` the same with it standing further back, gaps paid for.
    """
    none = F.lit(None).cast("int")
    empty = F.array(*[none] * len(term))
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    chars = F.zip_with(letters(subject), letters(path), lambda c, raw: F.struct(c.alias("c"), raw.alias("raw")))
    start = F.struct(empty.alias("at"), empty.alias("gap"), none.alias("best"), F.lit("/").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        bonus = F.when(acc["last"].rlike(r"[/_\-. ]"), BOUNDARY).when(acc["last"].rlike("[a-z]") & x["raw"].rlike("[A-Z]"), HUMP).otherwise(0)
        at, gap = [], []
        for k, letter in enumerate(term):
            before = F.lit(0) if k == 0 else F.greatest(acc["at"][k - 1] + RUN, acc["gap"][k - 1])
            at.append(F.when(x["c"] == F.lit(letter), before + LETTER + bonus))
            gap.append(F.greatest(acc["at"][k] - GAP, acc["gap"][k] - LONGER))
        return F.struct(F.array(*at).alias("at"), F.array(*gap).alias("gap"), F.greatest(acc["best"], at[-1]).alias("best"), x["raw"].alias("last"))

    return F.aggregate(chars, start, step)["best"]


def fuzzy_score(path: Column, pattern: str) -> Column:
    """A documented score of our own, higher is better: the sum over the terms of their best alignment; null if a term doesn't occur.

    A letter gives LETTER, BOUNDARY more at the start of a component or behind one of `_-. `, HUMP more as a capital behind a small
    letter, RUN more right behind the letter before it; letters left out between two of a term's cost GAP for the first and LONGER
    for each further one. What stands before a term's first and behind its last letter is free.
    """
    score = F.lit(0)
    for term, subject in _terms(path, pattern):
        score = score + _best_alignment(subject, path, term)
    return score


def best_match(files: DataFrame, pattern: str, repo: str = "repo_id") -> DataFrame:
    """(repo, path, score): the best matching file of each repository; on ties the first in path order. Only files that match are scored."""
    hits = files.filter(fuzzy_match(F.col("path"), pattern)).withColumn("score", fuzzy_score(F.col("path"), pattern))
    first = F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), F.col("path_parts"))).alias("first")
    return hits.groupBy(repo).agg(first).select(repo, "first.path", "first.score")
