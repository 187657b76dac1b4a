"""Fitting a repository into a token budget.

Files are ordered by tier, then tokens, size and path, all three descending. First outlines replace
contents: a file is outlined if that saves tokens and the total less the savings of the files
before is still over the budget. Then files are dropped in the (new) order by the same rule. As
savings and sizes only add up, each phase ends at one key per repository: everything before it is
outlined (or dropped), nothing behind it. These cuts are found on stored keys of the repositories that are
over the budget, without contents, and a last scan compares each file with the cuts of its repository. Keys of a
repository go through windows in one task while they are known to be few; where a repository has more,
all go through ranges (see `order`), with the same outcome. Only files that will
be outlined, or may be in a repository over its budget, reach the outline function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, tokens
from ..staging import SMALL, staged
from .order import last_spent, ranged, same_keys


def _key(tok: Column, size: Column) -> Column:
    """Largest first: lowest tier, then most tokens, bytes, and last path."""
    return F.struct((-F.col("tier")).alias("rank"), tok.alias("tok"), size.alias("size"), F.col("path_parts").alias("path_parts"))


#: Files of a repository whose keys one task may sort.
FEW = 200_000


def _after(keys: DataFrame, cut_1: Column) -> DataFrame:
    """`keys` with key_1: what a file's key becomes when those up to the first cut are outlined."""
    taken = (F.col("saving") > 0) & F.coalesce(F.col("key_0") >= cut_1, F.lit(False))
    tok_1 = F.col("key_0.tok") - F.when(taken, F.col("saving")).otherwise(F.lit(0))
    return keys.withColumn("key_1", _key(tok_1, F.when(taken, F.col("size_o")).otherwise(F.col("key_0.size"))))


def _cuts_in_windows(keys: DataFrame, totals: DataFrame, budget: int, repo: str) -> DataFrame:
    """(repo, cut_1, cut_2): both phases over each repository's keys."""
    whole = Window.partitionBy(repo)
    before = lambda key, value: F.coalesce(F.sum(value).over(whole.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = same_keys(keys, totals, [repo]).withColumn("spent", before("key_0", F.col("saving")) < F.col("total_0") - budget)
    first = first.withColumn("cut_1", F.min(F.when(F.col("spent"), F.col("key_0"))).over(whole))
    second = _after(first, F.col("cut_1"))
    second = second.withColumn("spent", before("key_1", F.col("key_1.tok")) < F.sum("key_1.tok").over(whole) - budget)
    return second.groupBy(repo).agg(F.first("cut_1").alias("cut_1"), F.min(F.when(F.col("spent"), F.col("key_1"))).alias("cut_2"))


def _cuts_in_ranges(keys: DataFrame, totals: DataFrame, budget: int, repo: str, small: bool) -> DataFrame:
    """As `_cuts_in_windows`, for repositories of any size."""
    lookup = F.broadcast if small else lambda t: t
    stored = ranged(keys, repo, F.col("key_0").desc(), "outline-keys", stored=True)
    cut_1 = staged(last_spent(stored, repo, "key_0", "saving", totals.select(repo, (F.col("total_0") - budget).alias("need"))).withColumnRenamed("cut", "cut_1"), "outline-cuts")
    after = _after(same_keys(stored.drop("range_no"), lookup(cut_1), [repo], "left"), F.col("cut_1")).select(repo, "key_1")
    second = ranged(after, repo, F.col("key_1").desc(), "fitted-keys").withColumn("tok_1", F.col("key_1.tok"))
    left = second.groupBy(repo).agg((F.sum("tok_1") - budget).alias("need"))
    cut_2 = last_spent(second, repo, "key_1", "tok_1", left).withColumnRenamed("cut", "cut_2")
    return same_keys(same_keys(totals.select(repo), cut_1, [repo], "left"), cut_2, [repo], "left")


def fit_budget(files: DataFrame, budget: int, outline: Column | None = None, factor: float = 1.0, repo: str = "repo_id", count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds tier, content_fit, tokens_fit, outlined and kept to a FILE relation; rows over the budget have kept false.

    `outline` is the outlined content, null where there is none; it reads the column `content`. `count` counts a text's tokens, by default
    the estimate times `factor`; a row's own token_count is taken where it has one. Null contents count as empty. A repository
    within its budget stays as it is. Rows that repeat a path, tokens and size are decided alike. Rows without a repository are
    one repository. An empty relation gives an empty result.
    """
    size_of = lambda c: F.octet_length(c).cast("bigint")
    count = count or (lambda c: tokens.scaled(tokens.estimate(c), factor))
    whole = files.withColumn("content", F.coalesce(F.col("content"), F.lit(""))).withColumn("tier", paths.compression_tier(F.col("path")))
    own = whole.withColumn("tok_0", F.coalesce(F.col("token_count"), count(F.when(F.col("token_count").isNull(), F.col("content")))) if "token_count" in files.columns else count(F.col("content")))
    own = own.withColumn("key_0", _key(F.col("tok_0"), size_of("content")))
    totals = staged(own.groupBy(repo).agg(F.sum("tok_0").alias("total_0"), F.count("*").alias("n_files")).filter(F.col("total_0") > budget), "over-budget")
    n_repos, most = totals.agg(F.count("*"), F.max("n_files")).first()
    small = n_repos <= SMALL
    lookup = F.broadcast if small else lambda t: t

    def outlined_in(rows: DataFrame, wanted: Column) -> DataFrame:
        """outline_text and saving (0: none) of the wanted rows; the others' contents don't reach the outline."""
        asked = rows.withColumn("whole", F.col("content")).withColumn("content", F.when(wanted, F.col("content")))
        asked = asked.withColumn("outline_text", F.when(wanted, outline)).withColumn("content", F.col("whole")).drop("whole")
        asked = asked.withColumn("tok_o", count(F.col("outline_text")))
        smaller = (size_of("outline_text") < size_of("content")) & (F.col("tok_o") < F.col("tok_0"))
        return asked.withColumn("saving", F.when(F.coalesce(smaller, F.lit(False)), F.col("tok_0") - F.col("tok_o")).otherwise(F.lit(0)).cast("bigint"))

    if n_repos:
        over = same_keys(own, lookup(totals.select(repo)), [repo])
        over = outlined_in(over, F.lit(True)).withColumn("size_o", size_of("outline_text")) if outline is not None else over.withColumns({"saving": F.lit(0).cast("bigint"), "size_o": F.lit(None).cast("bigint")})
        keys = staged(over.select(repo, "tier", "path_parts", "key_0", "saving", "size_o"), "budget-keys")
        cuts = _cuts_in_windows(keys, totals, budget, repo) if most <= FEW else _cuts_in_ranges(keys, totals, budget, repo, small)
        decided = same_keys(own, lookup(staged(cuts, "cuts")), [repo], "left")
    else:
        none = F.lit(None).cast(own.schema["key_0"].dataType)
        decided = own.withColumns({"cut_1": none, "cut_2": none})
    if outline is not None:
        reached = F.coalesce(F.col("key_0") >= F.col("cut_1"), F.lit(False))
        fitted = outlined_in(decided.withColumn("reached", reached), F.col("reached")).withColumn("outlined", F.col("saving") > 0)
        fitted = fitted.withColumn("content_fit", F.when(F.col("outlined"), F.col("outline_text")).otherwise(F.col("content"))).withColumn("tokens_fit", F.col("tok_0") - F.col("saving"))
    else:
        fitted = decided.withColumn("outlined", F.lit(False)).withColumn("content_fit", F.col("content")).withColumn("tokens_fit", F.col("tok_0"))
    dropped = F.coalesce(_key(F.col("tokens_fit"), size_of("content_fit")) >= F.col("cut_2"), F.lit(False))
    return fitted.withColumn("kept", ~dropped).select(*files.columns, "tier", "content_fit", "tokens_fit", "outlined", "kept")


def affected(fitted: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, affected): files that were outlined or dropped; one that was both counts once."""
    return fitted.groupBy(repo).agg(F.sum((F.col("outlined") | ~F.col("kept")).cast("bigint")).alias("affected"))
