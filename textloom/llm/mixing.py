"""Mixing sources to target weights by systematic sampling.

Every source gets a share of the mix by its weight, up to a limit of copies. Within a source each
document expects target / size copies. Documents are laid end to end by their expected copies, the
whole is moved by one random offset, and a document is emitted once for each integer boundary that
it crosses. As documents lie in order of size, what a source gives differs from its target by
little more than its longest document.

Order and prefix sums are made in ranges (see `operators.order`): a source that holds a third of
all rows is spread over many ranges. Expected copies are decimals, so the sums are exact, and where
one range ends the next begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import RANGE, bases, before, numbered, ranged, same_keys
from .scratch import SMALL, staged

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix as percent of all sizes.
PERCENT = 150
#: At most so many copies of a document.
MOST = 2
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"
COPIES = "decimal(20,12)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """A number over 0 and under 1 that is made from a text."""
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def targets(sources: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size, weight), a stored table.

    Targets are in proportion to the weights, but at most `most` times a source's size. What a
    source can't take is shared anew among the others, until none is above: a round counts the
    sources that the present level fills, and ends when the count stays.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, level, full = percent * total / 100, 0.0, -1
    while True:
        filled = cap <= F.lit(level) * F.col("weight")
        n, taken, weight = sources.agg(F.coalesce(F.sum(filled.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(filled, cap)), F.lit(0)), F.sum(F.when(~filled, F.col("weight")))).first()
        if n == full or not weight:
            break
        full, level = n, (share - taken) / weight
    target = F.when(cap <= F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", (target if weight else cap.cast("double")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row per input row: copies of it are in the mix, `taken` words in all.

    size is the number of words (null: 0). Sources stand in code-point order, a missing one last; it is
    a source like any other. Documents of a source are laid out by size, longest first, equal sizes by
    a hash of doc_id, then by doc_id (a missing one last); rows that repeat a doc_id and size are exchangeable. Texts without words
    and sources without any give nothing. Reruns give the same mix. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    place = [(-F.col("size")).alias("a"), _unit(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("b"), F.col("doc_id").isNull().alias("c"), F.col("doc_id").alias("d")]
    stored = ranged(own.withColumn("place", F.struct(*place)), "source", F.col("place"), "mix-rows")

    known = staged(stored.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # sources may be many: their places, too, are found in ranges
    rank = numbered(known.withColumn("last", F.col("source").isNull()).withColumn("all", F.lit(0)), "all", ["last", "source"], "mix-order").drop("all", "last")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("number") - 1) % len(weights)).cast("int"))
    aims = staged(targets(staged(rank.withColumn("weight", weight), "mix-weights"), percent, most), "mix-targets")
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).cast(COPIES)
    aims = aims.withColumn("expected", each).withColumn("offset", _unit(F.concat_ws(":", F.lit(seed), F.lit("source"), F.col("source"))).cast(COPIES))

    # a row of a range meets its source's numbers by (source, range), so no source is one key of the join
    starts = same_keys(bases(stored, "source", F.lit(1)), F.broadcast(aims) if aims.limit(SMALL + 1).count() <= SMALL else aims, ["source"]).drop("base")
    rows = same_keys(stored, starts, ["source", RANGE])
    laid = before(rows, "source", [F.col("place")], F.col("expected"))
    crossed = F.floor(F.col("before") + F.col("expected") + F.col("offset")) - F.floor(F.col("before") + F.col("offset"))
    return laid.withColumn("copies", crossed.cast("long")).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
