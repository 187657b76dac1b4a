"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are compared with numpy exclusive-or and bit counts in tiles; tiles whose population
counts differ by more than the radius are never dealt together. To keep the work of a large corpus
in proportion, fingerprints first go to homes by their segments: two that differ in at most r bits
agree in at least p - r of p segments, so every linked pair meets in some home and no pair is missed
(homes whose hashes agree only share their comparisons). A home over `TILE` fingerprints is cut, in
order of population count, into tiles; a tile meets only the tiles of counts within the radius, and
each such pair is a unit of work of its own, so one crowded home is worked on by many tasks.

Equal fingerprints are one node, so a group of exact copies costs a single comparison. A unit
emits the connected components it finds as stars, never the pairs in a group; the components of
the whole are found from these by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spread, staged
from .survivors import text_key, without

RADIUS = 3
SEED = 42
TILE = 4096
#: Rows of a tile that are compared with one tile at a time.
EDGE = 64


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of the word shingles of the text, A-Z lower-cased; repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    h = shingle_hashes(text)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, fp long[, text_key]): the 64 bits as a signed number; a row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", "text_key"][: len(batch.columns)])

    key = [text_key(F.col(text_col)).alias("text_key")] * with_key
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), *key)).mapInArrow(run, "doc_id long, fp long" + ", text_key string" * with_key)


def local_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """Component label (an index) of each fingerprint under links at `radius` or fewer bits.

    Fingerprints are sorted by population count. Each step compares a tile of up to EDGE reached
    ones with those not reached yet whose counts are within the radius of the tile's.
    """
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    bits, pops = fps[order], np.bitwise_count(fps)[order].astype(np.int64)
    label = np.empty(len(fps), dtype=np.int64)
    todo = np.arange(len(fps))
    while len(todo):
        seed, todo = todo[:1], todo[1:]
        label[seed] = seed
        queue = [seed]
        root = seed[0]
        while queue and len(todo):
            tile = queue.pop()
            if len(tile) > EDGE:
                queue.append(tile[EDGE:])
                tile = tile[:EDGE]
            own = pops[todo]
            a = np.searchsorted(own, pops[tile].min() - radius, side="left")
            b = np.searchsorted(own, pops[tile].max() + radius, side="right")
            near = np.zeros(len(todo), dtype=bool)
            for x in range(a, b, 8192):
                y = min(b, x + 8192)
                near[x:y] = (np.bitwise_count(bits[tile][:, None] ^ bits[todo[x:y]][None, :]) <= radius).any(axis=0)
            if near.any():
                found = todo[near]
                label[found] = root
                todo = todo[~near]
                queue.append(found)
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[label]
    return out


def _stars(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smaller node) of rows sorted by key; whole groups only."""
    us, vs = [], []
    pops = np.bitwise_count(fps).astype(np.int64)
    by = np.lexsort((pops, keys))
    keys, fps, nodes, pops = keys[by], fps[by], nodes[by], pops[by]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(cut, len(keys)))
    small = np.repeat(size <= EDGE, size)
    for d in range(1, int(size[size <= EDGE].max(initial=1))):  # small groups: each row with the d-th after it, while counts are near
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:] & (pops[d:] - pops[:-d] <= radius))
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        us.append(np.maximum(nodes[i], nodes[i + d]))
        vs.append(np.minimum(nodes[i], nodes[i + d]))
    for a, n in zip(cut[size > EDGE].tolist(), size[size > EDGE].tolist(), strict=True):
        own = nodes[a : a + n]
        by = np.argsort(own, kind="stable")
        label = local_components(fps[a : a + n][by], radius)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label, own[by])
        us.append(own[by])
        vs.append(least[label])
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    return u[u != v], v[u != v]


def segments_for(n: int, radius: int = RADIUS) -> int:
    """Segments into which fingerprints are cut: the fewest with which n random ones leave at most EDGE in a home."""
    parts = radius + 1
    while parts < 2 * radius and n >> 64 * (parts - radius) // parts > EDGE:
        parts += 1
    return parts


def tile_plan(homes: DataFrame, radius: int) -> DataFrame:
    """(home, pop, tile, subs, partners): the tile of each population count of a crowded home, and the tiles it meets.

    Tiles are ranges of counts of some TILE rows; a count with more rows is cut into `subs` by hash.
    Everything here is by home and count: at most 65 rows a home.
    """
    counted = homes.groupBy("home", F.bit_count("fp").cast("int").alias("pop")).agg(F.count("*").alias("n"))
    by_home = Window.partitionBy("home")
    before = F.sum("n").over(by_home.orderBy("pop")) - F.col("n")
    ranged = counted.withColumn("total", F.sum("n").over(by_home)).filter(F.col("total") > TILE).withColumn("tile", F.floor(before / F.lit(TILE)).cast("int"))
    tiles = ranged.groupBy("home", "tile").agg(F.min("pop").alias("low"), F.max("pop").alias("high"), F.sum("n").alias("rows"))
    tiles = tiles.withColumn("subs", F.ceil(F.col("rows") / F.lit(TILE)).cast("int"))
    all_tiles = F.collect_list(F.struct("tile", "low", "high", "subs")).over(by_home)  # at most 65
    near = F.filter("every", lambda t: (t["low"] - F.col("high") <= radius) & (F.col("low") - t["high"] <= radius))
    met = tiles.withColumn("every", all_tiles).select("home", "tile", "subs", F.transform(near, lambda t: F.struct(t["tile"].alias("tile"), t["subs"].alias("subs"))).alias("partners"))
    return ranged.select("home", "pop", "tile").join(met, ["home", "tile"])


def links(nodes: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Star edges (u, v), v < u, whose components are those of all links among `nodes` (fp, node).

    The 64 bits are cut into `parts` segments, by default as many as the number of nodes asks for.
    At least parts - radius of them agree in a linked pair, so each choice of that many segments is a
    home. More parts make more and smaller homes: 6 give 20 homes of 32 bits each.
    """
    parts = parts or segments_for(nodes.count(), radius)
    cuts = [64 * k // parts for k in range(parts + 1)]
    values = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(F.lit(n), *[values[k] for k in chosen]) for n, chosen in enumerate(combinations(range(parts), parts - radius))]
    homes = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("home"))
    crowd = staged(homes.groupBy("home").count().filter("count > 1"), "homes")
    shared = homes.join(crowd, "home")
    modest = shared.filter(F.col("count") <= TILE).select("fp", "node", F.col("home").alias("unit"))
    units = modest
    if not crowd.filter(F.col("count") > TILE).isEmpty():
        crowded = shared.filter(F.col("count") > TILE).select("home", "fp", "node")
        plan = staged(tile_plan(crowded, radius), "tiles")
        own = F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int")
        dealt = (
            crowded.withColumn("pop", F.bit_count("fp").cast("int")).join(plan, ["home", "pop"]).withColumn("own", F.struct(F.col("tile").alias("tile"), own.alias("sub")))
            .withColumn("partner", F.explode("partners")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("partner.subs") - 1)))
            .withColumn("other", F.struct(F.col("partner.tile").alias("tile"), F.col("sub").alias("sub")))
        )
        units = modest.union(dealt.select("fp", "node", F.xxhash64("home", F.least("own", "other"), F.greatest("own", "other")).alias("unit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3  # of the unit that may go on in the next batch
        for batch in batches:
            held = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
            rest = [c[last:] for c in held]
            u, v = _stars(held[0][:last], held[1][:last].view(np.uint64), held[2][:last], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        u, v = _stars(rest[0], rest[1].view(np.uint64), rest[2], radius)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    # units whose hashes agree would only be compared with each other, too: links stay exact
    dealt = units.select("unit", "fp", "node").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of each linked node's component; roots themselves are left out."""
    at = staged(edges, "edges")
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = staged(large, "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        at = staged(small, "small-star")
        # done when every node has one edge and no node that has one is a root
        if at.groupBy("u").count().filter("count > 1").isEmpty() and at.select(F.col("v").alias("u")).join(at.select("u"), "u", "left_semi").isEmpty():
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(rows: DataFrame, radius: int, *more: Column) -> DataFrame:
    """`rows` (doc_id, fp, others) with component_id and what `more` aggregates over a component. The graph's nodes are the fingerprints.

    Aggregates are taken by fingerprint first, so a group of any size arrives as few rows.
    """
    names = ["component_id", *(f"more_{k}" for k in range(len(more)))]
    least = [F.min(c).alias(n) for n, c in zip(names, (F.col("doc_id"), *more), strict=True)]
    nodes = staged(rows.groupBy("fp").agg(*least), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    named = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", *names, F.coalesce("root", "fp").alias("component")), "components")
    whole = named.groupBy("component").agg(*[F.min(n).alias(n) for n in names])
    return rows.join(staged(named.select("fp", "component").join(whole, "component").select("fp", *names), "component-ids"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row per input row.

    component_id is the smallest doc_id reachable over links of `radius` or fewer bits, the row's
    own included; rows without a doc_id link like any other, and only a component without any
    number has null. Texts without words have fingerprint zero and are linked like any other.
    Repeated rows get a row each. An empty table gives an empty result; other columns are not read.
    """
    return _grouped(staged(fingerprints(docs, text_col), "fingerprints"), radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """`docs` with one row for each group of near-duplicates; all columns stay.

    The row of the smallest doc_id stays, one without a doc_id only in a group without any; of rows that share it,
    the one whose text has the smallest hash; of rows that repeat both, one.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    rows = _grouped(staged(fingerprints(docs, text_col, with_key=True), "fingerprints"), radius, own)
    judged = staged(rows.select("doc_id", "text_key", own.eqNullSafe(F.col("more_0")).alias("stays")), "near-rows")
    return without(docs, judged.filter(~F.col("stays")), judged.filter("stays"), text_key(F.col(text_col)))
