"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold outside menus, notices and the like; the
best one names its page's choice as a generalised path of tags and classes (classes up to their
first digit). Spark counts the choices by host, and each page is read again with the paths its host
agreed on, so odd pages profit from their neighbours. A page on which none of these paths holds text
falls back on its own best container.

Words of classes and ids, and links that stand alone, only propose what is no part of the article where
they can mean either. The host's pages decide: an element that a weak word proposes goes if its path is on half of them, one with
a sure word within another name ("share-tools", "notice-board") if it is on a tenth and on several, a block of links if the same block is on a fifth of them. Copies of a page count once. Where a host
has too few pages to tell, an element stays if it stands in the article, and a block of links if text precedes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Element, Page, parse
from .scratch import spread, staged

#: Least share of a host's pages that vote for a path, show the path of an element that a weak word or a sure word within a name proposes, or repeat a block of links.
LEAST, SLOT, LIKELY, REPEATED = 0.02, 0.5, 0.1, 0.2
#: Different pages that a host must have to decide.
PLENTY = 3
#: Bytes of what the hosts agreed on that may be broadcast; with more, pages and hosts are joined, salted.
BROADCAST_BYTES = 32 << 20
SALTS = 64
#: Hosts that a Python worker keeps ready.
HELD = 10_000
SECTIONS = frozenset("article main div section body td center fieldset #root".split())


@dataclass(frozen=True)
class Host:
    """What a host's pages agreed on: container paths, most votes first; hashes of paths and of link blocks; whether it has pages enough."""

    paths: tuple[str, ...] = ()
    slots: frozenset[int] = frozenset()
    repeated: frozenset[int] = frozenset()
    plenty: bool = False


ALONE = Host()


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _slot(page: Page, e: Element) -> int:
    """A proposed element's path, and what proposes it."""
    return _hash(str(e.weak), page.hashes[e.path])


def judge(page: Page, host: Host) -> list[bool]:
    """Which blocks are no part of an article: those surely so, and what the host, or on its own the page, decides of the proposed."""
    out = [b.chaff for b in page.blocks]
    before = False
    for k, b in enumerate(page.blocks):
        if b.links:
            out[k] = _hash(b.text, page.hashes[b.path]) in host.repeated if host.plenty else not before
        before = before or not out[k]
    total, linked = [0], [0]
    for k, b in enumerate(page.blocks):
        total.append(total[-1] + (0 if out[k] else len(b.text)))
        linked.append(linked[-1] + (0 if out[k] else b.linked))
    for e in page.elements:
        if e.weak and (held := total[e.last] - total[e.first]) and 2 * held <= total[-1]:
            links = 2 * (linked[e.last] - linked[e.first]) >= held
            if links or (_slot(page, e) in host.slots if host.plenty else not page.elements[e.parent].inside):
                out[e.first : e.last] = [True] * (e.last - e.first)
    return out


def best_container(page: Page, out: list[bool]) -> int:
    """Index of the element that holds the article: article or main elements first, else the deepest that keeps most text.

    The walk down stops where headings, paragraphs or the like stand beside the child with most text, for these belong to it.
    """
    total = [0]
    for block, chaff in zip(page.blocks, out, strict=True):
        total.append(total[-1] + (0 if chaff else len(block.text)))
    held = [total[e.last] - total[e.first] for e in page.elements]
    everything = held[0]
    if not everything:
        return 0
    marked = [k for k, e in enumerate(page.elements) if e.good and not e.chaff and held[k]]
    if marked:
        best = max(marked, key=lambda k: (held[k], page.elements[k].depth))
        if held[best] * 5 >= everything:
            return best
    at = 0
    while True:
        texts = [k for k in page.elements[at].children if held[k]]
        most = max(texts, key=lambda k: (held[k], -k), default=None)
        if most is None or held[most] * 10 < 6 * held[at] or page.elements[most].tag not in SECTIONS | {"html"}:
            return at
        if any(page.elements[k].tag not in SECTIONS for k in texts if k != most) or sum(held[k] for k in texts) < held[at]:
            return at
        at = most


def text_of(page: Page, first: int, last: int, out: list[bool]) -> list[str]:
    return [b.text for b, chaff in zip(page.blocks[first:last], out[first:last], strict=True) if not chaff]


def text_at(page: Page, path: int, out: list[bool]) -> str:
    """Text of the outermost elements with this path, in page order."""
    found: list[str] = []
    end = -1
    for e in page.elements:
        if e.path == path and not e.chaff and e.first >= end and e.last > e.first:
            found += text_of(page, e.first, e.last, out)
            end = e.last
    return "\n".join(found)


def main_text(source: str | None, host: Host = ALONE) -> str:
    """The article with the host's paths in order of votes; '' for a null or empty page."""
    if not source:
        return ""
    page = parse(source)
    out = judge(page, host)
    for path in host.paths:
        if (at := page.find(path)) > 0 and (text := text_at(page, at, out)):
            return text
    e = page.elements[best_container(page, out)]
    return "\n".join(text_of(page, e.first, e.last, out))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, slots, repeated, plenty): what the pages of a host agree on.

    A row a page first, copies of a page once; then counts by host and key, of which only those
    over the shares come together by host: at most 1 / LEAST paths, and of the rest what 1 / SLOT, 1 / LIKELY or 1 / REPEATED pages can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"host": [], "digest": [], "path": [], "slots": [], "likely": [], "blocks": []}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if source.as_py():
                    page = parse(source.as_py())
                    own = page.elements[best_container(page, judge(page, ALONE))]
                    rows["host"].append(host)
                    rows["digest"].append(_hash(source.as_py()))
                    rows["path"].append(page.path_text(own.path))
                    rows["slots"].append(list({_slot(page, e) for e in page.elements if e.weak == 1}))
                    rows["likely"].append(list({_slot(page, e) for e in page.elements if e.weak == 2}))
                    rows["blocks"].append(list({_hash(b.text, page.hashes[b.path]) for b in page.blocks if b.links}))
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    read = pages.select("host", "html").mapInArrow(run, "host string, digest long, path string, slots array<long>, likely array<long>, blocks array<long>")
    alike = read.groupBy("host", "digest").agg(*[F.first(c).alias(c) for c in ("path", "slots", "likely", "blocks")])
    one = staged(alike, "host-pages")
    total = staged(one.groupBy("host").agg(F.count("*").alias("total")), "host-totals")
    key = F.struct(F.lit("p").alias("kind"), F.lit(0).cast("long").alias("hash"), F.col("path"))
    named = lambda kind: lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hash"), F.lit("").alias("path"))
    proposed = [F.transform("slots", named("s")), F.transform("likely", named("l")), F.transform("blocks", named("b"))]
    counted = one.select("host", F.explode(F.concat(F.array(key), *proposed)).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    share = F.when(F.col("key.kind") == "p", LEAST).when(F.col("key.kind") == "s", SLOT).when(F.col("key.kind") == "l", LIKELY).otherwise(REPEATED)
    agreed = counted.filter("key.path != '' or key.kind != 'p'").join(total, "host").filter((F.col("n") >= F.col("total") * share) & ((F.col("n") > 1) | (F.col("key.kind") != "l")))
    of = lambda kind, value: F.collect_list(F.when(F.col("key.kind") == kind, value))
    paths = F.transform(F.array_sort(of("p", F.struct((-F.col("n")).alias("n"), F.col("key.path").alias("path")))), lambda x: x["path"])
    found = agreed.groupBy("host").agg(paths.alias("paths"), F.collect_list(F.when(F.col("key.kind").isin("s", "l"), F.col("key.hash"))).alias("slots"), of("b", F.col("key.hash")).alias("repeated"))
    return total.join(found, "host", "left").select("host", "paths", "slots", "repeated", (F.col("total") >= PLENTY).alias("plenty"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), a row per input row.

    The host is what stands between `//` and the next slash, lower-cased; rows without one vote as
    one host. A null or empty page has an empty text. Rows that repeat a page_id, or have none, get
    a row each. An empty table gives an empty result. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    own = spread(pages.select("page_id", "url", "html", host.alias("host")))
    agreed = staged(host_paths(own), "host-paths")
    n_bytes = agreed.agg(F.sum(F.octet_length("host") + 16 + 8 * (F.size(F.coalesce("slots", F.array())) + F.size(F.coalesce("repeated", F.array()))) + F.octet_length(F.array_join(F.coalesce("paths", F.array()), ">>>>")))).first()[0]
    if (n_bytes or 0) <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(agreed), "host", "left")
    else:  # a host of any size is spread over SALTS tasks
        salted = agreed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Host] = {}
        for batch in batches:
            texts = []
            for k, (source, name) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                if name not in known:
                    if len(known) >= HELD:
                        known.clear()
                    paths, slots, repeated, plenty = (batch.column(c)[k].as_py() for c in range(4, 8))
                    known[name] = Host(tuple(paths or ()), frozenset(slots or ()), frozenset(repeated or ()), bool(plenty))
                texts.append(main_text(source.as_py(), known[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "paths", "slots", "repeated", "plenty").mapInArrow(run, "page_id long, url string, text string")
