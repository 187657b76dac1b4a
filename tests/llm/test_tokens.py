"""op2, op7 and the pipeline: exact round trips and whole results."""

import io
from collections import Counter

import brute
import numpy as np
import pytest
from cases import HARD
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing, queries, token_file
from textloom.llm.encode import Encoder

BYTES, WORDS = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def enc(request):
    return Encoder(request.param)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", "'s", "don't", "é", "É", "漢", "1", "23", ".", "...", "<|endoftext|>", "\x1c", " ", "Σ", "ς", "\0", "İ", "é", "-", "\r"]), max_size=14))
def test_pieces_equal_whole(enc, parts):
    text = "".join(parts)
    assert enc.encode([text]) == enc._whole([text])


def test_real_texts(enc, sample):
    texts = [t for _, t in sample[:80]]
    assert enc.encode(texts) == enc._whole(texts) == enc.encode(texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_narrow_ids_and_small_caches(path, sample):
    """Two bytes an id, and generations that end in the midst of a text, change nothing."""
    narrow, wide = Encoder(path, cache=50, width=2), Encoder(path)
    for _, t in sample[:60]:
        assert (np.frombuffer(narrow.encode([t or ""])[0], "<u2") == np.frombuffer(wide._whole([t or ""])[0], "<u4")).all()


def test_file_format():
    sink = io.BytesIO()
    out = token_file.TokenFileWriter(sink, width=2, frame_bytes=64)
    docs = {k: np.arange(k * 3, dtype=np.uint32) for k in (5, 0, 40, 7)}
    for k, ids in docs.items():
        out.add(k, ids)
    out.finish()
    raw = sink.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(raw)

    reader = token_file.TokenFileReader(Source(raw))
    assert all((reader.document(k) == ids).all() for k, ids in docs.items()) and len(reader.frames) == 2
    with pytest.raises(KeyError):
        reader.document(99)
    bad = bytearray(raw)
    bad[reader.frames[0][0] + 10] ^= 1  # in the second frame
    damaged = token_file.TokenFileReader(Source(bytes(bad)))
    assert (damaged.document(5) == docs[5]).all()
    with pytest.raises(Exception):  # noqa: B017
        damaged.document(7)
    import zstandard

    # frames stand alone: any zstandard reader gets the ids from the first one
    assert zstandard.ZstdDecompressor().decompress(raw[: reader.frames[0][0]]) == b"".join(docs[k].astype("<u2").tobytes() for k in (5, 0, 40))


def test_token_query(spark, sf_dir, sample):
    rows = sorted(sample)
    want, start = {}, 0
    for (d, _), ids in zip(rows, brute.whole_ids(BYTES, [t for _, t in rows], 2), strict=True):
        want[d] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op2_token_files(spark, sf_dir).collect()} == want


def test_token_files_hard(spark, hard, empty, tmp_path):
    written = token_file.write_token_files(hard, BYTES, 2, str(tmp_path / "t"), files=3)
    rows = sorted(((d, t or "") for d, t in HARD if d is not None))
    got = token_file.read_token_files(spark, written, with_ids=True).collect()
    assert [(r["doc_id"], r["ids"]) for r in sorted(got, key=lambda r: r["start"])] == [(d, i) for (d, _), i in zip(rows, brute.whole_ids(BYTES, [t for _, t in rows], 2), strict=True)]
    assert len(written.files) >= 2 and token_file.TokenFiles.load(str(tmp_path / "t")).files == written.files
    # ranges and files of any size hold the same ids in the same order; foreign files and those of other runs stay
    (tmp_path / "s" / "run-of-another").mkdir(parents=True)
    foreign = [tmp_path / "s" / "mine.txt", tmp_path / "s" / "ids-mine.tok", tmp_path / "s" / "run-of-another" / "ids-0.tok"]
    for f in foreign:
        f.write_bytes(b"x")
    small = token_file.write_token_files(hard, BYTES, 2, str(tmp_path / "s"), range_bytes=1000, file_bytes=30_000)
    again = token_file.read_token_files(spark, small, with_ids=True).collect()
    assert [(r["doc_id"], r["ids"]) for r in sorted(again, key=lambda r: r["start"])] == [(r["doc_id"], r["ids"]) for r in sorted(got, key=lambda r: r["start"])]
    assert len(small.files) > len(written.files) and all(f.exists() for f in foreign)
    (folder,) = {p.rsplit("/", 2)[-2] for p, *_ in small.files}
    own = tmp_path / "s" / folder
    for name in ("ids-left-by-a-lost-task.tok", "notes.txt"):
        (own / name).write_bytes(b"x")
    token_file._tidy(small, folder)
    assert {p.name for p in own.iterdir()} == {p.rsplit("/", 1)[-1] for p, *_ in small.files} | {"notes.txt"}
    later = token_file.write_token_files(hard, BYTES, 2, str(tmp_path / "s"))
    assert token_file.TokenFiles.load(str(tmp_path / "s")).files == later.files
    assert token_file.read_token_files(spark, small).count() == len(again)
    assert token_file.read_token_files(spark, token_file.write_token_files(empty, BYTES, 2, str(tmp_path / "e"))).count() == 0


def check_packing(rows, texts, size=4096):
    ids = [brute.whole_ids(WORDS, [t], 1)[0] for t in texts]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_seq) <= -(-sum(map(len, ids)) // size) * 1.02 + 2
    return ids


def test_packing_query(spark, sf_dir, sample):
    rows = queries.op7_pack(spark, sf_dir).collect()
    ids = dict(zip([d for d, _ in sample], check_packing(rows, [t for _, t in sample]), strict=True))
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + 4096]
        assert r["start"] == 4096 * r["piece"] and r["length"] == len(piece) and r["ids_crc32"] == brute.crc(piece)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_packing_hard(hard, empty):
    rows = packing.packed(hard, WORDS, 1, with_ids=True).collect()
    check_packing(rows, [t for _, t in HARD])
    assert len([r for r in rows if r["doc_id"] == 11]) == 2 and len([r for r in rows if r["doc_id"] == 8]) == 10
    assert packing.packed(empty, WORDS, 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_place_fits_everything(lengths):
    bins = {}
    for s, own, offset in zip(lengths, *packing.place(lengths, 64), strict=True):
        assert bins.get(own, 0) == offset
        bins[own] = offset + s
    assert all(v <= 64 for v in bins.values()) and sorted(bins) == list(range(len(bins)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 150), min_size=1, max_size=8))
def test_sum_of_squares_rule(counts):
    """Piece by piece, however often a length occurs: each goes to the open gap after which the sum of squared counts is smallest; none open, a new bin."""
    lengths = [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    gaps = Counter()
    for length, offset in zip(lengths, packing.place(lengths, 20)[1], strict=True):
        def squares(g):
            rest = gaps.copy()
            rest[g] -= 1
            if g > length:
                rest[g - length] += 1
            return sum(v * v for v in rest.values())  # noqa: B023

        fits = sorted(g for g in gaps if g >= length and gaps[g])
        best = min(fits, key=lambda g: (squares(g), g)) if fits else 20
        assert offset == 20 - best
        if fits:
            gaps[best] -= 1
        if best > length:
            gaps[best - length] += 1


def test_shards_are_whole(spark):
    """Shards of a few pieces each still place every row once, in few more sequences than the bound."""
    rng = np.random.default_rng(4)
    rows = [(k % 900 if k % 7 else None, k, 0, 0, int(n), 5) for k, n in enumerate(np.concatenate((rng.integers(1, 400, 3000), np.full(40, 4096), np.full(500, 7))))]
    table = spark.createDataFrame(rows, "doc_id long, copy_key long, piece int, start long, length long, ids_crc32 long")
    for shard in (10**6, 500):
        got = packing.placed(table, shard=shard).collect()
        assert sorted((r["copy_key"], r["length"], r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((r[1], r[4], r[0]) for r in rows if r[0] is not None) and len(got) == len(rows)
        parts = {}
        for r in got:
            parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in parts.values():
            own.sort()
            assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
        assert len(parts) <= -(-sum(r[4] for r in rows) // 4096) + 8


def test_pipeline(spark, sf_dir, sample, docs_of):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {d: t for d, t in sample if t and any(c.isalpha() for c in t)}
    last = {}
    for d in sorted(kept):
        last[brute.lower_ascii(kept[d])] = d
    kept = {d: t for d, t in kept.items() if d in set(last.values())}
    near = brute.simhash(sorted(kept.items()))
    kept = {d: t for d, t in kept.items() if near[d][1] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = brute.decontaminate(kept.items(), items)
    kept = {d: t for d, t in kept.items() if not bad[d][4]}
    rows = p.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    check_packing(rows, list(kept.values()))
    hard = docs_of(HARD, clash=True)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, hard, sf_dir)
        assert out.columns == hard.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
