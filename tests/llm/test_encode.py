from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from driftfield.llm import bitplanes, encode, packing
from driftfield.llm.encode import PieceEncoder, load_tokenizer
from tests.llm.conftest import TROUBLE

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def direct(path, texts):
    tokenizer = load_tokenizer(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    encoder = PieceEncoder(path, cache_pieces=8)
    for _ in range(2):  # the second time from the cache
        for k in range(0, len(TROUBLE), 5):
            part = [t or "" for t in TROUBLE[k : k + 5]]
            ids, lengths = encoder.encode(part)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == direct(path, part)


_encoders = {name: PieceEncoder(public_tokenizers.path(name)) for name in FILES}
ODD = st.text(alphabet=st.sampled_from(list("ab'sté \n\t  ́ñÀ1.<|>漢")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_any_text(texts):
    for name, encoder in _encoders.items():
        ids, lengths = encoder.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []
        assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_many_words_go_through_the_library_some_at_a_time(byte_bpe, monkeypatch):
    encoder, asked, whole = PieceEncoder(byte_bpe), [], PieceEncoder._whole
    monkeypatch.setattr(PieceEncoder, "_whole", lambda self, texts: asked.append(len(texts)) or whole(self, texts))
    words = [f"wörd{k * 7919}" for k in range(40_000)]
    ids, sizes = encoder.spaced_words(words)
    assert max(asked) < len(words) / 200
    assert len(encoder.pieces) == len(words)
    encoder.cache_pieces = 30_000
    assert all(map(np.array_equal, encoder.spaced_words(words[:9]), (ids[: sizes[:9].sum()], sizes[:9])))
    assert len(encoder.pieces) <= 15_000  # given up at once
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == direct(byte_bpe, [" " + w for w in words])


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    planes = bitplanes.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert np.array_equal(bitplanes.from_planes(planes, n, kind), ids)


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 100)])
def test_token_files_round_trip(spark, ws, trouble, byte_bpe, kind, block):
    root = ws.folder("tokens")
    manifest = ws.write(bitplanes.write_token_files(trouble, root, byte_bpe, end_id=2, kind=kind, block_ids=block), "manifest")
    got = bitplanes.read_token_files(manifest, root, with_ids=True).collect()
    rows = sorted(trouble.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = [ids + [2] for ids in direct(byte_bpe, [r.text for r in rows])]
    assert sorted(map(tuple, ((r.doc_id if r.doc_id is not None else -1, *r.ids) for r in got))) == sorted(
        (r.doc_id if r.doc_id is not None else -1, *ids) for r, ids in zip(rows, want)
    )
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [r.doc_id for r in rows]
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())


def test_token_files_of_nothing(spark, ws, byte_bpe):
    empty = spark.createDataFrame([], "doc_id long, text string")
    root = ws.folder("tokens")
    manifest = ws.write(bitplanes.write_token_files(empty, root, byte_bpe, end_id=2), "manifest")
    assert bitplanes.read_token_files(manifest, root).count() == 0


def packed(df, capacity):
    bins = {}
    for r in df.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, ws, trouble, word_bpe):
    docs = trouble.withColumn("offset", trouble.doc_id).withColumn("length", trouble.doc_id)
    capacity = 64
    pieces = ws.write(packing.token_pieces(docs, word_bpe, 0, capacity), "pieces")
    out = ws.write(packing.pack(pieces, ws, capacity), "packed")
    packed(out, capacity)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.collect())
    want = []
    rows = trouble.collect()
    for r, ids in zip(rows, direct(word_bpe, [r.text for r in rows])):
        ids = ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append(((-1 if r.doc_id is None else r.doc_id), k // capacity, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert got == sorted(want)


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 101, 400), np.full(300, 37)])
    counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    runs = packing.best_fit(counts, 100)
    used = int((runs.first_sequence + runs.end_rank - runs.first_rank).max())
    gaps = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(100 - n)
    assert used <= len(gaps) * 1.02 + 1 and used >= -(-lengths.sum() // 100)
    assert int((runs.end_rank - runs.first_rank).sum()) == len(lengths)


def test_packing_of_nothing(spark, ws, word_bpe):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(ws.write(packing.token_pieces(empty, word_bpe, 0), "pieces"), ws).count() == 0


def test_words_of_a_word_level_file(word_bpe):
    """Plain words go together, odd ones alone; all as the library gives them."""
    rng = np.random.default_rng(4)
    letters = list("abcdefgzABCZ019.,;!?'-_/<|>\"éèüßñÖçøΣσİẞ漢字e\u0301\u00a0\u200b\x85\t\n")
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(20_000)]
    words += ["<|endoftext|>", "</w>", "a</w>", "don't", "ΑΣ", "ǅ", "ﬁ", "Å", "K", "ß", "İi", "x" * 3000]
    words = [w for w in words if " " not in w]
    encoder = encode.PieceEncoder(word_bpe)
    assert encoder.word_level and not encode.PieceEncoder(word_bpe.replace("word_bpe_49k", "byte_bpe_50k")).word_level
    ids, sizes = encoder._lowered(words)
    want = [encoder.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]
    assert sum(map(encode.is_plain, words)) > 2000
    unlike = [w for w in map(chr, range(0x250)) if encode.is_plain(w)]  # every letter by itself, as its lower case
    for w in unlike:
        got = encoder.tokenizer.encode(w, add_special_tokens=False).ids
        assert encoder.token_bytes[got].sum() == len(w.lower().encode()), w
