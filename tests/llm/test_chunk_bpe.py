from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from driftfield.llm import chunk_bpe
from driftfield.llm.encode import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.sampled_from(list("ab'st 1é \n\t!<|endoftext|>漢 ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(TEXT, max_size=5), min_size=1, max_size=4))
def test_joined_chunks_are_the_whole_text(docs):
    codec = chunk_bpe.codec_for(PATH)
    want = [codec.encoder.tokenizer.encode("".join(d), add_special_tokens=False).ids for d in docs]
    got = codec.join([codec.encode(d) for d in docs])
    assert [g.tolist() for g in got] == want
    assert [codec.decode(g) for g in got] == ["".join(d) for d in docs]


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n).astype(np.uint8), passage]) for n in (0, 777)]
    sets = []
    for data in texts:
        (ends,) = chunk_bpe.cut_points(data, np.array([0, len(data)]))
        assert ends[-1] == len(data) and np.all(np.diff(ends)[:-1] >= chunk_bpe.LEAST_BYTES)
        sets.append({c[1:] for c in chunk_bpe.chunks_of(memoryview(data.tobytes()), 0, ends)})
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2


def test_encode_by_chunks(spark, ws, trouble):
    passage = " ".join(f"shared{k * 7919 % 1009} passage, number {k}." for k in range(200))
    extra = [(100 + k, f"{'é' * k} start {k} " + passage + f" end{k}") for k in range(6)] + [(200, passage), (201, passage)]
    docs = trouble.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.withColumn("pos", docs.doc_id).withColumn("h1", docs.doc_id)
    tokenizer = load_tokenizer(PATH)
    want = sorted(
        (-1 if r.doc_id is None else r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    got = chunk_bpe.encode_by_chunks(docs, ws, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == want
    digests = chunk_bpe.encode_by_chunks(docs, ws, PATH, chunk_bpe.DIGESTS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (
            d,
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tokenizer.decode(list(ids), skip_special_tokens=False).encode()).hexdigest(),
        )
        for d, ids in want
    )


def test_nothing(spark, ws):
    assert chunk_bpe.encode_by_chunks(spark.createDataFrame([], "doc_id long, text string"), ws, PATH).count() == 0
