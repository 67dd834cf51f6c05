from __future__ import annotations

import re
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F

from driftfield.llm import queries
from driftfield.llm.encode import load_tokenizer
from driftfield.llm.token_rollup import TokenRollup, count_tokens, count_words

EVENT = "doc_id long, version string, source string, lang string, tokens long, op string, seq int"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_signed_deltas_and_idempotent_batches(spark, ws):
    rollup = TokenRollup(spark, ws.folder("rollup"))
    assert totals(rollup) == {} and rollup.ledger().count() == 0

    def apply(batch, *rows):
        df = spark.createDataFrame(rows, EVENT).withColumns({"old_tokens_": F.lit(1), "turn": F.lit("x")})
        return rollup.apply(batch, df)

    first = [(1, "a", "web", "en", 10, "insert", 0), (2, "a", "web", None, 5, "insert", 0), (3, "a", None, "de", 7, "insert", 0), (None, "a", "web", "en", 99, "insert", 0)]
    assert apply("one/ä", *first, first[0])
    assert totals(rollup) == {("web", "en", "a"): (1, 10), ("web", None, "a"): (1, 5), (None, "de", "a"): (1, 7)}
    assert not apply("one/ä", *first)
    assert apply("two", (1, "a", "book", "en", 12, "revise", 0), (2, "a", "web", None, 0, "delete", 1), (2, "a", "web", None, 50, "insert", 0), (9, "a", "web", "en", 0, "delete", 0))
    assert totals(rollup) == {("book", "en", "a"): (1, 12), (None, "de", "a"): (1, 7)}
    assert apply("three", (2, "a", "web", "en", 4, "insert", 0), (1, "b", "book", "en", 3, "insert", 0), (1, "a", "book", "en", 12, "insert", 0))
    want = {("book", "en", "a"): (1, 12), (None, "de", "a"): (1, 7), ("web", "en", "a"): (1, 4), ("book", "en", "b"): (1, 3)}
    assert totals(rollup) == want
    # an attempt that failed before its commit leaves files that nobody reads
    spark.createDataFrame([("web", "en", "a", 1, 1000)], "source string, lang string, version string, documents long, tokens long").write.parquet(
        f"{rollup.root}/deltas/b-four-lost"
    )
    assert totals(rollup) == want
    assert apply("four") and totals(rollup) == want


def test_counts(spark, trouble, byte_bpe):
    tokenizer = load_tokenizer(byte_bpe)
    docs = trouble.withColumn("tokens", F.lit("clash"))
    got = sorted((str(r.doc_id), r.tokens) for r in count_tokens(docs, byte_bpe).collect())
    assert got == sorted((str(r.doc_id), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in trouble.collect())
    got = sorted((str(r.doc_id), r.tokens) for r in count_words(docs).collect())
    assert got == sorted((str(r.doc_id), len(re.findall(r"[^ \t\n\v\f\r]+", r.text or ""))) for r in trouble.collect())


def test_query_matches_a_plain_count(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad, toxic = {r.doc_id for r in labels if r.quality == 0}, {r.doc_id for r in labels if r.toxic == 1}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id in bad and r.doc_id not in toxic:
            continue
        text = re.sub(r"^[^\n]*\n?", "", r.text, count=1) if r.doc_id in toxic else r.text
        for version, n in (("words", len(text.split())), ("byte_bpe_50k", len(tokenizer.encode(text, add_special_tokens=False).ids))):
            group = want[r.source, r.lang, version]
            group[0] += 1
            group[1] += n
    got = queries.QUERIES["op9_token_rollups"](spark, sf).collect()
    assert {(r.source, r.lang, r.version): [r.documents, r.tokens] for r in got} == dict(want)
