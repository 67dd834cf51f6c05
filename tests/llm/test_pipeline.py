from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from driftfield.llm import importance
from driftfield.llm.encode import load_tokenizer
from driftfield.llm.queries import WORD_BPE
from driftfield.workspace import Workspace
from tests.llm.test_jaccard import brute

import public_tokenizers

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept.append(ws.write(stage(spark, kept[-1], SF), "stage"))
        assert kept[-1].columns == docs.columns and kept[-1].exceptAll(kept[-2]).count() == 0
    quality = kept[1].join(labels, "doc_id").groupBy("quality").count().collect()
    share = {r.quality: r["count"] for r in quality}
    whole = {r.quality: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert share[1] / whole[1] > 0.8 and share.get(0, 0) / whole[0] < 0.4  # some 400 labels are all there is here
    before = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert {r.doc_id for r in kept[3].collect()} == {int(c) for _, _, c, _ in brute(before, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)}
    packed = corpus_pipeline.pack(spark, kept[3], SF).toPandas()
    tokenizer = load_tokenizer(public_tokenizers.path(WORD_BPE))
    lengths = packed.groupby("doc_id").length.sum().to_dict()
    for r in kept[3].collect():
        assert lengths[r.doc_id] == len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 2048) + 3


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d", "en"), (None, "a b c d", "en"), (1, "x y z w", "en"), (1, "x y z w", "en"), (2, "X y z W", "de"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "a b c d", "en"), (1, "x y z w", "en"), (3, None, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
    assert importance.kth_largest(docs.withColumn("v", F.lit(1.0)), "v", 2) == 1.0


def test_columns_of_any_name_are_kept(spark):
    """Own columns named like those the operators add come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {c: F.concat(F.lit(f"{c} of "), "doc_id") for c in ("key", "log_ratio", "score", "_number", "digest", "component_id", "first")}
    )
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.exceptAll(docs).count() == 0 < got.count()


def test_survivors_are_rows(spark):
    """Rows that share an id, or have none, are kept or dropped for their own texts."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words), (5, words + " more"), (5, "a unique text of some words"), (None, words), (None, "another text that nobody has"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_texts_are_not_shuffled_for_survivors(spark, monkeypatch):
    """Survivors are told by a bit each, whatever the size of the table allows to broadcast."""
    rows = spark.range(0, 100_000, 1, 3).withColumns({"_number": F.col("id") * 7 + (F.col("id") % 3) * (1 << 33), "text": F.lit("x")})
    kept = rows.where("id % 5 in (0, 3)").select("_number")
    want = sorted(r.id for r in rows.where("id % 5 in (0, 3)").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.chosen(rows, kept, "_number")
        assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == want
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_BUCKETS", 0)
        assert sorted(r.id for r in corpus_pipeline.chosen(rows, kept, "_number").collect()) == want
        assert corpus_pipeline.chosen(rows, kept.limit(0), "_number").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
