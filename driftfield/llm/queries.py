"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.llm import bitplanes, chunk_bpe, factorization, hard_negatives, importance, jaccard, language_model
from driftfield.llm import manifest, maxscore, merkle, packing, simhash, token_rollup
from driftfield.workspace import workspace_for

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def op1_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return chunk_bpe.encode_by_chunks(documents(spark, sf_dir), workspace_for(spark), path, chunk_bpe.DIGESTS)


@query
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(documents(spark, sf_dir), workspace_for(spark))


ORACLES["op2_merkle_fingerprints"] = merkle.ORACLE


@query
def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scale=256.0)


ORACLES["op3_maxscore_top_k"] = maxscore.ORACLE


@query
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    selection, keys = importance.select(documents(spark, sf_dir), labels, workspace_for(spark))
    return keys.withColumn("kept", F.col("key") >= selection.least_key)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace_for(spark)
    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=0)
    return packing.pack(ws.write(pieces, "pieces"), ws)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``: tells the documents held out from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


TOXIC_FROM = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``score``, learnt from the labels of documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return factorization.scored(docs, factorization.learn(docs, labels, remainder("doc_id", 4) != 2))


@query
def op6_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(spark, documents(spark, sf_dir), sf_dir)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query
def op7_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    held_out = remainder("doc_id", 7) == 2
    return language_model.score_texts(documents(spark, sf_dir), workspace_for(spark), path, held_out, end_id=50256)


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir), workspace_for(spark))


@query
def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, bad ones went, toxic ones lost their first line, and the first batch came again."""
    ws = workspace_for(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = public_tokenizers.path(BYTE_BPE)

    def events(rows: DataFrame, op: str, name: str) -> DataFrame:
        counted = token_rollup.count_words(rows).withColumn("version", F.lit("words"))
        counted = counted.unionByName(token_rollup.count_tokens(rows, path).withColumn("version", F.lit("byte_bpe_50k")))
        return ws.write(counted.withColumns({"op": F.lit(op), "seq": F.lit(0)}), name)

    bad = labels.where("quality = 0").select("doc_id").distinct()
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    # counted for all documents and chosen afterwards, so only counts are shuffled, never texts
    rest = events(docs.withColumn("text", F.regexp_replace("text", r"^[^\n]*\n?", "")), "revise", "rest")
    shorter = rest.join(toxic, "doc_id", "left_semi")
    gone = docs.select("doc_id", "source", "lang").join(bad, "doc_id", "left_semi")
    gone = gone.withColumns({"tokens": F.lit(0).cast("long"), "op": F.lit("delete"), "seq": F.lit(0)})
    gone = gone.withColumn("version", F.explode(F.array(F.lit("words"), F.lit("byte_bpe_50k"))))
    rollup = token_rollup.TokenRollup(spark, ws.folder("rollup"))
    loaded = events(docs, "insert", "loaded")
    rollup.apply("load", loaded)
    rollup.apply("bad quality", gone)
    rollup.apply("toxic", shorter)
    rollup.apply("load", loaded)
    return rollup.totals()


@query
def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace_for(spark)
    root = ws.folder("tokens")
    manifest = bitplanes.write_token_files(documents(spark, sf_dir), root, public_tokenizers.path(BYTE_BPE), end_id=2)
    return bitplanes.read_token_files(ws.write(manifest, "manifest"), root)


@query
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir), workspace_for(spark))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest.audit_documents(docs, remainder("doc_id", 7) == 0, workspace_for(spark))


ORACLES["op12_merkle_manifest"] = manifest.ORACLE


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(vectors, workspace_for(spark), every=50, positives=5, negatives=3, scale=256.0, label=label)


ORACLES["op13_hard_negatives"] = hard_negatives.ORACLE
