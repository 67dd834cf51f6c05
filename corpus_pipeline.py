"""Documents to packed training sequences: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes the result of every stage as Parquet in the shared
folder and reads it again for the next one, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.llm import importance, jaccard, packing
from driftfield.llm.queries import TOXIC_FROM, WORD_BPE, toxicity
from driftfield.workspace import workspace_for


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    selection, _ = importance.select(docs, labels, workspace_for(spark))
    drawn = importance.weighted(_apart(docs), selection.weights).where(F.col("key") >= selection.least_key)
    return _together(drawn, docs)


def _apart(docs: DataFrame) -> DataFrame:
    """The columns a stage reads, and all others under numbers, so no name of the user's can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(_name(c, k)) for k, c in enumerate(docs.columns)])


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows from ``_apart`` with the columns of ``docs`` again."""
    return rows.select(*[F.col(_name(c, k)).alias(c) for k, c in enumerate(docs.columns)])


def _name(column: str, k: int) -> str:
    return column if column in ("doc_id", "text") else f"_own_{k}"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    return _together(toxicity(spark, _apart(docs), sf_dir).where(F.col("score") < TOXIC_FROM), docs)


#: Words of a shingle and least similarity, in percent, of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest id (rows without an id last, then by text).

    Rows are told apart by a number of their own, so rows that share an id or have none are
    judged by their texts like all others.  Rows without words are no one's copies and stay.
    """
    ws = workspace_for(spark)
    rows = ws.write(_apart(docs).withColumn("_number", F.monotonically_increasing_id()), "numbered_rows")
    found = jaccard.similar_components(rows.select("_number", "text"), ws, NEAR_WORDS, NEAR_PERCENT, doc="_number")
    known = rows.select("_number", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    known = found.select(F.col("doc_id").alias("_number"), "component_id").join(known, "_number")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "_number")).alias("first")
    kept = known.groupBy("component_id").agg(first).select("first._number")
    return _together(chosen(rows, ws.write(kept, "kept"), "_number"), docs)


#: Buckets of 32,768 numbers, 4 KB each, up to which every task gets the bits of all of them.
BROADCAST_BUCKETS = 1 << 13


def chosen(rows: DataFrame, kept: DataFrame, number: str) -> DataFrame:
    """``rows`` whose number is in ``kept``, found by one bit for each number, so texts stay where they are."""
    bucket, place = F.bitmap_bucket_number(number), F.bitmap_bit_position(number)
    bits = kept.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    if bits.count() <= BROADCAST_BUCKETS:
        bits = F.broadcast(bits)
    met = rows.join(bits, bucket == F.col("_bucket")).withColumn("_place", place.cast("int"))
    byte = "cast(conv(hex(substring(_bits, shiftright(_place, 3) + 1, 1)), 16, 10) as int)"
    return met.where(f"getbit({byte}, _place & 7) = 1").select(rows.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it."""
    ws = workspace_for(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD_BPE), end_id=0)
    return packing.pack(ws.write(pieces, "pieces"), ws)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack),
]

#: Fitted models, tokenizers and components have no SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace_for(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
