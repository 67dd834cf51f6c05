"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch holds events: documents inserted, deleted, or revised under a tokenizer version.  An
insert adds a document's tokens, a delete takes back what the ledger holds for it, a revision
does both.  Deltas are summed by group before they are added, and totals are the sum of all
committed deltas: they never count texts again.

Files: ``deltas/`` and ``ledger/`` have a folder per batch, ``commits/`` one row per
committed batch.  A batch writes both folders first and its commit row last.  A batch id that
is committed is skipped when it comes again; folders of a batch that failed before its commit
are ignored, and written anew under another attempt.  Readers only see committed attempts.

A null text has no tokens; null sources and languages are groups of their own. In a batch
the last event of a document and version (by ``seq``) counts; repeated events count once.
Events without a document id are left out, as nothing could ever revise them. Deleting what
is not there changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftfield.llm.encode import encoded_blocks, small_batches

GROUP = ("source", "lang", "version")
_LEDGER = "doc_id long, version string, source string, lang string, tokens long, alive boolean"
_DELTAS = "source string, lang string, version string, documents long, tokens long"
_COMMITS = "batch string, attempt string, ledger_rows long"


def count_tokens(documents: DataFrame, tokenizer: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``documents`` with the number of ids of their texts in place of the texts."""
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in (text, out)]
    rows = documents.select(*kept, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, np.int64), *(n for _, _, _, n in encoded_blocks(batch.column(len(kept)), tokenizer))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(parts))], names=[*kept, out])

    return rows.mapInArrow(count, rows.drop(text).withColumn(out, F.lit(0).cast("long")).schema)


def count_words(documents: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """The same with runs of characters other than ASCII white space as tokens."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return documents.withColumn(out, F.size(words).cast("long")).drop(text)


class TokenRollup:
    """Totals kept below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of committed attempts."""
        commits = self.commits()
        rows = commits.collect()  # a row per batch
        paths = [f"{self.root}/{name}/{_folder(r.batch)}-{r.attempt}" for r in rows]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def commits(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits")

    def ledger(self) -> DataFrame:
        """What each document counts for now, by version."""
        rows = self._table("ledger", _LEDGER + ", turn long")
        newest = F.max_by(F.struct("source", "lang", "tokens", "alive"), "turn").alias("r")
        return rows.groupBy("doc_id", "version").agg(newest).select("doc_id", "version", "r.*").where("alive").drop("alive")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens of all groups that hold documents."""
        summed = self._table("deltas", _DELTAS).groupBy(*GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        return summed.where("documents <> 0 or tokens <> 0")

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Commit events (doc_id, version, source, lang, tokens, op of insert | revise | delete, seq); False if done before."""
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return False
        attempt, turn = uuid.uuid4().hex[:12], self.commits().count()
        last = Window.partitionBy("doc_id", "version").orderBy(F.desc("seq"), F.desc("tokens"), F.desc("source"), F.desc("lang"))
        events = events.where("doc_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
        held = self.ledger().select(
            "doc_id", "version", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("tokens").alias("old_tokens")
        )
        met = events.join(held, ["doc_id", "version"], "left")
        alive = F.col("op") != "delete"
        known = F.col("old_tokens").isNotNull()
        entries = met.where(alive | known).select(
            "doc_id", "version", "source", "lang", F.when(alive, F.col("tokens")).otherwise(0).alias("tokens"), alive.alias("alive"),
            F.lit(turn).cast("long").alias("turn"), "old_source", "old_lang", "old_tokens",
        )
        where = f"{_folder(batch)}-{attempt}"
        entries.write.parquet(f"{self.root}/ledger/{where}")
        written = self.spark.read.schema(entries.schema).parquet(f"{self.root}/ledger/{where}")
        both = F.array(
            F.struct("source", "lang", "version", F.col("alive").cast("long").alias("documents"), "tokens"),
            F.struct(
                F.col("old_source").alias("source"),
                F.col("old_lang").alias("lang"),
                "version",
                (-F.col("old_tokens").isNotNull().cast("long")).alias("documents"),
                F.coalesce(-F.col("old_tokens"), F.lit(0)).alias("tokens"),
            ),
        )
        signed = written.select(F.explode(both).alias("c")).select("c.*").where("documents <> 0")
        deltas = signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        deltas.write.parquet(f"{self.root}/deltas/{where}")
        done = self.spark.createDataFrame([(batch, attempt, written.count())], _COMMITS)
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return True


def _folder(batch: str) -> str:
    return "b-" + quote(batch, safe="").replace("%", "=")
