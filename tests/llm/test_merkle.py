from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from driftfield.llm import merkle


def test_fingerprints_match_sql(spark, ws):
    body = "First sentence here. Second one follows! A third?\nNew line with a longer run of words " + "and more " * 40
    texts = [body, body, None, "", "one", body.replace("third", "fourth"), "é漢" * 200, "\n\n\n", body * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = merkle.fingerprint_edits(docs.withColumns({"k": F.lit(1), "n": F.lit(2)}), ws).toPandas().sort_values("doc_id")
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(merkle.ORACLE + " ORDER BY e.doc_id").df()
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c
    fp = dict(zip(got.doc_id, got.fingerprint))
    assert fp[0] == fp[1] and fp[2] == fp[3] and len(set(fp.values())) == 7
    assert got.near_next.tolist()[0] == 1.0 and got.near_edited.between(0, 1).all()


def test_odd_rows(spark, ws):
    rows = [(None, "a. b. c. d."), (5, "x. y. z. w."), (5, "x. y. z. w."), (5, "other"), (7, "end")]
    got = merkle.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), ws).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1
    twins = [r for r in got if r.doc_id == 5 and r.n_chars == 11]
    assert len(twins) == 2 and twins[0] == twins[1]
    alone = merkle.fingerprint_edits(spark.createDataFrame([(1, "only one.")], "doc_id long, text string"), ws).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert merkle.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string"), ws).count() == 0


def test_changed_branches_locate_the_edit(spark):
    sentences = [f"Sentence number {k} of this text. " for k in range(200)]
    edited = list(sentences)
    edited[120] = "Something else stands here. "
    row = spark.createDataFrame([("".join(sentences), "".join(edited))], "a string, b string")
    row = row.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    found = row.select(merkle.changed(F.col("a"), F.col("b")).alias("c"), merkle.changed(F.col("a"), F.col("a")).alias("same"), "b").first()
    assert len(found.c) == 1 and found.same is None
    sections = found.b.split("|")[1].split(";")
    before = sum(len(s.split(":")[1].split(",")) for s in sections[: found.c[0].section])
    assert before + found.c[0].leaf == 120
