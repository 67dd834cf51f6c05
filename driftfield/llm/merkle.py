"""Document fingerprints: a Merkle tree over paragraphs and sections, in column expressions only.

Leaves are paragraphs (lines; a long one is cut after its sentences, and at 80 characters
where none ends).  Consecutive leaves form sections; a leaf whose hash starts with 0 ends its
section, so sections follow the content and an insertion does not move later borders.  A
section's hash is taken over its leaves' hashes, the root over the sections' hashes.

The fingerprint is text: ``root|section:leaf,leaf;section:leaf``.  Roots are equal where
texts are; sections and leaves that differ locate an edit.

A null text counts as empty; an empty text has no leaves. Texts are never cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.workspace import Workspace

#: What ends a leaf: a sentence end with spaces, a line end, the end of the text, or 80 characters.
LEAF = r"[^\n]{1,80}?(?:[.!?]+[ \t]+|\n+|\z)|[^\n]{1,80}|\n+"


def _short(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    leaves = F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), _short)
    ended = F.transform(leaves, lambda x: F.concat(x, F.when(x.startswith("0"), ";").otherwise(",")))
    body = F.array_join(ended, "")
    sections = _let(body, lambda b: F.split(F.substring(b, F.lit(1), F.length(b) - 1), ";"))
    hashed = F.transform(sections, lambda s: F.concat(_short(s), F.lit(":"), s))

    def tree(sections: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 16)), ";"), 256)
        return F.concat(root, F.lit("|"), F.array_join(sections, ";"))

    return F.when(F.length(text) > 0, _let(hashed, tree)).otherwise(F.concat(F.sha2(F.lit(""), 256), F.lit("|")))


def nodes(fp: Column) -> Column:
    """Distinct hashes of a fingerprint: root, sections and leaves."""
    return F.array_distinct(F.split(fp, "[|;:,]"))


def likeness(a: Column, b: Column) -> Column:
    """Shared nodes of two fingerprints, from 0 to 1; 1 only where the roots are equal."""

    def shared(x: Column) -> Column:
        return _let(nodes(b), lambda y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))

    return F.when(a == b, 1.0).otherwise(_let(nodes(a), shared))


def changed(a: Column, b: Column) -> Column:
    """(section, leaf) numbers in ``b`` of what ``a`` has not; only sections that differ are looked into."""
    old = F.split(F.element_at(F.split(a, r"\|"), 2), ";")
    new = F.split(F.element_at(F.split(b, r"\|"), 2), ";")
    old_leaves = F.split(F.array_join(F.transform(old, lambda s: F.element_at(F.split(s, ":"), -1)), ","), ",")

    def leaves(section: Column, number: Column) -> Column:
        own = F.split(F.element_at(F.split(section, ":"), -1), ",")
        marked = F.transform(own, lambda x, k: F.struct(number.alias("section"), k.alias("leaf"), x.alias("hash")))
        fresh = F.filter(marked, lambda x: ~F.array_contains(old_leaves, x["hash"]) & (x["hash"] != ""))
        return F.when(F.array_contains(old, section), F.filter(marked, lambda x: F.lit(False))).otherwise(fresh)

    return F.when(
        F.element_at(F.split(a, r"\|"), 1) != F.element_at(F.split(b, r"\|"), 1), F.flatten(F.transform(new, leaves))
    )


def successors(keys: DataFrame, ws: Workspace, order: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``next_``/``prev_`` columns of their neighbours in ``order``; the last is followed by the first.

    Keys are range-partitioned and written, so each range finds its neighbours alone, and
    ranges meet only in one row each.
    """
    columns = [*order, *[c for c in keys.columns if c not in order]]
    dealt = keys.distinct().repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = ws.write(dealt, "order")
    row = F.struct(*columns)
    inside = Window.partitionBy("_range").orderBy(*order)
    ends = dealt.groupBy("_range").agg(F.min(row).alias("_a"), F.max(row).alias("_z"))
    across = Window.orderBy("_range")  # a row per range
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "_range",
        F.coalesce(F.lead("_a").over(across), F.first("_a").over(whole)).alias("_after"),
        F.coalesce(F.lag("_z").over(across), F.last("_z").over(whole)).alias("_before"),
    )
    linked = dealt.select("*", F.lead(row).over(inside).alias("_n"), F.lag(row).over(inside).alias("_p")).join(ends, "_range")
    return linked.select(
        *columns,
        *[F.coalesce(F.col(f"_n.{c}"), F.col(f"_after.{c}")).alias(f"next_{c}") for c in columns],
        *[F.coalesce(F.col(f"_p.{c}"), F.col(f"_before.{c}")).alias(f"prev_{c}") for c in columns],
    )


def fingerprint_edits(documents: DataFrame, ws: Workspace, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, and that of its text with the last quarter taken from the next document's start.

    Documents follow each other by id (null first; repeated ids by text; repeated rows are
    one document in this order and give a row each).
    """
    none = F.lit(-(1 << 63))
    docs = documents.select(
        F.coalesce(F.col(doc).cast("long"), none).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    keys = docs.select("k", "h", F.char_length("text").cast("long").alias("n"))
    order = ws.write(successors(keys, ws, ["k", "h"]).drop("next_k", "next_h", "next_n"), "neighbours")
    # both uses take the same columns of ``docs``, so texts are shuffled once
    placed = docs.join(order, ["k", "h"])
    following = placed.select(
        F.col("prev_k").alias("k"),
        F.col("prev_h").alias("h"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("start"),
        fingerprint(F.col("text")).alias("next_fingerprint"),
    ).dropDuplicates(["k", "h"])
    placed = placed.withColumn("fingerprint", fingerprint(F.col("text")))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    return (
        placed.join(following, ["k", "h"])
        .withColumn("edited", F.concat(kept, F.col("start")))
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
        .select(
            F.when(F.col("k") != none, F.col("k")).alias("doc_id"),
            F.col("n").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n,
             coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, n, text, nt, substr(text, 1, n - n // 4) || substr(nt, 1, n // 4) AS et FROM o),
t AS (SELECT doc_id, 'own' AS which, text AS x FROM e UNION ALL SELECT doc_id, 'edited', et FROM e
      UNION ALL SELECT doc_id, 'next', nt FROM e),
b AS (SELECT doc_id, which, x, array_to_string([h || CASE WHEN h[1] = '0' THEN ';' ELSE ',' END
        FOR h IN [sha256(p)[1:16] FOR p IN regexp_extract_all(x, '[^\n]{1,80}?(?:[.!?]+[ \t]+|\n+|\z)|[^\n]{1,80}|\n+')]], '') AS body FROM t),
s AS (SELECT doc_id, which, x, [sha256(p)[1:16] || ':' || p FOR p IN string_split(body[:-2], ';')] AS sections FROM b),
f AS (SELECT doc_id, which, CASE WHEN x = '' THEN sha256('') || '|' ELSE
        sha256(array_to_string([p[1:16] FOR p IN sections], ';')) || '|' || array_to_string(sections, ';') END AS fp FROM s),
w AS (SELECT doc_id, max(fp) FILTER (which = 'own') AS a, max(fp) FILTER (which = 'edited') AS b, max(fp) FILTER (which = 'next') AS c FROM f GROUP BY doc_id),
l AS (SELECT doc_id, a, b, c, list_distinct(string_split_regex(a, '[|;:,]')) AS na, list_distinct(string_split_regex(b, '[|;:,]')) AS nb,
             list_distinct(string_split_regex(c, '[|;:,]')) AS nc FROM w)
SELECT e.doc_id, e.n AS n_chars, sha256(e.et) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(na, nb)) / (len(na) + len(nb)) END AS near_edited,
  CASE WHEN a = c THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(na, nc)) / (len(na) + len(nc)) END AS near_next
FROM e JOIN l USING (doc_id)
"""
