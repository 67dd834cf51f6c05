"""Merkle manifest of a dataset: a postorder append log written by aligned builders.

H is the lowercase hex sha256 of its inputs one after the other, digests as hex text.  A leaf
is H of a row's fields (``-`` for null, else UTF-8 byte count, ``:``, value).  The leaves of a
tree are numbered in order; while a level has more than one node, every two consecutive ones
become their H, and a last one alone becomes its H.

* **Numbering.**  Leaves are range-partitioned and counted per range, so no tree is sorted in
  one task.
* **Building.**  A builder takes an aligned block of 2 ** ``bits`` consecutive nodes and
  appends every node below its root in completion order.  Block roots are the leaves of the
  next stage, which is built alike, until every tree has one root: a tree of n leaves takes
  log(n) / ``bits`` stages.  A builder's part of the log is one row.
* **Addressing.**  In postorder, the node over leaves [e, e + m) on level h lies at
  ``2 e - popcount(e)`` (all nodes that were complete before) plus ``sum(ceil(m / 2 ** l), l = 0..h) - 1``
  (the rest of its subtree).  Siblings are found by that form alone, nothing is searched.
* **Proofs.**  From the top stage down, a fragment of the log hands every block below the path
  from its root on; a path is written once per block, and leaves meet only their own block.

Trees may be of any sizes: a hot tree is many blocks.  Rows in a tree are ordered by the given
columns, null first; equal leaves keep the order in which they were first written.  Empty
tables give empty results; a tree of one leaf has that leaf as its root and a path without steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.workspace import Workspace

#: Levels that one builder completes: a block has 2 ** BITS leaves.
BITS = 12
SIZE = 32
_LEFT, _RIGHT, _ALONE = 0, 1, 2


def field(value: Column) -> Column:
    """A value as it enters a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def combined(*digests: bytes) -> bytes:
    """H of digests."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def width(leaves: int, level: int) -> int:
    """Nodes on a level over so many leaves."""
    return (leaves + (1 << level) - 1) >> level


def height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder of a tree of ``leaves``."""
    first = index << level
    under = min(leaves - first, 1 << level)
    return 2 * first - first.bit_count() + sum(width(under, k) for k in range(level + 1)) - 1


def completed(digests: list[bytes], levels: int) -> list[bytes]:
    """All nodes over consecutive leaves, up to ``levels`` above them, in the order in which they are complete."""
    log, waiting = [], [None] * levels
    for digest in digests:
        log.append(digest)
        for level in range(levels):
            left, waiting[level] = waiting[level], None
            if left is None:
                waiting[level] = digest
                break
            digest = combined(left, digest)
            log.append(digest)
    last: tuple[bytes, ...] = ()
    for level in range(levels):
        run = (waiting[level], *last) if waiting[level] is not None else last
        last = (combined(*run),) if run else ()
        log += last
    return log


def path_in(log: Callable[[int], bytes], index: int, leaves: int, levels: int) -> list[tuple[int, bytes]]:
    """(side, sibling) from leaf ``index`` upwards; ``log`` gives the node at a position."""
    path = []
    for level in range(levels):
        own = index >> level
        sibling = own ^ 1
        if sibling >= width(leaves, level):
            path.append((_ALONE, b""))
        else:
            path.append((_LEFT if sibling < own else _RIGHT, log(position(level, sibling, leaves))))
    return path


def packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + sibling for side, sibling in path)


def unpacked(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        side, size = path[at], 0 if path[at] == _ALONE else SIZE
        out.append((side, path[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its path lead to."""
    for side, sibling in path:
        if side == _ALONE:
            digest = combined(digest)
        else:
            digest = combined(sibling, digest) if side == _LEFT else combined(digest, sibling)
    return digest


def numbered(rows: DataFrame, ws: Workspace, order: list[str]) -> DataFrame:
    """``rows`` (with ``tree``) with their place ``at`` in their tree and its number of leaves ``n``."""
    dealt = ws.write(rows.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    tree = Window.partitionBy("tree")
    before = F.sum("_count").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_count"))
    counts = counts.select("tree", "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_count").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside)
        .join(counts, ["tree", "_range"])
        .withColumn("at", F.col("_before") + F.col("_inside") - 1)
        .drop("_range", "_before", "_inside")
    )


@dataclass(frozen=True)
class Manifest:
    """The log of every stage, (tree, block, n, leaves, top, nodes), and ``roots`` (tree, stage, root)."""

    stages: list[DataFrame]
    roots: DataFrame
    bits: int


_FRAGMENT = "tree string, block long, n long, leaves int, top boolean, nodes binary"


def build(leaves: DataFrame, ws: Workspace, bits: int = BITS) -> Manifest:
    """The manifest of ``leaves`` (tree, at, n, digest)."""

    def append(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block["n"][0].as_py()
        log = completed(block["digest"].to_pylist(), min(bits, height(n)))
        return pa.table(
            {
                "tree": block["tree"].slice(0, 1).cast(pa.string()),
                "block": pa.array([block["at"][0].as_py() >> bits], pa.int64()),
                "n": pa.array([n], pa.int64()),
                "leaves": pa.array([block.num_rows], pa.int32()),
                "top": pa.array([n <= 1 << bits]),
                "nodes": pa.array([b"".join(log)], pa.binary()),
            }
        )

    stages, level = [], leaves.select("tree", "at", "n", "digest")
    while True:
        blocks = level.groupBy("tree", F.shiftright("at", bits).alias("_block"))
        stages.append(ws.write(blocks.applyInArrow(append, _FRAGMENT), "log"))
        rest = stages[-1].where("not top")
        if rest.isEmpty():
            break
        above = F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n")
        level = rest.select("tree", F.col("block").alias("at"), above, _root().alias("digest"))
    tops = [s.where("top").select("tree", F.lit(k).alias("stage"), _root().alias("root")) for k, s in enumerate(stages)]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return Manifest(stages, ws.write(roots, "roots"), bits)


def _root() -> Column:
    """The last node of a fragment."""
    return F.substring("nodes", -SIZE, SIZE)


def _node_at(nodes: bytes) -> Callable[[int], bytes]:
    return lambda k: nodes[SIZE * k : SIZE * (k + 1)]


def fragments_with_paths(manifest: Manifest, ws: Workspace, tops: DataFrame | None = None) -> DataFrame:
    """The log of the first stage with ``above``, the path from each fragment's root on, and its tree's ``root``.

    ``tops`` (tree, path) goes on above the trees' own roots.
    """
    bits = manifest.bits

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = _Held(row, bits)
                own = [packed(held.path(held.first + k)) for k in range(held.leaves)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(own), pa.string()),
                        pa.array(range(held.first, held.first + len(own)), pa.int64()),
                        pa.array([row["root"]] * len(own), pa.binary()),
                        pa.array(own, pa.binary()),
                    ],
                    names=["tree", "block", "root", "above"],
                )

    paths = None
    for stage in range(len(manifest.stages) - 1, -1, -1):
        given = manifest.roots.where(F.col("stage") == stage).select("tree", F.lit(0).cast("long").alias("block"), "root")
        given = given.join(tops.select("tree", F.col("path").alias("above")), "tree") if tops is not None else given.withColumn("above", F.lit(b""))
        if paths is not None:
            given = given.unionByName(paths)
        held = manifest.stages[stage].join(given, ["tree", "block"])
        if stage:
            paths = ws.write(held.mapInArrow(below, "tree string, block long, root binary, above binary"), "paths")
    return held


class _Held:
    """A fragment of the log, with the path above it, while its leaves are served."""

    def __init__(self, row: dict, bits: int):
        self.leaves, self.levels, self.first = row["leaves"], min(bits, height(row["n"])), row["block"] << bits
        self.nodes, self.above, self.root = row["nodes"], unpacked(row["above"]), row["root"]

    def node(self, k: int) -> bytes:
        return self.nodes[SIZE * k : SIZE * (k + 1)]

    def path(self, at: int) -> list[tuple[int, bytes]]:
        return path_in(self.node, at - self.first, self.leaves, self.levels) + self.above


def audited(
    manifest: Manifest, claims: DataFrame, ws: Workspace, tops: DataFrame | None = None, claimed: str = "claimed"
) -> DataFrame:
    """``claims`` (tree, at, claimed, and any others) with ``path``, ``tree_root`` and ``folded``.

    ``path`` is the proof (``unpacked`` gives its steps), ``folded`` the root that the claimed
    leaf and the proof lead to; all are null where the manifest has no such leaf.  Claims of
    one block of leaves meet in one task: a leaf should have a few claims at most.
    """
    bits = manifest.bits
    kinds = {"path": "binary", "tree_root": "binary", "folded": "binary"}
    columns = [f for f in claims.schema.fields if f.name not in ("block", *kinds)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + [f"{k} {t}" for k, t in kinds.items()])

    def check(leaves: pa.Table, fragment: pa.Table) -> pa.Table:
        held = _Held(fragment.to_pylist()[0], bits) if fragment.num_rows else None
        out = leaves.select([f.name for f in columns])
        paths, roots, ends = [], [], []
        for at, digest in zip(leaves["at"].to_pylist(), leaves[claimed].to_pylist(), strict=True):
            known = held is not None and 0 <= at - held.first < held.leaves
            path = held.path(at) if known else None
            paths.append(packed(path) if known else None)
            roots.append(held.root if known else None)
            ends.append(folded(digest, path) if known and digest is not None else None)
        for name, values in zip(kinds, (paths, roots, ends), strict=True):
            out = out.append_column(name, pa.array(values, pa.binary()))
        return out

    log = fragments_with_paths(manifest, ws, tops).select("tree", "block", "n", "leaves", "nodes", "above", "root")
    placed = claims.select(*[f.name for f in columns]).withColumn("block", F.shiftright("at", bits))
    return placed.groupBy("tree", "block").cogroup(log.groupBy("tree", "block")).applyInArrow(check, schema)


def proof_digest(paths: pa.Array) -> pa.Array:
    """H of the siblings of each path."""
    return pa.array([combined(*[s for side, s in unpacked(p) if side != _ALONE]) for p in paths.to_pylist()], pa.binary())


def audit_documents(documents: DataFrame, tampered: Column, ws: Workspace, bits: int = BITS) -> DataFrame:
    """A manifest of documents, a tree per ``lang`` under one root, and what verification says of each document.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests in hex.  Where
    ``tampered``, ``n_chars`` is claimed to be one more than the manifest has it.
    """
    c = F.col
    more = (c("n_chars").cast("decimal(20,0)") + 1).cast("string")
    own, other = (leaf(c("doc_id"), c("source"), c("lang"), n, c("text")) for n in (c("n_chars"), more))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row_no"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), c("lang").cast("string")), F.lit("")).alias("tree"),
        own.alias("digest"),
        F.when(tampered, other).otherwise(own).alias("claimed"),
    )
    rows = ws.write(numbered(ws.write(rows, "leaves"), ws, ["doc_id", "digest", "row_no"]), "numbered")
    trees = build(rows, ws, bits)
    subroots = trees.roots.select(F.lit("").alias("tree"), c("tree").alias("lang_tree"), c("root").alias("digest"))
    subroots = ws.write(numbered(subroots, ws, ["lang_tree"]), "subroots")
    whole = build(subroots, ws, bits)
    upper = audited(whole, subroots.select("tree", "at", "lang_tree", c("digest").alias("claimed")), ws)
    tops = ws.write(upper.select(c("lang_tree").alias("tree"), "path"), "tops")
    first = whole.roots.select("root").first()
    root = F.lit(bytes(first.root) if first else b"")  # without documents there is none, and no row to show it

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("path"), "path", proof_digest(batch["path"]))

    found = audited(trees, rows.select("tree", "at", "doc_id", "digest", "claimed"), ws, tops).select(
        "doc_id", "digest", "tree_root", "path", "folded"
    )
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    found = found.mapInArrow(proofs, f"doc_id {doc_type}, digest binary, tree_root binary, path binary, folded binary")

    def hexed(x: Column) -> Column:
        return F.lower(F.hex(x))

    return found.select(
        "doc_id",
        hexed(c("digest")).alias("leaf"),
        hexed(c("tree_root")).alias("subroot"),
        hexed(root).alias("root"),
        hexed(c("path")).alias("proof_sha256"),
        hexed(c("folded")).alias("folded_root"),
        (c("folded") == root).alias("verified"),
    )


_H = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_H.format(k) for k in ("doc_id", "source", "lang", "{n}", "text")) + ")"
ORACLE = f"""
WITH RECURSIVE src AS (
  SELECT *, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')] AS bytes FROM documents),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
           list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 7 = 0
      THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS claimed
  FROM src),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS row_no FROM d),
a(tree, lvl, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT l.row_no, a.lvl AS step, a.h AS sibling, a.pos < (l.pos >> a.lvl) AS before
  FROM l JOIN a ON a.tree = l.tree AND a.n > 1 AND a.pos = xor(l.pos >> a.lvl, 1)
  UNION ALL
  SELECT l.row_no, 100 + b.lvl, b.h, b.pos < (s.pos >> b.lvl) FROM l JOIN s USING (tree) JOIN b ON b.n > 1 AND b.pos = xor(s.pos >> b.lvl, 1)),
heights AS (
  SELECT l.row_no, a.lvl AS step FROM l JOIN (SELECT DISTINCT tree, lvl FROM a WHERE n > 1) a USING (tree)
  UNION ALL
  SELECT l.row_no, 100 + lvl FROM l, (SELECT DISTINCT lvl FROM b WHERE n > 1)),
numbered AS (
  SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY step) AS k, sibling, before FROM heights LEFT JOIN steps USING (row_no, step)),
f(row_no, k, h) AS (
  SELECT row_no, 0::BIGINT, claimed FROM l
  UNION ALL
  SELECT f.row_no, f.k + 1, sha256(CASE WHEN m.sibling IS NULL THEN f.h WHEN m.before THEN m.sibling || f.h ELSE f.h || m.sibling END)
  FROM f JOIN numbered m ON m.row_no = f.row_no AND m.k = f.k + 1)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root,
  sha256(coalesce((SELECT string_agg(sibling, '' ORDER BY step) FROM steps WHERE steps.row_no = l.row_no), '')) AS proof_sha256,
  e.h AS folded_root, e.h = t.h AS verified
FROM l JOIN s USING (tree) JOIN b t ON t.n = 1 JOIN (SELECT row_no, arg_max(h, k) AS h FROM f GROUP BY row_no) e USING (row_no)
"""
