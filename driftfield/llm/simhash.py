"""Near-duplicate documents by a self-join of SimHash fingerprints in a binary trie.

A text's words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case, its
shingles all runs of ``size`` words joined by spaces, repeats included (fewer words: all of them
as one).  A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.
Fingerprints link where at most ``limit`` of the 64 bits differ; documents are in one component
where links lead from one to the other.

1. Distinct fingerprints that differ within one block of four bits are linked first: such a
   group has at most 16 members, and dense balls of near copies become one component early on.
2. Fingerprints are range-sorted and cut into runs of at most ``RUN`` values along the borders
   of the trie; the common prefix of a run is its node.
3. Pairs of nodes go down the trie together, ``STEP`` bits a round, as Spark joins of pairs with
   their children; differing bits add up, and a pair beyond its budget goes no further.  What is
   left are pairs of runs that may hold links.
4. Each pair of runs goes on bit by bit in a task, until the nodes are a few values that are
   compared.  A pair of nodes that lie in one component already is dropped; found links are
   emitted once per pair of components, so a dense group never becomes all its pairs.

Two turns keep the budget small where the trie is wide: a pair with at most ``limit`` differing
bits has at most ``limit // 2`` in the first half, or at most ``(limit - 1) // 2`` in the second.
The first turn walks the bits as they are, the second from the middle on.  This is exact.

Null and empty texts have fingerprint 0 and link like any other; long texts are read whole.
Repeated rows are documents with equal fingerprints.  Documents without an id are linked, but
name no component: one of such documents only has a null component.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.encode import small_batches
from driftfield.operators.components import connected_components
from driftfield.workspace import Workspace

SHINGLE = 4
LIMIT = 4
SEED = 42
#: Values in a run: a pair of runs is what one call of the kernel sees.
RUN = 4096
#: Bits that pairs of nodes go down in a round.
STEP = 4
#: Node pairs of so few value pairs are compared directly.
FEW = 64
#: Value pairs compared at a time.
TOGETHER = 1 << 20
#: Pairs of runs in an Arrow batch.
PAIRS = 64
#: A fingerprint of more than one in so many rows is joined by broadcast (there are at most so many).
HOT = 10_000
HALF = 32

_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)] if words else []
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - size + 1].tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits set in over half of each document's hashes; ``count`` hashes a document, one after the other."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    n = count[some]
    if not len(n):
        return out
    first = np.cumsum(n) - n
    parts = -(-n // 255)  # so many hashes can be added up in a byte
    doc = np.cumsum(parts) - parts
    at = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(doc, parts))
    for byte in range(8):
        lanes = _LANES[(hashes >> np.uint64(8 * byte)) & np.uint64(255)]
        sums = np.add.reduceat(lanes, at).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits = 2 * np.add.reduceat(sums, doc, axis=0) > n[:, None]
        out[some] |= (bits.astype(np.uint64) << (np.arange(8) + 8 * byte).astype(np.uint64)).sum(axis=1).astype(np.uint64)
    return out


def fingerprints(documents: DataFrame, size: int = SHINGLE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(shingle_hashes(t or b"", size), np.uint64) for t in batch["text"].to_pylist()]
            count = np.fromiter(map(len, hashes), np.int64, len(hashes))
            fp = majority(np.concatenate(hashes), count) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(build, "doc_id long, fp long")


def block_neighbours(values: DataFrame, bits: int = 4) -> DataFrame:
    """(src, dst) of values that differ within one aligned block of ``bits`` bits."""
    masks = [(((1 << bits) - 1) << k) & ((1 << 64) - 1) for k in range(0, 64, bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rest = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(~m)).alias("rest")) for k, m in enumerate(signed)])
    groups = values.select("fp", F.explode(rest).alias("g")).groupBy("g.part", "g.rest").agg(F.collect_list("fp").alias("members"))
    groups = groups.where(F.size("members") > 1).withColumn("least", F.array_min("members"))
    return groups.select(F.explode("members").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def budgets(limit: int) -> list[int]:
    """Differing bits allowed in the first half, per turn."""
    return [b for b in (limit // 2, (limit - 1) // 2) if b >= 0]


def cut(values: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(first, end, common bits) of runs of at most ``most`` sorted values along the borders of the trie."""
    out, todo = [], [(0, len(values))] if len(values) else []
    while todo:
        a, z = todo.pop()
        depth = 64 - (int(values[a]) ^ int(values[z - 1])).bit_length()
        if z - a <= most:
            out.append((a, z, depth))
            continue
        bit = 1 << (63 - depth)
        middle = (int(values[a]) | (bit - 1)) + 1  # the first value with the bit set
        at = a + int(np.searchsorted(values[a:z], np.uint64(middle)))
        todo += [(at, z), (a, at)]
    return out


_RUNS = "turn int, v long, depth int, fps binary, components binary"


def runs(values: DataFrame, limit: int, run: int = RUN) -> DataFrame:
    """(turn, v, depth, fps, components): ``v`` is a run's first value, as the turn walks it."""
    turned = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", 64 - HALF))
    walks = [F.struct(F.lit(t).alias("turn"), v.alias("v")) for t, v in enumerate((F.col("fp"), turned)[: len(budgets(limit))])]
    low = F.lit(-(1 << 63))
    walked = values.select(F.explode(F.array(*walks)).alias("w"), "component").select("w.turn", F.col("w.v").bitwiseXOR(low).alias("order"), "component")
    dealt = walked.repartitionByRange("turn", "order").sortWithinPartitions("turn", "order")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            turns = table["turn"].to_numpy()
            values = table["order"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            owner = table["component"].to_numpy()
            for turn in np.unique(turns):
                own, whose = values[turns == turn], owner[turns == turn]
                pieces = cut(own, run)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([turn] * len(pieces), pa.int32()),
                        pa.array([int(own[a : a + 1].view(np.int64)[0]) for a, _, _ in pieces], pa.int64()),
                        pa.array([d for _, _, d in pieces], pa.int32()),
                        pa.array([own[a:z].astype("<u8").tobytes() for a, z, _ in pieces], pa.binary()),
                        pa.array([whose[a:z].astype("<i8").tobytes() for a, z, _ in pieces], pa.binary()),
                    ],
                    names=["turn", "v", "depth", "fps", "components"],
                )

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 16 * run:
                yield from emit(held)
                held, count = [], 0
        if held:
            yield from emit(held)

    return dealt.mapInArrow(build, _RUNS)


def _allowed(a: str, b: str, depth: str, turn: str, limit: int) -> Column:
    """Whether the first ``depth`` bits of two values are within the budgets."""
    first = F.expr("CASE " + " ".join(f"WHEN {turn} = {t} THEN {n}" for t, n in enumerate(budgets(limit))) + " END")
    half = F.expr(f"CASE WHEN {depth} = 0 THEN 0 ELSE bit_count(shiftrightunsigned({a} ^ {b}, 64 - least({depth}, {HALF}))) END")
    whole = F.expr(f"CASE WHEN {depth} = 0 THEN 0 ELSE bit_count(shiftrightunsigned({a} ^ {b}, 64 - {depth})) END")
    return (half <= first) & (whole <= limit)


def run_pairs(nodes: DataFrame, ws: Workspace, limit: int) -> DataFrame:
    """(turn, a, b) of runs (turn, v, depth) that may hold links, a run with itself included; each pair once."""
    deepest = nodes.agg(F.max(F.least("depth", F.lit(64 - STEP)))).first()[0] or 0
    turns = [(t, 0, 0) for t in range(len(budgets(limit)))]
    pairs = nodes.sparkSession.createDataFrame(turns, "turn int, p long, q long")
    found = []
    for depth in range(0, deepest + 1, STEP):

        def at(level: int, v: str = "v") -> Column:
            return F.expr(f"shiftrightunsigned({v}, 64 - {level})") if level else F.lit(0).cast("long")

        here = nodes.where(F.col("depth") >= depth)
        ends = F.col("depth") < depth + STEP if depth + STEP < 64 else F.lit(True)
        sides = {}
        for side, node in (("a", "p"), ("b", "q")):
            own = here.select("turn", at(depth).alias(node), F.col("v").alias(side), F.col("depth").alias(f"{side}_depth"), ends.alias(f"{side}_ends"))
            sides[side] = own
        left = pairs.join(sides["a"].where("a_ends"), ["turn", "p"]).join(sides["b"], ["turn", "q"])
        left = left.where("p <> q OR NOT b_ends OR a <= b")
        right = pairs.where("p <> q").join(sides["a"].where("NOT a_ends"), ["turn", "p"]).join(sides["b"].where("b_ends"), ["turn", "q"])
        both = left.unionByName(right).withColumn("common", F.least("a_depth", "b_depth"))
        found.append(ws.write(both.where(_allowed("a", "b", "common", "turn", limit)).select("turn", "a", "b"), "run_pairs"))
        if depth + STEP > deepest:
            break
        deeper = nodes.where(F.col("depth") >= depth + STEP).select("turn", at(depth).alias("p"), at(depth + STEP).alias("c")).distinct()
        below = pairs.join(deeper.withColumnRenamed("c", "pc"), ["turn", "p"])
        below = below.join(deeper.withColumnsRenamed({"p": "q", "c": "qc"}), ["turn", "q"]).where("p <> q OR pc <= qc")
        level = depth + STEP
        moved = [f"shiftleft({c}, {64 - level})" for c in ("pc", "qc")]
        below = below.where(_allowed(*moved, str(level), "turn", limit))
        pairs = ws.write(below.select("turn", F.col("pc").alias("p"), F.col("qc").alias("q")), "node_pairs")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def linked(
    a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, same: bool, half: int, limit: int
) -> np.ndarray:
    """Distinct pairs of components that links between sorted values ``a`` and ``b`` join."""
    a_run, b_run = (np.cumsum(np.append(0, c[1:] != c[:-1])) for c in (a_of, b_of))
    node = np.array([[0, len(a), 0, len(b), 0]])  # ranges in a and in b, differing bits
    found = [np.zeros((0, 2), np.int64)]
    depth = 0
    while len(node):
        a0, a1, b0, b1, off = node.T
        one = (a_run[a0] == a_run[a1 - 1]) & (b_run[b0] == b_run[b1 - 1]) & (a_of[a0] == b_of[b0])
        few = (a1 - a0) * (b1 - b0) <= FEW
        found += _compared(node[few & ~one], a, a_of, b, b_of, limit)
        node = node[~few & ~one]
        if not len(node):
            break
        a0, a1, b0, b1, off = node.T
        am, bm = _middle(a, a0, depth), _middle(b, b0, depth)
        am, bm = np.minimum(am, a1), np.minimum(bm, b1)
        mirrored = same & (a0 == b0) & (a1 == b1)
        children = [
            np.stack([a0, am, b0, bm, off], axis=1),
            np.stack([am, a1, bm, b1, off], axis=1),
            np.stack([a0, am, bm, b1, off + 1], axis=1),
            np.stack([am, a1, b0, bm, off + 1], axis=1)[~mirrored],
        ]
        node = np.concatenate(children)
        depth += 1
        budget = half if depth <= HALF else limit
        node = node[(node[:, 0] < node[:, 1]) & (node[:, 2] < node[:, 3]) & (node[:, 4] <= budget)]
    return np.unique(np.concatenate(found), axis=0)


def _middle(values: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Place of the first value with the next bit set, in the nodes whose first values are given."""
    bit = np.uint64(1 << (63 - depth))
    above = ~(bit | (bit - np.uint64(1)))
    return np.searchsorted(values, (values[first] & above) | bit)


def _compared(node, a, a_of, b, b_of, limit: int) -> list[np.ndarray]:
    """Pairs of components from nodes whose values are all compared."""
    out = []
    size = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2])
    part = np.cumsum(size) // TOGETHER
    for k in np.unique(part):
        a0, _, b0, b1, _ = node[part == k].T
        n = size[part == k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b1 - b0, n)
        i, j = np.repeat(a0, n) + inside // wide, np.repeat(b0, n) + inside % wide
        hit = (np.bitwise_count(a[i] ^ b[j]) <= limit) & (a_of[i] != b_of[j])
        ends = np.sort(np.stack([a_of[i[hit]], b_of[j[hit]]], axis=1), axis=1)
        out.append(np.unique(ends, axis=0))
    return out


def trie_links(values: DataFrame, ws: Workspace, limit: int = LIMIT, run: int = RUN) -> DataFrame:
    """(src, dst) between components of values (fp, component) that links join, found in the trie."""
    spark = values.sparkSession
    tree = ws.write(runs(values, limit, run), "runs")
    pairs = run_pairs(ws.write(tree.select("turn", "v", "depth"), "nodes"), ws, limit)
    a = tree.select("turn", F.col("v").alias("a"), F.col("fps").alias("a_fps"), F.col("components").alias("a_of"))
    b = tree.select("turn", F.col("v").alias("b"), F.col("fps").alias("b_fps"), F.col("components").alias("b_of"))
    half = budgets(limit)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = [np.frombuffer(row[k], kind) for k, kind in (("a_fps", "<u8"), ("a_of", "<i8"), ("b_fps", "<u8"), ("b_of", "<i8"))]
                got = linked(*sides, row["a"] == row["b"], half[row["turn"]], limit)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["src", "dst"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PAIRS))
    try:
        found = pairs.join(a, ["turn", "a"]).join(b, ["turn", "b"]).mapInArrow(find, "src long, dst long")
        return ws.write(found.distinct(), "trie_links")
    finally:
        spark.conf.set(key, before)


def near_components(
    documents: DataFrame,
    ws: Workspace,
    size: int = SHINGLE,
    limit: int = LIMIT,
    doc: str = "doc_id",
    text: str = "text",
    run: int = RUN,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    small_batches(documents.sparkSession)
    docs = ws.write(fingerprints(documents, size, doc, text), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    distinct = ws.write(distinct, "distinct")
    joined = distinct.select("fp", F.col("fp").alias("component"))
    if limit:
        near = connected_components(block_neighbours(distinct.select("fp"), min(4, limit)), ws)
        near = near.select(F.col("node").alias("fp"), F.col("component").alias("near"))
        joined = distinct.select("fp").join(near, "fp", "left").select("fp", F.coalesce("near", "fp").alias("component"))
        joined = ws.write(joined, "balls")
        whole = connected_components(trie_links(joined, ws, limit, run), ws)
        whole = whole.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        joined = joined.join(whole, "component", "left").select("fp", F.coalesce("whole", "component").alias("component"))
    known = ws.write(joined.join(distinct, "fp"), "components")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ws.write(known.join(names, "component").select("fp", "rows", "component_id"), "named")
    total = named.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT > total
    hot = F.broadcast(named.where(is_hot).select("fp", "component_id"))
    rest = docs.join(hot.select("fp"), "fp", "left_anti").join(named.where(~is_hot).select("fp", "component_id"), "fp")
    both = docs.join(hot, "fp").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
