"""Documents whose sets of word shingles are alike, as a blocked sparse matrix product.

The incidence matrix has a row per distinct set and a column per shingle.  Two sets can only
reach the wanted Jaccard similarity if they share a column among the first few of each in one
common order of columns (how many follows from the sets' sizes), so only that part of the
product decides which rows can meet:

1. Sets are reduced to digests; documents with equal sets form a class, a row of the matrix.
   The same pass counts shingles in a sketch of fixed size, which orders columns from rare to
   common.  The order need not be exact for exact results; it keeps columns that many texts
   share (passages, boilerplate) out of the prefixes.
2. Rows that share a column of their prefixes become neighbours if their sizes, and the place
   of the column in both, leave enough columns to share.  Connected rows form families; a
   similar pair is always inside one family.  Prefixes are shuffled once and never written.
3. Families are laid out in blocks of rows by set size.  A task multiplies two blocks, a run
   of columns at a time, accumulates overlaps and drops pairs below the bound that their sizes
   set.  It returns a spanning forest of the links it found and the number of links per row,
   so a family of thousands of near copies is never written out as pairs.
4. Links are contracted to components; every document gets the smallest id of its own.

All counts and the neighbours a task finds among its own rows are combined before shuffles,
classes that many rows share are keys of joins that can be split, and the filter that tells
which sets are needed again has a fixed size.  Nothing is capped or sampled.

Null and blank texts have no shingles, link with nothing and are components of their own.
Texts of fewer words than a shingle are one shingle. Repeated rows are separate documents and
linked. Rows with a null id link others but never name a component. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.encode import small_batches
from driftfield.llm.words import Words, mix, shingle_hashes, word_blocks
from driftfield.operators.components import connected_components, hook
from driftfield.operators.ranking import bucketed_row_number
from driftfield.workspace import Workspace

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 25
FILTER_BITS = 27
_SLICE_BITS = 6
BLOCK_ROWS = 512
#: Rows of prefixes in which a task looks for neighbours before they are shuffled.
HELD_ROWS = 1 << 19
_COLUMNS = 4096


class Sets:
    """Distinct shingle hashes of a run of documents, ordered within each, with a digest per document."""

    def __init__(self, words: Words, size: int):
        owner, h = shingle_hashes(words, size)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.owner, self.hash = owner[fresh], h[fresh]
        self.count = np.bincount(self.owner, minlength=words.docs)
        self.first = np.cumsum(self.count) - self.count
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hash), dtype=np.uint64)])
        total = sums[self.first + self.count] - sums[self.first]
        self.digest = mix(total + self.count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def _fresh(digests: np.ndarray, count: np.ndarray, seen: set[int]) -> np.ndarray:
    """Documents whose set this task has not met before."""
    out = []
    for k, (d, n) in enumerate(zip(digests.tolist(), count.tolist(), strict=True)):
        if n and d not in seen:
            seen.add(d)
            out.append(k)
    return np.asarray(out, np.int64)


def _thin(counts: np.ndarray) -> bytes:
    """Small counts, few of them not zero: a bit for each cell, and the counts that are there."""
    return np.packbits(counts > 0).tobytes() + counts[counts > 0].tobytes()


def _thick(raw: bytes, cells: int) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8)
    counts = np.zeros(cells, np.uint64)
    counts[np.unpackbits(packed[: cells // 8]).astype(bool)] = packed[cells // 8 :]
    return counts


def described(documents: DataFrame, size: int, doc: str, text: str) -> DataFrame:
    """(doc_id, digest, n) per document, and sketch rows (slice, part, counts) with how often shingles occurred."""
    slices = 1 << _SLICE_BITS

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            for at, to, words in word_blocks(batch.column(1)):
                sets = Sets(words, size)
                cell, times = np.unique(sets.hash & np.uint64(len(sketch) - 1), return_counts=True)
                cell = cell.astype(np.int64)
                sketch[cell] = np.minimum(sketch[cell] + times, 255)
                n = to - at
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n).cast(pa.int64()),
                        pa.array(sets.digest, mask=sets.count == 0),
                        pa.array(sets.count.astype(np.int64)),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
        compress = zstandard.ZstdCompressor(level=3).compress
        parts = sketch.reshape(slices, -1)
        some = [k for k in range(slices) if parts[k].any()]
        blobs = [compress(_thin(parts[k])) for k in some]
        n = len(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.array(some, pa.int32()),
                pa.array([TaskContext.get().partitionId() // 256] * n, pa.int32()),
                pa.array(blobs, pa.binary()),
            ],
            names=names,
        )

    names = ["doc_id", "digest", "n", "slice", "part", "counts"]
    return documents.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(
        describe, "doc_id long, digest long, n long, slice int, part int, counts binary"
    )


def merged_sketch(rows: DataFrame) -> np.ndarray:
    """Rarity level (0 to 255) of every cell of the sketch, from the counts of all tasks."""

    width = 1 << (SKETCH_BITS - _SLICE_BITS)

    def added(table: pa.Table, read) -> pa.Table:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        total = np.zeros(width, np.uint64)
        for blob in table["counts"]:
            total += read(decompress(blob.as_py()))
        total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
        packed = zstandard.ZstdCompressor(level=3).compress(total.tobytes())
        return pa.table({"slice": table["slice"][:1], "counts": pa.array([packed], pa.binary())})

    def first(table: pa.Table) -> pa.Table:
        return added(table, lambda raw: _thick(raw, width))

    def rest(table: pa.Table) -> pa.Table:
        return added(table, lambda raw: np.frombuffer(raw, "<u4"))

    once = rows.groupBy("slice", "part").applyInArrow(first, "slice int, counts binary")  # of at most 256 tasks each
    slices = once.groupBy("slice").applyInArrow(rest, "slice int, counts binary").collect()
    import zstandard

    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in slices:
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), "<u4")
        levels[r.slice * width : (r.slice + 1) * width] = np.minimum(8 * np.log2(1.0 + counts), 255)
    return levels


def _local_runs(column: np.ndarray, digest: np.ndarray, low: np.ndarray, reach: np.ndarray):
    """What one task can settle of ``neighbours``: (column, digest, low, reach, other) rows, ``other`` masked while open.

    Rows of one column whose sizes meet become one open row, their run, and a finished edge each.
    """
    order = np.lexsort((low, column))
    column, digest, low, reach = column[order], digest[order], low[order], reach[order]
    fresh = np.ones(len(column), bool)
    fresh[1:] = column[1:] != column[:-1]
    base = np.cumsum(fresh) << 32
    before = np.maximum.accumulate(base + np.maximum(reach, 0))
    met = np.zeros(len(column), bool)
    met[1:] = before[:-1] >= (base + low)[1:]
    opens = (reach >= low) & ~met
    head = np.maximum.accumulate(np.where(opens, np.arange(len(column)), 0))
    done = met & (low[head] <= reach)
    np.maximum.at(reach, head[done], reach[done])
    low[done], reach[done] = 1, 0
    again = np.argsort(order)  # rows of one set side by side are half as large in a shuffle
    return column[again], digest[again], low[again], reach[again], np.ma.array(digest[head], mask=~done)[again]


def prefixes(documents: DataFrame, levels: np.ndarray, size: int, percent: int, text: str) -> DataFrame:
    """(column, digest, low, reach, other): the columns of each distinct set that a similar set must share one of.

    ``low`` is the set's size.  If a column is the first that two sets share in the common order,
    all others they share come after it in both; ``reach`` is the largest size of another set that
    still allows a link then.  Rows with ``other`` are edges a task has found among its own sets.
    """
    order_of = documents.sparkSession.sparkContext.broadcast(levels)

    def settled(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        column, digest, low, reach, other = _local_runs(*(np.concatenate(z) for z in zip(*rows, strict=True)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(column),
                pa.array(digest),
                pa.array(low.astype(np.int32)),
                pa.array(reach.astype(np.int32)),
                pa.array(other.data, mask=other.mask),
            ],
            names=["column", "digest", "low", "reach", "other"],
        )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, rows, held = order_of.value, set(), [], 0
        for batch in batches:
            for _, _, words in word_blocks(batch.column(0)):
                sets = Sets(words, size)
                chosen = np.zeros(words.docs, bool)
                chosen[_fresh(sets.digest, sets.count, seen)] = True
                kept = chosen[sets.owner]
                owner, h = sets.owner[kept], sets.hash[kept]
                order = np.lexsort((h, levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)], owner))
                owner, h = owner[order], h[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(words.docs))[owner]
                n = sets.count[owner]
                first = place < n - (percent * n + 99) // 100 + 1
                reach = (n - place) * (100 + percent) // percent - n
                rows.append((h[first].view(np.int64), sets.digest[owner[first]], n[first], reach[first]))
                held += len(rows[-1][0])
                if held >= HELD_ROWS:
                    yield settled(rows)
                    rows, held = [], 0
        if rows:
            yield settled(rows)

    return documents.select(F.col(text)).mapInArrow(pick, "column long, digest long, low int, reach int, other long")


def neighbours(rows: DataFrame) -> DataFrame:
    """(digest, other): edges that connect all sets that a common column allows to link.

    The smaller set of such a pair reaches the size of the larger one, and the larger one reaches
    down to it.  In order of sizes, a row within the reach of those before it joins their run,
    named by its first set; nothing across two runs can link.  Every row is dealt out once.
    """
    sizes = Window.partitionBy("column").orderBy("low", "digest")
    upto = sizes.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max("reach").over(sizes.rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("met", F.coalesce(F.col("low") <= before, F.lit(False)))
    opens = F.when((F.col("reach") >= F.col("low")) & ~F.col("met"), F.struct("digest", "low"))
    run = met.withColumn("run", F.last(opens, ignorenulls=True).over(upto))
    found = F.when(F.col("met") & (F.col("run.low") <= F.col("reach")), F.col("run.digest"))
    edges = run.select("digest", F.coalesce("other", found).alias("other"))
    return edges.where("digest <> other").distinct()


def digest_filter(members: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has a bit for every digest."""
    width = 1 << (FILTER_BITS - _SLICE_BITS)

    def mark(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[_filter_cell(table["digest"].to_numpy()) % width] = True
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    sliced = members.select("digest").mapInArrow(_with_slice, "digest long, slice int")
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in sliced.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
        out[r.slice * width // 8 : (r.slice + 1) * width // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _filter_cell(digests: np.ndarray) -> np.ndarray:
    return (mix(digests.view(np.uint64) + np.uint64(1)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _with_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = _filter_cell(batch.column(0).to_numpy())
        part = (cell >> (FILTER_BITS - _SLICE_BITS)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part)], names=["digest", "slice"])


def needed_sets(documents: DataFrame, wanted: np.ndarray, size: int, text: str) -> DataFrame:
    """(digest, hashes) of the distinct sets that pass the filter."""
    bits_of = documents.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bits_of.value, set()
        for batch in batches:
            for _, _, words in word_blocks(batch.column(0)):
                sets = Sets(words, size)
                cell = _filter_cell(sets.digest)
                hit = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                rows = _fresh(sets.digest, sets.count * hit, seen)
                blobs = [sets.hash[a : a + n].tobytes() for a, n in zip(sets.first[rows], sets.count[rows])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.digest[rows]), pa.array(blobs, pa.binary())], names=["digest", "hashes"]
                )

    return documents.select(F.col(text)).mapInArrow(pick, "digest long, hashes binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets: a product, a run of columns at a time."""
    total = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(a, b)
    places = []
    for sets, flat in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(columns, flat)
        kept = np.flatnonzero(columns[np.minimum(at, len(columns) - 1)] == flat) if len(columns) else np.zeros(0, np.int64)
        order = np.argsort(at[kept], kind="stable")
        places.append((row[kept][order], at[kept][order]))
    for start in range(0, len(columns), _COLUMNS):
        width = min(_COLUMNS, len(columns) - start)
        parts = []
        for sets, (row, at) in zip((left, right), places, strict=True):
            lo, hi = np.searchsorted(at, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1.0
            parts.append(part)
        total += parts[0] @ parts[1].T
    return np.rint(total).astype(np.int64)


def linked(overlap: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which overlaps reach the similarity: 100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (n_left[:, None] + n_right[None, :] - overlap)


LINKS = "digest long, other long, links long"


def layout(members: DataFrame, ws: Workspace, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where the sets (family, digest, n, copies) are needed: first and second block of every product, and the own one."""
    place = bucketed_row_number(members, ["family"], {"_size": F.col("n")}, [F.col("digest")], "_row").withColumn(
        "block", F.floor((F.col("_row") - 1) / block_rows).cast("int")
    )
    place = ws.write(place.drop("_row"), "blocks")
    span = place.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = span.select("family", F.col("block").alias("second"), F.col("low").alias("low2"))
    pairs = (
        span.withColumnRenamed("block", "first")
        .join(other, "family")
        .where(F.col("first") <= F.col("second"))
        .where(100 * F.col("high") >= percent * F.col("low2"))
        .select("family", "first", "second")
    )
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    return place.join(sides, ["family", "block"])


def family_links(laid: DataFrame, percent: int) -> DataFrame:
    """Spanning links and link counts, a row per set and product, of laid out sets with their hashes."""

    def multiply(table: pa.Table) -> pa.Table:
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        block = table["block"].to_numpy()
        digest, n, copies = (table[c].to_numpy() for c in ("digest", "n", "copies"))
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in table["hashes"]]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        hit = linked(overlaps([sets[k] for k in left], [sets[k] for k in right]), n[left], n[right], percent)
        if first == second:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(digest), np.int64)
        links[left] += hit @ copies[right]
        if first != second:
            links[right] += hit.T @ copies[left]
        a, b = np.nonzero(hit)
        rank = np.argsort(np.argsort(digest, kind="stable"), kind="stable")
        by_rank = np.sort(digest)
        root = hook(len(digest), rank[left[a]], rank[right[b]])
        other = by_rank[root[rank]]
        some = links > 0
        return pa.table({"digest": digest[some], "other": other[some], "links": links[some]})

    return laid.select("family", "first", "second", "block", "digest", "n", "copies", "hashes").groupBy(
        "family", "first", "second"
    ).applyInArrow(multiply, LINKS)


def similar_components(
    documents: DataFrame,
    ws: Workspace,
    size: int = SHINGLE,
    percent: int = PERCENT,
    doc: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): n_links counts the other documents that link with this one."""
    small_batches(documents.sparkSession)
    stage = ws.write(described(documents, size, doc, text), "described")
    levels = merged_sketch(stage.where("slice is not null").select("slice", "part", "counts"))
    docs = stage.where("slice is null").select("doc_id", "digest", "n")
    classes = ws.write(
        docs.where("n > 0").groupBy("digest").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")
        ),
        "classes",
    )

    rows = prefixes(documents, levels, size, percent, text)
    families = connected_components(neighbours(rows), ws, src="digest", dst="other")
    families = families.select(F.col("node").alias("digest"), F.col("component").alias("family"))
    members = ws.write(families.join(classes.select("digest", "n", "copies"), "digest"), "families")

    wanted = digest_filter(members)
    places = ws.write(layout(members, ws, percent, block_rows), "layout")
    sets = needed_sets(documents, wanted, size, text).groupBy("digest").agg(F.first("hashes").alias("hashes"))
    links = ws.write(family_links(sets.join(places, "digest"), percent), "links")

    joined = connected_components(links, ws, src="digest", dst="other")
    joined = joined.select(F.col("node").alias("digest"), "component").join(classes, "digest")
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    known = classes.join(named.select("digest", "component_id"), "digest", "left").join(counts, "digest", "left")
    known = known.select(
        "digest",
        F.coalesce("component_id", "least").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return docs.join(known, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
