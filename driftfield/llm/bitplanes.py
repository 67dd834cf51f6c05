"""Token ids in binary files: fixed-size blocks as compressed byte or bit planes, with a chunk index.

A shard file is a magic word, the planes of its blocks, and a footer (Parquet-like: the
reader starts from the end).  A block holds ``block_ids`` ids (the last one fewer) as
little-endian unsigned 32-bit integers; plane j holds byte (or bit) j of every id, and is
a zstandard frame of its own.  The footer has the chunk index (offset of every plane, ids
per block) and the documents' ids and lengths.  Documents may cross blocks, not shards.

Shards follow the order of ``doc_id`` (nulls first; repeated ids by text).  Every task
writes under a name of its own and reports it; only reported files count, so the files of
lost or repeated attempts are never read.  Memory is one block and one batch of texts.

Null and empty texts hold the end id alone. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.encode import encoded_blocks, small_batches

MAGIC = b"BPLANES1"
BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block, least significant first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, j].tobytes() for j in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, j]).tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[list[int]] = []  # ids, offset of the first plane, sizes of the planes
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths.append(np.asarray(lengths, np.int64))
        self.waiting.append(np.asarray(ids, np.uint32))
        self.held += len(ids)
        if self.held >= self.block_ids:
            held = np.concatenate(self.waiting)
            full = len(held) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(held[k : k + self.block_ids])
            self.waiting, self.held = [held[full:]], len(held) - full

    def _block(self, ids: np.ndarray) -> None:
        start, sizes = self.at, []
        for plane in to_planes(ids, self.kind):
            packed = self.compress(plane)
            sizes.append(len(packed))
            self._put(packed)
        self.blocks.append([len(ids), start, *sizes])

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) after the footer is written."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        index = np.asarray(self.blocks, np.int64)
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], np.int64)
        parts = [self.compress(a.tobytes()) for a in (index, known, docs, lengths)]
        head = {"kind": self.kind, "blocks": len(self.blocks), "docs": len(docs), "parts": [len(p) for p in parts]}
        text = json.dumps(head).encode()
        self._put(b"".join(parts) + text + struct.pack("<q", len(text)) + MAGIC)
        return len(docs), int(lengths.sum()), self.at


class ShardReader:
    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete shard file")
        n = struct.unpack("<q", tail[:8])[0]
        head = json.loads(source.read_at(n, size - 16 - n))
        at = size - 16 - n - sum(head["parts"])
        parts = []
        for p in head["parts"]:
            parts.append(self.decompress(source.read_at(p, at)) if p else b"")
            at += p
        self.kind = head["kind"]
        index, known, docs, lengths = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "u1", "<i8", "<i8"), strict=True))
        self.blocks = index.reshape(head["blocks"], -1)
        self.docs = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        self.lengths = lengths

    def block(self, k: int) -> np.ndarray:
        n, at, *sizes = self.blocks[k].tolist()
        planes = []
        for s in sizes:
            planes.append(self.decompress(self.source.read_at(s, at)))
            at += s
        return from_planes(planes, n, self.kind)

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids), reading every block once."""
        ends = np.cumsum(self.lengths)
        done, held, base = 0, np.zeros(0, np.uint32), 0
        for k in range(len(self.blocks)):
            held = np.concatenate([held, self.block(k)])
            to = int(np.searchsorted(ends, base + len(held), "right"))
            if to > done:
                used = int(ends[to - 1]) - base
                yield done, to, held[:used]
                done, held, base = to, held[used:], base + used
        if done < len(self.docs):
            yield done, len(self.docs), held


MANIFEST = "shard long, path string, docs long, ids long, bytes long"


def write_token_files(
    documents: DataFrame,
    root: str,
    tokenizer: str,
    end_id: int | None = None,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode and write all texts in ascending order of ``doc`` under ``root``; one row per shard file.

    The result must be written once (see :func:`committed`) before it is read: writing it runs the tasks.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(root)
        writer, path = None, f"{base}/{number:06d}-{uuid.uuid4().hex}.bplanes"
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, to, ids, lengths in encoded_blocks(batch.column(1), tokenizer):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    writer = ShardWriter(files.open_output_stream(path), kind, block_ids)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                writer.add(docs[at:to], ids, lengths)
        if writer is not None:
            n, total, size = writer.close()
            writer.sink.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [number], "path": [path], "docs": [n], "ids": [total], "bytes": [size]}
            )

    small_batches(documents.sparkSession)
    ordered = documents.select(F.col(doc).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = ordered.repartitionByRange("_doc", F.xxhash64("_text")).sortWithinPartitions("_doc", F.xxhash64("_text"), "_text")
    return ordered.mapInArrow(shard, MANIFEST)


def read_token_files(manifest: DataFrame, root: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files in a written manifest: doc_id, start, n_tokens, ids_crc32 [, ids].

    ``start`` counts the ids of all documents before it, over all shards.
    """
    counted = manifest.withColumn(
        "_base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )  # a row per shard: a few numbers each

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    reader = ShardReader(source)
                    start = base + np.cumsum(reader.lengths) - reader.lengths
                    for a, b, ids in reader.runs():
                        n = reader.lengths[a:b]
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n) * 4
                        out = {
                            "doc_id": pa.array(reader.docs[a:b], pa.int64()),
                            "start": pa.array(start[a:b], pa.int64()),
                            "n_tokens": pa.array(n, pa.int64()),
                            "ids_crc32": pa.array(
                                [zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64()
                            ),
                        }
                        if with_ids:
                            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    shards = max(1, manifest.count())
    return counted.select("path", "_base").repartition(shards).mapInArrow(documents, schema)
