"""Byte-level BPE with content-defined chunks: a chunk that documents share is encoded once.

Texts are cut where a rolling hash of the last 32 bytes hits a pattern, so equal passages
give equal chunks wherever they stand.  The first document (smallest id) that has a shared
chunk encodes and publishes it; the others take its ids by the chunk's 128-bit digest.
Chunks of a document are then joined and the joins repaired: the text between the nearest
places on either side where a space follows a visible ASCII character is encoded anew, with
a word more on both sides; where these words come out as they were, the repair agrees with
its surroundings and is kept, otherwise the window is widened up to the whole document.
Such places end a pre-token in any byte-level file, so agreement means the ids of the whole
text.

Only digests are shuffled to find shared chunks (counted before the shuffle), texts move
once (compressed), and ids only for documents that take chunks from others.  A chunk that a third of all
documents share is a hot key of a join whose other side has one row for it.

Null texts count as empty and give no ids. Repeated rows give a row each. Special tokens in
a text become their ids, as in the library. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.encode import PieceEncoder, byte_lengths, encoder_for, small_batches
from driftfield.llm.words import mix, text_blocks
from driftfield.workspace import Workspace

#: Mean distance of cut candidates is 2 ** CUT_BITS bytes; chunks are at least LEAST_BYTES long.
CUT_BITS = 9
LEAST_BYTES = 128
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each document, relative to the block."""
    h, shift = _GEAR[data], 1
    while shift < 32 and len(h):  # hash of the last 2, 4, ... 32 bytes
        older = np.zeros_like(h)
        older[shift:] = h[:-shift] << np.uint32(shift)
        h = h + older
        shift *= 2
    hit = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    hit = hit[hit < len(data)]
    hit = hit[(data[hit] & 0xC0) != 0x80] if len(hit) else hit
    first = np.searchsorted(hit, offsets)
    out = []
    for k in range(len(offsets) - 1):
        at, stop, ends = int(offsets[k]), int(offsets[k + 1]), []
        for c in hit[first[k] : first[k + 1]].tolist():
            if c - at >= LEAST_BYTES and c < stop:
                ends.append(c)
                at = c
        if stop > offsets[k]:
            ends.append(stop)
        out.append(np.asarray(ends, np.int64))
    return out


def chunks_of(raw: memoryview, start: int, ends: np.ndarray) -> list[tuple[bytes, int, int]]:
    """(bytes, digest as two numbers) of the chunks of one document."""
    out, at = [], start
    for end in ends.tolist():
        part = bytes(raw[at:end])
        digest = hashlib.blake2b(part, digest_size=16).digest()
        out.append((part, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
        at = end
    return out


class TokenTable:
    """Byte strings by id, gathered for many ids at once."""

    def __init__(self, values: list[bytes]):
        size = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(size) - size
        self.size = size
        self.flat = np.frombuffer(b"".join(values), np.uint8)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, end of each id)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)], ends


def token_values(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer."""
    byte_of = {}
    spare = 256
    for b in range(256):  # printable bytes stand for themselves, the others follow from 256 on
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(spare)] = b
            spare += 1
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    added = {k: t.content.encode() for k, t in tokenizer.get_added_tokens_decoder().items()}
    for token, k in tokenizer.get_vocab(with_added_tokens=True).items():
        out[k] = added[k] if k in added else bytes(byte_of[c] for c in token)
    return out


class ByteCodec:
    """Encoding of chunks, joining of their ids, and decoding, for one byte-level tokenizer file."""

    def __init__(self, path: str):
        self.encoder: PieceEncoder = encoder_for(path)
        values = token_values(self.encoder.tokenizer)
        self.bytes = TokenTable(values)
        self.decimal = TokenTable([b"%d," % k for k in range(len(values))])
        self.spaced = np.array([v[:1] == b" " for v in values])
        self.visible = np.array([bool(v) and 0x21 <= v[-1] <= 0x7E for v in values])
        assert np.array_equal(self.bytes.size, byte_lengths(self.encoder.tokenizer))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.encoder.encode(texts)
        return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes.gather(ids)[0].tobytes().decode("utf-8", "replace")

    def join(self, docs: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Ids of whole documents from the ids of their chunks."""
        parts = [np.asarray(p, np.int32) for d in docs for p in d]
        if not parts:
            return [np.zeros(0, np.int32) for _ in docs]
        flat = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        per_doc = np.cumsum([len(d) for d in docs])
        doc_end = np.where(per_doc > 0, ends[per_doc - 1], 0)
        doc_start = np.concatenate([[0], doc_end[:-1]])
        edges = np.union1d(doc_start, doc_end)
        safe = np.zeros(len(flat) + 1, bool)
        safe[1:-1] = self.spaced[flat[1:]] & self.visible[flat[:-1]]
        safe[edges] = True
        joins = np.setdiff1d(ends, edges)
        joins = joins[~safe[joins]]
        fixed = self._repaired(flat, np.flatnonzero(safe), edges, joins) if len(joins) else []
        out, pieces, at = [], [], 0
        for a, b, ids in fixed:
            pieces += [flat[at:a], ids]
            at = b
        pieces.append(flat[at:])
        grown = np.zeros(len(flat) + 1, np.int64)  # how much longer everything before a place has become
        for a, b, ids in fixed:
            grown[b] += len(ids) - (b - a)
        grown = np.cumsum(grown)
        whole = np.concatenate(pieces)
        for a, b in zip(doc_start, doc_end, strict=True):
            out.append(whole[a + (grown[a] if a else 0) : b + grown[b]])
        return out

    def _repaired(self, flat, safe, edges, joins) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, new ids) of disjoint stretches of ``flat``, in order."""
        low = np.searchsorted(safe, joins, "left") - 1
        high = np.searchsorted(safe, joins, "right")
        lower = edges[np.searchsorted(edges, joins, "right") - 1]
        upper = edges[np.searchsorted(edges, joins, "right")]
        todo = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(low, high, lower, upper, strict=True)]
        done: list[tuple[int, int, np.ndarray]] = []
        words = 1
        while todo:
            windows: list[list[int]] = []  # start, inner start, inner end, end, bounds of the document
            for a, b, c, d in todo:
                start = max(c, int(safe[max(a - words, 0)]))
                end = min(d, int(safe[min(b + words, len(safe) - 1)]))
                inner = (int(safe[a]), int(safe[b]))
                if windows and start < windows[-1][3]:
                    windows[-1][2:4] = [inner[1], end]
                    windows[-1][6].append((a, b, c, d))
                else:
                    windows.append([start, *inner, end, c, d, [(a, b, c, d)]])
            texts = [self.decode(flat[w[0] : w[3]]) for w in windows]
            todo = []
            for (start, a, b, end, c, d, members), ids in zip(windows, self.encode(texts), strict=True):
                before, after = flat[start:a], flat[b:end]
                agrees = np.array_equal(ids[: len(before)], before) and np.array_equal(ids[len(ids) - len(after) :], after)
                if agrees and len(ids) >= len(before) + len(after) or (start == c and end == d):
                    done.append((start, end, ids))
                else:
                    todo += members
            words *= 8
        done.sort(key=lambda x: x[0])
        return self._merged(done)

    def _merged(self, done):
        """A widened window may take in neighbours that were repaired before: the widest counts."""
        out: list[tuple[int, int, np.ndarray]] = []
        for x in done:
            while out and x[0] < out[-1][1]:
                if x[1] - x[0] <= out[-1][1] - out[-1][0]:
                    break
                out.pop()
            else:
                out.append(x)
        return out


_codecs: dict[str, ByteCodec] = {}


def codec_for(path: str) -> ByteCodec:
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


@dataclass(frozen=True)
class Output:
    """What is kept of a document's ids: Spark columns, and a function of (codec, ids of documents) that fills them."""

    schema: str
    values: Callable[[ByteCodec, list[np.ndarray]], list[dict]]


def _ids(codec: ByteCodec, docs: list[np.ndarray]) -> list[dict]:
    return [{"ids": d.tolist()} for d in docs]


def _digests(codec: ByteCodec, docs: list[np.ndarray]) -> list[dict]:
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    reach = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    out = [{"n_tokens": len(d)} for d in docs]
    for name, table, comma in (("ids_sha256", codec.decimal, 1), ("decoded_sha256", codec.bytes, 0)):
        data, ends = table.gather(flat)
        ends = np.concatenate([[0], ends])[reach].tolist()
        raw = data.tobytes()
        for k, row in enumerate(out):
            part = raw[ends[k] : max(ends[k], ends[k + 1] - comma)]
            if not comma:
                part = part.decode("utf-8", "replace").encode()
            row[name] = hashlib.sha256(part).hexdigest()
    return out


IDS = Output("ids array<int>", _ids)
DIGESTS = Output("n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)

_CHUNK = pa.struct([("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.binary())])
_CHUNK_SQL = "array<struct<pos: int, h1: long, h2: long, ids: binary>>"


def encode_by_chunks(
    documents: DataFrame, ws: Workspace, tokenizer: str, output: Output = IDS, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, columns of ``output``) for every row of ``documents``."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"))
    docs = docs.withColumn("_key", F.coalesce(F.col("_doc"), F.lit(-(1 << 63) + 1)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column(1)):
                raw, rows = memoryview(data.tobytes()), ([], [], [], [])
                for k, ends in enumerate(cut_points(data, offsets)):
                    key = batch.column(0)[at + k].as_py()
                    for pos, (_, h1, h2) in enumerate(chunks_of(raw, int(offsets[k]), ends)):
                        for column, v in zip(rows, (key, pos, h1, h2), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    names=["_key", "pos", "h1", "h2"],
                )

    seen = ws.write(docs.select("_key", "_text").mapInArrow(digests, "_key long, pos int, h1 long, h2 long"), "chunks")
    shared = (
        seen.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "pos")).alias("_owner"))
        .where("_n > 1")
        .drop("_n")
    )
    roles = (
        seen.join(shared, ["h1", "h2"])
        .withColumn("own", F.struct("_key", "pos") == F.col("_owner"))
        .groupBy("_key")
        .agg(F.collect_set(F.struct("pos", "h1", "h2", "own")).alias("_shared"))
    )
    fields = output.schema
    stage_schema = f"row long, doc_id long, done struct<{_struct(fields)}>, parts {_CHUNK_SQL}, published {_CHUNK_SQL}"
    out_type = _arrow_struct(documents.sparkSession, fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = codec_for(tokenizer)
        decompress = zstandard.ZstdDecompressor().decompress
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            whole = pa.array([decompress(z.as_buffer()) for z in batch.column(1)], pa.large_binary())
            for at, to, data, offsets in text_blocks(whole.cast(pa.large_string())):
                raw = memoryview(data.tobytes())
                roles = batch.column(2).slice(at, to - at).to_pylist()
                texts: list[str] = []
                plan: list[list[tuple[int, int, int, int, bool]]] = []  # number of the text or -1, digest, position, published
                for k, ends in enumerate(cut_points(data, offsets)):
                    known = {(r["pos"], r["h1"], r["h2"]): r["own"] for r in roles[k] or ()}
                    steps = []
                    for pos, (part, h1, h2) in enumerate(chunks_of(raw, int(offsets[k]), ends)):
                        own = known.get((pos, h1, h2))
                        if own is False:
                            steps.append((-1, h1, h2, pos, False))
                        else:
                            steps.append((len(texts), h1, h2, pos, own is True))
                            texts.append(part.decode())
                    plan.append(steps)
                ids = codec.encode(texts)
                whole = [k for k, steps in enumerate(plan) if all(s[0] >= 0 for s in steps)]
                joined = codec.join([[ids[s[0]] for s in plan[k]] for k in whole])
                done = dict(zip(whole, output.values(codec, joined), strict=True))
                parts, published = [], []
                for k, steps in enumerate(plan):
                    parts.append(
                        None
                        if k in done
                        else [
                            {"pos": pos, "h1": h1, "h2": h2, "ids": packed(ids[t]) if t >= 0 else None}
                            for t, h1, h2, pos, _ in steps
                        ]
                    )
                    mine = [{"pos": pos, "h1": h1, "h2": h2, "ids": packed(ids[t])} for t, h1, h2, pos, own in steps if own]
                    published.append(mine or None)
                n = to - at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(at, n),
                        pa.array([done.get(k) for k in range(n)], out_type),
                        pa.array(parts, pa.list_(_CHUNK)),
                        pa.array(published, pa.list_(_CHUNK)),
                    ],
                    names=["row", "doc_id", "done", "parts", "published"],
                )
                row += n

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([compress(t.as_buffer()) for t in texts], pa.binary())],
                names=["_key", "_doc", "_zip"],
            )

    moved = docs.select("_key", "_doc", "_text").mapInArrow(zipped, "_key long, _doc long, _zip binary")
    staged = moved.join(roles, "_key", "left").select("_doc", "_zip", "_shared").mapInArrow(encode, stage_schema)
    staged = ws.write(staged, "encoded")
    finished = staged.where("done is not null").select("doc_id", "done.*")

    published = staged.select(F.explode("published").alias("p")).select("p.h1", "p.h2", F.col("p.ids").alias("got"))
    published = published.dropDuplicates(["h1", "h2"])
    open_parts = staged.where("done is null").select("row", "doc_id", F.explode("parts").alias("p"))
    open_parts = open_parts.select("row", "doc_id", "p.pos", "p.h1", "p.h2", "p.ids")
    own = open_parts.where("ids is not null").select("row", "doc_id", "pos", "ids")
    taken = open_parts.where("ids is null").join(published, ["h1", "h2"]).select("row", "doc_id", "pos", F.col("got").alias("ids"))
    gathered = (
        own.unionByName(taken)
        .groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
        .select("doc_id", "parts.ids")
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [[np.frombuffer(b, "<i4") for b in parts] for parts in part.column(1).to_pylist()]
                values = output.values(codec, codec.join(docs))
                columns = pa.array(values, out_type).flatten()
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *[f.name for f in out_type]])

    return finished.unionByName(gathered.mapInArrow(assemble, f"doc_id long, {fields}"))


def packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids, "<i4").tobytes()


def _struct(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(", ")))


def _arrow_struct(spark, fields: str) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return pa.struct(list(to_arrow_schema(_parse_datatype_string(fields))))
