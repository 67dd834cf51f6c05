"""Scoring of texts by a causal self-attention model next to a word-count base.

A text is its words in lower case (A-Z only), joined by single spaces, then an end token.

1. Texts are turned into blocks of at most ``BLOCK_BYTES``: the distinct words of a block,
   their subword ids, their counts in training documents, and the texts as word numbers.
2. Words of all blocks meet their total count in one shuffle by word; a word has one row per
   block, however often it occurs.  Subword counts of all training documents give the classes.
3. The model is trained where the blocks are: a task takes steps on the windows of every training
   document in its blocks, starting from the same model; the results are averaged (in groups first)
   and the next round starts from the average.  Windows are dealt over the rounds by their hash, so
   each of them enters one step of one round.
4. Blocks are joined with their words' totals and scored: sums of log counts for the base, and
   batches of overlapping windows for the model.

Texts whose ``held_out`` is true take no part in counts, classes or steps; neither do texts
without an id, which count as held out.  Null and empty texts are the end token alone.
Repeated rows are documents of their own. Without training documents the base and the model
are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm import attention
from driftfield.llm.encode import encoder_for, small_batches
from driftfield.llm.words import mix, word_blocks
from driftfield.workspace import Workspace

BLOCK_BYTES = 12 << 20
#: Words whose ids a worker remembers from block to block.
REMEMBERED = 150_000
#: Words of the documents that are looked at together.
RUN_WORDS = 100_000
ROUNDS = 2
#: One in so many windows of the training documents takes part, in one of the rounds.
WINDOW_SHARE = 1
#: Windows one task learns from in a round; more of them need more tasks.
TASK_WINDOWS = 12_000
#: Windows a task holds and shuffles before it takes steps on them.
HELD_WINDOWS = 1 << 15

_BLOCK = (
    "block long, docs array<long>, held array<boolean>, counts binary, numbers binary, word_ids binary, "
    "words array<binary>, train array<long>, id array<int>, id_train array<long>"
)


def _zip(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def blocks(documents: DataFrame, held_out: Column, tokenizer: str, doc: str, text: str) -> DataFrame:
    rows = documents.select(
        F.col(doc).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held"),
    )

    def block(number: int, parts: list[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]) -> pa.RecordBatch:
        encoder = encoder_for(tokenizer, REMEMBERED)
        words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        count = np.concatenate([p[1] for p in parts])
        docs, held = pa.concat_arrays([p[2] for p in parts]), pa.concat_arrays([p[3] for p in parts])
        number_of = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        learnt = np.repeat(~held.to_numpy(zero_copy_only=False), count)
        train = np.bincount(number_of[learnt], minlength=len(words.dictionary))
        ids, size = encoder.spaced_words([w.decode() for w in words.dictionary.to_pylist()])
        weight = np.bincount(ids, np.repeat(train, size)).astype(np.int64)
        some = np.flatnonzero(weight)
        columns = {
            "block": [number],
            "docs": [docs],
            "held": [held],
            "counts": [_zip(count.astype("<i4"))],
            "numbers": [_zip(number_of.astype("<i4"))],
            "word_ids": [_zip(np.concatenate([size, ids]).astype("<i4"))],
            "words": [words.dictionary],
            "train": [pa.array(train)],
            "id": [pa.array(some, pa.int32())],
            "id_train": [pa.array(weight[some])],
        }
        kinds = {"block": pa.int64(), "docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "words": pa.list_(pa.binary())}
        kinds |= {"train": pa.list_(pa.int64()), "id": pa.list_(pa.int32()), "id_train": pa.list_(pa.int64())}
        arrays = []
        for name, value in columns.items():
            kind = kinds.get(name, pa.binary())
            if isinstance(kind, pa.ListType):
                inner = value[0].cast(kind.value_type)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
            else:
                arrays.append(pa.array(value, kind))
        return pa.RecordBatch.from_arrays(arrays, names=list(columns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held_bytes = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at, to, words in word_blocks(batch.column(1)):
                strings = words.strings()
                parts.append((strings, np.diff(words.first), batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at)))
                held_bytes += len(words.data)
                if held_bytes >= BLOCK_BYTES:
                    yield block(number, parts)
                    number, parts, held_bytes = number + 1, [], 0
        if parts:
            yield block(number, parts)

    return rows.mapInArrow(build, _BLOCK)


def _texts(counts: np.ndarray, numbers: np.ndarray, word_ids: np.ndarray, words: int, end: int, some: np.ndarray):
    """(ids, lengths) of the chosen documents, the end id included."""
    size, ids = word_ids[:words].astype(np.int64), word_ids[words:]
    start = np.cumsum(size) - size
    chosen = numbers[np.repeat(some, counts)]
    n = size[chosen]
    ends = np.cumsum(n)
    flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[chosen] - (ends - n), n)]
    last = np.cumsum(counts[some])
    reach = np.concatenate([[0], ends])
    lengths = reach[last] - reach[last - counts[some]]
    return np.insert(flat, np.cumsum(lengths), end), lengths + 1


def _runs(counts: np.ndarray, most: int = RUN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first, end document, first, end word) of runs of at most ``most`` words, or of one document."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        start = int(ends[at] - counts[at])
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield at, to, start, int(ends[to - 1])
        at = to


def _averaged(models: DataFrame) -> np.ndarray | None:
    """Mean of the models of all tasks by their steps: in groups of tasks, then over the groups."""

    def average(table: pa.Table) -> pa.Table:
        steps = table["steps"].to_numpy().astype(np.float64)
        total = sum(s * np.frombuffer(m.as_py(), "<f4").astype(np.float64) for s, m in zip(steps, table["model"]))
        mean = (total / max(steps.sum(), 1)).astype("<f4").tobytes()
        return pa.table({"task": pa.array([0], pa.int32()), "steps": pa.array([int(steps.sum())], pa.int64()), "model": pa.array([mean], pa.binary())})

    schema = "task int, steps long, model binary"
    once = models.withColumn("task", F.floor(F.col("task") / 64).cast("int")).groupBy("task").applyInArrow(average, schema)
    rows = once.groupBy((F.col("task") % 1).alias("all")).applyInArrow(average, schema).collect()
    return np.frombuffer(bytes(rows[0].model), "<f4") if rows and rows[0].steps else None


def trained(
    stage: DataFrame, classes: attention.Classes, end: int, subwords: int, rounds: int = ROUNDS, share: int = WINDOW_SHARE
) -> dict[str, np.ndarray]:
    """The model after all rounds; ``subwords`` tells how many training documents have."""
    spark = stage.sparkSession
    tasks = max(1, round(subwords / attention.STRIDE / share / rounds / TASK_WINDOWS))
    model = attention.fresh(classes)
    for turn in range(rounds):
        given = spark.sparkContext.broadcast((attention.packed(model), classes))

        def learn(batches: Iterator[pa.RecordBatch], given=given, turn=turn) -> Iterator[pa.RecordBatch]:
            flat, classes = given.value
            trainer = attention.Trainer(attention.unpacked(flat, attention.fresh(classes)), attention.RATE / (1 + 2 * turn))

            def take_steps(kept: list) -> None:
                draw, x, y, asked = (np.concatenate(z) for z in zip(*kept, strict=True))
                order = np.argsort(mix(draw), kind="stable")
                for k in range(0, len(order), attention.STEP_WINDOWS):
                    part = order[k : k + attention.STEP_WINDOWS]
                    trainer.step(x[part], classes.of[y[part]], asked[part])

            for batch in batches:
                for row in batch.to_pylist():
                    held = np.asarray(row["held"], bool)
                    counts, numbers = _unzip(row["counts"], "<i4"), _unzip(row["numbers"], "<i4")
                    word_ids, kept, count = _unzip(row["word_ids"], "<i4"), [], 0
                    for a, b, first, last in _runs(counts):
                        ids, lengths = _texts(counts[a:b], numbers[first:last], word_ids, row["words"], end, ~held[a:b])
                        doc, start = attention.window_starts(lengths)
                        place = ((doc + a).astype(np.uint64) << np.uint64(24)) + (start // attention.STRIDE).astype(np.uint64)
                        draw = mix(place + np.uint64(row["block"]))
                        chosen = np.flatnonzero(draw % np.uint64(share * rounds) == turn)
                        for k in range(0, len(chosen), HELD_WINDOWS):
                            some = chosen[k : k + HELD_WINDOWS]
                            kept.append((draw[some], *attention.windows(ids, lengths, classes, doc[some], start[some])))
                            count += len(some)
                            if count >= HELD_WINDOWS:
                                take_steps(kept)
                                kept, count = [], 0
                    if kept:
                        take_steps(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int32()),
                    pa.array([trainer.steps], pa.int64()),
                    pa.array([attention.packed(trainer.model).tobytes()], pa.binary()),
                ],
                names=["task", "steps", "model"],
            )

        columns = ["block", "held", "counts", "numbers", "word_ids", F.size("words").alias("words")]
        got = _averaged(stage.select(*columns).coalesce(tasks).mapInArrow(learn, "task int, steps long, model binary"))
        if got is not None:
            model = attention.unpacked(got, model)
    return model


def score_texts(
    documents: DataFrame,
    ws: Workspace,
    tokenizer: str,
    held_out: Column,
    end_id: int,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords) of every document."""
    spark = documents.sparkSession
    small_batches(spark)
    stage = ws.write(blocks(documents, held_out, tokenizer, doc, text), "blocks")
    here = stage.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("pos", "w"))
    here = here.select("block", "pos", F.col("w.words").alias("word"), F.col("w.train").alias("n"))
    same = Window.partitionBy("word")
    totals = ws.write(
        here.select(
            "block", "pos", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block")) == 1).alias("first")
        ),
        "totals",
    )
    texts = stage.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    found = totals.where("first and c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (found.n or 0) + texts, found.v + (texts > 0)
    counts = np.zeros(encoder_for(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    pieces = stage.select(F.explode(F.arrays_zip("id", "id_train")).alias("p")).groupBy("p.id").agg(F.sum("p.id_train").alias("n"))
    for r in pieces.collect():  # at most one row per subword id
        counts[r.id] = r.n
    counts[end_id] += texts
    classes = attention.Classes.from_counts(counts)
    model = trained(stage, classes, end_id, int(counts.sum()))
    given = spark.sparkContext.broadcast((attention.packed(model), classes))
    norm = np.log10(float(tokens + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, classes = given.value
        model = attention.unpacked(flat, attention.fresh(classes))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}
                docs, held = row["docs"].values, row["held"].values
                count, numbers = _unzip(row["counts"].as_py(), "<i4"), _unzip(row["numbers"].as_py(), "<i4")
                known = row["known"].values if row["known"].is_valid else None
                c = np.zeros(row["words"].as_py(), np.int64)
                if known is not None:
                    c[known.field("pos").to_numpy()] = known.field("c").to_numpy()
                owner = np.repeat(np.arange(len(count)), count)
                base = np.bincount(owner, np.log10(c + 1.0)[numbers], len(count)) + np.log10(texts + 1.0) - (count + 1) * norm
                seen = np.bincount(owner, (c > 0)[numbers], len(count)).astype(np.int64) + (texts > 0)
                word_ids, values, sizes = _unzip(row["word_ids"].as_py(), "<i4"), [np.zeros(0)], [np.zeros(0, np.int64)]
                for a, b, first, last in _runs(count):
                    ids, lengths = _texts(count[a:b], numbers[first:last], word_ids, len(c), end_id, np.ones(b - a, bool))
                    values.append(attention.score(model, classes, ids, lengths))
                    sizes.append(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs,
                        held,
                        pa.array(count.astype(np.int64) + 1),
                        pa.array(seen),
                        pa.array(np.full(len(count), tokens, np.int64)),
                        pa.array(base),
                        pa.array(np.concatenate(values)),
                        pa.array(np.concatenate(sizes)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"],
                )

    known = totals.groupBy("block").agg(F.collect_list(F.struct("pos", "c")).alias("known"))  # a block's words
    columns = ["block", "docs", "held", "counts", "numbers", "word_ids", F.size("words").alias("words")]
    return stage.select(*columns).join(known, "block", "left").mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long",
    )
