"""Token ids as the ``tokenizers`` library gives them, with every distinct word encoded once per worker.

Both byte-level and word-level BPE files end a pre-token wherever a space follows a
character that is not white space.  A text is therefore cut there, pieces that the
worker has met before are looked up, the others go through the library, and the ids
of a text are the ids of its pieces in order.  Texts in which a space follows other
white space go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from driftfield.llm.words import text_blocks

#: Distinct pieces a worker remembers before it starts anew (bounds its memory, never the result).
CACHE_PIECES = 400_000
_TOGETHER = 128
#: Runs of words that go through the library at a time: its results take far more memory than the ids.
_RUNS = 128
_SPACED = re.compile(r"\s ")

_encoders: dict[str, PieceEncoder] = {}


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Pieces(dict):
    """Piece -> number; a new piece is numbered when it is first asked for."""

    def __init__(self):
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = self.size
        self.size += 1
        self.new.append(piece)
        return number


class PieceEncoder:
    """Ids of texts for one tokenizer file."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = load_tokenizer(path)
        self.cache_pieces = cache_pieces
        self.byte_level = self.tokenizer.decoder is not None and self.tokenizer.normalizer is None
        self.word_level = not self.byte_level and lowers_words(self.tokenizer)
        if self.byte_level or self.word_level:
            self.token_bytes = byte_lengths(self.tokenizer, WORD_END if self.word_level else "")
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.ids = np.zeros(1 << 18, np.int32)
        self.offset = np.zeros(1 << 16, np.int64)
        self.used = np.zeros(1 << 16, np.int32)

    def shrink(self) -> None:
        """Keep the pieces met most often, at most half as many as may be remembered."""
        used = self.used[: self.pieces.size]
        least = 2
        while np.count_nonzero(used >= least) > self.cache_pieces // 2:
            least *= 2
        kept = np.flatnonzero(used >= least)
        sizes = self.offset[kept + 1] - self.offset[kept]
        ids = self._gathered(kept)
        names = np.array(list(self.pieces), object)[kept].tolist()
        self.forget()
        for name in names:
            self.pieces[name]
        self.pieces.new = []
        self._store(0, ids, sizes)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) by the library."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for " " + word of each word; many words go through the library as one text."""
        if self.byte_level and words:
            runs = [" " + " ".join(words[a : a + _TOGETHER]) for a in range(0, len(words), _TOGETHER)]
            ids = np.concatenate([self._whole(runs[a : a + _RUNS])[0] for a in range(0, len(runs), _RUNS)])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
            reach = np.cumsum(self.token_bytes[ids])
            cut = np.searchsorted(reach, ends)
            if len(reach) and cut[-1] < len(reach) and np.array_equal(reach[cut], ends):
                return ids, np.diff(cut + 1, prepend=0)
        if self.word_level:
            return self._lowered(words)
        return self._whole([" " + w for w in words])

    def _lowered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_spaced`` for word-level files: words whose bytes are known beforehand go together, the others alone."""
        plain = np.fromiter(map(is_plain, words), bool, len(words))
        quick = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        runs = [quick[a : a + _TOGETHER] for a in range(0, len(quick), _TOGETHER)]
        ids, size = self._whole([" ".join(run) for run in runs])
        ends = np.cumsum(np.fromiter((len(w.lower().encode()) for w in quick), np.int64, len(quick)))
        reach = np.cumsum(self.token_bytes[ids])
        cut = np.searchsorted(reach, ends)
        if len(quick) and not (cut[-1] < len(reach) and np.array_equal(reach[cut], ends)):
            return self._whole([" " + w for w in words])
        first, first_sizes = ids, np.diff(cut + 1, prepend=0)
        more, more_sizes = self._whole([" " + w for w, p in zip(words, plain.tolist(), strict=True) if not p])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain], sizes[~plain] = first_sizes, more_sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        is_quick = np.repeat(plain, sizes)
        out[is_quick], out[~is_quick] = first, more
        return out, sizes

    def spaced_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of " " + word for words without spaces."""
        # a leading NUL would mean a piece at the start of a text
        named = [w if w[:1] != "\0" else None for w in words]
        at = np.fromiter((-1 if w is None else self.pieces[w] for w in named), np.int64, len(words))
        self._learn()
        known = at >= 0
        self.used[at[known]] += 1
        sizes = np.zeros(len(words), np.int64)
        sizes[known] = self.offset[at[known] + 1] - self.offset[at[known]]
        out = self._gathered(at[known])
        if not known.all():
            more, sizes[~known] = self._whole([" " + w for w, n in zip(words, named, strict=True) if n is None])
            is_known, met = np.repeat(known, sizes), out
            out = np.zeros(int(sizes.sum()), np.int32)
            out[is_known], out[~is_known] = met, more
        if self.pieces.size > self.cache_pieces:  # not left to the next call, which may be stages away
            self.shrink()
        return out, sizes

    def _store(self, first: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of the pieces numbered from ``first`` on."""
        start, last = int(self.offset[first]), first + len(sizes)
        while len(self.ids) < start + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while len(self.offset) <= last:
            self.offset = np.concatenate([self.offset, np.zeros(len(self.offset), np.int64)])
            self.used = np.concatenate([self.used, np.zeros(len(self.used), np.int32)])
        self.ids[start : start + len(ids)] = ids
        self.offset[first + 1 : last + 1] = start + np.cumsum(sizes)

    def _gathered(self, pieces: np.ndarray) -> np.ndarray:
        sizes = self.offset[pieces + 1] - self.offset[pieces]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[pieces] - (ends - sizes), sizes)]

    def _learn(self) -> None:
        """Encode the pieces met since the last call. A piece starts with its space, or with NUL where the text starts."""
        new = self.pieces.new
        if not new:
            return
        self.pieces.new = []
        first = self.pieces.size - len(new)
        odd = [k for k, w in enumerate(new) if not w or w[0] == "\0" or w[-1].isspace()]
        if odd:
            alone = np.zeros(len(new), bool)
            alone[odd] = True
            order = np.concatenate([np.flatnonzero(~alone), odd])
            ids, sizes = self._spaced([w for w, a in zip(new, alone.tolist(), strict=True) if not a])
            more, more_sizes = self._whole([new[k][1:] if new[k][:1] == "\0" else " " + new[k] for k in odd])
            ids, ordered = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
            start = (np.cumsum(ordered) - ordered)[np.argsort(order)]
            sizes = ordered[np.argsort(order)]
            ends = np.cumsum(sizes)
            ids = ids[np.arange(len(ids)) + np.repeat(start - (ends - sizes), sizes)]
        else:
            ids, sizes = self._spaced(new)
        self._store(first, ids, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if self.pieces.size > self.cache_pieces:
            self.shrink()
        numbers: list[int] = []
        count = np.zeros(len(texts), np.int64)
        number, whole = self.pieces.__getitem__, []
        for k, text in enumerate(texts):
            if not text:
                continue
            if "\0" in text or _SPACED.search(text):
                whole.append(k)
                continue
            head, *rest = text.split(" ")
            numbers.append(number("\0" + head))
            numbers.extend(map(number, rest))
            count[k] = 1 + len(rest)
        self._learn()
        at = np.fromiter(numbers, np.int64, len(numbers))
        if len(at):
            met = np.bincount(at)
            self.used[: len(met)] += met.astype(np.int32)
        ends = np.cumsum(self.offset[at + 1] - self.offset[at])
        ids = self._gathered(at)
        last = np.cumsum(count)
        reach = np.concatenate([[0], ends])
        lengths = reach[last] - reach[last - count]
        if whole:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            got, sizes = self._whole([texts[k] for k in whole])
            for k, part in zip(whole, np.split(got, np.cumsum(sizes)[:-1]), strict=True):
                parts[k] = part
                lengths[k] = len(part)
            ids = np.concatenate(parts)
        return ids, lengths


#: How word-level files mark a token that ends a word.
WORD_END = "</w>"
#: Visible ASCII, letters and digits.
_VISIBLE = re.compile(r"[!-~\w]+")
#: Letters whose lower case depends on their neighbours or has more bytes.
_ODD_CASE = re.compile("[ΣİẞȺȾ]")


def is_plain(word: str) -> bool:
    """Whether a word's normal form is its lower case: visible, composed characters without special tokens."""
    return (
        _VISIBLE.fullmatch(word) is not None
        and "<|" not in word
        and (word.isascii() or (is_normalized("NFC", word) and not _ODD_CASE.search(word)))
    )


def lowers_words(tokenizer) -> bool:
    """Whether a file lowers case, drops white space and marks ends of words."""

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    alone = [ids("ab"), ids("cd")]
    return ids(" Ab  CD ") == alone[0] + alone[1] and all(tokenizer.id_to_token(x[-1]).endswith(WORD_END) for x in alone)


def byte_lengths(tokenizer, word_end: str = "") -> np.ndarray:
    """Bytes each id stands for (a vocabulary character is a byte, a special token its text, an end mark nothing)."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    out = np.zeros(size, np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=True).items():
        out[k] = len(token) - (len(word_end) if word_end and token.endswith(word_end) else 0)
    for k, added in tokenizer.get_added_tokens_decoder().items():
        out[k] = len(added.content.encode())
    return out


def encoder_for(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].cache_pieces = cache_pieces
    return _encoders[path]


def encoded_blocks(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids per row) over bounded runs of rows; null is an empty text."""
    encoder = encoder_for(path)
    texts = texts.cast(pa.large_string())
    for at, to, _, _ in text_blocks(texts):
        yield at, to, *encoder.encode([t or "" for t in texts.slice(at, to - at).to_pylist()])


#: Rows of text in one Arrow batch: bounds what a worker and its JVM hold at a time.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
