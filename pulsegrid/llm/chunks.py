"""Token ids of many texts with each distinct word encoded once.

Where a tokenizer never forms a token across the start of a whitespace run, a text whose words stand apart by
single spaces or newlines is the sequence of its *chunks*: a word with the one space or newline before it.
Arrow splits the texts and numbers the distinct chunks, only new ones are encoded, and the ids of a text are
gathered by number. All other texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker keeps between batches; beyond it starts anew, which changes no result.
CACHE_ENTRIES = 500_000
#: Texts that aren't plain: two whitespace characters in a row, one at either end, or another than space and newline.
ODD = (r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
       r"|[ \n][ \n]|^[ \n]|[ \n]$|^$")

Encoded = tuple[np.ndarray, np.ndarray]  # ids of several strings one after another, and how many each has


class ChunkEncoder:
    """``chunks`` encodes distinct chunks, ``whole`` any texts; both return flat ids and lengths.

    ``never`` are strings (special tokens, in any case) whose texts always go to ``whole``. ``prepare`` may bring plain
    texts to a form with fewer distinct chunks and the same ids. ``share`` is of ``CACHE_ENTRIES``.
    """

    def __init__(self, chunks: Callable[[list[str]], Encoded], whole: Callable[[list[str]], Encoded],
                 never: Sequence[str] = (), prepare: Callable[[pa.Array], pa.Array] | None = None,
                 share: float = 1.0):
        self.chunks, self.whole, self.never, self.prepare, self.share = chunks, whole, list(never), prepare, share
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def numbers(self, keys: list[str]) -> np.ndarray:
        """Places of chunks in the store; new ones are encoded."""
        found = list(map(self.index.get, keys))
        new = [k for k, i in zip(keys, found, strict=True) if i is None]
        if new:
            new = list(dict.fromkeys(new))
            if self.index and len(self.index) + len(new) > self.share * CACHE_ENTRIES:
                self.forget()
                return self.numbers(keys)
            flat, lengths = self.chunks(new)
            n, at = len(self.index), self.used
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while n + len(new) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.flat[at:at + len(flat)] = flat
            self.lengths[n:n + len(new)] = lengths
            self.starts[n:n + len(new)] = at + np.cumsum(lengths) - lengths
            self.used += len(flat)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            found = list(map(self.index.get, keys))
        return np.array(found, np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For plain texts: store numbers of all chunks, and where each text's chunks end."""
        texts = self.prepare(texts) if self.prepare else texts
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], parts.flatten()
        coded = words.dictionary_encode()
        distinct = [w if w[:1] == "\n" else " " + w for w in coded.dictionary.to_pylist()]
        first = words.take(pa.array(offsets[:-1])).to_pylist()
        n = len(distinct)
        places = self.numbers(distinct + first)
        numbers = places[:n][coded.indices.to_numpy()]
        numbers[offsets[:-1]] = places[n:]
        return numbers, offsets[1:]

    def _sorted_out(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.never:
            odd = pc.or_(odd, pc.match_substring(texts, s, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False)
        return np.flatnonzero(~odd), np.flatnonzero(odd)

    def encode(self, texts: pa.Array) -> Encoded:
        """Flat ids and the number of ids of each text. Texts must not be null."""
        plain, odd = self._sorted_out(texts)
        if not len(plain):
            return self.whole(texts.to_pylist()) if len(odd) else (np.empty(0, np.int32), np.zeros(0, np.int64))
        numbers, ends = self._plain(texts.take(pa.array(plain)) if len(odd) else texts)
        n, flat = self.gather(numbers)
        n = np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)
        return shuffled((flat, n), plain, self.whole(texts.take(pa.array(odd)).to_pylist()), odd) if len(odd) else (flat, n)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        plain, odd = self._sorted_out(texts)
        lengths = np.zeros(len(texts), np.int64)
        if len(plain):
            numbers, ends = self._plain(texts.take(pa.array(plain)) if len(odd) else texts)
            lengths[plain] = np.diff(np.concatenate([[0], np.cumsum(self.lengths[numbers])])[ends], prepend=0)
        if len(odd):
            lengths[odd] = self.whole(texts.take(pa.array(odd)).to_pylist())[1]
        return lengths

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, self.flat[np.arange(total) + np.repeat(self.starts[numbers] - (ends - n), n)]


def shuffled(a: Encoded, at_a: np.ndarray, b: Encoded, at_b: np.ndarray) -> Encoded:
    """The strings of ``a`` and ``b`` in one sequence, at the places given."""
    lengths, begins = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.int64)
    lengths[at_a], lengths[at_b] = a[1], b[1]
    begins[at_a], begins[at_b] = np.cumsum(a[1]) - a[1], len(a[0]) + np.cumsum(b[1]) - b[1]
    both = np.concatenate([a[0], b[0]]).astype(np.int32)
    return both[np.arange(len(both)) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)], lengths


def list_column(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Flat ids and lengths as an Arrow list column."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(flat, np.int32)))


def flat_lists(lists: Sequence[Sequence[int]]) -> Encoded:
    """Python lists of ids as flat ids and lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(lengths.sum())
    return np.fromiter((i for x in lists for i in x), np.int32, total), lengths
