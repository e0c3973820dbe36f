"""Byte-pair encoding and decoding by a prefix-sharing trie of distinct words.

A BPE result is fixed by its last token: if ``t`` ends the encoding of a prefix of length ``n``, the rest
is the encoding of the prefix of length ``n - len(t)``. So one token per trie node says everything. Distinct
words are laid out as a trie in depth-first order (sorted, each entered below the prefix it shares with the
one before), the last token of each node is found from those of its ancestors, and a shared prefix is
worked out once.

A token ``t`` may follow a token ``s`` exactly if merging the bytes of both by the merge list gives ``s, t``
back. While ``s`` is being built its last symbol goes through a chain of tokens, and so does the first of
``t``; the two stay apart if no merge of a pair of them comes up before either is merged away on its own side.
For a merge list in which a merge comes after those that make its parts, exactly one suffix token of a
prefix fits (all pairs that neighbour each other are then stable, and only the BPE result is so).
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from pulsegrid.llm.chunks import ChunkEncoder, Encoded, flat_lists, list_column
from pulsegrid.llm.common import text_pass, without

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Known neighbours that a worker keeps; beyond it starts anew, which changes no result.
FIT_ENTRIES = 500_000
NEVER = 1 << 60
#: Rows that are decoded together.
DECODED = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the
    next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file with the same ids as the tokenizers library gives."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs.setdefault((x, y), rank)
            self.parts.setdefault(z, (x, y, rank))
        self.longest = max(map(len, self.ids))
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split = regex.compile(PATTERN).findall
        special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.specials = regex.compile(f"({special})") if special else None
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list] = {}
        self.alone: dict[int, bool] = {}
        self.chunks = ChunkEncoder(self.encode_strings, self.encode_whole, list(self.special))

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one end of a token while it is built, with the rank of the merge that
        takes each away; ``side`` 0 is the first symbol, 1 the last."""
        if (token, side) not in self.spines:
            found, gone, t = [], NEVER, token
            while True:
                found.append((t, gone))
                if t not in self.parts:
                    break
                gone, t = self.parts[t][2], self.parts[t][side]
            self.spines[token, side] = found
        return self.spines[token, side]

    def follows(self, s: int, t: int) -> bool:
        """Whether ``s, t`` are stable side by side. Equal ranks go to the left one first."""
        key = s * self.size + t
        if (known := self.fits.get(key)) is None:
            known = True
            for a, a_gone in self.spine(s, 1):
                for b, b_gone in self.spine(t, 0):
                    rank = self.pairs.get((a, b))
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        known = False
            if len(self.fits) > FIT_ENTRIES:
                self.fits.clear()  # in place: a running traversal goes on with it
            self.fits[key] = known
        return known

    def stands(self, token: int) -> bool:
        """Whether the bytes of a token encode to it alone."""
        if token not in self.alone:
            if token in self.parts:
                a, b, rank = self.parts[token]
                # Just before its last merge the two halves must be what stands there.
                pair_ok = all((r := self.pairs.get((x, y))) is None or (x, y) == (a, b) or not (r < min(gx, rank) and r <= min(gy, rank))
                              for x, gx in self.spine(a, 1) for y, gy in self.spine(b, 0))
                self.alone[token] = pair_ok and self.stands(a) and self.stands(b)
            else:
                self.alone[token] = len(self.bytes[token]) == 1
        return self.alone[token]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of distinct words, depth first through their trie."""
        ids, fits, follows, longest, size, out = self.ids.get, self.fits.get, self.follows, self.longest, self.size, {}
        path, last, width, shared = b"", [0], [0], 0  # the token that ends each prefix of the path, and its length
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], width[shared + 1:]
            for depth in range(shared + 1, n + 1):
                # One suffix fits, so the order is free: first those that begin no sooner than the last one did.
                near, low = depth - 1 - width[-1], depth - longest if depth > longest else 0
                begin = near if near > low else low
                while True:
                    token = ids(word[begin:depth])
                    if token is not None:
                        if begin:
                            known = fits(last[begin] * size + token)
                            if follows(last[begin], token) if known is None else known:
                                break
                        elif self.stands(token):
                            break
                    begin += 1
                    if begin == depth:
                        begin = low
                last.append(token)
                width.append(depth - begin)
            path, at, found = word, n, []
            while at:
                found.append(last[at])
                at -= width[at]
            found.reverse()
            out[word] = found
        return out

    def encode_strings(self, texts: list[str]) -> Encoded:
        """Flat ids and lengths of strings without special ones."""
        pieces = []
        for t in texts:
            # A word with at most a space before it is one piece, also with one point or comma after it.
            body, mark = (t[:-1], t[-1:]) if t[-1:] in ",." else (t, "")
            if (body[1:] if body[:1] == " " else body).isalpha():
                pieces.append([body.encode(), mark.encode()] if mark else [body.encode()])
            else:
                pieces.append([p.encode() for p in self.split(t)])
        known = self.encode_words({p for ps in pieces for p in ps})
        return flat_lists([known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in pieces])

    def encode_whole(self, texts: list[str]) -> Encoded:
        """Flat ids and lengths of any strings; special strings become their own ids, as in the library."""
        if self.specials is None:
            return self.encode_strings(texts)
        parts = [self.specials.split(t) for t in texts]  # plain, special, plain, ...
        flat, n = self.encode_strings([p for ps in parts for p in ps[::2]])
        ends = np.cumsum(n)
        ids, at = [], 0
        for ps in parts:
            own = []
            for i, p in enumerate(ps):
                if i % 2:
                    own.append(self.special[p])
                else:
                    own += flat[ends[at] - n[at]:ends[at]].tolist()
                    at += 1
            ids.append(own)
        return flat_lists(ids)

    def decode_arrays(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id sequences that stand one after another and end at ``ends``; bytes that are no
        UTF-8 become replacement characters."""
        n = self.lengths[ids]
        stop = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(stop[-1]) + np.repeat(self.starts[ids] - stop[:-1], n)
        raw, bounds = self.flat[take].tobytes(), stop[np.concatenate([[0], ends])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    """One instance per worker process."""
    return ByteBpe(path)


def _encoding(docs: DataFrame, path: str, text: str, out: str, keep: bool):
    def make():
        bpe = vocabulary(path)
        return lambda texts: [list_column(*bpe.chunks.encode(texts))]

    return text_pass(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType(), False))], make, keep)


def _decoding(schema: T.StructType, path: str, ids: str, out: str):
    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(i, DECODED) for i in range(0, batch.num_rows, DECODED)):
                lists = part.column(ids)
                n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                if flat.null_count:
                    raise ValueError(f"{ids} holds a null id")
                texts = bpe.decode_arrays(flat.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return run, T.StructType([*schema.fields, T.StructField(out, T.StringType())])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """Each whole text as token ids: the rows of ``docs`` plus ``out``, an array of int.

    Null and empty texts give an empty array; nothing is cut, prefixed or padded. Rows are independent:
    repeated rows repeat their result, an empty table gives an empty one, other columns pass through
    (``keep=False`` drops the text), a column named ``out`` is replaced. No shuffle.
    """
    return docs.mapInArrow(*_encoding(docs, path, text, out, keep))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows plus the text of their ids. A null array decodes to the empty text; null or unknown ids
    are an error, as they have no text. A column named ``out`` is replaced."""
    rows = without(rows, [out], [ids])
    return rows.mapInArrow(*_decoding(rows.schema, path, ids, out))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: bool = True) -> DataFrame:
    """``encode`` and ``decode`` one after the other in one pass, so a task needs one Python worker."""
    docs = without(docs, [ids, out], [text])
    forth, schema = _encoding(docs, path, text, ids, keep)
    back, schema = _decoding(schema, path, ids, out)
    return docs.mapInArrow(lambda batches: back(forth(batches)), schema)
