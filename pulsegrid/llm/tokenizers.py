"""Public tokenizer files through their own libraries, each distinct word of a worker's texts encoded once."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pulsegrid.llm.chunks import ChunkEncoder, Encoded, flat_lists, shuffled

#: Words that go to the tokenizers library in one call.
TOGETHER = 4096
LAST_LATIN = "\u024f"
#: Fixed value: what the word vocabulary's pre-tokenizer takes as words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


class WordBpe:
    """A vocabulary of the tokenizers library with word ends that drops whitespace, so its words are independent.

    Chunks are normalised by the library together, cut into words here, and each distinct word is encoded once
    by the library's model; the last token of a word says that it is the last.
    """

    def __init__(self, path: str):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        spec = json.loads(self.model.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(self.model.get_vocab().values()) + 1, bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith(suffix) and token not in special
        # Words come normalised and cut, so what is left is bytes and merges.
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.plain = tokenizers.Tokenizer.from_str(json.dumps(spec | {
            "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, byte_level]}}))
        self.words = ChunkEncoder(self.encode_words, self.encode_words, share=0.5)
        self.chunks = ChunkEncoder(self.encode_chunks, self.encode_whole, special, self.spaced)

    @staticmethod
    def spaced(texts: pa.Array) -> pa.Array:
        """A-Z lower-cased, as the normaliser does, and a space where words end anyway: before a point or comma after a letter."""
        return pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,])", r"\1 \2")

    def encode_words(self, words: list[str]) -> Encoded:
        """Normalised words, many in one call."""
        flat = [np.array(self.plain.encode(" ".join(words[i:i + TOGETHER]), add_special_tokens=False).ids, np.int32)
                for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate(flat) if flat else np.empty(0, np.int32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def encode_chunks(self, chunks: list[str]) -> Encoded:
        normal = self.model.normalizer.normalize_str("".join([c if c[0] in " \n" else " " + c for c in chunks])).split(" ")[1:]
        # Beyond Latin letters, Unicode versions may disagree on what a letter is: the library cuts those.
        foreign = [i for i, c in enumerate(normal) if not c.isascii() and max(c) > LAST_LATIN]
        if foreign:
            rest = sorted(set(range(len(chunks))) - set(foreign))
            return shuffled(self.encode_normal([normal[i] for i in rest]), np.array(rest, np.int64),
                            self.encode_whole([chunks[i] for i in foreign]), np.array(foreign, np.int64))
        return self.encode_normal(normal)

    def encode_normal(self, normal: list[str]) -> Encoded:
        """Normalised chunks without the whitespace before them."""
        words, counts = [], np.ones(len(normal), np.int64)
        for i, c in enumerate(normal):
            if c.isalpha():
                words.append(c)
            else:
                found = [c[:-1], c[-1]] if c[-1:] in ",." and c[:-1].isalpha() else WORDS(c)
                words += found
                counts[i] = len(found)
        n, flat = self.words.gather(self.words.numbers(words))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)

    def encode_whole(self, texts: list[str]) -> Encoded:
        return flat_lists([e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)])


class PieceBpe:
    """A sentencepiece model whose pieces hold the space mark at their head only.

    Such a model never joins characters across a space that follows a word, and a word alone gets the mark
    that its space would be.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark = self.model.piece_to_id("▁")
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        free = all("▁" not in p.lstrip("▁") and "\n" not in p for p in pieces)
        self.chunks = ChunkEncoder(self.encode_chunks, self.encode_whole, ["▁"]) if free else None

    def encode_chunks(self, chunks: list[str]) -> Encoded:
        lists = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        # The mark that the library puts before a text belongs to no chunk that begins with a newline.
        return flat_lists([x[1:] if c[0] == "\n" else x for c, x in zip(chunks, lists, strict=True)])

    def encode_whole(self, texts: list[str]) -> Encoded:
        return flat_lists(self.model.encode(texts, num_threads=1))


class Whole:
    """Any other vocabulary of the tokenizers library: whole texts only."""

    def __init__(self, path: str):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.chunks = None

    def encode_whole(self, texts: list[str]) -> Encoded:
        return flat_lists([e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)])


@lru_cache(maxsize=4)
def load(path: str, words: bool = False):
    """The tokenizer of a file, one per worker process. ``words``: a .json vocabulary drops whitespace."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cluster's tasks are the parallelism
    return PieceBpe(path) if path.endswith(".model") else WordBpe(path) if words else Whole(path)


def version(path: str) -> str:
    """A digest of all that fixes the ids: the file and the library's release."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()
