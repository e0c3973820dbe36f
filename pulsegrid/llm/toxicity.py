"""A weighted lexicon of abuse, matched by Aho-Corasick in folded texts, less what stands in harmless phrases.

Folding undoes disguises: accents, look-alike letters of other alphabets, digits and signs that stand for letters. Terms and
harmless phrases go into one automaton. A text's hits weigh against its number of words; a logistic curve makes that a score.
The lexicon has a fixed part and a part learned from labelled texts: words and beginnings of words that toxic texts have and
others don't, beyond what chance would give among so many candidates.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.llm.common import slices, texts_of, with_text_columns
from pulsegrid.session import cut_lineage

# Words of abuse and their weights. A star stands for any ending.
LEXICON = {
    "arsehole*": 3, "asshole*": 3, "bastard*": 3, "bitch*": 3, "cunt*": 4, "dickhead*": 3, "fag": 4, "faggot*": 4, "fuck*": 3, "motherfuck*": 4,
    "nigger*": 4, "prick": 2, "retard*": 3, "shit*": 2, "slut*": 4, "twat*": 3, "wanker*": 3, "whore*": 4,
    "clown": 1, "clowns": 1, "degenerate*": 2, "disgusting*": 2, "dumb": 1, "dumbass*": 3, "filth": 2, "garbage": 1, "idiot*": 3, "imbecile*": 3,
    "loser*": 2, "moron*": 3, "pathetic*": 2, "scum*": 3, "scumbag*": 3, "stupid*": 2, "subhuman*": 4, "trash": 1, "ugly": 1, "vermin": 2,
    "worthless*": 2, "kill yourself": 4, "drop dead": 3, "go to hell": 2, "piece of shit": 4, "shut up": 1}
# Phrases in which such words are harmless. A star stands for any ending.
HARMLESS = [
    "trash can*", "trash bin*", "trash bag*", "trash collect*", "trash folder*", "empty trash", "empty the trash", "take out the trash",
    "garbage collect*", "garbage can*", "garbage truck*", "garbage disposal*", "garbage in garbage out", "clown fish*", "clown nose*", "clown shoe*",
    "circus clown*", "class clown*", "sore loser*", "winner and loser", "winners and losers", "winner or loser", "idiot proof*", "idiot s guide*",
    "complete idiot s guide*", "stupid question*", "keep it simple stupid", "deaf and dumb", "dumb terminal*", "dumb bell*", "flame retard*", "fire retard*",
    "retard the", "ugly duckling*", "the good the bad and the ugly", "degenerate case*", "degenerate matri*", "degenerate gas*", "prick test*", "not stupid",
    "no such thing as a stupid question"]
# Letters of other alphabets that look like Latin ones, then digits and signs that stand for letters. The letters i and l count
# as one, as 1 stands for both.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ь": "b", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ɡ": "g"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"

_TABLE = str.maketrans(LOOK_ALIKES | dict.fromkeys(INVISIBLE) | SIGNS | {"l": "i"})
_ASCII = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()} | {k: v for k, v in (SIGNS | {"l": "i"}).items() if k.isascii()})
_NUMBERS, _SIGNS, _BETWEEN = re.compile("[0-9]+"), re.compile("[!|@$€]+"), re.compile(r"[\W_]+")
#: Accents of Latin, Greek and Cyrillic letters after decomposition.
_ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")

#: Shortest learned term, labelled documents of a class to learn from, learned terms kept at most.
SHORTEST, PER_CLASS, MOST_TERMS, PENALTY = 4, 3000, 2000, 1e-3
#: Words in a shingle of the signature by which near copies teach once.
SHINGLE = 5


def _alone(found: re.Match) -> str:
    """A number without letters around it is no word."""
    text, begin, end = found.string, found.start(), found.end()
    beside = (begin and text[begin - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return found[0] if beside else " "


def _as_letter(found: re.Match) -> str:
    """Signs stand for letters where a word goes on behind them; ! and | also need a word in front."""
    text, begin, end = found.string, found.start(), found.end()
    behind, front = end < len(text) and text[end].isalnum(), begin and text[begin - 1].isalnum()
    return found[0] if behind and (front or found[0][0] not in "!|") else " "


def folded(text: str) -> str:
    """The text's words in folded letters, each between single spaces (of no words: one space)."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    text = _SIGNS.sub(_as_letter, _NUMBERS.sub(_alone, text))
    words = text.translate(_ASCII) if text.isascii() else _BETWEEN.sub(" ", text.translate(_TABLE))
    words = " ".join(words.split())
    return f" {words} " if words else " "


def pattern(term: str) -> str:
    """A term of the lists as a folded pattern: a space at its begin and, but for a star, at its end."""
    return folded(term.rstrip("*")).rstrip() + ("" if term.endswith("*") else " ")


def signature(text: str) -> int:
    """The least hash of a text's shingles: near copies nearly always have the same one."""
    words = folded(text).split()
    return min([zlib.crc32(" ".join(words[i:i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))])


@dataclass(frozen=True)
class Model:
    """Patterns with weights, harmless patterns, and the curve over (log of weight per hundred words, log of weight)."""

    terms: Mapping[str, float]
    harmless: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p in self.harmless:
            found.add_word(p, (p, 0.0))
        for p, w in self.terms.items():
            if p not in self.harmless:
                found.add_word(p, (p, w))
        if len(found):
            found.make_automaton()
        return found

    def measure(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
        """Total weight of the hits outside harmless phrases, and the number of words. Of terms that begin at one word the heaviest counts."""
        line = folded(text)
        words = line.count(" ") - 1
        if not len(automaton) or words < 1:
            return 0.0, max(0, words)
        weight: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (p, w) in automaton.iter(line):
            begin = end + 1 - len(p)
            if w:
                weight[begin] = max(w, weight.get(begin, 0.0))
            else:
                spared.append((begin, end))
        if weight and spared:
            at = np.array(sorted(weight))
            free = np.ones(len(at), bool)
            for begin, end in spared:
                free[np.searchsorted(at, begin):np.searchsorted(at, end)] = False
            return float(sum([weight[int(b)] for b in at[free]])), words
        return float(sum(weight.values())), words

    def scores(self, texts: list[str], automaton: ahocorasick.Automaton) -> np.ndarray:
        x = features([self.measure(t, automaton) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -500, 500)))


def features(measured: list[tuple[float, int]]) -> np.ndarray:
    m = np.array(measured, np.float64).reshape(-1, 2)
    return np.stack([np.log1p(100 * m[:, 0] / np.maximum(1, m[:, 1])), np.log1p(m[:, 0]), np.ones(len(m))], axis=1)


#: Without labels to learn from: three points of weight in a hundred words make toxic likely.
PLAIN_CURVE = (2.5, 0.5, -3.0)


def curve(measured: list[tuple[float, int]], toxic: list[int], totals: tuple[int, int]) -> tuple[float, float, float]:
    """The logistic curve by penalised Newton steps; classes weigh as they occur, slopes are never negative."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return PLAIN_CURVE
    x, drawn = features(measured), np.array([(y == 0).sum(), (y == 1).sum()])
    each = (np.array(totals) / drawn)[y.astype(int)]
    each /= each.sum()
    used = [0, 1, 2]
    while True:
        w, part = np.zeros(len(used)), x[:, used]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -500, 500)))
            ridge = PENALTY * np.array([0.0 if u == 2 else 1.0 for u in used]) + 1e-9
            step = np.linalg.solve((part * (p * (1 - p) * each)[:, None]).T @ part + np.diag(ridge), part.T @ ((p - y) * each) + ridge * w)
            w = w - np.clip(step, -2, 2)
        negative = [u for u, v in zip(used, w, strict=True) if u != 2 and v < 0]
        if not negative:
            full = dict(zip(used, w.tolist(), strict=True))
            return full.get(0, 0.0), full.get(1, 0.0), full[2]
        used.remove(negative[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("__print", pa.array([signature(t) for t in batch.column("__text").to_pylist()], pa.int64()))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and beginnings of words of each text, as patterns, with its mark."""
    for batch in batches:
        for part in slices(batch, "__text", 1 << 20):
            for text, mark in zip(texts_of(part, "__text").to_pylist(), part.column("__mark").to_pylist(), strict=True):
                words = {w for w in folded(text).split(" ") if len(w) >= SHORTEST}
                terms = [f" {w} " for w in words] + list({f" {w[:n]}" for w in words for n in range(SHORTEST, min(len(w), 24) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([mark] * len(terms), pa.int32())], names=["term", "mark"])


def distinct_terms(rows: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Of terms that contain each other, one: the longest that nearly as many toxic texts have, and none that a kept one covers.

    ``rows``: term, toxic and clean texts that have it, weight.
    """
    rows = sorted(rows)
    covered = set()
    for i, (term, toxic, *_) in enumerate(rows):
        for longer, n, *_ in rows[i + 1:]:
            if not longer.startswith(term):
                break
            if n >= 0.9 * toxic:
                covered.add(term)
                break
    kept: dict[str, float] = {}
    for term, _, _, weight in rows:
        if term not in covered and not any(term[:n] in kept for n in range(len(term))):
            kept[term] = weight
    return kept


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None,
          per_class: int = PER_CLASS, most_terms: int = MOST_TERMS, lexicon: Mapping[str, float] = LEXICON, harmless: list[str] = HARMLESS) -> Model:
    """The lexicon and its curve from a bounded sample: at most ``per_class`` labelled documents of a class, whole texts, those whose ids hash lowest.

    Two thirds of them teach terms, the rest the curve. A term is learned if the likelihood ratio of its counts in toxic and
    clean texts beats one error among all candidates; of those at most ``most_terms``, the surest first. Near copies of one mark teach once. Its weight is the smoothed
    log of the ratio; terms of the fixed lexicon keep theirs. ``usable`` picks the ids that may be learned from. Labels other than 0 and 1, null ids
    and null texts teach nothing; of contradicting labels of an id the lower counts, of several texts of an id the smallest.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & (F.lit(True) if usable is None else usable)).groupBy(id).agg(F.min(label).alias("__mark"))
    known = marks.join(docs.select(id).distinct(), id).withColumn("__h", F.xxhash64(F.col(id), F.lit("toxicity sample")))
    totals = dict.fromkeys((0, 1), 0) | {int(r[0]): r[1] for r in known.groupBy("__mark").count().collect()}
    fixed = {pattern(t): float(w) for t, w in lexicon.items()}
    spared = tuple(dict.fromkeys(map(pattern, harmless)))
    chosen = [(r[0], int(r[1])) for c in (0, 1) for r in
              known.where(F.col("__mark") == c).orderBy("__h", id).limit(per_class).select(id, "__mark").collect()]
    if not chosen:
        return Model(fixed, spared, PLAIN_CURVE)
    spark = docs.sparkSession
    sample = spark.createDataFrame([(i, m, n % 3 == 0) for n, (i, m) in enumerate(chosen)], T.StructType(
        [T.StructField("__id", docs.schema[id].dataType), T.StructField("__mark", T.IntegerType()), T.StructField("__held", T.BooleanType())]))
    # The sample has at most 2 * per_class rows, whatever the tables hold.
    drawn = (docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
             .join(F.broadcast(sample), "__id").groupBy("__id", "__mark", "__held").agg(F.min("__text").alias("__text")))
    print_of = T.StructType([*drawn.schema.fields, T.StructField("__print", T.LongType())])
    signed = drawn.mapInArrow(_signed, print_of)
    once = F.row_number().over(Window.partitionBy("__mark", "__print").orderBy("__id")) == 1
    texts = cut_lineage(signed.withColumn("__once", once).where("__once").drop("__once", "__print"), "toxicity-sample")
    taught = texts.where(~F.col("__held")).groupBy("__mark").count().collect()
    n = {int(r[0]): r[1] for r in taught}
    learned: dict[str, float] = {}
    if n.get(0) and n.get(1):
        counts = (texts.where(~F.col("__held")).select("__text", "__mark").mapInArrow(_candidates, "term string, mark int")
                  .groupBy("term").agg(F.sum("mark").alias("a"), F.sum(1 - F.col("mark")).alias("b")))
        seen, ratio, log_odds = F.col("a") + F.col("b"), F.lit(n[1] / (n[0] + n[1])), F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
        term = lambda x, share: F.when(x > 0, 2 * x * F.log(x / (seen * share))).otherwise(0.0)
        judged = counts.where("a >= 3").select("term", "a", "b", log_odds.alias("weight"), (term(F.col("a"), ratio) + term(F.col("b"), 1 - ratio)).alias("sure"))
        candidates = counts.where("a + b >= 3").count()
        rows = (judged.where((F.col("weight") >= 2) & (F.col("sure") > 2 * float(np.log(max(2, candidates)))))
                .orderBy(F.desc("sure"), "term").limit(most_terms).collect())
        learned = distinct_terms([(r["term"], r["a"], r["b"], r["weight"]) for r in rows])
    covered = lambda t: any(t[:k] in fixed for k in range(len(t) + 1)) or any(f.startswith(t) for f in fixed)
    terms = fixed | {t: w for t, w in learned.items() if not covered(t)}
    model = Model(terms, spared, PLAIN_CURVE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            got = [model.measure(t, automaton) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__mark"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                                             names=["mark", "weight", "words"])

    held = texts.where("__held").select("__mark", "__text").mapInArrow(measure, "mark int, weight double, words long").collect()
    held = sorted(map(tuple, held))
    return Model(terms, spared, curve([r[1:] for r in held], [r[0] for r in held], (totals[0], totals[1])))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: bool = True) -> DataFrame:
    """``docs`` plus how likely a whole text is toxic (0 to 1).

    No shuffle; rows are independent, so repeats score alike. Null texts, empty texts and texts without a word have the score of no hit.
    Other columns pass through; one named ``out`` is replaced. The model (fixed lists and at most ``most_terms`` terms) goes with the task.
    """
    def make():
        automaton = model.automaton()
        return lambda texts: [pa.array(model.scores(texts.to_pylist(), automaton), pa.float64())]

    return with_text_columns(docs, text, [T.StructField(out, T.DoubleType())], make, keep)
