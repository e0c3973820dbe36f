"""A compression classifier: how much better a text packs with a dictionary of good text than of bad.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text's size under
either, their difference over their sum and over the text's length, and the text's plain compressibility
go through a logistic curve fitted to labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.llm.common import with_text_columns

PER_CLASS, SLICE_CHARS, DICT_BYTES, LEVEL, PENALTY, BLOCK_BYTES = 1500, 8192, 1 << 16, 3, 1e-3, 4096


def remainder(id: str, of: int) -> Column:
    """CRC-32 of an id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % of


@dataclass(frozen=True)
class Model:
    """Dictionaries by class (bad, good; empty bytes: none) and the fitted curve."""

    dictionaries: tuple[bytes, bytes]
    raw: tuple[bool, bool]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> list:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        kind = {True: zstandard.DICT_TYPE_RAWCONTENT, False: zstandard.DICT_TYPE_AUTO}
        return [zstandard.ZstdCompressor(**options, **({"dict_data": zstandard.ZstdCompressionDict(d, dict_type=kind[r])} if d else {}))
                for d, r in zip(self.dictionaries, self.raw, strict=True)]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(texts: list[bytes], compressors: list) -> np.ndarray:
    """Per text: size difference over the sum of sizes, over the length, and log of the good size over the length.

    A text is packed in blocks and means over them are taken, so a long text has no edge over a short one from what
    the packer learns of it on the way.
    """
    bad, good = compressors
    blocks = [[t[i:i + BLOCK_BYTES] for i in range(0, len(t), BLOCK_BYTES)] or [t] for t in texts]
    size = lambda packer, parts: sum([len(packer.compress(p)) for p in parts]) / len(parts)
    x = np.array([(size(bad, ps), size(good, ps), sum(map(len, ps)) / len(ps)) for ps in blocks], np.float64).reshape(-1, 3)
    b, g, n = x[:, 0], x[:, 1], x[:, 2]
    return np.stack([(b - g) / np.maximum(1, b + g), (b - g) / np.maximum(1, n), np.log((g + 1) / (n + 1))], axis=1)


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary; too few samples to train one serve as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:], True


def fit(rows: list[tuple[bytes, int]], totals: tuple[int, int] | None = None) -> Model:
    """A model from labelled texts in any fixed order: of three, two feed the dictionaries, one the curve.

    ``totals`` says how many texts of each class there were to draw from; in the curve, classes weigh by it.

    Without texts of both classes in a part, or without any, the score is the share of good ones (or a half).
    """
    dicts = [_dictionary([t for i, (t, q) in enumerate(rows) if q == c and i % 3]) for c in (0, 1)]
    model = Model(tuple(d for d, _ in dicts), tuple(r for _, r in dicts), np.zeros(3), np.ones(3), np.zeros(4))
    held = [r for r in rows[::3]]
    y = np.array([q for _, q in held], np.float64)
    if not len(y) or y.min() == y.max():
        share = np.mean([q for _, q in rows]) if rows else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(model.dictionaries, model.raw, model.centre, model.scale, np.array([0, 0, 0, np.log(share / (1 - share))]))
    x = features([t for t, _ in held], model.compressors())
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    drawn = np.array([(y == 0).sum(), (y == 1).sum()])
    each = (np.array(totals or drawn) / drawn)[y.astype(int)]
    each /= each.sum()
    # Newton steps on the penalised likelihood.
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = z.T @ ((p - y) * each) + PENALTY * w
        w = w - np.linalg.solve((z * (p * (1 - p) * each)[:, None]).T @ z + PENALTY * np.eye(len(w)), grad)
    return Model(model.dictionaries, model.raw, centre, scale, w)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          usable: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit to a bounded sample: at most ``per_class`` labelled documents of a class, those whose ids hash
    lowest, a passage of at most ``SLICE_CHARS`` characters of each from a place that the id's hash names.

    ``usable`` picks the ids that may be learned from. Labels other than 0 and 1 and null texts are left out;
    of contradicting labels of an id the lower counts.
    """
    marks = labels.where(F.col(label).isin(0, 1) & (F.lit(True) if usable is None else usable)).groupBy(id).agg(F.min(label).alias("__mark"))
    known = marks.join(docs.select(id).distinct(), id).withColumn("__h", F.xxhash64(F.col(id), F.lit("sample")))
    totals = dict.fromkeys((0, 1), 0) | {int(r[0]): r[1] for r in known.groupBy("__mark").count().collect()}
    chosen = {r[0]: r[1] for c in (0, 1) for r in
              known.where(F.col("__mark") == c).orderBy("__h", id).limit(per_class).select(id, "__mark").collect()}
    n = F.length(text)
    begin = F.pmod(F.xxhash64(F.col(id), F.lit("place")), F.greatest(F.lit(1), n - SLICE_CHARS + 1)) + 1
    passages = (docs.where(F.col(id).isin(list(chosen)) & F.col(text).isNotNull())
                .select(id, F.substr(F.col(text), begin.cast("int"), F.lit(SLICE_CHARS)).alias("passage"))
                .groupBy(id).agg(F.min("passage").alias("passage")).collect()) if chosen else []
    return fit([(p.encode(), chosen[i]) for i, p in sorted(map(tuple, passages))], (totals[0], totals[1]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: bool = True) -> DataFrame:
    """``docs`` plus the probability (0 to 1) that a whole text is good.

    No shuffle; rows are independent, so repeats score alike. Null and empty texts have the score of the
    empty text. Other columns pass through. The model (at most two dictionaries of ``DICT_BYTES``) goes with the task.
    """
    def make():
        packers = model.compressors()
        return lambda texts: [pa.array(model.score(features(texts.cast(pa.binary()).to_pylist(), packers)))]

    return with_text_columns(docs, text, [T.StructField(out, T.DoubleType())], make, keep)
