"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of one length that overlap by the widest filter less one byte, so
each n-gram of the text lies in a window. Bytes are embedded, filters of several widths slide over a window,
each filter's greatest answer feeds a softmax. A text's languages are weighed by the mean log-probability of all
its windows. Training (numpy, Adam) is on a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.llm.common import with_text_columns

WINDOW, DIM, FILTERS = 256, 8, {2: 8, 3: 12, 4: 12}
WIDEST = max(FILTERS)
STRIDE = WINDOW - WIDEST + 1
PER_CLASS, SLICE_CHARS, EPOCHS, BATCH, RATE = 400, 1000, 12, 64, 0.01
#: Windows that go through the network at a time: about 2 MB of work arrays, so they stay in the processor's cache.
TOGETHER = 64
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x DIM; byte 0 pads
    filters: np.ndarray  # WIDEST * DIM x filters, zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded n-grams of windows: windows x places x (WIDEST * DIM)."""
        x = self.embedding[windows]
        return np.concatenate([x[:, k:k + STRIDE] for k in range(WIDEST)], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        answers = self.columns(windows).reshape(-1, WIDEST * DIM) @ self.filters
        return np.maximum(answers.reshape(len(windows), STRIDE, -1).max(axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i:i + TOGETHER]) @ self.dense + self.offset for i in range(0, len(windows), TOGETHER)]
        z = np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)
        z = z.astype(np.float64) - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, and each text's number of windows (none for an empty text)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    begin = np.repeat(np.cumsum(n) - n, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    end = np.repeat(np.cumsum(n), count)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[begin]
    windows[np.arange(WINDOW) >= (end - begin)[:, None]] = 0
    return windows, count


def fit(rows: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """A network from labelled passages; the same rows give the same network."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    width = np.repeat(list(FILTERS), list(FILTERS.values()))
    live = (np.arange(WIDEST * DIM)[:, None] < width * DIM).astype(np.float32)
    f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Network(languages, f(256, DIM, s=0.5), f(WIDEST * DIM, len(width), s=0.2) * live, np.zeros(len(width), np.float32),
                  f(len(width), max(1, len(languages)), s=0.1), np.zeros(max(1, len(languages)), np.float32))
    if len(languages) < 2:
        return net
    windows, count = windows_of([t for t, _ in rows])
    y = np.repeat([languages.index(lang) for _, lang in rows], count)
    # Every language weighs the same, whatever its share.
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    names = ["embedding", "filters", "bias", "dense", "offset"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at:at + BATCH]
            grads = _gradients(net, windows[pick], y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                g = g * live if k == "filters" else g
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                change = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    cols = net.columns(windows)
    answers = cols @ net.filters
    best = answers.argmax(axis=1)
    top = np.take_along_axis(answers, best[:, None], axis=1)[:, 0] + net.bias
    h = np.maximum(top, 0)
    z = h @ net.dense + net.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    dz = p * weight[:, None] / len(y)
    dh = (dz @ net.dense.T) * (top > 0)
    # Only the place of each filter's greatest answer passes a gradient on.
    chosen = np.take_along_axis(cols, best[:, :, None], axis=1)
    demb = np.zeros_like(net.embedding)
    spread = (dh[:, :, None] * net.filters.T[None]).reshape(*dh.shape, WIDEST, DIM)
    at = best[:, :, None] + np.arange(WIDEST)
    np.add.at(demb, windows[np.arange(len(y))[:, None, None], at], spread)
    return {"embedding": demb, "filters": np.einsum("bf,bfk->kf", dh, chosen), "bias": dh.sum(axis=0), "dense": h.T @ dz, "offset": dz.sum(axis=0)}


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None,
          per_class: int = PER_CLASS) -> Network:
    """Fit to a bounded sample: about ``per_class`` documents of each language whose id hash falls below a
    limit (cut to ``per_class`` exactly), one passage of at most ``SLICE_CHARS`` characters of each.

    ``usable`` picks the rows that may be learned from; null languages, null ids and texts without a letter teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & (F.lit(True) if usable is None else usable))
    shares = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row a language
    if not shares:
        return fit([])
    wide = 1 << 30
    limit = F.create_map(*[F.lit(x) for k, n in shares.items() for x in (k, min(wide, int(1.3 * per_class * wide / n) + 1))])
    place = F.pmod(F.xxhash64(F.col(id), F.lit("language sample")), F.lit(wide))
    begin = F.pmod(F.xxhash64(F.col(id), F.lit("place")), F.greatest(F.lit(1), F.length(text) - SLICE_CHARS + 1)) + 1
    rows = (known.where(place < limit[F.col(lang)]).where(F.col(text).rlike(r"\p{L}"))
            .select(lang, place, id, F.substr(F.col(text), begin.cast("int"), F.lit(SLICE_CHARS))).collect())
    taken, by = [], {}
    for name, _, _, passage in sorted(map(tuple, rows)):
        by[name] = by.get(name, 0) + 1
        if by[name] <= per_class:
            taken.append((passage.encode(), name))
    return fit(taken)


def predict(docs: DataFrame, net: Network, text: str = "text", out: str = "lang_pred", score: str = "score", keep: bool = True) -> DataFrame:
    """``docs`` plus the language of each whole text and its probability (0 to 1).

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned. No shuffle; rows are
    independent; other columns pass through.
    """
    added = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]

    def make():
        def work(texts: pa.Array) -> list:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = np.flatnonzero(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)) if net.languages else []
            if len(lettered):
                windows, count = windows_of(texts.take(pa.array(lettered)).cast(pa.binary()).to_pylist())
                logs = np.add.reduceat(net.log_probabilities(windows), np.cumsum(count) - count, axis=0) / count[:, None]
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, s in zip(lettered.tolist(), p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = net.languages[k], s
            return [pa.array(langs, pa.string()), pa.array(scores)]

        return work

    return with_text_columns(docs, text, added, make, keep)
