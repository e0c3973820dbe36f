"""Plain numpy forms of the record-level operators, written for the tests."""

import math

import numpy as np


def signal_rows(signals):
    """``{record: values}`` to long rows with one channel."""
    return [(r, "1", i, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v))
            for r, vs in signals.items() for i, v in enumerate(vs)]


def frame(spark, signals):
    return spark.createDataFrame(signal_rows(signals), "record_id STRING, channel STRING, idx BIGINT, value DOUBLE")


def collect(blocks):
    """Blocks back to one array per record, with a check that they are whole and in order."""
    out = {}
    for row in sorted(blocks.collect(), key=lambda r: (r["record_id"], r["block"])):
        parts = out.setdefault(row["record_id"], [])
        assert row["block"] == len(parts)
        parts.append(np.array(row["values"], dtype=float))
    return {k: np.concatenate(v) for k, v in out.items()}


def recursion(x, sos, zi=None):
    y = list(map(float, x))
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1, s2 = (0.0, 0.0) if zi is None else zi[2 * s:2 * s + 2]
        for n, v in enumerate(y):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            y[n] = o
    return np.array(y)


def both_ways(x, sos, edge):
    x = np.asarray(x, float)
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2:-edge - 2:-1]])
    # The steady state is found by running a constant for a long time.
    flat = np.ones(20000)
    state = []
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1 = s2 = 0.0
        out = np.empty_like(flat)
        for n, v in enumerate(flat):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out[n] = o
        state += [s1, s2]
        flat = out
    state = np.array(state)
    y = recursion(ext, sos, state * ext[0])[::-1]
    y = recursion(y, sos, state * y[0])[::-1]
    return y[edge:-edge]


def despike(x, win, threshold=3.0, rounds=1000):
    """Round by round on the whole record, median over all windows."""
    x = np.array(x, dtype=float)
    if win < 1 or len(x) < win:
        return x
    n = len(x) // win
    body = x[:n * win].reshape(n, win)
    for _ in range(rounds):
        peaks = np.abs(body).max(axis=1)
        mid = np.median(peaks)
        if mid == 0 or not (peaks > threshold * mid).any():
            break
        w = body[int(peaks.argmax())]
        p = int(np.abs(w).argmax())
        flips = [i for i in range(win - 1) if abs(np.sign(w[i + 1]) - np.sign(w[i])) > 1]
        lo = max([i + 1 for i in flips if i < p], default=0)
        hi = min([i for i in flips if i >= p], default=win - 1)
        w[lo:hi] = 1e-4
    return x


def resampled(x, up, down, taps):
    half = len(taps) // 2
    out = []
    for m in range(-(-len(x) * up // down)):
        out.append(sum(x[i] * taps[m * down - i * up + half] for i in range(len(x))
                       if 0 <= m * down - i * up + half < len(taps)))
    return np.array(out)
