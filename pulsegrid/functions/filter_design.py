"""Filter coefficients from closed forms: Butterworth sections, notch, FIR bands, resampling kernel.

Only small coefficient arrays are made here, on the driver; the filtering itself is in
``operators.recursive`` and ``operators.kernels``.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np


def butterworth(order: int, edges, kind: str) -> np.ndarray:
    """Second-order sections ``[b0 b1 b2 1 a1 a2]``; ``edges`` are fractions of the Nyquist rate.

    ``kind`` is ``low``, ``high``, ``band`` or ``stop``. The analogue prototype's poles lie evenly
    on the left unit half-circle; they are moved to the pre-warped edges and mapped by the bilinear
    transform.
    """
    edges = np.atleast_1d(np.asarray(edges, dtype=float))
    warped = np.tan(np.pi * edges / 2)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "low":
        poles, zeros = warped[0] * proto, np.zeros(0, complex)
    elif kind == "high":
        poles, zeros = warped[0] / proto, np.zeros(order, complex)
    else:
        width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
        half = proto * width / 2 if kind == "band" else width / 2 / proto
        root = np.sqrt(half ** 2 - centre2 + 0j)
        poles = np.concatenate([half + root, half - root])
        if kind == "band":
            zeros = np.zeros(order, complex)
        else:
            zeros = np.repeat([1j, -1j], order) * np.sqrt(centre2)
    z = (1 + zeros) / (1 - zeros)
    p = (1 + poles) / (1 - poles)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    # Unit gain at a frequency inside the pass band fixes the overall factor.
    w = {"low": 0.0, "high": np.pi, "stop": 0.0}.get(kind, 2 * np.arctan(np.sqrt(warped[0] * warped[-1])))
    at = np.exp(1j * w)
    gain = np.abs(np.prod(at - p) / np.prod(at - z))
    return _sections(z, p, gain)


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Quadratic (or last linear) real factors of a conjugate-closed root set."""
    upper = sorted(roots[roots.imag > 1e-12], key=lambda r: (abs(r), r.real))
    real = sorted(roots[np.abs(roots.imag) <= 1e-12].real)
    out = [np.array([1.0, -2 * r.real, abs(r) ** 2]) for r in upper]
    # Pairing the ends keeps zeros at +1 and -1 in one factor, as a band-pass needs.
    while len(real) >= 2:
        a, b = real.pop(0), real.pop(-1)
        out.append(np.array([1.0, -(a + b), a * b]))
    if real:
        out.append(np.array([1.0, -real[0], 0.0]))
    return out


def _sections(z, p, gain) -> np.ndarray:
    den, num = _pairs(np.asarray(p, complex)), _pairs(np.asarray(z, complex))
    sos = np.array([np.concatenate([b, a]) for b, a in zip(num, den)])
    sos[0, :3] *= gain
    return sos


def notch(freq: float, q: float) -> np.ndarray:
    """One notch section at ``freq`` (fraction of the Nyquist rate) with quality ``q``."""
    w0 = np.pi * freq
    g = 1 / (1 + np.tan(w0 / q / 2))
    mid = -2 * np.cos(w0) * g
    return np.array([[g, mid, g, 1.0, mid, 2 * g - 1]])


def band_sections(low: float, high: float, fs: float, order: int = 2) -> np.ndarray:
    """Causal low-pass at ``high`` then high-pass at ``low``; cutoffs are divided by ``fs``.

    Because the divisor is ``fs`` and not ``fs / 2``, the effective band is half the nominal one.
    """
    return np.concatenate([butterworth(order, high / fs, "low"), butterworth(order, low / fs, "high")])


def edge_length(sos: np.ndarray) -> int:
    """Samples of odd extension used for zero-phase filtering by sections."""
    taps = 2 * len(sos) + 1
    return 3 * (taps - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def steady_state(sos: np.ndarray) -> np.ndarray:
    """Section states (two per section) after a constant input of 1."""
    state, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        out = level * (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 * level - a2 * out
        state += [b1 * level - a1 * out + s2, s2]
        level = out
    return np.array(state)


def fir_band(taps: int, edges, kind: str) -> np.ndarray:
    """Hamming-windowed sinc filter; edges are fractions of the Nyquist rate."""
    m = np.arange(taps) - (taps - 1) / 2
    lows, highs, scale_at = {"low": ([0.0], [edges[0]], 0.0), "high": ([edges[0]], [1.0], 1.0),
                             "band": ([edges[0]], [edges[-1]], (edges[0] + edges[-1]) / 2)}[kind]
    h = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in zip(lows, highs))
    h = h * np.hamming(taps)
    return h / np.sum(h * np.cos(np.pi * m * scale_at))


def four_bands(fs: float, taps: int = 61, edges=(45.0, 80.0, 200.0)) -> list[np.ndarray]:
    """Low, two band-pass, and high filters that split a signal at three edges (Hz)."""
    e0, e1, e2 = (e / (fs / 2) for e in edges)
    return [fir_band(taps, [e0], "low"), fir_band(taps, [e0, e1], "band"),
            fir_band(taps, [e1, e2], "band"), fir_band(taps, [e2], "high")]


def zero_phase_kernel(h: np.ndarray) -> np.ndarray:
    """Forward and backward filtering by ``h`` as one symmetric kernel."""
    return np.convolve(h, h[::-1])


@lru_cache(maxsize=64)
def resample_kernel(fs_in: int, fs_out: int) -> tuple[int, int, tuple[float, ...]]:
    """``(up, down, kernel)`` for polyphase resampling: Kaiser(5) sinc, 10 zero crossings a side."""
    g = gcd(int(fs_out), int(fs_in))
    up, down = int(fs_out) // g, int(fs_in) // g
    widest = max(up, down)
    half = 10 * widest
    m = np.arange(2 * half + 1) - half
    h = np.sinc(m / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    h = h / h.sum() * up
    return up, down, tuple(h)
