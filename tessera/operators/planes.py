"""Whole planes in numpy: what a task does with a tile once its code-blocks are decoded.

The same lifting as `functions.lifting`, vectorised over a plane; tests hold the two together.
"""

from __future__ import annotations

import numpy as np

from tessera.functions.lifting import A1, A2, A3, A4, K


def _neighbours(band: np.ndarray, count: int, shift: int) -> np.ndarray:
    """band[i + shift] for i < count along axis 0, indexes clamped into the band."""
    return band[np.clip(np.arange(count) + shift, 0, len(band) - 1)]


def _lift(own: np.ndarray, other: np.ndarray, shift: int, step) -> np.ndarray:
    if not len(other) or not len(own):
        return own
    return own + step(_neighbours(other, len(own), shift) + _neighbours(other, len(own), shift + 1))


def _woven(even: np.ndarray, odd: np.ndarray) -> np.ndarray:
    out = np.empty((len(even) + len(odd), *even.shape[1:]), even.dtype)
    out[::2], out[1::2] = even, odd
    return out


def _inverse53(x: np.ndarray) -> np.ndarray:
    half = (len(x) + 1) // 2
    even = _lift(x[:half], x[half:], -1, lambda s: -((s + 2) >> 2))
    return _woven(even, _lift(x[half:], even, 0, lambda s: s >> 1))


def _forward53(x: np.ndarray) -> np.ndarray:
    even, odd = x[::2], x[1::2]
    odd = _lift(odd, even, 0, lambda s: -(s >> 1))
    return np.concatenate([_lift(even, odd, -1, lambda s: (s + 2) >> 2), odd])


def _inverse97(x: np.ndarray) -> np.ndarray:
    if len(x) == 1:
        return x
    half = (len(x) + 1) // 2
    even, odd = x[:half] * K, x[half:] / K
    even = _lift(even, odd, -1, lambda s: A4 * s)
    odd = _lift(odd, even, 0, lambda s: A3 * s)
    even = _lift(even, odd, -1, lambda s: A2 * s)
    return _woven(even, _lift(odd, even, 0, lambda s: A1 * s))


def _forward97(x: np.ndarray) -> np.ndarray:
    if len(x) == 1:
        return x
    even, odd = x[::2], x[1::2]
    odd = _lift(odd, even, 0, lambda s: -A1 * s)
    even = _lift(even, odd, -1, lambda s: -A2 * s)
    odd = _lift(odd, even, 0, lambda s: -A3 * s)
    even = _lift(even, odd, -1, lambda s: -A4 * s)
    return np.concatenate([even / K, odd * K])


def inverse(plane: np.ndarray, levels: int, reversible: bool) -> np.ndarray:
    """Samples of a plane in quadrant order: columns, then rows, from the smallest level up."""
    out, line = plane.copy(), _inverse53 if reversible else _inverse97
    for height, width in reversed([(-(-plane.shape[0] // (1 << k)), -(-plane.shape[1] // (1 << k))) for k in range(levels)]):
        out[:height, :width] = line(line(out[:height, :width]).T).T
    return out


def forward(plane: np.ndarray, levels: int, reversible: bool) -> np.ndarray:
    """The opposite of `inverse`."""
    out, line = plane.copy(), _forward53 if reversible else _forward97
    for k in range(levels):
        height, width = -(-plane.shape[0] // (1 << k)), -(-plane.shape[1] // (1 << k))
        out[:height, :width] = line(line(out[:height, :width].T).T)
    return out


def colours(planes: np.ndarray, reversible: bool, use_mct: bool, bits: int, signed: bool) -> np.ndarray:
    """Integer samples of the components' planes: colour transform, level shift and clamp."""
    if use_mct and len(planes) >= 3:
        a, b, c = planes[:3]
        if reversible:
            g = a - ((b + c) >> 2)
            first = [c + g, g, b + g]
        else:
            first = [a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b]
        planes = np.stack([*first, *planes[3:]])
    whole = planes if reversible else np.floor(planes + 0.5).astype(np.int64)
    if signed:
        return np.clip(whole, -(1 << bits - 1), (1 << bits - 1) - 1)
    return np.clip(whole + (1 << bits - 1), 0, (1 << bits) - 1)
