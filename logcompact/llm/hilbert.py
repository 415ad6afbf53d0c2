"""Places of integer points on a Hilbert curve."""

from __future__ import annotations

import numpy as np

#: Bits of a key; more dimensions than these are left out of the curve.
KEY_BITS = 62


def curve_bits(width: int) -> int:
    return max(1, min(20, KEY_BITS // max(width, 1)))


def hilbert_keys(points: np.ndarray, low: int, high: int) -> np.ndarray:
    """The place of each point of the cube [low, high]^width on a curve through it, as a non-negative integer.

    The bits of all coordinates at one scale are worked out for all points at once: from the coarsest scale down, the
    rest of the cube is reflected or turned as the curve runs through its octant, then the bits are Gray-decoded across
    coordinates. Coordinates are cut to as many leading bits as the key has room for; points that agree in them share a key.
    """
    n, width = points.shape[0], min(points.shape[1], KEY_BITS)
    bits = curve_bits(width)
    if not n or not width:
        return np.zeros(n, dtype=np.int64)
    shift = max(int(high - low).bit_length() - bits, 0)
    x = ((points[:, :width] - low) >> shift).astype(np.int64).T.copy()
    for scale in range(bits - 1, 0, -1):
        one = 1 << scale
        rest = one - 1
        for k in range(width):
            upper = (x[k] & one) != 0
            swap = np.where(upper, 0, (x[0] ^ x[k]) & rest)
            x[0] ^= np.where(upper, rest, swap)
            x[k] ^= swap
    for k in range(1, width):
        x[k] ^= x[k - 1]
    turned = np.zeros(n, dtype=np.int64)
    for scale in range(bits - 1, 0, -1):
        turned ^= np.where((x[width - 1] >> scale) & 1 == 1, (1 << scale) - 1, 0)
    x ^= turned
    keys = np.zeros(n, dtype=np.int64)
    for scale in range(bits - 1, -1, -1):
        for k in range(width):
            keys = keys << 1 | ((x[k] >> scale) & 1)
    return keys
