"""Scalar building blocks whose edge semantics matter: truncation, clipping, guarded division, stable seeds, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_int(x: Column) -> Column:
    """Towards zero, unlike ``floor``."""
    return x.cast("long")


def clip(x: Column, low: int | float, high: int | float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_div(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """``otherwise`` where the denominator is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def voxel_index(x: Column, scale: float, resolution: int) -> Column:
    """Truncated towards zero, then clipped into the grid."""
    return clip(trunc_int(x / F.lit(scale / resolution)), 0, resolution - 1)


def linear_key(x: Column, y: Column, z: Column, resolution: int) -> Column:
    return (x * resolution + y) * resolution + z


def quantize(x: Column, low: float, high: float, bins: int = 1024) -> Column:
    return clip(trunc_int((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins - 1))), 0, bins - 1)


def dequantize(b: Column, low: float, high: float, bins: int = 1024) -> Column:
    return b / F.lit(float(bins - 1)) * F.lit(high - low) + F.lit(low)


def _spread(x: Column) -> Column:
    """The ten low bits, two zeros between each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """30-bit Z-order code of three ten-bit coordinates, x most significant."""
    a, b, c = (_spread(v.cast("long")) for v in (x, y, z))
    return F.shiftleft(a, 2).bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(c)


def sha_seed(text: Column) -> Column:
    """The first four bytes of SHA-256 as a little-endian unsigned number."""
    h = F.sha2(text, 256)
    swapped = F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2))
    return F.conv(swapped, 16, 10).cast("long")


def murmur_mix(x: Column) -> Column:
    """The 32-bit finaliser of murmur3 on the low 32 bits, without sign."""
    low = F.lit(0xFFFFFFFF)
    x = x.bitwiseAND(low)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
        # the product may pass 2^63: multiply by halves
        x = (x * F.lit(factor & 0xFFFF) + F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def rotation_from_quaternion(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Row-major 3x3 matrix; a quaternion of length under 1e-12 is the identity."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    tiny = n < F.lit(1e-12)
    w, x, y, z = (F.when(tiny, F.lit(d)).otherwise(v / n) for v, d in ((w, 1.0), (x, 0.0), (y, 0.0), (z, 0.0)))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotation_from_euler(a: Column, b: Column, c: Column) -> list[list[Column]]:
    """Rz(c) Ry(b) Rx(a): static x, y, z axes."""
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return [
        [cb * cc, sa * sb * cc - ca * sc, ca * sb * cc + sa * sc],
        [cb * sc, sa * sb * sc + ca * cc, ca * sb * sc - sa * cc],
        [-sb, sa * cb, ca * cb],
    ]


def matvec(m: list[list[Column]], v: list[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def geodesic(a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Angle between two rotations."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.acos(clip((trace - 1) / 2, -1.0, 1.0))
