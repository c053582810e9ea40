"""Order-dependent or numerically special steps, each on one small group in an Arrow function."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def blake_seed(text: pd.Series) -> pd.Series:
    """BLAKE2b of four bytes, as a little-endian unsigned number."""
    return text.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little") if t is not None else None)


@F.pandas_udf(LongType())
def hilbert(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """30-bit Hilbert index of three ten-bit coordinates, by the transpose form: undo excess work, Gray encode, interleave."""
    axes = np.stack([np.asarray(v, np.int64) for v in (x, y, z)])
    for shift in range(9, 0, -1):
        bit, low = 1 << shift, (1 << shift) - 1
        for i in range(3):
            on = (axes[i] & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(on, axes[0] ^ low, axes[0] ^ swap)
            axes[i] ^= swap
    axes[1] ^= axes[0]
    axes[2] ^= axes[1]
    gray = np.zeros_like(axes[0])
    for shift in range(9, 0, -1):
        gray ^= np.where((axes[2] >> shift) & 1 == 1, (1 << shift) - 1, 0)
    axes ^= gray
    out = np.zeros_like(axes[0])
    for shift in range(9, -1, -1):
        for i in range(3):
            out = (out << 1) | ((axes[i] >> shift) & 1)
    return pd.Series(out)


def greedy_tour(stops: DataFrame, key: str, turn_cost: float = 1.5) -> DataFrame:
    """``(key, item, rank)``: from the first item on, always to the stop of least distance plus ``turn_cost`` times the turn between forwards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        at, ahead = pdf[["x", "y", "z"]].to_numpy(float), pdf[["fx", "fy", "fz"]].to_numpy(float)
        ahead = ahead / np.maximum(np.linalg.norm(ahead, axis=1, keepdims=True), 1e-12)
        order, left = [0], np.ones(len(pdf), bool)
        left[0] = False
        while left.any():
            i = order[-1]
            cost = np.linalg.norm(at - at[i], axis=1) + turn_cost * np.arccos(np.clip(ahead @ ahead[i], -1, 1))
            order.append(int(np.where(left, cost.round(9), np.inf).argmin()))  # ties to the smaller item
            left[order[-1]] = False
        return pd.DataFrame({key: pdf[key].iloc[0], "item": pdf["item"].iloc[order].to_numpy(), "rank": np.arange(len(order))})

    return stops.groupBy(key).applyInPandas(run, stops.select(key, "item").withColumn("rank", F.lit(0).cast("long")).schema)


def distinct_segments(segments: DataFrame, key: str, parallel: float = 0.98, offset: float = 0.5) -> DataFrame:
    """Longest first, a segment goes if it is nearly parallel to a kept one and nearer to its line than ``offset``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.stack([pdf.x1 - pdf.x0, pdf.y1 - pdf.y0], 1).astype(float)
        length = np.hypot(*d.T)
        unit, mid = d / np.maximum(length, 1e-12)[:, None], np.stack([pdf.x0 + pdf.x1, pdf.y0 + pdf.y1], 1) / 2
        kept: list[int] = []
        for i in np.lexsort((pdf["item"], -length.round(9))):
            near = [k for k in kept if abs(unit[i] @ unit[k]) >= parallel and abs((mid[i] - mid[k]) @ [-unit[k][1], unit[k][0]]) < offset]
            if not near:
                kept.append(int(i))
        return pdf.iloc[sorted(kept)][[key, "item"]]

    return segments.groupBy(key).applyInPandas(run, segments.select(key, "item").schema)


def similarity_fit(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Least-squares scale, rotation and shift from paired points."""
    a, b = source - source.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(b.T @ a / len(a))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    rotation = u @ flip @ vt
    scale = float((s * np.diag(flip)).sum() / max((a**2).sum() / len(a), 1e-12))
    return scale, rotation, target.mean(0) - scale * rotation @ source.mean(0)


def trimmed_alignment(pairs: DataFrame, key: str, keep: float = 0.9, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``(key, scale, residual, rounds)`` of the similarity that lays the points of side 0 onto those of side 1.

    Nearest pairs and closed-form fits in turn, on the nearest share of pairs. A group is one object: its points
    must fit a task (pool them by voxel first).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[pdf.side == s, ["x", "y", "z"]].to_numpy(float) for s in (0, 1))
        if len(a) < 3 or len(b) < 3:
            return pd.DataFrame([(pdf[key].iloc[0], None, None, 0)], columns=[key, "scale", "residual", "rounds"])
        scale, rotation, shift, last, n = 1.0, np.eye(3), b.mean(0) - a.mean(0), np.inf, 0
        for n in range(1, rounds + 1):
            moved = scale * a @ rotation.T + shift
            d2 = ((moved[:, None] - b[None]) ** 2).sum(2)
            nearest, near = d2.argmin(1), d2.min(1)
            used = np.argsort(near, kind="stable")[: max(3, int(keep * len(a)))]
            error = float(np.sqrt(near[used].mean()))
            if last - error < tolerance:
                break
            last = error
            scale, rotation, shift = similarity_fit(a[used], b[nearest[used]])
        return pd.DataFrame([(pdf[key].iloc[0], scale, last, n)], columns=[key, "scale", "residual", "rounds"])

    return pairs.groupBy(key).applyInPandas(run, f"{key} long, scale double, residual double, rounds long")
