"""Similarity poses (scale, angles about fixed x, y and z axes, shift) under affine transforms, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.functions.semantics import rotation_from_euler

GRID = [(i, j) for i in range(3) for j in range(3)]


def euler_from_rotation(m: list[list[Column]]) -> list[Column]:
    """Angles about fixed x, y and z; looking straight up or down, where only their sum is known, that about z is 0."""
    level = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    sound = level > 1e-8
    return [F.when(sound, F.atan2(m[2][1], m[2][2])).otherwise(F.atan2(-m[1][2], m[1][1])), F.atan2(-m[2][0], level), F.when(sound, F.atan2(m[1][0], m[0][0])).otherwise(0.0)]


def nearest_rotation(m: list[list[Column]], rounds: int = 16) -> Column:
    """The rotation nearest to a matrix, nine numbers row by row: the mean of it and its inverse transpose, again and again.

    Null where the determinant isn't positive. Convergence is quadratic; a matrix that stretches a thousandfold takes a dozen rounds.
    """
    others = [(1, 2), (2, 0), (0, 1)]

    def step(x: Column, _: Column) -> Column:
        at = lambda i, j: x[3 * i + j]
        cofactor = [[at(p, r) * at(q, s) - at(p, s) * at(q, r) for r, s in others] for p, q in others]
        det = sum((at(0, j) * cofactor[0][j] for j in range(3)), F.lit(0.0))
        return F.array(*((at(i, j) + cofactor[i][j] / det) / 2 for i, j in GRID))

    det = sum((m[0][j] * (m[1][r] * m[2][s] - m[1][s] * m[2][r]) for j, (r, s) in enumerate(others)), F.lit(0.0))
    return F.when(det > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*(m[i][j] for i, j in GRID)), step))


def transformed_poses(poses: DataFrame) -> DataFrame:
    """``poses`` after their transforms t00 ... t23: ``scale`` (the mean length of the axes), ``angles``, ``shift``, and the nearest ``rotation``.

    A pose has scale, ax, ay, az, tx, ty, tz. Angles are those of the axes over the mean scale, whether or not these are square to each other, as they are
    where the transform shears or stretches unevenly; ``rotation`` is square, and null where the transform turns inside out. A scale of nothing has no angles (0).
    """
    r = rotation_from_euler(*(F.col(f"a{a}") for a in "xyz"))
    rows = poses.withColumns({f"_r{i}{j}": r[i][j] * F.col("scale") for i, j in GRID})
    rows = rows.withColumns({f"_m{i}{j}": sum((F.col(f"t{i}{k}") * F.col(f"_r{k}{j}") for k in range(3)), F.lit(0.0)) for i, j in GRID})
    m = [[F.col(f"_m{i}{j}") for j in range(3)] for i in range(3)]
    mean = sum((F.sqrt(sum((m[i][j] * m[i][j] for i in range(3)), F.lit(0.0))) for j in range(3)), F.lit(0.0)) / 3
    shift = F.array(*(sum((F.col(f"t{i}{k}") * F.col(f"t{a}") for k, a in enumerate("xyz")), F.col(f"t{i}3")) for i in range(3)))
    rows = rows.withColumns({"_mean": mean, "shift": shift, "rotation": nearest_rotation(m)})
    turned = [[F.when(F.col("_mean") > 1e-8, m[i][j] / F.col("_mean")).otherwise(float(i == j)) for j in range(3)] for i in range(3)]
    kept = [c for c in poses.columns if c not in {"scale", "ax", "ay", "az", "tx", "ty", "tz", *(f"t{i}{j}" for i in range(3) for j in range(4))}]
    return rows.select(*kept, F.col("_mean").alias("scale"), F.array(*euler_from_rotation(turned)).alias("angles"), "shift", "rotation")
