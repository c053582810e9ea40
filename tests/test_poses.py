"""Poses under transforms, against numpy."""

import numpy as np

from scenarium.operators.poses import transformed_poses

COLUMNS = ["i", "scale", "ax", "ay", "az", "tx", "ty", "tz", *(f"t{i}{j}" for i in range(3) for j in range(4))]


def turn(a, b, c):
    x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return z @ y @ x


def test_poses_turn_about_any_axis(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        pose = [float(rng.uniform(0.1, 5)), *map(float, rng.uniform(-1.5, 1.5, 3)), *map(float, rng.normal(size=3))]
        t = np.hstack([turn(*rng.uniform(-3, 3, 3)) @ np.diag(rng.uniform(0.01, 10, 3)) if i % 2 else turn(*rng.uniform(-3, 3, 3)) * 2, rng.normal(size=(3, 1))])
        rows.append((i, *pose, *map(float, t.ravel())))
    mirror = (60, 1.0, *[0.0] * 6, *map(float, np.hstack([np.diag([1.0, 1, -1]), np.zeros((3, 1))]).ravel()))
    nothing = (61, 0.0, 0.3, 0.2, 0.1, 1.0, 2.0, 3.0, *map(float, np.eye(3, 4).ravel()))
    up = (62, 1.0, 0.4, np.pi / 2, 0.0, 0.0, 0.0, 0.0, *map(float, np.eye(3, 4).ravel()))
    got = {r["i"]: r for r in transformed_poses(spark.createDataFrame([tuple(map(float, r)) for r in (*rows, mirror, nothing, up)], [*COLUMNS])).collect()}
    for row in rows:
        r, t = got[row[0]], np.array(row[8:]).reshape(3, 4)
        m = t[:, :3] @ (row[1] * turn(*row[2:5]))
        mean = np.linalg.norm(m, axis=0).mean()
        assert np.isclose(r["scale"], mean) and np.allclose(r["shift"], t[:, :3] @ np.array(row[5:8]) + t[:, 3])
        a, _, b = np.linalg.svd(m)
        assert np.allclose(np.array(r["rotation"]).reshape(3, 3), a @ b, atol=1e-9)
        if row[0] % 2 == 0:  # no shear: the angles give the rotation back
            assert np.allclose(turn(*r["angles"]), m / mean)
    assert got[60]["rotation"] is None and got[61]["scale"] == 0 and np.allclose(got[61]["angles"], 0)
    assert np.allclose(turn(*got[62]["angles"]), turn(0.4, np.pi / 2, 0.0), atol=1e-6)
