"""What is placed collides with nothing, stands on something, and no scene takes more than it may."""

from collections import Counter

from scenarium.operators import placement
from scenarium.operators.placement import place, placed_rows


def test_places_are_free_and_supported(spark):
    cubes = [(s, o, x, y, z) for s in (1, 2) for o in range(40) for x in range(1 + o % 3) for y in range(2) for z in range(1 + o % 2)] + [(1, 99, x, 0, 0) for x in range(20)]
    ground = [(1, x, y, 0) for x in range(4) for y in range(8)]
    shapes = spark.createDataFrame(cubes, "s int, object int, vx long, vy long, vz long").repartition(3)
    places = place(shapes, spark.createDataFrame(ground, "s int, vx long, vy long, vz long"), ["s"], "7", 8, 4, 0.5, 12, 2)
    held = {(r["s"], r["object"]): (r["turn"], r["dx"], r["dy"], r["dz"]) for r in places.collect()}
    assert len(held) == places.count() and max(Counter(s for s, _ in held).values()) <= 12 and (1, 99) not in held
    assert len({t for t, *_ in held.values()}) > 1 and {dz for *_, dz in held.values()} == {0, 1}
    taken = {(1, x, y, z) for _, x, y, z in ground}
    for turn in range(4):
        now = [k for k, v in held.items() if v[0] == turn]
        new = set()
        for s, o in now:
            _, dx, dy, dz = held[s, o]
            own = [(s, x + dx, y + dy, z + dz) for a, b, x, y, z in cubes if (a, b) == (s, o)]
            assert all(0 <= c < 8 for v in own for c in v[1:]) and not taken & set(own) and not new & set(own)
            bottom = [v for v in own if v[3] == dz]
            assert sum(v[3] == 0 or (*v[:3], v[3] - 1) in taken for v in bottom) >= 0.5 * len(bottom)
            new |= set(own)
        taken |= new
    rows = placed_rows(shapes, places, ["s"]).collect()
    assert {(r["s"], r["vx"], r["vy"], r["vz"]) for r in rows} == taken - {(1, x, y, z) for _, x, y, z in ground}
    assert place(shapes.limit(0), shapes.select("s", "vx", "vy", "vz").limit(0), ["s"], "7", 8, 2, 0.5, 12, 2).collect() == []


def test_full_scenes_draw_no_more(spark, monkeypatch):
    tables, real = [], placement.materialize
    monkeypatch.setattr(placement, "materialize", lambda df, name: (tables.append(name), real(df, name))[1])
    shapes = spark.createDataFrame([(1, o, 0, 0, z) for o in range(30) for z in range(2)], "s int, object int, vx long, vy long, vz long")
    places = place(shapes, shapes.select("s", "vx", "vy", "vz").limit(0), ["s"], "7", 8, 4, 0.5, 2, 1)
    assert places.count() == 2 and {r["turn"] for r in places.collect()} == {0}
    assert tables.count("placed") == 1
