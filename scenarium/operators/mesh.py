"""Mesh topology over ``faces(mesh_id, fid, v0, v1, v2)`` and ``vertices(mesh_id, vid, x, y, z)``, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.functions.semantics import cross, norm
from scenarium.operators.graph import connected_components
from scenarium.plans.materialize import materialize

CORNERS = ["v0", "v1", "v2"]


def face_corners(faces: DataFrame) -> DataFrame:
    return faces.select("mesh_id", "fid", F.posexplode(F.array(*CORNERS)).alias("corner", "vid"))


def face_edges(faces: DataFrame) -> DataFrame:
    """Three undirected edges of each face; ``forward`` if the face runs from the smaller to the larger end."""
    ends = F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    e = faces.select("mesh_id", "fid", F.posexplode(ends).alias("side", "e"))
    return e.select("mesh_id", "fid", "side", F.least("e.a", "e.b").alias("e0"), F.greatest("e.a", "e.b").alias("e1"), (F.col("e.a") <= F.col("e.b")).alias("forward"))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """Faces of each vertex, in order."""
    return face_corners(faces).groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_set("fid")).alias("fids"))


def edges(faces: DataFrame) -> DataFrame:
    """Unique edges and how many faces each has."""
    return face_edges(faces).groupBy("mesh_id", "e0", "e1").agg(F.count("*").alias("n_faces"))


def edge_faces(faces: DataFrame) -> DataFrame:
    return face_edges(faces).groupBy("mesh_id", "e0", "e1").agg(F.array_sort(F.collect_list("fid")).alias("fids"))


def vertex_edges(faces: DataFrame) -> DataFrame:
    """How many edges, boundary edges and overfull edges meet at each vertex; whether it is manifold."""
    ends = edges(faces).select("mesh_id", F.explode(F.array("e0", "e1")).alias("vid"), "n_faces")
    out = ends.groupBy("mesh_id", "vid").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_faces") == 1).alias("n_boundary"), F.count_if(F.col("n_faces") > 2).alias("n_overfull"))
    return out.withColumn("manifold", (F.col("n_overfull") == 0) & (F.col("n_boundary") <= 2))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("n_faces = 1").select("mesh_id", "e0", "e1")


def manifold_neighbours(faces: DataFrame) -> DataFrame:
    """Pairs of faces across an edge of exactly two faces, and whether both run along it the same way."""
    two = face_edges(faces).groupBy("mesh_id", "e0", "e1").agg(F.count("*").alias("n"), F.min("fid").alias("f0"), F.max("fid").alias("f1"), F.count_if("forward").alias("along"))
    return two.where("n = 2").select("mesh_id", "e0", "e1", "f0", "f1", (F.col("along") != 1).alias("same_direction"))


def boundary_neighbours(faces: DataFrame) -> DataFrame:
    """The two boundary edges that meet at each vertex that is manifold and on the boundary."""
    ends = boundary_edges(faces).select("mesh_id", "e0", "e1", F.explode(F.array("e0", "e1")).alias("vid"))
    good = vertex_edges(faces).where("manifold and n_boundary = 2").select("mesh_id", "vid")
    pair = ends.join(good, ["mesh_id", "vid"]).groupBy("mesh_id", "vid").agg(F.min(F.struct("e0", "e1")).alias("a"), F.max(F.struct("e0", "e1")).alias("b"))
    return pair.select("mesh_id", "vid", F.col("a.e0").alias("a0"), F.col("a.e1").alias("a1"), F.col("b.e0").alias("b0"), F.col("b.e1").alias("b1"))


def without_duplicates(faces: DataFrame) -> DataFrame:
    """Of faces with the same three vertices the one of lowest fid, its own vertex order kept."""
    key = F.array_sort(F.array(*CORNERS))
    return faces.groupBy("mesh_id", key.alias("k")).agg(F.min_by(F.struct("fid", *CORNERS), "fid").alias("f")).select("mesh_id", "f.*")


def _with_positions(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    out = faces
    for i, c in enumerate(CORNERS):
        out = out.join(vertices.select("mesh_id", F.col("vid").alias(c), *(F.col(a).alias(f"{a}{i}") for a in "xyz")), ["mesh_id", c])
    return out


def _normal() -> list[Column]:
    a, b = ([F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz"] for i in (1, 2))
    return cross(a, b)


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area, un-normalised normal and longest edge of each face."""
    rows = _with_positions(faces, vertices)
    side = lambda i, j: norm([F.col(f"{c}{i}") - F.col(f"{c}{j}") for c in "xyz"])
    n = _normal()
    return rows.select("mesh_id", "fid", *CORNERS, (norm(n) / 2).alias("area"), *(v.alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)), F.greatest(side(0, 1), side(1, 2), side(2, 0)).alias("longest"))


def without_degenerate(faces: DataFrame, vertices: DataFrame, relative: float = 1e-3, absolute: float = 1e-12) -> DataFrame:
    """Drops faces with a repeated vertex or an area under both limits."""
    g = face_geometry(faces.where("v0 <> v1 and v1 <> v2 and v2 <> v0"), vertices)
    return g.where(F.col("area") >= F.least(relative * F.col("longest") * F.col("longest"), F.lit(absolute))).select("mesh_id", "fid", *CORNERS)


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Normalised sum of the un-normalised normals of a vertex's faces; its first face's where the sum is zero."""
    g = face_geometry(faces, vertices).select("mesh_id", "fid", "nx", "ny", "nz", F.explode(F.array(*CORNERS)).alias("vid"))
    s = g.groupBy("mesh_id", "vid").agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"), F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("first"))
    length = norm([F.col(f"s{c}") for c in "xyz"])
    return s.select("mesh_id", "vid", *(F.when(length > 0, F.col(f"s{c}") / length).otherwise(F.col(f"first.n{c}")).alias(f"n{c}") for c in "xyz"))


def without_overfull_edges(faces: DataFrame) -> DataFrame:
    """Of the faces at an edge of more than two, the first two by fid stay."""
    n = F.row_number().over(W.partitionBy("mesh_id", "e0", "e1").orderBy("fid"))
    return faces.join(face_edges(faces).withColumn("n", n).where("n > 2").select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_anti")


def compacted(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces use, numbered anew from 0 in each mesh, and the faces with the new numbers."""
    used = face_corners(faces).select("mesh_id", "vid").distinct()
    kept = vertices.join(used, ["mesh_id", "vid"], "left_semi").withColumn("new", F.row_number().over(W.partitionBy("mesh_id").orderBy("vid")) - 1)
    out = faces
    for c in CORNERS:
        out = out.join(kept.select("mesh_id", F.col("vid").alias(c), F.col("new").alias(f"n_{c}")), ["mesh_id", c])
    return out.select("mesh_id", "fid", *(F.col(f"n_{c}").alias(c) for c in CORNERS)), kept.drop("vid").withColumnRenamed("new", "vid")


def face_components(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, component): the smallest fid reachable over edges of exactly two faces. ``fid`` is unique over all meshes."""
    links = manifold_neighbours(faces).select(F.col("f0").alias("src"), F.col("f1").alias("dst"))
    c = connected_components(links).withColumnRenamed("node", "fid")
    return faces.select("mesh_id", "fid").join(c, "fid", "left").select("mesh_id", "fid", F.coalesce("component", "fid").alias("component"))


def without_small_components(faces: DataFrame, vertices: DataFrame, least_area: float) -> DataFrame:
    parts = face_components(faces).join(face_geometry(faces, vertices).select("fid", "area"), "fid")
    large = parts.groupBy("component").agg(F.sum("area").alias("area")).where(F.col("area") >= least_area)
    return faces.join(parts.join(large, "component", "left_semi").select("fid"), "fid", "left_semi")


def _boundary_roots(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary edges with a number ``edge`` and the least number ``root`` that hangs together with it, and the numbered pairs of neighbours."""
    b = materialize(boundary_edges(faces).withColumn("edge", F.monotonically_increasing_id()), "boundary")
    pairs = boundary_neighbours(faces)
    for side, name in (("a", "src"), ("b", "dst")):
        pairs = pairs.join(b.select("mesh_id", F.col("e0").alias(f"{side}0"), F.col("e1").alias(f"{side}1"), F.col("edge").alias(name)), ["mesh_id", f"{side}0", f"{side}1"])
    pairs = materialize(pairs.select("mesh_id", "vid", "src", "dst"), "pairs")
    roots = connected_components(pairs).select(F.col("node").alias("edge"), F.col("component").alias("root"))
    return b.join(roots, "edge", "left").withColumn("root", F.coalesce("root", "edge")), pairs


def _loops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("edge")).groupBy("edge").agg(F.count("*").alias("ends"))
    rows = edges.join(ends, "edge", "left").withColumn("ends", F.coalesce("ends", F.lit(0)))
    loops = rows.groupBy("mesh_id", "root").agg(F.min(F.struct("e0", "e1")).alias("loop"), F.count("*").alias("n_edges"), F.bool_and(F.col("ends") >= 2).alias("closed"))
    return loops.select("mesh_id", F.col("loop.e0").alias("loop_e0"), F.col("loop.e1").alias("loop_e1"), "n_edges", "closed", "root")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(mesh_id, loop, n_edges, closed): components of boundary edges; closed if each has a neighbour at both ends."""
    return _loops(*_boundary_roots(faces))


def bounds(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in "xyz"))


def canonical(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Centred on the bounds, the longest side 0.99999; a mesh without extent is an error."""
    b = bounds(vertices, keys)
    side = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
    scale = F.when(side > 0, 0.99999 / side).otherwise(F.raise_error(F.lit("a mesh has no extent")).cast("double"))
    return vertices.join(b, keys).select(*[c for c in vertices.columns if c not in "xyz"], *(((F.col(c) - (F.col(f"max_{c}") + F.col(f"min_{c}")) / 2) * scale).alias(c) for c in "xyz"))


def filled_holes(faces: DataFrame, vertices: DataFrame, longest: float) -> tuple[DataFrame, DataFrame]:
    """New vertices and fan triangles for closed boundary loops of a perimeter under ``longest``.

    The new vertex of a loop is the mean of its edges' midpoints and has the number -1 - rank within the mesh;
    each boundary edge gives one triangle to it.
    """
    edges, pairs = _boundary_roots(faces)
    closed = _loops(edges, pairs).where("closed").select("root")
    e = edges.join(closed, "root", "left_semi")
    for i in (0, 1):
        e = e.join(vertices.select("mesh_id", F.col("vid").alias(f"e{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), ["mesh_id", f"e{i}"])
    length = norm([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])
    loops = e.groupBy("mesh_id", "root").agg(F.sum(length).alias("perimeter"), F.min(F.struct("e0", "e1")).alias("first"), *(F.avg((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in "xyz")).where(F.col("perimeter") < longest)
    loops = loops.withColumn("vid", (-F.row_number().over(W.partitionBy("mesh_id").orderBy("first"))).cast("long"))
    fan = e.select("mesh_id", "root", "e0", "e1").join(loops.select("mesh_id", "root", "vid"), ["mesh_id", "root"])
    return loops.select("mesh_id", "vid", "x", "y", "z"), fan.select("mesh_id", F.col("e0").alias("v0"), F.col("e1").alias("v1"), F.col("vid").alias("v2"))


def oriented(faces: DataFrame) -> DataFrame:
    """Faces of each component turned to agree with its face of lowest fid; components that can't agree stay as they are.

    Two copies of each face, kept and turned, are nodes; a shared edge that both run along the same way links a copy
    to the other's opposite copy. A face is turned if its kept copy is not in the root's component.
    """
    pairs = manifold_neighbours(faces)
    node = lambda f, turned: F.col(f) * 2 + turned
    across = F.when(F.col("same_direction"), 1).otherwise(0)
    links = pairs.select(F.inline(F.array(*(F.struct(node("f0", F.lit(t)).alias("src"), node("f1", (F.lit(t) + across) % 2).alias("dst")) for t in (0, 1)))))
    c = connected_components(links)
    flip = faces.select("mesh_id", "fid", *CORNERS).join(c.select(F.col("node").alias("kept"), F.col("component").alias("ck")), F.col("fid") * 2 == F.col("kept"), "left")
    turned = F.coalesce(F.col("ck") % 2 == 1, F.lit(False))
    return flip.select("mesh_id", "fid", "v0", F.when(turned, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turned, F.col("v1")).otherwise(F.col("v2")).alias("v2"))


def split_vertices(faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, corner, vid, part)``: corners of faces that hang together at a vertex across edges of exactly two faces share a ``part``.

    Each part becomes a vertex of its own, at the old place: its name is its least corner, as fid * 3 + corner. So edges
    of more than two faces, and vertices where surfaces only touch, come apart.
    """
    corners = faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid")).withColumn("node", F.col("fid") * 3 + F.col("corner"))
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 2), (2, 0))))
    ends = F.array("v0", "v1", "v2")
    edges = faces.select("mesh_id", "fid", F.explode(sides).alias("s"), ends.alias("v"))
    edges = edges.select("mesh_id", "fid", *(F.element_at("v", F.col(f"s.{x}") + 1).alias(f"v{x}") for x in "ij"), *((F.col("fid") * 3 + F.col(f"s.{x}")).alias(f"n{x}") for x in "ij"))
    low = F.col("vi") < F.col("vj")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    edges = edges.select("mesh_id", "fid", pick("vi", "vj").alias("e0"), pick("vj", "vi").alias("e1"), pick("ni", "nj").alias("n0"), pick("nj", "ni").alias("n1"))
    # both faces of an edge at once: sums tell whether there are two, minima and maxima which corners meet
    two = edges.groupBy("mesh_id", "e0", "e1").agg(F.count("*").alias("n"), *(f(F.struct("fid", "n0", "n1")).alias(x) for x, f in (("a", F.min), ("b", F.max)))).where("n = 2")
    links = two.select(F.explode(F.array(F.struct(F.col("a.n0").alias("src"), F.col("b.n0").alias("dst")), F.struct(F.col("a.n1").alias("src"), F.col("b.n1").alias("dst")))).alias("l")).select("l.*")
    roots = connected_components(links).withColumnRenamed("component", "part")
    return corners.join(roots, "node", "left").select("mesh_id", "fid", "corner", "vid", F.coalesce("part", "node").alias("part"))
