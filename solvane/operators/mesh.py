"""Mesh audit, repair, healing, clipping and surface grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.core import large
from solvane.functions.vector import cross, dot, norm, sub, vec
from solvane.operators.graphs import _cut

#: Face flags, vertex flags.
INVALID_INDEX, NON_FINITE, DEGENERATE, DUPLICATE = 1, 2, 4, 8
VERTEX_NON_FINITE, VERTEX_ISOLATED = 1, 2
F32_EPSILON = 2.0**-23


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _faces_with_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for k in range(3):
        v = vertices.select("mesh_id", F.col("vertex_index").alias(f"v{k}"), *[F.col(x).alias(f"p{k}{x}") for x in "xyz"], F.lit(True).alias(f"there{k}"))
        out = out.join(large(v), ["mesh_id", f"v{k}"], "left")
    return out


def face_flags(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """faces with flag, double area and the points: the first reason in the order index, finite, degenerate, duplicate."""
    rows = _faces_with_points(vertices, faces)
    there = F.col("there0").isNotNull() & F.col("there1").isNotNull() & F.col("there2").isNotNull()
    finite = F.lit(True)
    for k in range(3):
        for x in "xyz":
            finite = finite & _finite(F.col(f"p{k}{x}"))
    double = norm(cross(sub(vec("p1"), vec("p0")), sub(vec("p2"), vec("p0"))))
    same = (F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))
    flag = F.when(~there, INVALID_INDEX).when(~finite, NON_FINITE).when(same | (double <= 2 * tolerance * tolerance), DEGENERATE).otherwise(0)
    triple = F.array_sort(F.array("v0", "v1", "v2"))
    rows = rows.withColumn("flag", flag).withColumn("double_area", double).withColumn("triple", triple)
    nth = F.row_number().over(Window.partitionBy("mesh_id", "triple", (F.col("flag") == 0)).orderBy("face_index"))
    return rows.withColumn("flag", F.when((F.col("flag") == 0) & (nth > 1), DUPLICATE).otherwise(F.col("flag")))


def edges(flagged: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, n, turn) of the accepted faces' edges: how many faces, and their directions' sum."""
    e = F.array(*[F.struct(F.least(F.col(a), F.col(b)).alias("lo"), F.greatest(F.col(a), F.col(b)).alias("hi"), F.when(F.col(a) < F.col(b), 1).otherwise(-1).alias("way")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return flagged.where("flag = 0").select("mesh_id", F.inline(e)).groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("way").alias("turn"))


def audit(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6, f32_ratio: float = 0.25) -> DataFrame:
    """A row for each mesh: counts of faults, area, signed volume, edges, components, readiness."""
    flagged = face_flags(vertices, faces, tolerance)
    volume = dot(vec("p0"), cross(vec("p1"), vec("p2"))) / 6
    ok = F.col("flag") == 0
    per_face = flagged.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("face_count"),
        *[F.count_if(F.col("flag") == f).alias(n) for f, n in ((INVALID_INDEX, "invalid_index_faces"), (NON_FINITE, "non_finite_faces"), (DEGENERATE, "degenerate_faces"), (DUPLICATE, "duplicate_faces"), (0, "accepted_faces"))],
        F.coalesce(F.sum(F.when(ok, F.col("double_area") / 2)), F.lit(0.0)).alias("area"),
        F.coalesce(F.sum(F.when(ok, volume)), F.lit(0.0)).alias("signed_volume"),
    )
    e = edges(flagged)
    per_edge = e.groupBy("mesh_id").agg(F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"), F.count_if((F.col("n") == 2) & (F.col("turn") != 0)).alias("winding_conflicts"))
    used = flagged.where("flag = 0").select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_index")).distinct()
    top = F.greatest(*[F.abs(F.col(x)) for x in "xyz"])
    per_vertex = vertices.join(large(used.withColumn("used", F.lit(True))), ["mesh_id", "vertex_index"], "left").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertex_count"), F.count_if(F.col("used").isNull()).alias("isolated_vertices"), F.count_if(~(_finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z")))).alias("non_finite_vertices"), (F.max(F.when(_finite(top), top)) * F32_EPSILON).alias("f32_error"))
    from solvane.operators.graphs import components

    parts = components(e.select(F.struct("mesh_id", F.col("lo").alias("at")).alias("a"), F.struct("mesh_id", F.col("hi").alias("at")).alias("b"))).groupBy(F.col("v.mesh_id").alias("mesh_id")).agg(F.countDistinct("comp").alias("components"))
    out = per_vertex.join(per_face, "mesh_id", "left").join(per_edge, "mesh_id", "left").join(parts, "mesh_id", "left").na.fill(0)
    ready = (F.col("accepted_faces") == F.col("face_count")) & (F.col("face_count") > 0) & (F.col("non_finite_vertices") == 0)
    tight = ready & (F.col("boundary_edges") == 0) & (F.col("non_manifold_edges") == 0) & (F.col("winding_conflicts") == 0)
    return out.withColumn("ready", ready & (F.col("isolated_vertices") == 0)).withColumn("watertight", tight).withColumn("f32_safe", F.col("f32_error") <= tolerance * f32_ratio)


def issues(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(mesh_id, item, index, issue): each fault of a mesh as a row."""
    name = F.when(F.col("flag") == INVALID_INDEX, "invalid_index").when(F.col("flag") == NON_FINITE, "non_finite").when(F.col("flag") == DEGENERATE, "degenerate").otherwise("duplicate")
    f = face_flags(vertices, faces, tolerance).where("flag > 0").select("mesh_id", F.lit("face").alias("item"), F.col("face_index").alias("index"), name.alias("issue"))
    v = vertices.where(~(_finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z")))).select("mesh_id", F.lit("vertex").alias("item"), F.col("vertex_index").alias("index"), F.lit("non_finite").alias("issue"))
    return f.unionByName(v)


def repair(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Meshes without flagged faces; vertices keep those in use, numbered by first use."""
    good = face_flags(vertices, faces, tolerance).where("flag = 0").select("mesh_id", "face_index", "v0", "v1", "v2")
    uses = good.select("mesh_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vertex_index"), "face_index")
    first = uses.groupBy("mesh_id", "vertex_index").agg(F.min(F.struct("face_index", "k")).alias("at"))
    new = first.select("mesh_id", "vertex_index", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")) - 1).cast("long").alias("new"))
    v = vertices.join(large(new), ["mesh_id", "vertex_index"]).select("mesh_id", F.col("new").alias("vertex_index"), "x", "y", "z")
    f = good
    for k in range(3):
        f = f.join(large(new.select("mesh_id", F.col("vertex_index").alias(f"v{k}"), F.col("new").alias(f"n{k}"))), ["mesh_id", f"v{k}"])
    number = (F.row_number().over(Window.partitionBy("mesh_id").orderBy("face_index")) - 1).cast("long")
    return v, f.select("mesh_id", number.alias("face_index"), *[F.col(f"n{k}").alias(f"v{k}") for k in range(3)])


def _as_arrays(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vertex_index", "x", "y", "z"))).alias("v"))
    f = faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("face_index", "v0", "v1", "v2"))).alias("f"))
    return v.join(large(f), "mesh_id", "left").select("mesh_id", *[F.col(f"v.{x}").alias(x) for x in ("vertex_index", "x", "y", "z")], *[F.col(f"f.{x}").alias(x) for x in ("v0", "v1", "v2")])


def _per_mesh(vertices: DataFrame, faces: DataFrame, change) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs change(points, triples) -> (points, triples, notes) on each mesh; a mesh is the unit of work."""
    kinds = "mesh_id long, points array<array<double>>, triples array<array<long>>, note_a long, note_b long"

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                index = {int(k): n for n, k in enumerate(r.vertex_index)}
                p = np.column_stack([np.asarray(c, float) for c in (r.x, r.y, r.z)]) if len(r.vertex_index) else np.zeros((0, 3))
                cols = [[] if c is None else c for c in (r.v0, r.v1, r.v2)]
                t = np.array([[index[int(i)] for i in f] for f in zip(*cols, strict=True)], np.int64).reshape(-1, 3)
                p, t, notes = change(p, t)
                out.append((r.mesh_id, p.tolist(), t.tolist(), *notes))
            yield pd.DataFrame(out, columns=["mesh_id", "points", "triples", "note_a", "note_b"])

    done = _cut(_as_arrays(vertices, faces).mapInPandas(run, kinds))
    v = done.select("mesh_id", F.posexplode("points").alias("k", "p")).select("mesh_id", F.col("k").cast("long").alias("vertex_index"), *[F.element_at("p", i + 1).alias(x) for i, x in enumerate("xyz")])
    f = done.select("mesh_id", F.posexplode("triples").alias("k", "t")).select("mesh_id", F.col("k").cast("long").alias("face_index"), *[F.element_at("t", i + 1).alias(f"v{i}") for i in range(3)])
    return v, f, done.select("mesh_id", "note_a", "note_b")


def welded(points: np.ndarray, tolerance: float) -> np.ndarray:
    """For each point the earliest kept point within tolerance, itself if there is none; points in order."""
    cells: dict[tuple[int, int, int], list[int]] = {}
    out = np.arange(len(points))
    for k, p in enumerate(points):
        c = tuple(np.floor(p / tolerance).astype(int))
        near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((c[0] + dx, c[1] + dy, c[2] + dz), ())]
        near = [j for j in near if ((points[j] - p) ** 2).sum() <= tolerance * tolerance]
        if near:
            out[k] = min(near)
        else:
            cells.setdefault(c, []).append(k)
    return out


def weld(vertices: DataFrame, faces: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices within tolerance of an earlier one become that one; notes: vertices before and after."""

    def change(p, t):
        to = welded(p, tolerance)
        kept = np.unique(to)
        new = np.searchsorted(kept, to)
        return p[kept], new[t], (len(p), len(kept))

    return _per_mesh(vertices, faces, change)


def rewind(points: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Faces turned so that neighbours agree and closed parts face outward; how many were turned, edges left unresolved."""
    triples = triples.copy()
    by_edge: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, t in enumerate(triples):
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            by_edge.setdefault((min(a, b), max(a, b)), []).append((k, 1 if a < b else -1))
    unresolved = sum(len(x) != 2 for x in by_edge.values())
    near: dict[int, list[tuple[int, bool]]] = {}
    open_faces = set()
    for faces in by_edge.values():
        if len(faces) == 2:
            (i, x), (j, y) = faces
            near.setdefault(i, []).append((j, x == y))
            near.setdefault(j, []).append((i, x == y))
        else:
            open_faces |= {k for k, _ in faces}
    turned = np.zeros(len(triples), bool)
    seen = np.zeros(len(triples), bool)
    for s in range(len(triples)):
        if seen[s]:
            continue
        part, at = [s], 0
        seen[s] = True
        while at < len(part):
            for j, flip in near.get(part[at], ()):
                if not seen[j]:
                    seen[j] = True
                    turned[j] = turned[part[at]] ^ flip
                    part.append(j)
            at += 1
        if not open_faces.intersection(part):
            t = triples[part].copy()
            t[turned[part]] = t[turned[part]][:, [0, 2, 1]]
            if (points[t[:, 0]] * np.cross(points[t[:, 1]], points[t[:, 2]])).sum() < 0:
                turned[part] = ~turned[part]
    triples[turned] = triples[turned][:, [0, 2, 1]]
    return triples, int(turned.sum()), unresolved


def heal(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6, weld_tolerance: float = 0.0, winding: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair, weld if asked for, repair again, turn faces; and the audit of what came out."""
    v, f = repair(vertices, faces, tolerance)
    if weld_tolerance > 0:
        v, f, _ = weld(v, f, weld_tolerance)
        v, f = repair(v, f, tolerance)
    if winding:
        v, f, _ = _per_mesh(v, f, lambda p, t: (lambda r: (p, r[0], (r[1], r[2])))(rewind(p, t)))
    return v, f, audit(v, f, tolerance)


def clip_polygon(points: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The part of a convex polygon inside a box, plane after plane."""
    for axis in range(3):
        for limit, side in ((lo[axis], 1), (hi[axis], -1)):
            out = []
            for a, b in zip(points, points[1:] + points[:1], strict=True):
                da, db = side * (a[axis] - limit), side * (b[axis] - limit)
                if da >= 0:
                    out.append(a)
                if (da >= 0) != (db >= 0):
                    out.append(a + (b - a) * (da / (da - db)))
            points = out
            if not points:
                return []
    return points


def clip(vertices: DataFrame, faces: DataFrame, lo: tuple[float, float, float], hi: tuple[float, float, float], tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meshes inside a box, cut polygons as fans; notes: faces left out, faces cut."""
    low, high = np.array(lo, float), np.array(hi, float)

    def change(p, t):
        points, triples, gone, cut = [], [], 0, 0
        for tri in t:
            own = [p[i] for i in tri]
            part = clip_polygon(own, low, high)
            if len(part) < 3:
                gone += 1
                continue
            cut += len(part) != 3 or any((a != b).any() for a, b in zip(part, own, strict=False))
            base = len(points)
            points += part
            triples += [(base, base + k, base + k + 1) for k in range(1, len(part) - 1)]
        points = np.array(points, float).reshape(-1, 3)
        to = welded(points, tolerance) if tolerance > 0 else np.arange(len(points))
        kept = np.unique(to)
        new = np.searchsorted(kept, to)[np.array(triples, np.int64).reshape(-1, 3)] if triples else np.zeros((0, 3), np.int64)
        return points[kept], new, (gone, cut)

    return _per_mesh(vertices, faces, change)


def surface_grid(vertices: DataFrame, faces: DataFrame, target: float, offset: float = 0.0, first_id: int = 1, levels: int = 48) -> DataFrame:
    """Faces split at their longest edges until none is longer than target: cells with centre, normal and area.

    sensor_id runs from first_id by face and by order of splitting, the first
    part first.  Each round splits all faces that are too long at once.
    """
    rows = face_flags(vertices, faces).where("flag = 0").select("mesh_id", F.col("face_index").alias("source_face"), F.lit("").alias("path"), *[F.col(f"p{k}{x}").alias(f"{c}{x}") for k, c in enumerate("abc") for x in "xyz"])
    done: DataFrame | None = None
    for _ in range(levels + 1):
        ab, bc, ca = (norm(sub(vec(y), vec(x))) for x, y in (("a", "b"), ("b", "c"), ("c", "a")))
        rows = rows.withColumn("ab", ab).withColumn("bc", bc).withColumn("ca", ca)
        long = F.greatest("ab", "bc", "ca") > target
        small = rows.where(~long).drop("ab", "bc", "ca")
        done = small if done is None else done.unionByName(small)
        rest = rows.where(long)
        if rest.isEmpty():
            break
        # the longest edge xy (ab before bc before ca) is halved: x, half, z and half, y, z
        pick = lambda at_ab, at_bc, at_ca: F.when((F.col("ab") >= F.col("bc")) & (F.col("ab") >= F.col("ca")), at_ab).when(F.col("bc") >= F.col("ca"), at_bc).otherwise(at_ca)
        corner = lambda i: tuple(pick(*[F.col(f"{'abc'[(i + s) % 3]}{x}") for s in range(3)]) for x in "xyz")
        x, y, z = corner(0), corner(1), corner(2)
        half = tuple((p + q) / 2 for p, q in zip(x, y, strict=True))
        part = lambda n, pts: F.struct(F.concat("path", F.lit(str(n))).alias("path"), *[v.alias(f"{c}{a}") for c, p in zip("abc", pts, strict=True) for v, a in zip(p, "xyz", strict=True)])
        rows = rest.select("mesh_id", "source_face", F.inline(F.array(part(0, (x, half, z)), part(1, (half, y, z)))))
        # plans grow with each round; a checkpoint in the shared folder cuts them
        if rows.sparkSession.sparkContext.getCheckpointDir():
            rows = rows.checkpoint()
    n = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    size = norm(n)
    unit = tuple(c / size for c in n)
    centre = tuple((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in "xyz")
    nth = F.row_number().over(Window.partitionBy("mesh_id").orderBy("source_face", "path"))
    return done.select("mesh_id", (nth - 1 + first_id).cast("long").alias("sensor_id"), "source_face", F.length("path").alias("depth"), *[f"{c}{x}" for c in "abc" for x in "xyz"], *[(c + u * offset).alias(f"p{x}") for c, u, x in zip(centre, unit, "xyz", strict=True)], *[u.alias(f"n{x}") for u, x in zip(unit, "xyz", strict=True)], (size / 2).alias("area"))
