"""Physical plans of the ray-triangle join.

``nested``: triangles are broadcast and tested against each ray: the reference
for the other plans.  Only for a number of triangles under ``NESTED_TRIANGLES``,
which is counted first.
``voxel``: triangles are listed in all cells of a grid that their boxes touch,
rays in all cells that they cross (from the sorted parameters of the crossings of
the grid's planes, in SQL expressions), and both meet by an equality join on the
cell.  Neither side is broadcast; hot cells are split by adaptive execution.
``bvh``: rays walk a broadcast hierarchy; for scenes of a counted, bounded size.
``auto`` takes ``bvh`` while the triangles fit, ``voxel`` beyond that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.vector import box_entry, intersect, vec

#: Triangles that are broadcast at most (about 150 bytes each).  Each ray is tested against all, for reference and for tests.
NESTED_TRIANGLES = 200_000
#: Cells on the longest side of the scene at most.
MOST_CELLS = 512
_CORNERS = ("a", "b", "c")
_TRIANGLE = ["object_id", "instance_id", "mesh_id", "triangle_id", *[f"{c}{x}" for c in _CORNERS for x in "xyz"], "category_mask", "mirrored"]


def _tests(excluding: Column | None) -> tuple[dict[str, Column], Column]:
    hit = intersect(vec("o"), vec("d"), vec("t_a"), vec("t_b"), vec("t_c"))
    ok = hit["accept"] & (hit["t"] >= F.col("t_min")) & (hit["t"] <= F.col("t_max")) & (F.col("category_mask").bitwiseAND(F.col("t_category_mask")) != 0)
    if excluding is not None:
        ok = ok & (F.col("t_object_id") != excluding)
    return hit, ok


def _hits(joined: DataFrame, keys: list[str], hit: dict[str, Column], carry: list[str]) -> DataFrame:
    front = F.when(F.col("t_mirrored"), hit["det"] < 0).otherwise(hit["det"] > 0)
    return joined.select(*keys, *carry, hit["t"].alias("distance"), hit["u"].alias("u"), hit["v"].alias("v"), *[F.col(f"t_{c}").alias(c) for c in ("object_id", "instance_id", "mesh_id", "triangle_id")], front.alias("front_face"))


def _prefixed(triangles: DataFrame) -> DataFrame:
    return triangles.select(*[F.col(c).alias(f"t_{c}") for c in _TRIANGLE])


def nested_hits(rays: DataFrame, triangles: DataFrame, keys: list[str], carry: list[str], excluding: Column | None) -> DataFrame:
    hit, ok = _tests(excluding)
    return _hits(rays.join(F.broadcast(_prefixed(triangles)), ok, "inner"), keys, hit, carry)


def _box(triangles: DataFrame):
    lo = [F.least(*[F.col(f"t_{c}{x}") for c in _CORNERS]) for x in "xyz"]
    hi = [F.greatest(*[F.col(f"t_{c}{x}") for c in _CORNERS]) for x in "xyz"]
    return lo, hi


def voxel_hits(rays: DataFrame, triangles: DataFrame, keys: list[str], carry: list[str], excluding: Column | None, cell: float | None = None) -> DataFrame:
    tris = _prefixed(triangles)
    lo, hi = _box(tris)
    bounds = tris.agg(*[F.min(c).alias(f"lo{k}") for k, c in enumerate(lo)], *[F.max(c).alias(f"hi{k}") for k, c in enumerate(hi)], F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        return nested_hits(rays, triangles, keys, carry, excluding)
    corner = [bounds[f"lo{k}"] for k in range(3)]
    far = [bounds[f"hi{k}"] for k in range(3)]
    size = [max(b - a, 0.0) for a, b in zip(corner, far, strict=True)]
    longest = max(*size, 1e-6)
    cell = cell or max(longest / MOST_CELLS, longest / max(2.0, bounds["n"] ** 0.5))
    slack = 1e-9 * max(longest, *map(abs, corner), *map(abs, far))
    at = lambda x, k: F.floor((x - corner[k]) / cell)
    axes = [F.explode(F.sequence(at(lo[k] - slack, k), at(hi[k] + slack, k))).alias(f"g{k}") for k in range(3)]
    listed = tris
    for a in axes:  # one generator for each selection
        listed = listed.select("*", a)

    o, d = vec("o"), vec("d")
    first, last = box_entry(o, d, tuple(F.lit(c - slack) for c in corner), tuple(F.lit(c + slack) for c in far), F.col("t_min"), F.col("t_max"))
    inside = rays.select(*keys, *[c for c in carry if c not in keys], "ox", "oy", "oz", "dx", "dy", "dz", "t_min", "t_max", "category_mask", *([excluding.alias("w_excluded")] if excluding is not None else []), first.alias("w_in"), last.alias("w_out")).where("w_in <= w_out")
    crossings = []

    def plane(k: int):
        return lambda g: (corner[k] + g * cell - o[k]) / d[k]

    for k in range(3):
        a = F.floor((F.least(o[k] + d[k] * F.col("w_in"), o[k] + d[k] * F.col("w_out")) - corner[k]) / cell)
        b = F.ceil((F.greatest(o[k] + d[k] * F.col("w_in"), o[k] + d[k] * F.col("w_out")) - corner[k]) / cell)
        steps = F.transform(F.sequence(a, b), plane(k))
        crossings.append(F.when(F.abs(d[k]) > 1e-12, steps).otherwise(F.array().cast("array<double>")))
    ts = F.array_sort(F.array_distinct(F.concat(F.array("w_in", "w_out"), F.filter(F.concat(*crossings), lambda t: (t > F.col("w_in")) & (t < F.col("w_out"))))))
    walked = inside.withColumn("w_ts", ts)
    mids = F.when(F.size("w_ts") > 1, F.transform(F.slice("w_ts", F.lit(2), F.size("w_ts") - 1), lambda t, i: (t + F.element_at("w_ts", i + 1)) / 2)).otherwise(F.col("w_ts"))
    cells = F.array_distinct(F.transform(mids, lambda t: F.struct(*[at(o[k] + d[k] * t, k).alias(f"g{k}") for k in range(3)])))
    walked = walked.select("*", F.inline(cells)).drop("w_ts", "w_in", "w_out")
    hit, ok = _tests(F.col("w_excluded") if excluding is not None else None)
    found = _hits(walked.join(listed, ["g0", "g1", "g2"]).where(ok), keys, hit, carry)
    # a triangle is met once for each cell that it shares with the ray
    return found.dropDuplicates([*keys, "object_id", "instance_id", "triangle_id"])


def chosen(strategy: str, triangles: DataFrame) -> str:
    """The plan that ``auto`` stands for with these triangles, which are counted up to the bound."""
    if strategy != "auto":
        return strategy
    from solvane.plans.bvh import BVH_TRIANGLES

    return "bvh" if triangles.limit(BVH_TRIANGLES + 1).count() <= BVH_TRIANGLES else "voxel"


def ray_hits(rays: DataFrame, triangles: DataFrame, keys: list[str], carry: list[str] | None = None, strategy: str = "auto", excluding: Column | None = None) -> DataFrame:
    """All accepted hits: keys, carried ray columns, distance, u, v, ids of the triangle, front_face."""
    carry, strategy = carry or [], chosen(strategy, triangles)
    if strategy == "bvh":
        from solvane.plans.bvh import bvh_hits

        return bvh_hits(rays, triangles, keys, carry, excluding)
    # rays are dealt out by their keys: their expressions are computed once, below the exchange; by number, since the work is in the
    # tests and not in the rays' few bytes, by which adaptive execution would bring them together again
    rays = rays.repartition(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    if strategy == "nested":
        if triangles.limit(NESTED_TRIANGLES + 1).count() > NESTED_TRIANGLES:
            raise ValueError("too many triangles for this plan; take voxel")
        return nested_hits(rays, triangles, keys, carry, excluding)
    if strategy == "voxel":
        return voxel_hits(rays, triangles, keys, carry, excluding)
    raise ValueError(f"unknown strategy {strategy}")


def default_cell(n_triangles: int, extent: float) -> float:
    """The grid's cell side for a scene."""
    return max(extent / MOST_CELLS, extent / max(2.0, math.sqrt(n_triangles)))
