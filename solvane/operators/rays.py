"""Ray queries: closest, any, excluding an object, ordered transmission, and parity of plans.

Rays are rows with o*, d* (unit), t_min, t_max, category_mask and key columns;
distances are equal or compared exactly, ties go to the smallest (object_id,
instance_id, triangle_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.core import NO_ID, NO_TRIANGLE
from solvane.plans.ray_plans import chosen, ray_hits

#: Transmission walks on at least so far behind a hit.
STEP = 1e-7


def closest(rays: DataFrame, triangles: DataFrame, keys: list[str], strategy: str = "auto", excluding: Column | None = None, carry: list[str] | None = None, active: Column | None = None, dealt: bool = False) -> DataFrame:
    """A row for each ray: keys, carried columns, hit, distance (null for a miss), u, v, ids (0 and 4294967295 for a miss), front_face.

    Rays for which active is not true are not traced and miss.  Where rays are dealt
    out to tasks already, the hierarchy's plan does not shuffle them again.
    """
    carry, strategy = carry or [], chosen(strategy, triangles)
    if strategy == "bvh":
        from solvane.plans.bvh import bvh_closest

        return bvh_closest(rays, triangles, keys, carry, excluding, active, dealt)
    found = ray_hits(rays if active is None else rays.where(active), triangles, keys, strategy=strategy, excluding=excluding)
    first = F.min(F.struct("distance", "object_id", "instance_id", "triangle_id", "mesh_id", "u", "v", "front_face"))
    best = found.groupBy(*keys).agg(first.alias("h"))
    rows = rays.select(*keys, *carry).join(best, keys, "left")
    hit = F.col("h").isNotNull()
    ids = [F.coalesce(F.col(f"h.{c}"), F.lit(NO_ID).cast("long")).alias(c) for c in ("object_id", "instance_id", "mesh_id")]
    return rows.select(*keys, *carry, hit.alias("hit"), F.col("h.distance").alias("distance"), F.col("h.u").alias("u"), F.col("h.v").alias("v"), *ids, F.coalesce(F.col("h.triangle_id"), F.lit(NO_TRIANGLE)).alias("triangle_id"), F.coalesce(F.col("h.front_face"), F.lit(False)).alias("front_face"))


def any_hit(rays: DataFrame, triangles: DataFrame, keys: list[str], strategy: str = "auto", excluding: Column | None = None) -> DataFrame:
    """(keys, blocked) of each ray; equal hits are brought together before rays meet them."""
    if chosen(strategy, triangles) == "bvh":
        return closest(rays, triangles, keys, "bvh", excluding).select(*keys, F.col("hit").alias("blocked"))
    found = ray_hits(rays, triangles, keys, strategy=strategy, excluding=excluding).select(*keys).distinct().withColumn("blocked", F.lit(True))
    return rays.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("blocked", F.lit(False)).alias("blocked"))


def with_transmittance(triangles: DataFrame, materials: DataFrame, assignment: DataFrame, channel: str = "solar_t") -> DataFrame:
    """Triangles (or hits) with the transmittance of their objects as coefficient; objects without material are opaque."""
    known = assignment.join(materials, "material_id").select("object_id", F.col(channel).alias("coefficient"))
    return triangles.join(known, "object_id", "left").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))


def layered(rays: DataFrame, triangles: DataFrame, keys: list[str], materials: DataFrame, assignment: DataFrame, channel: str = "solar_t", strategy: str = "auto", excluding: Column | None = None, carry: list[str] | None = None, active: Column | None = None, dealt: bool = False) -> DataFrame:
    """(keys, carried columns, layers) of each ray: all its hits in order, with their objects' coefficients; a miss has no layers.

    Triangles may have their coefficients already (``with_transmittance``), so that several analyses share a scene.
    Where rays are dealt out to tasks already, the hierarchy's plan does not shuffle them again.
    """
    carry, strategy = carry or [], chosen(strategy, triangles)
    if strategy == "bvh":
        from solvane.plans.bvh import bvh_layers

        return bvh_layers(rays, triangles if "coefficient" in triangles.columns else with_transmittance(triangles, materials, assignment, channel), keys, carry, excluding, active, dealt)
    hits = with_transmittance(ray_hits(rays if active is None else rays.where(active), triangles, keys, strategy=strategy, excluding=excluding), materials, assignment, channel)
    layers = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("distance", "object_id", "instance_id", "triangle_id", "coefficient"))).alias("layers"))
    none = F.array().cast(layers.schema["layers"].dataType)
    return rays.select(*keys, *carry).join(layers, keys, "left").withColumn("layers", F.coalesce("layers", none))


def folded(layers: Column, t_max: Column, tolerance: float, cutoff: float, max_layers: int, excluding: Column | None = None) -> Column:
    """Walks sorted layers(distance, object_id, coefficient) front to back.

    Gives travelled, transmission, limit and the layers that took a loss, each
    with its attributed loss T (1 - c).  A layer counts if it is not nearer than
    the place reached; the walk stops at an opaque layer, below the cutoff, past
    t_max, or at the layer cap, which sets limit.
    """
    step = max(tolerance, STEP)
    cap = min(max(max_layers, 1), 64)
    kept = layers if excluding is None else F.filter(layers, lambda x: x["object_id"] != excluding)
    kind = "array<struct<object_id:bigint,distance:double,loss:double>>"
    zero = F.struct(F.lit(0.0).alias("travelled"), F.lit(1.0).alias("transmission"), F.lit(False).alias("done"), F.lit(False).alias("limit"), F.array().cast(kind).alias("losses"))

    def walk(acc: Column, x: Column) -> Column:
        live = ~acc["done"] & (x["distance"] >= acc["travelled"]) & (x["distance"] <= t_max)
        full = F.size(acc["losses"]) >= cap
        take = live & ~full
        left = F.when(take, acc["transmission"] * x["coefficient"]).otherwise(acc["transmission"])
        loss = F.struct(x["object_id"].alias("object_id"), x["distance"].alias("distance"), (acc["transmission"] * (1 - x["coefficient"])).alias("loss"))
        return F.struct(
            F.when(take, x["distance"] + step).otherwise(acc["travelled"]).alias("travelled"),
            F.when(take & (x["coefficient"] <= 0), F.lit(0.0)).otherwise(left).alias("transmission"),
            (acc["done"] | (live & full) | (take & ((x["coefficient"] <= 0) | (left <= cutoff)))).alias("done"),
            (acc["limit"] | (live & full)).alias("limit"),
            F.when(take, F.concat(acc["losses"], F.array(loss))).otherwise(acc["losses"]).alias("losses"),
        )

    return F.aggregate(kept, zero, walk)


def transmission(rays: DataFrame, triangles: DataFrame, keys: list[str], materials: DataFrame, assignment: DataFrame, channel: str = "solar_t", tolerance: float = 1e-6, cutoff: float = 1e-4, max_layers: int = 8, strategy: str = "auto", excluding: Column | None = None, carry: list[str] | None = None, active: Column | None = None) -> DataFrame:
    """(keys, carried columns, transmission, layer_count, limit_reached, losses) of each ray; 1 and no layers where it is not active."""
    carry = carry or []
    far = [] if "t_max" in carry else ["t_max"]
    rows = layered(rays, triangles, keys, materials, assignment, channel, strategy, excluding, [*carry, *far], active)
    walked = rows.select(*keys, *carry, folded(F.col("layers"), F.col("t_max"), tolerance, cutoff, max_layers).alias("w"))
    return walked.select(*keys, *carry, F.col("w.transmission").alias("transmission"), F.size("w.losses").alias("layer_count"), F.col("w.limit").alias("limit_reached"), F.col("w.losses").alias("losses"))


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row on how two results of ``closest`` agree: states, identities on mutual hits, distance errors."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("hit", "distance", "object_id", "instance_id", "triangle_id")])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("hit", "distance", "object_id", "instance_id", "triangle_id")])
    both = a.join(b, keys, "full_outer").withColumn("mutual", F.coalesce(F.col("a_hit") & F.col("b_hit"), F.lit(False)))
    other = (F.col("a_object_id") != F.col("b_object_id")) | (F.col("a_instance_id") != F.col("b_instance_id")) | (F.col("a_triangle_id") != F.col("b_triangle_id"))
    error = F.when(F.col("mutual"), F.abs(F.col("a_distance") - F.col("b_distance")))
    return both.agg(F.count(F.lit(1)).alias("rays"), F.count_if(~F.col("a_hit").eqNullSafe(F.col("b_hit"))).alias("state_mismatches"), F.count_if(F.col("mutual") & other).alias("identity_mismatches"), F.max(error).alias("max_distance_error"), F.avg(error).alias("mean_distance_error"))
