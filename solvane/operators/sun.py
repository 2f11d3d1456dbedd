"""Direct sun, sky view, solar scenarios, envelopes and PV.

All analyses share one shape: entities times a domain give a timeline with a
state; only rows that need a ray are traced, and hits are joined back; summaries,
dominant occluders and attributions are aggregates of the timeline.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.functions.sampling import hemisphere
from solvane.functions.vector import Vec, add, cross, dot, named, ratio, scale, sub, tangents, vec
from solvane.core import dealt, large, small
from solvane.operators.ordering import running
from solvane.operators.rays import closest, transmission

INFINITE = 1e300


def rays_from(timeline: DataFrame, offset: float, max_distance: float, mask: int = -1) -> DataFrame:
    """Ray columns of timeline rows: from p + n offset towards d."""
    o = add(vec("p"), scale(vec("n"), F.lit(offset)))
    return timeline.select("*", *[c.alias(f"o{x}") for c, x in zip(o, "xyz", strict=True)], F.lit(0.0).alias("t_min"), F.lit(float(max_distance)).alias("t_max"), F.lit(mask).cast("long").alias("category_mask"))


def dominant(blocked: DataFrame, keys: list[str], weight: Column, name: str = "dominant_object_id") -> DataFrame:
    """(keys, name): the object with the largest sum of weights; ties go to the smallest id."""
    each = blocked.groupBy(*keys, "object_id").agg(F.sum(weight).alias("w"))
    return each.groupBy(*keys).agg(F.max_by("object_id", F.struct("w", -F.col("object_id"))).alias(name))


def direct_sun_timeline(sensors: DataFrame, suns: DataFrame, triangles: DataFrame, offset: float = 1e-4, max_distance: float = INFINITE, min_cosine: float = 0.0, mask: int = -1, strategy: str = "auto") -> DataFrame:
    """(sensor_id, sun_index, state, cosine, hours, object_id, distance): inactive, back_facing, visible or blocked."""
    s = suns.select("sun_index", "dx", "dy", "dz", (F.col("duration_hours") * F.col("weight")).alias("hours"), "is_active")
    rows = sensors.crossJoin(small(s))
    cosine = dot(vec("n"), vec("d"))
    rows = rows.withColumn("cosine", cosine).withColumn("early", F.when(~F.col("is_active"), "inactive").when(F.col("cosine") <= min_cosine, "back_facing"))
    out = closest(rays_from(rows, offset, max_distance, mask), triangles, ["sensor_id", "sun_index"], strategy, carry=["early", "cosine", "hours"], active=F.col("early").isNull())
    state = F.coalesce("early", F.when(F.col("hit"), "blocked").otherwise("visible"))
    return out.select("sensor_id", "sun_index", state.alias("state"), "cosine", "hours", "object_id", "distance")


def direct_sun_summary(timeline: DataFrame) -> DataFrame:
    """A row for each sensor: direct, shadow and eligible hours, their ratio, the dominant occluder by hours.

    The timeline is read once: sums by sensor and occluder first, then by sensor.
    """
    hours = lambda state: F.sum(F.when(F.col("state") == state, F.col("hours")).otherwise(0.0))
    each = timeline.groupBy("sensor_id", F.when(F.col("state") == "blocked", F.col("object_id")).alias("o")).agg(hours("visible").alias("d"), hours("blocked").alias("s"))
    top = F.max_by("o", F.when(F.col("o").isNotNull(), F.struct("s", -F.col("o"))))
    out = each.groupBy("sensor_id").agg(F.sum("d").alias("direct_hours"), F.sum("s").alias("shadow_hours"), top.alias("o")).withColumn("eligible_hours", F.col("direct_hours") + F.col("shadow_hours"))
    return out.select("sensor_id", "direct_hours", "shadow_hours", "eligible_hours", ratio(F.col("direct_hours"), F.col("eligible_hours")).alias("direct_ratio"), F.coalesce("o", F.lit(0).cast("long")).alias("dominant_object_id"))


def in_basis(n: Vec, local: Vec) -> Vec:
    """A local direction (z along n) in world coordinates, where the basis t*, b* of n is at hand."""
    return add(add(scale(vec("t"), local[0]), scale(vec("b"), local[1])), scale(n, local[2]))


def with_basis(entities: DataFrame, n: str) -> DataFrame:
    """Two tangents t*, b* of the direction n*, once for each entity and not for each of its samples."""
    t, _ = tangents(vec(n))
    rows = entities.select("*", *named(t, "t"))
    return rows.select("*", *named(cross(vec(n), vec("t")), "b"))


def directed(entities: DataFrame, directions: DataFrame) -> DataFrame:
    """Entities times directions (idx, lx, ly, lz), with d* about each entity's normal."""
    rows = with_basis(entities, "n").crossJoin(small(directions))
    d = in_basis(vec("n"), vec("l"))
    return rows.select("*", *[c.alias(f"d{x}") for c, x in zip(d, "xyz", strict=True)])


def sky_view_timeline(sensors: DataFrame, triangles: DataFrame, samples: int = 2048, seed: int = 0, offset: float = 1e-4, max_distance: float = INFINITE, mask: int = -1, strategy: str = "auto", directions: DataFrame | None = None) -> DataFrame:
    """(sensor_id, idx, d*, lz, visible, object_id): the shadow mask of each sensor."""
    directions = directions if directions is not None else hemisphere(sensors.sparkSession, samples, seed)
    rows = directed(sensors, directions)
    out = closest(rays_from(rows, offset, max_distance, mask), triangles, ["sensor_id", "idx"], strategy, carry=["dx", "dy", "dz", "lz"])
    return out.select("sensor_id", "idx", "dx", "dy", "dz", "lz", (~F.col("hit")).alias("visible"), "object_id", "distance")


def sky_view_summary(timeline: DataFrame) -> DataFrame:
    """A row for each sensor: visible fraction, cosine-weighted factor, solid angle, even-odd deltas, dominant occluder."""
    one, seen, w = F.lit(1.0), F.col("visible").cast("double"), F.col("lz")
    even = F.col("idx") % 2 == 0
    parts = {"n": one, "s": seen, "w": w, "sw": seen * w}
    sums = [F.sum(x).alias(k) for k, x in parts.items()] + [F.sum(F.when(even, x).otherwise(0.0)).alias(f"{k}_even") for k, x in parts.items()]
    each = timeline.groupBy("sensor_id", F.when(~F.col("visible"), F.col("object_id")).alias("o")).agg(*sums)
    names = [f"{k}{t}" for t in ("", "_even") for k in parts]
    top = F.max_by("o", F.when(F.col("o").isNotNull(), F.struct("w", -F.col("o"))))
    out = each.groupBy("sensor_id").agg(*[F.sum(k).alias(f"t_{k}") for k in names], top.alias("o"))
    t = lambda k: F.col(f"t_{k}")
    odd = lambda k: t(k) - t(f"{k}_even")
    fraction, factor = ratio(t("s"), t("n")), ratio(t("sw"), t("w"))
    return out.select(
        "sensor_id",
        t("n").cast("long").alias("samples"),
        fraction.alias("visible_fraction"),
        factor.alias("sky_view_factor"),
        (2 * math.pi * fraction).alias("visible_solid_angle"),
        F.abs(ratio(t("s_even"), t("n_even")) - ratio(odd("s"), odd("n"))).alias("fraction_delta"),
        F.abs(ratio(t("sw_even"), t("w_even")) - ratio(odd("sw"), odd("w"))).alias("factor_delta"),
        F.coalesce("o", F.lit(0).cast("long")).alias("dominant_object_id"),
    )


def scenario_timeline(sensors: DataFrame, suns: DataFrame, triangles: DataFrame, scenarios: DataFrame, offset: float = 1e-4, max_distance: float = INFINITE, max_layers: int = 8, cutoff: float = 1e-4, strategy: str = "auto") -> DataFrame:
    """(scenario_id, sensor_id, sun_index, hours, transmission, losses) of eligible rows.

    scenarios(scenario_id, object_id, coefficient) are sets of materials; objects
    without a row are opaque.  Geometry is traced once for all scenarios.
    """
    from solvane.operators.rays import folded
    from solvane.plans.ray_plans import ray_hits

    s = suns.where("is_active").select("sun_index", "dx", "dy", "dz", (F.col("duration_hours") * F.col("weight")).alias("hours"))
    rows = sensors.crossJoin(small(s)).where(dot(vec("n"), vec("d")) > 0)
    keys = ["sensor_id", "sun_index"]
    hits = ray_hits(rays_from(rows, offset, max_distance), triangles, keys, strategy=strategy)
    names = small(scenarios.select("scenario_id").distinct(), 1000)
    per = hits.crossJoin(names).join(scenarios, ["scenario_id", "object_id"], "left").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))
    walked = per.groupBy("scenario_id", *keys).agg(F.array_sort(F.collect_list(F.struct("distance", "object_id", "instance_id", "triangle_id", "coefficient"))).alias("layers"))
    walked = walked.select("scenario_id", *keys, folded(F.col("layers"), F.lit(float(max_distance)), 1e-6, cutoff, max_layers).alias("w"))
    base = rows.select(*keys, "hours").crossJoin(names)
    none = F.array().cast("array<struct<object_id:bigint,distance:double,loss:double>>")
    return base.join(walked, ["scenario_id", *keys], "left").select("scenario_id", *keys, "hours", F.coalesce("w.transmission", F.lit(1.0)).alias("transmission"), F.coalesce("w.losses", none).alias("losses"))


def scenario_summary(timeline: DataFrame) -> DataFrame:
    """A row for each scenario and sensor: eligible, received and lost hours, and deltas against the first scenario."""
    sums = timeline.groupBy("scenario_id", "sensor_id").agg(F.sum("hours").alias("eligible_hours"), F.sum(F.col("hours") * F.col("transmission")).alias("received_hours"))
    sums = sums.withColumn("lost_hours", F.greatest(F.col("eligible_hours") - F.col("received_hours"), F.lit(0.0)))
    first = Window.partitionBy("sensor_id").orderBy("scenario_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.withColumn("received_delta", F.col("received_hours") - F.first("received_hours").over(first)).withColumn("lost_delta", F.col("lost_hours") - F.first("lost_hours").over(first))


def scenario_losses(timeline: DataFrame) -> DataFrame:
    """(scenario_id, sensor_id, object_id, loss): what each object takes."""
    each = timeline.select("scenario_id", "sensor_id", "hours", F.explode("losses").alias("x"))
    return each.groupBy("scenario_id", "sensor_id", F.col("x.object_id").alias("object_id")).agg(F.sum(F.col("hours") * F.col("x.loss")).alias("loss"))


def top_losses(losses: DataFrame, k: int = 10) -> DataFrame:
    """The k largest losses of each scenario and sensor, with their rank and share of all that is lost there."""
    by = Window.partitionBy("scenario_id", "sensor_id")
    ranked = losses.withColumn("rank", F.row_number().over(by.orderBy(F.col("loss").desc(), "object_id"))).withColumn("fraction", ratio(F.col("loss"), F.sum("loss").over(by)))
    return ranked.where(F.col("rank") <= k)


def category_breakdown(losses: DataFrame, objects: DataFrame) -> DataFrame:
    """Losses by object, by exact category mask and in all, in one pass; grouping says which: object, category or total."""
    rows = losses.join(objects.select("object_id", "category_mask"), "object_id", "left")
    out = rows.groupingSets([["scenario_id", "object_id"], ["scenario_id", "category_mask"], ["scenario_id"]], "scenario_id", "object_id", "category_mask").agg(F.sum("loss").alias("loss"), F.grouping("object_id").alias("go"), F.grouping("category_mask").alias("gc"))
    kind = F.when(F.col("go") == 0, "object").when(F.col("gc") == 0, "category").otherwise("total")
    return out.select("scenario_id", kind.alias("grouping"), "object_id", "category_mask", "loss")


def _along(rays: DataFrame, candidates: DataFrame, radius: float, max_distance: float) -> DataFrame:
    """Rays(p*, d*) with the upright axes(b*) whose feet may lie within the radius of their tracks on the ground, each pair once.

    A track has a place at least every cell; a foot within the radius of it is in
    a cell around such a place, since a cell is more than two radii wide.
    """
    cell = max(2.5 * radius, max_distance / 8, 1e-9)
    flat = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    n = F.ceil(flat * max_distance / cell).cast("int")
    at = lambda c, k: F.floor((F.col(f"p{c}") + F.col(f"d{c}") * max_distance * k / F.greatest(n, F.lit(1))) / cell)
    around = lambda k: [F.struct((at("x", k) + i).alias("gx"), (at("y", k) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    cells = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.array(*around(k)))))
    feet = candidates.select("*", *[F.floor(F.col(f"b{c}") / cell).alias(f"g{c}") for c in "xy"])
    return rays.select("*", F.inline(cells)).join(large(feet), ["gx", "gy"]).drop("gx", "gy")


def solar_envelope(candidates: DataFrame, sensors: DataFrame, suns: DataFrame, triangles: DataFrame, radius: float = 0.5, preserve: float = 0.8, shade: float = 0.5, clearance: float = 0.05, max_distance: float = INFINITE, materials: DataFrame | None = None, assignment: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """For each candidate axis (candidate_id, base b*, unit axis a*): how high it may be, and from where it shades.

    A sun ray constrains an axis if its closest approach lies ahead, at an axis
    distance of 0 or more, within the radius and the distance; it weighs its hours
    times what reaches the axis.  access_height is the axis distance at which
    (1 - preserve) of the weight would be lost, less clearance (null: no limit);
    shading_height the one at which the share ``shade`` is, plus clearance.
    """
    s = suns.where("is_active").select("sun_index", "dx", "dy", "dz", (F.col("duration_hours") * F.col("weight")).alias("hours"))
    if max_distance < 1e150 and candidates.where("abs(ax) > 1e-12 or abs(ay) > 1e-12").isEmpty():
        rows = _along(dealt(sensors).crossJoin(small(s)).where(dot(vec("n"), vec("d")) > 0), candidates, radius, max_distance)
    else:
        rows = sensors.crossJoin(candidates).crossJoin(small(s)).where(dot(vec("n"), vec("d")) > 0)
    w = sub(vec("p"), vec("b"))
    da, dw, aw = dot(vec("d"), vec("a")), dot(vec("d"), w), dot(vec("a"), w)
    den = 1 - da * da
    rows = rows.withColumn("ahead", F.when(den > 1e-12, (da * aw - dw) / den)).withColumn("height", F.when(den > 1e-12, (aw - da * dw) / den))
    gap = sub(add(w, scale(vec("d"), F.col("ahead"))), scale(vec("a"), F.col("height")))
    near = rows.withColumn("lateral", F.sqrt(dot(gap, gap))).where(f"ahead > 0 and height >= 0 and lateral <= {radius} and ahead <= {max_distance}")
    keys = ["candidate_id", "sensor_id", "sun_index"]
    spark = sensors.sparkSession
    materials = materials if materials is not None else spark.createDataFrame([], "material_id long, solar_t double")
    assignment = assignment if assignment is not None else spark.createDataFrame([], "object_id long, material_id long")
    traced = transmission(rays_from(near, 1e-4, max_distance).withColumn("t_max", F.col("ahead")), triangles, keys, materials, assignment, strategy=strategy, carry=["height", "hours"])
    weighed = traced.withColumn("w", F.col("hours") * F.col("transmission")).where("w > 0")
    order = Window.partitionBy("candidate_id").orderBy("height", "sensor_id", "sun_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = weighed.withColumn("cum", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy("candidate_id")))
    at = lambda share: F.min(F.when(F.col("cum") >= F.col("total") * share, F.struct("height", "sensor_id", "sun_index")))
    found = cum.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("constraints"), F.max("total").alias("weight"), at(1 - preserve).alias("access"), at(shade).alias("shading"))
    out = candidates.select("candidate_id").join(found, "candidate_id", "left")
    return out.select("candidate_id", F.coalesce("constraints", F.lit(0)).alias("constraints"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.when(F.col("access").isNotNull(), F.greatest(F.col("access.height") - clearance, F.lit(0.0))).alias("access_height"), (F.col("shading.height") + clearance).alias("shading_height"), F.col("access.sensor_id").alias("control_sensor_id"), F.col("access.sun_index").alias("control_sun_index"))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Step quantiles: the first value at which the running weight reaches its share of the whole."""
    run = running(rows, keys, value, weight)
    reached = F.col("before") + F.col("weight")
    return run.groupBy(*keys).agg(*[F.min(F.when(reached >= F.col("total") * q, F.col(value))).alias(n) for n, q in shares.items()])


def pv_potential(cells: DataFrame, threshold: float = 800_000.0, efficiency: float = 0.22, coverage: float = 0.85, loss: float = 0.14) -> DataFrame:
    """One row of eligible cells(sensor_id, area, energy in Wh/m2): area, mean and quantiles, kWp and kWh."""
    ok = cells.where(F.col("energy") >= threshold)
    q = weighted_quantiles(ok, [], "energy", "area", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    total = ok.agg(F.count(F.lit(1)).alias("cells"), F.sum("area").alias("area"), F.sum(F.col("area") * F.col("energy")).alias("energy_wh"))
    out = total.crossJoin(F.broadcast(q)).withColumn("mean", ratio(F.col("energy_wh"), F.col("area")))  # one row each
    return out.select("cells", "area", "mean", "p10", "p50", "p90", (F.col("energy_wh") / 1000).alias("incident_kwh"), (F.col("area") * coverage * efficiency).alias("kwp"), (F.col("energy_wh") / 1000 * efficiency * coverage * (1 - loss)).alias("yield_kwh"))


def pv_regions(cells: DataFrame, neighbours: DataFrame, threshold: float = 800_000.0) -> DataFrame:
    """Eligible cells with region: edge-connected groups, numbered by their first cells. neighbours(i, j) by sensor_id."""
    from solvane.operators.graphs import components

    ok = cells.where(F.col("energy") >= threshold)
    ids = ok.select("sensor_id")
    links = neighbours.join(ids.withColumnRenamed("sensor_id", "i"), "i", "left_semi").join(ids.withColumnRenamed("sensor_id", "j"), "j", "left_semi")
    found = components(links.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("v", "sensor_id")
    named = ok.join(found, "sensor_id", "left").withColumn("first_cell", F.coalesce("comp", "sensor_id"))
    numbers = named.select("first_cell").distinct().withColumn("region", F.row_number().over(Window.orderBy("first_cell")))
    return named.join(numbers, "first_cell").select("sensor_id", "area", "energy", "first_cell", "region")


def cell_neighbours(cells: DataFrame, digits: int = 6) -> DataFrame:
    """(i, j) of cells(sensor_id, a*, b*, c*) that share an edge, by corners rounded to digits."""
    point = lambda c: F.concat_ws(",", *[F.round(F.col(f"{c}{x}"), digits).cast("string") for x in "xyz"])
    edge = lambda x, y: F.concat_ws(";", F.array_sort(F.array(point(x), point(y))))
    e = cells.select("sensor_id", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("edge"))
    return e.alias("x").join(e.alias("y"), (F.col("x.edge") == F.col("y.edge")) & (F.col("x.sensor_id") < F.col("y.sensor_id"))).select(F.col("x.sensor_id").alias("i"), F.col("y.sensor_id").alias("j")).distinct()
