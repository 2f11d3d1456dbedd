"""Isovists, intervisibility, visibility graphs, target views, corridors, paths, landmarks, comparison."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.core import dealt, few, large, small
from solvane.functions.sampling import circle, disk, sphere, triangle_points
from solvane.functions.vector import add, cross, dot, field_of_view, in_field, named, norm, ratio, scale, solid_angle, sub, unit, vec
from solvane.operators.rays import closest, folded, layered
from solvane.operators.sun import dominant, top_losses, with_basis


def _rays(rows: DataFrame, far: Column, mask: int = -1) -> DataFrame:
    """Ray columns of rows with a place p* and a unit direction d*."""
    return rows.select("*", *[F.col(f"p{x}").alias(f"o{x}") for x in "xyz"], F.lit(0.0).alias("t_min"), far.alias("t_max"), F.lit(mask).cast("long").alias("category_mask"))


def near_between(a: DataFrame, b: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """Rows of a(p*) with rows of b(q*) within a radius along some axes, and their distance: an equality join on grid cells, each pair found once."""
    cell = lambda place: [F.floor(F.col(f"{place}{c}") / radius).alias(f"g{c}") for c in axes]
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = b.select("*", *cell("q"))
    for c in axes:
        around = around.withColumn(f"s{c}", F.explode(steps)).withColumn(f"g{c}", F.col(f"g{c}") + F.col(f"s{c}")).drop(f"s{c}")
    keys = [f"g{c}" for c in axes]
    apart = tuple(F.col(f"q{c}") - F.col(f"p{c}") if c in axes else F.lit(0.0) for c in "xyz")
    return a.select("*", *cell("p")).join(large(around), keys).drop(*keys).withColumn("distance", norm(apart)).where(F.col("distance") <= radius)


def near_dealt(a: DataFrame, b: DataFrame, radius: float) -> tuple[DataFrame, bool]:
    """Rows of ``near_between``, and whether they are dealt out to tasks.

    They are where b is broadcast, counted first: a's rows are dealt out and meet it
    on the cells around them, so that pairs and rays, many more than rows, are not shuffled.
    """
    if not few(b):
        return near_between(a, b, radius), False
    rows = dealt(a)
    for c in "xyz":
        own = F.floor(F.col(f"p{c}") / radius)
        rows = rows.select("*", F.explode(F.array(*[own + k for k in (-1, 0, 1)])).alias(f"g{c}"))
    keys = [f"g{c}" for c in "xyz"]
    met = rows.join(F.broadcast(b.select("*", *[F.floor(F.col(f"q{c}") / radius).alias(f"g{c}") for c in "xyz"])), keys).drop(*keys)
    return met.withColumn("distance", norm(sub(vec("q"), vec("p")))).where(F.col("distance") <= radius), True


def _toward(rows: DataFrame) -> DataFrame:
    """rows with the unit direction d* from p* to q*, where distance is at hand."""
    d = scale(sub(vec("q"), vec("p")), 1 / F.when(F.col("distance") > 0, F.col("distance")))
    return rows.select("*", *named(d, "d"))


#: States that need no ray: (pairs with a distance) -> state or null.
def _early(clearance: float, max_distance: float) -> Column:
    return F.when(F.col("distance") <= clearance, "coincident").when(F.col("distance") > max_distance, "out_of_range").when(F.col("distance") <= 2 * clearance, "visible")


def _disk_rays(rows: DataFrame, points: DataFrame, radius: str) -> DataFrame:
    """Rays from p* to points(idx, lx, ly) of a disk about q* that stands across the axis a*; reach is the distance to its point."""
    rows = with_basis(rows.withColumnsRenamed({f"a{x}": f"n{x}" for x in "xyz"}), "n").crossJoin(small(points))
    to = add(sub(vec("q"), vec("p")), add(scale(vec("t"), F.col("lx") * F.col(radius)), scale(vec("b"), F.col("ly") * F.col(radius))))
    rows = rows.select("*", *named(to, "v")).withColumn("reach", norm(vec("v")))
    return rows.select("*", *[(F.col(f"v{x}") / F.col("reach")).alias(f"d{x}") for x in "xyz"])


# Isovists in a plane.


def isovist_rays(viewpoints: DataFrame, triangles: DataFrame, samples: int = 720, field_degrees: float = 360.0, max_distance: float = 100.0, strategy: str = "auto", angles: DataFrame | None = None) -> DataFrame:
    """(viewpoint_id, idx, angle, d*, distance, object_id, hit) in the horizontal plane of each viewpoint(viewpoint_id, p*)."""
    a = angles if angles is not None else circle(viewpoints.sparkSession, samples, field_degrees).select("idx", F.cos("angle").alias("dx"), F.sin("angle").alias("dy"), F.lit(0.0).alias("dz"))
    rows = viewpoints.select("viewpoint_id", "px", "py", "pz").crossJoin(small(a))
    names = [c for c in rows.columns if c not in ("viewpoint_id", "idx")]
    hits = closest(_rays(rows, F.lit(float(max_distance))), triangles, ["viewpoint_id", "idx"], strategy, carry=names)
    return hits.select("viewpoint_id", "idx", *names, "hit", "object_id", F.coalesce("distance", F.lit(float(max_distance))).alias("distance"))


def isovist_summary(rays: DataFrame, full_circle: bool = True) -> DataFrame:
    """A row for each viewpoint: polygon area and perimeter, centroid drift, radial moments, compactness, convergence, occluder."""
    rows = rays.select("*", (F.col("dx") * F.col("distance")).alias("x"), (F.col("dy") * F.col("distance")).alias("y"))
    by = Window.partitionBy("viewpoint_id").orderBy("idx")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def polygon(rows: DataFrame, tag: str) -> DataFrame:
        following = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole) if full_circle else F.lit(0.0))
        e = rows.withColumn("x2", following("x")).withColumn("y2", following("y"))
        turn = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
        side = F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")))
        # a field that is not full is closed over the eye, at the origin
        start = F.lit(0.0) if full_circle else F.first("distance")
        return e.groupBy("viewpoint_id").agg((F.abs(F.sum(turn)) / 2).alias(f"area{tag}"), (F.sum(side) + start).alias(f"perimeter{tag}"), F.sum((F.col("x") + F.col("x2")) * turn).alias("mx"), F.sum((F.col("y") + F.col("y2")) * turn).alias("my"), F.sum(turn).alias("mt"))

    shape = polygon(rows, "")
    half = polygon(rows.where("idx % 2 = 0"), "_half").select("viewpoint_id", "area_half")
    r = F.col("distance")
    moments = rows.groupBy("viewpoint_id").agg(F.count(F.lit(1)).alias("samples"), F.avg(r).alias("mean_radius"), F.min(r).alias("min_radius"), F.max(r).alias("max_radius"), F.stddev_pop(r).alias("radius_deviation"), F.coalesce(F.skewness(r), F.lit(0.0)).alias("radius_skewness"))
    top = dominant(rows.where("hit"), ["viewpoint_id"], F.lit(1.0))
    out = shape.join(half, "viewpoint_id").join(moments, "viewpoint_id").join(top, "viewpoint_id", "left").na.fill(0, ["dominant_object_id"])
    drift = lambda m: F.when(F.abs(F.col("mt")) > 0, F.col(m) / (3 * F.col("mt"))).otherwise(0.0)
    compact = F.least(ratio(4 * math.pi * F.col("area"), F.col("perimeter") * F.col("perimeter")), F.lit(1.0))
    return out.select("viewpoint_id", "samples", "area", "perimeter", drift("mx").alias("drift_x"), drift("my").alias("drift_y"), "mean_radius", "min_radius", "max_radius", "radius_deviation", "radius_skewness", compact.alias("compactness"), F.abs(F.col("area") - F.col("area_half")).alias("area_delta"), "dominant_object_id")


# Intervisibility.


def intervisibility(observers: DataFrame, targets: DataFrame, triangles: DataFrame, max_distance: float = 1e300, clearance: float = 1e-4, reference_distance: float = 10.0, facing_exponent: float = 1.0, strategy: str = "auto", far: bool = True) -> DataFrame:
    """(observer_id, target_id, state, distance, risk, object_id) of all pairs of observers(p*, weight) and targets(q*, sensitivity).

    States: coincident, out_of_range, visible, blocked.  Targets with a normal
    m* are weighed by how they face the observer.  Pairs in range meet on grid
    cells and only they are traced; with far = False pairs out of range are left
    out, and ``visibility_counts`` can count them without listing them.
    """
    t = targets.select("target_id", "qx", "qy", "qz", "sensitivity", *(c for c in ("mx", "my", "mz") if c in targets.columns))
    o = observers.select("observer_id", "px", "py", "pz", "weight")
    bounded = max_distance < 1e150
    rows, ready = near_dealt(o, t, max_distance) if bounded else (o.crossJoin(t).withColumn("distance", norm(sub(vec("q"), vec("p")))), False)
    rows = _toward(rows.withColumn("early", _early(clearance, max_distance)))
    facing = F.pow(F.greatest(-dot(vec("m"), vec("d")), F.lit(0.0)), facing_exponent) if "mx" in targets.columns else F.lit(1.0)
    rows = rows.withColumn("gain", F.col("weight") * F.col("sensitivity") * facing).withColumnRenamed("distance", "far")
    out = closest(_rays(rows, F.col("far") - clearance).withColumn("t_min", F.lit(clearance)), triangles, ["observer_id", "target_id"], strategy, carry=["early", "far", "gain"], active=F.col("early").isNull(), dealt=ready)
    near = F.col("far") / reference_distance
    state = F.coalesce("early", F.when(F.col("hit"), "blocked").otherwise("visible"))
    risk = F.when(state == "visible", F.col("gain") / (1 + near * near)).otherwise(0.0)
    out = out.select("observer_id", "target_id", state.alias("state"), F.col("far").alias("distance"), risk.alias("risk"), "object_id")
    if not bounded or not far:
        return out
    beyond = dealt(o).crossJoin(small(t)).withColumn("distance", norm(sub(vec("q"), vec("p")))).where(F.col("distance") > max_distance)
    return out.unionByName(beyond.select("observer_id", "target_id", F.lit("out_of_range").alias("state"), "distance", F.lit(0.0).alias("risk"), F.lit(0).cast("long").alias("object_id")))


def visibility_counts(pairs: DataFrame, key: str, entities: DataFrame | None = None, others: int | None = None) -> DataFrame:
    """A row for each observer or target: pairs by state, visible share without coincident ones, combined and largest risk.

    Where pairs out of range were left out, entities has all keys and others is
    the number of rows on the other side: what is not listed is out of range.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    out = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), n("visible").alias("visible"), n("blocked").alias("blocked"), n("out_of_range").alias("out_of_range"), n("coincident").alias("coincident"), (1 - F.product(1 - F.least("risk", F.lit(1.0)))).alias("combined_risk"), F.max("risk").alias("max_risk"))
    if entities is not None:
        out = entities.select(key).join(out, key, "left").na.fill(0).withColumn("out_of_range", F.col("out_of_range") + others - F.col("pairs")).withColumn("pairs", F.lit(others).cast("long"))
    return out.withColumn("visible_fraction", ratio(F.col("visible").cast("double"), (F.col("pairs") - F.col("coincident")).cast("double")))


# Visibility graphs. Edges are (i, j) with i < j, by nodes' idx.


def graph_pairs(nodes: DataFrame, triangles: DataFrame, max_distance: float = 1e300, clearance: float = 1e-4, strategy: str = "auto", pairs: DataFrame | None = None, far: bool = True) -> DataFrame:
    """(i, j, distance, state) of all unordered pairs of nodes(idx, x, y, z), or of the given pairs(i, j).

    Pairs in range meet on grid cells and only they are traced; with far = False
    pairs out of range are left out.
    """
    a, b = _ends(nodes)
    apart = norm(sub(vec("q"), vec("p")))
    bounded = pairs is None and max_distance < 1e150
    if bounded:
        rows = near_between(a, b, max_distance).where("i < j")
    else:
        rows = (a.join(b, F.col("i") < F.col("j")) if pairs is None else pairs.select("i", "j").join(a, "i").join(b, "j")).withColumn("distance", apart)
    rows = _toward(rows.withColumn("early", _early(clearance, max_distance))).withColumnRenamed("distance", "far")
    out = closest(_rays(rows, F.col("far") - clearance).withColumn("t_min", F.lit(clearance)), triangles, ["i", "j"], strategy, carry=["early", "far"], active=F.col("early").isNull())
    out = out.select("i", "j", F.col("far").alias("distance"), F.coalesce("early", F.when(F.col("hit"), "blocked").otherwise("visible")).alias("state"))
    if not bounded or not far:
        return out
    beyond = dealt(a).join(small(b), F.col("i") < F.col("j")).withColumn("distance", apart).where(F.col("distance") > max_distance)
    return out.unionByName(beyond.select("i", "j", "distance", F.lit("out_of_range").alias("state")))


def _ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(nodes.select(F.col("idx").alias(n), *[F.col(c).alias(f"{p}{c}") for c in "xyz"]) for n, p in (("i", "p"), ("j", "q")))  # type: ignore[return-value]


def near_pairs(nodes: DataFrame, radius: float) -> DataFrame:
    """(i, j, distance) of nodes within a radius, i < j."""
    return near_between(*_ends(nodes), radius).where("i < j").select("i", "j", "distance")


def sparse_candidates(nodes: DataFrame, radius: float = 25.0, neighbours: int = 16) -> DataFrame:
    """(i, j, distance): the nearest neighbours of each node within a radius, as unordered pairs."""
    p = near_pairs(nodes, radius)
    ends = p.select(F.col("i").alias("n"), F.col("j").alias("m"), "distance").unionByName(p.select(F.col("j").alias("n"), F.col("i").alias("m"), "distance"))
    nearest = ends.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("distance", "m"))).where(F.col("r") <= neighbours)
    return nearest.select(F.least("n", "m").alias("i"), F.greatest("n", "m").alias("j"), "distance").distinct()


def capped(pairs: DataFrame, cap: int) -> DataFrame:
    """Pairs taken greedily by (distance, i, j) while both ends have fewer than cap.

    A pair's fate hangs on all shorter ones, so rounds decide at once all pairs
    that are the next of both their ends, and drop what full ends leave over.
    """
    from solvane.operators.graphs import _cut

    left = _cut(pairs.select("i", "j", "distance"))
    taken = left.where("false")
    while not left.isEmpty():
        ends = left.select("i", "j", "distance", F.explode(F.array("i", "j")).alias("n"))
        first = ends.groupBy("n").agg(F.min(F.struct("distance", "i", "j")).alias("f"))
        both = ends.join(first, "n").where((F.col("f.i") == F.col("i")) & (F.col("f.j") == F.col("j"))).groupBy("i", "j", "distance").count().where("count = 2").drop("count")
        taken = _cut(taken.unionByName(both.select("i", "j", "distance")))
        full = taken.select(F.explode(F.array("i", "j")).alias("n")).groupBy("n").count().where(F.col("count") >= cap).select("n")
        left = left.join(both.select("i", "j"), ["i", "j"], "left_anti")
        left = _cut(left.join(full.withColumnRenamed("n", "i"), "i", "left_anti").join(full.withColumnRenamed("n", "j"), "j", "left_anti").select("i", "j", "distance"))
    return taken


def sparse_graph(nodes: DataFrame, triangles: DataFrame, radius: float = 25.0, neighbours: int = 16, cap: int | None = None, strategy: str = "auto") -> DataFrame:
    """(i, j, distance, state) of near neighbours under a degree cap."""
    pairs = sparse_candidates(nodes, radius, neighbours)
    return graph_pairs(nodes, triangles, strategy=strategy, pairs=capped(pairs, cap or neighbours))


# Target views.


def target_view_samples(observers: DataFrame, patches: DataFrame, triangles: DataFrame, samples: int = 16, horizontal: float = 90.0, vertical: float = 60.0, max_distance: float = 1000.0, reference_distance: float = 25.0, distance_exponent: float = 2.0, direction_exponent: float = 1.0, two_sided: bool = False, mask: int = -1, strategy: str = "auto") -> DataFrame:
    """Samples of patches(target_id, patch_id, a*, b*, c*, mask, category_weight) seen by observers(observer_id, p*, f*, u*, weight).

    (observer_id, target_id, patch_id, idx, omega, score, visible, object_id):
    omega is the sample's part of the patch's solid angle, by cosine over distance
    squared; score its weighted share.
    """
    h, v = math.tan(math.radians(horizontal / 2)), math.tan(math.radians(vertical / 2))
    kept = patches.where(F.expr(f"(mask & {mask}) <> 0")).select("*", *named(unit(cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))), "n"))
    if max_distance < 1e150:
        # a patch with a sample in range has its centre within the range and its own size
        middle = [((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3).alias(f"q{x}") for x in "xyz"]
        kept = kept.select("*", *middle)
        reach = kept.agg(F.max(F.greatest(*[norm(sub(vec(c), vec("q"))) for c in "abc"])).alias("r")).first()["r"] or 0.0
        rows = near_between(observers, kept, max_distance + reach).drop("distance", "qx", "qy", "qz")
    else:
        rows = observers.crossJoin(kept)
    rows = rows.withColumn("patch_omega", solid_angle(*[sub(vec(c), vec("p")) for c in "abc"]))
    s = triangle_points(observers.sparkSession, samples)
    rows = rows.crossJoin(small(s))
    q = tuple((F.col("wa") * F.col(f"a{x}") + F.col("wb") * F.col(f"b{x}") + F.col("wc") * F.col(f"c{x}")) for x in "xyz")
    rows = rows.select("*", *named(q, "q")).withColumn("distance", norm(sub(vec("q"), vec("p"))))
    rows = _toward(rows)
    cosine = -dot(vec("n"), vec("d"))
    rows = rows.withColumn("cosine", F.abs(cosine) if two_sided else cosine).where("cosine > 0")
    rows = rows.withColumn("w", F.col("cosine") / (F.col("distance") * F.col("distance")))
    patch = Window.partitionBy("observer_id", "target_id", "patch_id")
    rows = rows.withColumn("omega", F.col("patch_omega") * ratio(F.col("w"), F.sum("w").over(patch)))
    rows = rows.where(in_field(vec("f"), vec("u"), vec("d"), h, v) & (F.col("distance") <= max_distance))
    near = 1 / (1 + F.pow(F.col("distance") / reference_distance, distance_exponent))
    facing = F.pow(F.greatest(dot(vec("f"), vec("d")), F.lit(0.0)), direction_exponent)
    rows = rows.withColumn("score", F.col("omega") * F.col("category_weight") * near * facing * F.col("weight")).withColumnRenamed("mask", "own_mask")
    keys = ["observer_id", "target_id", "patch_id", "idx"]
    hits = closest(_rays(rows, F.col("distance") - 1e-4), triangles, keys, strategy, carry=["own_mask", "omega", "score"])
    return hits.select(*keys, F.col("own_mask").alias("mask"), "omega", "score", (~F.col("hit")).alias("visible"), F.when(F.col("hit"), F.col("object_id")).alias("object_id"))


def target_view_pairs(samples: DataFrame) -> DataFrame:
    """(observer_id, target_id) with potential and visible solid angle, fraction, score, convergence, dominant blocker."""
    seen = F.when(F.col("visible"), F.col("omega")).otherwise(0.0)
    even = F.col("idx") % 2 == 0
    share = lambda test: ratio(F.sum(F.when(test, seen).otherwise(0.0)), F.sum(F.when(test, F.col("omega")).otherwise(0.0)))
    out = samples.groupBy("observer_id", "target_id").agg(F.sum("omega").alias("potential"), F.sum(seen).alias("visible_omega"), F.sum(F.when(F.col("visible"), F.col("score")).otherwise(0.0)).alias("score"), F.abs(share(even) - share(~even)).alias("convergence"))
    top = dominant(samples.where("object_id is not null"), ["observer_id", "target_id"], F.col("omega"))
    return out.join(top, ["observer_id", "target_id"], "left").na.fill(0, ["dominant_object_id"]).withColumn("fraction", ratio(F.col("visible_omega"), F.col("potential")))


def target_view_observers(samples: DataFrame, horizontal: float = 90.0, vertical: float = 60.0, green_mask: int = 0) -> DataFrame:
    """A row for each observer: target view factor, green index, the target of the largest visible solid angle."""
    camera = field_of_view(math.tan(math.radians(horizontal / 2)), math.tan(math.radians(vertical / 2)))
    seen = F.when(F.col("visible"), F.col("omega")).otherwise(0.0)
    each = samples.groupBy("observer_id", "target_id").agg(F.sum(seen).alias("o"), F.sum(F.when(F.expr(f"(mask & {green_mask}) <> 0"), seen).otherwise(0.0)).alias("g"))
    return each.groupBy("observer_id").agg((F.sum("o") / camera).alias("target_view_factor"), (F.sum("g") / camera).alias("green_index"), F.max_by("target_id", F.struct("o", -F.col("target_id"))).alias("dominant_target_id"))


# View corridors.


def corridors(views: DataFrame, triangles: DataFrame, samples: int = 512, strategy: str = "auto") -> DataFrame:
    """A row for each corridor(corridor_id, p*, q*, radius): open share of a round aperture, cone angle, convergence, blockers."""
    axis = scale(sub(vec("q"), vec("p")), 1 / F.col("length"))
    rows = views.withColumn("length", norm(sub(vec("q"), vec("p")))).select("*", *named(axis, "a"))
    rows = _disk_rays(rows, disk(views.sparkSession, samples, centred=True), "radius")
    every = closest(_rays(rows, F.col("reach") - 1e-4), triangles, ["corridor_id", "idx"], strategy, carry=["length", "radius"]).withColumnRenamed("distance", "hit_distance")
    is_open = F.when(F.col("hit"), 0.0).otherwise(1.0)
    cone = 2 * math.pi * (1 - F.first(F.col("length") / F.sqrt(F.col("length") * F.col("length") + F.col("radius") * F.col("radius"))))
    half = F.avg(F.when(F.col("idx") < samples // 2, is_open))
    out = every.groupBy("corridor_id").agg(F.avg(is_open).alias("open_fraction"), cone.alias("cone_solid_angle"), F.abs(F.avg(is_open) - half).alias("convergence"), F.min_by("object_id", F.when(F.col("hit"), F.struct("hit_distance", "object_id"))).alias("nearest_object_id"), F.min("hit_distance").alias("nearest_distance"))
    top = dominant(every.where("hit"), ["corridor_id"], F.lit(1.0))
    return out.join(top, "corridor_id", "left").na.fill(0, ["dominant_object_id", "nearest_object_id"])


# Observer paths.


def path_observers(paths: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Observers along polylines(path_id, k, x, y, z), at two or more equal spacings, looking along the path.

    (path_id, sample, at, p*, f*, u*, trapezoid): trapezoid weighs a sample by
    half its steps.
    """
    by = Window.partitionBy("path_id").orderBy("k")
    nxt = lambda c: F.lead(c).over(by)
    seg = paths.select("path_id", "k", "x", "y", "z", nxt("x").alias("x2"), nxt("y").alias("y2"), nxt("z").alias("z2")).where("x2 is not null")
    seg = seg.withColumn("length", F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")) + (F.col("z2") - F.col("z")) * (F.col("z2") - F.col("z")))).where("length > 0")
    # lengths are added as decimals: in any order the same, and a segment begins just where the one before it ends
    seg = seg.withColumn("end", F.sum(F.col("length").cast("decimal(38,18)")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    seg = seg.withColumn("begin", F.coalesce(F.lag("end").over(by), F.lit(0.0)))
    total = seg.groupBy("path_id").agg(F.max("end").alias("total"))
    steps = total.withColumn("n", F.greatest(F.ceil(F.col("total") / spacing), F.lit(1)))
    # a segment lists the samples about it; a sample belongs to the segment that ends at it or after it first, the last one ends the path
    place = lambda c: F.col(c) / F.col("total") * F.col("n")
    about = F.sequence(F.greatest(F.floor(place("begin")) - 1, F.lit(0)), F.least(F.ceil(place("end")) + 1, F.col("n")))
    samples = seg.join(steps, "path_id").withColumn("sample", F.explode(about))
    samples = samples.withColumn("at", F.when(F.col("sample") == F.col("n"), F.col("total")).otherwise(F.col("total") * F.col("sample") / F.col("n")))
    inside = (F.col("at") > F.col("begin")) & (F.col("at") <= F.col("end")) | (F.col("sample") == 0) & (F.col("begin") == 0)
    rows = samples.where(inside).withColumn("s", (F.col("at") - F.col("begin")) / F.col("length"))
    place = [(F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("s")).alias(f"p{c}") for c in "xyz"]
    face = [((F.col(f"{c}2") - F.col(c)) / F.col("length")).alias(f"f{c}") for c in "xyz"]
    edge = (F.col("sample") == 0) | (F.col("sample") == F.col("n"))
    return rows.select("path_id", F.col("sample").cast("int").alias("sample"), "at", *place, *face, F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"), (F.col("total") / F.col("n") * F.when(edge, 0.5).otherwise(1.0)).alias("trapezoid"))


def path_summary(values: DataFrame) -> DataFrame:
    """A row for each path of values(path_id, sample, trapezoid, value): weighted mean, first worst and last best sample."""
    return values.groupBy("path_id").agg(ratio(F.sum(F.col("trapezoid") * F.col("value")), F.sum("trapezoid")).alias("mean"), F.min("value").alias("worst"), F.min_by("sample", F.struct("value", "sample")).alias("worst_sample"), F.max("value").alias("best"), F.max_by("sample", F.struct("value", "sample")).alias("best_sample"))


# Isovists in space, with transmission.


def isovist3d_layers(viewpoints: DataFrame, triangles: DataFrame, materials: DataFrame, assignment: DataFrame, samples: int = 4096, max_distance: float = 100.0, strategy: str = "auto", directions: DataFrame | None = None) -> DataFrame:
    """(viewpoint_id, idx, d*, layers): the sorted layers that each ray meets, traced once."""
    d = directions if directions is not None else sphere(viewpoints.sparkSession, samples).select("idx", F.col("lx").alias("dx"), F.col("ly").alias("dy"), F.col("lz").alias("dz"))
    rows = viewpoints.select("viewpoint_id", "px", "py", "pz").crossJoin(small(d))
    keys = ["viewpoint_id", "idx"]
    return layered(_rays(rows, F.lit(float(max_distance))), triangles, keys, materials, assignment, "visible_t", strategy, carry=["px", "py", "pz", "dx", "dy", "dz"])


def isovist3d(layers: DataFrame, samples: int, max_distance: float = 100.0, max_layers: int = 8, cutoff: float = 1e-4, excluding: Column | None = None) -> DataFrame:
    """A row for each viewpoint (and excluded object): radial volume and surface, openness, mean transmission, convergence."""
    omega = 4 * math.pi / samples
    w = folded(F.col("layers"), F.lit(float(max_distance)), 1e-6, cutoff, max_layers, excluding)
    rows = layers.withColumn("w", w)
    last = F.when(F.col("w.transmission") <= cutoff, F.element_at("w.losses", -1)["distance"]).otherwise(F.lit(float(max_distance)))
    rows = rows.withColumn("r", last).withColumn("t", F.col("w.transmission"))
    keys = ["viewpoint_id", *(["excluded_id"] if "excluded_id" in layers.columns else [])]
    stride = F.avg(F.when(F.col("idx") % 2 == 0, F.col("t")))
    return rows.groupBy(*keys).agg(F.sum(omega * F.pow("r", F.lit(3.0)) / 3).alias("volume"), F.sum(omega * F.col("r") * F.col("r")).alias("surface"), F.avg(F.when(F.col("t") > cutoff, 1.0).otherwise(0.0)).alias("openness"), F.avg("t").alias("mean_transmission"), F.abs(F.avg("t") - stride).alias("convergence"))


def isovist3d_attribution(layers: DataFrame, samples: int, max_distance: float = 100.0, max_layers: int = 8, cutoff: float = 1e-4, k: int = 10) -> DataFrame:
    """(viewpoint_id, object_id, loss, rank, fraction): the k objects that take most, in solid angle."""
    w = folded(F.col("layers"), F.lit(float(max_distance)), 1e-6, cutoff, max_layers)
    each = layers.select("viewpoint_id", F.explode(w["losses"]).alias("x")).groupBy("viewpoint_id", F.col("x.object_id").alias("object_id")).agg((F.sum("x.loss") * (4 * math.pi / samples)).alias("loss"))
    return top_losses(each.select(F.lit(0).alias("scenario_id"), F.col("viewpoint_id").alias("sensor_id"), "object_id", "loss"), k).select(F.col("sensor_id").alias("viewpoint_id"), "object_id", "loss", "rank", "fraction")


def isovist3d_counterfactuals(layers: DataFrame, attribution: DataFrame, samples: int, first: int = 5, **options) -> DataFrame:
    """The isovist of each viewpoint without each of its first objects; the same hits are walked again, nothing is traced."""
    out = attribution.where(F.col("rank") <= first).select("viewpoint_id", F.col("object_id").alias("excluded_id"))
    return isovist3d(layers.join(out, "viewpoint_id"), samples, excluding=F.col("excluded_id"), **options)


# Landmarks.


def landmarks(observers: DataFrame, marks: DataFrame, triangles: DataFrame, materials: DataFrame, assignment: DataFrame, samples: int = 64, horizontal: float = 90.0, vertical: float = 90.0, max_distance: float = 1000.0, max_layers: int = 8, cutoff: float = 1e-4, strategy: str = "auto", far: bool = True) -> DataFrame:
    """(observer_id, landmark_id, in_view, solid_angle, transmission, score) of spheres landmarks(landmark_id, q*, radius, weight).

    Only landmarks in view are traced; with far = False those beyond max_distance
    are left out, else they have a row of zeros like all that are not in view.
    """
    m = marks.select("landmark_id", "qx", "qy", "qz", "radius", F.col("weight").alias("mark_weight"))
    names = ["observer_id", "landmark_id", "in_view", "solid_angle", "transmission", "score"]
    apart = norm(sub(vec("q"), vec("p")))
    rows, ready = near_dealt(observers, m, max_distance) if max_distance < 1e150 else (observers.crossJoin(m).withColumn("distance", apart), False)
    axis = scale(sub(vec("q"), vec("p")), 1 / F.when(F.col("distance") > 0, F.col("distance")))
    rows = rows.select("*", *named(axis, "a"))
    view = in_field(vec("f"), vec("u"), vec("a"), math.tan(math.radians(horizontal / 2)), math.tan(math.radians(vertical / 2)))
    rows = rows.withColumn("in_view", F.coalesce(view & (F.col("distance") > F.col("radius")), F.lit(False)))
    share = F.col("radius") / F.when(F.col("distance") > F.col("radius"), F.col("distance"))
    seen = rows.where("in_view").withColumn("share", share).withColumn("solid_angle", 2 * math.pi * (1 - F.sqrt(1 - F.col("share") * F.col("share"))))
    s = _disk_rays(seen, disk(observers.sparkSession, samples), "radius")
    keys = ["observer_id", "landmark_id", "idx"]
    rays = _rays(s, F.col("reach") - F.col("radius"))
    layers = layered(rays, triangles, keys, materials, assignment, "visible_t", strategy, carry=["t_max", "solid_angle", "mark_weight"], dealt=ready)
    walked = layers.withColumn("t", folded(F.col("layers"), F.col("t_max"), 1e-6, cutoff, max_layers)["transmission"])
    mean = walked.groupBy("observer_id", "landmark_id", "solid_angle", "mark_weight").agg(F.avg("t").alias("transmission"))
    camera = 4 * math.sin(math.radians(horizontal / 2)) * math.sin(math.radians(vertical / 2))
    score = F.col("mark_weight") * F.col("solid_angle") * F.col("transmission") / camera
    out = mean.select("observer_id", "landmark_id", F.lit(True).alias("in_view"), "solid_angle", "transmission", score.alias("score"))
    zero = [F.lit(False).alias("in_view"), *[F.lit(0.0).alias(c) for c in names[3:]]]
    out = out.unionByName(rows.where("not in_view").select("observer_id", "landmark_id", *zero))
    if max_distance < 1e150 and far:
        beyond = dealt(observers.select("observer_id", "px", "py", "pz")).crossJoin(small(m.select("landmark_id", "qx", "qy", "qz"))).where(apart > max_distance)
        out = out.unionByName(beyond.select("observer_id", "landmark_id", *zero))
    return out.select(*names)


# Comparison and helpers.


def compare_metrics(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics' deltas of aligned viewpoints; a viewpoint that only one side has is refused."""
    from solvane.core import require_none

    a = before.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics])
    b = after.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics])
    both = a.join(b, key, "full_outer")
    first = metrics[0]
    require_none(both.where(F.col(f"a_{first}").isNull() != F.col(f"b_{first}").isNull()), "the viewpoints differ")
    return both.select(key, *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"{m}_delta") for m in metrics])


def compare_attribution(before: DataFrame, after: DataFrame) -> DataFrame:
    """(viewpoint_id, object_id, before, after, delta): losses of objects on either side, 0 where one is missing."""
    a = before.select("viewpoint_id", "object_id", F.col("loss").alias("before"))
    b = after.select("viewpoint_id", "object_id", F.col("loss").alias("after"))
    out = a.join(b, ["viewpoint_id", "object_id"], "full_outer").na.fill(0.0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))


def highlighted(triangles: DataFrame, occluders: DataFrame) -> DataFrame:
    """The triangles of objects that are named in occluders(object_id)."""
    return triangles.join(occluders.select("object_id").distinct(), "object_id", "left_semi")


def converged(rows: DataFrame, delta: str, threshold: float) -> DataFrame:
    """rows with accepted: whether a convergence delta is small enough."""
    return rows.withColumn("accepted", F.abs(F.col(delta)) <= threshold)


def legend(rows: DataFrame, value: str, domain: str = "full", low: float = 0.0, high: float = 1.0, ticks: int = 5) -> tuple[DataFrame, pd.DataFrame]:
    """Values brought to [0, 1] and the legend's ticks. domain: full, percentile (low and high are shares), symmetric, fixed.

    Values outside are clamped and counted, values that are not finite are null
    and counted, and a flat domain is padded by a half on both sides.
    """
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    if domain == "fixed":
        lo, hi = low, high
    else:
        p = [low, high] if domain == "percentile" else [0.0, 1.0]
        lo, hi = rows.agg(F.percentile(finite, p).alias("p")).first()["p"] or (0.0, 1.0)
        if domain == "symmetric":
            hi = max(abs(lo), abs(hi))
            lo = -hi
    if hi <= lo:
        lo, hi = lo - 0.5, hi + 0.5
    out = rows.withColumn("normalised", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (finite - lo) / (hi - lo)))).withColumn("clipped", (finite < lo) | (finite > hi))
    at = [k / max(ticks - 1, 1) for k in range(ticks)]
    return out, pd.DataFrame({"share": at, "value": [lo + (hi - lo) * a for a in at]})
