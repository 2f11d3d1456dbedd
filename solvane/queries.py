"""The registry of queries: each applies an operator to tables derived from a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane import fixtures as fx
from solvane import oracle
from solvane.core import shared_folder, small
from solvane.functions import sampling
from solvane.functions.solar_position import sun_set
from solvane.functions.vector import IDENTITY
from solvane.operators import daylight, evidence, graphs, mesh, rays, scene, study, sun, visibility, weather
from solvane.plans.ray_plans import ray_hits
from solvane.sources import exports
from solvane.sources import mesh_files as mf
from solvane.sources import weather_files as wf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def snapped(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded with limits off the halves, where exact averages of decimals lie."""
    return df.withColumns({n: F.floor(F.col(n) * 10.0**digits + 0.37) / 10.0**digits for n in names})


def sun_rays(spark: SparkSession, d: str) -> DataFrame:
    s = fx.suns(spark).where("is_active")
    rows = fx.sensors(spark, d).crossJoin(small(s)).where("nx * dx + ny * dy + nz * dz > 0")
    return sun.rays_from(rows, 1e-4, sun.INFINITE)


KEYS = ["sensor_id", "sun_index"]


@query
def scene_world_triangles(spark, d):
    q = fx.quads(spark, d)
    z, w, x0, y0 = (F.col(c) for c in ("z", "w", "x0", "y0"))
    # each roof is a mesh of its own size at the origin, and an instance that moves it into place
    corner = lambda k, x, y: F.struct(F.lit(k).cast("long").alias("vertex_index"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    zero = F.lit(0.0)
    v = q.select(F.col("object_id").alias("mesh_id"), F.inline(F.array(corner(0, zero, zero), corner(1, w, zero), corner(2, w, w), corner(3, zero, w))))
    face = lambda k, a, b, c: F.struct(F.lit(k).cast("long").alias("face_index"), F.lit(a).cast("long").alias("v0"), F.lit(b).cast("long").alias("v1"), F.lit(c).cast("long").alias("v2"))
    f = q.select(F.col("object_id").alias("mesh_id"), F.inline(F.array(face(0, 0, 1, 2), face(1, 0, 2, 3))))
    one = F.lit(1.0)
    i = q.select(F.col("object_id").alias("instance_id"), "object_id", F.col("object_id").alias("mesh_id"), F.array(one, zero, zero, x0, zero, one, zero, y0, zero, zero, one, z, zero, zero, zero, one).alias("transform"), "category_mask", F.lit("static").alias("layer"))
    return scene.world_triangles(v, f, i)


@query
def scene_stats(spark, d):
    return rounded(scene.stats(fx.triangles(spark, d)), 6, "area")


@query
def mesh_audit_counts(spark, d):
    a = mesh.audit(*fx.meshes(spark, d))
    return rounded(a, 6, "area").select("mesh_id", "vertex_count", "face_count", "accepted_faces", "duplicate_faces", "degenerate_faces", "isolated_vertices", "area", "boundary_edges", "non_manifold_edges", "components", "ready", "watertight")


@query
def mesh_boundary_edges(spark, d):
    return mesh.edges(mesh.face_flags(*fx.meshes(spark, d))).where("n = 1").select("mesh_id", "lo", "hi")


@query
def mesh_duplicate_faces(spark, d):
    v, f = fx.meshes(spark, d)
    last = fx.quads(spark, d).agg((F.max("object_id") * 2).alias("n"))
    again = f.where("face_index % 2 = 1 and ((face_index div 2) + 1) % 10 = 0").crossJoin(F.broadcast(last)).select("mesh_id", (F.col("n") + F.expr("face_index div 2") + 1).alias("face_index"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    return mesh.issues(v, f.unionByName(again))


@query
def mesh_surface_grid(spark, d):
    cells = mesh.surface_grid(*fx.meshes(spark, d), target=5.0)
    return cells.where("depth <= 1").groupBy("source_face").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("area"), 6).alias("area"))


@query
def ray_closest_hit(spark, d):
    return rounded(rounded(rays.closest(sun_rays(spark, d), fx.triangles(spark, d), KEYS), 9, "distance"), 6, "u", "v")


@query
def ray_any_hit(spark, d):
    return rays.any_hit(sun_rays(spark, d), fx.triangles(spark, d), KEYS)


@query
def ray_excluding_object(spark, d):
    r, t = sun_rays(spark, d), fx.triangles(spark, d)
    first = rays.closest(r, t, KEYS).select(*KEYS, F.col("object_id").alias("first_id"))
    out = rays.closest(r.join(first, KEYS), t, KEYS, excluding=F.col("first_id"))
    return rounded(out.select(*KEYS, "hit", "distance", "object_id"), 9, "distance")


@query
def ray_category_mask(spark, d):
    r = sun_rays(spark, d).withColumn("category_mask", F.lit(5).cast("long"))
    n = ray_hits(r, fx.triangles(spark, d), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hits"))
    return r.select(*KEYS).join(n, KEYS, "left").na.fill(0)


@query
def ray_transmission(spark, d):
    out = rays.transmission(sun_rays(spark, d), fx.triangles(spark, d), KEYS, fx.materials(spark), fx.assignment(spark, d))
    return rounded(out.select(*KEYS, "transmission", "layer_count"), 9, "transmission")


@query
def ray_voxel_parity(spark, d):
    r, t = sun_rays(spark, d), fx.triangles(spark, d)
    return rays.parity(rays.closest(r, t, KEYS, "bvh"), rays.closest(r, t, KEYS, "voxel"), KEYS)


@query
def ray_hierarchy_parity(spark, d):
    r, t = sun_rays(spark, d), fx.triangles(spark, d)
    return rays.parity(rays.closest(r, t, KEYS, "voxel"), rays.closest(r, t, KEYS, "bvh"), KEYS)


@query
def direct_sun_timeline(spark, d):
    return rounded(sun.direct_sun_timeline(fx.sensors(spark, d), fx.suns(spark), fx.triangles(spark, d)), 9, "cosine", "distance")


@query
def direct_sun_summary(spark, d):
    return sun.direct_sun_summary(sun.direct_sun_timeline(fx.sensors(spark, d), fx.suns(spark), fx.triangles(spark, d)))


def scenario_time(spark, d):
    a = fx.assignment(spark, d).join(fx.materials(spark), "material_id").select(F.lit(1).alias("scenario_id"), "object_id", F.col("solar_t").alias("coefficient"))
    b = fx.quads(spark, d).select(F.lit(2).alias("scenario_id"), "object_id", F.lit(0.0).alias("coefficient"))
    return sun.scenario_timeline(fx.sensors(spark, d), fx.suns(spark), fx.triangles(spark, d), a.unionByName(b))


@query
def solar_scenario_delta(spark, d):
    out = sun.scenario_summary(scenario_time(spark, d)).drop("lost_delta")
    return rounded(out, 6, "received_hours", "lost_hours", "received_delta")


@query
def solar_attribution_topk(spark, d):
    return rounded(sun.top_losses(sun.scenario_losses(scenario_time(spark, d))), 6, "loss", "fraction")


@query
def solar_category_breakdown(spark, d):
    return rounded(sun.category_breakdown(sun.scenario_losses(scenario_time(spark, d)), fx.quads(spark, d)), 6, "loss")


@query
def solar_envelope(spark, d):
    c = fx.quads(spark, d).select(F.col("object_id").alias("candidate_id"), F.col("x0").alias("bx"), F.col("y0").alias("by"), F.lit(0.0).alias("bz"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"))
    out = sun.solar_envelope(c, fx.sensors(spark, d), fx.suns(spark), fx.triangles(spark, d), radius=1.0, max_distance=60.0)
    return rounded(out, 6, "access_height", "shading_height")


def sky_time(spark, d):
    local = fx.suns(spark).where("dz > 0").select(F.col("sun_index").alias("idx"), F.col("dx").alias("lx"), F.col("dy").alias("ly"), F.col("dz").alias("lz"))
    return sun.sky_view_timeline(fx.sensors(spark, d), fx.triangles(spark, d), directions=local)


@query
def sky_shadow_mask(spark, d):
    return sky_time(spark, d).select("sensor_id", "idx", "visible", "object_id")


@query
def sky_view(spark, d):
    out = sun.sky_view_summary(sky_time(spark, d)).select("sensor_id", "samples", "visible_fraction", "sky_view_factor", "fraction_delta", "dominant_object_id")
    return rounded(out, 9, "visible_fraction", "sky_view_factor", "fraction_delta")


def matrix(spark, d, triangles=None):
    up = fx.suns(spark).where("dz > 0").select(F.col("sun_index").alias("idx"), "dx", "dy", "dz")
    t = triangles if triangles is not None else fx.triangles(spark, d)
    return daylight.coefficient_matrix(fx.sensors(spark, d), t, fx.materials(spark), fx.assignment(spark, d), patches=12, directions=up)


@query
def daylight_matrix(spark, d):
    return rounded(matrix(spark, d).select("sensor_id", "idx", "coefficient"), 9, "coefficient")


@query
def daylight_factor(spark, d):
    return rounded(daylight.daylight_factor(matrix(spark, d), 12), 6, "daylight_factor")


@query
def point_illuminance(spark, d):
    out = daylight.point_illuminance(fx.sensors(spark, d), matrix(spark, d), (0.0, 0.6, 0.8), 50_000.0, 10_000.0, fx.triangles(spark, d), fx.materials(spark), fx.assignment(spark, d), patches=12)
    return rounded(out, 4, "direct", "diffuse", "total")


@query
def daylight_validation(spark, d):
    o = fx.outcomes(spark, d)
    a = o.where("scenario_id = 1").select("candidate_id", F.col("objective").alias("value"))
    b = o.where("scenario_id = 2").select("candidate_id", F.col("objective").alias("reference"))
    out = daylight.compare(a.join(b, "candidate_id"))
    return rounded(snapped(out, 4, "bias", "mae", "rmse", "max_error"), 6, "mape", "r_squared")


def weather_suns(spark, d):
    """Hours of weather, the suns taking turns."""
    w = fx.weather(spark, d).select("midpoint_unix", "duration_hours", "ghi", "dni", "dhi", F.pmod(F.expr("hour_unix div 3600"), F.lit(12)).cast("int").alias("k"))
    s = fx.suns(spark).select(F.col("sun_index").alias("k"), "dx", "dy", "dz", "is_active")
    return w.join(small(s), "k").select((F.col("midpoint_unix") / 3600).cast("int").alias("sun_index"), "midpoint_unix", "duration_hours", "ghi", "dni", "dhi", "dx", "dy", "dz", "is_active")


@query
def annual_irradiance(spark, d):
    out = daylight.annual_irradiance(fx.sensors(spark, d), weather_suns(spark, d), fx.triangles(spark, d))
    return rounded(out.drop("peak_index"), 3, "direct_wh", "diffuse_wh", "ground_wh", "total_wh", "loss_wh", "peak_w")


def daylight_year(spark, d):
    # one scene serves the rays to the patches and those to the suns
    s, m, a = fx.sensors(spark, d), fx.materials(spark), fx.assignment(spark, d)
    t = rays.with_transmittance(fx.triangles(spark, d), m, a, "visible_t")
    # hours are few, events are many: they are counted into hours once, not for each use of the hours
    w = graphs._cut(daylight.with_turns(weather_suns(spark, d)))
    return daylight.annual_daylight(s, matrix(spark, d, t), w, daylight.sun_transmission(s, w, t, m, a), patches=12)


@query
def annual_daylight(spark, d):
    return rounded(rounded(daylight_year(spark, d), 9, "sda_share", "udi_low", "udi_supplementary", "udi_autonomous", "udi_excessive"), 3, "mean_lux")


@query
def daylight_project(spark, d):
    return rounded(daylight.daylight_project(daylight_year(spark, d)), 6, "sda_percent", "ase_percent", "udi_percent")


@query
def weather_hourly(spark, d):
    return fx.weather(spark, d)


@query
def weather_gaps(spark, d):
    return weather.gaps(fx.weather(spark, d))


@query
def weather_interpolate(spark, d):
    w = fx.weather(spark, d)
    return w.select("midpoint_unix", "dni_missing", F.round(weather.interpolated(w, "dni"), 6).alias("dni"))


@query
def weather_select(spark, d):
    w = fx.weather(spark, d).withColumn("month", F.month(F.timestamp_seconds("midpoint_unix")))
    return weather.select(w, months=0b101, weekdays=0b11111, start_hour=8, end_hour=18, min_dni=20).select("midpoint_unix", "dni", "weight")


@query
def intervisibility(spark, d):
    out = visibility.intervisibility(fx.observers(spark, d), fx.targets(spark, d), fx.triangles(spark, d), max_distance=60)
    return rounded(out, 9, "distance", "risk")


def _counts(spark, d, own, other, key):
    near = visibility.intervisibility(fx.observers(spark, d), fx.targets(spark, d), fx.triangles(spark, d), max_distance=60, far=False)
    out = visibility.visibility_counts(near, key, own, other.count())
    return rounded(rounded(out.drop("coincident"), 6, "combined_risk"), 9, "max_risk", "visible_fraction")


@query
def observer_summary(spark, d):
    return _counts(spark, d, fx.observers(spark, d), fx.targets(spark, d), "observer_id")


@query
def target_summary(spark, d):
    return _counts(spark, d, fx.targets(spark, d), fx.observers(spark, d), "target_id")


@query
def visibility_graph_pairs(spark, d):
    return rounded(visibility.graph_pairs(fx.nodes(spark, d), fx.triangles(spark, d), max_distance=40), 9, "distance")


@query
def graph_degree(spark, d):
    n = fx.nodes(spark, d)
    return rounded(graphs.degrees(n.select("idx"), visibility.near_pairs(n, 25.0)), 9, "degree_centrality")


@query
def graph_components(spark, d):
    n = fx.nodes(spark, d)
    return graphs.with_components(n.select("idx"), visibility.near_pairs(n, 25.0)).select("idx", F.col("component").cast("long").alias("component"))


@query
def graph_centralities(spark, d):
    n = fx.nodes(spark, d)
    return rounded(graphs.centralities(n, visibility.near_pairs(n, 25.0)), 9, "closeness", "betweenness")


@query
def sparse_graph_candidates(spark, d):
    return rounded(visibility.sparse_candidates(fx.nodes(spark, d), 25.0, 3), 9, "distance")


@query
def sparse_graph(spark, d):
    return rounded(visibility.sparse_graph(fx.nodes(spark, d), fx.triangles(spark, d), 25.0, 4), 9, "distance")


@query
def isovist_summary(spark, d):
    v = fx.sensors(spark, d).select(F.col("sensor_id").alias("viewpoint_id"), "px", "py", F.lit(1.6).alias("pz"))
    flat = [(1, 0), (0.8, 0.6), (0.6, 0.8), (0, 1), (-0.6, 0.8), (-0.8, 0.6), (-1, 0), (-0.8, -0.6), (-0.6, -0.8), (0, -1), (0.6, -0.8), (0.8, -0.6)]
    a = spark.createDataFrame([(k, float(x), float(y), 0.0) for k, (x, y) in enumerate(flat)], "idx int, dx double, dy double, dz double")
    out = visibility.isovist_summary(visibility.isovist_rays(v, fx.triangles(spark, d), angles=a))
    return rounded(rounded(out.select("viewpoint_id", "samples", "area", "perimeter", "mean_radius", "min_radius", "max_radius"), 4, "area", "perimeter"), 6, "mean_radius")


def layers(spark, d):
    v = fx.sensors(spark, d).select(F.col("sensor_id").alias("viewpoint_id"), "px", "py", F.lit(1.6).alias("pz"))
    dirs = fx.suns(spark).select(F.col("sun_index").alias("idx"), "dx", "dy", "dz")
    return visibility.isovist3d_layers(v, fx.triangles(spark, d), fx.materials(spark), fx.assignment(spark, d), directions=dirs)


@query
def isovist3d(spark, d):
    out = visibility.isovist3d(layers(spark, d), 12).drop("convergence")
    return rounded(rounded(rounded(out, 2, "volume"), 3, "surface"), 9, "openness", "mean_transmission")


@query
def isovist3d_counterfactuals(spark, d):
    rows = layers(spark, d)
    out = visibility.isovist3d_counterfactuals(rows, visibility.isovist3d_attribution(rows, 12), 12).drop("convergence")
    return rounded(rounded(rounded(out, 2, "volume"), 3, "surface"), 9, "openness", "mean_transmission")


def view_patches(spark, d):
    return fx.triangles(spark, d).select(F.col("object_id").alias("target_id"), F.col("triangle_id").alias("patch_id"), *[f"{c}{x}" for c in "abc" for x in "xyz"], F.col("category_mask").alias("mask"), F.lit(1.0).alias("category_weight"))


@query
def target_view(spark, d):
    o = fx.observers(spark, d).select("observer_id", "px", "py", F.lit(20.0).alias("pz"), F.lit(0.6).alias("fx"), F.lit(0.0).alias("fy"), F.lit(-0.8).alias("fz"), F.lit(0.8).alias("ux"), F.lit(0.0).alias("uy"), F.lit(0.6).alias("uz"), "weight")
    out = visibility.target_view_pairs(visibility.target_view_samples(o, view_patches(spark, d), fx.triangles(spark, d), samples=4, max_distance=14.0))
    return rounded(out, 9, "potential", "visible_omega", "score", "fraction").drop("convergence")


@query
def corridor_summary(spark, d):
    """A corridor from each observer to one of the targets on its square."""
    own = F.expr(f"(observer_id - 1) div {fx.OBSERVERS}") * fx.SENSORS + F.col("observer_id") % fx.SENSORS + 1
    v = fx.observers(spark, d).withColumn("target_id", own).join(fx.targets(spark, d), "target_id")
    v = v.select(F.col("observer_id").alias("corridor_id"), "px", "py", "pz", "qx", "qy", "qz", F.lit(1.0).alias("radius"))
    out = visibility.corridors(v, fx.triangles(spark, d), samples=16)
    return rounded(out, 6, "cone_solid_angle", "nearest_distance")


@query
def observer_path(spark, d):
    p = fx.sensors(spark, d).select((F.col("sensor_id") % 10).alias("path_id"), F.col("sensor_id").alias("k"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    return rounded(visibility.path_observers(p, 5.0).groupBy("path_id").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("trapezoid").cast("decimal(38,18)")).cast("double").alias("length")), 6, "length")


@query
def landmark_visibility(spark, d):
    o = fx.observers(spark, d).select("observer_id", "px", "py", "pz", F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    m = fx.targets(spark, d).select(F.col("target_id").alias("landmark_id"), "qx", "qy", "qz", F.lit(2.0).alias("radius"), F.col("sensitivity").alias("weight"))
    out = visibility.landmarks(o, m, fx.triangles(spark, d), fx.materials(spark), fx.assignment(spark, d), samples=8, max_distance=30.0)
    return rounded(out, 9, "solid_angle", "transmission", "score")


OBJECTIVES = {"rev": "max", "disc": "min"}


@query
def pareto_front(spark, d):
    return study.pareto_front(fx.evaluations(spark, d), OBJECTIVES, ["residual"]).select("candidate_id", "rev", "disc", "residual")


def ranked(spark, d):
    return study.rank_study(fx.evaluations(spark, d), OBJECTIVES, ["residual"])


@query
def pareto_rank(spark, d):
    return ranked(spark, d).select("candidate_id", "rank", "feasible", "violation", "dominated_count")


@query
def crowding(spark, d):
    return rounded(ranked(spark, d).select("candidate_id", "crowding"), 6, "crowding")


@query
def hypervolume2d(spark, d):
    front = study.pareto_front(fx.evaluations(spark, d), OBJECTIVES, ["residual"]).select((-F.col("rev")).alias("x"), F.col("disc").alias("y"))
    return rounded(study.hypervolume_2d(front, "x", "y", (0.0, 0.1)), 2, "hypervolume")


@query
def spearman(spark, d):
    return rounded(study.spearman(fx.evaluations(spark, d), ["size", "price"], ["rev", "disc"]), 6, "rho")


@query
def statistical_sensitivity(spark, d):
    out = study.statistical_sensitivity(fx.evaluations(spark, d), ["size", "price"], ["rev", "disc"], bootstrap=100, permutations=100)
    return rounded(rounded(out, 6, "rho", "low", "high"), 9, "p", "p_holm")


@query
def robust_cvar(spark, d):
    out = evidence.robust_scenarios(fx.outcomes(spark, d), "min", 0.8).drop("deviation")
    return rounded(snapped(out, 4, "mean", "worst", "cvar"), 9, "violation_probability")


@query
def uncertainty_rank(spark, d):
    m = fx.outcomes(spark, d).groupBy("candidate_id").agg(F.avg("objective").alias("o"), F.stddev_pop("objective").alias("o_sd"), F.avg("residual").alias("r"), F.stddev_pop("residual").alias("r_sd"))
    return evidence.uncertainty_ranking(m, {"o": "min"}, ["r"]).select("candidate_id", "rank", "tier")


@query
def fidelity_calibration(spark, d):
    out = evidence.calibration(fx.fidelities(spark, d)).select("n", "slope", "intercept")
    return rounded(rounded(out, 6, "slope"), 4, "intercept")


@query
def fidelity_recommendation(spark, d):
    o = fx.fidelities(spark, d).withColumn("objectives", F.array("objective", -F.col("objective") / 2)).drop("objective")
    return rounded(rounded(evidence.recommend(o, ["min", "min"], batch=8, draws=64), 3, "gain"), 4, "score")


@query
def sobol_indices(spark, d):
    design = evidence.saltelli_design(spark, [(0.0, 1.0), (0.0, 1.0)], 4096)
    out = evidence.sobol_indices(design.select("block", "base", (F.element_at("values", 1) + 2 * F.element_at("values", 2)).alias("y")))
    return rounded(out, 6, "first_order", "total")


@query
def morris_effects(spark, d):
    design = evidence.morris_design(spark, [(0.0, 1.0), (0.0, 1.0)], 32)
    out = evidence.morris_effects(design.select("trajectory", "step", "changed", "delta", (F.element_at("values", 1) + 2 * F.element_at("values", 2)).alias("y")))
    return rounded(out, 9, "mu", "mu_star", "sigma")


@query
def scenario_delta_map(spark, d):
    f = fx.outcomes(spark, d).select(F.concat(F.lit("s"), "scenario_id").alias("scenario_id"), F.concat(F.lit("c"), "candidate_id").alias("name"), F.array("objective", "residual").alias("values"))
    return snapped(study.compare_scenarios(f, "s1").drop("rms_delta"), 4, "min_delta", "mean_delta", "max_delta")


@query
def weighted_quantiles(spark, d):
    out = sun.weighted_quantiles(fx.outcomes(spark, d), ["scenario_id"], "objective", "probability", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rounded(out, 6, "p10", "p50", "p90")


@query
def pv_potential(spark, d):
    cells = fx.quads(spark, d).select(F.col("object_id").alias("sensor_id"), (F.col("w") * F.col("w") / 2).alias("area"), (700000 + 1000.0 * (F.col("object_id") % 300)).alias("energy"))
    return rounded(rounded(sun.pv_potential(cells).drop("incident_kwh"), 6, "mean", "kwp"), 3, "yield_kwh")


@query
def pv_regions(spark, d):
    cells = fx.triangles(spark, d).select((F.col("object_id") * 2 + F.col("triangle_id")).alias("sensor_id"), F.lit(1.0).alias("area"), (700000 + 1000.0 * (F.col("object_id") % 300)).alias("energy"), *[f"{c}{x}" for c in "abc" for x in "xyz"])
    return sun.pv_regions(cells, sun.cell_neighbours(cells))


@query
def sun_position(spark, d):
    hours = fx.weather(spark, d).select(F.col("midpoint_unix").alias("unix_seconds"), "duration_hours", F.lit(1.0).alias("weight"))
    return sun_set(hours, 35.6892, 51.3890, 1200.0)


@query
def optimizer_generation(spark, d):
    o = study.Optimizer([study.Variable("x", 0.0, 1.0), study.Variable("y", 0.0, 1.0)], ["min", "min"], population=16, offspring=16)
    for _ in range(3):
        c = spark.createDataFrame(o.ask())
        x, y = F.element_at("values", 1), F.element_at("values", 2)
        done = c.select("candidate_id", "values", F.array(x, (1 + y) * (1 - F.sqrt(x / (1 + y)))).alias("objectives"), F.array(F.lit(0.0)).alias("residuals"))
        o.tell(done.orderBy("candidate_id").toPandas())
    rows = [(m["id"], m["rank"], [float(v) for v in m["objectives"]]) for m in o.members]
    return spark.createDataFrame(rows, "candidate_id long, rank int, objectives array<double>")


# Files, repairs, samplers and small parts: each written or computed by its operator and compared as a table.

def broken(spark, d):
    """The fixture's mesh with repeated, degenerate and unbounded faces, and loose vertices."""
    v, f = fx.meshes(spark, d)
    last = fx.quads(spark, d).agg((F.max("object_id") * 2).alias("n"))
    some = f.where("face_index % 2 = 1 and ((face_index div 2) + 1) % 10 = 0").crossJoin(F.broadcast(last))
    k = F.expr("face_index div 2") + 1
    again = some.select("mesh_id", (F.col("n") + k).alias("face_index"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    flat = some.select("mesh_id", (2 * F.col("n") + k).alias("face_index"), "v0", F.col("v1"), F.col("v1").alias("v2"))
    loose = v.where("vertex_index % 40 = 0").select("mesh_id", (F.col("vertex_index") + 1_000_000_000).alias("vertex_index"), "x", "y", (F.col("z") + 500).alias("z"))
    return v.unionByName(loose), f.unionByName(again).unionByName(flat)


def measured(v, f):
    """(mesh_id, vertices, faces, area, min_x, max_x) of mesh tables."""
    points = v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    return points.join(face_sums(v, f), "mesh_id")


def face_sums(v, f):
    return mesh.face_flags(v, f).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("double_area") / 2, 6).alias("area"))


@query
def mesh_repair(spark, d):
    return measured(*mesh.repair(*broken(spark, d)))


@query
def mesh_weld(spark, d):
    _, _, notes = mesh.weld(*fx.blocks(spark, d), 1e-6)
    return notes.select("mesh_id", F.col("note_a").alias("before"), F.col("note_b").alias("after"))


@query
def mesh_heal(spark, d):
    v, f = fx.blocks(spark, d)
    turned = f.select("mesh_id", "face_index", "v0", *[F.when(F.col("face_index") % 2 == 1, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("v1", "v2"), ("v2", "v1"))])
    _, _, audit = mesh.heal(v, turned)
    return rounded(audit, 6, "area").select("mesh_id", "accepted_faces", "area", "winding_conflicts", "boundary_edges")


@query
def mesh_clip(spark, d):
    v, f, _ = mesh.clip(*fx.blocks(spark, d), (60.5, -1.0, -1.0), (1e6, 1e6, 6.5))
    return face_sums(v, f).select("mesh_id", "area")


@query
def mesh_files(spark, d):
    """Each mesh written in each format to the shared folder and read again."""
    v, f = fx.blocks(spark, d)
    out = None
    for kind in oracle.FORMATS:
        folder = shared_folder(spark, f"meshes-{kind}")
        mf.write_files(v, f, kind, folder)
        rv, rf, files = mf.read_meshes(spark, f"{folder}/mesh-*")
        own = files.select("mesh_id", F.regexp_extract("path", r"mesh-(\d+)", 1).cast("long").alias("own"))
        rows = measured(rv, rf).join(own, "mesh_id").select(F.lit(kind).alias("format"), F.col("own").alias("mesh_id"), "vertices", "faces", "area", "min_x", "max_x")
        out = rows if out is None else out.unionByName(rows)
    return out


def weather_records(spark, d):
    """The hours as full weather records."""
    t = F.timestamp_seconds("midpoint_unix")
    no = F.lit(False)
    w = fx.weather(spark, d).select((F.col("hour_unix") / 3600).cast("long").alias("idx"), F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), "midpoint_unix", "duration_hours", "ghi", "dni", "dhi", no.alias("ghi_missing"), "dni_missing", no.alias("dhi_missing"), F.lit(20.0).alias("dry_bulb"), F.lit(88000.0).alias("pressure"), F.lit(0.2).alias("albedo"), F.lit("x").alias("flags"))
    return w


@query
def weather_files(spark, d):
    """The weather written as CSV and as WEA, and read again."""
    w = weather_records(spark, d)
    folder = shared_folder(spark, "weather")
    wf.write_lines(wf.csv_lines(w, "hours"), f"{folder}/csv")
    wf.write_lines(wf.wea_lines({"city": "x", "latitude": 35.0, "longitude": 51.0, "utc_offset": 0.0, "elevation": 1200.0}, w), f"{folder}/wea")
    back = [(wf.read_csv(spark, f"{folder}/csv/part-*"), "csv"), (wf.read_wea(spark, f"{folder}/wea/part-*", 2024)[1], "wea")]
    rows = [r.select(F.lit(n).alias("format"), "midpoint_unix", F.round("dni", 6).alias("dni"), F.round("dhi", 6).alias("dhi"), "dni_missing") for r, n in back]
    return rows[0].unionByName(rows[1])


@query
def weather_policy(spark, d):
    out = weather.apply_policy(weather_records(spark, d), missing="interpolate", leap_day="drop", on_gap="preserve")
    return rounded(out.select("midpoint_unix", "ghi", "dni", "dhi"), 6, "dni")


@query
def schedule_hours(spark, d):
    return weather.schedule(spark, 1_704_067_200, 1_704_067_200 + 30 * 86_400 + 1000, 1800, 0.5)


@query
def occupancy_hours(spark, d):
    return weather.weekday_hours(spark, 8, 18)


@query
def scene_deltas(spark, d):
    q = fx.quads(spark, d)
    i = q.select(F.col("object_id").alias("instance_id"), "object_id", F.col("object_id").alias("mesh_id"), F.array(*[F.lit(x) for x in IDENTITY]).alias("transform"), "category_mask", F.lit("static").alias("layer"))
    none = {"object_id": "long", "mesh_id": "long", "transform": "array<double>", "category_mask": "long", "layer": "string"}
    row = lambda df, kind, seq, **own: df.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), "instance_id", *[(own[c] if c in own else F.lit(None).cast(t)).alias(c) for c, t in none.items()])
    deltas = row(i.where("instance_id % 10 = 0"), "update", 1, category_mask=F.lit(64).cast("long"))
    deltas = deltas.unionByName(row(i.where("instance_id % 10 = 1"), "remove", 2)).unionByName(row(i.where("instance_id % 20 = 1"), "add", 3, object_id=F.col("object_id"), mesh_id=F.lit(7).cast("long"), transform=F.col("transform"), category_mask=F.lit(1).cast("long"), layer=F.lit("new")))
    out, _ = scene.apply_deltas(i, deltas)
    return out.select("instance_id", "object_id", "mesh_id", "category_mask", "layer")


@query
def scene_documents(spark, d):
    """Documents written as a table, read again and taken apart."""
    v, f = fx.blocks(spark, d)
    i = v.select("mesh_id").distinct().select(F.col("mesh_id").alias("instance_id"), F.col("mesh_id").alias("object_id"), "mesh_id", F.array(*[F.lit(x) for x in IDENTITY]).alias("transform"), F.lit(1).cast("long").alias("category_mask"), F.lit("static").alias("layer"))
    folder = shared_folder(spark, "documents")
    scene.documents(v, f, i).write.parquet(folder)
    rv, rf, ri = scene.compile_documents(spark.read.parquet(folder))
    return scene.world_triangles(rv, rf, ri).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles"), F.min("ax").alias("min_ax"), F.sum("az").alias("sum_az"))


@query
def sample_points(spark, d):
    """Directions and points of all samplers."""
    row = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), "idx", *[F.round(F.col(x) if isinstance(x, str) else x, 9).alias(n) for x, n in zip(c, "abc", strict=True)])
    zero = F.lit(0.0)
    parts = [
        row(sampling.hemisphere(spark, 64), "hemisphere", "lx", "ly", "lz"),
        row(sampling.sphere(spark, 64), "sphere", "lx", "ly", "lz"),
        row(sampling.disk(spark, 64), "disk", "lx", "ly", zero),
        row(sampling.disk(spark, 64, centred=True), "centred", "lx", "ly", zero),
        row(sampling.circle(spark, 64), "circle", "angle", zero, zero),
        row(sampling.circle(spark, 64, 90.0), "arc", "angle", zero, zero),
        row(sampling.triangle_points(spark, 64), "triangle", "wa", "wb", "wc"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def optical_materials(spark, d):
    part = fx.table(spark, d, "part")
    rgb = lambda *k: F.array(*[((F.col("p_partkey") * m % 100) / F.lit(200.0)) for m in k])
    o = part.select((F.col("p_partkey") + 1).alias("material_id"), rgb(7, 11, 13).alias("transmittance"), rgb(3, 5, 17).alias("reflectance"))
    return rounded(daylight.optical_materials(o), 9, "visible_t", "solar_t", "reflectance")


@query
def path_summary(spark, d):
    s = fx.sensors(spark, d).select((F.col("sensor_id") % 10).alias("path_id"), F.col("sensor_id").cast("int").alias("sample"), F.col("area").alias("trapezoid"), ((F.col("sensor_id") * 37) % 11).cast("double").alias("value"))
    return rounded(visibility.path_summary(s), 9, "mean")


@query
def occluder_triangles(spark, d):
    time = sun.direct_sun_timeline(fx.sensors(spark, d), fx.suns(spark), fx.triangles(spark, d))
    return visibility.highlighted(fx.triangles(spark, d), time.where("state = 'blocked'")).select("object_id", "triangle_id")


@query
def legend_values(spark, d):
    rows, _ = visibility.legend(fx.evaluations(spark, d).select("candidate_id", "price"), "price")
    return rounded(rows.select("candidate_id", "normalised", "clipped"), 9, "normalised")


@query
def metric_comparison(spark, d):
    s = fx.sensors(spark, d).select(F.col("sensor_id").alias("viewpoint_id"), "px", "area")
    after = s.withColumn("px", F.col("px") * 2).withColumn("area", F.col("area") - 1)
    return rounded(visibility.compare_metrics(s, after, "viewpoint_id", ["px", "area"]), 9, "px_delta", "area_delta")


@query
def study_files(spark, d):
    """A study's table with named columns, written and read again."""
    e = fx.evaluations(spark, d).select("candidate_id", F.array("size", "price").alias("values"), F.array("rev", "disc").alias("objectives"), F.array("residual").alias("residuals"))
    folder = shared_folder(spark, "study")
    exports.write_study(exports.study_table(e, ["Size", "Unit price"], [("Revenue", 1), ("Discount", 1)], ["Limit"]), folder)
    return spark.read.parquet(folder)


@query
def objective_points(spark, d):
    out = exports.objective_space(fx.evaluations(spark, d).select("candidate_id", "rev", "disc"), ["rev", "disc"])
    return rounded(out.select("candidate_id", "x", "y", "z"), 9, "x", "y")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.Q.items() if k in QUERIES}
