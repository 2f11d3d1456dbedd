import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvane.functions import vector as V
from solvane.functions.sky import perez
from solvane.functions.solar_position import position
from solvane.operators import daylight, rays, scene, sun
from solvane.plans.ray_plans import ray_hits

TRI = "object_id long, instance_id long, mesh_id long, triangle_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, category_mask long, mirrored boolean"
KEYS = ["ray_id"]


def big(spark, z=1.0, oid=1, mask=-1, x=-50.0):
    return spark.createDataFrame([(oid, oid, 1, 0, x, -50.0, z, 150.0, -50.0, z, x, 150.0, z, mask, False)], TRI)


def none(spark):
    return spark.createDataFrame([], TRI)


def sensors(spark, *n):
    return spark.createDataFrame([(k + 1, 0.0, 0.0, 0.0, *map(float, v), 1.0) for k, v in enumerate(n or [(0, 0, 1)])], "sensor_id long, px double, py double, pz double, nx double, ny double, nz double, area double")


def suns(spark, *d):
    return spark.createDataFrame([(k, *map(float, v), 1.0, 1.0, v[2] > 0) for k, v in enumerate(d)], "sun_index int, dx double, dy double, dz double, duration_hours double, weight double, is_active boolean")


def materials(spark, t=0.5):
    return spark.createDataFrame([(1, t, t)], "material_id long, visible_t double, solar_t double"), spark.createDataFrame([(1, 1)], "object_id long, material_id long")


def test_sun_position_published_value():
    az, alt = position(np.array([1066419030]), 39.742476, -105.1786, 1830.14, 67, 820, 11)
    assert az[0] == pytest.approx(194.34024, abs=3e-4) and alt[0] == pytest.approx(39.88838, abs=3e-4)


def test_direct_sun_states_hours_and_occluder(spark):
    t = sun.direct_sun_timeline(sensors(spark, (0, 0, 1), (0, 0, -1)), suns(spark, (0, 0, 1), (0.6, 0, 0.8), (0, 0.8, -0.6)), big(spark, x=-0.5))
    state = {(r["sensor_id"], r["sun_index"]): r["state"] for r in t.collect()}
    assert state[(1, 0)] == "blocked" and state[(1, 2)] == "inactive" and state[(2, 0)] == "back_facing"
    s = sun.direct_sun_summary(t).where("sensor_id = 1").first()
    assert s["shadow_hours"] + s["direct_hours"] == s["eligible_hours"] == 2.0 and s["dominant_object_id"] == 1
    other = sun.direct_sun_summary(t).where("sensor_id = 2").first()
    assert other["eligible_hours"] == 0 and other["direct_ratio"] == 0 and other["dominant_object_id"] == 0


def test_ties_go_to_the_smallest_ids_and_masks_hide(spark):
    two = big(spark, oid=2).unionByName(big(spark, oid=1))
    r = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 100.0, -1)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, t_min double, t_max double, category_mask long")
    assert rays.closest(r, two, KEYS).first()["object_id"] == 1
    assert rays.closest(r, two, KEYS, excluding=F.lit(1)).first()["object_id"] == 2
    assert not rays.closest(r.withColumn("category_mask", F.lit(2).cast("long")), big(spark, mask=1), KEYS).first()["hit"]
    assert rays.any_hit(r, none(spark), KEYS).first()["blocked"] is False
    miss = rays.closest(r, none(spark), KEYS).first()
    assert (miss["object_id"], miss["triangle_id"], miss["distance"]) == (0, 4294967295, None)


def test_transmission_walks_layers_and_stops(spark):
    m, a = materials(spark)
    r = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 100.0, -1)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, t_min double, t_max double, category_mask long")
    layers = big(spark, 1.0).unionByName(big(spark, 2.0)).unionByName(big(spark, 3.0))
    out = rays.transmission(r, layers, KEYS, m, a).first()
    assert out["transmission"] == pytest.approx(0.125) and out["layer_count"] == 3 and not out["limit_reached"]
    assert [x["loss"] for x in out["losses"]] == pytest.approx([0.5, 0.25, 0.125])
    out = rays.transmission(r, layers, KEYS, m, a, max_layers=2).first()
    assert out["limit_reached"] and out["transmission"] == pytest.approx(0.25)
    out = rays.transmission(r, layers.unionByName(big(spark, 1.5, oid=9)), KEYS, m, a).first()
    assert out["transmission"] == 0 and out["layer_count"] == 2


@pytest.mark.parametrize("plan", ["voxel", "bvh"])
def test_plans_agree_on_random_scenes(spark, plan):
    rng = np.random.default_rng(7)
    c = rng.uniform(0, 10, (300, 1, 3)) + rng.normal(0, 0.7, (300, 3, 3))
    t = spark.createDataFrame([(k + 1, k + 1, 1, 0, *map(float, x.ravel()), -1, False) for k, x in enumerate(c)], TRI)
    o, d = rng.uniform(-2, 12, (500, 3)), rng.normal(size=(500, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    r = spark.createDataFrame([(k, *map(float, a), *map(float, b), 0.0, 1e300, -1) for k, (a, b) in enumerate(zip(o, d, strict=True))], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, t_min double, t_max double, category_mask long")
    p = rays.parity(rays.closest(r, t, KEYS, "nested"), rays.closest(r, t, KEYS, plan), KEYS).first()
    assert p["rays"] == 500 and p["state_mismatches"] == 0 and p["identity_mismatches"] == 0 and p["max_distance_error"] < 1e-9
    assert ray_hits(r, t, KEYS, strategy="nested").count() == ray_hits(r, t, KEYS, strategy=plan).count()


def test_sky_view_limits(spark):
    empty = sun.sky_view_summary(sun.sky_view_timeline(sensors(spark), none(spark), 64)).first()
    assert empty["sky_view_factor"] == 1 and empty["visible_fraction"] == 1
    lid = big(spark, 0.001, x=-1e3).withColumn("bx", F.lit(1e6)).withColumn("cy", F.lit(1e6)).withColumn("ay", F.lit(-1e3)).withColumn("by", F.lit(-1e3))
    covered = sun.sky_view_summary(sun.sky_view_timeline(sensors(spark), lid, 64)).first()
    assert covered["sky_view_factor"] == 0 and covered["dominant_object_id"] == 1


def test_perez_on_the_horizontal_is_the_diffuse(spark):
    parts = perez(F.lit(500.0), F.lit(100.0), F.lit(math.radians(40)), F.cos(F.lit(math.radians(40))), F.lit(1.0))
    assert spark.range(1).select(parts["total"].alias("t")).first()["t"] == pytest.approx(100.0)


def test_open_irradiance_and_losses(spark):
    w = spark.createDataFrame([(0, 0.0, 0.0, 1.0, True, 1.0, 800.0, 100.0, 900.0)], "sun_index int, dx double, dy double, dz double, is_active boolean, duration_hours double, dni double, dhi double, ghi double")
    r = daylight.annual_irradiance(sensors(spark), w, none(spark)).first()
    assert r["total_wh"] == pytest.approx(900.0) and r["ground_wh"] == 0 and r["loss_wh"] == 0
    r = daylight.annual_irradiance(sensors(spark), w, big(spark)).first()
    assert r["direct_wh"] == 0 and r["loss_wh"] >= 800 and r["dominant_object_id"] == 1
    g = daylight.annual_irradiance(sensors(spark, (1, 0, 0)), w, none(spark)).first()
    assert g["ground_wh"] == pytest.approx(900 * 0.2 / 2)


def test_zenith_sun_and_glazing(spark):
    m, a = materials(spark)
    s = sensors(spark)
    clear = daylight.coefficient_matrix(s, none(spark), m, a, patches=64)
    p = daylight.point_illuminance(s, clear, (0, 0, 1), 50_000.0, 10_000.0, none(spark), m, a, patches=64).first()
    assert (p["direct"], p["diffuse"]) == (pytest.approx(50_000), pytest.approx(10_000))
    assert daylight.daylight_factor(clear, 64).first()["daylight_factor"] == pytest.approx(100)
    p = daylight.point_illuminance(s, clear, (0, 0, 1), 50_000.0, 10_000.0, big(spark), m, a, patches=64).first()
    assert p["direct"] == pytest.approx(25_000)


def test_scenarios_against_the_first(spark):
    sc = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.0)], "scenario_id int, object_id long, coefficient double")
    t = sun.scenario_timeline(sensors(spark), suns(spark, (0, 0, 1)), big(spark), sc)
    s = {r["scenario_id"]: r for r in sun.scenario_summary(t).collect()}
    assert s[1]["received_hours"] == 0.5 and s[2]["received_delta"] == -0.5
    top = sun.top_losses(sun.scenario_losses(t)).where("scenario_id = 1").first()
    assert top["loss"] == 0.5 and top["fraction"] == 1 and top["rank"] == 1


def test_envelope_heights(spark):
    c = spark.createDataFrame([(1, 5.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, -500.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "candidate_id long, bx double, by double, bz double, ax double, ay double, az double")
    e = {r["candidate_id"]: r for r in sun.solar_envelope(c, sensors(spark), suns(spark, (0.6, 0, 0.8)), none(spark)).collect()}
    assert e[1]["access_height"] == pytest.approx(5 * 0.8 / 0.6 - 0.05) and e[1]["control_sensor_id"] == 1
    assert e[2]["constraints"] == 0 and e[2]["access_height"] is None


def test_envelopes_meet_axes_along_the_rays_only(spark):
    rng = np.random.default_rng(3)
    feet, places, ways = rng.uniform(-90, 90, (600, 2)), rng.uniform(-60, 60, (20, 2)), [(0.6, 0, 0.8), (-0.48, 0.64, 0.6), (0, 0, 1), (0.96, 0, 0.28)]
    c = spark.createDataFrame([(k, *map(float, f), 0.0, 0.0, 0.0, 1.0) for k, f in enumerate(feet)], "candidate_id long, bx double, by double, bz double, ax double, ay double, az double")
    s = spark.createDataFrame([(k, *map(float, p), 0.0, 0.0, 0.0, 1.0) for k, p in enumerate(places)], "sensor_id long, px double, py double, pz double, nx double, ny double, nz double")
    met = [tuple(r) for r in sun._along(s.crossJoin(suns(spark, *ways)), c, 1.0, 60.0).select("sensor_id", "sun_index", "candidate_id").collect()]
    assert len(met) == len(set(met)) < 20 * 4 * 600 / 10
    want = {}
    for i, p in enumerate(places):
        for j, d in enumerate(np.array(ways)[:, :2]):
            t = (feet - p) @ d / max(d @ d, 1e-300)
            for k in np.flatnonzero((t > 0) & (t <= 60) & (np.linalg.norm(p + t[:, None] * d - feet, axis=1) <= 1.0)):
                want[i, j, int(k)] = t[k]
    assert len(want) > 50 and set(want) <= set(met)
    n = {r["candidate_id"]: r["constraints"] for r in sun.solar_envelope(c, s, suns(spark, *ways), none(spark), radius=1.0, max_distance=60.0).collect()}
    assert n == {k: sum(x[2] == k for x in want) for k in range(600)}


def test_pv_quantiles_and_regions(spark):
    cells = spark.createDataFrame([(1, 1.0, 900_000.0), (2, 1.0, 1_000_000.0), (3, 2.0, 850_000.0), (4, 1.0, 10.0)], "sensor_id long, area double, energy double")
    p = sun.pv_potential(cells).first()
    assert (p["cells"], p["area"], p["p10"], p["p50"], p["p90"]) == (3, 4.0, 850_000, 850_000, 1_000_000)
    n = spark.createDataFrame([(1, 2), (3, 4)], "i long, j long")
    r = {x["sensor_id"]: x["region"] for x in sun.pv_regions(cells, n).collect()}
    assert r == {1: 1, 2: 1, 3: 2}


def test_deltas_fold_and_refuse(spark):
    kind = "instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string"
    i = spark.createDataFrame([(1, 1, 1, V.IDENTITY, -1, "static"), (2, 2, 1, V.IDENTITY, -1, "static")], kind)
    d = spark.createDataFrame([(1, "update", 1, None, None, None, 3, None), (2, "remove", 2, None, None, None, None, None), (3, "add", 3, 7, 1, V.IDENTITY, -1, "dynamic"), (4, "update", 1, 9, None, None, None, None)], "seq long, kind string, instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string")
    out, report = scene.apply_deltas(i, d)
    rows = {r["instance_id"]: r for r in out.collect()}
    assert set(rows) == {1, 3} and rows[1]["category_mask"] == 3 and rows[1]["object_id"] == 9 and report.first()["update"] == 2
    with pytest.raises(ValueError):
        scene.apply_deltas(i, d.where("seq = 1").withColumn("instance_id", F.lit(99).cast("long")))
    with pytest.raises(ValueError):
        scene.apply_deltas(i, d.where("kind = 'remove'").unionByName(d.where("kind = 'remove'").withColumn("instance_id", F.lit(1).cast("long"))))


def test_mirrored_instances_keep_their_front(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0)], "mesh_id long, vertex_index long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2)], "mesh_id long, face_index long, v0 long, v1 long, v2 long")
    m = list(V.IDENTITY)
    m[0] = -1.0
    i = spark.createDataFrame([(1, 1, 1, V.IDENTITY, 0, "s"), (2, 2, 1, m, 0, "s")], "instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string")
    t = {r["instance_id"]: r for r in scene.world_triangles(v, f, i).collect()}
    assert not t[1]["mirrored"] and t[2]["mirrored"] and t[2]["bx"] == -1.0 and t[1]["category_mask"] == -1
    inv = spark.createDataFrame([(m,)], "m array<double>").select(V.inverse(F.col("m")).alias("i")).first()["i"]
    assert inv[0] == -1.0 and inv[5] == 1.0


def test_annual_metrics_and_validation(spark):
    pairs = spark.createDataFrame([(100.0, 100.0), (200.0, 200.0)], "value double, reference double")
    c = daylight.compare(pairs).first()
    assert c["bias"] == 0 and c["r_squared"] == 1 and c["accepted"] == 2


def hours_of(spark, *rows):
    """Hours (sun_index, d*, is_active) of noon."""
    return spark.createDataFrame([(k, *map(float, d), on, 1.0, 700.0 + k, 100.0, 900.0, 43200) for k, d, on in rows], "sun_index int, dx double, dy double, dz double, is_active boolean, duration_hours double, dni double, dhi double, ghi double, midpoint_unix long")


def test_hours_of_one_direction_share_a_ray(spark, monkeypatch):
    every = [(0, (0, 0, 1), True), (1, (0.6, 0, 0.8), True), (2, (0, 0, 1), True), (3, (0, 0, 1), False), (4, (0, 0.8, -0.6), False)]
    traced, own = [], daylight.closest
    monkeypatch.setattr(daylight, "closest", lambda rays, *rest, **options: (traced.append(rays), own(rays, *rest, **options))[1])
    s, t = sensors(spark, (0, 0, 1), (0, 0, -1)), big(spark, x=-0.3)
    whole = {(r["sensor_id"], r["sun_index"]): r for r in daylight.irradiance_timeline(s, hours_of(spark, *every), t).collect()}
    assert traced[0].count() == 2 * 3 and len(whole) == 2 * 5
    for h in every:
        for r in daylight.irradiance_timeline(s, hours_of(spark, h), t).collect():
            assert r == whole[r["sensor_id"], h[0]]


def test_a_scene_is_built_once_for_rays_to_sky_and_sun(spark, monkeypatch):
    from solvane.plans import bvh

    built, own = [], bvh._built
    monkeypatch.setattr(bvh, "_built", lambda t: (built.append(t), own(t))[1])
    daylight.annual_irradiance(sensors(spark), hours_of(spark, (0, (0, 0, 1), True)), big(spark)).collect()
    assert len(built) == 1


def test_annual_daylight_by_directions_equals_it_by_hours(spark):
    w = daylight.with_turns(hours_of(spark, (0, (0, 0, 1), True), (1, (0.6, 0, 0.8), True), (2, (0, 0, 1), True), (3, (0, 0, 1), False)))
    s, t, (m, a) = sensors(spark, (0, 0, 1), (0, 0, -1)), big(spark, x=-0.3), materials(spark)
    through = daylight.sun_transmission(s, w, t, m, a)
    assert through.count() == 2
    hours = through.join(w.where("is_active").select("turn", "sun_index"), "turn").select("sensor_id", "sun_index", "transmission")
    year = lambda x: sorted(daylight.annual_daylight(s, daylight.coefficient_matrix(s, rays.with_transmittance(t, m, a, "visible_t"), m, a, patches=16), w, x, patches=16).collect())
    assert year(through) == year(hours) and [r["hours"] for r in year(through)] == [4.0, 4.0]
    assert year(through)[0]["ase_hours"] == 3.0


def test_a_project_builds_one_scene(spark, data, monkeypatch):
    from solvane import queries
    from solvane.plans import bvh

    built, own = [], bvh._built
    monkeypatch.setattr(bvh, "_built", lambda t: (built.append(t), own(t))[1])
    assert queries.QUERIES["daylight_project"](spark, data).count() == 1 and len(built) == 1


def test_a_project_counts_events_into_hours_once(spark, data):
    from solvane import queries

    plan = queries.QUERIES["daylight_project"](spark, data)._jdf.queryExecution().toString()
    assert "event_type" not in plan
