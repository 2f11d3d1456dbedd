import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvane import fixtures as fx
from solvane import queries
from solvane.core import InvalidInput
from solvane.operators import evidence, graphs, ordering, rays, study, visibility

TRI = "object_id long, instance_id long, mesh_id long, triangle_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, category_mask long, mirrored boolean"


def walls(spark, *quads):
    """Upright quads (object_id, x1, y1, x2, y2) from z -10 to 10."""
    rows = []
    for o, x1, y1, x2, y2 in quads:
        a, b, c, d = (x1, y1, -10.0), (x2, y2, -10.0), (x2, y2, 10.0), (x1, y1, 10.0)
        rows += [(o, o, 1, 0, *map(float, a + b + c), -1, False), (o, o, 1, 1, *map(float, a + c + d), -1, False)]
    return spark.createDataFrame(rows, TRI)


def room(spark):
    return walls(spark, (1, -5, -5, 5, -5), (2, 5, -5, 5, 5), (3, 5, 5, -5, 5), (4, -5, 5, -5, -5))


def test_isovist_of_a_square_room(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "viewpoint_id long, px double, py double, pz double")
    s = visibility.isovist_summary(visibility.isovist_rays(v, room(spark), 360)).first()
    assert s["area"] == pytest.approx(100, rel=1e-2) and s["min_radius"] == pytest.approx(5, rel=1e-3) and s["compactness"] < 1


def test_privacy_formula_and_states(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.5)], "observer_id long, px double, py double, pz double, weight double")
    t = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 20.0, 0.0, 1.0), (4, 90.0, 0.0, 0.0, 1.0)], "target_id long, qx double, qy double, qz double, sensitivity double")
    p = {r["target_id"]: r for r in visibility.intervisibility(o, t, walls(spark, (7, -5, 10, 5, 10)), max_distance=50).collect()}
    assert [p[k]["state"] for k in (1, 2, 3, 4)] == ["visible", "coincident", "blocked", "out_of_range"]
    assert p[1]["risk"] == pytest.approx(0.25) and p[3]["object_id"] == 7
    c = visibility.visibility_counts(visibility.intervisibility(o, t, walls(spark, (7, -5, 10, 5, 10)), max_distance=50), "observer_id").first()
    assert c["visible_fraction"] == pytest.approx(1 / 3) and c["combined_risk"] == pytest.approx(0.25)


def test_graph_measures_of_a_path(spark):
    n = spark.createDataFrame([(k,) for k in range(5)], "idx long")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i long, j long")
    c = {r["idx"]: r for r in graphs.centralities(n, e).collect()}
    assert c[1]["betweenness"] == pytest.approx(4 / 12) and c[0]["closeness"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 4)
    d = {r["idx"]: r["degree"] for r in graphs.degrees(n, e).collect()}
    assert d == {0: 1, 1: 2, 2: 2, 3: 1, 4: 0}
    assert {r["idx"]: r["component"] for r in graphs.with_components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}


def test_centralities_of_more_paths_than_a_float_counts(spark):
    many = 1100  # diamonds in a row, so 2 ** 1100 shortest paths from end to end
    e = [(3 * k + a, 3 * k + b) for k in range(many) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    n = 3 * many + 1
    got = {r["idx"]: r["betweenness"] * (n - 1) * (n - 2) for r in graphs.centralities(spark.range(n).toDF("idx"), spark.createDataFrame(e, "i long, j long")).collect()}
    # a joint has all pairs across it, and half of the paths of the twins beside it; a twin has half of the pairs across its diamond
    for k in (0, 1, 40, many // 2, many - 1):
        assert got[3 * k] == pytest.approx(2 * (3 * k) * (n - 1 - 3 * k) + (1 if k == 0 else 2), rel=1e-9)
        assert got[3 * k + 1] == pytest.approx((3 * k + 1) * (n - 3 * k - 3), rel=1e-9) and got[3 * k + 2] == pytest.approx(got[3 * k + 1], rel=1e-9)


def test_greedy_cap_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 15, (60, 2)) if a != b})
    rows = [(i, j, float(rng.integers(1, 8))) for i, j in pairs]
    degree, want = {}, set()
    for i, j, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if degree.get(i, 0) < 3 and degree.get(j, 0) < 3:
            want.add((i, j))
            degree[i] = degree.get(i, 0) + 1
            degree[j] = degree.get(j, 0) + 1
    got = visibility.capped(spark.createDataFrame(rows, "i long, j long, distance double"), 3)
    assert {(r["i"], r["j"]) for r in got.collect()} == want


def test_target_view_fraction_and_green_share(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "observer_id long, px double, py double, pz double, fx double, fy double, fz double, ux double, uy double, uz double, weight double")
    p = spark.createDataFrame([(1, 0, 10.0, 1.0, -1.0, 10.0, -1.0, -1.0, 10.0, -1.0, 1.0, 2, 1.0)], "target_id long, patch_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, mask long, category_weight double")
    s = visibility.target_view_samples(o, p, spark.createDataFrame([], TRI), two_sided=True)
    r = visibility.target_view_pairs(s).first()
    assert r["fraction"] == pytest.approx(1) and r["potential"] == pytest.approx(0.02, rel=0.02)
    g = visibility.target_view_observers(s, green_mask=2).first()
    assert g["green_index"] == pytest.approx(g["target_view_factor"]) and g["dominant_target_id"] == 1
    hidden = visibility.target_view_pairs(visibility.target_view_samples(o, p, walls(spark, (9, 5, -5, 5, 5)), two_sided=True)).first()
    assert hidden["fraction"] == 0 and hidden["dominant_object_id"] == 9


def test_corridor_path_and_landmark(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 1.0)], "corridor_id long, px double, py double, pz double, qx double, qy double, qz double, radius double")
    half = visibility.corridors(c, walls(spark, (3, 10, 0, 10, 5)), 256).first()
    assert 0.4 < half["open_fraction"] < 0.6 and half["nearest_object_id"] == 3
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 0.0, 0.0), (1, 2, 3.0, 4.0, 0.0)], "path_id long, k long, x double, y double, z double")
    rows = visibility.path_observers(p, 2.0).orderBy("sample").collect()
    assert len(rows) == 5 and rows[-1]["py"] == 4 and sum(r["trapezoid"] for r in rows) == pytest.approx(7) and rows[0]["fx"] == 1 and rows[-1]["fy"] == 1
    v = visibility.path_observers(p, 2.0).withColumn("value", F.when(F.col("sample") < 2, 1.0).otherwise(2.0))
    s = visibility.path_summary(v).first()
    assert s["worst_sample"] == 0 and s["best_sample"] == 4
    o = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "observer_id long, px double, py double, pz double, fx double, fy double, fz double, ux double, uy double, uz double")
    m = spark.createDataFrame([(1, 20.0, 0.0, 0.0, 1.0, 1.0), (2, -20.0, 0.0, 0.0, 1.0, 1.0)], "landmark_id long, qx double, qy double, qz double, radius double, weight double")
    mats = spark.createDataFrame([(1, 0.5, 0.5)], "material_id long, visible_t double, solar_t double")
    own = spark.createDataFrame([(3, 1)], "object_id long, material_id long")
    lm = {r["landmark_id"]: r for r in visibility.landmarks(o, m, walls(spark, (3, 10, -5, 10, 5)), mats, own).collect()}
    assert lm[1]["transmission"] == pytest.approx(0.5) and not lm[2]["in_view"] and lm[1]["solid_angle"] == pytest.approx(2 * math.pi * (1 - math.sqrt(1 - 1 / 400)))


def test_components_at_once_and_by_rounds(spark, data):
    """A chain through shuffled ids, a ring, a loop; and places within a range, whose copies on cells are not broadcast."""
    rows = [(k * 37 % 101, (k + 1) * 37 % 101) for k in range(60)] + [(k, k % 5 + 1001) for k in range(1001, 1006)] + [(2000, 2000)]
    links = spark.createDataFrame(rows, "a long, b long")
    once, rounds = (sorted(map(tuple, graphs.components(links, n).collect())) for n in (1000, 0))
    assert once == rounds and {c for _, c in once} == {min(x for x, _ in rows[:60]), 1001, 2000}
    assert graphs.components(links.where("a < 0")).count() == 0
    assert "BroadcastHashJoin" not in visibility.near_pairs(fx.nodes(spark, data), 25.0)._jdf.queryExecution().executedPlan().toString()


def test_a_path_keeps_every_sample(spark):
    places = [0.0, 2.3, 4.6, 4.699999999999999, 5.799999999999999]
    p = spark.createDataFrame([(1, k, x, 0.0, 0.0) for k, x in enumerate(places)] + [(2, k, 0.1 * k, 0.0, 0.0) for k in range(5000)], "path_id long, k long, x double, y double, z double")
    rows = visibility.path_observers(p, 1.0).groupBy("path_id").agg(F.sort_array(F.collect_list("sample")).alias("n"), F.max("at").alias("end"), F.max("px").alias("px")).orderBy("path_id").collect()
    assert [r["n"] for r in rows] == [list(range(math.ceil(round(end, 9)) + 1)) for end in (places[-1], 499.9)]
    assert all(r["end"] == pytest.approx(end, abs=1e-12) and r["px"] == pytest.approx(end, abs=1e-9) for r, end in zip(rows, (places[-1], 499.9), strict=True))


def test_isovist3d_without_an_object(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "viewpoint_id long, px double, py double, pz double")
    mats = spark.createDataFrame([], "material_id long, visible_t double, solar_t double")
    own = spark.createDataFrame([], "object_id long, material_id long")
    layers = visibility.isovist3d_layers(v, walls(spark, (3, 5, -50, 5, 50)), mats, own, samples=128)
    base = visibility.isovist3d(layers, 128).first()
    top = visibility.isovist3d_attribution(layers, 128)
    out = visibility.isovist3d_counterfactuals(layers, top, 128).first()
    assert base["openness"] < 1 and out["openness"] == 1 and out["volume"] == pytest.approx(4 / 3 * math.pi * 1e6) and top.first()["object_id"] == 3


def test_pareto_rank_hypervolume_and_crowding(spark):
    rows = spark.createDataFrame([(1, 1.0, 4.0, 0.0), (2, 2.0, 2.0, 0.0), (3, 4.0, 1.0, 0.0), (4, 3.0, 3.0, 0.0), (5, 0.0, 0.0, 2.0), (6, 0.0, 0.0, 1.0)], "candidate_id long, a double, b double, r double")
    k = {x["candidate_id"]: x for x in study.rank_study(rows, {"a": "min", "b": "min"}, ["r"]).collect()}
    assert [k[i]["rank"] for i in range(1, 7)] == [0, 0, 0, 1, 3, 2] and k[4]["dominated_count"] == 1
    assert k[2]["crowding"] == pytest.approx(2.0) and k[1]["crowding"] is None
    front = study.pareto_front(rows, {"a": "min", "b": "min"}, ["r"])
    assert {x["candidate_id"] for x in front.collect()} == {1, 2, 3}
    assert study.hypervolume_2d(front, "a", "b", (5.0, 5.0)).first()["hypervolume"] == 4 * 1 + 3 * 2 + 1 * 1
    rho = study.spearman(rows.where("candidate_id <= 3"), ["a"], ["b"]).first()["rho"]
    assert rho == pytest.approx(-1)


def test_holm_and_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    h = {r["name"]: r["p_holm"] for r in study.holm(p, "p", ["name"]).collect()}
    assert h == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06)}
    rng = np.random.default_rng(0)
    x = rng.random(60)
    d = spark.createDataFrame([(float(a), float(a + 0.1 * b), float(b)) for a, b in zip(x, rng.random(60), strict=True)], "x double, y double, z double")
    s = {r["objective"]: r for r in study.statistical_sensitivity(d, ["x"], ["y", "z"], bootstrap=50, permutations=50).collect()}
    assert s["y"]["significant"] and s["y"]["low"] <= s["y"]["rho"] <= s["y"]["high"] and s["y"]["p"] == pytest.approx(1 / 51)


def test_optimizer_resumes_exactly():
    import pandas as pd

    def evaluate(c):
        c = c.copy()
        c["objectives"] = [[v[0], (1 - v[0]) ** 2 + v[1]] for v in c["values"]]
        c["residuals"] = [[0.0]] * len(c)
        return c

    a = study.Optimizer([study.Variable("x", 0, 1), study.Variable("k", 0, 3, "integer"), study.Variable("c", 0, 2, "categorical")], ["min", "min"], population=12, offspring=12)
    a.tell(evaluate(a.ask()))
    b = study.Optimizer.resume(a.checkpoint())
    for _ in range(3):
        x, y = a.ask(), b.ask()
        pd.testing.assert_frame_equal(x, y)
        a.tell(evaluate(x))
        b.tell(evaluate(y))
    assert a.checkpoint() == b.checkpoint() and all(m["rank"] == 0 for m in a.archive)


def test_sobol_and_morris_know_a_linear_model(spark):
    d = evidence.saltelli_design(spark, [(0, 1), (0, 1)], 8192)
    s = {r["parameter"]: r for r in evidence.sobol_indices(d.select("block", "base", (F.element_at("values", 1) + 2 * F.element_at("values", 2)).alias("y"))).collect()}
    assert s[0]["first_order"] == pytest.approx(0.2, abs=0.05) and s[1]["total"] == pytest.approx(0.8, abs=0.05)
    m = evidence.morris_effects(evidence.morris_design(spark, [(0, 1), (0, 1)], 8).select("trajectory", "step", "changed", "delta", (F.element_at("values", 1) + 2 * F.element_at("values", 2)).alias("y")))
    assert {r["parameter"]: round(r["mu_star"], 9) for r in m.collect()} == {0: 1.0, 1: 2.0}
    with pytest.raises(InvalidInput):
        evidence.sobol_indices(d.select("block", "base", F.lit(1.0).alias("y")))


def test_cvar_intervals_and_calibration(spark):
    o = spark.createDataFrame([(1, 1, 0.8, 1.0, -1.0), (1, 2, 0.2, 5.0, 1.0)], "candidate_id long, scenario_id int, probability double, objective double, residual double")
    r = evidence.robust_scenarios(o).first()
    assert (r["mean"], r["worst"], r["cvar"], r["violation_probability"]) == (pytest.approx(1.8), 5, pytest.approx(5), pytest.approx(0.2))
    u = spark.createDataFrame([(1, 1.0, 0.1), (2, 2.0, 0.1), (3, 1.3, 0.1)], "candidate_id long, o double, o_sd double")
    k = {x["candidate_id"]: x["rank"] for x in evidence.uncertainty_ranking(u, {"o": "min"}).collect()}
    assert k == {1: 0, 2: 1, 3: 0}
    f = [(i, "fast", float(i), 1.0) for i in range(1, 6)] + [(i, "reference", 1 + 2.0 * i, 10.0) for i in (1, 3, 5)]
    obs = spark.createDataFrame(f, "candidate_id long, fidelity string, objective double, cost double")
    c = evidence.calibration(obs).first()
    assert c["slope"] == pytest.approx(2) and c["intercept"] == pytest.approx(1)
    best = evidence.recommend(obs.withColumn("objectives", F.array("objective", -F.col("objective"))), ["min", "min"], batch=5, draws=32)
    assert {r["candidate_id"] for r in best.collect()} == {2, 4}


def test_passports_scenarios_and_workspaces(spark, tmp_path):
    p = evidence.seal({"study_id": "s", "candidate_id": 1, "engine_version": "1", "created_at": "2024-01-01T00:00:00Z", "input_hashes": {"a": "b"}})
    assert evidence.validate(p) and not evidence.validate(p | {"candidate_id": 2})
    with pytest.raises(InvalidInput):
        evidence.seal({"study_id": "s"})
    f = spark.createDataFrame([("a", "x", [1.0, 2.0]), ("b", "x", [2.0, 5.0])], "scenario_id string, name string, values array<double>")
    d = study.compare_scenarios(f, "a").first()
    assert (d["min_delta"], d["mean_delta"], d["max_delta"]) == (1, 2, 3) and d["rms_delta"] == pytest.approx(math.sqrt(5))
    manifest = {"parameters": [{"name": "w", "low": 0, "high": 1}], "objectives": [{"name": "e", "direction": "min"}]}
    w = study.Workspace.create(str(tmp_path / "w"), manifest)
    assert w.commit(1, [{"id": 1}]) and not w.commit(1, [{"id": 1}]) and w.rows() == [{"id": 1}]
    with pytest.raises(InvalidInput):
        w.commit(1, [{"id": 2}])
    (tmp_path / "w/batches/00000001.json").write_text(json.dumps({"rows": [], "sha256": "0"}))
    with pytest.raises(InvalidInput):
        w.rows()


def test_legend_and_comparison(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, None), (4, float("inf"))], "viewpoint_id long, v double")
    out, ticks = visibility.legend(d, "v")
    assert [r["normalised"] for r in out.orderBy("viewpoint_id").collect()][:2] == [0, 1] and ticks["value"].tolist() == [0, 2.5, 5, 7.5, 10]
    a = d.where("viewpoint_id <= 2")
    assert visibility.compare_metrics(a, a.withColumn("v", F.col("v") + 1), "viewpoint_id", ["v"]).agg(F.sum("v_delta")).first()[0] == 2
    with pytest.raises(InvalidInput):
        visibility.compare_metrics(a, a.where("viewpoint_id = 1"), "viewpoint_id", ["v"])


def test_workspaces_take_uris_and_refuse_old_folders(spark, tmp_path):
    manifest = {"parameters": [{"name": "w", "low": 0, "high": 1}], "objectives": [{"name": "e", "direction": "min"}]}
    w = study.Workspace.create(f"file://{tmp_path}/w", manifest, spark)
    assert w.manifest() == manifest and w.commit(2, [{"id": 2}]) and w.commit(1, [])
    assert study.Workspace(f"file://{tmp_path}/w", spark).rows() == [{"id": 2}]
    with pytest.raises(InvalidInput):
        study.Workspace.create(f"file://{tmp_path}/w", manifest, spark)


def test_ranking_at_once_equals_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.integers(0, 12)), float(rng.integers(0, 12)), float(rng.integers(0, 12)), float(rng.integers(-3, 2))) for k in range(120)]
    d = spark.createDataFrame(rows, "candidate_id long, a double, b double, c double, r double")
    for objectives in ({"a": "max", "b": "min"}, {"a": "min", "b": "min", "c": "max"}):
        once, rounds = ({r["candidate_id"]: r.asDict() for r in study.rank_study(d, objectives, ["r"], at_once=n).collect()} for n in (1000, 0))
        assert once == rounds and max(r["rank"] for r in once.values()) > 3
    assert study.rank_study(d.where("r > 0"), {"a": "min"}, ["r"]).agg(F.min("rank")).first()[0] == 0
    assert study.rank_study(d.where("false"), {"a": "min"}, ["r"]).count() == 0


def test_running_sums_and_ranks_over_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 3)), None if rng.random() < 0.05 else float(rng.integers(0, 40)), float(rng.integers(1, 5))) for _ in range(500)] + [(0, 7.0, 1.0)] * 300
    d = spark.createDataFrame(rows, "g int, v double, w double").repartition(7)
    for r in ordering.running(d, ["g"], "v", "w").collect():
        own = [(v, w) for g, v, w in rows if g == r["g"] and v is not None]
        assert r["before"] == sum(w for v, w in own if v < r["v"]) and r["weight"] == sum(w for v, w in own if v == r["v"]) and r["total"] == sum(w for _, w in own)
    import pandas as pd

    want = pd.Series([v for _, v, _ in rows]).rank()
    got = ordering.average_ranks(d, ["v"])
    assert sorted((r["v"], r["r_v"]) for r in got.where("v is not null").collect()) == sorted((v, x) for (_, v, _), x in zip(rows, want, strict=True) if v is not None)


def test_plans_of_views_stay_small(spark, data):
    for name in ("corridor_summary", "landmark_visibility", "sky_view", "target_view", "solar_envelope", "direct_sun_timeline", "intervisibility"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 60_000, (name, len(plan))


def test_far_pairs_can_be_counted_without_listing_them(spark, data):
    o, t, tri = fx.observers(spark, data), fx.targets(spark, data), fx.triangles(spark, data)
    every = visibility.intervisibility(o, t, tri, max_distance=40)
    near = visibility.intervisibility(o, t, tri, max_distance=40, far=False)
    assert near.count() < every.count() == o.count() * t.count()
    a = visibility.visibility_counts(every, "observer_id")
    b = visibility.visibility_counts(near, "observer_id", o, t.count())
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("plan", ["bvh", "voxel", "nested"])
def test_plans_agree_on_layers_and_inactive_rays(spark, data, plan):
    tri = fx.triangles(spark, data)
    r = queries.sun_rays(spark, data)
    got = rays.transmission(r, tri, queries.KEYS, fx.materials(spark), fx.assignment(spark, data), strategy=plan, carry=["cosine"] if "cosine" in r.columns else None, active=F.col("sun_index") != 2)
    rows = {(x["sensor_id"], x["sun_index"]): (x["transmission"], x["layer_count"]) for x in got.collect()}
    want = {(x["sensor_id"], x["sun_index"]): (x["transmission"], x["layer_count"]) for x in rays.transmission(r, tri, queries.KEYS, fx.materials(spark), fx.assignment(spark, data), strategy="voxel").collect()}
    assert rows == {k: (1.0, 0) if k[1] == 2 else v for k, v in want.items()}
    hit = rays.closest(r, tri, queries.KEYS, strategy=plan, active=F.col("sun_index") != 2)
    assert hit.count() == r.count() and hit.where("sun_index = 2 and hit").isEmpty()


def test_two_objectives_are_ranked_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for step in (1.0, 4e-13, 1e-12):  # also costs that are told apart within the tolerance only
        c = rng.integers(0, 30, (300, 2)) * step
        assert (study.swept_ranks(c) == study.front_ranks(c)).all()
        beats = ((c[:, None] <= c[None] + 1e-12).all(2) & (c[:, None] < c[None] - 1e-12).any(2)).sum(0)
        assert (study.swept_counts(c) == beats).all()
    rows = [(k, float(rng.integers(0, 12)), float(rng.integers(0, 12)), float(rng.integers(-3, 2))) for k in range(120)]
    d = spark.createDataFrame(rows, "candidate_id long, a double, b double, r double")
    taken = lambda **o: sorted(map(tuple, study.rank_study(d, {"a": "max", "b": "min"}, ["r"], at_once=0, **o).collect()))
    rounds = taken(swept=0)
    monkeypatch.setattr(study, "_ranked_by_rounds", None)
    assert taken() == rounds


def test_growth_of_a_front_is_the_difference_of_areas():
    rng = np.random.default_rng(6)

    def area(points, reference):
        top, out = reference[1], 0.0
        for x, y in sorted(p for p in points.tolist() if p[0] < reference[0] and p[1] < reference[1]):
            if y < top:
                out, top = out + (reference[0] - x) * (top - y), y
        return out

    far = np.array([10.0, 10.0])
    for n in (0, 1, 40):
        known = rng.integers(0, 12, (n, 2)).astype(float)
        points = rng.integers(-1, 13, (300, 2)) + rng.choice([0.0, 0.5], (300, 2))
        real = [area(np.vstack([known, p]), far) - area(known, far) for p in points]
        assert evidence.Growth(known, far).of(points[:, 0], points[:, 1]) == pytest.approx(real, abs=1e-9)
    seeds = np.array([-3, 0, 42, 7919 * 10**6])
    assert (study._draws(seeds, 5) == np.stack([study._draws(int(k), 5) for k in seeds])).all()


def test_intervals_are_ranked_at_once_as_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, float(rng.integers(0, 40)), float(rng.integers(0, 4)), float(rng.integers(-3, 3)), float(rng.integers(0, 2))) for k in range(80)] + [(80, None, None, -9.0, 0.0), (81, math.nan, 1.0, -9.0, 0.0), (82, 3.0, None, -9.0, 0.0)]
    d = spark.createDataFrame(rows, "candidate_id long, o double, o_sd double, r double, r_sd double")
    taken = lambda **a: {x["candidate_id"]: (x["rank"], x["tier"]) for x in evidence.uncertainty_ranking(d, {"o": "max"}, ["r"], **a).collect()}
    rounds = taken(at_once=0)
    cuts = []
    monkeypatch.setattr(evidence, "_cut", lambda df: cuts.append(1) or df)
    assert taken() == rounds and len(rounds) == 83 and len(cuts) == 1
    assert evidence.uncertainty_ranking(d.where("false"), {"o": "min"}).count() == 0


def test_scenes_are_built_by_a_task_and_not_drawn_out(spark, data, monkeypatch):
    from solvane.plans import bvh

    t = fx.triangles(spark, data)
    wide = t.unionByName(t.withColumns({c: F.col(c) + 10_000 for c in ("ax", "bx", "cx")}).withColumn("object_id", F.col("object_id") + 1_000_000))
    r = queries.sun_rays(spark, data)
    want = {tuple(x) for x in rays.closest(r, wide, queries.KEYS, "voxel").select(*queries.KEYS, "hit", "distance", "object_id", "triangle_id").collect()}
    scene = bvh.Scene(wide.toArrow())
    n = scene.tree.real
    ray, _ = scene.tree.candidates(np.stack([np.full(50, 100.0), np.linspace(0, 200, 50), np.full(50, 1.6)]), np.stack([np.full(50, 0.6), np.zeros(50), np.full(50, 0.8)]), np.zeros(50), np.full(50, 10.0))
    assert len(ray) < 50 * n / bvh.LEAF / 10
    monkeypatch.setattr(bvh.Scene, "__init__", None)  # not by the driver
    got = {tuple(x) for x in rays.closest(r, wide, queries.KEYS, "bvh").select(*queries.KEYS, "hit", "distance", "object_id", "triangle_id").collect()}
    assert got == want


def test_crowding_of_larger_studies_needs_no_rounds(spark, monkeypatch):
    rows = [(k, float(k % 7), float((k * 5) % 11), 0.0) for k in range(60)]
    d = spark.createDataFrame(rows, "candidate_id long, a double, b double, r double")
    taken = lambda n: {x["candidate_id"]: x["crowding"] for x in study.rank_study(d, {"a": "max", "b": "min"}, ["r"], at_once=n).collect()}
    once = taken(1000)
    monkeypatch.setattr(study, "_ranked_by_rounds", None)
    assert taken(0) == once and any(x is not None for x in once.values())


def test_far_pairs_are_dealt_out_to_all_tasks(spark, data):
    from solvane import fixtures as fx

    tri = fx.triangles(spark, data)
    o, n = fx.observers(spark, data).coalesce(1), fx.nodes(spark, data).coalesce(1)
    looks = o.select("observer_id", "px", "py", "pz", *[F.lit(float(v)).alias(c) for c, v in (("fx", 1), ("fy", 0), ("fz", 0), ("ux", 0), ("uy", 0), ("uz", 1))])
    marks = fx.targets(spark, data).select(F.col("target_id").alias("landmark_id"), "qx", "qy", "qz", F.lit(2.0).alias("radius"), F.lit(1.0).alias("weight"))
    empty = fx.materials(spark), fx.assignment(spark, data)
    for far in (
        visibility.intervisibility(o, fx.targets(spark, data), tri, max_distance=1e-3),
        visibility.graph_pairs(n, tri, max_distance=1e-3),
        visibility.landmarks(looks, marks, tri, *empty, samples=1, max_distance=1e-3),
    ):
        assert far.groupBy(F.spark_partition_id()).count().count() == 4


def _shuffled_rays(df):
    """Whether the optimised plan deals rows out between the join that makes pairs and the walk of their rays."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    walk = plan[plan.index("MapInArrow") :]
    return walk.index("Repartition") < walk.index("Join")


def test_rays_of_near_pairs_are_not_shuffled(spark, data, monkeypatch):
    o, t, tri = fx.observers(spark, data), fx.targets(spark, data), fx.triangles(spark, data)
    near = lambda: visibility.intervisibility(o, t, tri, max_distance=60, far=False)
    got = near()
    assert not _shuffled_rays(got)
    rows = sorted(map(str, got.collect()))
    monkeypatch.setattr(visibility, "few", lambda b: False)  # more targets than are broadcast
    assert rows == sorted(map(str, near().collect())) and any("visible" in r for r in rows) and any("blocked" in r for r in rows)


def test_rays_to_landmarks_are_not_shuffled(spark, data, monkeypatch):
    tri, own = fx.triangles(spark, data), (fx.materials(spark), fx.assignment(spark, data))
    looks = fx.observers(spark, data).select("observer_id", "px", "py", "pz", *[F.lit(float(v)).alias(c) for c, v in (("fx", 1), ("fy", 0), ("fz", 0), ("ux", 0), ("uy", 0), ("uz", 1))])
    marks = fx.targets(spark, data).select(F.col("target_id").alias("landmark_id"), "qx", "qy", "qz", F.lit(2.0).alias("radius"), F.lit(1.0).alias("weight"))
    near = lambda: visibility.landmarks(looks, marks, tri, *own, samples=4, max_distance=60, far=False)
    got = near()
    assert not _shuffled_rays(got)
    seen = lambda df: sorted((r["observer_id"], r["landmark_id"], r["in_view"], round(r["transmission"], 12), round(r["score"], 12)) for r in df.collect())
    rows = seen(got)
    monkeypatch.setattr(visibility, "few", lambda b: False)  # more landmarks than are broadcast
    assert rows == seen(near()) and any(0 < r[3] < 1 for r in rows)
