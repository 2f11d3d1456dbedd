import pytest
from pyspark.sql import functions as F

from solvane import fixtures as fx
from solvane.core import InvalidInput
from solvane.functions import sampling
from solvane.functions import vector as V
from solvane.operators import scene, sun


def mesh(spark, *ids):
    v = spark.createDataFrame([(m, k, *p) for m in ids for k, p in enumerate([(0.0, 0.0, 0.0), (1.0, -0.0, 0.0), (0.0, 1.0, 0.0)])], "mesh_id long, vertex_index long, x double, y double, z double")
    return v, spark.createDataFrame([(m, 0, 0, 1, 2) for m in ids], "mesh_id long, face_index long, v0 long, v1 long, v2 long")


def test_equal_meshes_are_kept_once(spark):
    v, f = mesh(spark, 1, 2, 3)
    v = v.withColumn("x", F.when((F.col("mesh_id") == 3) & (F.col("vertex_index") == 1), 2.0).otherwise(F.col("x"))).withColumn("y", F.when((F.col("mesh_id") == 2) & (F.col("y") == 0), 0.0).otherwise(F.col("y")))
    v2, f2, kept = scene.add_meshes(v, f, scale=0.5)
    assert {r["mesh_id"]: r["kept_id"] for r in kept.collect()} == {1: 1, 2: 1, 3: 3}
    assert f2.count() == 2 and v2.agg(F.max("x")).first()[0] == 1.0


def test_digest_does_not_hang_on_order(spark, data):
    t = fx.triangles(spark, data)
    a = scene.content_hash(t).first()[0]
    assert a == scene.content_hash(t.orderBy(F.desc("object_id")).repartition(3)).first()[0]
    assert a != scene.content_hash(t.withColumn("az", F.col("az") + 1)).first()[0]


def test_documents_round_trip_and_checks(spark):
    v, f = mesh(spark, 1)
    i = spark.createDataFrame([(1, 5, 1, V.IDENTITY, -1, "static")], "instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string")
    scene.check_instances(i)
    back = scene.compile_documents(scene.documents(v, f, i))
    assert [sorted(map(str, b.select(*a.columns).collect())) for a, b in zip((v, f, i), back, strict=True)] == [sorted(map(str, a.collect())) for a in (v, f, i)]
    with pytest.raises(InvalidInput):
        scene.check_instances(i.unionByName(i))
    bad = list(V.IDENTITY)
    bad[15] = 2.0
    with pytest.raises(InvalidInput):
        scene.check_instances(i.withColumn("transform", F.array(*[F.lit(float(x)) for x in bad])))
    m = spark.createDataFrame([(1, 0.7, 0.7, 0.5)], "material_id long, visible_t double, solar_t double, reflectance double")
    own = spark.createDataFrame([(5, 1)], "object_id long, material_id long")
    with pytest.raises(InvalidInput):
        scene.check_materials(m, own)
    with pytest.raises(InvalidInput):
        scene.check_materials(m.withColumn("reflectance", F.lit(0.1)), own.withColumn("material_id", F.lit(9).cast("long")))
    scene.check_materials(m.withColumn("reflectance", F.lit(0.1)), own)


def test_stats_origin_and_actions(spark, data):
    s = scene.stats(fx.triangles(spark, data)).first()
    o = scene.origin(fx.triangles(spark, data)).first()
    assert s["triangle_count"] == 2 * s["object_count"] and o["ox"] == (s["min_x"] + s["max_x"]) / 2
    r = spark.createDataFrame([(0, 1, 0, 0)], '"add" int, update int, remove int, replace_mesh int'.replace('"', "`"))
    assert scene.index_action(r, 1.2, 0) == "refit" and scene.index_action(r, 1.5, 0) == "rebuild" and scene.index_action(r.withColumn("update", F.lit(0)), 9, 99) == "reuse"


def test_directions_are_spread_evenly(spark):
    h = sampling.hemisphere(spark, 500, seed=3).toPandas()
    s = sampling.sphere(spark, 500).toPandas()
    assert ((h["lx"] ** 2 + h["ly"] ** 2 + h["lz"] ** 2) - 1).abs().max() < 1e-12 and h["lz"].min() > 0
    assert abs(s[["lx", "ly", "lz"]].mean()).max() < 0.02
    t = sampling.triangle_points(spark, 16).toPandas()
    assert (t[["wa", "wb", "wc"]].sum(axis=1) - 1).abs().max() < 1e-12 and t[["wa", "wb", "wc"]].min().min() >= 0
    c = sampling.circle(spark, 5, 90).toPandas()["angle"]
    assert c.iloc[0] == -c.iloc[-1]


def test_solid_angles(spark):
    row = spark.range(1).select(V.solid_angle(V.const(1, 0, 0), V.const(0, 1, 0), V.const(0, 0, 1)).alias("octant"), V.field_of_view(1.0, 1.0).alias("cube_face")).first()
    assert row["octant"] == pytest.approx(4 * 3.141592653589793 / 8) and row["cube_face"] == pytest.approx(4 * 3.141592653589793 / 6)


def test_losses_by_object_category_and_in_all(spark):
    losses = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, 3.0), (1, 2, 1, 1.0)], "scenario_id int, sensor_id long, object_id long, loss double")
    objects = spark.createDataFrame([(1, 4), (2, 4)], "object_id long, category_mask long")
    got = {(r["grouping"], r["object_id"], r["category_mask"]): r["loss"] for r in sun.category_breakdown(losses, objects).collect()}
    assert got == {("object", 1, None): 3.0, ("object", 2, None): 3.0, ("category", None, 4): 6.0, ("total", None, None): 6.0}


def test_portable_scenes_keep_their_budget(spark, data):
    t = fx.triangles(spark, data)
    p = scene.portable(t)
    assert p.schema["ax"].dataType.typeName() == "float" and p.agg(F.max("error")).first()[0] < 1e-4 and p.count() == t.count()
    with pytest.raises(InvalidInput):
        scene.portable(t.withColumn("cx", F.col("cx") * 1e7 + 0.123))


def test_reference_determinant_is_absolute(spark):
    tiny = [V.const(*(1e-5 * x for x in p)) for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0))]
    own = V.intersect(V.const(2e-6, 2e-6, 1), V.const(0, 0, -1), *tiny)
    plain = V.intersect(V.const(2e-6, 2e-6, 1), V.const(0, 0, -1), *tiny, absolute=1e-9)
    row = spark.range(1).select(own["accept"].alias("own"), plain["accept"].alias("plain")).first()
    assert row["own"] is True and row["plain"] is None
