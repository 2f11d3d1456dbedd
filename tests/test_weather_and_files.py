import pytest
from pyspark.sql import functions as F

from solvane.core import InvalidInput
from solvane.operators import weather
from solvane.sources import exports, weather_files
from solvane.streaming import live

HEAD = "LOCATION,Town,-,IRN,x,1,35.6892,51.3890,3.5,1200.0\nDESIGN CONDITIONS,0\nTYPICAL/EXTREME PERIODS,0\nGROUND TEMPERATURES,0\nHOLIDAYS/DAYLIGHT SAVINGS,No,0,0,0\nCOMMENTS 1,a\nCOMMENTS 2,b\nDATA PERIODS,1,1,Data,Friday,6/21,6/21\n"


def epw(hours=(9, 10, 11), ghi="500"):
    row = lambda h: ",".join(["2024", "6", "21", str(h), "0", "flag", "25.0", "10", "40", "88000", "0", "0", "300", ghi if h == hours[0] else "500", "600", "100", *["0"] * 16, "0.21", "0", "0"])
    return HEAD + "\n".join(row(h) for h in hours) + "\n"


def test_epw_midpoints_and_missing_radiation(spark, tmp_path):
    (tmp_path / "a.epw").write_text(epw(ghi="9999"))
    site, w = weather_files.read_epw(spark, str(tmp_path / "a.epw"))
    rows = w.orderBy("idx").collect()
    assert site.first()["utc_offset"] == 3.5 and len(rows) == 3 and rows[0]["duration_hours"] == 1.0
    # nine o'clock local is the end of the first hour: its middle is 08:30 local, 05:00 UTC
    assert rows[0]["midpoint_unix"] == 1718946000 and rows[0]["ghi"] == 0 and rows[0]["ghi_missing"] and not rows[1]["ghi_missing"]
    assert rows[0]["albedo"] == pytest.approx(0.21) and rows[0]["pressure"] == 88000
    (tmp_path / "b.epw").write_text(epw().replace("DESIGN CONDITIONS", "OTHER"))
    with pytest.raises(InvalidInput):
        weather_files.read_epw(spark, str(tmp_path / "b.epw"))


def test_csv_and_wea_round_trips(spark, tmp_path):
    (tmp_path / "a.epw").write_text(epw())
    site, w = weather_files.read_epw(spark, str(tmp_path / "a.epw"))
    weather_files.write_lines(weather_files.csv_lines(w, "test"), str(tmp_path / "csv"))
    back = weather_files.read_csv(spark, f"{tmp_path}/csv/part-*")
    cols = weather_files.CSV
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, w.select(*cols).collect()))
    s = site.first().asDict()
    weather_files.write_lines(weather_files.wea_lines(s, w), str(tmp_path / "wea"))
    site2, w2 = weather_files.read_wea(spark, f"{tmp_path}/wea/part-*", 2024)
    assert site2.first()["longitude"] == pytest.approx(51.389) and [r["midpoint_unix"] for r in w2.orderBy("idx").collect()] == [r["midpoint_unix"] for r in w.orderBy("idx").collect()]
    first = w2.orderBy("idx").first()
    assert first["dni"] == 600 and 100 < first["ghi"] < 700 and first["duration_hours"] == 1.0


def records(spark, *rows):
    kind = "midpoint_unix long, duration_hours double, month int, day int, hour int, minute int, ghi double, dni double, dhi double, ghi_missing boolean, dni_missing boolean, dhi_missing boolean"
    return spark.createDataFrame([(t, 1.0, m, d, 1, 0, v, v, v, x, x, x) for t, m, d, v, x in rows], kind)


def test_policies(spark):
    w = records(spark, (0, 2, 28, 1.0, False), (3600, 2, 29, 0.0, True), (7200, 3, 1, 3.0, False))
    with pytest.raises(InvalidInput):
        weather.apply_policy(w)
    assert [r["dni"] for r in weather.apply_policy(w, "interpolate").orderBy("midpoint_unix").collect()] == [1, 2, 3]
    assert weather.apply_policy(w, "zero", "drop").count() == 2
    gap = records(spark, (0, 1, 1, 1.0, False), (7200, 1, 1, 1.0, False))
    assert weather.gaps(gap).count() == 1
    with pytest.raises(InvalidInput):
        weather.apply_policy(gap)
    assert weather.apply_policy(gap, on_gap="preserve").count() == 2
    with pytest.raises(InvalidInput):
        weather.apply_policy(records(spark, (0, 1, 1, 1.0, False), (0, 1, 1, 1.0, False)), on_gap="preserve")
    with pytest.raises(InvalidInput):
        weather.with_simulation_year(w, 2023, 0.0)
    moved = weather.with_simulation_year(w.where("day = 28"), 2023, 0.0).first()
    assert moved["midpoint_unix"] == 1677544200


def test_selection_occupancy_and_schedule(spark):
    # 2024-01-01 is a Monday
    w = records(spark, *[(1704067200 + 3600 * h + 1800, 1, 1 + h // 24, 10.0, False) for h in range(24 * 7)])
    assert weather.select(w, weekdays=0b0000001).count() == 24
    assert weather.select(w, start_hour=8, end_hour=18, occupancy=weather.weekday_hours(spark, 9, 17)).count() == 40
    off = spark.createDataFrame([(1, 2)], "month int, day int")
    assert weather.select(w, holidays=off).count() == 24 * 6 and weather.select(w, months=0b10).count() == 0
    s = weather.schedule(spark, 0, 9000, 3600).orderBy("unix_seconds").collect()
    assert [(r["unix_seconds"], r["duration_hours"]) for r in s] == [(1800, 1.0), (5400, 1.0), (8100, 0.5)]
    assert weather.identity(w).first() == weather.identity(w.orderBy(F.desc("midpoint_unix"))).first()


def test_documents_and_exports(spark, tmp_path):
    doc = {"schema_version": 0, "instances": [{"instance_id": 1}]}
    data = exports.pack_document(doc)
    assert exports.unpack_document(data)["instances"][0]["layer"] == "static"
    with pytest.raises(InvalidInput):
        exports.unpack_document(data[:-1] + b"x")
    (tmp_path / "s.bin").write_bytes(data)
    assert '"schema_version": 1' in exports.read_documents(spark, str(tmp_path / "s.bin")).first()["document"]
    rows = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0, 5.0], [0.0])], "candidate_id long, values array<double>, objectives array<double>, residuals array<double>")
    t = exports.study_table(rows, ["Wall Width", "n"], [("View Quality", 2), ("Energy", 1)], ["Budget"])
    assert t.columns == ["candidate_id", "parameter_wall_width", "parameter_n", "objective_view_quality_0", "objective_view_quality_1", "objective_energy", "constraint_budget"]
    exports.write_study(t, str(tmp_path / "study"))
    assert spark.read.parquet(str(tmp_path / "study")).first()["objective_energy"] == 5.0
    p = exports.objective_space(t.unionByName(t.withColumn("objective_energy", F.lit(9.0))), ["objective_energy"]).collect()
    assert sorted(r["x"] for r in p) == [-1, 1]


def test_delta_stream_applies_once(spark, tmp_path):
    kind = "instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string"
    i = spark.createDataFrame([(1, 1, 1, None, -1, "static")], kind)
    d = spark.createDataFrame([(1, "add", 2, 2, 1, None, -1, "dynamic")], "seq long, kind string, " + kind)
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = live.start_deltas(stream, i, str(tmp_path / "snap"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    n, now = live.snapshot(spark, str(tmp_path / "snap"))
    assert now.count() == 2
    live.apply_delta_batch(d, n, str(tmp_path / "snap"))
    assert live.snapshot(spark, str(tmp_path / "snap"))[1].count() == 2
    g = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "scope string, generation int, v string")
    assert {r["v"] for r in live.newest_generation(g).collect()} == {"new", "only"}


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 40
    assert entry.entry(spark).count() == 10


def test_small_exports(spark, tmp_path):
    import json

    v = exports.inline_vectors(spark, ["1, 0, 2.5", "0;0;1"]).orderBy("idx").collect()
    assert [(r["x"], r["y"], r["z"]) for r in v] == [(1.0, 0.0, 2.5), (0.0, 0.0, 1.0)]
    for bad in ("1,2", "a,b,c", "1,2,inf", ""):
        with pytest.raises(InvalidInput):
            exports.inline_vectors(spark, [bad])
    points = spark.createDataFrame([(1.0, 0.0, -1.0), (-1.0, 0.5, 0.0)], "x double, y double, z double")
    doc = json.loads(exports.objective_space_gltf(points))
    assert doc["accessors"][0]["count"] == 2 and doc["accessors"][0]["min"] == [-1.0, 0.0, -1.0] and doc["meshes"][0]["primitives"][0]["mode"] == 0
    with pytest.raises(InvalidInput):
        exports.objective_space_gltf(points, most=1)
    rows = spark.createDataFrame([(1, 2.5)], "sensor_id long, lux double")
    exports.evidence_table(rows, str(tmp_path / "e"))
    assert exports.evidence_rows(spark, str(tmp_path / "e"), "sensor_id long, lux double").first()["lux"] == 2.5
    with pytest.raises(InvalidInput):
        exports.evidence_table(rows.withColumn("lux", F.lit(float("nan"))), str(tmp_path / "f"))
