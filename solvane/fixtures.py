"""Deterministic scenes, sensors, weather and study tables, derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit vectors to the sun, exact in decimals; the last but one is below the horizon.
SUNS = [(0.6, 0, 0.8), (-0.6, 0, 0.8), (0, 0.6, 0.8), (0, -0.6, 0.8), (0.8, 0, 0.6), (-0.8, 0, 0.6), (0, 0, 1), (0.48, 0.64, 0.6), (-0.48, 0.64, 0.6), (0.36, 0.48, 0.8), (0, 0.8, -0.6), (0.96, 0, 0.28)]


#: Rows of each table that stand on one square of the ground, and its side: the scene grows with the tables, its density stays.
QUADS, SENSORS, OBSERVERS, SIDE = 2000, 100, 1500, 200
#: Squares in a row.
ROW = 64


def moved(key: str, each: int) -> tuple[Column, Column]:
    """The corner of the square on which a row stands, ``each`` rows on a square."""
    square = F.expr(f"{key} div {each}")
    return square % ROW * SIDE, F.floor(square / ROW) * SIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal square roofs, one for each part."""
    k = F.col("p_partkey")
    dx, dy = moved("p_partkey", QUADS)
    return table(spark, sf_dir, "part").select(
        (k + 1).alias("object_id"),
        ((k * 37) % 200 + dx).cast("double").alias("x0"),
        ((k * 61 + F.expr("p_partkey div 200") * 17) % 200 + dy).cast("double").alias("y0"),
        (3 + k % 3).cast("double").alias("w"),
        (2 + F.col("p_size") % 10).cast("double").alias("z"),
        F.expr("shiftleft(1L, cast(p_partkey % 4 as int))").alias("category_mask"),
    )


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World triangles: two for each roof."""
    x0, y0, w, z = (F.col(c) for c in ("x0", "y0", "w", "z"))
    a = (x0, y0, z)
    far = (x0 + w, y0 + w, z)
    one = [*a, x0 + w, y0, z, *far]
    two = [*a, *far, x0, y0 + w, z]
    names = [f"{c}{x}" for c in "abc" for x in "xyz"]
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("triangle_id"), *[v.alias(n) for v, n in zip(t, names, strict=True)]) for k, t in enumerate((one, two))])
    return quads(spark, sf_dir).select("object_id", F.col("object_id").alias("instance_id"), F.col("object_id").alias("mesh_id"), F.inline(each), "category_mask", F.lit(False).alias("mirrored"))


def meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The roofs as mesh tables (vertices, faces): one mesh, corners not shared between roofs."""
    q = quads(spark, sf_dir)
    x0, y0, w, z = (F.col(c) for c in ("x0", "y0", "w", "z"))
    base = (F.col("object_id") - 1) * 4
    corner = lambda k, x, y: F.struct((base + k).alias("vertex_index"), x.alias("x"), y.alias("y"), z.alias("z"))
    mesh = F.lit(1).cast("long").alias("mesh_id")
    vertices = q.select(mesh, F.inline(F.array(corner(0, x0, y0), corner(1, x0 + w, y0), corner(2, x0 + w, y0 + w), corner(3, x0, y0 + w))))
    face = lambda k, a, b, c: F.struct(((F.col("object_id") - 1) * 2 + k).alias("face_index"), (base + a).alias("v0"), (base + b).alias("v1"), (base + c).alias("v2"))
    faces = q.select(mesh, F.inline(F.array(face(0, 0, 1, 2), face(1, 0, 2, 3))))
    return vertices, faces


#: Roofs of one of the meshes of ``blocks``.
BLOCK = 200


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The roofs as mesh tables, a mesh for each run of BLOCK roofs."""
    v, f = meshes(spark, sf_dir)
    mesh = lambda c, each: (F.floor(F.col(c) / (each * BLOCK)) + 1).cast("long").alias("mesh_id")
    own = lambda c, each: (F.col(c) % (each * BLOCK)).alias(c)
    corners = [(F.col(c) % (4 * BLOCK)).alias(c) for c in ("v0", "v1", "v2")]
    return v.select(mesh("vertex_index", 4), own("vertex_index", 4), "x", "y", "z"), f.select(mesh("face_index", 2), own("face_index", 2), *corners)


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0.5, 0.5), (2, 0.8, 0.8), (3, 0.0, 0.0)], "material_id long, visible_t double, solar_t double")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).select("object_id", (F.col("object_id") % 4).alias("material_id")).where("material_id > 0")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    k = s % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (k + 1).cast("int"))
    dx, dy = moved("s_suppkey", SENSORS)
    return table(spark, sf_dir, "supplier").select(
        (s + 1).alias("sensor_id"),
        ((s * 29) % 200 + dx + F.lit(0.37)).alias("px"),
        ((s * 53 + F.expr("s_suppkey div 10") * 7) % 200 + dy + F.lit(0.61)).alias("py"),
        F.lit(0.0).alias("pz"),
        pick(0, 0.6, 0, 1).alias("nx"),
        pick(0, 0, 0.6, 0).alias("ny"),
        pick(1, 0.8, 0.8, 0).alias("nz"),
        (1 + s % 5).cast("double").alias("area"),
    )


def suns(spark: SparkSession) -> DataFrame:
    rows = [(k, float(x), float(y), float(z), 1.0, 1.0, z > 0) for k, (x, y, z) in enumerate(SUNS)]
    return spark.createDataFrame(rows, "sun_index int, dx double, dy double, dz double, duration_hours double, weight double, is_active boolean")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather from events; hours without events are gaps, hours without purchases miss DNI."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(hour.alias("h")).agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("v"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    # rounded down from a little above, so that no value lies on the limit in one engine and beside it in the other
    snap = lambda x: F.floor(x * 1000 + 0.37) / 1000
    return rows.select(
        F.unix_seconds("h").alias("hour_unix"),
        (F.unix_seconds("h") + 1800).alias("midpoint_unix"),
        F.lit(1.0).alias("duration_hours"),
        snap(F.col("v") * 1.5).alias("ghi"),
        snap(F.col("v") * 2).alias("dni"),
        snap(F.col("v") * 0.5).alias("dhi"),
        (F.col("bought") == 0).alias("dni_missing"),
    )


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    dx, dy = moved("c_custkey", OBSERVERS)
    return table(spark, sf_dir, "customer").select((c + 1).alias("observer_id"), ((c * 31) % 200 + dx + F.lit(0.13)).alias("px"), ((c * 47 + F.expr("c_custkey div 200") * 13) % 200 + dy + F.lit(0.29)).alias("py"), F.lit(1.6).alias("pz"), ((1 + c % 10) / F.lit(10.0)).alias("weight"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sensor_id") - 1
    return sensors(spark, sf_dir).select(F.col("sensor_id").alias("target_id"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.lit(12.5).alias("qz"), ((1 + s % 5) / F.lit(5.0)).alias("sensitivity"), (F.col("sensor_id") % 3).alias("group_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors(spark, sf_dir).select((F.col("sensor_id") - 1).alias("idx"), F.col("sensor_id").alias("node_id"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1.5).alias("z"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design candidates: revenue (to maximise), discount (to minimise), one residual; sums are exact decimals."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("rev"),
        F.sum(F.col("l_discount").cast("decimal(9,4)")).cast("double").alias("d"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = table(spark, sf_dir, "part")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rows.select((F.col("p_partkey") + 1).alias("candidate_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "rev", F.round(F.col("d") / F.col("n"), 6).alias("disc"), (F.col("p_size") - 40).cast("double").alias("residual"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario outcomes of candidates: a row for each return flag, its probability a count."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("candidate_id"), flag.alias("scenario_id"))
    n = F.count(F.lit(1))
    return rows.agg(
        n.cast("double").alias("probability"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / n).alias("objective"),
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / n - 26).alias("residual"),
    )


def fidelities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    fast = part.select((k + 1).alias("candidate_id"), F.lit("fast").alias("fidelity"), F.col("p_retailprice").alias("objective"), F.lit(1.0).alias("cost"))
    slow = part.where("p_partkey % 5 = 0").select((k + 1).alias("candidate_id"), F.lit("reference").alias("fidelity"), (1 + 2 * F.col("p_retailprice") + 0.01 * (k % 3)).alias("objective"), F.lit(20.0).alias("cost"))
    return fast.unionByName(slow)
