"""Annual irradiance and daylight: static sky visibility, coefficients, illuminance, metrics, validation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.core import small
from solvane.functions.sampling import hemisphere
from solvane.functions.sky import luminance, perez
from solvane.functions.vector import dot, photopic, ratio, vec
from solvane.operators.rays import closest, transmission
from solvane.operators.sun import INFINITE, rays_from

DOME_AZIMUTHS, DOME_ALTITUDES, HORIZON = 24, 6, 24


def dome_patches(spark: SparkSession) -> DataFrame:
    """(idx, zone, d*, omega): 24 by 6 patches of the dome in equal angles, and 24 directions of the horizon."""
    rows = []
    for j in range(DOME_ALTITUDES):
        lo, hi = (math.pi / 2 * k / DOME_ALTITUDES for k in (j, j + 1))
        alt = (lo + hi) / 2
        for i in range(DOME_AZIMUTHS):
            az = 2 * math.pi * (i + 0.5) / DOME_AZIMUTHS
            rows.append((len(rows), "dome", math.cos(alt) * math.sin(az), math.cos(alt) * math.cos(az), math.sin(alt), 2 * math.pi / DOME_AZIMUTHS * (math.sin(hi) - math.sin(lo))))
    for i in range(HORIZON):
        az = 2 * math.pi * (i + 0.5) / HORIZON
        rows.append((len(rows), "horizon", math.sin(az), math.cos(az), 0.0, 1.0))
    return spark.createDataFrame(rows, "idx int, zone string, dx double, dy double, dz double, omega double")


def static_sky(sensors: DataFrame, triangles: DataFrame, offset: float = 1e-4, max_distance: float = INFINITE, strategy: str = "auto") -> DataFrame:
    """(sensor_id, dome_visibility, horizon_visibility): shares of the projected sky that are open; 1 where nothing weighs."""
    rows = sensors.crossJoin(F.broadcast(dome_patches(sensors.sparkSession))).withColumn("w", F.greatest(dot(vec("n"), vec("d")), F.lit(0.0)) * F.col("omega")).where("w > 0")
    seen = closest(rays_from(rows, offset, max_distance), triangles, ["sensor_id", "idx"], strategy, carry=["zone", "w"])
    share = lambda z: ratio(F.sum(F.when((F.col("zone") == z) & ~F.col("hit"), F.col("w")).otherwise(0.0)), F.sum(F.when(F.col("zone") == z, F.col("w")).otherwise(0.0)), 1.0)
    out = sensors.select("sensor_id").join(seen.groupBy("sensor_id").agg(share("dome").alias("dome_visibility"), share("horizon").alias("horizon_visibility")), "sensor_id", "left")
    return out.na.fill(1.0)


def with_turns(weather_suns: DataFrame) -> DataFrame:
    """weather_suns with turn, a number of each direction d*: what a ray meets hangs on its direction, which hours may share."""
    return weather_suns.withColumn("turn", F.dense_rank().over(Window.orderBy("dx", "dy", "dz")))


def _directions(turned: DataFrame) -> DataFrame:
    """(turn, d*, any_active) of each direction of hours with turns."""
    return turned.groupBy("turn").agg(*[F.first(f"d{x}").alias(f"d{x}") for x in "xyz"], F.max("is_active").alias("any_active"))


def irradiance_timeline(sensors: DataFrame, weather_suns: DataFrame, triangles: DataFrame, ground_albedo: float = 0.2, prefer_weather_albedo: bool = True, offset: float = 1e-4, strategy: str = "auto", sky: DataFrame | None = None) -> DataFrame:
    """(sensor_id, sun_index, state, direct, diffuse, ground, total, loss, object_id) in W/m2 and Wh/m2 (loss).

    weather_suns has sun_index, d*, is_active, duration_hours, dni, dhi, ghi (Wh/m2
    of the interval) and, if there, albedo.  A sensor traces each direction once,
    however many hours have it.
    """
    hours = F.col("duration_hours")
    per_hour = {c: ratio(F.col(c), hours) for c in ("dni", "dhi", "ghi")}
    albedo = F.coalesce("albedo", F.lit(ground_albedo)) if prefer_weather_albedo and "albedo" in weather_suns.columns else F.lit(ground_albedo)
    w = with_turns(weather_suns).select("turn", "sun_index", "dx", "dy", "dz", "is_active", "duration_hours", *[v.alias(c) for c, v in per_hour.items()], albedo.alias("albedo"))
    rows = sensors.crossJoin(small(_directions(w))).withColumn("cosine", dot(vec("n"), vec("d")))
    needed = ["cosine", "nz", "dz"]
    traced = closest(rays_from(rows, offset, INFINITE), triangles, ["sensor_id", "turn"], strategy, carry=needed, active=F.col("any_active") & (F.col("cosine") > 0))
    traced = traced.join(small(w.drop("dx", "dy", "dz")), "turn").withColumn("facing", F.col("is_active") & (F.col("cosine") > 0))
    sky = sky if sky is not None else static_sky(sensors, triangles, offset, strategy=strategy)
    out = traced.join(sky, "sensor_id")
    visible = F.col("facing") & ~F.coalesce("hit", F.lit(False))
    zenith = F.acos(F.greatest(F.least(F.col("dz"), F.lit(1.0)), F.lit(-1.0)))
    parts = perez(F.col("dni"), F.col("dhi"), zenith, F.col("cosine"), F.col("nz"))
    direct = F.when(visible, F.col("dni") * F.col("cosine")).otherwise(0.0)
    diffuse = F.greatest(parts["dome"] * F.col("dome_visibility") + F.when(visible, parts["circumsolar"]).otherwise(0.0) + parts["horizon"] * F.col("horizon_visibility"), F.lit(0.0))
    ground = F.col("ghi") * F.col("albedo") * (1 - F.col("nz")) / 2
    blocked = F.col("facing") & F.coalesce("hit", F.lit(False))
    loss = F.when(blocked, (F.col("dni") * F.col("cosine") + F.greatest(parts["circumsolar"], F.lit(0.0))) * hours).otherwise(0.0)
    state = F.when(~F.col("is_active"), "inactive").when(F.col("cosine") <= 0, "back_facing").when(blocked, "blocked").otherwise("visible")
    return out.select("sensor_id", "sun_index", state.alias("state"), "duration_hours", direct.alias("direct"), diffuse.alias("diffuse"), ground.alias("ground"), (direct + diffuse + ground).alias("total"), loss.alias("loss"), F.when(blocked, F.col("object_id")).alias("object_id"))


def irradiance_summary(timeline: DataFrame) -> DataFrame:
    """A row for each sensor: Wh/m2 by parts, loss, the first peak and its interval, the object that takes most."""
    parts = ("direct", "diffuse", "ground", "total")
    peak = F.max(F.struct(F.col("total").alias("total"), (-F.col("sun_index")).alias("back")))
    each = timeline.groupBy("sensor_id", F.col("object_id").alias("o")).agg(*[F.sum(F.col(c) * F.col("duration_hours")).alias(f"{c}_wh") for c in parts], F.sum("loss").alias("loss_wh"), peak.alias("peak"))
    top = F.max_by("o", F.when(F.col("o").isNotNull(), F.struct("loss_wh", -F.col("o"))))
    out = each.groupBy("sensor_id").agg(*[F.sum(f"{c}_wh").alias(f"{c}_wh") for c in parts], F.sum("loss_wh").alias("loss_sum"), F.max("peak").alias("peak"), top.alias("o"))
    return out.select("sensor_id", *[f"{c}_wh" for c in parts], F.col("loss_sum").alias("loss_wh"), F.col("peak")["total"].alias("peak_w"), (-F.col("peak")["back"]).alias("peak_index"), F.coalesce("o", F.lit(0).cast("long")).alias("dominant_object_id"))


def annual_irradiance(sensors: DataFrame, weather_suns: DataFrame, triangles: DataFrame, **options) -> DataFrame:
    """The summary of ``irradiance_timeline`` with the same options."""
    return irradiance_summary(irradiance_timeline(sensors, weather_suns, triangles, **options))


def coefficient_matrix(sensors: DataFrame, triangles: DataFrame, materials: DataFrame, assignment: DataFrame, patches: int = 576, max_layers: int = 8, cutoff: float = 1e-4, offset: float = 1e-4, strategy: str = "auto", directions: DataFrame | None = None) -> DataFrame:
    """(sensor_id, idx, dz, coefficient): max(0, n.d) times a patch's solid angle times what reaches the sensor."""
    spark = sensors.sparkSession
    d = directions if directions is not None else hemisphere(spark, patches).select("idx", F.col("lx").alias("dx"), F.col("ly").alias("dy"), F.col("lz").alias("dz"))
    omega = 2 * math.pi / patches
    rows = sensors.crossJoin(small(d)).withColumn("projected", F.greatest(dot(vec("n"), vec("d")), F.lit(0.0)) * omega)
    t = transmission(rays_from(rows, offset, INFINITE), triangles, ["sensor_id", "idx"], materials, assignment, "visible_t", cutoff=cutoff, max_layers=max_layers, strategy=strategy, carry=["dz", "projected"], active=F.col("projected") > 0)
    return t.select("sensor_id", "idx", "dz", (F.col("projected") * F.col("transmission")).alias("coefficient"))


def optical_materials(optical: DataFrame) -> DataFrame:
    """Materials for analysis from optical ones: photopic transmittance in both channels."""
    t = photopic(F.col("transmittance"))
    return optical.select("material_id", t.alias("visible_t"), t.alias("solar_t"), photopic(F.col("reflectance")).alias("reflectance"))


def horizontal_normaliser(patches: int, sky: str) -> float:
    """What the unobstructed horizontal coefficients of a hemisphere of patches sum to under a sky."""
    z = [(k + 0.5) / patches for k in range(patches)]
    weight = (lambda v: 1.0) if sky == "isotropic" else (lambda v: 1 + 2 * v)
    return sum(v * 2 * math.pi / patches * weight(v) for v in z)


def relative_illuminance(matrix: DataFrame, patches: int, sky: str) -> DataFrame:
    """(sensor_id, share): illuminance by the sky as a share of the unobstructed horizontal one."""
    return matrix.groupBy("sensor_id").agg((F.sum(F.col("coefficient") * luminance(sky, F.col("dz"))) / horizontal_normaliser(patches, sky)).alias("share"))


def point_illuminance(sensors: DataFrame, matrix: DataFrame, sun: tuple[float, float, float], direct_normal_lux: float, diffuse_horizontal_lux: float, triangles: DataFrame, materials: DataFrame, assignment: DataFrame, patches: int = 576, sky: str = "isotropic", offset: float = 1e-4, strategy: str = "auto") -> DataFrame:
    """(sensor_id, direct, diffuse, total) in lux at one moment."""
    rows = sensors.select("*", *[F.lit(float(v)).alias(f"d{x}") for v, x in zip(sun, "xyz", strict=True)]).withColumn("cosine", F.greatest(dot(vec("n"), vec("d")), F.lit(0.0)))
    up = F.expr(f"cosine > 0 and {float(sun[2])!r} > 0")
    t = transmission(rays_from(rows, offset, INFINITE), triangles, ["sensor_id"], materials, assignment, "visible_t", strategy=strategy, carry=["cosine"], active=up)
    direct = F.when(up, F.col("cosine") * direct_normal_lux * F.col("transmission")).otherwise(0.0)
    out = t.join(relative_illuminance(matrix, patches, sky), "sensor_id", "left")
    diffuse = F.coalesce("share", F.lit(0.0)) * diffuse_horizontal_lux
    return out.select("sensor_id", direct.alias("direct"), diffuse.alias("diffuse"), (direct + diffuse).alias("total"))


def daylight_factor(matrix: DataFrame, patches: int = 576) -> DataFrame:
    """(sensor_id, daylight_factor) in percent under the CIE overcast sky."""
    return relative_illuminance(matrix, patches, "cie_overcast").select("sensor_id", (100 * F.col("share")).alias("daylight_factor"))


def sun_transmission(sensors: DataFrame, turned: DataFrame, triangles: DataFrame, materials: DataFrame, assignment: DataFrame, offset: float = 1e-4, strategy: str = "auto") -> DataFrame:
    """(sensor_id, turn, transmission) of sensors that face the sun in active hours with turns; each direction is traced once."""
    rows = sensors.crossJoin(small(_directions(turned.where("is_active")))).where("nx * dx + ny * dy + nz * dz > 0")
    return transmission(rays_from(rows, offset, INFINITE), triangles, ["sensor_id", "turn"], materials, assignment, "visible_t", strategy=strategy).select("sensor_id", "turn", "transmission")


def annual_daylight(sensors: DataFrame, matrix: DataFrame, weather_suns: DataFrame, sun_transmission: DataFrame, patches: int = 576, sky: str = "isotropic", direct_efficacy: float = 100.0, diffuse_efficacy: float = 120.0, start_hour: float = 8.0, end_hour: float = 18.0, utc_offset_hours: float = 0.0, sda_lux: float = 300.0, ase_lux: float = 1000.0, ase_hours: float = 250.0, udi: tuple[float, float, float] = (100.0, 300.0, 3000.0)) -> DataFrame:
    """A row for each sensor of hours, sDA share, ASE hours, UDI shares and mean lux in the occupied hours.

    weather_suns as for irradiance, with midpoint_unix; sun_transmission has
    (sensor_id, sun_index, transmission), or (sensor_id, turn, transmission) where
    weather_suns has turns.  Occupied hours may run over midnight.
    """
    hours = F.col("duration_hours")
    local = F.pmod(F.col("midpoint_unix") + F.lit(int(utc_offset_hours * 3600)), F.lit(86400)) / 3600
    inside = (local >= start_hour) & (local < end_hour) if start_hour <= end_hour else (local >= start_hour) | (local < end_hour)
    by = "turn" if "turn" in sun_transmission.columns else "sun_index"
    w = weather_suns.where(inside).select(by, "dx", "dy", "dz", "is_active", "duration_hours", ratio(F.col("dni"), hours).alias("dni"), ratio(F.col("dhi"), hours).alias("dhi"))
    each = sensors.select("sensor_id", "nx", "ny", "nz", "area").join(relative_illuminance(matrix, patches, sky), "sensor_id")
    if by == "turn":  # joined before the hours that share them
        rows = each.crossJoin(small(w.select(by).distinct())).join(sun_transmission.select("sensor_id", by, "transmission"), ["sensor_id", by], "left").join(small(w), by)
    else:
        rows = each.crossJoin(small(w)).join(sun_transmission, ["sensor_id", by], "left")
    direct = F.when(F.col("is_active"), F.col("dni") * direct_efficacy * F.greatest(dot(vec("n"), vec("d")), F.lit(0.0)) * F.coalesce("transmission", F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("direct_lux", direct).withColumn("lux", F.col("direct_lux") + F.col("dhi") * diffuse_efficacy * F.col("share"))
    total = F.sum(hours)
    when = lambda test: F.sum(F.when(test, hours).otherwise(0.0))
    low, supplementary, high = udi
    return rows.groupBy("sensor_id").agg(
        F.first("area").alias("area"),
        total.alias("hours"),
        ratio(when(F.col("lux") >= sda_lux), total).alias("sda_share"),
        when(F.col("direct_lux") > ase_lux).alias("ase_hours"),
        (when(F.col("direct_lux") > ase_lux) > ase_hours).alias("ase_fails"),
        ratio(when(F.col("lux") < low), total).alias("udi_low"),
        ratio(when((F.col("lux") >= low) & (F.col("lux") < supplementary)), total).alias("udi_supplementary"),
        ratio(when((F.col("lux") >= supplementary) & (F.col("lux") <= high)), total).alias("udi_autonomous"),
        ratio(when(F.col("lux") > high), total).alias("udi_excessive"),
        ratio(F.sum(F.col("lux") * hours), total).alias("mean_lux"),
    )


def daylight_project(per_sensor: DataFrame, sda_time: float = 0.5) -> DataFrame:
    """One row of area-weighted percentages: sDA, ASE, mean UDI."""
    area = F.sum("area")
    share = lambda test: ratio(100 * F.sum(F.when(test, F.col("area")).otherwise(0.0)), area)
    return per_sensor.agg(area.alias("area"), share(F.col("sda_share") >= sda_time).alias("sda_percent"), share(F.col("ase_fails")).alias("ase_percent"), ratio(100 * F.sum(F.col("area") * (F.col("udi_supplementary") + F.col("udi_autonomous"))), area).alias("udi_percent"))


def compare(pairs: DataFrame, absolute: float = 1.0, relative: float = 0.05) -> DataFrame:
    """One row on (value, reference): bias, MAE, RMSE, MAPE, largest error, R2, accepted rows."""
    rows = pairs.withColumn("e", F.col("value") - F.col("reference"))
    ok = F.abs(F.col("e")) <= F.greatest(F.lit(absolute), relative * F.abs(F.col("reference")))
    named = F.abs(F.col("reference")) > 1e-9
    mean = rows.agg(F.avg("reference").alias("m"))
    out = rows.crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("e").alias("bias"),
        F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.coalesce(F.avg(F.when(named, F.abs(F.col("e") / F.when(named, F.col("reference"))))), F.lit(0.0)).alias("mape"),
        F.max(F.abs("e")).alias("max_error"),
        F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.sum((F.col("reference") - F.col("m")) * (F.col("reference") - F.col("m"))).alias("sst"),
        F.count_if(ok).alias("accepted"),
    )
    flat = F.when(F.col("sse") <= 1e-18, 1.0).otherwise(0.0)
    return out.withColumn("r_squared", F.when(F.col("sst") > 1e-18, 1 - F.col("sse") / F.col("sst")).otherwise(flat)).drop("sse", "sst")
