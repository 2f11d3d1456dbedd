"""Weather files: EPW, WEA and CSV, parsed by SQL functions over whole files, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.core import InvalidInput, require_none

#: Columns of the weather CSV, after its two comment lines.
CSV = ["year", "month", "day", "hour", "minute", "midpoint_unix", "duration_hours", "ghi", "dni", "dhi", "ghi_missing", "dni_missing", "dhi_missing", "dry_bulb", "pressure", "albedo", "flags"]
_CSV_KINDS = "year int, month int, day int, hour int, minute int, midpoint_unix long, duration_hours double, ghi double, dni double, dhi double, ghi_missing boolean, dni_missing boolean, dhi_missing boolean, dry_bulb double, pressure double, albedo double, flags string"
# The first words of an EPW's eight header lines.
EPW_HEADERS = ["LOCATION", "DESIGN CONDITIONS", "TYPICAL/EXTREME PERIODS", "GROUND TEMPERATURES", "HOLIDAYS/DAYLIGHT SAVINGS", "COMMENTS 1", "COMMENTS 2", "DATA PERIODS"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of whole files, blank lines left out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")


def read_epw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(site, weather) of EPW files: site(path, city, latitude, longitude, utc_offset, elevation, records_per_hour)."""
    lines = _lines(spark, path)
    head = lines.where("n < 8").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("h"))
    words = F.transform("h.line", lambda x: F.trim(F.split(x, ",")[0]))
    require_none(head.where(words != F.array(*[F.lit(x) for x in EPW_HEADERS])), "the header lines of an EPW are others")
    first = lambda k: F.split(F.col("h.line")[k], ",")
    num = lambda x: F.expr("1.0") * x.try_cast("double")
    site = head.select("path", F.trim(first(0)[1]).alias("city"), num(first(0)[6]).alias("latitude"), num(first(0)[7]).alias("longitude"), num(first(0)[8]).alias("utc_offset"), num(first(0)[9]).alias("elevation"), first(7)[1].try_cast("int").alias("periods"), first(7)[2].try_cast("int").alias("records_per_hour"))
    require_none(site.where("latitude is null or longitude is null or utc_offset is null or not latitude between -90 and 90 or not longitude between -180 and 180"), "an EPW's location is not valid")
    require_none(site.where("periods is null or periods <> 1 or records_per_hour is null or records_per_hour < 1 or 60 % records_per_hour <> 0"), "an EPW has one data period and records that divide an hour")
    rows = lines.where("n >= 8").withColumn("f", F.split("line", ",")).join(site.select("path", "utc_offset", "records_per_hour"), "path")
    at = lambda k: F.trim(F.get("f", F.lit(k)))
    whole = [at(k).try_cast("int").alias(n) for k, n in enumerate(("year", "month", "day", "hour", "minute"))]
    radiation = []
    for k, n in ((13, "ghi"), (14, "dni"), (15, "dhi")):
        v = at(k).try_cast("double")
        ok = v.isNotNull() & (v >= 0) & (v < 9999)
        radiation += [F.when(ok, v).otherwise(0.0).alias(n), (~ok).alias(f"{n}_missing")]

    def ranged(k: int, low: float, high: float) -> Column:
        v = at(k).try_cast("double")
        return F.when((v >= low) & (v <= high), v)

    out = rows.select("path", "n", *whole, (1.0 / F.col("records_per_hour")).alias("duration_hours"), "utc_offset", *radiation, ranged(6, -90, 70).alias("dry_bulb"), ranged(9, 31000, 120000).alias("pressure"), ranged(32, 0, 1).alias("albedo"), at(5).alias("flags"))
    require_none(out.where("year is null or month is null or day is null or hour is null or not hour between 1 and 24"), "an EPW record has no valid time")
    day = F.expr("try_make_timestamp(year, month, day, 0, 0, 0)")
    require_none(out.where(day.isNull()), "an EPW record's day does not exist")
    minutes = F.when(F.col("minute") == 0, F.lit(60)).otherwise(F.col("minute"))
    end = F.unix_seconds(day) + (F.col("hour") - 1) * 3600 + minutes * 60
    middle = (end - F.col("utc_offset") * 3600 - F.col("duration_hours") * 1800).cast("long")
    idx = (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("long")
    return site, out.select("path", idx.alias("idx"), "year", "month", "day", "hour", "minute", middle.alias("midpoint_unix"), "duration_hours", "ghi", "dni", "dhi", "ghi_missing", "dni_missing", "dhi_missing", "dry_bulb", "pressure", "albedo", "flags")


def read_wea(spark: SparkSession, path: str, year: int = 2001) -> tuple[DataFrame, DataFrame]:
    """(site, weather) of WEA files; longitudes and meridians there count to the west; GHI comes from DNI, DHI and the sun's height."""
    lines = _lines(spark, path)
    pair = lines.where("line rlike '^[a-z_]+ '").select("path", F.split("line", " ", 2).alias("w")).select("path", F.col("w")[0].alias("k"), F.trim(F.col("w")[1]).alias("v"))
    site = pair.groupBy("path").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in (("place", "city"), ("latitude", "latitude"), ("longitude", "west"), ("time_zone", "meridian"), ("site_elevation", "elevation"), ("weather_data_file_units", "units"))])
    require_none(site.where("units is null or units <> '1'"), "a WEA's units are others than 1")
    site = site.select("path", "city", F.col("latitude").cast("double").alias("latitude"), (-F.col("west").cast("double")).alias("longitude"), (-F.col("meridian").cast("double") / 15).alias("utc_offset"), F.col("elevation").cast("double").alias("elevation"))
    rows = lines.where("line rlike '^ *[0-9]'").withColumn("f", F.split(F.trim("line"), r"\s+")).join(site.select("path", "utc_offset"), "path")
    rows = rows.select("path", "n", F.col("f")[0].cast("int").alias("month"), F.col("f")[1].cast("int").alias("day"), F.col("f")[2].cast("double").alias("clock"), F.col("f")[3].cast("double").alias("dni"), F.col("f")[4].cast("double").alias("dhi"), "utc_offset")
    day = F.expr(f"try_make_timestamp({year}, month, day, 0, 0, 0)")
    rows = rows.withColumn("midpoint_unix", (F.unix_seconds(day) + F.col("clock") * 3600 - F.col("utc_offset") * 3600).cast("long"))
    require_none(rows.where("midpoint_unix is null"), "a WEA record's day does not exist")
    by = Window.partitionBy("path").orderBy("midpoint_unix")
    rows = rows.withColumn("step", F.col("midpoint_unix") - F.lag("midpoint_unix").over(by))
    rows = rows.withColumn("duration_hours", F.coalesce(F.min("step").over(Window.partitionBy("path")) / 3600, F.lit(1.0)))
    no = F.lit(False)
    out = rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("long").alias("idx"), F.lit(year).alias("year"), "month", "day", F.floor("clock").cast("int").alias("hour"), ((F.col("clock") % 1) * 60).cast("int").alias("minute"), "midpoint_unix", "duration_hours", F.lit(None).cast("double").alias("ghi"), "dni", "dhi", no.alias("ghi_missing"), no.alias("dni_missing"), no.alias("dhi_missing"), *[F.lit(None).cast("double").alias(c) for c in ("dry_bulb", "pressure", "albedo")], F.lit("").alias("flags"))
    return site, _with_ghi(out, site)


def _with_ghi(rows: DataFrame, site: DataFrame) -> DataFrame:
    """GHI = DNI max(0, z) + DHI, the sun without refraction."""
    import numpy as np

    from solvane.functions.solar_position import position

    names = rows.columns
    joined = rows.join(site.select("path", "latitude", "longitude", "elevation"), "path")

    def run(batches):
        for b in batches:
            z = np.zeros(len(b))
            for (lat, lon, up), g in b.groupby(["latitude", "longitude", "elevation"]):
                at = b.index.get_indexer(g.index)
                z[at] = np.sin(np.radians(position(g["midpoint_unix"].to_numpy(), lat, lon, up, pressure=0.0)[1]))
            b["ghi"] = b["dni"] * np.maximum(z, 0) + b["dhi"]
            yield b[names]

    return joined.mapInPandas(run, rows.schema)


def wea_lines(site: dict, weather: DataFrame) -> DataFrame:
    """(n, value): a WEA text of one site, 8 decimals, in order."""
    spark = weather.sparkSession
    head = [f"place {site.get('city', '')}", f"latitude {site['latitude']:.8f}", f"longitude {-site['longitude']:.8f}", f"time_zone {-site['utc_offset'] * 15:.8f}", f"site_elevation {site['elevation']:.8f}", "weather_data_file_units 1"]
    top = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "n long, value string")
    local = F.timestamp_seconds(F.col("midpoint_unix") + F.lit(int(site["utc_offset"] * 3600)))
    clock = F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600
    rows = weather.select(F.col("idx").alias("n"), F.format_string("%d %d %.8f %.8f %.8f", F.month(local), F.dayofmonth(local), clock.cast("double"), "dni", "dhi").alias("value"))
    return top.unionByName(rows)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines(n, value) in the order of n; one file, as these formats ask for."""
    lines.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def csv_lines(weather: DataFrame, note: str = "") -> DataFrame:
    """(n, value): the weather CSV with its two comment lines; numbers keep all digits."""
    top = weather.sparkSession.createDataFrame([(-2, f"# weather {note}".strip()), (-1, "# " + ",".join(CSV))], "n long, value string")
    rows = weather.select(F.col("idx").alias("n"), F.to_csv(F.struct(*CSV)).alias("value"))
    return top.unionByName(rows)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weather records of CSV files with two comment lines and fixed columns."""
    rows = _lines(spark, path).where("not line like '#%'").select("path", "n", F.from_csv("line", _CSV_KINDS).alias("r"))
    if rows.isEmpty():
        raise InvalidInput("no weather records")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("long").alias("idx"), "r.*")
