"""Weather policies, selection, simulation years and schedules, as windows over records (core.WEATHER)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.core import InvalidInput, require_none

CHANNELS = ("ghi", "dni", "dhi")


def gaps(weather: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, midpoint_unix, missing_seconds) of records that come later than the one before and its duration allow, by more than a second."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("midpoint_unix")
    step = F.col("midpoint_unix") - F.lag("midpoint_unix").over(order)
    expected = (F.lag("duration_hours").over(order) + F.col("duration_hours")) / 2 * 3600
    rows = weather.withColumn("w_extra", step - expected)
    return rows.where("w_extra > 1").select(*(keys or []), "midpoint_unix", F.col("w_extra").alias("missing_seconds"))


def interpolated(weather: DataFrame, channel: str, keys: list[str] | None = None) -> Column:
    """A channel with its missing values filled linearly in time between valid neighbours; ends hold the nearest."""
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("midpoint_unix")
    past, future = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ok = ~F.col(f"{channel}_missing")
    t0, t1 = F.last(F.when(ok, F.col("midpoint_unix")), ignorenulls=True).over(past), F.first(F.when(ok, F.col("midpoint_unix")), ignorenulls=True).over(future)
    v0, v1 = F.last(F.when(ok, F.col(channel)), ignorenulls=True).over(past), F.first(F.when(ok, F.col(channel)), ignorenulls=True).over(future)
    between = v0 + (v1 - v0) * ((F.col("midpoint_unix") - t0) / (t1 - t0))
    return F.when(ok, F.col(channel)).otherwise(F.when(t0.isNull(), v1).when(t1.isNull(), v0).when(t1 == t0, v0).otherwise(between))


def apply_policy(weather: DataFrame, missing: str = "reject", leap_day: str = "keep", on_gap: str = "reject") -> DataFrame:
    """Weather under a policy: missing reject | zero | interpolate, leap_day keep | drop, on_gap reject | preserve.

    Time must increase strictly; gaps are looked for before leap days go.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("midpoint_unix")
    same = weather.withColumn("w_before", F.lag("midpoint_unix").over(order)).where("midpoint_unix = w_before")
    require_none(same, "two records have one time")
    if on_gap == "reject":
        require_none(gaps(weather), "the records have a gap")
    elif on_gap != "preserve":
        raise InvalidInput(f"unknown gap policy {on_gap}")
    out = weather
    if leap_day == "drop":
        out = out.where("not (month = 2 and day = 29)")
    elif leap_day != "keep":
        raise InvalidInput(f"unknown leap day policy {leap_day}")
    if missing == "reject":
        require_none(out.where(" or ".join(f"{c}_missing" for c in CHANNELS)), "radiation is missing")
    elif missing == "zero":
        out = out.withColumns({c: F.when(F.col(f"{c}_missing"), 0.0).otherwise(F.col(c)) for c in CHANNELS})
    elif missing == "interpolate":
        out = out.withColumns({c: interpolated(out, c) for c in CHANNELS})
    else:
        raise InvalidInput(f"unknown missing policy {missing}")
    return out


def with_simulation_year(weather: DataFrame, year: int, utc_offset_hours: float) -> DataFrame:
    """Records moved to a year: midpoints from month, day, hour and minute; a day that the year lacks is an error."""
    day = F.expr(f"try_make_timestamp({year}, month, day, 0, 0, 0)")
    rows = weather.withColumn("w_day", day)
    require_none(rows.where("w_day is null"), f"a record's day is not in {year}")
    minutes = F.when(F.col("minute") == 0, F.lit(60)).otherwise(F.col("minute"))
    end = F.unix_seconds("w_day") + (F.col("hour") - 1) * 3600 + minutes * 60
    middle = end - F.lit(utc_offset_hours * 3600) - F.col("duration_hours") * 1800
    return rows.withColumn("midpoint_unix", middle.cast("long")).withColumn("year", F.lit(year)).drop("w_day")


def weekday_hours(spark: SparkSession, start: int, end: int) -> DataFrame:
    """The 168 occupancy weights (weekday 0 = Monday, hour, occupancy): Monday to Friday in [start, end)."""
    h = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return h.withColumn("occupancy", F.when((F.col("weekday") < 5) & (F.col("hour") >= start) & (F.col("hour") < end), 1.0).otherwise(0.0))


def select(weather: DataFrame, utc_offset_hours: float = 0.0, months: int = 0, weekdays: int = 0, start_hour: float = 0.0, end_hour: float = 24.0, min_dni: float = 0.0, min_ghi: float = 0.0, occupancy: DataFrame | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """Records in a filter, with weight > 0. Masks: bit 0 is January or Monday, 0 stands for all; hours are [start, end).

    occupancy has 168 rows (weekday, hour, occupancy); holidays(month, day) weigh 0.
    """
    local = F.col("midpoint_unix") + F.lit(int(utc_offset_hours * 3600))
    # 1970-01-01 was a Thursday: Monday is weekday 0
    rows = weather.withColumn("w_weekday", ((F.floor(local / 86400) + 3) % 7).cast("int")).withColumn("w_seconds", F.pmod(local, F.lit(86400)))
    hour = F.col("w_seconds") / 3600
    bit = lambda mask, k: F.lit(True) if mask == 0 else F.expr(f"(shiftright({mask}, {k}) & 1) = 1")
    rows = rows.where(bit(months, "month - 1") & bit(weekdays, "w_weekday") & (hour >= start_hour) & (hour < end_hour) & (F.col("dni") >= min_dni) & (F.col("ghi") >= min_ghi))
    rows = rows.withColumn("w_hour", F.floor(hour).cast("int"))
    if occupancy is not None:
        o = occupancy.select(F.col("weekday").alias("w_weekday"), F.col("hour").alias("w_hour"), "occupancy")
        rows = rows.join(F.broadcast(o), ["w_weekday", "w_hour"], "left").withColumn("weight", F.coalesce("occupancy", F.lit(0.0))).drop("occupancy")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    if holidays is not None:
        off = holidays.select("month", "day").distinct().withColumn("w_off", F.lit(True))
        rows = rows.join(F.broadcast(off), ["month", "day"], "left").withColumn("weight", F.when(F.col("w_off"), 0.0).otherwise(F.col("weight"))).drop("w_off")
    return rows.where("weight > 0").drop("w_weekday", "w_hour", "w_seconds")


def schedule(spark: SparkSession, start_unix: int, end_unix: int, step_seconds: int, weight: float = 1.0) -> DataFrame:
    """(unix_seconds, duration_hours, weight): the midpoints of equal intervals from start to end."""
    if end_unix <= start_unix or step_seconds <= 0:
        raise InvalidInput("an empty schedule")
    n = -(-(end_unix - start_unix) // step_seconds)
    first = F.lit(start_unix) + F.col("id") * step_seconds
    last = F.least(first + step_seconds, F.lit(end_unix))
    return spark.range(n).select(F.floor((first + last) / 2).alias("unix_seconds"), ((last - first) / 3600.0).alias("duration_hours"), F.lit(float(weight)).alias("weight"))


def identity(weather: DataFrame) -> DataFrame:
    """One row: a digest of the records' meaning, in the order of time."""
    cols = [c for c in ("midpoint_unix", "duration_hours", "ghi", "dni", "dhi", "albedo") if c in weather.columns]
    row = F.sha2(F.concat_ws("|", F.lit("weather"), *[F.coalesce((F.col(c) + 0).cast("string"), F.lit("~")) for c in cols]), 256)
    # times are distinct, so a sum over rows keeps the order's meaning
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return weather.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(part).cast("string")), 256).alias("weather_hash"))


def from_events(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Hourly weather from events(ts, value, event_type), batch or streaming: an extension for live feeds."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    each = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return each.select(F.unix_seconds("w.start").alias("hour_unix"), F.round(F.col("v") * 2, 3).alias("dni"), F.round(F.col("v") * 0.5, 3).alias("dhi"), F.round(F.col("v") * 1.5, 3).alias("ghi"), (F.col("bought") == 0).alias("dni_missing"))
