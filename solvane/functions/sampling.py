"""Low-discrepancy directions and points, as generated tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
_MASK = (1 << 64) - 1


def splitmix(x: int) -> int:
    """The finaliser of SplitMix64 on one 64-bit number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def phase(seed: int) -> float:
    """An angle in [0, 2 pi) for a seed; 0 for seed 0."""
    return 0.0 if seed == 0 else (splitmix(seed) >> 11) / (1 << 53) * 2 * math.pi


def _on_circle(rows: DataFrame, z: Column, seed: int) -> DataFrame:
    angle = F.col("idx") * GOLDEN_ANGLE + phase(seed)
    r = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    return rows.select(F.col("idx").cast("int").alias("idx"), (r * F.cos(angle)).alias("lx"), (r * F.sin(angle)).alias("ly"), z.alias("lz"))


def hemisphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(idx, lx, ly, lz): n directions of equal solid angle above the plane z = 0."""
    return _on_circle(spark.range(n).withColumnRenamed("id", "idx"), (F.col("idx") + 0.5) / n, seed)


def sphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(idx, lx, ly, lz): n directions of equal solid angle."""
    return _on_circle(spark.range(n).withColumnRenamed("id", "idx"), 1 - 2 * (F.col("idx") + 0.5) / n, seed)


def disk(spark: SparkSession, n: int, centred: bool = False) -> DataFrame:
    """(idx, lx, ly): n points of the unit disk; centred: the first is the centre and the last on the rim."""
    share = F.sqrt(F.col("idx") / max(n - 1, 1)) if centred else F.sqrt((F.col("idx") + 0.5) / n)
    angle = F.col("idx") * GOLDEN_ANGLE
    rows = spark.range(n).withColumnRenamed("id", "idx")
    return rows.select(F.col("idx").cast("int").alias("idx"), (share * F.cos(angle)).alias("lx"), (share * F.sin(angle)).alias("ly"))


def radical_inverse(k: int) -> float:
    """Binary digits of k mirrored at the point."""
    out, weight = 0.0, 0.5
    while k:
        out += weight * (k & 1)
        k >>= 1
        weight /= 2
    return out


def triangle_points(spark: SparkSession, n: int) -> DataFrame:
    """(idx, wa, wb, wc): barycentric weights of n points spread over a triangle."""
    rows = []
    for k in range(n):
        r, s = math.sqrt((k + 0.5) / n), radical_inverse(k)
        rows.append((k, 1 - r, r * (1 - s), r * s))
    return spark.createDataFrame(rows, "idx int, wa double, wb double, wc double")


def circle(spark: SparkSession, n: int, field_degrees: float = 360.0) -> DataFrame:
    """(idx, angle): n angles about 0; a full circle is not closed twice, a smaller field includes both ends."""
    full = field_degrees >= 360.0
    span = math.radians(field_degrees)
    angle = F.col("id") / n * span if full else (F.col("id") / max(n - 1, 1) - 0.5) * span
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), angle.alias("angle"))
