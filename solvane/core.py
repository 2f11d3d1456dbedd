"""Schemas, sentinels and checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "None" in results: object, instance and mesh ids; triangle ids.
NO_ID = 0
NO_TRIANGLE = 4294967295
ALL_CATEGORIES = -1

MESH_VERTEX = "mesh_id long, vertex_index long, x double, y double, z double"
MESH_FACE = "mesh_id long, face_index long, v0 long, v1 long, v2 long"
INSTANCE = "instance_id long, object_id long, mesh_id long, transform array<double>, category_mask long, layer string"
TRIANGLE = "object_id long, instance_id long, mesh_id long, triangle_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, category_mask long, mirrored boolean"
RAY = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, t_min double, t_max double, category_mask long"
SENSOR = "sensor_id long, px double, py double, pz double, nx double, ny double, nz double, area double"
SUN = "sun_index int, dx double, dy double, dz double, duration_hours double, weight double, is_active boolean"
WEATHER = "idx long, year int, month int, day int, hour int, minute int, midpoint_unix long, duration_hours double, ghi double, dni double, dhi double, ghi_missing boolean, dni_missing boolean, dhi_missing boolean, dry_bulb double, pressure double, albedo double, flags string"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, qualified.

    Where it is unset, a local session gets a folder of its own, as in tests; on a
    cluster that would be seen by one machine only, and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="solvane-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared root; nothing is there yet."""
    return f"{shared_root(spark)}/solvane/{name}-{uuid.uuid4().hex}"


#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``most`` rows, which are counted up to that."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows; else as it is."""
    return F.broadcast(df) if few(df, most) else df


def large(df: DataFrame) -> DataFrame:
    """df joined by sorted parts, never by broadcast: rows that a generator makes are estimated at the few bytes of the file they come from."""
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt out by number: where each of them makes much work, as a small file's rows do that meet all of another table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class InvalidInput(ValueError):
    """Input that an operator refuses."""


def require_unique(df: DataFrame, *keys: str) -> None:
    """Raises if a key is there twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise InvalidInput(f"{', '.join(keys)}: not unique")


def require_none(df: DataFrame, what: str) -> None:
    """Raises if df has a row."""
    if not df.isEmpty():
        raise InvalidInput(what)


def category(mask):
    """A category mask; 0 stands for all categories."""
    return F.when(mask == 0, F.lit(ALL_CATEGORIES).cast("long")).otherwise(mask.cast("long"))
