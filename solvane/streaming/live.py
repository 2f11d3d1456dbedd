"""Live extensions: scene deltas and weather feeds as Structured Streaming.

Batches are applied exactly once: a snapshot is written under its batch's number
and an applied number is not applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solvane.operators.scene import apply_deltas
from solvane.operators.weather import from_events


def snapshot(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """(number, instances) of the newest snapshot that is whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=") and fs.exists(jvm_path(s.getPath(), "_SUCCESS"))]
    return (max(numbers), spark.read.parquet(f"{folder}/batch={max(numbers)}")) if numbers else None


def apply_delta_batch(deltas: DataFrame, number: int, folder: str) -> None:
    """Applies one batch of deltas to the newest snapshot, once."""
    spark = deltas.sparkSession
    now = snapshot(spark, folder)
    if now is None:
        raise ValueError("there is no first snapshot")
    if now[0] >= number:
        return
    out, _ = apply_deltas(now[1], deltas) if not deltas.isEmpty() else (now[1], None)
    out.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def start_deltas(deltas: DataFrame, instances: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of deltas into snapshots under a folder; the first one is the given instances."""
    if snapshot(instances.sparkSession, folder) is None:
        instances.write.parquet(f"{folder}/batch=-1")
    return deltas.writeStream.foreachBatch(lambda df, n: apply_delta_batch(df, n, folder)).option("checkpointLocation", checkpoint).start()


def hourly_weather(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Hourly weather of a stream of events; an hour comes out when the watermark has passed it."""
    return from_events(events, watermark)


def newest_generation(results: DataFrame) -> DataFrame:
    """Results(scope, generation, ...) of each scope's newest generation: what was superseded goes."""
    newest = results.groupBy("scope").agg(F.max("generation").alias("generation"))
    return results.join(newest, ["scope", "generation"], "left_semi")
