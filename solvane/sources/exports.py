"""Sinks: timelines as CSV, studies as Parquet with a column for each field, objective space, reports, scene documents."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.core import InvalidInput, require_none

MAGIC = b"SLVN"
VERSION = 1


def slug(name: str) -> str:
    """A column name: lower case, other signs than letters and digits as one underscore."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "field"


def write_timeline(df: DataFrame, path: str) -> None:
    """Any timeline or matrix as CSV with a header; the files stay as many as the tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def study_table(rows: DataFrame, parameters: list[str], objectives: list[tuple[str, int]], constraints: list[str]) -> DataFrame:
    """Arrays values, objectives and residuals as columns named by slugs; objectives have (name, components)."""
    cols: list[Column] = [F.element_at("values", k + 1).alias(f"parameter_{slug(n)}") for k, n in enumerate(parameters)]
    at = 1
    for name, size in objectives:
        for c in range(size):
            cols.append(F.element_at("objectives", at).alias(f"objective_{slug(name)}" + (f"_{c}" if size > 1 else "")))
            at += 1
    cols += [F.element_at("residuals", k + 1).alias(f"constraint_{slug(n)}") for k, n in enumerate(constraints)]
    rest = [c for c in rows.columns if c not in ("values", "objectives", "residuals")]
    return rows.select(*rest, *cols)


def write_study(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("compression", "snappy").parquet(path)


def objective_space(rows: DataFrame, axes: list[str]) -> DataFrame:
    """rows with x, y, z: up to three objectives brought to [-1, 1], 0 where one does not vary."""
    span = rows.agg(*[F.min(a).alias(f"lo{k}") for k, a in enumerate(axes[:3])], *[F.max(a).alias(f"hi{k}") for k, a in enumerate(axes[:3])])
    out = rows.crossJoin(F.broadcast(span))
    for k, x in enumerate("xyz"):
        if k < len(axes):
            d = F.col(f"hi{k}") - F.col(f"lo{k}")
            out = out.withColumn(x, F.when(d > 0, 2 * (F.col(axes[k]) - F.col(f"lo{k}")) / d - 1).otherwise(0.0))
        else:
            out = out.withColumn(x, F.lit(0.0))
    return out.drop(*[f"{e}{k}" for k in range(3) for e in ("lo", "hi")])


def objective_space_gltf(points: DataFrame, most: int = 1_000_000) -> bytes:
    """A glTF 2 text of points(x, y, z) as one point cloud, in the order of their coordinates; more than ``most`` are refused."""
    import base64
    import struct

    rows = points.select("x", "y", "z").orderBy("x", "y", "z").limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidInput(f"more than {most} points")
    body = b"".join(struct.pack("<3f", r["x"], r["y"], r["z"]) for r in rows)
    each = list(zip(*struct.iter_unpack("<3f", body), strict=True)) or [(0.0,)] * 3
    accessor = {"bufferView": 0, "componentType": 5126, "count": len(rows), "type": "VEC3", "min": [min(c) for c in each], "max": [max(c) for c in each]}
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "name": "objective space"}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "mode": 0}]}], "accessors": [accessor], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(body)}]}
    doc["buffers"] = [{"byteLength": len(body), "uri": "data:application/octet-stream;base64," + base64.b64encode(body).decode()}]
    return json.dumps(doc, sort_keys=True).encode()


def inline_vectors(spark: SparkSession, texts: list[str], names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(idx, x, y, z) of vectors given as texts like "1, 0, 2.5"; a text with another number of finite numbers is refused."""
    rows = []
    for k, t in enumerate(texts):
        try:
            v = [float(x) for x in t.replace(";", ",").split(",")]
        except ValueError:
            v = []
        if len(v) != len(names) or not all(abs(x) < float("inf") for x in v):
            raise InvalidInput(f"not a vector: {t}")
        rows.append((k, *v))
    return spark.createDataFrame(rows, "idx int, " + ", ".join(f"{n} double" for n in names))


def evidence_table(timeline: DataFrame, path: str) -> None:
    """Rows of a result as JSON lines with schema version 1.0.0, as ``evidence_rows`` reads them; NaN and endless values are refused."""
    numbers = [f.name for f in timeline.schema.fields if f.dataType.typeName() in ("double", "float")]
    odd = F.lit(False)
    for n in numbers:
        odd = odd | F.isnan(n) | (F.abs(F.col(n)) == float("inf"))
    require_none(timeline.where(odd), "a number is not finite")
    timeline.select(F.lit("1.0.0").alias("schema_version"), "*").write.mode("overwrite").json(path)


def html_report(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with the first rows of some tables; a report, not an export."""
    import html

    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)


def json_schema(manifest: dict) -> dict:
    """A JSON schema of one evaluated candidate of a study."""
    field = lambda p: {"type": "number"} if p.get("kind") != "categorical" else {"enum": p["categories"]}
    part = lambda names: {"type": "object", "properties": names, "required": sorted(names)}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "properties": {
            "candidate_id": {"type": "integer", "minimum": 1},
            "parameters": part({p["name"]: field(p) for p in manifest["parameters"]}),
            "objectives": part({o["name"]: {"type": "array", "items": {"type": "number"}, "minItems": o.get("components", 1), "maxItems": o.get("components", 1)} for o in manifest["objectives"]}),
            "constraints": part({c["name"]: {"type": "number"} for c in manifest.get("constraints", [])}),
        },
        "required": ["candidate_id", "parameters", "objectives"],
    }


def pack_document(doc: dict) -> bytes:
    """A scene document in a binary envelope: magic, version, length, checksum, body."""
    body = json.dumps(doc, sort_keys=True).encode()
    return MAGIC + struct.pack("<IQ", VERSION, len(body)) + hashlib.sha256(body).digest() + body


def unpack_document(data: bytes) -> dict:
    """The document of an envelope, brought to the current schema."""
    if data[:4] != MAGIC:
        raise InvalidInput("not a scene document")
    version, size = struct.unpack_from("<IQ", data, 4)
    body = data[48 : 48 + size]
    if version != VERSION or len(body) != size or len(data) != 48 + size:
        raise InvalidInput("a scene document of another version or length")
    if hashlib.sha256(body).digest() != data[16:48]:
        raise InvalidInput("a damaged scene document")
    return migrated(json.loads(body))


def migrated(doc: dict) -> dict:
    """A document of schema 0 (instances without masks and layers) or 1, as schema 1."""
    version = doc.get("schema_version", 0)
    if version > 1:
        raise InvalidInput(f"schema version {version}")
    if version == 0:
        doc = doc | {"schema_version": 1, "instances": [{"category_mask": -1, "layer": "static"} | i for i in doc.get("instances", [])]}
    return doc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document) of binary scene documents as JSON texts; damaged ones are errors."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "document": [json.dumps(unpack_document(bytes(c)), sort_keys=True) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, document string")


def render_bundle(triangles: DataFrame, materials: DataFrame, assignment: DataFrame, sensors: DataFrame) -> dict[str, DataFrame]:
    """Text lines of a physically based renderer's inputs: materials, polygons, sensor points."""
    glass = F.when(F.col("visible_t") > 0, F.format_string("void trans m%d\n0\n0\n7 %.6f %.6f %.6f 0 0 %.6f 1", "material_id", F.lit(1.0), F.lit(1.0), F.lit(1.0), "visible_t")).otherwise(F.format_string("void plastic m%d\n0\n0\n5 0.5 0.5 0.5 0 0", "material_id"))
    own = triangles.join(assignment, "object_id", "left").withColumn("m", F.coalesce(F.concat(F.lit("m"), F.col("material_id").cast("string")), F.lit("opaque")))
    polygon = F.format_string("%s polygon o%d_%d\n0\n0\n9 %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f", "m", "object_id", "triangle_id", *[f"{c}{x}" for c in "abc" for x in "xyz"])
    point = F.format_string("%.9f %.9f %.9f %.9f %.9f %.9f", "px", "py", "pz", "nx", "ny", "nz")
    return {"materials": materials.select(glass.alias("value")), "geometry": own.select(polygon.alias("value")), "sensors": sensors.orderBy("sensor_id").select(point.alias("value"))}


def evidence_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a strict schema and version 1.0.0; others are errors."""
    rows = spark.read.schema(schema + ", schema_version string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = rows.where("schema_version is null or schema_version <> '1.0.0'")
    if not bad.isEmpty():
        raise InvalidInput("a row has another schema version")
    return rows.drop("_corrupt")
