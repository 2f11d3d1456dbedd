"""Mesh files: OBJ, STL, PLY, glTF and GLB, read from any folder Spark can list, and written deterministically.

A reader turns files into mesh tables (core.MESH_VERTEX, core.MESH_FACE); a file
is the unit of work.  Formats that hold polygons give triangles: quads are split
at the diagonal 0-2, larger polygons are refused.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.core import InvalidInput
from solvane.operators.graphs import _cut

Part = tuple[str, np.ndarray, np.ndarray]  #: name, points, triples


def _split(polygon: list[int]) -> list[tuple[int, int, int]]:
    if len(polygon) == 3:
        return [tuple(polygon)]  # type: ignore[list-item]
    if len(polygon) == 4:
        a, b, c, d = polygon
        return [(a, b, c), (a, c, d)]
    raise InvalidInput(f"a polygon of {len(polygon)} corners")


def parse_obj(text: str) -> tuple[list[Part], int]:
    """Objects of an OBJ text, each with the vertices that it uses, and the number of lines that are not read."""
    points: list[tuple[float, ...]] = []
    parts: list[tuple[str, list[tuple[int, int, int]]]] = [("", [])]
    ignored = 0
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        if words[0] == "v":
            try:
                points.append(tuple(float(x) for x in words[1:4]))
            except ValueError as e:
                raise InvalidInput(f"line {number}: {e}") from e
            if len(points[-1]) != 3:
                raise InvalidInput(f"line {number}: a vertex has three numbers")
        elif words[0] == "f":
            polygon = []
            for w in words[1:]:
                i = int(w.split("/", 1)[0])
                i = i - 1 if i > 0 else len(points) + i
                if not 0 <= i < len(points) or w.startswith("0"):
                    raise InvalidInput(f"line {number}: no vertex {w}")
                polygon.append(i)
            if len(polygon) < 3:
                raise InvalidInput(f"line {number}: a face has three corners at least")
            parts[-1][1].extend(_split(polygon))
        elif words[0] == "o":
            parts.append((" ".join(words[1:]), []))
        else:
            ignored += 1
    p = np.array(points, float).reshape(-1, 3)
    named = [(n, f) for n, f in parts if f]
    if len(named) <= 1:
        return [(named[0][0] if named else "", p, np.array(named[0][1] if named else [], np.int64).reshape(-1, 3))], ignored
    out = []
    for n, f in named:
        t = np.array(f, np.int64)
        used, new = np.unique(t, return_inverse=True)
        out.append((n, p[used], new.reshape(t.shape)))
    return out, ignored


def _merged(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points once each by their exact bits (0 and -0 alike), in order of first use, and the index of each input point."""
    p = points + 0.0
    _, first, back = np.unique(p.view(np.uint64).reshape(len(p), 3), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return p[first[order]], rank[back.ravel()]


def parse_stl(data: bytes) -> Part:
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        n = struct.unpack_from("<I", data, 80)[0]
        rows = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        corners = rows["p"].reshape(-1, 3).astype(float)
        name = ""
    else:
        words = data.decode("ascii", "strict").split()
        if not words or words[0] != "solid":
            raise InvalidInput("neither a binary nor an ASCII STL")
        name = words[1] if len(words) > 1 and words[1] != "facet" else ""
        at = [k for k, w in enumerate(words) if w == "vertex"]
        corners = np.array([[float(x) for x in words[k + 1 : k + 4]] for k in at], float).reshape(-1, 3)
        if len(corners) % 3:
            raise InvalidInput("a facet has three corners")
    points, index = _merged(corners) if len(corners) else (corners, np.zeros(0, np.int64))
    return name, points, index.reshape(-1, 3)


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}  # fixed values


def parse_ply(data: bytes) -> Part:
    head, _, body = data.partition(b"end_header\n")
    lines = head.decode("ascii").split("\n")
    if lines[0].strip() != "ply":
        raise InvalidInput("not a PLY")
    form, elements = "", []
    for line in lines[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info"):
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append(tuple(w[1:]))
    if form not in ("ascii", "binary_little_endian"):
        raise InvalidInput(f"PLY format {form}")
    points, faces = np.zeros((0, 3)), []
    words, k, at = (body.split() if form == "ascii" else []), 0, 0
    for name, count, props in elements:
        table: dict[str, list] = {p[-1]: [] for p in props}
        scalar = all(p[0] != "list" for p in props)
        if form != "ascii" and scalar:
            rows = np.frombuffer(body, np.dtype([(p[1], "<" + _PLY[p[0]]) for p in props]), count, at)
            at += rows.nbytes
            table = {n: rows[n] for n in table}
        else:
            for _ in range(count):
                for p in props:
                    if p[0] == "list":
                        if form == "ascii":
                            n = int(words[k])
                            v = [int(x) for x in words[k + 1 : k + 1 + n]]
                            k += 1 + n
                        else:
                            n = int(np.frombuffer(body, "<" + _PLY[p[1]], 1, at)[0])
                            at += np.dtype(_PLY[p[1]]).itemsize
                            v = np.frombuffer(body, "<" + _PLY[p[2]], n, at).astype(int).tolist()
                            at += n * np.dtype(_PLY[p[2]]).itemsize
                        table[p[-1]].append(v)
                    elif form == "ascii":
                        table[p[-1]].append(float(words[k]))
                        k += 1
                    else:
                        table[p[-1]].append(float(np.frombuffer(body, "<" + _PLY[p[0]], 1, at)[0]))
                        at += np.dtype(_PLY[p[0]]).itemsize
        if name == "vertex":
            points = np.column_stack([np.asarray(table[x], float) for x in "xyz"])
        elif name == "face":
            own = table.get("vertex_indices") or table.get("vertex_index") or []
            faces = [t for f in own for t in _split(list(f))]
    return "", points, np.array(faces, np.int64).reshape(-1, 3)


_COMPONENT = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}  # fixed values
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}  # fixed values


def parse_gltf(doc: dict, chunk: bytes | None = None) -> list[Part]:
    """Meshes of a glTF 2 document in the places of its nodes; buffers are embedded, primitives are triangles."""
    if not str(doc.get("asset", {}).get("version", "")).startswith("2."):
        raise InvalidInput("not glTF 2")
    buffers = []
    for b in doc.get("buffers", []):
        uri = b.get("uri")
        if uri is None:
            if chunk is None:
                raise InvalidInput("a buffer is missing")
            buffers.append(chunk)
        elif uri.startswith("data:"):
            buffers.append(base64.b64decode(uri.split(",", 1)[1]))
        else:
            raise InvalidInput("external buffers are not read")

    def read(k: int) -> np.ndarray:
        a = doc["accessors"][k]
        if "sparse" in a:
            raise InvalidInput("sparse accessors are not read")
        v = doc["bufferViews"][a["bufferView"]]
        kind = np.dtype("<" + _COMPONENT[a["componentType"]])
        width = _WIDTH[a["type"]]
        step = v.get("byteStride", kind.itemsize * width)
        raw = buffers[v["buffer"]]
        at = v.get("byteOffset", 0) + a.get("byteOffset", 0)
        return np.stack([np.frombuffer(raw, kind, width, at + step * i) for i in range(a["count"])]) if a["count"] else np.zeros((0, width))

    def local(node: dict) -> np.ndarray:
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", [0, 0, 0, 1])
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        m = np.eye(4)
        m[:3, :3] = turn * np.array(node.get("scale", [1, 1, 1]), float)
        m[:3, 3] = node.get("translation", [0, 0, 0])
        return m

    out: list[Part] = []

    def visit(k: int, above: np.ndarray, depth: int) -> None:
        if depth > 256:
            raise InvalidInput("nodes are nested too deep")
        node = doc["nodes"][k]
        m = above @ local(node)
        if "mesh" in node:
            mesh = doc["meshes"][node["mesh"]]
            for p in mesh["primitives"]:
                if p.get("mode", 4) != 4:
                    raise InvalidInput("only triangles are read")
                points = read(p["attributes"]["POSITION"]).astype(float)
                index = read(p["indices"]).ravel().astype(np.int64) if "indices" in p else np.arange(len(points))
                t = index.reshape(-1, 3)
                if np.linalg.det(m[:3, :3]) < 0:
                    t = t[:, [0, 2, 1]]
                out.append((node.get("name") or mesh.get("name", ""), points @ m[:3, :3].T + m[:3, 3], t))
        for c in node.get("children", []):
            visit(c, m, depth + 1)

    roots = doc["scenes"][doc.get("scene", 0)]["nodes"] if doc.get("scenes") else sorted(set(range(len(doc.get("nodes", [])))) - {c for n in doc.get("nodes", []) for c in n.get("children", [])})
    for r in roots:
        visit(r, np.eye(4), 0)
    return out


def parse_glb(data: bytes) -> list[Part]:
    magic, version, size = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or size != len(data):
        raise InvalidInput("not a GLB of version 2")
    at, doc, chunk = 12, None, None
    while at < size:
        n, kind = struct.unpack_from("<I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"JSON":
            doc = json.loads(body)
        elif kind == b"BIN\x00":
            chunk = body
        at += 8 + n
    return parse_gltf(doc or {}, chunk)


def parse(path: str, data: bytes) -> tuple[list[Part], int]:
    """Parts of a file by its ending, and lines left out."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "obj":
        return parse_obj(data.decode())
    if end == "stl":
        return [parse_stl(data)], 0
    if end == "ply":
        return [parse_ply(data)], 0
    if end == "gltf":
        return parse_gltf(json.loads(data)), 0
    if end == "glb":
        return parse_glb(data), 0
    raise InvalidInput(f"unknown mesh format: {path}")


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and (mesh_id, path, part, name, ignored_lines) of all mesh files under a path or pattern."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                parts, ignored = parse(p, bytes(data))
                out += [(p, k, name, ignored, points.tolist(), t.tolist()) for k, (name, points, t) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["path", "part", "name", "ignored_lines", "points", "triples"])

    kinds = "path string, part int, name string, ignored_lines int, points array<array<double>>, triples array<array<long>>"
    parts = _cut(files.mapInPandas(run, kinds).withColumn("mesh_id", F.xxhash64("path", "part")))
    v = parts.select("mesh_id", F.posexplode("points").alias("k", "p")).select("mesh_id", F.col("k").cast("long").alias("vertex_index"), *[F.element_at("p", i + 1).alias(x) for i, x in enumerate("xyz")])
    f = parts.select("mesh_id", F.posexplode("triples").alias("k", "t")).select("mesh_id", F.col("k").cast("long").alias("face_index"), *[F.element_at("t", i + 1).alias(f"v{i}") for i in range(3)])
    return v, f, parts.select("mesh_id", "path", "part", "name", "ignored_lines")


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, value): one OBJ text for each mesh, with all digits of its numbers."""
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vertex_index", F.concat_ws(" ", F.lit("v"), *[F.col(x).cast("string") for x in "xyz"]).alias("line")))).alias("v"))
    f = faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("face_index", F.concat_ws(" ", F.lit("f"), *[(F.col(f"v{k}") + 1).cast("string") for k in range(3)]).alias("line")))).alias("f"))
    return v.join(f, "mesh_id", "left").select("mesh_id", F.concat(F.array_join("v.line", "\n"), F.lit("\n"), F.coalesce(F.array_join("f.line", "\n"), F.lit(""))).alias("value"))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """OBJ texts under path, partitioned by mesh."""
    obj_lines(vertices, faces).write.partitionBy("mesh_id").mode("overwrite").text(path)


def to_bytes(kind: str, points: np.ndarray, triples: np.ndarray) -> bytes:
    """A mesh as stl, stl-ascii, ply, ply-ascii, gltf or glb."""
    p, t = np.asarray(points, float).reshape(-1, 3), np.asarray(triples, np.int64).reshape(-1, 3)
    corners = p[t]
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    if kind == "stl":
        rows = np.zeros(len(t), np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]))
        rows["n"], rows["p"] = n, corners
        return b"\0" * 80 + struct.pack("<I", len(t)) + rows.tobytes()
    if kind == "stl-ascii":
        facet = [f"facet normal {a[0]!r} {a[1]!r} {a[2]!r}\nouter loop\n" + "".join(f"vertex {float(x)!r} {float(y)!r} {float(z)!r}\n" for x, y, z in c) + "endloop\nendfacet\n" for a, c in zip(n.tolist(), corners, strict=True)]
        return ("solid mesh\n" + "".join(facet) + "endsolid mesh\n").encode()
    if kind in ("ply", "ply-ascii"):
        form = "binary_little_endian" if kind == "ply" else "ascii"
        head = f"ply\nformat {form} 1.0\nelement vertex {len(p)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(t)}\nproperty list uchar int vertex_indices\nend_header\n".encode()
        if kind == "ply":
            rows = np.zeros(len(t), np.dtype([("n", "u1"), ("t", "<i4", 3)]))
            rows["n"], rows["t"] = 3, t
            return head + p.astype("<f8").tobytes() + rows.tobytes()
        return head + ("".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in p.tolist()) + "".join(f"3 {a} {b} {c}\n" for a, b, c in t.tolist())).encode()
    if kind in ("gltf", "glb"):
        body = p.astype("<f4").tobytes() + t.astype("<u4").tobytes()
        views = [{"buffer": 0, "byteOffset": 0, "byteLength": 12 * len(p)}, {"buffer": 0, "byteOffset": 12 * len(p), "byteLength": 12 * len(t)}]
        f32 = p.astype("<f4").astype(float)
        accessors = [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": f32.min(axis=0).tolist() if len(p) else [0, 0, 0], "max": f32.max(axis=0).tolist() if len(p) else [0, 0, 0]}, {"bufferView": 1, "componentType": 5125, "count": 3 * len(t), "type": "SCALAR"}]
        doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "buffers": [{"byteLength": len(body)}], "bufferViews": views, "accessors": accessors}
        if kind == "gltf":
            doc["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(body).decode()
            return json.dumps(doc, sort_keys=True).encode()
        text = json.dumps(doc, sort_keys=True).encode()
        text += b" " * (-len(text) % 4)
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body
    raise InvalidInput(f"unknown mesh format {kind}")


def encoded(vertices: DataFrame, faces: DataFrame, kind: str) -> DataFrame:
    """(mesh_id, content): each mesh's file as bytes, made where the mesh is."""
    from solvane.operators.mesh import _as_arrays

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                index = {int(k): n for n, k in enumerate(r.vertex_index)}
                t = [[index[int(i)] for i in f] for f in zip(*([] if c is None else c for c in (r.v0, r.v1, r.v2)), strict=True)]
                out.append((r.mesh_id, to_bytes(kind, np.column_stack([r.x, r.y, r.z]), np.array(t, np.int64))))
            yield pd.DataFrame(out, columns=["mesh_id", "content"])

    return _as_arrays(vertices, faces).mapInPandas(run, "mesh_id long, content binary")


def write_files(vertices: DataFrame, faces: DataFrame, kind: str, folder: str) -> DataFrame:
    """Writes each mesh as a file (obj, stl, stl-ascii, ply, ply-ascii, gltf, glb) to a folder's URI; returns (mesh_id, path), written there too.

    Files are made and written by the tasks that hold the meshes, under another
    name first, so that a task that is run again leaves whole files.
    """
    ending = kind.split("-")[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        store, at = (pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else pafs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            paths = []
            for mesh, content in zip(b["mesh_id"], b["content"], strict=True):
                name = f"mesh-{mesh}.{ending}"
                own = f"{at}/{name}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(own) as out:
                    out.write(bytes(content))
                if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(f"{at}/{name}").type != pafs.FileType.NotFound:
                    store.delete_file(f"{at}/{name}")
                store.move(own, f"{at}/{name}")
                paths.append(f"{folder}/{name}")
            yield pd.DataFrame({"mesh_id": b["mesh_id"], "path": paths})

    content = obj_lines(vertices, faces).select("mesh_id", F.col("value").cast("binary").alias("content")) if kind == "obj" else encoded(vertices, faces, kind)
    written = content.mapInPandas(run, "mesh_id long, path string")
    written.write.mode("overwrite").parquet(f"{folder}/_written")
    return vertices.sparkSession.read.schema("mesh_id long, path string").parquet(f"{folder}/_written")
