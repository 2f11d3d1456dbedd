import math

import numpy as np
import pytest

from solvane import fixtures as fx
from solvane.core import InvalidInput
from solvane.operators import mesh
from solvane.sources import mesh_files as mf

QUAD = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n"
TETRA = "v 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nf 1 3 2\nf 1 2 4\nf 2 3 4\nf 3 1 4\n"
BROKEN = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nv 9 9 9\nf 1 2 3\nf 2 3 1\nf 1 1 2\nf 1 3 4\n"


def tables(spark, *texts):
    v, f = [], []
    for k, text in enumerate(texts, 1):
        _, points, triples = mf.parse_obj(text)[0][0]
        v += [(k, i, *map(float, p)) for i, p in enumerate(points)]
        f += [(k, i, *map(int, t)) for i, t in enumerate(triples)]
    return spark.createDataFrame(v, "mesh_id long, vertex_index long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, face_index long, v0 long, v1 long, v2 long")


def test_audit_of_known_meshes(spark):
    a = {r["mesh_id"]: r for r in mesh.audit(*tables(spark, QUAD, TETRA, BROKEN)).collect()}
    assert a[1]["ready"] and not a[1]["watertight"] and a[1]["boundary_edges"] == 4 and a[1]["components"] == 1
    assert a[1]["area"] == pytest.approx(1.0)
    assert a[2]["watertight"] and a[2]["boundary_edges"] == 0 and a[2]["signed_volume"] == pytest.approx(1 / 6)
    assert not a[3]["ready"] and (a[3]["duplicate_faces"], a[3]["degenerate_faces"], a[3]["isolated_vertices"]) == (1, 1, 1)


def test_repair_drops_faults_and_compacts(spark):
    v, f = mesh.repair(*tables(spark, BROKEN))
    assert v.count() == 4 and f.count() == 2
    assert mesh.audit(v, f).first()["ready"]


def test_weld_and_winding(spark):
    two = "v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 0 0.0000001\nv 1 1 0\nv 0 1 0\nf 1 2 3\nf 4 6 5\n"
    v, f, a = mesh.heal(*tables(spark, two), weld_tolerance=1e-4)
    r = a.first()
    assert v.count() == 4 and r["boundary_edges"] == 4 and r["winding_conflicts"] == 0
    inside_out = TETRA.replace("f 1 3 2\nf 1 2 4\nf 2 3 4\nf 3 1 4", "f 1 2 3\nf 1 4 2\nf 2 4 3\nf 3 4 1")
    _, _, a = mesh.heal(*tables(spark, inside_out))
    assert a.first()["signed_volume"] == pytest.approx(1 / 6)


def test_clip_keeps_the_part_inside(spark):
    v, f, notes = mesh.clip(*tables(spark, QUAD), (0, 0, -1), (0.5, 1, 1))
    assert mesh.audit(v, f).first()["area"] == pytest.approx(0.5)
    assert notes.first()["note_b"] == 2


def test_surface_grid_keeps_area_and_limits_edges(spark):
    c = mesh.surface_grid(*tables(spark, QUAD), target=0.3, offset=0.1).toPandas()
    assert c["area"].sum() == pytest.approx(1.0)
    p = c[[f"{k}{x}" for k in "abc" for x in "xyz"]].to_numpy().reshape(-1, 3, 3)
    assert np.linalg.norm(p - np.roll(p, 1, axis=1), axis=2).max() <= 0.3 + 1e-12
    assert sorted(c["sensor_id"]) == list(range(1, len(c) + 1)) and (c["pz"] - 0.1).abs().max() < 1e-12


@pytest.mark.parametrize("kind", ["stl", "stl-ascii", "ply", "ply-ascii", "gltf", "glb"])
def test_formats_round_trip(spark, tmp_path, kind):
    v, f = tables(spark, TETRA)
    content = mf.encoded(v, f, kind).first()["content"]
    end = kind.split("-")[0]
    (tmp_path / f"m.{end}").write_bytes(bytes(content))
    v2, f2, names = mf.read_meshes(spark, f"{tmp_path}/m.{end}")
    a = mesh.audit(v2, f2).first()
    assert names.count() == 1 and a["watertight"] and a["signed_volume"] == pytest.approx(1 / 6)


def test_obj_objects_negative_indices_and_refusals(spark, tmp_path):
    parts, ignored = mf.parse_obj("o a\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\no b\nv 0 0 1\nvn 0 0 1\nf 1/1 2/2 4\n")
    assert [p[0] for p in parts] == ["a", "b"] and ignored == 1 and len(parts[1][1]) == 3
    with pytest.raises(InvalidInput):
        mf.parse_obj(QUAD + "v 2 2 0\nf 1 2 3 4 5\n")
    v, f = tables(spark, QUAD)
    text = mf.obj_lines(v, f).first()["value"]
    (tmp_path / "q.obj").write_text(text)
    v2, f2, _ = mf.read_meshes(spark, f"{tmp_path}/q.obj")
    assert mesh.audit(v2, f2).first()["area"] == pytest.approx(1.0)


def test_negative_zero_and_points_merge():
    _, p, t = mf.parse_stl(mf.to_bytes("stl", np.array([[0.0, 0, 0], [1, 0, 0], [-0.0, 1, 0]]), np.array([[0, 1, 2], [0, 2, 1]])))
    assert len(p) == 3 and len(t) == 2
    assert not math.copysign(1, p[:, 0].min()) < 0


def test_generated_corners_are_not_broadcast(spark, data):
    """Rows made by a generator are estimated at their file's size, so plans must not rest on that."""
    v, f = fx.meshes(spark, data)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(mesh.face_flags(v, f)) and "BroadcastHashJoin" not in plan(mesh.issues(v, f))
    assert "BroadcastHashJoin" not in plan(mesh.audit(v, f))


def test_repair_of_many_meshes_is_not_broadcast(spark, data):
    v, f = mesh.repair(*fx.blocks(spark, data))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(v) and "BroadcastHashJoin" not in plan(f)
    assert v.count() == 800 and f.count() == 400


def test_cells_of_a_surface_grid_rest_on_no_broadcast(spark, data, monkeypatch):
    """The faces that are split first come out of joins by sorted parts."""
    seen, flags = [], mesh.face_flags
    monkeypatch.setattr(mesh, "face_flags", lambda *a: seen.append(flags(*a)) or seen[-1])
    cells = mesh.surface_grid(*fx.meshes(spark, data), target=5.0)
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert cells.select("source_face").distinct().count() == 400


def test_duplicates_are_found_without_a_broadcast(spark, data):
    from solvane import queries

    out = queries.queries()["mesh_duplicate_faces"](spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and out.count() == 20
