"""One function for each verb of a command line or a node canvas.

``VERBS`` is the list to look things up in; what a verb needs and gives is in its
function's docstring.  Verbs that ask about devices or start external renderers
have no counterpart here.
"""

from __future__ import annotations

from collections.abc import Callable

from solvane.functions.solar_position import sun_set
from solvane.operators import daylight, evidence, graphs, materialised, mesh, rays, scene, study, sun, visibility, weather
from solvane.sources import exports, mesh_files, weather_files
from solvane.streaming import live

VERBS: dict[str, Callable] = {
    "cache": materialised.Materialised,
    "queue": materialised.Queue,
    "self-test": rays.parity,
    "sun-position": sun_set,
    "direct-sun": sun.direct_sun_timeline,
    "direct-sun-summary": sun.direct_sun_summary,
    "sky-view": sun.sky_view_timeline,
    "sky-view-summary": sun.sky_view_summary,
    "solar-envelope": sun.solar_envelope,
    "solar-scenarios": sun.scenario_timeline,
    "solar-scenarios-summary": sun.scenario_summary,
    "pv-potential": sun.pv_potential,
    "pv-regions": sun.pv_regions,
    "annual-irradiance": daylight.annual_irradiance,
    "daylight-matrix": daylight.coefficient_matrix,
    "daylight-point": daylight.point_illuminance,
    "daylight-factor": daylight.daylight_factor,
    "annual-daylight": daylight.annual_daylight,
    "annual-daylight-project": daylight.daylight_project,
    "daylight-compare": daylight.compare,
    "render-export": exports.render_bundle,
    "isovist": visibility.isovist_rays,
    "isovist-summary": visibility.isovist_summary,
    "isovist-3d": visibility.isovist3d_layers,
    "isovist-3d-summary": visibility.isovist3d,
    "landmark-visibility": visibility.landmarks,
    "intervisibility": visibility.intervisibility,
    "visibility-graph": visibility.graph_pairs,
    "sparse-visibility-graph": visibility.sparse_graph,
    "graph-centralities": graphs.centralities,
    "target-view": visibility.target_view_samples,
    "view-corridor": visibility.corridors,
    "observer-path": visibility.path_observers,
    "study-rank": study.rank_study,
    "study-sensitivity": study.statistical_sensitivity,
    "study-schema": exports.json_schema,
    "study-init": study.Workspace.create,
    "study-status": study.Workspace,
    "study-batch": study.Optimizer,
    "study-commit": study.Workspace.commit,
    "study-report": exports.html_report,
    "study-table": exports.study_table,
    "study-space": exports.objective_space_gltf,
    "inline-vectors": exports.inline_vectors,
    "evidence-write": exports.evidence_table,
    "scenario-compare": study.compare_scenarios,
    "evidence-design": evidence.saltelli_design,
    "evidence-morris": evidence.morris_design,
    "evidence-sensitivity": evidence.sobol_indices,
    "evidence-robust": evidence.robust_scenarios,
    "evidence-uncertainty": evidence.uncertainty_ranking,
    "evidence-multifidelity": evidence.recommend,
    "evidence-passport": evidence.seal,
    "evidence-table": exports.evidence_rows,
    "mesh-check": mesh.audit,
    "mesh-repair": mesh.heal,
    "mesh-clip": mesh.clip,
    "mesh-read": mesh_files.read_meshes,
    "mesh-convert": mesh_files.encoded,
    "mesh-write": mesh_files.write_files,
    "surface-grid": mesh.surface_grid,
    "scene-build": scene.world_triangles,
    "scene-deltas": scene.apply_deltas,
    "scene-portable": scene.portable,
    "scene-stream": live.start_deltas,
    "scene-pack": exports.pack_document,
    "scene-unpack": exports.unpack_document,
    "weather-read": weather_files.read_epw,
    "weather-convert": weather_files.wea_lines,
    "weather-policy": weather.apply_policy,
    "weather-select": weather.select,
    "period-schedule": weather.schedule,
}
