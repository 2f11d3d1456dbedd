"""SQL twins (DuckDB dialect) of the registered queries, over the same tables."""

from __future__ import annotations

from solvane.fixtures import SUNS
from solvane.functions.sampling import GOLDEN_ANGLE
from solvane.functions.sky import CLEARNESS, COEFFICIENTS

_SUN_ROWS = ", ".join(f"({k}, {float(x)}::DOUBLE, {float(y)}::DOUBLE, {float(z)}::DOUBLE)" for k, (x, y, z) in enumerate(SUNS))

#: Derived tables by name, each on the tables of the data folder and on earlier ones.
FIXTURES = {
    "quad": """SELECT p_partkey + 1 AS object_id, CAST((p_partkey * 37) % 200 + p_partkey // 2000 % 64 * 200 AS DOUBLE) AS x0, CAST((p_partkey * 61 + (p_partkey // 200) * 17) % 200 + p_partkey // 128000 * 200 AS DOUBLE) AS y0,
        CAST(3 + p_partkey % 3 AS DOUBLE) AS w, CAST(2 + p_size % 10 AS DOUBLE) AS z, CAST(1 << CAST(p_partkey % 4 AS INT) AS BIGINT) AS category_mask FROM part""",
    "tri": """SELECT object_id, CAST(0 AS BIGINT) AS triangle_id, x0 AS ax, y0 AS ay, z AS az, x0 + w AS bx, y0 AS "by", z AS bz, x0 + w AS cx, y0 + w AS cy, z AS cz, category_mask FROM quad
        UNION ALL SELECT object_id, 1, x0, y0, z, x0 + w, y0 + w, z, x0, y0 + w, z, category_mask FROM quad""",
    "coef": "SELECT object_id, CASE object_id % 4 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS c FROM quad",
    "sensor": """SELECT s_suppkey + 1 AS sensor_id, (s_suppkey * 29) % 200 + s_suppkey // 100 % 64 * 200 + 0.37::DOUBLE AS px, (s_suppkey * 53 + (s_suppkey // 10) * 7) % 200 + s_suppkey // 6400 * 200 + 0.61::DOUBLE AS py, 0.0::DOUBLE AS pz,
        CASE s_suppkey % 4 WHEN 1 THEN 0.6::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nx, CASE s_suppkey % 4 WHEN 2 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS ny,
        CASE s_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS nz, CAST(1 + s_suppkey % 5 AS DOUBLE) AS area FROM supplier""",
    "sun": f"SELECT CAST(i AS INTEGER) AS sun_index, dx, dy, dz, dz > 0 AS is_active FROM (VALUES {_SUN_ROWS}) AS v(i, dx, dy, dz)",
    "pair": "SELECT *, nx * dx + ny * dy + nz * dz AS cosine FROM sensor CROSS JOIN sun",
    "sunray": "SELECT sensor_id, sun_index, px + nx * 1e-4::DOUBLE AS ox, py + ny * 1e-4::DOUBLE AS oy, pz + nz * 1e-4::DOUBLE AS oz, dx, dy, dz, 0.0::DOUBLE AS t_min, 1e300::DOUBLE AS t_max FROM pair WHERE is_active AND cosine > 0",
    "sunhit": None,
    "sunfirst": "SELECT sensor_id, sun_index, min(distance) AS distance, arg_min(object_id, (distance, object_id, triangle_id)) AS object_id, arg_min(triangle_id, (distance, object_id, triangle_id)) AS triangle_id FROM sunhit GROUP BY 1, 2",
    "suntime": """SELECT sensor_id, sun_index, CASE WHEN NOT is_active THEN 'inactive' WHEN cosine <= 0 THEN 'back_facing' WHEN distance IS NOT NULL THEN 'blocked' ELSE 'visible' END AS state,
        cosine, 1.0::DOUBLE AS hours, coalesce(object_id, 0) AS object_id, distance FROM pair LEFT JOIN sunfirst USING (sensor_id, sun_index)""",
    "weather": """SELECT h AS hour_unix, h + 1800 AS midpoint_unix, 1.0::DOUBLE AS duration_hours, floor(v * 1.5::DOUBLE * 1000 + 0.37::DOUBLE) / 1000 AS ghi, floor(v * 2 * 1000 + 0.37::DOUBLE) / 1000 AS dni, floor(v * 0.5::DOUBLE * 1000 + 0.37::DOUBLE) / 1000 AS dhi, dni_missing FROM
        (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v, count(*) FILTER (event_type = 'purchase') = 0 AS dni_missing FROM events GROUP BY date_trunc('hour', ts))""",
    "observer": "SELECT c_custkey + 1 AS observer_id, (c_custkey * 31) % 200 + c_custkey // 1500 % 64 * 200 + 0.13::DOUBLE AS px, (c_custkey * 47 + c_custkey // 200 * 13) % 200 + c_custkey // 96000 * 200 + 0.29::DOUBLE AS py, 1.6::DOUBLE AS pz, (1 + c_custkey % 10) / 10.0::DOUBLE AS weight FROM customer",
    "target": "SELECT sensor_id AS target_id, px AS qx, py AS qy, 12.5::DOUBLE AS qz, (1 + (sensor_id - 1) % 5) / 5.0::DOUBLE AS sensitivity, sensor_id % 3 AS group_id FROM sensor",
    "node": "SELECT sensor_id - 1 AS idx, px AS x, py AS y, 1.5::DOUBLE AS z FROM sensor",
    "candidate": """SELECT l_partkey + 1 AS candidate_id, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS rev,
        round(CAST(sum(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE) / count(*), 6) AS disc, CAST(any_value(p_size) - 40 AS DOUBLE) AS residual, CAST(any_value(p_size) AS DOUBLE) AS size, any_value(p_retailprice) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""",
    "outcome": """SELECT l_partkey + 1 AS candidate_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS scenario_id, CAST(count(*) AS DOUBLE) AS probability,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS objective, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 26 AS residual FROM lineitem GROUP BY 1, 2""",
    "obspair": """SELECT *, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS distance0 FROM observer CROSS JOIN target""",
    "obsray": """SELECT observer_id, target_id, px AS ox, py AS oy, pz AS oz, (qx - px) * (1 / distance0) AS dx, (qy - py) * (1 / distance0) AS dy, (qz - pz) * (1 / distance0) AS dz, 1e-4::DOUBLE AS t_min, distance0 - 1e-4::DOUBLE AS t_max
        FROM obspair WHERE distance0 > 1e-4 AND distance0 <= 60 AND distance0 > 2e-4""",
    "obshit": None,
    "obstime": """SELECT p.observer_id, p.target_id, CASE WHEN distance0 <= 1e-4 THEN 'coincident' WHEN distance0 > 60 THEN 'out_of_range' WHEN distance0 <= 2e-4 THEN 'visible' WHEN h.object_id IS NOT NULL THEN 'blocked' ELSE 'visible' END AS state,
        distance0 AS distance, weight, sensitivity, coalesce(h.object_id, 0) AS object_id
        FROM obspair p LEFT JOIN (SELECT observer_id, target_id, arg_min(object_id, (distance, object_id, triangle_id)) AS object_id FROM obshit GROUP BY 1, 2) h USING (observer_id, target_id)""",
    "obsrisk": "SELECT *, CASE WHEN state = 'visible' THEN weight * sensitivity * 1.0 / (1 + distance / 10 * (distance / 10)) ELSE 0.0 END AS risk FROM obstime",
    "edgepair": """SELECT a.idx AS i, b.idx AS j, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS distance FROM node a JOIN node b ON a.idx < b.idx""",
    "viewray": "SELECT sensor_id AS viewpoint_id, sun_index AS idx, px AS ox, py AS oy, 1.6::DOUBLE AS oz, dx, dy, dz, 0.0::DOUBLE AS t_min, 100.0::DOUBLE AS t_max FROM sensor CROSS JOIN sun",
    "viewhit": None,
    "flat": "SELECT CAST(i AS INTEGER) AS idx, dx, dy FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.8::DOUBLE, 0.6::DOUBLE), (2, 0.6::DOUBLE, 0.8::DOUBLE), (3, 0.0::DOUBLE, 1.0::DOUBLE), (4, -0.6::DOUBLE, 0.8::DOUBLE), (5, -0.8::DOUBLE, 0.6::DOUBLE), (6, -1.0::DOUBLE, 0.0::DOUBLE), (7, -0.8::DOUBLE, -0.6::DOUBLE), (8, -0.6::DOUBLE, -0.8::DOUBLE), (9, 0.0::DOUBLE, -1.0::DOUBLE), (10, 0.6::DOUBLE, -0.8::DOUBLE), (11, 0.8::DOUBLE, -0.6::DOUBLE)) AS v(i, dx, dy)",
}


def _hits(rays: str, keys: str) -> str:
    """All accepted ray-triangle hits, by the same arithmetic as the engine's."""
    return f"""SELECT {keys}, object_id, triangle_id, category_mask, t AS distance, u, v, det > 0 AS front_face FROM (
        SELECT r.*, g.object_id, g.triangle_id, g.category_mask, bx - ax AS e1x, "by" - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z,
          dy * e2z - dz * e2y AS hx, dz * e2x - dx * e2z AS hy, dx * e2y - dy * e2x AS hz, e1x * hx + e1y * hy + e1z * hz AS det,
          CASE WHEN abs(det) > 1e-14 * sqrt(e1x * e1x + e1y * e1y + e1z * e1z) * sqrt(e2x * e2x + e2y * e2y + e2z * e2z) THEN 1.0 / det END AS inv,
          ox - ax AS sx, oy - ay AS sy, oz - az AS sz, (sx * hx + sy * hy + sz * hz) * inv AS u,
          sy * e1z - sz * e1y AS q1, sz * e1x - sx * e1z AS q2, sx * e1y - sy * e1x AS q3, (dx * q1 + dy * q2 + dz * q3) * inv AS v, (e2x * q1 + e2y * q2 + e2z * q3) * inv AS t
        FROM {rays} r CROSS JOIN tri g) WHERE u >= 0 AND u <= 1 AND v >= 0 AND u + v <= 1 AND t >= t_min AND t <= t_max"""


FIXTURES["sunhit"] = _hits("sunray", "sensor_id, sun_index, t_max")
FIXTURES["obshit"] = _hits("obsray", "observer_id, target_id")
FIXTURES["viewhit"] = _hits("viewray", "viewpoint_id, idx")
#: What each derived table stands on.
NEEDS = {
    "tri": "quad", "coef": "quad", "pair": "sensor sun", "sunray": "pair", "sunhit": "sunray tri", "sunfirst": "sunhit", "suntime": "pair sunfirst", "target": "sensor", "node": "sensor",
    "obspair": "observer target", "obsray": "obspair", "obshit": "obsray tri", "obstime": "obspair obshit", "obsrisk": "obstime", "edgepair": "node", "viewray": "sensor sun", "viewhit": "viewray tri",
}


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """body after the derived tables that it needs."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, "").split():
            need(m)
        if n not in order:
            order.append(n)

    for n in needs.split():
        need(n)
    ctes = [f"{n} AS MATERIALIZED ({FIXTURES[n]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + (", " if ctes else "") + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + (", " if ctes else "") + body[5:]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


#: Walks a ray's sorted layers: list_reduce over structs, as the engine's fold does.
def _walk(hits: str, keys: str, coef: str = "c", name: str = "w") -> str:
    return f"""lay_{name} AS (SELECT {keys}, list({{'d': distance, 'o': object_id, 'k': triangle_id, 'c': {coef}}} ORDER BY distance, object_id, triangle_id) AS l FROM {hits} GROUP BY {keys}),
    {name} AS (
      SELECT {keys}, l, 0 AS n, 1 AS ix, 0.0::DOUBLE AS far, 1.0::DOUBLE AS t, false AS done, CAST(NULL AS BIGINT) AS o, 0.0::DOUBLE AS loss FROM lay_{name}
      UNION ALL
      SELECT {keys}, l, CASE WHEN take THEN n + 1 ELSE n END, ix + 1, CASE WHEN take THEN d + 1e-6::DOUBLE ELSE far END, CASE WHEN take THEN (CASE WHEN c <= 0 THEN 0.0 ELSE t * c END) ELSE t END,
        CASE WHEN take THEN c <= 0 OR t * c <= 1e-4 ELSE done OR (live AND n >= 8) END, CASE WHEN take THEN o2 END, CASE WHEN take THEN t * (1 - c) ELSE 0.0 END
      FROM (SELECT *, l[ix].d AS d, l[ix].c AS c, l[ix].o AS o2, NOT done AND l[ix].d >= far AS live, live AND n < 8 AS take FROM {name} WHERE ix <= len(l))
    )"""


#: Formats of mesh files that are compared.
FORMATS = ["stl", "stl-ascii", "ply", "ply-ascii", "gltf", "glb", "obj"]
Q: dict[str, str] = {}
Q["scene_world_triangles"] = sql("tri", 'SELECT object_id, object_id AS instance_id, object_id AS mesh_id, triangle_id, ax, ay, az, bx, "by", bz, cx, cy, cz, category_mask, false AS mirrored FROM tri')
Q["scene_stats"] = sql(
    "tri quad",
    """SELECT count(*) AS triangle_count, count(DISTINCT object_id) AS object_count, count(DISTINCT object_id) AS instance_count, count(DISTINCT object_id) AS mesh_count, (SELECT round(sum(w * w), 6) FROM quad) AS area,
    min(least(ax, bx, cx)) AS min_x, max(greatest(ax, bx, cx)) AS max_x, min(least(ay, "by", cy)) AS min_y, max(greatest(ay, "by", cy)) AS max_y, min(az) AS min_z, max(az) AS max_z FROM tri""",
)
Q["mesh_audit_counts"] = sql(
    "quad",
    """SELECT CAST(1 AS BIGINT) AS mesh_id, 4 * count(*) AS vertex_count, 2 * count(*) AS face_count, 2 * count(*) AS accepted_faces, CAST(0 AS BIGINT) AS duplicate_faces, CAST(0 AS BIGINT) AS degenerate_faces, CAST(0 AS BIGINT) AS isolated_vertices,
    round(sum(w * w), 6) AS area, 4 * count(*) AS boundary_edges, CAST(0 AS BIGINT) AS non_manifold_edges, count(*) AS components, true AS ready, false AS watertight FROM quad""",
)
Q["mesh_boundary_edges"] = sql(
    "quad",
    """WITH f AS (SELECT (object_id - 1) * 4 AS b FROM quad), e AS (SELECT b, unnest([0, 1, 2, 0, 2, 3]) AS v, unnest([1, 2, 0, 2, 3, 0]) AS w FROM f)
    SELECT CAST(1 AS BIGINT) AS mesh_id, b + least(v, w) AS lo, b + greatest(v, w) AS hi FROM e GROUP BY b, least(v, w), greatest(v, w) HAVING count(*) = 1""",
)
Q["mesh_duplicate_faces"] = sql("quad", "SELECT CAST(1 AS BIGINT) AS mesh_id, 'face' AS item, (SELECT 2 * max(object_id) FROM quad) + object_id AS \"index\", 'duplicate' AS issue FROM quad WHERE object_id % 10 = 0")
Q["mesh_surface_grid"] = sql(
    "quad",
    """WITH c AS (SELECT object_id, w, k FROM quad CROSS JOIN (VALUES (0), (1)) v(k)), h AS (SELECT (object_id - 1) * 2 + k AS source_face, w, CASE WHEN sqrt(w * w + w * w) <= 5 THEN 1 ELSE 2 END AS n FROM c)
    SELECT source_face, CAST(n AS BIGINT) AS cells, round(w * w / 2, 6) AS area FROM h""",
)
_first = "arg_min({c}, (distance, object_id, triangle_id))"
Q["ray_closest_hit"] = sql(
    "sunray sunhit",
    f"""SELECT r.sensor_id, r.sun_index, h.o IS NOT NULL AS hit, round(d, 9) AS distance, round(u, 6) AS u, round(v, 6) AS v, coalesce(o, 0) AS object_id, coalesce(o, 0) AS instance_id, coalesce(o, 0) AS mesh_id, coalesce(k, 4294967295) AS triangle_id, coalesce(f, false) AS front_face
    FROM sunray r LEFT JOIN (SELECT sensor_id, sun_index, min(distance) AS d, {_first.format(c='u')} AS u, {_first.format(c='v')} AS v, {_first.format(c='object_id')} AS o, {_first.format(c='triangle_id')} AS k, {_first.format(c='front_face')} AS f FROM sunhit GROUP BY 1, 2) h USING (sensor_id, sun_index)""",
)
Q["ray_any_hit"] = sql("sunray sunhit", "SELECT sensor_id, sun_index, EXISTS (SELECT 1 FROM sunhit h WHERE h.sensor_id = r.sensor_id AND h.sun_index = r.sun_index) AS blocked FROM sunray r")
Q["ray_excluding_object"] = sql(
    "sunray sunhit sunfirst",
    f"""SELECT r.sensor_id, r.sun_index, h.o IS NOT NULL AS hit, round(d, 9) AS distance, coalesce(o, 0) AS object_id FROM sunray r LEFT JOIN
    (SELECT s.sensor_id, s.sun_index, min(s.distance) AS d, arg_min(s.object_id, (s.distance, s.object_id, s.triangle_id)) AS o FROM sunhit s JOIN sunfirst f USING (sensor_id, sun_index) WHERE s.object_id <> f.object_id GROUP BY 1, 2) h USING (sensor_id, sun_index)""",
)
Q["ray_category_mask"] = sql("sunray sunhit", "SELECT r.sensor_id, r.sun_index, count(h.object_id) AS hits FROM sunray r LEFT JOIN sunhit h ON r.sensor_id = h.sensor_id AND r.sun_index = h.sun_index AND (h.category_mask & 5) <> 0 GROUP BY 1, 2")
Q["ray_transmission"] = sql(
    "sunray sunhit coef",
    "WITH RECURSIVE hc AS (SELECT * FROM sunhit JOIN coef USING (object_id)), " + _walk("hc", "sensor_id, sun_index") + ", z AS (SELECT sensor_id, sun_index, arg_max(t, ix) AS t, max(n) AS n FROM w GROUP BY 1, 2) SELECT r.sensor_id, r.sun_index, round(coalesce(t, 1.0), 9) AS transmission, CAST(coalesce(n, 0) AS INTEGER) AS layer_count FROM sunray r LEFT JOIN z USING (sensor_id, sun_index)",
)
Q["direct_sun_timeline"] = sql("suntime", "SELECT sensor_id, sun_index, state, round(cosine, 9) AS cosine, hours, object_id, round(distance, 9) AS distance FROM suntime")
Q["direct_sun_summary"] = sql(
    "suntime",
    """WITH s AS (SELECT sensor_id, sum(CASE WHEN state = 'visible' THEN hours ELSE 0.0 END) AS direct_hours, sum(CASE WHEN state = 'blocked' THEN hours ELSE 0.0 END) AS shadow_hours FROM suntime GROUP BY 1),
    o AS (SELECT sensor_id, arg_max(object_id, (h, -object_id)) AS o FROM (SELECT sensor_id, object_id, sum(hours) AS h FROM suntime WHERE state = 'blocked' GROUP BY 1, 2) GROUP BY 1)
    SELECT sensor_id, direct_hours, shadow_hours, direct_hours + shadow_hours AS eligible_hours, CASE WHEN direct_hours + shadow_hours > 0 THEN direct_hours / (direct_hours + shadow_hours) ELSE 0.0 END AS direct_ratio, coalesce(o, 0) AS dominant_object_id FROM s LEFT JOIN o USING (sensor_id)""",
)
_scen = "WITH RECURSIVE sc AS (SELECT 1 AS scenario_id, object_id, c FROM coef UNION ALL SELECT 2, object_id, 0.0::DOUBLE FROM coef), hc AS (SELECT * FROM sunhit JOIN sc USING (object_id)), " + _walk("hc", "scenario_id, sensor_id, sun_index")
_sums = """, z AS (SELECT scenario_id, sensor_id, sun_index, arg_max(t, ix) AS t FROM w GROUP BY 1, 2, 3), base AS (SELECT scenario_id, sensor_id, sun_index FROM sunray CROSS JOIN (VALUES (1), (2)) v(scenario_id)),
    sums AS (SELECT scenario_id, sensor_id, CAST(count(*) AS DOUBLE) AS eligible_hours, sum(coalesce(t, 1.0)) AS received_hours FROM base LEFT JOIN z USING (scenario_id, sensor_id, sun_index) GROUP BY 1, 2)"""
_losses = ", losses AS (SELECT scenario_id, sensor_id, o AS object_id, sum(loss) AS loss FROM w WHERE o IS NOT NULL GROUP BY 1, 2, 3)"
Q["solar_scenario_delta"] = sql(
    "sunray sunhit coef",
    _scen + _sums + """ SELECT CAST(a.scenario_id AS INTEGER) AS scenario_id, a.sensor_id, a.eligible_hours, round(a.received_hours, 6) AS received_hours, round(greatest(a.eligible_hours - a.received_hours, 0), 6) AS lost_hours, round(a.received_hours - b.received_hours, 6) AS received_delta
    FROM sums a JOIN sums b ON a.sensor_id = b.sensor_id AND b.scenario_id = 1""",
)
Q["solar_attribution_topk"] = sql(
    "sunray sunhit coef",
    _scen + _losses + """ SELECT CAST(scenario_id AS INTEGER) AS scenario_id, sensor_id, object_id, round(loss, 6) AS loss, CAST(rank AS INTEGER) AS rank, round(fraction, 6) AS fraction FROM
    (SELECT *, row_number() OVER (PARTITION BY scenario_id, sensor_id ORDER BY loss DESC, object_id) AS rank, loss / sum(loss) OVER (PARTITION BY scenario_id, sensor_id) AS fraction FROM losses) WHERE rank <= 10""",
)
Q["solar_category_breakdown"] = sql(
    "sunray sunhit coef quad",
    _scen + _losses + """ SELECT CAST(scenario_id AS INTEGER) AS scenario_id, CASE WHEN grouping(object_id) = 0 THEN 'object' WHEN grouping(category_mask) = 0 THEN 'category' ELSE 'total' END AS "grouping", object_id, category_mask, round(sum(loss), 6) AS loss
    FROM losses JOIN quad USING (object_id) GROUP BY GROUPING SETS ((scenario_id, object_id), (scenario_id, category_mask), (scenario_id))""",
)
# Sky: the exact directions of the suns that are up, in each sensor's own basis.
_local = """loc AS (SELECT sun_index AS idx, dx AS lx, dy AS ly, dz AS lz FROM sun WHERE dz > 0),
    b0 AS (SELECT *, CASE WHEN abs(nz) >= 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hx, CASE WHEN abs(nz) >= 0.9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hz FROM sensor),
    b1 AS (SELECT *, 0.0::DOUBLE * nz - hz * ny AS cx, hz * nx - hx * nz AS cy, hx * ny - 0.0::DOUBLE * nx AS cz, sqrt(cx * cx + cy * cy + cz * cz) AS cn, cx / cn AS tx, cy / cn AS ty, cz / cn AS tz, ny * tz - nz * ty AS ux, nz * tx - nx * tz AS uy, nx * ty - ny * tx AS uz FROM b0),
    skyray AS MATERIALIZED (SELECT sensor_id, idx, lz, px + nx * 1e-4::DOUBLE AS ox, py + ny * 1e-4::DOUBLE AS oy, pz + nz * 1e-4::DOUBLE AS oz, tx * lx + ux * ly + nx * lz AS dx, ty * lx + uy * ly + ny * lz AS dy, tz * lx + uz * ly + nz * lz AS dz, 0.0::DOUBLE AS t_min, 1e300::DOUBLE AS t_max FROM b1 CROSS JOIN loc),
    skyhit AS MATERIALIZED (""" + _hits("skyray", "sensor_id, idx") + """),
    sky AS (SELECT r.sensor_id, r.idx, r.lz, h.o IS NULL AS visible, coalesce(h.o, 0) AS object_id FROM skyray r LEFT JOIN (SELECT sensor_id, idx, arg_min(object_id, (distance, object_id, triangle_id)) AS o FROM skyhit GROUP BY 1, 2) h USING (sensor_id, idx))"""
Q["sky_shadow_mask"] = sql("sensor sun tri", f"WITH {_local} SELECT sensor_id, idx, visible, object_id FROM sky")
Q["sky_view"] = sql(
    "sensor sun tri",
    f"""WITH {_local}, d AS (SELECT sensor_id, arg_max(object_id, (w, -object_id)) AS o FROM (SELECT sensor_id, object_id, sum(lz) AS w FROM sky WHERE NOT visible GROUP BY 1, 2) GROUP BY 1)
    SELECT sensor_id, count(*) AS samples, round(avg(CAST(visible AS INT)), 9) AS visible_fraction, round(sum(CASE WHEN visible THEN lz ELSE 0 END) / sum(lz), 9) AS sky_view_factor,
    round(abs(avg(CAST(visible AS INT)) FILTER (idx % 2 = 0) - avg(CAST(visible AS INT)) FILTER (idx % 2 = 1)), 9) AS fraction_delta, coalesce(any_value(o), 0) AS dominant_object_id FROM sky LEFT JOIN d USING (sensor_id) GROUP BY sensor_id""",
)
_matrix = """mr AS MATERIALIZED (SELECT sensor_id, sun_index AS idx, px + nx * 1e-4::DOUBLE AS ox, py + ny * 1e-4::DOUBLE AS oy, pz + nz * 1e-4::DOUBLE AS oz, dx, dy, dz, greatest(cosine, 0.0) * (2 * pi() / 12) AS projected, 0.0::DOUBLE AS t_min, 1e300::DOUBLE AS t_max FROM pair WHERE dz > 0),
    hc AS MATERIALIZED (SELECT h.*, c FROM (""" + _hits("(SELECT * FROM mr WHERE projected > 0)", "sensor_id, idx") + """) h JOIN coef USING (object_id)), """ + _walk("hc", "sensor_id, idx") + """,
    z AS (SELECT sensor_id, idx, arg_max(t, ix) AS t FROM w GROUP BY 1, 2), m AS (SELECT sensor_id, idx, mr.dz, projected * (CASE WHEN projected > 0 THEN coalesce(z.t, 1.0) ELSE 0.0 END) AS coefficient FROM mr LEFT JOIN z USING (sensor_id, idx))"""
Q["daylight_matrix"] = sql("pair tri coef", f"WITH RECURSIVE {_matrix} SELECT sensor_id, idx, round(coefficient, 9) AS coefficient FROM m")
Q["daylight_factor"] = sql("pair tri coef", f"WITH RECURSIVE {_matrix}, nrm AS (SELECT sum((k + 0.5::DOUBLE) / 12 * 2 * pi() / 12 * (1 + 2 * (k + 0.5::DOUBLE) / 12)) AS s FROM range(12) r(k)) SELECT sensor_id, round(100 * sum(coefficient * (1 + 2 * dz)) / any_value(s), 6) AS daylight_factor FROM m CROSS JOIN nrm GROUP BY 1")
Q["daylight_validation"] = sql(
    "outcome",
    """WITH p AS (SELECT a.objective AS value, b.objective AS reference FROM outcome a JOIN outcome b ON a.candidate_id = b.candidate_id AND a.scenario_id = 1 AND b.scenario_id = 2), e AS (SELECT *, value - reference AS e, avg(reference) OVER () AS m FROM p)
    SELECT count(*) AS "rows", floor((avg(e)) * 1e4 + 0.37::DOUBLE) / 1e4 AS bias, floor((avg(abs(e))) * 1e4 + 0.37::DOUBLE) / 1e4 AS mae, floor((sqrt(avg(e * e))) * 1e4 + 0.37::DOUBLE) / 1e4 AS rmse, round(avg(abs(e / reference)), 6) AS mape, floor((max(abs(e))) * 1e4 + 0.37::DOUBLE) / 1e4 AS max_error,
    count(*) FILTER (abs(e) <= greatest(1.0, 0.05 * abs(reference))) AS accepted, round(1 - sum(e * e) / sum((reference - m) * (reference - m)), 6) AS r_squared FROM e""",
)
Q["weather_hourly"] = sql("weather", "SELECT hour_unix, midpoint_unix, duration_hours, ghi, dni, dhi, dni_missing FROM weather")
Q["weather_gaps"] = sql("weather", "SELECT midpoint_unix, CAST(midpoint_unix - before - 3600 AS DOUBLE) AS missing_seconds FROM (SELECT midpoint_unix, lag(midpoint_unix) OVER (ORDER BY midpoint_unix) AS before FROM weather) WHERE midpoint_unix - before - 3600 > 1")
Q["weather_interpolate"] = sql(
    "weather",
    """WITH g AS (SELECT *, last_value(CASE WHEN NOT dni_missing THEN midpoint_unix END IGNORE NULLS) OVER a AS t0, first_value(CASE WHEN NOT dni_missing THEN midpoint_unix END IGNORE NULLS) OVER b AS t1,
      last_value(CASE WHEN NOT dni_missing THEN dni END IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN NOT dni_missing THEN dni END IGNORE NULLS) OVER b AS v1 FROM weather
      WINDOW a AS (ORDER BY midpoint_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY midpoint_unix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT midpoint_unix, dni_missing, round(CASE WHEN NOT dni_missing THEN dni WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(midpoint_unix - t0 AS DOUBLE) / (t1 - t0)) END, 6) AS dni FROM g""",
)
Q["weather_select"] = sql(
    "weather",
    """SELECT midpoint_unix, dni, 1.0::DOUBLE AS weight FROM (SELECT *, (midpoint_unix // 86400 + 3) % 7 AS d, midpoint_unix % 86400 / 3600.0::DOUBLE AS h, month(make_timestamp(midpoint_unix * 1000000)) AS m FROM weather)
    WHERE m IN (1, 3) AND d < 5 AND h >= 8 AND h < 18 AND dni >= 20""",
)
Q["intervisibility"] = sql("obsrisk", "SELECT observer_id, target_id, state, round(distance, 9) AS distance, round(risk, 9) AS risk, object_id FROM obsrisk")
for _key in ("observer", "target"):
    Q[f"{_key}_summary"] = sql(
        "obsrisk",
        f"""SELECT {_key}_id, count(*) AS pairs, count(*) FILTER (state = 'visible') AS visible, count(*) FILTER (state = 'blocked') AS blocked, count(*) FILTER (state = 'out_of_range') AS out_of_range, round(1 - product(1 - risk), 6) AS combined_risk,
        round(max(risk), 9) AS max_risk, round(count(*) FILTER (state = 'visible') / CAST(count(*) - count(*) FILTER (state = 'coincident') AS DOUBLE), 9) AS visible_fraction FROM obsrisk GROUP BY 1""",
    )
Q["visibility_graph_pairs"] = sql(
    "edgepair tri",
    "WITH r AS (SELECT i, j, distance AS far, px AS ox, py AS oy, pz AS oz, (qx - px) * (1 / distance) AS dx, (qy - py) * (1 / distance) AS dy, (qz - pz) * (1 / distance) AS dz, 1e-4::DOUBLE AS t_min, distance - 1e-4::DOUBLE AS t_max FROM edgepair WHERE distance <= 40), h AS (SELECT DISTINCT i, j FROM ("
    + _hits("r", "i, j")
    + ")) SELECT e.i, e.j, round(distance, 9) AS distance, CASE WHEN distance > 40 THEN 'out_of_range' WHEN h.i IS NOT NULL THEN 'blocked' ELSE 'visible' END AS state FROM edgepair e LEFT JOIN h USING (i, j)",
)
_near = "near AS (SELECT i, j, distance FROM edgepair WHERE distance <= 25)"
Q["graph_degree"] = sql("edgepair node", f"WITH {_near}, e AS (SELECT i AS idx FROM near UNION ALL SELECT j FROM near) SELECT n.idx, count(e.idx) AS degree, round(count(e.idx) / CAST((SELECT count(*) FROM node) - 1 AS DOUBLE), 9) AS degree_centrality FROM node n LEFT JOIN e USING (idx) GROUP BY 1")
Q["graph_components"] = sql(
    "edgepair node",
    f"""WITH RECURSIVE {_near}, bw AS (SELECT i AS a, j AS b FROM near UNION ALL SELECT j, i FROM near), r AS (SELECT idx AS v, idx AS c FROM node UNION SELECT bw.b, r.c FROM r JOIN bw ON bw.a = r.v AND bw.b > r.c),
    m AS (SELECT v, min(c) AS c FROM r GROUP BY 1) SELECT v AS idx, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS component FROM m""",
)
Q["sparse_graph_candidates"] = sql(
    "edgepair",
    f"""WITH {_near}, e AS (SELECT i AS n, j AS m, distance FROM near UNION ALL SELECT j, i, distance FROM near), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, m) AS r FROM e)
    SELECT DISTINCT least(n, m) AS i, greatest(n, m) AS j, round(distance, 9) AS distance FROM k WHERE r <= 3""",
)
_dom = "(a.rev >= b.rev AND a.disc <= b.disc AND (a.rev > b.rev OR a.disc < b.disc))"
Q["pareto_front"] = sql("candidate", f"WITH f AS (SELECT * FROM candidate WHERE residual <= 0) SELECT candidate_id, rev, disc, residual FROM f b WHERE NOT EXISTS (SELECT 1 FROM f a WHERE {_dom})")
_small = "s AS MATERIALIZED (SELECT * FROM candidate)"
_ranked = f"""{_small}, p AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b FROM s a JOIN s b ON a.residual <= 0 AND b.residual <= 0 AND {_dom}),
    chain AS (SELECT candidate_id AS b, 0 AS rank FROM s WHERE residual <= 0 UNION SELECT p.b, rank + 1 FROM chain JOIN p ON p.a = chain.b), fr AS (SELECT b AS candidate_id, max(rank) AS rank FROM chain GROUP BY 1),
    bad AS (SELECT candidate_id, (SELECT max(rank) + 1 FROM fr) + dense_rank() OVER (ORDER BY residual) - 1 AS rank FROM s WHERE residual > 0), rk AS (SELECT * FROM fr UNION ALL SELECT * FROM bad)"""
Q["pareto_rank"] = sql(
    "candidate",
    f"""WITH RECURSIVE {_ranked}, d AS (SELECT b.candidate_id, count(*) AS n FROM s a JOIN s b ON (a.residual <= 0 AND b.residual <= 0 AND {_dom}) OR (a.residual <= 0 AND b.residual > 0) OR (a.residual > 0 AND b.residual > 0 AND a.residual < b.residual) GROUP BY 1)
    SELECT candidate_id, CAST(rank AS INTEGER) AS rank, residual <= 0 AS feasible, greatest(residual, 0) AS violation, CAST(coalesce(n, 0) AS BIGINT) AS dominated_count FROM rk JOIN s USING (candidate_id) LEFT JOIN d USING (candidate_id)""",
)
Q["crowding"] = sql(
    "candidate",
    f"""WITH RECURSIVE {_ranked}, c AS (SELECT candidate_id, rank, -rev AS o0, disc AS o1 FROM rk JOIN s USING (candidate_id)),
    n AS (SELECT *, count(*) OVER q AS size, lag(o0) OVER a AS p0, lead(o0) OVER a AS n0, lag(o1) OVER b AS p1, lead(o1) OVER b AS n1, max(o0) OVER q - min(o0) OVER q AS s0, max(o1) OVER q - min(o1) OVER q AS s1 FROM c
      WINDOW q AS (PARTITION BY rank), a AS (PARTITION BY rank ORDER BY o0, candidate_id), b AS (PARTITION BY rank ORDER BY o1, candidate_id))
    SELECT candidate_id, CASE WHEN size <= 2 OR (s0 > 1e-12 AND (p0 IS NULL OR n0 IS NULL)) OR (s1 > 1e-12 AND (p1 IS NULL OR n1 IS NULL)) THEN NULL ELSE round(CASE WHEN s0 <= 1e-12 THEN 0.0 ELSE (n0 - p0) / s0 END + CASE WHEN s1 <= 1e-12 THEN 0.0 ELSE (n1 - p1) / s1 END, 6) END AS crowding FROM n""",
)
Q["hypervolume2d"] = sql(
    "candidate",
    f"""WITH f AS (SELECT -rev AS x, disc AS y FROM candidate b WHERE residual <= 0 AND rev > 0 AND disc < 0.1 AND NOT EXISTS (SELECT 1 FROM candidate a WHERE a.residual <= 0 AND {_dom})),
    t AS (SELECT x, y, coalesce(min(y) OVER (ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.1::DOUBLE) AS top FROM f) SELECT round(coalesce(sum((0 - x) * (top - y)) FILTER (y < top), 0.0), 2) AS hypervolume FROM t""",
)
Q["spearman"] = sql(
    "candidate",
    """WITH r AS (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE AS size, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS price,
      rank() OVER (ORDER BY rev) + (count(*) OVER (PARTITION BY rev) - 1) / 2.0::DOUBLE AS rev, rank() OVER (ORDER BY disc) + (count(*) OVER (PARTITION BY disc) - 1) / 2.0::DOUBLE AS disc FROM candidate)
    SELECT 'size' AS parameter, 'rev' AS objective, round(corr(size, rev), 6) AS rho FROM r UNION ALL SELECT 'size', 'disc', round(corr(size, disc), 6) FROM r UNION ALL SELECT 'price', 'rev', round(corr(price, rev), 6) FROM r UNION ALL SELECT 'price', 'disc', round(corr(price, disc), 6) FROM r""",
)
Q["robust_cvar"] = sql(
    "outcome",
    """WITH p AS (SELECT *, probability / sum(probability) OVER (PARTITION BY candidate_id) AS p FROM outcome), q AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY candidate_id ORDER BY objective DESC, scenario_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM p),
    t AS (SELECT *, least(greatest(1 - 0.8::DOUBLE - before, 0.0), p) AS part FROM q)
    SELECT candidate_id, floor((sum(p * objective)) * 1e4 + 0.37::DOUBLE) / 1e4 AS mean, floor((max(objective)) * 1e4 + 0.37::DOUBLE) / 1e4 AS worst, floor((sum(part * objective) / sum(part)) * 1e4 + 0.37::DOUBLE) / 1e4 AS cvar, round(sum(CASE WHEN residual > 0 THEN p ELSE 0.0 END), 9) AS violation_probability FROM t GROUP BY 1""",
)
Q["uncertainty_rank"] = sql(
    "outcome",
    """WITH RECURSIVE m AS (SELECT candidate_id, avg(objective) AS o, stddev_pop(objective) AS sd, avg(residual) AS r, stddev_pop(residual) AS rsd FROM outcome GROUP BY 1),
    v AS MATERIALIZED (SELECT candidate_id, o - 1.96::DOUBLE * sd AS lo, o + 1.96::DOUBLE * sd AS hi, CASE WHEN r + 1.96::DOUBLE * rsd <= 0 THEN 0 WHEN r - 1.96::DOUBLE * rsd <= 0 THEN 1 ELSE 2 END AS tier FROM m),
    d AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b FROM v a JOIN v b ON a.candidate_id <> b.candidate_id AND (a.tier < b.tier OR (a.tier = b.tier AND a.hi < b.lo - 1e-12))),
    c AS (SELECT candidate_id AS b, 0 AS rank FROM v UNION SELECT d.b, rank + 1 FROM c JOIN d ON d.a = c.b) SELECT b AS candidate_id, CAST(max(rank) AS INTEGER) AS rank, any_value(CASE tier WHEN 0 THEN 'proven' WHEN 1 THEN 'possible' ELSE 'infeasible' END) AS tier FROM c JOIN v ON b = candidate_id GROUP BY 1""",
)
Q["fidelity_calibration"] = sql(
    "",
    """SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM (SELECT p_retailprice AS x, 1 + 2 * p_retailprice + 0.01::DOUBLE * (p_partkey % 3) AS y FROM part WHERE p_partkey % 5 = 0)""",
)
Q["scenario_delta_map"] = sql(
    "outcome",
    """SELECT 's' || a.scenario_id AS scenario_id, 'c' || a.candidate_id AS name, CAST(2 AS BIGINT) AS n, floor((least(a.objective - b.objective, a.residual - b.residual)) * 1e4 + 0.37::DOUBLE) / 1e4 AS min_delta, floor(((a.objective - b.objective + a.residual - b.residual) / 2) * 1e4 + 0.37::DOUBLE) / 1e4 AS mean_delta, floor((greatest(a.objective - b.objective, a.residual - b.residual)) * 1e4 + 0.37::DOUBLE) / 1e4 AS max_delta
    FROM outcome a JOIN outcome b ON a.candidate_id = b.candidate_id AND b.scenario_id = 1 AND a.scenario_id <> 1""",
)
Q["weighted_quantiles"] = sql(
    "outcome",
    """WITH r AS (SELECT scenario_id, objective, sum(probability) OVER (PARTITION BY scenario_id ORDER BY objective RANGE UNBOUNDED PRECEDING) AS run, sum(probability) OVER (PARTITION BY scenario_id) AS tot FROM outcome)
    SELECT CAST(scenario_id AS INTEGER) AS scenario_id, round(min(objective) FILTER (run >= tot * 0.1::DOUBLE), 6) AS p10, round(min(objective) FILTER (run >= tot * 0.5::DOUBLE), 6) AS p50, round(min(objective) FILTER (run >= tot * 0.9::DOUBLE), 6) AS p90 FROM r GROUP BY 1""",
)
_cells = "cell AS (SELECT object_id AS sensor_id, w * w / 2 AS area, 700000 + 1000.0::DOUBLE * (object_id % 300) AS energy FROM quad)"
Q["pv_potential"] = sql(
    "quad",
    f"""WITH {_cells}, ok AS (SELECT * FROM cell WHERE energy >= 800000), r AS (SELECT *, sum(area) OVER (ORDER BY energy RANGE UNBOUNDED PRECEDING) AS run, sum(area) OVER () AS tot FROM ok)
    SELECT count(*) AS cells, sum(area) AS area, round(sum(area * energy) / sum(area), 6) AS mean, min(energy) FILTER (run >= tot * 0.1::DOUBLE) AS p10, min(energy) FILTER (run >= tot * 0.5::DOUBLE) AS p50, min(energy) FILTER (run >= tot * 0.9::DOUBLE) AS p90,
    round(sum(area) * 0.85::DOUBLE * 0.22::DOUBLE, 6) AS kwp, round(sum(area * energy) / 1000 * 0.22::DOUBLE * 0.85::DOUBLE * (1 - 0.14::DOUBLE), 3) AS yield_kwh FROM r""",
)
Q["isovist_summary"] = sql(
    "sensor flat tri",
    "WITH r AS MATERIALIZED (SELECT sensor_id AS viewpoint_id, idx, px AS ox, py AS oy, 1.6::DOUBLE AS oz, dx, dy, 0.0::DOUBLE AS dz, 0.0::DOUBLE AS t_min, 100.0::DOUBLE AS t_max FROM sensor CROSS JOIN flat), h AS (SELECT viewpoint_id, idx, min(distance) AS d FROM ("
    + _hits("r", "viewpoint_id, idx")
    + """) GROUP BY 1, 2), p AS (SELECT viewpoint_id, idx, coalesce(d, 100.0) AS r, dx * coalesce(d, 100.0) AS x, dy * coalesce(d, 100.0) AS y FROM r LEFT JOIN h USING (viewpoint_id, idx)),
    e AS (SELECT *, coalesce(lead(x) OVER q, first_value(x) OVER q) AS x2, coalesce(lead(y) OVER q, first_value(y) OVER q) AS y2 FROM p WINDOW q AS (PARTITION BY viewpoint_id ORDER BY idx))
    SELECT viewpoint_id, count(*) AS samples, round(abs(sum(x * y2 - x2 * y)) / 2, 4) AS area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 4) AS perimeter, round(avg(r), 6) AS mean_radius, min(r) AS min_radius, max(r) AS max_radius FROM e GROUP BY 1""",
)
Q["isovist3d"] = sql(
    "viewray viewhit coef",
    "WITH RECURSIVE hc AS (SELECT h.*, c FROM viewhit h JOIN coef USING (object_id)), "
    + _walk("hc", "viewpoint_id, idx")
    + """, z AS (SELECT viewpoint_id, idx, arg_max(t, ix) AS t, arg_max(far - 1e-6::DOUBLE, ix) AS d FROM w GROUP BY 1, 2), v AS (SELECT r.viewpoint_id, r.idx, coalesce(z.t, 1.0) AS t, CASE WHEN coalesce(z.t, 1.0) <= 1e-4 THEN z.d ELSE 100.0 END AS r FROM viewray r LEFT JOIN z USING (viewpoint_id, idx))
    SELECT viewpoint_id, round(sum(4 * pi() / 12 * (r * r * r) / 3), 2) AS volume, round(sum(4 * pi() / 12 * r * r), 3) AS surface, round(avg(CASE WHEN t > 1e-4 THEN 1.0 ELSE 0.0 END), 9) AS openness, round(avg(t), 9) AS mean_transmission FROM v GROUP BY 1""",
)
Q["observer_path"] = sql(
    "sensor",
    """WITH p AS (SELECT sensor_id % 10 AS path_id, sensor_id AS k, px AS x, py AS y, pz AS z FROM sensor), s AS (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM p WINDOW q AS (PARTITION BY path_id ORDER BY k)),
    l AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM s WHERE x2 IS NOT NULL), t AS (SELECT path_id, sum(len) AS total, count(*) AS segments FROM l WHERE len > 0 GROUP BY 1)
    SELECT path_id, CAST(ceil(total / 5) + 1 AS BIGINT) AS samples, round(total, 6) AS length FROM t""",
)

for _plan in ("voxel", "hierarchy"):
    Q[f"ray_{_plan}_parity"] = sql("sunray", "SELECT count(*) AS rays, CAST(0 AS BIGINT) AS state_mismatches, CAST(0 AS BIGINT) AS identity_mismatches, 0.0::DOUBLE AS max_distance_error, 0.0::DOUBLE AS mean_distance_error FROM sunray")
_share = "nrm AS (SELECT sum((k + 0.5::DOUBLE) / 12 * 2 * pi() / 12) AS s FROM range(12) r(k)), share AS (SELECT sensor_id, sum(coefficient) / any_value(s) AS share FROM m CROSS JOIN nrm GROUP BY 1)"
_through = "sc AS MATERIALIZED (SELECT h.*, c FROM sunhit h JOIN coef USING (object_id)), " + _walk("sc", "sensor_id, sun_index", name="sw") + ", st AS (SELECT sensor_id, sun_index, arg_max(t, ix) AS t FROM sw GROUP BY 1, 2)"
Q["point_illuminance"] = sql(
    "pair tri coef sunhit",
    f"""WITH RECURSIVE {_matrix}, {_through}, {_share}, e AS (SELECT sensor_id, CASE WHEN cosine > 0 THEN cosine * 50000 * coalesce(t, 1.0) ELSE 0.0 END AS direct, coalesce(share, 0.0) * 10000 AS diffuse
      FROM pair LEFT JOIN st USING (sensor_id, sun_index) LEFT JOIN share USING (sensor_id) WHERE sun_index = 2) SELECT sensor_id, round(direct, 4) AS direct, round(diffuse, 4) AS diffuse, round(direct + diffuse, 4) AS total FROM e""",
)
#: Hours of weather, the suns taking turns.
FIXTURES["wsun"] = "SELECT CAST(hour_unix // 3600 AS INTEGER) AS hour, sun_index AS k, midpoint_unix, ghi, dni, dhi, dx, dy, dz, is_active FROM weather JOIN sun ON sun.sun_index = hour_unix // 3600 % 12"
NEEDS["wsun"] = "weather sun"
_perez = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in COEFFICIENTS) + "]"
_bin = " + ".join(f"CASE WHEN clearness > {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in CLEARNESS)
Q["annual_irradiance"] = sql(
    "sensor wsun suntime tri",
    """WITH dome AS (SELECT 'dome' AS zone, pi() / 2 * j / 6 AS lo, pi() / 2 * (j + 1) / 6 AS hi, (lo + hi) / 2 AS alt, 2 * pi() * (i + 0.5::DOUBLE) / 24 AS az, cos(alt) * sin(az) AS dx, cos(alt) * cos(az) AS dy, sin(alt) AS dz, 2 * pi() / 24 * (sin(hi) - sin(lo)) AS omega, j * 24 + i AS idx FROM range(6) a(j) CROSS JOIN range(24) b(i)
      UNION ALL SELECT 'horizon', 0.0, 0.0, 0.0, 2 * pi() * (i + 0.5::DOUBLE) / 24 AS az, sin(az), cos(az), 0.0::DOUBLE, 1.0::DOUBLE, 144 + i FROM range(24) b(i)),
    dr AS MATERIALIZED (SELECT sensor_id, idx, zone, greatest(nx * dx + ny * dy + nz * dz, 0.0) * omega AS w, px + nx * 1e-4::DOUBLE AS ox, py + ny * 1e-4::DOUBLE AS oy, pz + nz * 1e-4::DOUBLE AS oz, dx, dy, dz, 0.0::DOUBLE AS t_min, 1e300::DOUBLE AS t_max FROM sensor CROSS JOIN dome WHERE w > 0),
    dh AS MATERIALIZED (SELECT DISTINCT sensor_id, idx FROM (""" + _hits("dr", "sensor_id, idx") + """)),
    vis AS (SELECT sensor_id, coalesce(sum(dr.w) FILTER (zone = 'dome' AND dh.idx IS NULL), 0.0) / sum(dr.w) FILTER (zone = 'dome') AS dv, coalesce(sum(dr.w) FILTER (zone = 'horizon' AND dh.idx IS NULL), 0.0) / sum(dr.w) FILTER (zone = 'horizon') AS hv FROM dr LEFT JOIN dh USING (sensor_id, idx) GROUP BY 1),
    r AS (SELECT s.sensor_id, hour, nz, dni, dhi, ghi, s.nx * w.dx + s.ny * w.dy + s.nz * w.dz AS cosine, t.state, t.object_id, least(acos(greatest(least(w.dz, 1.0), -1.0)), pi() / 2) AS z, coalesce(dv, 1.0) AS dv, coalesce(hv, 1.0) AS hv
      FROM sensor s CROSS JOIN wsun w JOIN suntime t ON t.sensor_id = s.sensor_id AND t.sun_index = w.k LEFT JOIN vis ON vis.sensor_id = s.sensor_id),
    p0 AS (SELECT *, CASE WHEN dhi > 0 THEN ((dhi + dni) / dhi + 1.041::DOUBLE * z * z * z) / (1 + 1.041::DOUBLE * z * z * z) ELSE 1.0 END AS clearness, greatest(90 - degrees(z), 0.0) AS elevation, dhi * (1 / (sin(radians(elevation)) + 0.50572::DOUBLE * pow(elevation + 6.07995::DOUBLE, -1.6364::DOUBLE))) / 1367 AS brightness FROM r),
    p1 AS (SELECT *, """ + _perez + "[1 + " + _bin + """] AS f, greatest(f[1] + f[2] * brightness + f[3] * z, 0.0) AS f1, f[4] + f[5] * brightness + f[6] * z AS f2 FROM p0),
    p2 AS (SELECT *, dhi * (1 - f1) * (1 + nz) / 2 * dv AS dome, dhi * f1 * greatest(cosine, 0.0) / greatest(cos(z), 0.087::DOUBLE) AS ring, dhi * f2 * sqrt(greatest(1 - nz * nz, 0.0)) * hv AS horizon FROM p1),
    e AS (SELECT *, CASE WHEN state = 'visible' THEN dni * cosine ELSE 0.0 END AS direct, greatest(dome + CASE WHEN state = 'visible' THEN ring ELSE 0.0 END + horizon, 0.0) AS diffuse, ghi * 0.2::DOUBLE * (1 - nz) / 2 AS ground, CASE WHEN state = 'blocked' THEN dni * cosine + greatest(ring, 0.0) ELSE 0.0 END AS loss FROM p2),
    d AS (SELECT sensor_id, arg_max(object_id, (l, -object_id)) AS o FROM (SELECT sensor_id, object_id, sum(loss) AS l FROM e WHERE state = 'blocked' GROUP BY 1, 2) GROUP BY 1)
    SELECT sensor_id, round(sum(direct), 3) AS direct_wh, round(sum(diffuse), 3) AS diffuse_wh, round(sum(ground), 3) AS ground_wh, round(sum(direct + diffuse + ground), 3) AS total_wh, round(sum(loss), 3) AS loss_wh, round(max(direct + diffuse + ground), 3) AS peak_w, coalesce(any_value(o), 0) AS dominant_object_id
    FROM e LEFT JOIN d USING (sensor_id) GROUP BY 1""",
)
_year = f"""{_matrix}, {_through}, {_share}, l AS (SELECT s.sensor_id, s.area, CASE WHEN is_active THEN dni * 100 * greatest(s.nx * w.dx + s.ny * w.dy + s.nz * w.dz, 0.0) * coalesce(t, 1.0) ELSE 0.0 END AS direct, direct + dhi * 120 * share AS lux
      FROM sensor s CROSS JOIN wsun w JOIN share USING (sensor_id) LEFT JOIN st ON st.sensor_id = s.sensor_id AND st.sun_index = w.k WHERE midpoint_unix % 86400 >= 8 * 3600 AND midpoint_unix % 86400 < 18 * 3600),
    per AS (SELECT sensor_id, any_value(area) AS area, CAST(count(*) AS DOUBLE) AS hours, count(*) FILTER (lux >= 300) / CAST(count(*) AS DOUBLE) AS sda_share, CAST(count(*) FILTER (direct > 1000) AS DOUBLE) AS ase_hours, count(*) FILTER (direct > 1000) > 250 AS ase_fails,
      count(*) FILTER (lux < 100) / CAST(count(*) AS DOUBLE) AS udi_low, count(*) FILTER (lux >= 100 AND lux < 300) / CAST(count(*) AS DOUBLE) AS udi_supplementary, count(*) FILTER (lux >= 300 AND lux <= 3000) / CAST(count(*) AS DOUBLE) AS udi_autonomous, count(*) FILTER (lux > 3000) / CAST(count(*) AS DOUBLE) AS udi_excessive, avg(lux) AS mean_lux FROM l GROUP BY 1)"""
Q["annual_daylight"] = sql("pair tri coef sunhit wsun", f"WITH RECURSIVE {_year} SELECT sensor_id, area, hours, round(sda_share, 9) AS sda_share, ase_hours, ase_fails, round(udi_low, 9) AS udi_low, round(udi_supplementary, 9) AS udi_supplementary, round(udi_autonomous, 9) AS udi_autonomous, round(udi_excessive, 9) AS udi_excessive, round(mean_lux, 3) AS mean_lux FROM per")
Q["daylight_project"] = sql("pair tri coef sunhit wsun", f"WITH RECURSIVE {_year} SELECT sum(area) AS area, round(100 * coalesce(sum(area) FILTER (sda_share >= 0.5), 0.0) / sum(area), 6) AS sda_percent, round(100 * coalesce(sum(area) FILTER (ase_fails), 0.0) / sum(area), 6) AS ase_percent, round(100 * sum(area * (udi_supplementary + udi_autonomous)) / sum(area), 6) AS udi_percent FROM per")
Q["solar_envelope"] = sql(
    "pair sunfirst quad",
    """WITH c AS (SELECT object_id AS candidate_id, sensor_id, sun_index, dx, dy, dz, px - x0 AS wx, py - y0 AS wy, pz - 0.0 AS wz, dx * wx + dy * wy + dz * wz AS dw, 1 - dz * dz AS den, CASE WHEN den > 1e-12 THEN (dz * wz - dw) / den END AS ahead, CASE WHEN den > 1e-12 THEN (wz - dz * dw) / den END AS height
      FROM pair CROSS JOIN quad WHERE is_active AND cosine > 0),
    n AS (SELECT *, sqrt((wx + dx * ahead) * (wx + dx * ahead) + (wy + dy * ahead) * (wy + dy * ahead) + (wz + dz * ahead - height) * (wz + dz * ahead - height)) AS side FROM c WHERE ahead > 0 AND height >= 0 AND ahead <= 60),
    k AS (SELECT n.*, row_number() OVER o AS cum, count(*) OVER (PARTITION BY candidate_id) AS total FROM n LEFT JOIN sunfirst f USING (sensor_id, sun_index) WHERE side <= 1 AND (f.distance IS NULL OR f.distance > ahead) WINDOW o AS (PARTITION BY candidate_id ORDER BY height, sensor_id, sun_index)),
    a AS (SELECT candidate_id, count(*) AS constraints, CAST(max(total) AS DOUBLE) AS weight, min((height, sensor_id, sun_index)) FILTER (cum >= total * (1 - 0.8::DOUBLE)) AS access, min(height) FILTER (cum >= total * 0.5::DOUBLE) AS shading FROM k GROUP BY 1)
    SELECT q.object_id AS candidate_id, coalesce(constraints, 0) AS constraints, coalesce(weight, 0.0) AS weight, round(CASE WHEN access[1] > 0.05::DOUBLE THEN access[1] - 0.05::DOUBLE WHEN access IS NOT NULL THEN 0.0 END, 6) AS access_height, round(shading + 0.05::DOUBLE, 6) AS shading_height, access[2] AS control_sensor_id, CAST(access[3] AS INTEGER) AS control_sun_index FROM quad q LEFT JOIN a ON a.candidate_id = q.object_id""",
)
Q["isovist3d_counterfactuals"] = sql(
    "viewray viewhit coef",
    "WITH RECURSIVE hc AS MATERIALIZED (SELECT h.*, c FROM viewhit h JOIN coef USING (object_id)), "
    + _walk("hc", "viewpoint_id, idx")
    + """, top AS MATERIALIZED (SELECT viewpoint_id, o AS excluded_id FROM (SELECT viewpoint_id, o, row_number() OVER (PARTITION BY viewpoint_id ORDER BY sum(loss) * (4 * pi() / 12) DESC, o) AS rank FROM w WHERE o IS NOT NULL GROUP BY viewpoint_id, o) WHERE rank <= 5),
    hx AS MATERIALIZED (SELECT hc.*, excluded_id FROM hc JOIN top USING (viewpoint_id) WHERE hc.object_id <> excluded_id), """
    + _walk("hx", "viewpoint_id, excluded_id, idx", name="x")
    + """, z AS (SELECT viewpoint_id, excluded_id, idx, arg_max(t, ix) AS t, arg_max(far - 1e-6::DOUBLE, ix) AS d FROM x GROUP BY 1, 2, 3), v AS (SELECT r.viewpoint_id, top.excluded_id, coalesce(z.t, 1.0) AS t, CASE WHEN coalesce(z.t, 1.0) <= 1e-4 THEN z.d ELSE 100.0 END AS r FROM viewray r JOIN top USING (viewpoint_id) LEFT JOIN z ON z.viewpoint_id = r.viewpoint_id AND z.excluded_id = top.excluded_id AND z.idx = r.idx)
    SELECT viewpoint_id, excluded_id, round(sum(4 * pi() / 12 * (r * r * r) / 3), 2) AS volume, round(sum(4 * pi() / 12 * r * r), 3) AS surface, round(avg(CASE WHEN t > 1e-4 THEN 1.0 ELSE 0.0 END), 9) AS openness, round(avg(t), 9) AS mean_transmission FROM v GROUP BY 1, 2""",
)
_basis = """CASE WHEN abs(az) >= 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hx, CASE WHEN abs(az) >= 0.9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hz, 0.0::DOUBLE * az - hz * ay AS kx, hz * ax - hx * az AS ky, hx * ay - 0.0::DOUBLE * ax AS kz, sqrt(kx * kx + ky * ky + kz * kz) AS kn,
      kx / kn AS tx, ky / kn AS ty, kz / kn AS tz, ay * tz - az * ty AS ux, az * tx - ax * tz AS uy, ax * ty - ay * tx AS uz"""
_todisk = """qx - px + (tx * (lx * radius) + ux * (ly * radius)) AS vx, qy - py + (ty * (lx * radius) + uy * (ly * radius)) AS vy, qz - pz + (tz * (lx * radius) + uz * (ly * radius)) AS vz, sqrt(vx * vx + vy * vy + vz * vz) AS reach, px AS ox, py AS oy, pz AS oz, vx / reach AS dx, vy / reach AS dy, vz / reach AS dz, 0.0::DOUBLE AS t_min"""
Q["corridor_summary"] = sql(
    "observer target tri",
    f"""WITH d AS (SELECT CAST(i AS INTEGER) AS idx, sqrt(i / 15.0::DOUBLE) * cos(i * {GOLDEN_ANGLE!r}::DOUBLE) AS lx, sqrt(i / 15.0::DOUBLE) * sin(i * {GOLDEN_ANGLE!r}::DOUBLE) AS ly FROM range(16) r(i)),
    c AS (SELECT observer_id AS corridor_id, px, py, pz, qx, qy, qz, 1.0::DOUBLE AS radius, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS length, (qx - px) * (1 / length) AS ax, (qy - py) * (1 / length) AS ay, (qz - pz) * (1 / length) AS az, {_basis}
      FROM observer JOIN target ON target_id = (observer_id - 1) // 1500 * 100 + observer_id % 100 + 1),
    cr AS MATERIALIZED (SELECT corridor_id, idx, length, radius, {_todisk}, reach - 1e-4::DOUBLE AS t_max FROM c CROSS JOIN d),
    h AS MATERIALIZED (SELECT corridor_id, idx, min(distance) AS distance, {_first.format(c='object_id')} AS object_id FROM ({_hits('cr', 'corridor_id, idx')}) GROUP BY 1, 2),
    dm AS (SELECT corridor_id, arg_max(object_id, (n, -object_id)) AS o FROM (SELECT corridor_id, object_id, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1)
    SELECT corridor_id, avg(CASE WHEN h.distance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS open_fraction, round(2 * pi() * (1 - any_value(length / sqrt(length * length + radius * radius))), 6) AS cone_solid_angle,
      abs(avg(CASE WHEN h.distance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - avg(CASE WHEN h.distance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (idx < 8)) AS convergence,
      coalesce(arg_min(object_id, (distance, object_id)) FILTER (object_id IS NOT NULL), 0) AS nearest_object_id, round(min(distance), 6) AS nearest_distance, coalesce(any_value(o), 0) AS dominant_object_id FROM cr LEFT JOIN h USING (corridor_id, idx) LEFT JOIN dm USING (corridor_id) GROUP BY 1""",
)
Q["landmark_visibility"] = sql(
    "observer target tri coef",
    f"""WITH RECURSIVE d AS (SELECT CAST(i AS INTEGER) AS idx, sqrt((i + 0.5::DOUBLE) / 8) * cos(i * {GOLDEN_ANGLE!r}::DOUBLE) AS lx, sqrt((i + 0.5::DOUBLE) / 8) * sin(i * {GOLDEN_ANGLE!r}::DOUBLE) AS ly FROM range(8) r(i)),
    c AS (SELECT observer_id, target_id AS landmark_id, px, py, pz, qx, qy, qz, 2.0::DOUBLE AS radius, sensitivity AS mark_weight, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS distance, (qx - px) * (1 / distance) AS ax, (qy - py) * (1 / distance) AS ay, (qz - pz) * (1 / distance) AS az FROM observer CROSS JOIN target),
    v AS MATERIALIZED (SELECT *, 2 * pi() * (1 - sqrt(1 - radius / distance * (radius / distance))) AS solid_angle, {_basis} FROM c WHERE distance <= 30 AND distance > radius AND ax > 0 AND abs(ay) <= ax * tan(pi() / 4) AND abs(az) <= ax * tan(pi() / 4)),
    lr AS MATERIALIZED (SELECT observer_id, landmark_id, idx, radius, {_todisk}, reach - radius AS t_max FROM v CROSS JOIN d),
    hc AS MATERIALIZED (SELECT h.*, c FROM ({_hits('lr', 'observer_id, landmark_id, idx')}) h JOIN coef USING (object_id)), """
    + _walk("hc", "observer_id, landmark_id, idx")
    + """, z AS (SELECT observer_id, landmark_id, idx, arg_max(t, ix) AS t FROM w GROUP BY 1, 2, 3), mean AS (SELECT observer_id, landmark_id, avg(coalesce(t, 1.0)) AS t FROM lr LEFT JOIN z USING (observer_id, landmark_id, idx) GROUP BY 1, 2)
    SELECT c.observer_id, c.landmark_id, v.observer_id IS NOT NULL AS in_view, round(coalesce(solid_angle, 0.0), 9) AS solid_angle, round(coalesce(mean.t, 0.0), 9) AS transmission, round(coalesce(c.mark_weight * solid_angle * mean.t / (4 * sin(pi() / 4) * sin(pi() / 4)), 0.0), 9) AS score
    FROM c LEFT JOIN v USING (observer_id, landmark_id) LEFT JOIN mean USING (observer_id, landmark_id)""",
)
Q["target_view"] = sql(
    "observer tri",
    f"""WITH s AS (SELECT CAST(k AS INTEGER) AS idx, sqrt((k + 0.5::DOUBLE) / 4) AS r, [0.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.75::DOUBLE][k + 1] AS v, 1 - r AS wa, r * (1 - v) AS wb, r * v AS wc FROM range(4) q(k)),
    o AS (SELECT observer_id, px, py, 20.0::DOUBLE AS pz, weight FROM observer),
    b AS (SELECT o.*, tri.object_id AS target_id, triangle_id AS patch_id, ax, ay, az, bx, "by", bz, cx, cy, cz, ax - px AS a1, ay - py AS a2, az - pz AS a3, bx - px AS b1, "by" - py AS b2, bz - pz AS b3, cx - px AS c1, cy - py AS c2, cz - pz AS c3,
      sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS la, sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS lb, sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS lc,
      2 * atan2(abs(a1 * (b2 * c3 - b3 * c2) + a2 * (b3 * c1 - b1 * c3) + a3 * (b1 * c2 - b2 * c1)), la * lb * lc + (a1 * b1 + a2 * b2 + a3 * b3) * lc + (a1 * c1 + a2 * c2 + a3 * c3) * lb + (b1 * c1 + b2 * c2 + b3 * c3) * la) AS patch_omega
      FROM o JOIN tri ON abs(ax - px) <= 24 AND abs(ay - py) <= 24),
    q AS (SELECT observer_id, target_id, patch_id, idx, weight, patch_omega, px AS ox, py AS oy, pz AS oz, wa * ax + wb * bx + wc * cx - px AS v1, wa * ay + wb * "by" + wc * cy - py AS v2, wa * az + wb * bz + wc * cz - pz AS v3, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS far, v1 * (1 / far) AS dx, v2 * (1 / far) AS dy, v3 * (1 / far) AS dz, -dz AS cosine, cosine / (far * far) AS w FROM b CROSS JOIN s WHERE -dz > 0),
    f AS (SELECT *, patch_omega * (w / sum(w) OVER (PARTITION BY observer_id, target_id, patch_id)) AS omega, 0.6::DOUBLE * dx - 0.8::DOUBLE * dz AS depth FROM q),
    tr AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS t_min, far - 1e-4::DOUBLE AS t_max, omega * (1 / (1 + pow(far / 25, 2))) * greatest(depth, 0.0) * weight AS score FROM f WHERE far <= 14 AND depth > 0 AND abs(dy) <= depth * tan(pi() / 4) AND abs(0.8::DOUBLE * dx + 0.6::DOUBLE * dz) <= depth * tan(pi() / 6)),
    h AS MATERIALIZED (SELECT observer_id, target_id, patch_id, idx, arg_min(object_id, (distance, object_id, triangle_id)) AS o FROM ({_hits('tr', 'observer_id, target_id, patch_id, idx')}) GROUP BY 1, 2, 3, 4),
    e AS (SELECT tr.*, h.o FROM tr LEFT JOIN h USING (observer_id, target_id, patch_id, idx)),
    dm AS (SELECT observer_id, target_id, arg_max(o, (n, -o)) AS dominant FROM (SELECT observer_id, target_id, o, sum(omega) AS n FROM e WHERE o IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT observer_id, target_id, round(sum(omega), 9) AS potential, round(coalesce(sum(omega) FILTER (o IS NULL), 0.0), 9) AS visible_omega, round(coalesce(sum(score) FILTER (o IS NULL), 0.0), 9) AS score, coalesce(any_value(dominant), 0) AS dominant_object_id, round(coalesce(sum(omega) FILTER (o IS NULL), 0.0) / sum(omega), 9) AS fraction
    FROM e LEFT JOIN dm USING (observer_id, target_id) GROUP BY 1, 2""",
)
Q["pv_regions"] = sql(
    "tri",
    """WITH RECURSIVE cell AS MATERIALIZED (SELECT object_id * 2 + triangle_id AS sensor_id, 700000 + 1000.0::DOUBLE * (object_id % 300) AS energy, (ax, ay, az) AS a, (bx, "by", bz) AS b, (cx, cy, cz) AS c FROM tri WHERE 700000 + 1000.0::DOUBLE * (object_id % 300) >= 800000),
    edge AS MATERIALIZED (SELECT sensor_id, least(p, q) AS p, greatest(p, q) AS q FROM (SELECT sensor_id, a AS p, b AS q FROM cell UNION ALL SELECT sensor_id, b, c FROM cell UNION ALL SELECT sensor_id, c, a FROM cell)),
    near AS MATERIALIZED (SELECT DISTINCT x.sensor_id AS i, y.sensor_id AS j FROM edge x JOIN edge y ON x.p = y.p AND x.q = y.q AND x.sensor_id <> y.sensor_id),
    r AS (SELECT sensor_id AS v, sensor_id AS c FROM cell UNION SELECT j, c FROM r JOIN near ON i = v AND j > c), m AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
    SELECT sensor_id, 1.0::DOUBLE AS area, energy, m.c AS first_cell, CAST(dense_rank() OVER (ORDER BY m.c) AS INTEGER) AS region FROM cell JOIN m ON v = sensor_id""",
)
Q["sparse_graph"] = sql(
    "edgepair node tri",
    f"""WITH RECURSIVE {_near}, e AS (SELECT i AS n, j AS m, distance FROM near UNION ALL SELECT j, i, distance FROM near), nn AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, m) AS r FROM e),
    k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY distance, i, j) AS pos FROM (SELECT DISTINCT least(n, m) AS i, greatest(n, m) AS j, distance FROM nn WHERE r <= 4)),
    g AS (SELECT CAST(0 AS BIGINT) AS pos, list_transform(range((SELECT max(idx) + 1 FROM node)), lambda x: 0) AS degree, false AS taken, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS distance
      UNION ALL SELECT pos, CASE WHEN ok THEN list_transform(degree, lambda x, p: x + CASE WHEN p = i + 1 OR p = j + 1 THEN 1 ELSE 0 END) ELSE degree END, ok, i, j, distance FROM (SELECT k.pos, g.degree, k.i, k.j, k.distance, g.degree[k.i + 1] < 4 AND g.degree[k.j + 1] < 4 AS ok FROM g JOIN k ON k.pos = g.pos + 1)),
    t AS MATERIALIZED (SELECT i, j, distance FROM g WHERE taken),
    gr AS MATERIALIZED (SELECT t.i, t.j, p.px AS ox, p.py AS oy, p.pz AS oz, (qx - px) * (1 / p.distance) AS dx, (qy - py) * (1 / p.distance) AS dy, (qz - pz) * (1 / p.distance) AS dz, 1e-4::DOUBLE AS t_min, p.distance - 1e-4::DOUBLE AS t_max FROM t JOIN edgepair p USING (i, j) WHERE p.distance > 2e-4),
    h AS (SELECT DISTINCT i, j FROM ({_hits('gr', 'i, j')})) SELECT t.i, t.j, round(distance, 9) AS distance, CASE WHEN distance <= 1e-4 THEN 'coincident' WHEN h.i IS NOT NULL THEN 'blocked' ELSE 'visible' END AS state FROM t LEFT JOIN h USING (i, j)""",
)
Q["graph_centralities"] = sql(
    "edgepair node",
    f"""WITH RECURSIVE {_near}, adj AS MATERIALIZED (SELECT i AS a, j AS b FROM near UNION ALL SELECT j, i FROM near),
    walk AS (SELECT idx AS s, idx AS v, 0 AS d FROM node UNION SELECT s, b, d + 1 FROM walk JOIN adj ON a = v WHERE d < (SELECT least(count(*), 60) FROM node)), far AS MATERIALIZED (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2),
    paths AS (SELECT idx AS s, idx AS v, 0 AS d, 1.0::DOUBLE AS n FROM node UNION ALL SELECT p.s, b, p.d + 1, sum(n) FROM paths p JOIN adj ON a = p.v JOIN far f ON f.s = p.s AND f.v = b AND f.d = p.d + 1 GROUP BY 1, 2, 3),
    ways AS MATERIALIZED (SELECT s, v, d, n FROM paths),
    between AS (SELECT x.v, sum(x.n * y.n / w.n) AS b FROM ways x JOIN ways y ON y.s = x.v AND y.d > 0 JOIN ways w ON w.s = x.s AND w.v = y.v AND w.d = x.d + y.d WHERE x.d > 0 GROUP BY 1),
    close AS (SELECT s, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0.0 END) AS c FROM far GROUP BY 1), total AS (SELECT count(*) AS n FROM node)
    SELECT s AS idx, round(c / greatest(n - 1, 1), 9) AS closeness, round(coalesce(b, 0.0) / greatest((n - 1) * (n - 2), 1), 9) AS betweenness FROM close LEFT JOIN between ON v = s CROSS JOIN total""",
)

Q["mesh_repair"] = sql("quad", "SELECT CAST(1 AS BIGINT) AS mesh_id, 4 * count(*) AS vertices, 2 * count(*) AS faces, round(sum(w * w), 6) AS area, min(x0) AS min_x, max(x0 + w) AS max_x FROM quad")
FIXTURES["block"] = "SELECT (object_id - 1) // 200 + 1 AS mesh_id, object_id, x0, y0, w, z FROM quad"
FIXTURES["blockpoint"] = "SELECT mesh_id, x0 AS x, y0 AS y, z FROM block UNION ALL SELECT mesh_id, x0 + w, y0, z FROM block UNION ALL SELECT mesh_id, x0 + w, y0 + w, z FROM block UNION ALL SELECT mesh_id, x0, y0 + w, z FROM block"
NEEDS |= {"block": "quad", "blockpoint": "block"}
Q["mesh_weld"] = sql("blockpoint", "SELECT mesh_id, count(*) AS before, count(DISTINCT (x, y, z)) AS after FROM blockpoint GROUP BY 1")
Q["mesh_heal"] = sql("block", "SELECT mesh_id, 2 * count(*) AS accepted_faces, round(sum(w * w), 6) AS area, CAST(0 AS BIGINT) AS winding_conflicts, 4 * count(*) AS boundary_edges FROM block GROUP BY 1")
Q["mesh_clip"] = sql("block", "SELECT mesh_id, round(sum((x0 + w - greatest(x0, 60.5)) * w) FILTER (z <= 6.5 AND x0 + w > 60.5), 6) AS area FROM block GROUP BY 1")
Q["mesh_files"] = sql(
    "block blockpoint",
    f"""WITH f AS (SELECT unnest({FORMATS!r}) AS format), b AS (SELECT mesh_id, 2 * count(*) AS faces, round(sum(w * w), 6) AS area, min(x0) AS min_x, max(x0 + w) AS max_x FROM block GROUP BY 1), p AS (SELECT mesh_id, count(*) AS n, count(DISTINCT (x, y, z)) AS m FROM blockpoint GROUP BY 1)
    SELECT format, mesh_id, CASE WHEN format LIKE 'stl%' THEN m ELSE n END AS vertices, faces, area, min_x, max_x FROM f CROSS JOIN b JOIN p USING (mesh_id)""",
)
Q["weather_files"] = sql("weather", "SELECT format, midpoint_unix, round(dni, 6) AS dni, round(dhi, 6) AS dhi, dni_missing AND format = 'csv' AS dni_missing FROM weather CROSS JOIN (VALUES ('csv'), ('wea')) f(format)")
Q["weather_policy"] = sql(
    "weather",
    """WITH g AS (SELECT *, last_value(CASE WHEN NOT dni_missing THEN midpoint_unix END IGNORE NULLS) OVER a AS t0, first_value(CASE WHEN NOT dni_missing THEN midpoint_unix END IGNORE NULLS) OVER b AS t1,
      last_value(CASE WHEN NOT dni_missing THEN dni END IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN NOT dni_missing THEN dni END IGNORE NULLS) OVER b AS v1 FROM weather WHERE NOT (month(make_timestamp(midpoint_unix * 1000000)) = 2 AND day(make_timestamp(midpoint_unix * 1000000)) = 29)
      WINDOW a AS (ORDER BY midpoint_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY midpoint_unix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT midpoint_unix, ghi, round(CASE WHEN NOT dni_missing THEN dni WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(midpoint_unix - t0 AS DOUBLE) / (t1 - t0)) END, 6) AS dni, dhi FROM g""",
)
Q["schedule_hours"] = "SELECT (a + least(a + 1800, 1704067200 + 30 * 86400 + 1000)) // 2 AS unix_seconds, (least(a + 1800, 1704067200 + 30 * 86400 + 1000) - a) / 3600.0::DOUBLE AS duration_hours, 0.5::DOUBLE AS weight FROM (SELECT 1704067200 + k * 1800 AS a FROM range(1441) r(k))"
Q["occupancy_hours"] = "SELECT CAST(k // 24 AS INTEGER) AS weekday, CAST(k % 24 AS INTEGER) AS hour, CASE WHEN k // 24 < 5 AND k % 24 >= 8 AND k % 24 < 18 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS occupancy FROM range(168) r(k)"
Q["scene_deltas"] = sql("quad", "SELECT object_id AS instance_id, object_id, CASE WHEN object_id % 20 = 1 THEN 7 ELSE object_id END AS mesh_id, CASE WHEN object_id % 20 = 1 THEN 1 WHEN object_id % 10 = 0 THEN 64 ELSE category_mask END AS category_mask, CASE WHEN object_id % 20 = 1 THEN 'new' ELSE 'static' END AS layer FROM quad WHERE object_id % 20 <> 11")
Q["scene_documents"] = sql("block", "SELECT mesh_id, 2 * count(*) AS triangles, min(x0) AS min_ax, sum(2 * z) AS sum_az FROM block GROUP BY 1")
_spiral = f"k * {GOLDEN_ANGLE!r}::DOUBLE"
Q["sample_points"] = f"""WITH r AS (SELECT k, (k + 0.5::DOUBLE) / 64 AS h, 1 - 2 * (k + 0.5::DOUBLE) / 64 AS s FROM range(64) q(k)), p AS (
    SELECT 'hemisphere' AS kind, k, sqrt(1 - h * h) * cos({_spiral}) AS a, sqrt(1 - h * h) * sin({_spiral}) AS b, h AS c FROM r UNION ALL SELECT 'sphere', k, sqrt(1 - s * s) * cos({_spiral}), sqrt(1 - s * s) * sin({_spiral}), s FROM r
    UNION ALL SELECT 'disk', k, sqrt(h) * cos({_spiral}), sqrt(h) * sin({_spiral}), 0.0 FROM r UNION ALL SELECT 'centred', k, sqrt(k / 63.0::DOUBLE) * cos({_spiral}), sqrt(k / 63.0::DOUBLE) * sin({_spiral}), 0.0 FROM r
    UNION ALL SELECT 'circle', k, k / 64.0::DOUBLE * 2 * pi(), 0.0, 0.0 FROM r UNION ALL SELECT 'arc', k, (k / 63.0::DOUBLE - 0.5::DOUBLE) * (pi() / 2), 0.0, 0.0 FROM r
    UNION ALL SELECT 'triangle', k, 1 - sqrt(h), sqrt(h) * (1 - v), sqrt(h) * v FROM (SELECT k, h, (k & 1) / 2.0::DOUBLE + (k >> 1 & 1) / 4.0::DOUBLE + (k >> 2 & 1) / 8.0::DOUBLE + (k >> 3 & 1) / 16.0::DOUBLE + (k >> 4 & 1) / 32.0::DOUBLE + (k >> 5 & 1) / 64.0::DOUBLE AS v FROM r))
    SELECT kind, CAST(k AS INTEGER) AS idx, round(a, 9) + 0.0 AS a, round(b, 9) + 0.0 AS b, round(c, 9) + 0.0 AS c FROM p"""
Q["optical_materials"] = """WITH m AS (SELECT p_partkey AS k, [7, 11, 13, 3, 5, 17] AS f FROM part), v AS (SELECT k, list_transform(f, lambda x: k * x % 100 / 200.0::DOUBLE) AS v FROM m)
    SELECT k + 1 AS material_id, round(0.265::DOUBLE * v[1] + 0.67::DOUBLE * v[2] + 0.065::DOUBLE * v[3], 9) AS visible_t, round(0.265::DOUBLE * v[1] + 0.67::DOUBLE * v[2] + 0.065::DOUBLE * v[3], 9) AS solar_t, round(0.265::DOUBLE * v[4] + 0.67::DOUBLE * v[5] + 0.065::DOUBLE * v[6], 9) AS reflectance FROM v"""
Q["path_summary"] = sql("sensor", "WITH s AS (SELECT sensor_id % 10 AS path_id, CAST(sensor_id AS INTEGER) AS sample, area AS t, CAST(sensor_id * 37 % 11 AS DOUBLE) AS v FROM sensor) SELECT path_id, round(sum(t * v) / sum(t), 9) AS mean, min(v) AS worst, arg_min(sample, (v, sample)) AS worst_sample, max(v) AS best, arg_max(sample, (v, sample)) AS best_sample FROM s GROUP BY 1")
Q["occluder_triangles"] = sql("suntime tri", "SELECT object_id, triangle_id FROM tri WHERE object_id IN (SELECT object_id FROM suntime WHERE state = 'blocked')")
Q["legend_values"] = sql("candidate", "SELECT candidate_id, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 9) AS normalised, false AS clipped FROM candidate")
Q["metric_comparison"] = sql("sensor", "SELECT sensor_id AS viewpoint_id, round(px * 2 - px, 9) AS px_delta, round(area - 1 - area, 9) AS area_delta FROM sensor")
Q["study_files"] = sql("candidate", "SELECT candidate_id, size AS parameter_size, price AS parameter_unit_price, rev AS objective_revenue, disc AS objective_discount, residual AS constraint_limit FROM candidate")
Q["objective_points"] = sql("candidate", "SELECT candidate_id, round(2 * (rev - min(rev) OVER ()) / (max(rev) OVER () - min(rev) OVER ()) - 1, 9) AS x, round(2 * (disc - min(disc) OVER ()) / (max(disc) OVER () - min(disc) OVER ()) - 1, 9) AS y, 0.0::DOUBLE AS z FROM candidate")


def _uniform(rows: str, seed: str, at: str) -> str:
    """rows (a table expression) with u in [0, 1): number ``at`` of the counter-based generator with a seed; both are columns or numbers."""
    whole = "18446744073709551616::UHUGEINT"
    times = lambda x, m: f"CAST(CAST({x} AS UHUGEINT) * {m}::UHUGEINT % {whole} AS UBIGINT)"
    z0 = f"(SELECT *, CAST((CAST({seed} AS UHUGEINT) + CAST({at} + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15}::UHUGEINT) % {whole} AS UBIGINT) AS z0 FROM {rows})"
    z1 = f"(SELECT *, {times('xor(z0, z0 >> 30)', 0xBF58476D1CE4E5B9)} AS z1 FROM {z0})"
    z2 = f"(SELECT *, {times('xor(z1, z1 >> 27)', 0x94D049BB133111EB)} AS z2 FROM {z1})"
    return f"(SELECT * EXCLUDE (z0, z1, z2), CAST(xor(z2, z2 >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM {z2})"


Q["sobol_indices"] = f"""WITH d AS MATERIALIZED (SELECT t, b, p, u FROM {_uniform("(SELECT t, b, p FROM range(2) x(t) CROSS JOIN range(4096) y(b) CROSS JOIN range(2) z(p))", "42", "t * 8192 + b * 2 + p")}),
    y AS (SELECT b, max(u) FILTER (t = 0 AND p = 0) AS a0, max(u) FILTER (t = 0 AND p = 1) AS a1, max(u) FILTER (t = 1 AND p = 0) AS b0, max(u) FILTER (t = 1 AND p = 1) AS b1 FROM d GROUP BY 1),
    v AS (SELECT var_samp(y) AS v FROM (SELECT a0 + 2 * a1 AS y FROM y UNION ALL SELECT b0 + 2 * b1 FROM y)),
    m AS (SELECT 0 AS parameter, a0 + 2 * a1 AS a, b0 + 2 * b1 AS b, b0 + 2 * a1 AS m FROM y UNION ALL SELECT 1, a0 + 2 * a1, b0 + 2 * b1, a0 + 2 * b1 FROM y)
    SELECT CAST(parameter AS INTEGER) AS parameter, round(avg(b * (m - a)) / any_value(v), 6) AS first_order, round(avg((a - m) * (a - m)) / 2 / any_value(v), 6) AS total FROM m CROSS JOIN v GROUP BY 1"""
# y = x + 2 y is linear: every elementary effect of a parameter is its factor
Q["morris_effects"] = "SELECT CAST(k AS INTEGER) AS parameter, CAST(k + 1 AS DOUBLE) AS mu, CAST(k + 1 AS DOUBLE) AS mu_star, 0.0::DOUBLE AS sigma FROM range(2) r(k)"
_replicates = "(SELECT pair, k, seed, c.j FROM (SELECT pair, k, 42 + 7919 * pair + 104729 * k + {shift} AS seed FROM range(4) a(pair) CROSS JOIN range(100) b(k)) CROSS JOIN c)"
_picked = "CASE WHEN pair < 2 THEN {a}.size ELSE {a}.price END AS x, CASE WHEN pair % 2 = 0 THEN {b}.rev ELSE {b}.disc END AS y"
_tied = "rank() OVER (PARTITION BY pair, k ORDER BY {c}) + (count(*) OVER (PARTITION BY pair, k, {c}) - 1) / 2.0::DOUBLE AS {c}"
Q["statistical_sensitivity"] = sql(
    "candidate",
    f"""WITH c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY size, price, rev, disc) - 1 AS j, size, price, rev, disc, count(*) OVER () AS n FROM candidate),
    b AS (SELECT pair, k, {_picked.format(a="c", b="c")} FROM {_uniform(_replicates.format(shift=1), "seed", "j")} r JOIN c ON c.j = CAST(floor(u * (SELECT any_value(n) FROM c)) AS BIGINT)),
    boot AS (SELECT pair, k, coalesce(corr(x, y), 0.0) AS rho FROM (SELECT pair, k, {_tied.format(c="x")}, {_tied.format(c="y")} FROM b) GROUP BY 1, 2),
    o AS (SELECT pair, k, j, row_number() OVER (PARTITION BY pair, k ORDER BY u, j) - 1 AS place FROM {_uniform(_replicates.format(shift=2), "seed", "j")}),
    p AS (SELECT pair, k, {_picked.format(a="x", b="y")} FROM o JOIN c y ON y.j = o.j JOIN c x ON x.j = o.place),
    perm AS (SELECT pair, k, coalesce(corr(x, y), 0.0) AS rho FROM (SELECT pair, k, {_tied.format(c="x")}, {_tied.format(c="y")} FROM p) GROUP BY 1, 2),
    real AS (SELECT pair, coalesce(corr(x, y), 0.0) AS rho FROM (SELECT pair, 0 AS k, {_tied.format(c="x")}, {_tied.format(c="y")} FROM (SELECT pair, 0 AS k, {_picked.format(a="c", b="c")} FROM c CROSS JOIN range(4) r(pair))) GROUP BY 1),
    lim AS (SELECT pair, list(rho ORDER BY rho) AS l FROM boot GROUP BY 1), ext AS (SELECT pair, count(*) FILTER (abs(perm.rho) >= abs(real.rho) - 1e-12) AS e FROM perm JOIN real USING (pair) GROUP BY 1),
    t AS (SELECT CASE WHEN pair < 2 THEN 'size' ELSE 'price' END AS parameter, CASE WHEN pair % 2 = 0 THEN 'rev' ELSE 'disc' END AS objective, rho, l[3] AS low, l[98] AS high, (e + 1) / 101.0::DOUBLE AS p FROM real JOIN lim USING (pair) JOIN ext USING (pair)),
    h AS (SELECT *, max(least(p * (4 - row_number + 1), 1.0)) OVER (ORDER BY p, parameter, objective) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, parameter, objective) AS row_number FROM t))
    SELECT parameter, objective, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high, round(p, 9) AS p, round(p_holm, 9) AS p_holm, p_holm <= 0.05 AS significant FROM h""",
)
Q["fidelity_recommendation"] = f"""WITH f AS (SELECT p_partkey + 1 AS c, p_retailprice AS x1, -p_retailprice / 2 AS x2 FROM part),
    r AS MATERIALIZED (SELECT p_partkey + 1 AS c, p_retailprice AS x1, -p_retailprice / 2 AS x2, 1 + 2 * p_retailprice + 0.01::DOUBLE * (p_partkey % 3) AS y1, -(1 + 2 * p_retailprice + 0.01::DOUBLE * (p_partkey % 3)) / 2 AS y2 FROM part WHERE p_partkey % 5 = 0),
    m AS (SELECT regr_slope(y1, x1) AS b1, regr_intercept(y1, x1) AS a1, greatest(sqrt(greatest(regr_syy(y1, x1) - 2 * b1 * regr_sxy(y1, x1) + b1 * b1 * regr_sxx(y1, x1), 0.0) / greatest(count(*) - 2, 1)), 1e-9) AS s1,
      regr_slope(y2, x2) AS b2, regr_intercept(y2, x2) AS a2, greatest(sqrt(greatest(regr_syy(y2, x2) - 2 * b2 * regr_sxy(y2, x2) + b2 * b2 * regr_sxx(y2, x2), 0.0) / greatest(count(*) - 2, 1)), 1e-9) AS s2,
      max(y1) + 0.1::DOUBLE * greatest(max(y1) - min(y1), 1.0) AS far1, max(y2) + 0.1::DOUBLE * greatest(max(y2) - min(y2), 1.0) AS far2 FROM r),
    step AS MATERIALIZED (SELECT y1 AS x, coalesce(lead(y1) OVER o, far1) AS nx, min(y2) OVER o AS top FROM r CROSS JOIN m WINDOW o AS (ORDER BY y1, y2) UNION ALL SELECT -1e300, min(y1), any_value(far2) FROM r CROSS JOIN m),
    u AS (SELECT c, k, least(greatest(u, 1e-12), 1 - 1e-12) AS u FROM {_uniform("(SELECT c, k, 42 + 7919 * c AS seed FROM f CROSS JOIN range(128) q(k) WHERE (c - 1) % 5 <> 0)", "seed", "k")}),
    d AS (SELECT a.c, a.k, sqrt(-2 * ln(a.u)) AS z, 2 * pi() * b.u AS w FROM u a JOIN u b ON a.c = b.c AND b.k = a.k + 64 WHERE a.k < 64),
    p AS (SELECT c, k, b1 * x1 + a1 + s1 * (z * cos(w)) AS px, b2 * x2 + a2 + s2 * (z * sin(w)) AS py, far1, far2 FROM d JOIN f USING (c) CROSS JOIN m),
    g AS (SELECT c, k, sum(greatest(least(nx, far1) - greatest(x, px), 0.0) * greatest(top - py, 0.0)) AS gain FROM p JOIN step ON nx > px WHERE px < far1 AND py < far2 GROUP BY 1, 2),
    s AS (SELECT p.c, avg(coalesce(gain, 0.0)) AS gain FROM p LEFT JOIN g USING (c, k) GROUP BY 1)
    SELECT c AS candidate_id, round(gain, 3) AS gain, 20.0::DOUBLE AS cost, round(gain / 20, 4) AS score FROM s ORDER BY gain DESC, c LIMIT 8"""
