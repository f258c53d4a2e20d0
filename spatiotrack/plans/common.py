"""SQL text shared bz the DuckDB statements: the derived telemetry and layout, written out in SQL."""

from __future__ import annotations

from ..sources.fixtures import SUBZONES, ZONES

TRUTH = """
ev AS (SELECT event_id, user_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS tick FROM events),
tr AS (SELECT event_id, user_id AS device, tick, 200 + (user_id*131 + tick*17) % 1600 AS true_x, 200 + (user_id*71 + tick*11) % 1000 AS true_y, CAST(user_id % 3 AS INTEGER) AS true_floor FROM ev)"""

RECEIVERS = """
rec AS (SELECT CAST(r // 4 AS INTEGER) AS floor_seq, 'f' || (r // 4) AS floor, CAST(r AS INTEGER) AS rec_seq, 'rx' || r AS scanner,
  CAST(200 + (r % 2) * 1600 AS DOUBLE) AS x, CAST(200 + ((r % 4) // 2) * 1000 AS DOUBLE) AS y,
  CASE WHEN r % 3 = 0 THEN 2.2e0 END AS height, 0.9e0 + 0.02e0 * r AS correction, 40e0 AS scale FROM range(12) AS t(r))"""

#: The same receivers, one for each supplier.
SUPPLIED = RECEIVERS.replace("0.02e0 * r AS correction", "0.02e0 * (r % 12) AS correction").replace("FROM range(12) AS t(r)", "FROM (SELECT s_suppkey AS r FROM supplier)")

# Six rooms a floor, in two rows, with integer wobble; on every third floor the second row is shifted, so that its corners lie on walls.
ROOMS6 = """rm AS (SELECT p_partkey // 6 AS f, p_partkey % 6 AS seq, p_partkey AS k, (p_partkey % 6) % 3 AS cx, (p_partkey % 6) // 3 AS cy FROM part),
vx AS (SELECT f, seq, k, i, seq * 4 + i AS v, CAST(cx * 204 + CASE WHEN f % 3 = 0 THEN cy * 100 ELSE 0 END + CASE WHEN i IN (1, 2) THEN 200 ELSE 0 END + (k * (7 + i * 5)) % 9 - 4 AS DOUBLE) AS x,
  CAST(cy * 154 + CASE WHEN i IN (2, 3) THEN 150 ELSE 0 END + (k * (11 + i * 3)) % 7 - 3 AS DOUBLE) AS y FROM rm, range(4) AS t(i))"""

#: Their walls, in the form of the fixture's edges.
ROOM_EDGES = (
    ROOMS6
    + """,
red AS (SELECT CAST(a.f AS INTEGER) AS floor_seq, CAST(a.seq AS INTEGER) AS zone_seq, 'room' || a.k AS zone, a.k % 11 = 5 AS no_go, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM vx a JOIN vx b ON a.k = b.k AND b.i = (a.i + 1) % 4)"""
)

STATES = (
    TRUTH
    + ","
    + RECEIVERS
    + """,
raw AS (SELECT tr.event_id, tr.tick, tr.device, rec.rec_seq,
  CAST(round(sqrt(((x - true_x) * (x - true_x) + (y - true_y) * (y - true_y)) / 1600e0
    + (3 * (floor_seq - true_floor) + coalesce(height, 1e0) - 1e0) * (3 * (floor_seq - true_floor) + coalesce(height, 1e0) - 1e0))
    * (1 + 0.3e0 * abs(floor_seq - true_floor)) * (1 + ((event_id * 7919 + rec_seq * 104729) % 201 - 100) / 1000e0)
    / correction / (CASE WHEN rec_seq % 4 = 3 THEN 0.3048e0 ELSE 1e0 END) * 1000) AS BIGINT) AS milli
  FROM tr, rec WHERE (event_id + rec_seq * 7) % 5 <> 0),
st AS (SELECT event_id, tick, 'sensor.dev' || device || '_distance_to_rx' || rec_seq AS entity_id,
  CASE WHEN event_id % 97 = 0 THEN 'unknown' WHEN event_id % 101 = 0 THEN 'unavailable'
    ELSE (milli // 1000) || '.' || lpad(CAST(milli % 1000 AS VARCHAR), 3, '0') END AS state,
  CASE WHEN rec_seq % 4 = 3 THEN 'ft' ELSE 'm' END AS unit FROM raw)"""
)

READINGS = (
    STATES
    + """,
par AS (SELECT event_id, tick, regexp_replace(split_part(entity_id, '_distance_to_', 1), '^sensor\\.', '') AS device, split_part(entity_id, '_distance_to_', 2) AS scanner,
  try_cast(state AS DOUBLE) * (CASE WHEN unit = 'ft' THEN 0.3048e0 ELSE 1e0 END) AS metres FROM st),
sl AS (SELECT par.*, floor_seq, floor, rec_seq, x, y, height, correction, scale, metres * correction AS slant FROM par JOIN rec USING (scanner) WHERE metres IS NOT NULL),
rd AS (SELECT *, CASE WHEN height BETWEEN 0 AND 10 THEN sqrt(greatest(slant * slant - (height - 1e0) * (height - 1e0), 0e0)) ELSE slant END AS horizontal FROM sl),
rr AS (SELECT *, scale * horizontal AS r FROM rd)"""
)

WEIGHTED = (
    READINGS
    + """,
cy AS (SELECT *, dense_rank() OVER (PARTITION BY device ORDER BY tick) AS cycle FROM rr),
pv AS (SELECT *, max(r) OVER (PARTITION BY device, floor_seq, x, y ORDER BY cycle RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS previous_r FROM cy),
wt AS (SELECT *, CASE WHEN previous_r IS NULL THEN 1e0 ELSE 1 / (1 + pow((greatest(greatest(r, 20e0) / greatest(previous_r, 20e0), greatest(previous_r, 20e0) / greatest(r, 20e0)) - 1) / 0.5e0, 2)) END AS w FROM pv)"""
)

RECORDING = (
    TRUTH
    + """,
rc AS (SELECT 'dev' || device AS ent, event_id, tick, CAST(tick AS DOUBLE) AS updated,
  CAST(true_x + (event_id * 37) % 401 - 200 AS DOUBLE) AS x, CAST(true_y + (event_id * 53) % 301 - 150 AS DOUBLE) AS y,
  CAST(true_x + (event_id * 41) % 601 - 300 AS DOUBLE) AS raw_x, CAST(true_y + (event_id * 59) % 501 - 250 AS DOUBLE) AS raw_y,
  CAST(CASE WHEN event_id % 29 = 0 THEN (true_floor + 1) % 3 ELSE true_floor END AS INTEGER) AS floor_seq,
  'f' || CAST(CASE WHEN event_id % 29 = 0 THEN (true_floor + 1) % 3 ELSE true_floor END AS INTEGER) AS floor,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN true_x < 900 THEN 'west' ELSE 'east' END AS zone,
  (event_id % 50) / 10e0 AS rms_m, (event_id * 13 % 100) / 100e0 AS conf, CAST(true_x AS DOUBLE) AS true_x, CAST(true_y AS DOUBLE) AS true_y FROM tr)"""
)


def _walk(text: str, drawn: bool) -> list[tuple[float, float]]:
    """Vertices in walking order; corners stored row by row by their angle around the middle."""
    points = [tuple(map(float, p.split())) for p in text.split(",")]
    if drawn or len(points) != 4:
        return points
    a, b, c, d = points
    return [a, b, d, c]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def _edges() -> list[tuple]:
    out = []
    for floor, seq, name, text, drawn, no_go in ZONES:
        ring = _walk(text, drawn)
        out += [(floor, seq, name, no_go, i, *ring[i], *ring[(i + 1) % len(ring)]) for i in range(len(ring))]
    return out


def _sub_edges() -> list[tuple]:
    out = []
    for floor, seq, name, text, parent in SUBZONES:
        ring = _walk(text, True)
        out += [(floor, seq, name, parent, i, *ring[i], *ring[(i + 1) % len(ring)]) for i in range(len(ring))]
    return out


EDGES = f"zed AS (SELECT * FROM (VALUES {_values(_edges())}) AS t(floor_seq, zone_seq, zone, no_go, i, ax, ay, bx, bz))"
SUB_EDGES = f"sed AS (SELECT * FROM (VALUES {_values(_sub_edges())}) AS t(floor_seq, sub_seq, sub_zone, parent, i, ax, ay, bx, bz))"

_T = "greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay))))"


def point_zones(points: str, edges: str = "zed", keys: str = "zone_seq, zone, no_go") -> str:
    """CTE pz: each point (id, floor_seq, px, py) against each ring of its floor: odd crossings, distance to the boundary, buffer."""
    return f"""
pe AS (SELECT p.id, p.px, p.py, e.* FROM {points} p JOIN {edges} e USING (floor_seq)),
pz AS (SELECT id, px, py, floor_seq, {keys},
  sum(CASE WHEN (ay > py) <> (bz > py) AND px < (bx - ax) * (py - ay) / (CASE WHEN bz = ay THEN 1e0 ELSE bz - ay END) + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd,
  min(sqrt((px - (ax + {_T} * (bx - ax))) * (px - (ax + {_T} * (bx - ax))) + (py - (ay + {_T} * (bz - ay))) * (py - (ay + {_T} * (bz - ay))))) AS d,
  0.05e0 * (max(ax) - min(ax) + max(ay) - min(ay)) / 2 AS buffer
  FROM pe GROUP BY ALL)"""


def sql(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


def solved(problems: str, name: str = "so", steps: int = 300) -> str:
    """CTE: the bounded weighted fix of each row of ``problems``, by damped Gauss-Newton steps written out for four receivers.

    problems: id, r0..r3 and w0..w3 (null where a receiver is missing), sx, sy (start), x0, y0, x1, y1
    (bounds). Receivers stand at the four corners of the fixture's floors. Result: id, fx, fy, num, den.
    """
    at = [(f"{200 + (i % 2) * 1600}e0", f"{200 + (i // 2) * 1000}e0") for i in range(4)]
    add = lambda part: "(" + " + ".join(part(i, *at[i]) for i in range(4)) + ")"
    d = lambda px, py, x, y: f"sqrt(({px} - {x}) * ({px} - {x}) + ({py} - {y}) * ({py} - {y}))"
    cost = lambda px, py: add(lambda i, x, y: f"v{i} * ({d(px, py, x, y)} - q{i}) * ({d(px, py, x, y)} - q{i})")
    gone = ", ".join(f"CASE WHEN r{i} IS NULL THEN 0e0 ELSE greatest(w{i}, 1e-12) / (greatest(r{i}, 20e0) * greatest(r{i}, 20e0)) END AS v{i}, coalesce(r{i}, 0e0) AS q{i}, CASE WHEN r{i} IS NULL THEN 0e0 ELSE w{i} END AS m{i}" for i in range(4))
    state = ", ".join(["id", *[f"v{i}, q{i}, m{i}" for i in range(4)], "x0", "y0", "x1", "y1"])
    unit = ", ".join(f"greatest({d('px', 'py', x, y)}, 1e-12) AS d{i}" for i, (x, y) in enumerate(at))
    ux, uy = (lambda i, x, y: f"(px - {x}) / d{i}"), (lambda i, x, y: f"(py - {y}) / d{i}")
    clip = lambda v, lo, hi: f"least(greatest({v}, {lo}), {hi})"
    return f"""
{name}_i AS (SELECT id, {gone}, x0, y0, x1, y1, {clip("sx", "x0", "x1")} AS px, {clip("sy", "y0", "y1")} AS py FROM {problems}),
{name}_r AS (
  SELECT {state}, px, py, 1e-3 AS damping, {cost("px", "py")} AS now, 0 AS k FROM {name}_i
  UNION ALL
  SELECT {state}, CASE WHEN then_cost <= now THEN tx ELSE px END, CASE WHEN then_cost <= now THEN ty ELSE py END,
    CASE WHEN then_cost <= now THEN greatest(damping / 5, 1e-12) ELSE least(damping * 6, 1e8) END, least(now, then_cost), k + 1
  FROM (SELECT *, {cost("tx", "ty")} AS then_cost
    FROM (SELECT *, {clip("px - (c2 * hx - b2 * hy) / det", "x0", "x1")} AS tx, {clip("py - (a2 * hy - b2 * hx) / det", "y0", "y1")} AS ty
      FROM (SELECT *, greatest(a2 * c2 - b2 * b2, 1e-300) AS det
        FROM (SELECT *, a + damping * (a + c) + 1e-300 AS a2, c + damping * (a + c) + 1e-300 AS c2, CASE WHEN held_x OR held_y THEN 0e0 ELSE b END AS b2,
            CASE WHEN held_x THEN 0e0 ELSE gx END AS hx, CASE WHEN held_y THEN 0e0 ELSE gy END AS hy
          FROM (SELECT *, (px <= x0 AND gx > 0) OR (px >= x1 AND gx < 0) AS held_x, (py <= y0 AND gy > 0) OR (py >= y1 AND gy < 0) AS held_y
            FROM (SELECT *, {add(lambda i, x, y: f"v{i} * {ux(i, x, y)} * (d{i} - q{i})")} AS gx, {add(lambda i, x, y: f"v{i} * {uy(i, x, y)} * (d{i} - q{i})")} AS gy,
                {add(lambda i, x, y: f"v{i} * {ux(i, x, y)} * {ux(i, x, y)}")} AS a, {add(lambda i, x, y: f"v{i} * {ux(i, x, y)} * {uy(i, x, y)}")} AS b, {add(lambda i, x, y: f"v{i} * {uy(i, x, y)} * {uy(i, x, y)}")} AS c
              FROM (SELECT *, {unit} FROM {name}_r WHERE k < {steps}))))))
  )
),
{name} AS (SELECT id, px AS fx, py AS fy, {add(lambda i, x, y: f"m{i} * ({d('px', 'py', x, y)} - q{i}) * ({d('px', 'py', x, y)} - q{i})")} AS num, m0 + m1 + m2 + m3 AS den FROM {name}_r WHERE k = {steps})"""
