"""SQL (DuckDB's dialect) for the catalogue's queries, over the same Parquet tables."""

from __future__ import annotations

from .catalogue import CENTRE_EPS, CENTRE_SAMPLES, CROSS_RADII, EPS, HASHES, LEVELS, MERGE_KM, MERGE_SAMPLES, MIN_SAMPLES, RADII, RADIUS_M, SCALE

R2 = "(2 * 6371008.8::DOUBLE)"


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    half = lambda a, b: f"sin(radians({b} - {a}) / 2::DOUBLE)"
    return f"{R2} * asin(sqrt(least(1::DOUBLE, {half(lat1, lat2)} * {half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)} * {half(lon1, lon2)})))"


PINGS = """
pings AS (
  SELECT event_id, user_id AS plate_num, ts AS published_at, value AS speed, CAST(ts AS DATE) AS day,
    103.40::DOUBLE + 1.15::DOUBLE * ((user_id * 37 % 150)::DOUBLE / 150::DOUBLE) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.00004::DOUBLE AS lon,
    30.10::DOUBLE + 1.10::DOUBLE * ((user_id * 53 % 150)::DOUBLE / 150::DOUBLE) + (CAST(round(value * 100) AS BIGINT) % 100) * 0.00004::DOUBLE AS lat
  FROM events)"""
NODES = """
nodes AS (
  SELECT CAST(s_suppkey AS BIGINT) AS node_id, CAST(s_nationkey AS BIGINT) AS region_key, CAST(s_acctbal AS DOUBLE) AS weight,
    103.40::DOUBLE + 1.15::DOUBLE * ((s_suppkey * 37 % 150)::DOUBLE / 150::DOUBLE) + 0.002::DOUBLE AS lon,
    30.10::DOUBLE + 1.10::DOUBLE * ((s_suppkey * 53 % 150)::DOUBLE / 150::DOUBLE) + 0.002::DOUBLE AS lat
  FROM supplier)"""
FOUND = f"""
near AS (
  SELECT event_id, min({{'d': d, 'n': node_id}}) AS best
  FROM (SELECT event_id, node_id, {_haversine("p.lon", "p.lat", "n.lon", "n.lat")} AS d
        FROM pings p JOIN nodes n ON abs(p.lat - n.lat) < 0.01 AND abs(p.lon - n.lon) < 0.02)
  WHERE d <= {RADIUS_M} GROUP BY event_id),
found AS (SELECT p.*, best.n AS node_id, best.d AS dist_m FROM pings p LEFT JOIN near USING (event_id))"""
COUNTS = """
counts AS (SELECT day, node_id, count(*) AS cnt FROM found WHERE node_id IS NOT NULL GROUP BY ALL)"""
PRIZES = """
dense AS (
  SELECT d.day, n.node_id, coalesce(c.cnt, 0) AS cnt
  FROM (SELECT DISTINCT day FROM pings) d CROSS JOIN nodes n LEFT JOIN counts c ON c.day = d.day AND c.node_id = n.node_id),
prizes AS (
  SELECT day, node_id, cnt, CASE WHEN max(cnt) OVER (PARTITION BY day) > 0 THEN cnt::DOUBLE / max(cnt) OVER (PARTITION BY day) ELSE 0 END AS prize FROM dense)"""
MISSES = """
misses AS (
  SELECT day, sum(CASE WHEN node_id % 2 = 0 THEN 0 ELSE prize END) AS missed, sum(CASE WHEN node_id % 2 = 0 THEN prize ELSE 0 END) AS collected,
    sum(prize) AS total, 1 - max(CASE WHEN node_id % 2 = 0 THEN NULL ELSE prize END) AS room, count(*) FILTER (node_id % 2 <> 0) AS unvisited
  FROM prizes GROUP BY day)"""
XY = """
xy AS (
  SELECT *, (lon - 104.0665::DOUBLE) * 111.32::DOUBLE * cos(radians(30.6570::DOUBLE)) AS x, (lat - 30.6570::DOUBLE) * 110.57::DOUBLE AS y FROM nodes)"""
ROUTES = """
turns AS (SELECT *, ntile(4) OVER w AS vehicle, row_number() OVER w AS turn FROM xy WINDOW w AS (ORDER BY round(atan2(y, x), 9), node_id)),
routes AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY turn) AS pos FROM turns)"""


def _costs(source: str, name: str = "costs") -> str:
    return f"""
{name}_legs AS (
  SELECT *, coalesce(lag(x) OVER v, 0) AS px, coalesce(lag(y) OVER v, 0) AS py, lead(pos) OVER v IS NULL AS last FROM {source} WINDOW v AS (PARTITION BY vehicle ORDER BY pos)),
{name} AS (
  SELECT vehicle, count(*) AS stops, sum(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + CASE WHEN last THEN sqrt(x * x + y * y) ELSE 0 END) * 100 AS cost
  FROM {name}_legs GROUP BY vehicle)"""


REALIZED = (
    MISSES
    + ","
    + XY
    + ","
    + ROUTES
    + ","
    + "\neven AS (SELECT * FROM routes WHERE node_id % 2 = 0),"
    + _costs("even")
    + f""",
realized AS (
  SELECT day, missed, (SELECT coalesce(sum(cost), 0) FROM costs) + {SCALE} * missed AS cost, CASE WHEN total > 0 THEN collected / total ELSE 1 END * 100 AS coverage_pct FROM misses)"""
)
BASE = ",".join((PINGS, NODES, FOUND, COUNTS, PRIZES))


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


def _dbscan(points: str, eps: float, k: int, name: str = "db") -> str:
    """CTEs ``{name}`` (event_id, is_core, label) over ``points`` (event_id, lon, lat)."""
    return f"""
{name}_cell AS (SELECT event_id, lon, lat, CAST(floor(lon / {eps}::DOUBLE) AS BIGINT) AS cx, CAST(floor(lat / {eps}::DOUBLE) AS BIGINT) AS cy FROM {points}),
{name}_pair AS (
  SELECT a.event_id AS a, b.event_id AS b
  FROM {name}_cell a, (SELECT unnest([-1, 0, 1]) AS dx) sx, (SELECT unnest([-1, 0, 1]) AS dy) sy, {name}_cell b
  WHERE b.cx = a.cx + dx AND b.cy = a.cy + dy
    AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {eps}::DOUBLE * {eps}::DOUBLE),
{name}_core AS (SELECT a AS event_id FROM {name}_pair GROUP BY a HAVING count(*) >= {k}),
{name}_edge AS (SELECT a, b FROM {name}_pair WHERE a IN (FROM {name}_core) AND b IN (FROM {name}_core)),
{name}_walk AS (
  SELECT event_id AS node, event_id AS reach FROM {name}_core
  UNION SELECT w.node, e.b FROM {name}_walk w JOIN {name}_edge e ON w.reach = e.a),
{name}_label AS (SELECT node AS event_id, min(reach) AS label FROM {name}_walk GROUP BY node),
{name}_border AS (
  SELECT p.a AS event_id, min(l.label) AS label FROM {name}_pair p JOIN {name}_label l ON l.event_id = p.b GROUP BY p.a),
{name} AS (
  SELECT c.event_id, l.label IS NOT NULL AS is_core, coalesce(l.label, b.label, -1) + 1 AS label
  FROM {points} c LEFT JOIN {name}_label l USING (event_id) LEFT JOIN {name}_border b USING (event_id))"""


def _per_day_clusters() -> str:
    e, k = CENTRE_EPS, CENTRE_SAMPLES
    return f"""
day_pair AS (
  SELECT a.day, a.event_id AS a, b.event_id AS b FROM pings a JOIN pings b USING (day)
  WHERE (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {e}::DOUBLE * {e}::DOUBLE),
day_core AS (SELECT day, a FROM day_pair GROUP BY ALL HAVING count(*) >= {k}),
day_walk AS (
  SELECT a AS node, a AS reach FROM day_core
  UNION SELECT w.node, p.b FROM day_walk w JOIN day_pair p ON w.reach = p.a AND p.b IN (SELECT a FROM day_core)),
day_label AS (SELECT node AS event_id, min(reach) AS root FROM day_walk GROUP BY node),
centres AS (
  SELECT day, root, root + 1 AS label, avg(lon) AS lon, avg(lat) AS lat, count(*) AS sampled_count
  FROM pings JOIN day_label USING (event_id) GROUP BY day, root),
spots AS (
  SELECT *, date_diff('day', DATE '2000-01-01', day) * 1000000000000 + label AS id FROM centres),
mid AS (SELECT avg(lat) AS m FROM spots),
local AS (
  SELECT id AS event_id, lon * 111.32::DOUBLE * cos(radians(m)) AS lon, (lat - m) * 110.57::DOUBLE + m * 110.57::DOUBLE AS lat FROM spots, mid)"""


def _shifts() -> list[float]:
    from patrolkit.operators.cluster import shifts

    return shifts(HASHES, 0.001)


def _hashed(any_bucket: bool) -> str:
    etas = ", ".join(f"({j}, {e!r}::DOUBLE)" for j, e in enumerate(_shifts()))
    counting = "bucket" if any_bucket else "(SELECT event_id, 0 AS j, floor(lon / 0.002::DOUBLE) AS cx, floor(lat / 0.002::DOUBLE) AS cy FROM pings)"
    label = "coalesce(w.label, CASE WHEN c.event_id IS NOT NULL THEN p.event_id END)" if any_bucket else "w.label"
    return f"""
eta(j, e) AS (VALUES {etas}),
bucket AS (SELECT event_id, j, floor((lon + e) / 0.002::DOUBLE) AS cx, floor((lat + e) / 0.002::DOUBLE) AS cy FROM pings, eta),
counting AS (SELECT * FROM {counting}),
core AS (SELECT DISTINCT event_id FROM counting JOIN (SELECT j, cx, cy FROM counting GROUP BY ALL HAVING count(*) >= 10) USING (j, cx, cy)),
lead_ AS (SELECT j, cx, cy, min(event_id) AS lead FROM bucket JOIN core USING (event_id) GROUP BY ALL),
star AS (SELECT DISTINCT event_id AS a, lead AS b FROM bucket JOIN core USING (event_id) JOIN lead_ USING (j, cx, cy) WHERE event_id <> lead),
border AS (
  SELECT event_id AS a, arg_min(lead, j) AS b FROM bucket JOIN lead_ USING (j, cx, cy) WHERE event_id NOT IN (FROM core) GROUP BY event_id),
edge AS (SELECT a, b FROM star UNION SELECT b, a FROM star UNION SELECT a, b FROM border UNION SELECT b, a FROM border),
walk AS (
  SELECT a AS node, a AS label FROM edge UNION SELECT e.b, w.label FROM walk w JOIN edge e ON e.a = w.node AND w.label < e.b),
labels AS (SELECT node AS event_id, min(label) AS label FROM walk GROUP BY node)
SELECT p.event_id, c.event_id IS NOT NULL AS is_core, CAST(coalesce({label} + 1, 0) AS BIGINT) AS label
FROM pings p LEFT JOIN core c ON c.event_id = p.event_id LEFT JOIN labels w ON w.event_id = p.event_id"""


SELECTIONS = """
picked AS (
  SELECT 'every 2' AS selection, node_id FROM nodes WHERE node_id % 2 = 0 UNION ALL SELECT 'every 3', node_id FROM nodes WHERE node_id % 3 = 0
  UNION ALL SELECT 'every 5', node_id FROM nodes WHERE node_id % 5 = 0 UNION ALL SELECT 'all', node_id FROM nodes),
names(selection) AS (VALUES ('every 2'), ('every 3'), ('every 5'), ('all'), ('none')),
open_ones AS (
  SELECT s.selection, p.day, p.prize, 1 - p.prize AS room FROM names s CROSS JOIN prizes p LEFT JOIN picked k ON k.selection = s.selection AND k.node_id = p.node_id WHERE k.node_id IS NULL),
each_day AS (SELECT selection, day, sum(prize) AS missed, count(*) AS m FROM open_ones GROUP BY ALL),
stats AS (SELECT selection, avg(missed) AS mean_missed, max(m) AS m FROM each_day GROUP BY selection)"""
#: For each number k of filled rooms: their sum and sum of squares, the next room, and how many rooms are left.
ROOMS = """
sorted AS (SELECT selection, day, room, row_number() OVER v AS i, count(*) OVER (PARTITION BY selection, day) AS m, sum(room) OVER w AS upto, sum(room * room) OVER w AS squares
  FROM open_ones WINDOW v AS (PARTITION BY selection, day ORDER BY room), w AS (PARTITION BY selection, day ORDER BY room ROWS UNBOUNDED PRECEDING)),
filled AS (
  SELECT selection, day, i - 1 AS k, m, m - i + 1 AS rest, upto - room AS s1, squares - room * room AS s2, room AS next FROM sorted
  UNION ALL SELECT selection, day, m, m, 0, upto, squares, 9e9 FROM sorted WHERE i = m)"""


def _dual(radii: tuple[float, ...]) -> str:
    """CTEs up to ``dual`` (selection, epsilon, value): the least of the convex dual, by bisection on its slope."""
    return f"""
radius AS (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in radii)}]) AS epsilon),
halve AS (
  SELECT selection, epsilon, 0 AS turn, 0::DOUBLE AS low, sqrt(m::DOUBLE) AS high FROM stats, radius
  UNION ALL
  SELECT selection, epsilon, turn + 1, CASE WHEN epsilon < g THEN mid ELSE low END, CASE WHEN epsilon < g THEN high ELSE mid END
  FROM (
    SELECT selection, epsilon, turn, any_value(low) AS low, any_value(high) AS high, any_value(mid) AS mid, avg(sqrt(n2)) AS g
    FROM (
      SELECT h.selection, h.epsilon, h.turn, h.low, h.high, (h.low + h.high) / 2 AS mid, f.day,
        arg_min(f.s2 + CASE WHEN f.rest > 0 THEN f.rest * f.s2 / ((h.low + h.high) * (h.low + h.high) / 4 - f.rest) ELSE 0 END, f.k) AS n2
      FROM halve h JOIN filled f ON f.selection = h.selection
      WHERE h.turn < 44 AND (f.rest = 0 OR ((h.low + h.high) * (h.low + h.high) / 4 > f.rest AND sqrt(f.s2 / ((h.low + h.high) * (h.low + h.high) / 4 - f.rest)) <= f.next + 1e-12))
      GROUP BY ALL) GROUP BY selection, epsilon, turn)),
ends AS (SELECT selection, epsilon, unnest([0::DOUBLE, low, high, sqrt(m::DOUBLE)]) AS s, m FROM halve JOIN stats USING (selection) WHERE turn = 44),
per_day AS (
  SELECT e.selection, e.epsilon, e.s, f.day, any_value(e.m) AS m,
    arg_min(f.s1 + CASE WHEN f.rest > 0 THEN f.rest * sqrt(f.s2 / (e.s * e.s - f.rest)) ELSE 0 END, f.k) AS d1,
    arg_min(f.s2 + CASE WHEN f.rest > 0 THEN f.rest * f.s2 / (e.s * e.s - f.rest) ELSE 0 END, f.k) AS d2
  FROM ends e JOIN filled f ON f.selection = e.selection
  WHERE f.rest = 0 OR (e.s * e.s > f.rest AND sqrt(f.s2 / (e.s * e.s - f.rest)) <= f.next + 1e-12) GROUP BY e.selection, e.epsilon, e.s, f.day),
at_s AS (
  SELECT selection, epsilon, s, epsilon * s + avg(missed + CASE WHEN s * s >= p.m - 1e-12 THEN 0 ELSE greatest(0, d1 - s * sqrt(d2)) END) AS value
  FROM per_day p JOIN each_day USING (selection, day) GROUP BY selection, epsilon, s),
dual AS (SELECT selection, epsilon, coalesce(min(value), 0) AS value FROM names CROSS JOIN radius LEFT JOIN at_s USING (selection, epsilon) GROUP BY ALL)"""


TRAVELS = """
chosen AS (SELECT k.selection, x, y, node_id FROM picked k JOIN xy USING (node_id)),
sectors AS (SELECT *, ntile(4) OVER v AS vehicle, row_number() OVER v AS pos FROM chosen WINDOW v AS (PARTITION BY selection ORDER BY round(atan2(y, x), 9), node_id)),
stops AS (SELECT *, coalesce(lag(x) OVER v, 0) AS px, coalesce(lag(y) OVER v, 0) AS py, lead(pos) OVER v IS NULL AS last FROM sectors WINDOW v AS (PARTITION BY selection, vehicle ORDER BY pos)),
travels AS (
  SELECT selection, coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + CASE WHEN last THEN sqrt(x * x + y * y) ELSE 0 END), 0) * 100 AS travel
  FROM names LEFT JOIN stops USING (selection) GROUP BY selection)"""
CROSS = ",".join((SELECTIONS, ROOMS, _dual(CROSS_RADII), TRAVELS)) + f""",
crossed AS (SELECT selection, epsilon, travel, {SCALE} * value + travel AS objective FROM dual JOIN travels USING (selection))"""
RECORDS = "records AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS instance, o_orderpriority AS method, CAST(o_totalprice AS DOUBLE) AS objective FROM orders)"
PAIRED = (
    RECORDS
    + """,
firsts AS (SELECT instance, method, arg_min(objective, o_orderkey) AS value FROM records GROUP BY ALL),
paired AS (
  SELECT f.method, f.value, f.value - r.value AS diff FROM firsts f JOIN firsts r USING (instance)
  WHERE r.method = (SELECT min(method) FROM records) AND f.method <> r.method)"""
)
HALVES = """
halves AS (
  SELECT node_id, avg(prize) FILTER (day(day) <= 18) AS train_mean, avg(prize) FILTER (day(day) > 18) AS holdout_mean FROM prizes GROUP BY node_id
  HAVING train_mean IS NOT NULL AND holdout_mean IS NOT NULL)"""
TABLE = """
flat AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
centre AS (SELECT label, i, avg(x) AS c FROM flat GROUP BY ALL),
gap AS (SELECT f.vec_id, f.label, c.label AS other, round(sum((f.x - c.c) * (f.x - c.c)), 9) AS d FROM flat f JOIN centre c USING (i) GROUP BY ALL),
pick AS (SELECT vec_id, label, min({'d': d, 'l': other}).l AS found FROM gap GROUP BY vec_id, label),
cells AS (SELECT label AS truth, found, count(*)::DOUBLE AS n FROM pick GROUP BY ALL),
a AS (SELECT truth, sum(n) AS n FROM cells GROUP BY ALL),
b AS (SELECT found, sum(n) AS n, max(n) AS top FROM cells GROUP BY ALL),
s AS (
  SELECT (SELECT sum(n) FROM cells) AS n, (SELECT sum(n * (n - 1) / 2) FROM cells) AS same, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
    (SELECT sum(n * ln(n)) FROM cells) AS sc, (SELECT sum(n * ln(n)) FROM a) AS sa, (SELECT sum(n * ln(n)) FROM b) AS sb, (SELECT sum(top) FROM b) AS good)"""


def _kdist(k: int) -> str:
    return f"""
gap AS (
  SELECT a.day, a.event_id, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d,
    row_number() OVER (PARTITION BY a.day, a.event_id ORDER BY (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS r,
    count(*) OVER (PARTITION BY a.day, a.event_id) AS n
  FROM pings a JOIN pings b USING (day)),
kd AS (SELECT day, event_id, d AS k_dist FROM gap WHERE r = least({k}, n))"""


_TAIL = "sum(least(c, greatest(k - above, 0)) * v) / sum(least(c, greatest(k - above, 0)))"
N_SAMPLES = "CAST(floor(least(12, greatest(5, 6.4::DOUBLE + 0.2::DOUBLE * ln(n / 10000::DOUBLE)))) AS INTEGER)"
N_HASHES = "CAST(trunc(least(20, 10::DOUBLE + ln(n / 10000::DOUBLE) / ln(2::DOUBLE))) AS INTEGER)"

ORACLE: dict[str, str] = {
    "q01_clean_pings": _with(PINGS) + """
SELECT DISTINCT event_id, CAST(plate_num AS VARCHAR) AS plate_num, round(speed, 4) AS speed, round(CAST(printf('%.6f', lon) AS DOUBLE), 6) AS lon, round(CAST(printf('%.6f', lat) AS DOUBLE), 6) AS lat
FROM pings WHERE speed BETWEEN 0 AND 120 AND lon BETWEEN 102 AND 105 AND lat BETWEEN 29 AND 32 AND published_at IS NOT NULL""",
    "q02_slow_in_box": _with(PINGS) + " SELECT event_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM pings WHERE speed BETWEEN 0 AND 35 AND lon BETWEEN 103.40::DOUBLE AND 104.55::DOUBLE AND lat BETWEEN 30.10::DOUBLE AND 31.20::DOUBLE",
    "q03_period_completeness": """
WITH seen AS (SELECT date_trunc('hour', ts) AS p, count(*) AS n FROM events GROUP BY 1),
every AS (SELECT unnest(generate_series((SELECT min(p) FROM seen)::TIMESTAMP, (SELECT max(p) FROM seen)::TIMESTAMP, INTERVAL 1 HOUR)) AS p)
SELECT strftime(every.p, '%Y-%m-%d %H') AS period, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'present' END AS status FROM every LEFT JOIN seen ON seen.p = every.p""",
    "q04_exact_n_sample": _with(PINGS) + """
SELECT CAST(day AS VARCHAR) AS day, event_id FROM (
  SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY (event_id * 1103515245 + 12345) % 2147483648, event_id) AS r, count(*) OVER (PARTITION BY day) AS n FROM pings)
WHERE r <= greatest(1, round_even(n * 0.1::DOUBLE, 0))""",
    "q05_nearest_node": _with(PINGS, NODES, FOUND) + " SELECT event_id, coalesce(node_id, -1) AS node_id, coalesce(round(dist_m, 3), -1) AS dist_m FROM found",
    "q06_daily_counts": _with(PINGS, NODES, FOUND, COUNTS) + " SELECT CAST(day AS VARCHAR) AS day, node_id, cnt FROM counts",
    "q07_daily_prizes": _with(BASE) + " SELECT CAST(day AS VARCHAR) AS day, node_id, cnt, round(prize, 6) AS prize FROM prizes",
    "q08_unique_vehicle_visits": _with(PINGS, NODES, FOUND) + " SELECT CAST(day AS VARCHAR) AS day, node_id, count(DISTINCT plate_num) AS vehicles FROM found WHERE node_id IS NOT NULL GROUP BY ALL",
    "q09_assignment_summary": _with(PINGS, NODES, FOUND) + """
SELECT CAST(day AS VARCHAR) AS day, count(*) AS points, count(node_id) AS assigned, round(count(node_id)::DOUBLE / count(*) * 100, 6) AS rate_pct, count(DISTINCT node_id) AS nodes_hit, round(avg(dist_m), 3) AS mean_dist_m FROM found GROUP BY ALL""",
    "q10_epsilon_neighbours": _with(PINGS, _dbscan("pings", EPS, MIN_SAMPLES), recursive=True) + " SELECT a AS event_id, count(*) AS neighbours FROM db_pair GROUP BY a",
    "q11_dbscan_core": _with(PINGS, _dbscan("pings", EPS, MIN_SAMPLES), recursive=True) + " SELECT event_id FROM db_core",
    "q12_dbscan_labels": _with(PINGS, _dbscan("pings", EPS, MIN_SAMPLES), recursive=True) + " SELECT event_id, is_core, CAST(label AS BIGINT) AS label FROM db",
    "q13_cluster_centroids": _with(PINGS, _dbscan("pings", EPS, MIN_SAMPLES), recursive=True) + """
SELECT CAST(label AS BIGINT) AS label, round(avg(lon), 7) AS lon, round(avg(lat), 7) AS lat, count(*) AS sampled_count FROM db JOIN pings USING (event_id) WHERE label <> 0 GROUP BY label""",
    "q14_kdist_quantiles": _with(PINGS, _kdist(6)) + """
SELECT CAST(day AS VARCHAR) AS day, round(quantile_cont(k_dist, 0.5), 8) AS q50, round(quantile_cont(k_dist, 0.6), 8) AS q60, round(quantile_cont(k_dist, 0.7), 8) AS q70, round(quantile_cont(k_dist, 0.75), 8) AS q75, count(*) AS n FROM kd GROUP BY day""",
    "q15_adaptive_params": _with(PINGS, _kdist(5)) + f"""
SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, round(least(0.01, greatest(0.0002, q)), 8) AS eps, {N_SAMPLES} AS min_samples, greatest(6, {N_HASHES}) AS hashes
FROM (SELECT day, count(*)::DOUBLE AS n, quantile_cont(k_dist, 0.7) AS q FROM kd GROUP BY day)""",
    "q15b_density_params": _with(PINGS, _kdist(5), _kdist(2).replace("gap AS", "gap2 AS").replace("FROM gap ", "FROM gap2 ").replace("kd AS", "kd2 AS")) + f"""
, k AS (SELECT day, quantile_cont(k_dist, 0.5) AS q50, quantile_cont(k_dist, 0.6) AS q60, quantile_cont(k_dist, 0.7) AS q70, quantile_cont(k_dist, 0.75) AS q75, min(k_dist) AS lo, max(k_dist) AS hi FROM kd GROUP BY day),
base AS (SELECT day, avg(k_dist) * 1.5::DOUBLE AS b FROM kd2 GROUP BY day),
size AS (SELECT day, count(*)::DOUBLE AS n, (max(lon) - min(lon)) * (max(lat) - min(lat)) AS area FROM pings GROUP BY day),
e AS (
  SELECT *, greatest(0.001::DOUBLE, b * (0.5::DOUBLE - 0.1::DOUBLE * log10(greatest(1, n / greatest(area, 1e-12))))) AS e0,
    least(0.5::DOUBLE, b * (3.0::DOUBLE + 0.2::DOUBLE * CASE WHEN n > 1000 THEN log10(n / 1000) ELSE 0 END)) AS raw1,
    list_sort([CASE WHEN n > 50000 THEN q70 ELSE q60 END, q50 * 1.2::DOUBLE, q75])[2] AS mid
  FROM size JOIN base USING (day) JOIN k USING (day)),
f AS (SELECT *, CASE WHEN raw1 <= e0 THEN e0 * 2 ELSE raw1 END AS e1 FROM e)
SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, {N_SAMPLES} AS min_samples, greatest(1, {N_HASHES}) AS hashes,
  round(round_even(least(e1, greatest(e0, CASE WHEN hi - lo > 1e-6 THEN e0 + (mid - lo) / (hi - lo) * (e1 - e0) * 0.8::DOUBLE ELSE (e0 + e1) / 2 END)), 6), 5) AS eps FROM f""",
    "q17_greedy_spacing": _with(NODES, f"""
turns AS (SELECT row_number() OVER (ORDER BY weight DESC, node_id) AS r, * FROM nodes),
pass AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(lon DOUBLE, lat DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS node_id
  UNION ALL
  SELECT o.r, CASE WHEN len(list_filter(kept, lambda k: {_haversine("o.lon", "o.lat", "k.lon", "k.lat")} < 25000)) = 0 THEN list_append(kept, {{'lon': o.lon, 'lat': o.lat}}) ELSE kept END,
    CASE WHEN len(list_filter(kept, lambda k: {_haversine("o.lon", "o.lat", "k.lon", "k.lat")} < 25000)) = 0 THEN o.node_id END
  FROM pass JOIN turns o ON o.r = pass.r + 1)""", recursive=True) + " SELECT node_id, round(weight, 4) AS weight FROM pass JOIN nodes USING (node_id)",
    "q16_persistent_candidates": _with(PINGS, _per_day_clusters(), _dbscan("local", MERGE_KM, MERGE_SAMPLES), recursive=True) + """
, merged AS (
  SELECT db.label, sum(sampled_count) AS sampled_count, count(DISTINCT day) AS active_periods, count(*) AS cluster_count
  FROM db JOIN spots ON spots.id = db.event_id WHERE db.label > 0 GROUP BY db.label),
scored AS (SELECT *, ln(1 + sampled_count::DOUBLE) * sqrt(active_periods::DOUBLE) AS score FROM merged),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, active_periods DESC, sampled_count DESC, label) AS node_id FROM scored)
SELECT CAST(node_id AS INTEGER) AS node_id, CAST(sampled_count AS BIGINT) AS sampled_count, active_periods, cluster_count, round(score, 6) AS score FROM ranked WHERE node_id <= 250""",
    "q18_prize_quintiles": _with(BASE) + """
, means AS (SELECT node_id, round(avg(prize), 9) AS m FROM prizes GROUP BY node_id),
edges AS (SELECT list_distinct([round(e, 9) FOR e IN quantile_cont(m, [0.2, 0.4, 0.6, 0.8])]) AS es FROM means)
SELECT node_id, round(m, 6) AS mean_prize, CAST(1 + len(list_filter(es, lambda e: m > e)) AS INTEGER) AS value_bin, CAST(ntile(5) OVER (ORDER BY m, node_id) AS INTEGER) AS rank_bin FROM means, edges""",
    "q19_route_costs": _with(NODES, XY, ROUTES, _costs("routes")) + " SELECT vehicle, stops, round(cost, 3) AS cost FROM costs",
    "q20_feasibility": _with(NODES, XY, ROUTES, _costs("routes")) + """
SELECT count(*) AS used, round(max(cost), 3) AS longest, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM routes GROUP BY node_id)) AS duplicates, CAST(0 AS BIGINT) AS unknown, count(*) <= 4 AND max(cost) <= 1000000.0000001 AS feasible FROM costs""",
    "q21_nominal_penalty": _with(BASE, MISSES) + f" SELECT round({SCALE} * avg(missed), 3) AS penalty, max(unvisited) AS unvisited FROM misses",
    "q22_box_penalty": _with(BASE, MISSES) + f" SELECT round({SCALE} * max(unvisited), 3) AS penalty FROM misses",
    "q23_dro_fast": _with(BASE, MISSES) + f"""
SELECT e AS epsilon, round(CASE WHEN m = 0 THEN 0 ELSE {SCALE} * (e * sqrt(m::DOUBLE) + mm) END, 3) AS penalty, m = 0 OR e <= sqrt(m::DOUBLE) * mr AS certified
FROM (SELECT avg(missed) AS mm, avg(coalesce(room, 0)) AS mr, max(unvisited) AS m FROM misses), (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in RADII)}]) AS e)""",
    "q25_realized_cost": _with(BASE, REALIZED) + " SELECT CAST(day AS VARCHAR) AS day, round(cost, 3) AS cost, round(missed, 6) AS missed FROM realized",
    "q26_coverage": _with(BASE, REALIZED) + " SELECT CAST(day AS VARCHAR) AS day, round(coverage_pct, 6) AS coverage_pct FROM realized",
    "q27_cvar": _with(BASE, REALIZED) + """
SELECT count(*) AS n, round(avg(cost), 3) AS mean_value, round(avg(cost) FILTER (r <= ceil(0.1::DOUBLE * n)), 3) AS cvar_value, round(max(cost), 3) AS worst_value
FROM (SELECT cost, row_number() OVER (ORDER BY cost DESC) AS r, count(*) OVER () AS n FROM realized)""",
    "q24_dro_general": _with(BASE, SELECTIONS, ROOMS, _dual((0.0, 0.1, 0.5, 1.0)), recursive=True) + f" SELECT selection, epsilon, round({SCALE} * value, 2) AS penalty FROM dual",
    "q28_eps_cross_matrix": _with(BASE, XY, CROSS, recursive=True) + " SELECT selection, " + ", ".join(f"round(max(objective) FILTER (epsilon = {v}::DOUBLE), 2) AS e{round(v * 1000)}" for v in CROSS_RADII) + " FROM crossed GROUP BY selection",
    "q29_column_winners": _with(BASE, XY, CROSS, recursive=True) + " SELECT epsilon, b.s AS selection, b.o AS objective FROM (SELECT epsilon, min({'o': round(objective, 2), 's': selection}) AS b FROM crossed GROUP BY epsilon)",
    "q30_lower_envelope": _with(BASE, XY, SELECTIONS, ROOMS, _dual((0.1,)), TRAVELS, recursive=True) + f"""
SELECT level, b.s AS plan_id, round(b.o, 1) AS objective FROM (
  SELECT level, min({{'o': round(travel + level * value, 6), 's': selection}}) AS b
  FROM dual JOIN travels USING (selection), (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in LEVELS)}]) AS level) GROUP BY level)""",
    "q31_pareto": """
WITH per AS (SELECT CAST(o_custkey AS BIGINT) AS o_custkey, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS cost, count(*)::DOUBLE AS gain FROM orders GROUP BY ALL),
one AS (SELECT cost, max({'g': gain, 't': -o_custkey}) AS b FROM per GROUP BY cost),
line AS (SELECT cost, b.g AS gain, -b.t AS o_custkey, max(b.g) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM one)
SELECT o_custkey, cost, gain FROM line WHERE best IS NULL OR gain > best + 1e-9""",
    "q32_best_per_group": "WITH " + RECORDS + """
SELECT instance, o_orderkey, method, round(objective, 2) AS objective FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY objective, o_orderkey) AS r FROM records) WHERE r = 1""",
    "q33_method_summary": "WITH " + RECORDS + """
SELECT method, count(*) AS runs, round(avg(objective), 3) AS mean_value, round(stddev_samp(objective), 3) AS std_value, round(min(objective), 3) AS min_value, round(max(objective), 3) AS max_value FROM records GROUP BY method""",
    "q34_paired_wtl": "WITH " + PAIRED + """
SELECT method, count(*) AS pairs, round(avg(diff), 3) AS mean_diff, round(avg(diff / value) * 100, 4) AS mean_reduction_pct, count(*) FILTER (diff > 1e-8) AS wins, count(*) FILTER (abs(diff) <= 1e-8) AS ties, count(*) FILTER (diff < -1e-8) AS losses FROM paired GROUP BY method""",
    "q35_calibration_fit": _with(BASE, HALVES) + """
SELECT round(regr_slope(holdout_mean, train_mean), 6) AS slope, round(regr_intercept(holdout_mean, train_mean), 6) AS intercept, round(regr_r2(holdout_mean, train_mean), 6) AS r2, round(avg(abs(holdout_mean - train_mean)), 6) AS mae, round(sqrt(avg((holdout_mean - train_mean) * (holdout_mean - train_mean))), 6) AS rmse, count(*) AS n FROM halves""",
    "q36_spearman": _with(BASE, HALVES) + """
, r AS (SELECT round(train_mean, 9) AS x, round(holdout_mean, 9) AS y FROM halves),
ranks AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2::DOUBLE AS ry FROM r)
SELECT round(corr(rx, ry), 8) AS rho, count(*) AS n FROM ranks""",
    "q37_rolling_folds": _with(BASE, REALIZED) + """
, folds(fold, t) AS (VALUES (1, 15), (2, 18), (3, 21)),
spans AS (SELECT fold, 'train' AS part, 1 AS low, t AS high FROM folds UNION ALL SELECT fold, 'validate', t + 1, t + 4 FROM folds UNION ALL SELECT fold, 'test', t + 5, t + 9 FROM folds),
ranked AS (
  SELECT fold, part, round(cost, 6) AS cost, row_number() OVER (PARTITION BY fold, part ORDER BY cost DESC) AS r, count(*) OVER (PARTITION BY fold, part) AS n
  FROM realized JOIN spans ON day(day) BETWEEN low AND high)
SELECT CAST(fold AS INTEGER) AS fold, part, max(n) AS n, round(avg(cost), 3) AS mean_value, round(avg(cost) FILTER (r <= ceil(0.1::DOUBLE * n)), 3) AS cvar_value, round(max(cost), 3) AS worst_value FROM ranked GROUP BY fold, part""",
    "q38_contingency_ari": _with(TABLE) + " SELECT CAST(n AS BIGINT) AS n, round((same - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 8) AS ari FROM s",
    "q39_nmi": _with(TABLE) + " SELECT CAST(n AS BIGINT) AS n, round(2 * (ln(n) + (sc - sa - sb) / n) / ((ln(n) - sa / n) + (ln(n) - sb / n)), 8) AS nmi FROM s",
    "q40_accuracy": _with(TABLE) + " SELECT CAST(n AS BIGINT) AS n, round(good / n, 8) AS accuracy FROM s",
    "q41_lsh_fdbscan": "WITH RECURSIVE " + PINGS + "," + _hashed(False),
    "q42_lsh_dynamic": "WITH RECURSIVE " + PINGS + "," + _hashed(True),
    "q43_stream_batches": """
WITH rows_ AS (SELECT event_id, user_id, CAST(floor(event_id / 1000) AS BIGINT) AS batch FROM events),
fresh AS (SELECT batch, count(*) AS k FROM (SELECT user_id, min(batch) AS batch FROM rows_ GROUP BY user_id) GROUP BY batch),
per AS (SELECT batch, count(*) AS inserts FROM rows_ GROUP BY batch)
SELECT batch, inserts, CAST(sum(inserts) OVER (ORDER BY batch) AS BIGINT) AS points, CAST(sum(coalesce(k, 0)) OVER (ORDER BY batch) AS BIGINT) AS vehicles FROM per LEFT JOIN fresh USING (batch)""",
    "q44_pivot_wide_prizes": _with(BASE) + " SELECT node_id, " + ", ".join(f"max(cnt) FILTER (day = DATE '2024-01-{d:02d}') AS cnt_202401{d:02d}, round(max(prize) FILTER (day = DATE '2024-01-{d:02d}'), 6) AS prize_202401{d:02d}" for d in range(1, 31)) + " FROM prizes GROUP BY node_id",
    "q45_density_grid": _with(PINGS) + """
SELECT CAST(least(359, floor((lon - 103.4::DOUBLE) / ((104.55::DOUBLE - 103.4::DOUBLE) / 360))) AS BIGINT) AS bin_x, CAST(least(359, floor((lat - 30.1::DOUBLE) / ((31.2::DOUBLE - 30.1::DOUBLE) / 360))) AS BIGINT) AS bin_y, count(*) AS amount
FROM pings WHERE lon BETWEEN 103.4::DOUBLE AND 104.55::DOUBLE AND lat BETWEEN 30.1::DOUBLE AND 31.2::DOUBLE GROUP BY ALL""",
    "q46_cluster_report": _with(PINGS, _dbscan("pings", EPS, MIN_SAMPLES), recursive=True) + """
, sizes AS (SELECT label, count(*) AS n FROM db GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (label <> 0) AS clusters, CAST(coalesce(sum(n) FILTER (label = 0), 0) AS BIGINT) AS noise, round(coalesce(sum(n) FILTER (label = 0), 0)::DOUBLE / sum(n) * 100, 6) AS noise_pct, round(avg(n) FILTER (label <> 0), 6) AS mean_size, max(n) FILTER (label <> 0) AS max_size, min(n) FILTER (label <> 0) AS min_size FROM sizes""",
    "q47_timepoint_asof": """
WITH points AS (SELECT unnest(generate_series((SELECT min(ts)::DATE + 1 FROM events)::TIMESTAMP, (SELECT max(ts) FROM events)::TIMESTAMP, INTERVAL 7 DAY)) AS point)
SELECT user_id AS plate_num, strftime(point, '%Y-%m-%d') AS point, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event_id FROM events, points WHERE ts <= point GROUP BY user_id, points.point""",
    "q48_running_best": "SELECT event_id, round(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS best_so_far FROM events",
    "q49_mean_sem": "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg({c}::DOUBLE), 5) AS {c}_mean, round(stddev_samp({c}::DOUBLE) / sqrt(count({c})::DOUBLE), 5) AS {c}_sem" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    from . import catalogue_checks, catalogue_more, catalogue_records

    return ORACLE | catalogue_more.ORACLE | catalogue_records.ORACLE | catalogue_checks.ORACLE
