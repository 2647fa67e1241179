"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_S = "SELECT vec_id, label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
_A = "SELECT vec_id, label, unnest(range(64)) AS pos, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings"
_RASTER = "SELECT CAST(l_orderkey % 32 AS INTEGER) AS \"row\", l_linenumber AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"
_FRAMES = f"SELECT vec_id, label, pos // 8 AS y, pos % 8 AS x, v FROM ({_S})"
_FOCUS = f"""
SELECT vec_id, label, round(sum(CASE WHEN x > 0 AND y > 0 THEN abs(v - lx) + abs(v - ly) ELSE 0 END), 6) + 0.0 AS metric
FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS lx, lag(v) OVER (PARTITION BY vec_id, x ORDER BY y) AS ly FROM ({_FRAMES}))
GROUP BY 1, 2"""
_POINTS = "SELECT unnest(range(9)) AS point, unnest([-2.0, 0.0, 2.0, -2.0, 0.0, 2.0, -2.0, 0.0, 2.0]::DOUBLE[]) AS px, unnest([-2.0, -2.0, -2.0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0]::DOUBLE[]) AS py"
_DELTAS = f"""SELECT point, embedding, sqrt(pow(100 * cos(vec_id * 0.01::DOUBLE) - px, 2) + pow(100 * sin(vec_id * 0.01::DOUBLE) - py, 2) + 400.0::DOUBLE) - (sqrt(10400.0::DOUBLE) - 20.0::DOUBLE) AS delta
FROM embeddings, ({_POINTS})"""

SQL: dict[str, str] = {
    "q01_range_profile_energy": f"SELECT vec_id, label, round(sum(v * v * pow(0.5 - 0.5 * cos(2 * pi() * pos / 63), 2)), 6) + 0.0 AS energy FROM ({_S}) GROUP BY 1, 2",
    "q02_dft_bin": f"""SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(sum(v * cos(2 * pi() / 64 * bin * pos)), 6) + 0.0 AS re, round(sum(v * sin(2 * pi() / 64 * bin * pos)), 6) + 0.0 AS im
FROM ({_S}), (SELECT unnest(range(8)) AS bin) GROUP BY 1, 2""",
    "q03_matched_lag": f"""
WITH s AS ({_S}), r AS (SELECT unnest(range(7)) AS m, unnest([0.25, 0.5, 0.75, 1.0, 0.75, 0.5, 0.25]::DOUBLE[]) AS w),
c AS (SELECT vec_id, pos - m AS lag, round(sum(v * w), 9) AS peak FROM s, r WHERE pos - m BETWEEN 0 AND 57 GROUP BY 1, 2)
SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(peak, 6) + 0.0 AS peak FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY peak DESC, lag) = 1""",
    "q04_pta_stats": f"""
WITH s AS ({_A}), m AS (SELECT vec_id, max(v) AS top FROM s GROUP BY 1),
p AS (SELECT s.vec_id, top, min(pos) AS p FROM s JOIN m ON s.vec_id = m.vec_id AND v = top GROUP BY 1, 2),
b AS (SELECT s.vec_id, top, p, coalesce(max(CASE WHEN v <= top * 0.5 AND pos < p THEN pos END), 0) AS l, coalesce(min(CASE WHEN v <= top * 0.5 AND pos > p THEN pos END), 63) AS r
      FROM s JOIN p ON s.vec_id = p.vec_id GROUP BY 1, 2, 3),
e AS (SELECT b.vec_id, top, p, l, r, coalesce(max(CASE WHEN pos < l OR pos > r THEN v END), 0) AS side, coalesce(sum(CASE WHEN pos < l OR pos > r THEN v * v END), 0) AS energy
      FROM s JOIN b ON s.vec_id = b.vec_id GROUP BY 1, 2, 3, 4, 5)
SELECT vec_id, round(top, 6) + 0.0 AS max_power, CAST(p + 1 AS INTEGER) AS pos, CAST(r - l AS INTEGER) AS irw,
       CASE WHEN side > 0 THEN round(20 * log10(side / top), 6) + 0.0 ELSE 0.0 END AS mslr,
       CASE WHEN energy > 0 THEN round(10 * log10(energy / (top * top)), 6) + 0.0 ELSE 0.0 END AS islr FROM e""",
    "q05_local_peaks_topk": f"""
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS INTEGER) AS nth, CAST(pos + 1 AS INTEGER) AS place, round(v, 6) + 0.0 AS power
FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ({_S}) WINDOW w AS (PARTITION BY vec_id ORDER BY pos))
WHERE v >= a AND v >= b QUALIFY nth <= 3""",
    "q06_profile_sum_2d": f"SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v), 6) + 0.0 AS total FROM ({_S}) GROUP BY 1, 2",
    "q07_histogram_right_closed": """
SELECT CASE WHEN hi > lo THEN least(9, greatest(0, CAST(ceil((value - lo) / ((hi - lo) / 10)) AS INTEGER) - 1)) ELSE 0 END AS bin, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1""",
    "q08_percentile_clip": """
SELECT share, value FROM (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem),
(SELECT unnest([0.02, 0.5, 0.98]::DOUBLE[]) AS share) WHERE k = CAST(floor(share * (n - 1)) AS BIGINT)""",
    "q09_agc_row": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN m > 0 THEN v / m ELSE v END, 6) + 0.0 AS value FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS m FROM ({_A}))",
    "q10_collapse": f"SELECT vec_id, CAST(pos // 5 AS INTEGER) AS cell, round(sum(v) / 5, 6) + 0.0 AS value FROM ({_S}) WHERE pos < 60 GROUP BY 1, 2",
    "q11_edge_taper": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN least(pos, 63 - pos) < 8 THEN v * (0.5 - 0.5 * cos(pi() * (least(pos, 63 - pos) + 1) / 9)) ELSE v END, 6) + 0.0 AS value FROM ({_S})",
    "q12_dc_removal": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v - m, 6) + 0.0 AS value FROM ({_S}), (SELECT avg(v) AS m FROM ({_S}))",
    "q13_centroid_registration": f"""
WITH c AS (SELECT vec_id, label, sum(abs(v)) AS total, round(sum(abs(v) * x) / nullif(sum(abs(v)), 0), 9) AS cx, round(sum(abs(v) * y) / nullif(sum(abs(v)), 0), 9) AS cy FROM ({_FRAMES}) GROUP BY 1, 2),
r AS (SELECT label, arg_min(cx, vec_id) AS rx, arg_min(cy, vec_id) AS ry FROM c WHERE total > 0 GROUP BY 1),
d AS (SELECT c.label, vec_id, CASE WHEN total > 0 THEN CAST(round(-(cx - rx)) AS INTEGER) ELSE 0 END AS dx, CASE WHEN total > 0 THEN CAST(round(-(cy - ry)) AS INTEGER) ELSE 0 END AS dy,
      CASE WHEN total > 0 THEN round(sqrt((cx - rx) * (cx - rx) + (cy - ry) * (cy - ry)), 6) + 0.0 ELSE 0.0 END AS metric FROM c JOIN r ON c.label = r.label)
SELECT label, vec_id, dx, dy, metric, CAST(sum(dx) OVER w AS BIGINT) AS cum_dx, CAST(sum(dy) OVER w AS BIGINT) AS cum_dy FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
    "q14_focus_metric": f"SELECT vec_id, metric FROM ({_FOCUS})",
    "q15_running_best": f"""
SELECT label, vec_id, metric, round(metric - best, 6) + 0.0 AS delta, metric >= best AS is_best
FROM (SELECT *, greatest(0.0, coalesce(max(metric) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best FROM ({_FOCUS}))""",
    "q16_latency_stats": "SELECT event_type, count(*) AS n, round(min(value - 100), 6) + 0.0 AS least, round(max(value - 100), 6) + 0.0 AS most, round(avg(value - 100), 6) + 0.0 AS mean FROM events WHERE value - 100 >= 0 GROUP BY 1",
    "q17_frame_buffer": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth, value FROM events QUALIFY nth <= 4",
    "q18_block_line_lookup": "SELECT o_orderkey AS line, min(s_suppkey) AS block FROM orders JOIN supplier ON o_orderkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 14 GROUP BY 1",
    "q19_asof_grid_interp": """
WITH k AS (SELECT s_suppkey * 10 AS low, s_acctbal AS a, lead(s_suppkey * 10) OVER (ORDER BY s_suppkey) AS high, lead(s_acctbal) OVER (ORDER BY s_suppkey) AS b FROM supplier),
i AS (SELECT * FROM k WHERE high IS NOT NULL), f AS (SELECT * FROM i ORDER BY low LIMIT 1),
m AS (SELECT o_orderkey AS line, coalesce(i.low, f.low) AS low, coalesce(i.high, f.high) AS high, coalesce(i.a, f.a) AS a, coalesce(i.b, f.b) AS b FROM orders ASOF LEFT JOIN i ON o_orderkey >= i.low, f)
SELECT line, round(a + (line - low) / CAST(high - low AS DOUBLE) * (b - a), 6) + 0.0 AS value FROM m""",
    "q20_backproject_sql": f"""
WITH d AS (SELECT *, least(CAST(floor(delta) AS INTEGER), 62) AS k FROM ({_DELTAS})),
i AS (SELECT point, delta, CASE WHEN delta BETWEEN 0 AND 63 THEN CAST(embedding[k + 1] AS DOUBLE) * (1 - (delta - k)) + CAST(embedding[k + 2] AS DOUBLE) * (delta - k) END AS v FROM d)
SELECT CAST(point AS INTEGER) AS point, round(sum(v * cos(0.5 * delta)), 4) + 0.0 AS re, round(sum(v * sin(0.5 * delta)), 4) + 0.0 AS im, count(v) AS n FROM i GROUP BY 1""",
    "q21_direct_sum": f"""
WITH d AS (SELECT point, delta, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM ({_DELTAS}))
SELECT CAST(point AS INTEGER) AS point, round(sum(v * cos((0.5 + 0.01 * k) * delta)), 4) + 0.0 AS re, round(sum(v * sin((0.5 + 0.01 * k) * delta)), 4) + 0.0 AS im FROM d GROUP BY 1""",
    "q22_compare_images": f"""
WITH b AS (SELECT CAST(l_orderkey % 32 AS INTEGER) AS "row", l_linenumber AS col, sum(l_quantity * (1 + l_tax / 100)) AS value FROM lineitem GROUP BY 1, 2),
j AS (SELECT a.value AS x, b.value AS y FROM ({_RASTER}) a FULL JOIN b ON a."row" = b."row" AND a.col = b.col)
SELECT count(*) AS pixels, round(sqrt(avg((x - y) * (x - y))), 4) + 0.0 AS rms, round(max(abs(x - y)), 4) + 0.0 AS max_difference,
       count(CASE WHEN abs(x - y) > 0.5 + 0.0004 * abs(y) THEN 1 END) AS failures, count(CASE WHEN x IS NULL OR y IS NULL THEN 1 END) AS unmatched FROM j""",
    "q23_preview_power": f'SELECT "row" // 4 AS "row", col // 4 AS col, round(sqrt(avg(value * value)), 6) + 0.0 AS value FROM ({_RASTER}) GROUP BY 1, 2',
    "q24_gray_db": f"""
SELECT "row", col, CASE WHEN top > 0 AND value > 0 THEN CAST(round(least(1.0, greatest(0.0, 1 + (20 * log10(value) - 20 * log10(top)) / 6)) * 255) AS INTEGER) ELSE 0 END AS gray
FROM ({_RASTER}), (SELECT max(value) AS top FROM ({_RASTER}))""",
    "q25_sequence_first_island": """
WITH f AS (SELECT DISTINCT l_partkey AS base, l_linenumber AS n FROM lineitem), g AS (SELECT base, n, n - row_number() OVER (PARTITION BY base ORDER BY n) AS island, min(n) OVER (PARTITION BY base) AS head FROM f)
SELECT base, min(n) AS first, max(n) AS last, count(*) AS n FROM g WHERE island = head - 1 GROUP BY 1""",
    "q26_echo_synthesis": """
WITH t AS (SELECT 200.0::DOUBLE + c_custkey % 97 AS x, c_custkey % 31 - 15.0::DOUBLE AS y, c_acctbal / 1000 AS rcs FROM customer),
s AS (SELECT pulse, rcs, sqrt(x * x + (y - pulse * 1.5::DOUBLE) * (y - pulse * 1.5::DOUBLE)) AS r FROM t, (SELECT unnest(range(8)) AS pulse)),
b AS (SELECT pulse, rcs, r, CAST(floor(r / 2) AS INTEGER) AS sample, 1 - (r / 2 - floor(r / 2)) AS w FROM s UNION ALL SELECT pulse, rcs, r, CAST(floor(r / 2) AS INTEGER) + 1, r / 2 - floor(r / 2) FROM s)
SELECT CAST(pulse AS INTEGER) AS pulse, sample, round(sum(rcs * w * cos(0.25::DOUBLE * r)), 4) + 0.0 AS re, round(sum(rcs * w * sin(0.25::DOUBLE * r)), 4) + 0.0 AS im FROM b WHERE sample BETWEEN 0 AND 199 GROUP BY 1, 2""",
    "q27_shift_image": f"""
WITH i AS (SELECT "row" - 2 AS "row", col AS col, value FROM ({_RASTER})), g AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(32)) AS r), (SELECT unnest(range(7)) AS c))
SELECT g."row", g.col, round(coalesce(value, 0.0), 6) + 0.0 AS value FROM g LEFT JOIN i ON g."row" = i."row" AND g.col = i.col""",
    "q28_unique_stem_check": "SELECT lower(trim(p_name)) AS stem, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "q29_mag_phase_decode": """
SELECT l_orderkey, round(m * cos(2.0::DOUBLE / 65536 * code * pi()), 6) + 0.0 AS re, round(m * sin(2.0::DOUBLE / 65536 * code * pi()), 6) + 0.0 AS im
FROM (SELECT l_orderkey, sum(l_quantity) AS m, CAST(sum(l_partkey) * 977 % 65536 AS BIGINT) AS code FROM lineitem GROUP BY 1)""",
    "q31_stc_ramp": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v * (0.5 + 0.5 * pos / 63.0::DOUBLE), 6) + 0.0 AS value FROM ({_S})",
    "q32_top_points": f'SELECT "row", col, round(value, 6) + 0.0 AS value FROM ({_RASTER}) ORDER BY value DESC, "row", col LIMIT 16',
    "q33_frequency_fit": """
WITH t AS (SELECT CAST(s_suppkey AS DOUBLE) AS k, 9600.0::DOUBLE + s_suppkey * 0.02::DOUBLE + s_acctbal * 1e-6::DOUBLE AS f FROM supplier), r AS (SELECT regr_slope(f, k) AS step, regr_intercept(f, k) AS start FROM t)
SELECT round(any_value(start), 6) + 0.0 AS start, round(any_value(step), 8) + 0.0 AS step, round(max(abs(f - start - step * k)), 6) + 0.0 AS error FROM t, r""",
    "q34_scene_extents": "SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY 1",
    "q36_phase_gray": "SELECT vec_id, CAST(k AS INTEGER) AS pos, CAST(round((atan2(CAST(embedding[2 * k + 2] AS DOUBLE), CAST(embedding[2 * k + 1] AS DOUBLE)) + pi()) / (2 * pi()) * 255) AS INTEGER) AS gray FROM embeddings, (SELECT unnest(range(32)) AS k)",
    "q37_normalised_histogram": """
WITH c AS (SELECT least(255, greatest(0, CAST(ceil((o_totalprice - lo) / ((hi - lo) / 256)) AS INTEGER) - 1)) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1)
SELECT bin, round(n / CAST((SELECT sum(n) FROM c) AS DOUBLE), 9) + 0.0 AS share FROM c""",
    "q38_quantised": f"""
WITH s AS (SELECT vec_id, round(v, 4) AS v FROM ({_S})), p AS (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS top FROM s),
c AS (SELECT vec_id, CASE WHEN top > 0 THEN CAST(round(v / top * 32767) AS INTEGER) ELSE 0 END AS code FROM p)
SELECT vec_id, CAST(sum(abs(code)) AS BIGINT) AS codes, max(code) AS top, min(code) AS least FROM c GROUP BY 1""",
    "q30_zoom_fft": f"""
WITH d AS (SELECT t, p, sum(cos(2 * pi() * f * (t / 256.0::DOUBLE - p / 64.0::DOUBLE))) AS c, sum(sin(2 * pi() * f * (t / 256.0::DOUBLE - p / 64.0::DOUBLE))) AS s
           FROM (SELECT unnest(range(256)) AS t), (SELECT unnest(range(64)) AS p), (SELECT unnest(range(-31, 33)) AS f) GROUP BY 1, 2),
z AS (SELECT vec_id, t, round(sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)) / 256, 9) AS z FROM ({_S}) x JOIN d ON x.pos = d.p GROUP BY 1, 2)
SELECT vec_id, round(z, 6) + 0.0 AS peak, CAST(t AS INTEGER) AS place FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, t) = 1""",
    "q35_scene_geodetic": """
WITH c AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f, radians(35.2::DOUBLE) AS phi, radians(-106.5::DOUBLE) AS lam),
k AS (SELECT *, f * (2 - f) AS e2, a / sqrt(1 - f * (2 - f) * pow(sin(phi), 2)) AS n, a * (1 - f) AS b FROM c),
p AS (SELECT c_custkey, c_custkey % 200 - 100.0::DOUBLE AS east, c_acctbal / 10 AS north FROM customer),
x AS (SELECT c_custkey, k.*, (n + 1600) * cos(phi) * cos(lam) - east * sin(lam) - north * sin(phi) * cos(lam) AS ex, (n + 1600) * cos(phi) * sin(lam) + east * cos(lam) - north * sin(phi) * sin(lam) AS ey,
      (n * (1 - e2) + 1600) * sin(phi) + north * cos(phi) AS ez FROM p, k),
t AS (SELECT *, sqrt(ex * ex + ey * ey) AS r, atan2(ez * a, sqrt(ex * ex + ey * ey) * b) AS theta FROM x)
SELECT c_custkey, round(degrees(atan2(ey, ex)), 7) + 0.0 AS lon, round(degrees(atan2(ez + e2 / (1 - e2) * b * pow(sin(theta), 3), r - e2 * a * pow(cos(theta), 3))), 7) + 0.0 AS lat FROM t""",
    "q39_impulse_response": f"""
WITH s AS ({_A}), m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM s), p AS (SELECT vec_id, pos, pow(v / top, 2) AS p, v = top AS high FROM m),
k AS (SELECT vec_id, min(pos) AS k FROM p WHERE high GROUP BY 1),
n AS (SELECT *, lag(p) OVER w AS before, lead(p) OVER w AS behind FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
b AS (SELECT n.vec_id, k, max(CASE WHEN before > p AND behind > p AND pos < k THEN pos END) AS l, min(CASE WHEN before > p AND behind > p AND pos > k THEN pos END) AS r FROM n JOIN k ON n.vec_id = k.vec_id GROUP BY 1, 2),
e AS (SELECT b.vec_id, k, l, r, max(CASE WHEN pos BETWEEN l AND k AND p <= 0.5 THEN pos END) AS a, min(CASE WHEN pos BETWEEN k AND r AND p <= 0.5 THEN pos END) AS z,
      max(CASE WHEN pos < l OR pos > r THEN p END) AS pslr, sum(CASE WHEN pos < l OR pos > r THEN p END) / sum(CASE WHEN pos BETWEEN l AND r THEN p END) AS islr
      FROM p JOIN b ON p.vec_id = b.vec_id GROUP BY 1, 2, 3, 4),
q AS (SELECT e.*, pa.p AS pa, pa1.p AS pa1, pz.p AS pz, pz1.p AS pz1, a IS NOT NULL AND z IS NOT NULL AS ok FROM e LEFT JOIN p pa ON pa.vec_id = e.vec_id AND pa.pos = a LEFT JOIN p pa1 ON pa1.vec_id = e.vec_id AND pa1.pos = a + 1
      LEFT JOIN p pz ON pz.vec_id = e.vec_id AND pz.pos = z LEFT JOIN p pz1 ON pz1.vec_id = e.vec_id AND pz1.pos = z - 1)
SELECT vec_id, CASE WHEN ok THEN CAST(k AS INTEGER) END AS peak, CASE WHEN ok THEN CAST(l AS INTEGER) END AS "left", CASE WHEN ok THEN CAST(r AS INTEGER) END AS "right",
       CASE WHEN ok THEN round((z - (0.5 - pz) / (pz1 - pz) - a - (0.5 - pa) / (pa1 - pa)) * 0.5, 6) + 0.0 END AS width, CASE WHEN ok THEN round(pslr, 6) + 0.0 END AS pslr, CASE WHEN ok THEN round(islr, 6) + 0.0 END AS islr,
       CASE WHEN ok THEN round(10 * log10(pslr), 6) + 0.0 END AS pslr_db, CASE WHEN ok THEN round(10 * log10(islr), 6) + 0.0 END AS islr_db FROM q""",
    "q40_axis_stats": f"""
WITH a AS (SELECT vec_id, 'x' AS axis, pos % 8 AS i, sum(v) AS v FROM ({_A}) GROUP BY 1, 2, 3 UNION ALL SELECT vec_id, 'y', pos // 8, sum(v) FROM ({_A}) GROUP BY 1, 2, 3),
m AS (SELECT vec_id, axis, max(v) AS top FROM a GROUP BY 1, 2), p AS (SELECT a.vec_id, a.axis, top, min(i) AS p FROM a JOIN m ON a.vec_id = m.vec_id AND a.axis = m.axis AND v = top GROUP BY 1, 2, 3),
b AS (SELECT a.vec_id, a.axis, top, p, coalesce(min(CASE WHEN v <= top * 0.5 AND i > p THEN i END), 7) - coalesce(max(CASE WHEN v <= top * 0.5 AND i < p THEN i END), 0) AS irw FROM a JOIN p ON a.vec_id = p.vec_id AND a.axis = p.axis GROUP BY 1, 2, 3, 4)
SELECT vec_id, max(CASE WHEN axis = 'x' THEN round(top, 6) END) + 0.0 AS x_power, max(CASE WHEN axis = 'y' THEN round(top, 6) END) + 0.0 AS y_power, CAST(max(CASE WHEN axis = 'x' THEN p END) + 1 AS INTEGER) AS x_pos,
       CAST(max(CASE WHEN axis = 'y' THEN p END) + 1 AS INTEGER) AS y_pos, CAST(max(CASE WHEN axis = 'x' THEN irw END) AS INTEGER) AS x_irw, CAST(max(CASE WHEN axis = 'y' THEN irw END) AS INTEGER) AS y_irw FROM b GROUP BY 1""",
    "q41_image_quality": f"""
WITH s AS (SELECT vec_id, pos, v * v AS v FROM ({_S})), m AS (SELECT vec_id, max(v) AS top FROM s GROUP BY 1), p AS (SELECT s.vec_id, top, min(pos) AS p FROM s JOIN m ON s.vec_id = m.vec_id AND v = top GROUP BY 1, 2),
b AS (SELECT s.vec_id, top, p, coalesce(min(CASE WHEN v <= top * 0.5 AND pos > p THEN pos END), 63) - coalesce(max(CASE WHEN v <= top * 0.5 AND pos < p THEN pos END), 0) AS irw FROM s JOIN p ON s.vec_id = p.vec_id GROUP BY 1, 2, 3),
n AS (SELECT *, lag(v) OVER w AS x, lead(v) OVER w AS y FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY pos)), k AS (SELECT vec_id, max(v) AS peak FROM n WHERE v >= x AND v >= y GROUP BY 1)
SELECT b.vec_id, round(top, 4) + 0.0 AS max_power, CAST(p + 1 AS INTEGER) AS pos, CAST(irw AS INTEGER) AS irw, round(peak, 4) + 0.0 AS peak FROM b LEFT JOIN k ON b.vec_id = k.vec_id""",
    "q42_demonstration_image": f"""
WITH g AS (SELECT "row" AS r, col - 1 AS c, CAST(value AS DOUBLE) AS v FROM ({_RASTER})), d AS (SELECT r, c, (v - (SELECT avg(v) FROM g)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * c / 6)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * r / 31)) AS w FROM g),
f AS (SELECT u, k, sqrt(pow(sum(w * cos(2 * pi() * (u * r / 32.0::DOUBLE + k * c / 7.0::DOUBLE))), 2) + pow(sum(w * sin(2 * pi() * (u * r / 32.0::DOUBLE + k * c / 7.0::DOUBLE))), 2)) AS m FROM d, (SELECT unnest(range(32)) AS u), (SELECT unnest(range(7)) AS k) GROUP BY 1, 2),
a AS (SELECT u, k, m / avg(m) OVER (PARTITION BY u) AS m, least(u, 31 - u) AS du, least(k, 6 - k) AS dk FROM f)
SELECT CAST(u AS INTEGER) AS "row", CAST(k AS INTEGER) AS col, round(m * CASE WHEN du < 2 THEN 0.5 - 0.5 * cos(pi() * (du + 1) / 3) ELSE 1 END * CASE WHEN dk < 2 THEN 0.5 - 0.5 * cos(pi() * (dk + 1) / 3) ELSE 1 END, 6) + 0.0 AS value FROM a""",
    "q43_compressed_backprojection": f"""
WITH s AS ({_S}), w AS (SELECT p, 0.5 - 0.5 * cos(2 * pi() * p / 63) AS w FROM (SELECT unnest(range(64)) AS p)),
t AS (SELECT k, p, w / (SELECT sum(w) FROM w) * cos(2 * pi() * (k - 64) * p / 128.0::DOUBLE) AS c, w / (SELECT sum(w) FROM w) * sin(2 * pi() * (k - 64) * p / 128.0::DOUBLE) AS d FROM w, (SELECT unnest(range(128)) AS k)),
f AS (SELECT vec_id, k, sum(v * c) AS re, sum(v * d) AS im FROM s JOIN t ON s.pos = t.p GROUP BY 1, 2),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS nth, count(*) OVER () AS n FROM embeddings),
q AS (SELECT vec_id, (0.5 - 0.5 * cos(2 * pi() * nth / (n - 1))) / ((n - 1) / 2.0::DOUBLE) AS weight, "row", col,
      sqrt(pow(100 * cos(vec_id * 0.01::DOUBLE) - (-15 + col * 3.0::DOUBLE), 2) + pow(100 * sin(vec_id * 0.01::DOUBLE) - (-15 + "row" * 5.0::DOUBLE), 2) + 400.0::DOUBLE) - sqrt(10400.0::DOUBLE) AS delta
      FROM o, (SELECT unnest(range(7)) AS "row"), (SELECT unnest(range(11)) AS col)),
i AS (SELECT *, delta / (299792458.0::DOUBLE / 2 / 128e6::DOUBLE) + 64 AS ix FROM q),
x AS (SELECT i."row", i.col, weight, delta, a.re * (1 - (ix - floor(ix))) + b.re * (ix - floor(ix)) AS re, a.im * (1 - (ix - floor(ix))) + b.im * (ix - floor(ix)) AS im, 4 * pi() * 1e8::DOUBLE / 299792458.0::DOUBLE * delta AS turn
      FROM i JOIN f a ON a.vec_id = i.vec_id AND a.k = CAST(floor(ix) AS INTEGER) JOIN f b ON b.vec_id = i.vec_id AND b.k = CAST(floor(ix) AS INTEGER) + 1)
SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(sum(weight * (re * cos(turn) - im * sin(turn))), 6) + 0.0 AS re, round(sum(weight * (re * sin(turn) + im * cos(turn))), 6) + 0.0 AS im FROM x GROUP BY 1, 2""",
    "q44_reduced_preview": f'SELECT CAST((("row" + 1) * 5 - 1) // 32 AS INTEGER) AS "row", CAST((col * 3 - 1) // 7 AS INTEGER) AS col, round(sqrt(avg(CAST(value AS DOUBLE) * value)), 6) + 0.0 AS value FROM ({_RASTER}) GROUP BY 1, 2',
    "q45_centre_phase": """
WITH g AS (SELECT CAST(l_orderkey % 32 AS INTEGER) AS r, l_linenumber - 1 AS c, sum(l_quantity) AS re, sum(l_discount * 100 - 5) AS im FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, ((r + 1) * 5 - 1) // 32 AS kr, ((c + 1) * 3 - 1) // 7 AS kc FROM g)
SELECT CAST(kr AS INTEGER) AS "row", CAST(kc AS INTEGER) AS col, round(CASE WHEN re <> 0 OR im <> 0 THEN atan2(im, re) ELSE 'NaN'::DOUBLE END, 6) + 0.0 AS value FROM k
WHERE r = (kr * 32 // 5 + (kr + 1) * 32 // 5 - 1) // 2 AND c = (kc * 7 // 3 + (kc + 1) * 7 // 3 - 1) // 2""",
    "q46_level_db": f"""
SELECT "row", col, CAST(floor(255 * least(1.0, greatest(0.0, (20 * log10(greatest(value / top, 1e-6::DOUBLE)) + 6) / 6))) AS INTEGER) AS level FROM ({_RASTER}), (SELECT max(value) AS top FROM ({_RASTER}))""",
    "q47_frame_geolocation": """
WITH k AS (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j), g AS (SELECT unnest([0, 0, 1, 1, 2, 2]) AS r, unnest([0, 1, 0, 1, 0, 1]) AS c, unnest([179.0, -179.5, 179.5, -178.5, -179.8, -177.0]::DOUBLE[]) AS lon, unnest([10.0, 10.5, 9.0, 9.4, 7.0, 7.7]::DOUBLE[]) AS lat),
a AS (SELECT c_custkey, (c_custkey % 41) / 2.0::DOUBLE AS y, (c_custkey % 37) / 3.0::DOUBLE AS x FROM customer), b AS (SELECT *, CASE WHEN y >= 8 THEN 1 ELSE 0 END AS r0, CASE WHEN y >= 8 THEN (y - 8) / 11 ELSE y / 8 END AS u, x / 11 AS v FROM a),
e AS (SELECT b.*, g.lon AS lon0, g.lat AS lat0 FROM b JOIN g ON g.r = b.r0 AND g.c = 0),
m AS (SELECT c_custkey, y, x, lon0, lat0, sum((CASE WHEN i = 1 THEN u ELSE 1 - u END) * (CASE WHEN j = 1 THEN v ELSE 1 - v END) * (g.lon - lon0 - 360 * round((g.lon - lon0) / 360))) AS dlon,
      sum((CASE WHEN i = 1 THEN u ELSE 1 - u END) * (CASE WHEN j = 1 THEN v ELSE 1 - v END) * (g.lat - lat0)) AS dlat FROM e, k JOIN g ON g.r = r0 + i AND g.c = j GROUP BY ALL)
SELECT c_custkey, CASE WHEN y <= 19 AND x <= 11 THEN round(lon0 + dlon - 360 * round((lon0 + dlon) / 360), 6) + 0.0 END AS lon, CASE WHEN y <= 19 AND x <= 11 THEN round(lat0 + dlat, 6) + 0.0 END AS lat FROM m""",
    "q48_utm": """
WITH c AS (SELECT 1 / 298.257223563::DOUBLE AS f), n AS (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM c),
k AS (SELECT *, 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS a, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM n),
p AS (SELECT c_custkey, c_custkey % 350 - 175.0::DOUBLE AS lon, c_acctbal / 200 AS lat FROM customer), z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM p),
t AS (SELECT z.*, k.*, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS l FROM z, k), u AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM t),
v AS (SELECT *, atan2(t, cos(l)) AS x, atanh(sin(l) / sqrt(1 + t * t)) AS y FROM u)
SELECT c_custkey, CASE WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS epsg,
       round(500000 + 0.9996::DOUBLE * a * (y + a1 * cos(2 * x) * sinh(2 * y) + a2 * cos(4 * x) * sinh(4 * y) + a3 * cos(6 * x) * sinh(6 * y)), 3) + 0.0 AS east,
       round(CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + 0.9996::DOUBLE * a * (x + a1 * sin(2 * x) * cosh(2 * y) + a2 * sin(4 * x) * cosh(4 * y) + a3 * sin(6 * x) * cosh(6 * y)), 3) + 0.0 AS north FROM v""",
    "q49_acquisition_match": """
WITH c AS (SELECT 'f_' || CAST(s_nationkey AS VARCHAR) AS path, s_nationkey AS n, s_suppkey AS chunk, CASE WHEN s_suppkey % 3 > 0 THEN 'stripmap' ELSE 'seaspot' END AS mode, s_suppkey * 10 AS start, 55 AS lines FROM supplier),
r AS (SELECT n, n - row_number() OVER (ORDER BY n) AS run, min(n) OVER () AS head FROM (SELECT DISTINCT n FROM c)), q AS (SELECT n FROM r WHERE run = head - 1),
m AS (SELECT * FROM c WHERE (n IN (SELECT n FROM q) OR path = 'f_7') AND CASE WHEN mode = 'stripmap' THEN 350 BETWEEN start AND start + 54 ELSE start = 350 END)
SELECT path, chunk, mode, start, lines, CAST(row_number() OVER (ORDER BY path <> 'f_7', n IN (SELECT n FROM q) DESC, n, chunk) AS INTEGER) AS rank FROM m""",
    "q50_scene_parameters": """
SELECT CAST(p_partkey AS VARCHAR) AS path, p_size * 100 * 1e6::DOUBLE AS carrier_hz, CASE WHEN p_size > 0 THEN 299792458.0::DOUBLE / (p_size * 100 * 1e6::DOUBLE) ELSE 0 END AS wavelength_m, p_size * 3 * 1e-9::DOUBLE AS pulse_s,
       p_retailprice * 1e6::DOUBLE AS sampling_hz, p_size / 2.0::DOUBLE * 1e12::DOUBLE AS fm_rate_hz_s, p_retailprice AS velocity_m_s, CAST(p_size * 1000 AS DOUBLE) AS range_m,
       round(radians(p_size * 1.5::DOUBLE), 9) + 0.0 AS eta_rad, CASE WHEN p_size % 5 > 0 THEN 1 / (p_size % 5 * 200 * 1e-6::DOUBLE) ELSE 0 END AS prf_hz, CAST(10 AS BIGINT) AS lines, 972 AS samples, 'c' AS data_type FROM part""",
    "q51_source_statistics": """
WITH t AS (SELECT CAST(s_suppkey AS DOUBLE) AS k, 9600.0::DOUBLE + s_suppkey * 0.02::DOUBLE + s_acctbal * 1e-6::DOUBLE AS f FROM supplier), r AS (SELECT regr_slope(f, k) AS step, regr_intercept(f, k) AS start FROM t)
SELECT count(*) AS samples, round(any_value(start), 6) + 0.0 AS start, round(any_value(step), 8) + 0.0 AS step, round(max(abs(f - start - step * k)), 6) + 0.0 AS error,
       round(any_value(step) * (max(k) - min(k)), 5) + 0.0 AS bandwidth_hz, round(299792458.0::DOUBLE / 2 / (any_value(step) * (max(k) - min(k))), 1) + 0.0 AS resolution_m FROM t, r""",
    "q52_tile_blend": f"""
SELECT "row", col - 1 AS col, round(value, 6) + 0.0 AS value, CAST(count(*) AS BIGINT) AS tiles FROM ({_RASTER}), (SELECT unnest(range(5)) AS ty), (SELECT unnest(range(2)) AS tx)
WHERE "row" >= ty * 7 - 2 AND "row" < (ty + 1) * 7 + 2 AND abs(ty - "row" // 7) <= 1 AND col - 1 >= tx * 4 - 2 AND col - 1 < (tx + 1) * 4 + 2 GROUP BY 1, 2, 3""",
    "q53_stage_policy": """
WITH p AS (SELECT unnest([0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]) AS kind, unnest(['raw_echo', 'range_profiles', 'complex_image', 'geocoded', 'raw_echo', 'range_profiles', 'complex_image', 'geocoded', 'raw_echo', 'range_profiles', 'complex_image', 'geocoded']) AS stage,
  unnest(['the source holds frequency samples, no raw echoes', NULL, NULL, 'the scene has no geographic origin', NULL, NULL, NULL, 'the scene has no geographic origin', 'the source is a focused image', 'the source is a focused image', NULL, NULL]) AS reason),
m AS (SELECT s_suppkey AS data_set, stage, CASE WHEN stage = 'geocoded' AND s_nationkey < 12 THEN NULL ELSE reason END AS reason FROM supplier JOIN p ON s_suppkey % 3 = kind)
SELECT data_set, stage, reason IS NULL AS available, reason FROM m""",
    "q54_colours": f"""
WITH k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([48, 50, 179, 250, 122]) AS r, unnest([18, 126, 221, 174, 4]) AS g, unnest([59, 184, 55, 34, 2]) AS b),
l AS (SELECT "row", col, CASE WHEN "row" % 8 > 0 THEN round(value / max(value) OVER (), 9) END AS v FROM ({_RASTER})), t AS (SELECT *, v * 4 AS t, least(CAST(floor(v * 4) AS INTEGER), 3) AS j FROM l)
SELECT "row", col, CASE WHEN v IS NULL THEN 0 ELSE CAST(round(x.r * (1 - (t - j)) + y.r * (t - j)) AS INTEGER) END AS red, CASE WHEN v IS NULL THEN 0 ELSE CAST(round(x.g * (1 - (t - j)) + y.g * (t - j)) AS INTEGER) END AS green,
       CASE WHEN v IS NULL THEN 0 ELSE CAST(round(x.b * (1 - (t - j)) + y.b * (t - j)) AS INTEGER) END AS blue, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS alpha FROM t LEFT JOIN k x ON x.k = j LEFT JOIN k y ON y.k = j + 1""",
    "q55_flat_grid": """
SELECT line, count(*) AS n, CAST(count(*) AS DOUBLE) AS ratios, CAST(0 AS BIGINT) AS known FROM (SELECT s_suppkey AS line FROM supplier UNION ALL SELECT s_suppkey + greatest(1, s_nationkey % 4) FROM supplier) GROUP BY 1""",
    "q56_merged_mask": f'SELECT "row", count(*) AS n, round(sum(CASE WHEN col % 3 <> 0 THEN value END), 6) + 0.0 AS kept FROM ({_RASTER}) GROUP BY 1',
    "q57_edge_taper_2d": f"""
SELECT "row", c AS col, round(value * CASE WHEN du < 3 THEN 0.5 - 0.5 * cos(pi() * (du + 1) / 4) ELSE 1 END * CASE WHEN dk < 3 THEN 0.5 - 0.5 * cos(pi() * (dk + 1) / 4) ELSE 1 END, 6) + 0.0 AS value
FROM (SELECT "row", col - 1 AS c, value, least("row", 31 - "row") AS du, least(col - 1, 7 - col) AS dk FROM ({_RASTER}))""",
    "q58_grid_coordinates": """
WITH k AS (SELECT s_suppkey * 40 AS low, s_acctbal / 97 AS a, s_nationkey AS s, lead(s_suppkey * 40) OVER w AS high, lead(s_acctbal / 97) OVER w AS b, lead(s_nationkey) OVER w AS t FROM supplier WINDOW w AS (ORDER BY s_suppkey)),
i AS (SELECT * FROM k WHERE high IS NOT NULL), f AS (SELECT * FROM i ORDER BY low LIMIT 1), o AS (SELECT o_orderkey, o_orderkey % 23 AS pixel FROM orders),
m AS (SELECT o.*, coalesce(i.low, f.low) AS low, coalesce(i.high, f.high) AS high, coalesce(i.a, f.a) AS a, coalesce(i.b, f.b) AS b, coalesce(i.s, f.s) AS s, coalesce(i.t, f.t) AS t FROM o ASOF LEFT JOIN i ON o_orderkey >= i.low, f),
v AS (SELECT o_orderkey, pixel, a + (o_orderkey - low) / CAST(high - low AS DOUBLE) * (b - a) AS base, s + (o_orderkey - low) / CAST(high - low AS DOUBLE) * (t - s) AS step FROM m),
c AS (SELECT *, CASE WHEN pixel < 10 THEN (pixel - 1) / 9.0::DOUBLE ELSE 1 + (pixel - 10) / 10.0::DOUBLE END AS u FROM v)
SELECT o_orderkey, round(base + 3 * u * step, 5) + 0.0 AS latitude, round(base + (3 * u + 1) * step, 5) + 0.0 AS longitude, round(base + (3 * u + 2) * step, 5) + 0.0 AS ratio FROM c""",
    "q59_geolocation_grid": """
WITH g AS (SELECT s_suppkey, 2 + s_suppkey % 50 AS h, 2 + s_nationkey * 3 AS w, s_acctbal * 1e-9::DOUBLE AS bend FROM supplier), n AS (SELECT *, least(h, 9) AS nr, least(w, 9) AS nc FROM g),
k AS (SELECT n.*, i, j, i * (h - 1) / CAST(nr - 1 AS DOUBLE) AS r, j * (w - 1) / CAST(nc - 1 AS DOUBLE) AS c FROM n, (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j) WHERE i < nr AND j < nc),
f AS (SELECT *, 179.99::DOUBLE + 0.001::DOUBLE * c + bend * r * c AS lon, 60.0::DOUBLE - 0.0005::DOUBLE * r + bend * r * c AS lat FROM k),
s AS (SELECT s_suppkey, count(*) AS knots, max(lon) AS east, min(lat) AS south, min_by(lon, i * 100 + j) AS lon0 FROM f GROUP BY 1),
m AS (SELECT a.s_suppkey, (a.r + d.r) / 2 AS r, (a.c + d.c) / 2 AS c, a.bend, (a.lon + b.lon + e.lon + d.lon) / 4 AS lon, (a.lat + b.lat + e.lat + d.lat) / 4 AS lat
  FROM f a JOIN f b ON a.s_suppkey = b.s_suppkey AND b.i = a.i + 1 AND b.j = a.j JOIN f e ON a.s_suppkey = e.s_suppkey AND e.i = a.i AND e.j = a.j + 1 JOIN f d ON a.s_suppkey = d.s_suppkey AND d.i = a.i + 1 AND d.j = a.j + 1),
t AS (SELECT s_suppkey, max(6371008.8::DOUBLE * sqrt(pow(radians(lat - (60.0::DOUBLE - 0.0005::DOUBLE * r + bend * r * c)), 2) + pow(radians(lon - (179.99::DOUBLE + 0.001::DOUBLE * c + bend * r * c)) * cos(radians(60.0::DOUBLE - 0.0005::DOUBLE * r + bend * r * c)), 2))) AS e FROM m GROUP BY 1)
SELECT s.s_suppkey, knots, round(east - 360 * round(lon0 / 360), 9) + 0.0 AS east, round(south, 9) + 0.0 AS south, round(e, 5) + 0.0 AS residual_m FROM s JOIN t ON s.s_suppkey = t.s_suppkey""",
    "q60_sensor_metadata": """
WITH d AS (SELECT s_suppkey, s_nationkey - 2 AS v, s_suppkey % 3 AS u, s_nationkey * 4.0::DOUBLE AS g, s_suppkey % 40 AS p, s_suppkey % 2 AS skew FROM supplier)
SELECT s_suppkey, CASE WHEN u < 2 AND v > 0 THEN round(v * CASE WHEN u = 0 THEN 1 ELSE 0.3048::DOUBLE END, 6) + 0.0 END AS row_spacing_m, CASE WHEN g <= 90 THEN g END AS graze_deg, CASE WHEN p BETWEEN 1 AND 30 THEN CAST(p - 1 AS INTEGER) END AS reference_row,
       CASE WHEN skew = 0 THEN 3 END AS parts, CAST(CAST((u = 2 OR v <= 0) AS INTEGER) + CAST(g > 90 AS INTEGER) + CAST(p NOT BETWEEN 1 AND 30 AS INTEGER) + skew AS INTEGER) AS n_issues,
       CASE WHEN u = 2 OR v <= 0 OR g > 90 OR p NOT BETWEEN 1 AND 30 OR skew = 1 THEN 'issues_found' ELSE 'checked' END AS status FROM d""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
