"""Equivalent SQL of the queries in ``general``, for DuckDB."""

NAME = """CASE WHEN lower(trim({c})) IN ('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'dev-') THEN NULL ELSE trim({c}) END"""
NUMBER = """CASE WHEN isnan({c}) OR {c} IN (-999, -9999, -99999) THEN NULL ELSE {c} END"""
# Seconds of the local time less the stated offset.
EPOCH_US = r"""CASE WHEN regexp_matches(trim({c}), '^\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{1,9}})?\s*(UTC|GMT|Z|[+-]\d{{2}}:?\d{{2}})?$') THEN
  epoch_us(TRY_CAST(replace(regexp_replace(trim({c}), '\s*(UTC|GMT|Z|[+-]\d{{2}}:?\d{{2}})$', ''), 'T', ' ') AS TIMESTAMP))
  - CASE WHEN regexp_matches(trim({c}), '[+-]\d{{2}}:?\d{{2}}$') AND NOT regexp_matches(trim({c}), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN
      (CASE WHEN regexp_extract(trim({c}), '([+-])\d{{2}}:?\d{{2}}$', 1) = '-' THEN -1 ELSE 1 END)
      * (CAST(regexp_extract(trim({c}), '[+-](\d{{2}}):?\d{{2}}$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(trim({c}), '[+-]\d{{2}}:?(\d{{2}})$', 1) AS BIGINT) * 60) * 1000000
    ELSE 0 END END"""

PLACES = """
WITH d AS (SELECT DISTINCT deviceId AS id, latitude AS lat, longitude AS lon FROM devices
           WHERE deviceId IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90
             AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
     w AS (SELECT DISTINCT station_id AS id, latitude AS lat, longitude AS lon FROM weather_cache
           WHERE station_id IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90
             AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))"""
DISTANCE = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(ob - oa) / 2), 2))))"
PAIRS = PLACES + """,
     p AS (SELECT a.id AS a, b.id AS b, 300 AS r, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob FROM d a JOIN d b ON a.id < b.id AND abs(a.lat - b.lat) < 0.003
           UNION ALL
           SELECT a.id, b.id, 7000, a.lat, a.lon, b.lat, b.lon FROM d a JOIN w b ON abs(a.lat - b.lat) < 0.07)"""

SQL = {
    "p3_found": PAIRS
    + f" SELECT DISTINCT least(a, b) AS loc_a, greatest(a, b) AS loc_b FROM p WHERE {DISTANCE} <= r",
    "p3_pairs": PAIRS
    + f" SELECT least(a, b) AS loc_a, greatest(a, b) AS loc_b, round(min({DISTANCE}), 3) AS metres FROM p WHERE {DISTANCE} <= r GROUP BY 1, 2",
    "p3_regions": PLACES
    + """ SELECT DISTINCT d.id AS "deviceId", w.id AS station_id FROM d JOIN w ON abs(d.lat - w.lat) <= 0.5 AND abs(d.lat - w.lat) + abs(d.lon - w.lon) <= 0.5 AND NOT (abs(d.lat - w.lat) < 0.1 AND abs(d.lon - w.lon) < 0.1)""",
    "p4_found": f"""
WITH r AS (SELECT reading_id, batch_id, period, {NAME.format(c="deviceId")} AS name, {NUMBER.format(c="x2")} AS x2, {NUMBER.format(c="t4")} AS t4 FROM device_data),
     b AS (SELECT batch_id, min(name) AS named FROM r WHERE name IS NOT NULL GROUP BY 1),
     k AS (SELECT r.*, coalesce(name, named) AS dev FROM r LEFT JOIN b USING (batch_id)),
     h AS (SELECT dev, count(x2) AS n2, count(t4) AS n4 FROM k GROUP BY 1)
SELECT reading_id, 'deviceId' AS field FROM k WHERE name IS NULL AND dev IS NOT NULL
UNION ALL SELECT reading_id, 't4' FROM k JOIN h USING (dev) WHERE t4 IS NULL AND n4 > 0
UNION ALL SELECT reading_id, 'x2' FROM k JOIN h USING (dev) WHERE x2 IS NULL AND period = 'train' AND n2 > 0
""",
    "p6_found": f"""
WITH r AS (SELECT DISTINCT {NAME.format(c="deviceId")} AS dev, CAST(floor(({EPOCH_US.format(c="timedate")}) / 300000000.0) AS BIGINT) AS slot FROM device_data),
     u AS (SELECT dev, slot FROM r WHERE dev IS NOT NULL AND slot IS NOT NULL),
     g AS (SELECT dev, unnest(range(min(slot), max(slot) + 1)) AS slot FROM u GROUP BY dev)
SELECT g.dev AS "deviceId", g.slot * 300 AS slot_epoch FROM g ANTI JOIN u ON g.dev = u.dev AND g.slot = u.slot
""",
    "p2_stuck": f"""
WITH r AS (SELECT reading_id, batch_id, {NAME.format(c="deviceId")} AS name, {EPOCH_US.format(c="timedate")} AS us, x2, t8 FROM device_data), b AS (SELECT batch_id, min(name) AS named FROM r WHERE name IS NOT NULL GROUP BY 1),
     k AS (SELECT reading_id, coalesce(name, named) AS dev, us, x2, t8 FROM r LEFT JOIN b USING (batch_id)),
     f AS (SELECT reading_id, dev, us, 'x2' AS field, x2 AS v, 0 AS lo, 1 AS hi, 0.001 AS idle FROM k UNION ALL SELECT reading_id, dev, us, 't8', t8, -70, 120, -1e9 FROM k),
     d AS (SELECT DISTINCT field, dev, us, v, idle FROM f WHERE dev IS NOT NULL AND us IS NOT NULL AND v BETWEEN lo AND hi AND NOT isnan(v)),
     g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY field, dev ORDER BY us, v) AS run FROM (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY field, dev ORDER BY us, v) AS new FROM d)),
     q AS (SELECT *, count(*) OVER w AS n, max(us) OVER w - min(us) OVER w AS long FROM g WINDOW w AS (PARTITION BY field, dev, run)),
     s AS (SELECT field, dev, us, v FROM q WHERE n >= 12 AND long >= 90 * 60000000::BIGINT AND v > idle)
SELECT reading_id, field, v AS value, 'impossible' AS reason FROM f WHERE NOT isnan(v) AND (v < lo OR v > hi) UNION ALL SELECT f.reading_id, f.field, f.v, 'stuck' FROM f JOIN s USING (field, dev, us, v)
""",
    "p4_filled": f"""
WITH r AS (SELECT reading_id, batch_id, period, {NAME.format(c="deviceId")} AS name, {EPOCH_US.format(c="timedate")} AS us, {NUMBER.format(c="x2")} AS x2, {NUMBER.format(c="t4")} AS t4, {NAME.format(c='"deviceType"')} AS kind FROM device_data),
     b AS (SELECT batch_id, min(name) AS named, min(us) AS lo, max(us) AS hi FROM r WHERE name IS NOT NULL GROUP BY 1),
     k AS (SELECT r.*, coalesce(name, named) AS dev, named, lo, hi FROM r LEFT JOIN b USING (batch_id)),
     m AS (SELECT dev, avg(x2) AS mx2, avg(t4) AS mt4 FROM k GROUP BY 1),
     o AS (SELECT *, {", ".join(f"last_value(CASE WHEN {c} IS NOT NULL THEN us END IGNORE NULLS) OVER back AS {c}_u0, last_value({c} IGNORE NULLS) OVER back AS {c}_v0, first_value(CASE WHEN {c} IS NOT NULL THEN us END IGNORE NULLS) OVER ahead AS {c}_u1, first_value({c} IGNORE NULLS) OVER ahead AS {c}_v1" for c in ("x2", "t4", "kind"))}
           FROM k WHERE dev IS NOT NULL AND us IS NOT NULL WINDOW back AS (PARTITION BY dev ORDER BY us, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY dev ORDER BY us, reading_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
     n AS ({" UNION ALL ".join(f"SELECT reading_id, '{c}' AS field, us, {c}_u0 AS u0, {c}_v0 AS v0, {c}_u1 AS u1, {c}_v1 AS v1 FROM o WHERE {c} IS NULL{more}" for c, more in (("x2", " AND period = 'train'"), ("t4", "")))})
SELECT reading_id, field, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR u1 <= u0 THEN v0 ELSE v0 + (v1 - v0) * (us - u0) / (u1 - u0) END, 6) AS value, NULL AS text, CASE WHEN v0 IS NULL OR v1 IS NULL THEN 'carried' ELSE 'interpolated' END AS method,
       round(least(us - u0, u1 - us) / 1e6, 3) AS distance_s FROM n WHERE v0 IS NOT NULL OR v1 IS NOT NULL
UNION ALL SELECT reading_id, 'deviceType', NULL, CASE WHEN later THEN kind_v1 ELSE kind_v0 END, 'carried', round(least(us - kind_u0, kind_u1 - us) / 1e6, 3) FROM (SELECT *, kind_u0 IS NULL OR coalesce(kind_u1 - us < us - kind_u0, FALSE) AS later FROM o WHERE kind IS NULL) WHERE least(us - kind_u0, kind_u1 - us) <= 180 * 60000000::BIGINT
UNION ALL SELECT reading_id, 'deviceId', NULL, named, 'batch', CASE WHEN us IS NOT NULL AND lo IS NOT NULL THEN round(greatest(lo - us, us - hi, 0) / 1e6, 3) END FROM k WHERE name IS NULL AND named IS NOT NULL
UNION ALL SELECT reading_id, 'x2', round(mx2, 6), NULL, 'mean', NULL FROM k JOIN m USING (dev) WHERE us IS NULL AND x2 IS NULL AND period = 'train' AND mx2 IS NOT NULL
UNION ALL SELECT reading_id, 't4', round(mt4, 6), NULL, 'mean', NULL FROM k JOIN m USING (dev) WHERE us IS NULL AND t4 IS NULL AND mt4 IS NOT NULL
""",
    "p6_grid": f"""
WITH r AS (SELECT DISTINCT {NAME.format(c="deviceId")} AS dev, {EPOCH_US.format(c="timedate")} AS us, {NUMBER.format(c="x2")} AS x2, {NUMBER.format(c="t4")} AS t4 FROM device_data),
     u AS (SELECT *, CAST(floor(us / 300000000.0) AS BIGINT) AS slot FROM r WHERE dev IS NOT NULL AND us IS NOT NULL),
     g AS (SELECT dev, unnest(range(min(slot), max(slot) + 1)) AS slot FROM u GROUP BY dev), a AS (SELECT dev, slot, count(*) AS n, avg(x2) AS x2, avg(t4) AS t4 FROM u GROUP BY 1, 2),
     c AS (SELECT dev, slot, slot * 300000000 + 150000000 AS mid, coalesce(n, 0) AS n, x2, t4 FROM g LEFT JOIN a USING (dev, slot)),
     {", ".join(f"{c}_o AS (SELECT dev, us, max({c}) AS last, min({c}) AS first FROM u WHERE {c} IS NOT NULL GROUP BY 1, 2)" for c in ("x2", "t4"))},
     {", ".join(f"{c}_f AS (SELECT c.dev, c.slot, p.us AS u0, p.last AS v0, f.us AS u1, f.first AS v1 FROM c ASOF LEFT JOIN {c}_o p ON c.dev = p.dev AND c.mid >= p.us ASOF LEFT JOIN {c}_o f ON c.dev = f.dev AND c.mid <= f.us WHERE c.{c} IS NULL)" for c in ("x2", "t4"))}
SELECT c.dev AS "deviceId", c.slot * 300 AS slot_epoch, n AS n_readings,
       {", ".join(f"round(coalesce(c.{c}, CASE WHEN {c}_f.u1 - {c}_f.u0 <= 3600000000 THEN {c}_f.v0 + ({c}_f.v1 - {c}_f.v0) * (c.mid - {c}_f.u0) / ({c}_f.u1 - {c}_f.u0) END), 6) AS {c}, CASE WHEN c.{c} IS NOT NULL THEN 'observed' WHEN {c}_f.u1 - {c}_f.u0 <= 3600000000 THEN 'interpolated' ELSE 'missing' END AS {c}_state" for c in ("x2", "t4"))}
FROM c LEFT JOIN x2_f ON c.dev = x2_f.dev AND c.slot = x2_f.slot LEFT JOIN t4_f ON c.dev = t4_f.dev AND c.slot = t4_f.slot
""",
}
