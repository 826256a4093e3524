"""The result of each registered query as SQL for DuckDB, over the test tables.

Written from the definition of each operator, and independent of the Spark code:
ids come from plain ``row_number``, cubes from the star joined back together.
Means are rounded as described in ``queries``.
"""

from __future__ import annotations

CATALOG = """
located AS (
  SELECT event_id, user_id, value, n_name, ts - to_days(CAST(event_id % 1461 AS INT)) AS ot
  FROM events JOIN nation ON n_nationkey = user_id % 25),
issued AS (
  SELECT located.*, 0 AS rev FROM located
  UNION ALL SELECT located.*, 1 AS rev FROM located WHERE event_id % 50 = 0
  UNION ALL SELECT located.*, 0 AS rev FROM located WHERE event_id % 125 = 0),
raw AS (
  SELECT
    strftime(ot + to_seconds(rev), '%Y-%m-%dT%H:%M:%S.%gZ') AS time,
    CASE WHEN event_id % 307 = 3 THEN CAST(95 AS DOUBLE)
         ELSE CAST((user_id * 7919) % 18001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) END AS latitude,
    CAST((user_id * 104729) % 36001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
    CASE WHEN event_id % 89 = 5 THEN NULL
         WHEN event_id % 211 = 7 THEN CAST(1200 AS DOUBLE)
         ELSE CAST((event_id * 37) % 700 AS DOUBLE) END AS depth,
    CASE WHEN event_id % 97 = 11 THEN NULL
         ELSE (floor(value / CAST(5 AS DOUBLE)) + CAST(15 AS DOUBLE)) / CAST(10 AS DOUBLE) END AS mag,
    CASE event_id % 4 WHEN 0 THEN 'mb' WHEN 1 THEN 'ml' WHEN 2 THEN 'mww' END AS "magType",
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 120 AS INT) END AS nst,
    CAST((event_id * 13) % 360 AS DOUBLE) AS gap,
    CAST((event_id * 7) % 500 AS DOUBLE) / CAST(100 AS DOUBLE) AS dmin,
    CAST((event_id * 3) % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS rms,
    CASE event_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ci' END AS net,
    concat('ev', CAST(event_id AS VARCHAR)) AS id,
    strftime(ot + to_days(CAST(1 + rev AS INT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated,
    CASE WHEN event_id % 101 = 13 THEN NULL
         WHEN event_id % 10 = 1 THEN concat(n_name, ' region')
         ELSE concat(CAST(user_id % 200 AS VARCHAR), ' km SSE of ', n_name) END AS place,
    'earthquake' AS type,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) / CAST(10 AS DOUBLE) END AS "horizontalError",
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) / CAST(10 AS DOUBLE) END AS "depthError",
    CAST(event_id % 9 AS DOUBLE) / CAST(100 AS DOUBLE) AS "magError",
    CAST(event_id % 60 AS INT) AS "magNst",
    CASE WHEN rev = 1 THEN 'reviewed' ELSE 'automatic' END AS status,
    'us' AS "locationSource",
    'us' AS "magSource"
  FROM issued),
conformed AS (
  SELECT time, latitude, longitude, depth, mag AS magnitude, "magType" AS magnitude_type,
    nst AS num_stations, gap AS azimuthal_gap, dmin AS min_distance, rms, net AS network,
    id AS event_id, updated, place, type AS event_type, "horizontalError" AS horizontal_error,
    "depthError" AS depth_error, "magError" AS magnitude_error, "magNst" AS magnitude_stations,
    status, "locationSource" AS location_source, "magSource" AS magnitude_source
  FROM raw),
clean AS (
  SELECT * REPLACE (coalesce(depth, 0.0) AS depth, coalesce(place, 'Unknown') AS place)
  FROM conformed
  WHERE time IS NOT NULL AND magnitude >= -2 AND magnitude <= 10
    AND coalesce(depth, 0.0) >= -10 AND coalesce(depth, 0.0) <= 1000
    AND latitude >= -90 AND latitude <= 90 AND longitude >= -180 AND longitude <= 180),
timed AS (
  SELECT *, CAST(strptime(time, '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP) AS datetime FROM clean),
angles AS (
  SELECT *, (epoch_us(datetime) - 946728000000000 + 69000000) / 3155760000000000.0 AS t FROM timed),
lunar AS (
  SELECT * EXCLUDE (t),
    297.8501921 + 445267.1114034 * t AS d,
    357.5291092 + 35999.0502909 * t AS m,
    134.9633964 + 477198.8675055 * t AS n,
    93.2720950 + 483202.0175233 * t AS f
  FROM angles),
phased AS (
  SELECT * EXCLUDE (d, m, n, f),
    (d + 6.288774 * sin(radians(n)) - (0.185116 + 1.914602) * sin(radians(m)) - 0.019993 * sin(radians(2 * m))
       - 0.000289 * sin(radians(3 * m)) + 1.274027 * sin(radians(2 * d - n)) + 0.658314 * sin(radians(2 * d))
       + 0.213618 * sin(radians(2 * n)) - 0.114332 * sin(radians(2 * f)) + 0.058793 * sin(radians(2 * d - 2 * n))
       + 0.057066 * sin(radians(2 * d - m - n)) + 0.053322 * sin(radians(2 * d + n))
       + 0.045758 * sin(radians(2 * d - m)) + 0.040923 * sin(radians(n - m)) - 0.034720 * sin(radians(d))
       - 0.030383 * sin(radians(m + n)) + 0.015327 * sin(radians(2 * d - 2 * f))
       - 0.012528 * sin(radians(n + 2 * f)) + 0.010980 * sin(radians(n - 2 * f))
       + 0.010675 * sin(radians(4 * d - n)) + 0.010034 * sin(radians(3 * n))) / 360 AS turns
  FROM lunar),
enriched AS (
  SELECT * EXCLUDE (turns),
    CAST(year(datetime) AS INT) AS year, CAST(month(datetime) AS INT) AS month,
    CAST(day(datetime) AS INT) AS day, CAST(hour(datetime) AS INT) AS hour,
    CAST(isodow(datetime) AS INT) AS day_of_week,
    CASE WHEN magnitude < 3 THEN 'Minor' WHEN magnitude < 5 THEN 'Light'
         WHEN magnitude < 6 THEN 'Moderate' WHEN magnitude < 7 THEN 'Strong'
         WHEN magnitude < 8 THEN 'Major' ELSE 'Great' END AS magnitude_category,
    CASE WHEN depth < 70 THEN 'Shallow' WHEN depth < 300 THEN 'Intermediate' ELSE 'Deep' END AS depth_category,
    string_split(place, ' of ')[-1] AS region,
    turns - floor(turns) AS moon_phase,
    CASE WHEN turns - floor(turns) < 0.0625 OR turns - floor(turns) >= 0.9375 THEN 'New Moon'
         WHEN turns - floor(turns) < 0.1875 THEN 'Waxing Crescent'
         WHEN turns - floor(turns) < 0.3125 THEN 'First Quarter'
         WHEN turns - floor(turns) < 0.4375 THEN 'Waxing Gibbous'
         WHEN turns - floor(turns) < 0.5625 THEN 'Full Moon'
         WHEN turns - floor(turns) < 0.6875 THEN 'Waning Gibbous'
         WHEN turns - floor(turns) < 0.8125 THEN 'Last Quarter'
         ELSE 'Waning Crescent' END AS moon_phase_name
  FROM phased),
silver AS (
  SELECT * FROM enriched
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY datetime DESC, updated DESC) = 1)
"""

# The class bounds and names in these relations are fixed values of the data model.
STAR = """
dim_time AS (
  SELECT row_number() OVER (ORDER BY datetime) AS time_id, datetime,
    CAST(date_trunc('day', datetime) AS TIMESTAMP) AS date, year, month, day, hour, day_of_week,
    dayname(datetime) AS day_name,
    CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month <= 5 THEN 'Spring'
         WHEN month <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
    day_of_week >= 6 AS is_weekend
  FROM (SELECT DISTINCT datetime, year, month, day, hour, day_of_week FROM silver)),
dim_location AS (
  SELECT row_number() OVER (ORDER BY latitude, longitude, place, region) AS location_id,
    latitude, longitude, place, region,
    CASE WHEN latitude >= 0 THEN 'Northern' ELSE 'Southern' END AS hemisphere_ns,
    CASE WHEN longitude >= 0 THEN 'Eastern' ELSE 'Western' END AS hemisphere_ew,
    CASE WHEN latitude BETWEEN -23.5 AND 23.5 THEN 'Tropical'
         WHEN latitude BETWEEN 23.5 AND 66.5 OR latitude BETWEEN -66.5 AND -23.5 THEN 'Temperate'
         ELSE 'Polar' END AS climate_zone
  FROM (SELECT DISTINCT latitude, longitude, coalesce(place, 'Unknown') AS place,
          coalesce(region, 'Unknown') AS region FROM silver)),
dim_magnitude AS (
  SELECT row_number() OVER (ORDER BY magnitude, magnitude_type, magnitude_category) AS magnitude_id,
    magnitude, magnitude_category, magnitude_type,
    CASE WHEN magnitude < 2 THEN 'Micro - Not felt' WHEN magnitude < 3 THEN 'Minor - Rarely felt'
         WHEN magnitude < 4 THEN 'Light - Often felt, rarely causes damage'
         WHEN magnitude < 5 THEN 'Moderate - Notable shaking, slight damage'
         WHEN magnitude < 6 THEN 'Strong - Can cause damage in populated areas'
         WHEN magnitude < 7 THEN 'Major - Serious damage over large areas'
         WHEN magnitude < 8 THEN 'Great - Serious damage over very large areas'
         ELSE 'Epic - Devastating over extremely large areas' END AS effects_description,
    pow(10.0, 1.5 * magnitude + 4.8) AS energy_joules
  FROM (SELECT DISTINCT magnitude, coalesce(magnitude_type, 'Unknown') AS magnitude_type,
          magnitude_category FROM silver)),
fact AS (
  SELECT s.event_id AS earthquake_id, time_id, location_id, magnitude_id, s.event_id,
    coalesce(s.depth, 0.0) AS depth, coalesce(s.depth_category, 'Unknown') AS depth_category,
    coalesce(CAST(s.num_stations AS INT), 0) AS num_stations,
    coalesce(s.azimuthal_gap, 0.0) AS azimuthal_gap, coalesce(s.min_distance, 0.0) AS min_distance,
    coalesce(s.rms, 0.0) AS rms, coalesce(s.horizontal_error, 0.0) AS horizontal_error,
    coalesce(s.depth_error, 0.0) AS depth_error, coalesce(s.magnitude_error, 0.0) AS magnitude_error,
    coalesce(s.network, 'Unknown') AS network, coalesce(s.status, 'Unknown') AS status,
    coalesce(s.event_type, 'Unknown') AS event_type, coalesce(s.moon_phase, 0.0) AS moon_phase,
    coalesce(s.moon_phase_name, 'Unknown') AS moon_phase_name
  FROM silver s
  LEFT JOIN dim_time t ON s.datetime = t.datetime
  LEFT JOIN dim_location l ON s.latitude = l.latitude AND s.longitude = l.longitude
    AND coalesce(s.place, 'Unknown') = l.place AND coalesce(s.region, 'Unknown') = l.region
  LEFT JOIN dim_magnitude m ON s.magnitude = m.magnitude
    AND coalesce(s.magnitude_type, 'Unknown') = m.magnitude_type
    AND s.magnitude_category = m.magnitude_category),
star AS (
  SELECT f.*, t.datetime, t.date, t.year, t.month, t.day, t.hour, t.day_of_week, t.day_name, t.season,
    t.is_weekend, l.latitude, l.longitude, l.place, l.region, l.hemisphere_ns, l.hemisphere_ew,
    l.climate_zone, m.magnitude, m.magnitude_category, m.magnitude_type, m.effects_description,
    m.energy_joules,
    CASE WHEN m.magnitude < 4 THEN '1-3' WHEN m.magnitude < 5 THEN '4' WHEN m.magnitude < 6 THEN '5'
         WHEN m.magnitude < 8 THEN '6-7' ELSE '8-9' END AS magnitude_group
  FROM fact f JOIN dim_time t USING (time_id) JOIN dim_location l USING (location_id)
    JOIN dim_magnitude m USING (magnitude_id))
"""

CUBES = """
cube_time AS (
  SELECT year, month, day_name, hour, season, is_weekend, magnitude_category,
    count(*) AS event_count, avg(magnitude) AS avg_magnitude, min(magnitude) AS min_magnitude,
    max(magnitude) AS max_magnitude, avg(depth) AS avg_depth, sum(energy_joules) AS total_energy
  FROM star GROUP BY ALL),
cube_location AS (
  SELECT region, hemisphere_ns, hemisphere_ew, climate_zone, magnitude_category,
    count(*) AS event_count, avg(magnitude) AS avg_magnitude, max(magnitude) AS max_magnitude,
    avg(depth) AS avg_depth, avg(latitude) AS center_latitude, avg(longitude) AS center_longitude
  FROM star GROUP BY ALL),
cube_depth AS (
  SELECT depth_category, magnitude_category, season, count(*) AS event_count,
    avg(depth) AS avg_depth, avg(magnitude) AS avg_magnitude, avg(num_stations) AS avg_stations,
    avg(azimuthal_gap) AS avg_gap, avg(horizontal_error) AS avg_horizontal_error,
    avg(depth_error) AS avg_depth_error
  FROM star GROUP BY ALL),
cube_trends AS (
  SELECT date, year, month, day_of_week, count(*) AS daily_event_count,
    avg(magnitude) AS daily_avg_magnitude, max(magnitude) AS daily_max_magnitude,
    sum(energy_joules) AS daily_total_energy, count(DISTINCT region) AS affected_regions
  FROM star GROUP BY ALL),
cube_moon AS (
  SELECT moon_phase_name, round(moon_phase, 6) AS moon_phase, magnitude_group,
    count(*) AS event_count, avg(magnitude) AS avg_magnitude, max(magnitude) AS max_magnitude,
    avg(depth) AS avg_depth
  FROM star GROUP BY ALL),
trend AS (
  SELECT date, year, month, day_of_week, count(*) AS daily_event_count,
    avg(magnitude) AS daily_avg_magnitude, max(magnitude) AS daily_max_magnitude,
    sum(energy_joules) AS daily_total_energy, count(DISTINCT region) AS affected_regions
  FROM star WHERE magnitude >= 5.5 GROUP BY ALL),
moon AS (
  SELECT moon_phase_name, round(moon_phase, 6) AS moon_phase, magnitude_group,
    count(*) AS event_count, avg(magnitude) AS avg_magnitude, max(magnitude) AS max_magnitude,
    avg(depth) AS avg_depth
  FROM star WHERE magnitude >= 5.5 GROUP BY ALL),
map AS (
  SELECT event_id, datetime, latitude, longitude, place, region, magnitude, magnitude_category,
    depth, depth_category
  FROM star WHERE magnitude >= 4 ORDER BY magnitude DESC, datetime DESC, event_id LIMIT 100)
"""

RAW_COLUMNS = (
    'time, latitude, longitude, depth, mag, "magType", CAST(nst AS DOUBLE) AS nst, gap, dmin, rms, net, id, updated, place, '
    'type, "horizontalError", "depthError", "magError", "magNst", status, "locationSource", "magSource"'
)

# The first broken rule of a conformed row.
FAILED_RULE = """
CASE WHEN time IS NULL THEN 'time_present' WHEN latitude IS NULL THEN 'latitude_present'
     WHEN longitude IS NULL THEN 'longitude_present' WHEN magnitude IS NULL THEN 'magnitude_present'
     WHEN NOT (magnitude BETWEEN -2 AND 10) THEN 'magnitude_in_range'
     WHEN NOT (coalesce(depth, 0.0) BETWEEN -10 AND 1000) THEN 'depth_in_range'
     WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'coordinates_on_globe'
END"""

SILVER_ROUNDED = """
SELECT * REPLACE (
  CAST(num_stations AS DOUBLE) AS num_stations,
  round(latitude + 1e-9, 6) AS latitude, round(longitude + 1e-9, 6) AS longitude, round(depth + 1e-9, 6) AS depth,
  round(magnitude + 1e-9, 6) AS magnitude, round(azimuthal_gap + 1e-9, 6) AS azimuthal_gap,
  round(min_distance + 1e-9, 6) AS min_distance, round(rms + 1e-9, 6) AS rms,
  round(horizontal_error + 1e-9, 6) AS horizontal_error, round(depth_error + 1e-9, 6) AS depth_error,
  round(magnitude_error + 1e-9, 6) AS magnitude_error, round(moon_phase + 1e-9, 6) AS moon_phase)
FROM silver"""

FACT_ROUNDED = """
SELECT * REPLACE (
  round(depth + 1e-9, 6) AS depth, round(azimuthal_gap + 1e-9, 6) AS azimuthal_gap,
  round(min_distance + 1e-9, 6) AS min_distance, round(rms + 1e-9, 6) AS rms,
  round(horizontal_error + 1e-9, 6) AS horizontal_error, round(depth_error + 1e-9, 6) AS depth_error,
  round(magnitude_error + 1e-9, 6) AS magnitude_error, round(moon_phase + 1e-9, 6) AS moon_phase)
FROM fact"""

CUBE_TIME = """
SELECT year, month, day_name, hour, season, is_weekend, magnitude_category, event_count,
  round(avg_magnitude + 1e-9, 6) AS avg_magnitude, round(min_magnitude + 1e-9, 6) AS min_magnitude,
  round(max_magnitude + 1e-9, 6) AS max_magnitude, round(avg_depth + 1e-9, 6) AS avg_depth,
  round(log10(total_energy) + 1e-9, 6) AS total_energy
FROM cube_time"""

CUBE_LOCATION = """
SELECT region, hemisphere_ns, hemisphere_ew, climate_zone, magnitude_category, event_count,
  round(avg_magnitude + 1e-9, 6) AS avg_magnitude, round(max_magnitude + 1e-9, 6) AS max_magnitude,
  round(avg_depth + 1e-9, 6) AS avg_depth, round(center_latitude + 1e-9, 6) AS center_latitude,
  round(center_longitude + 1e-9, 6) AS center_longitude
FROM cube_location"""

CUBE_DEPTH = """
SELECT depth_category, magnitude_category, season, event_count, round(avg_depth + 1e-9, 6) AS avg_depth,
  round(avg_magnitude + 1e-9, 6) AS avg_magnitude, round(avg_stations + 1e-9, 6) AS avg_stations,
  round(avg_gap + 1e-9, 6) AS avg_gap, round(avg_horizontal_error + 1e-9, 6) AS avg_horizontal_error,
  round(avg_depth_error + 1e-9, 6) AS avg_depth_error
FROM cube_depth"""

TRENDS = """
SELECT date, year, month, day_of_week, daily_event_count,
  round(daily_avg_magnitude + 1e-9, 6) AS daily_avg_magnitude,
  round(daily_max_magnitude + 1e-9, 6) AS daily_max_magnitude,
  round(log10(daily_total_energy) + 1e-9, 6) AS daily_total_energy, affected_regions
FROM {table}"""

MOON = """
SELECT moon_phase_name, moon_phase, magnitude_group, event_count,
  round(avg_magnitude + 1e-9, 6) AS avg_magnitude, round(max_magnitude + 1e-9, 6) AS max_magnitude,
  round(avg_depth + 1e-9, 6) AS avg_depth
FROM {table}"""

REGIONS = """
SELECT region, CAST(sum(event_count) AS BIGINT) AS event_count,
  round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude, round(max(max_magnitude) + 1e-9, 6) AS max_magnitude,
  round(avg(center_latitude) + 1e-9, 6) AS center_latitude,
  round(avg(center_longitude) + 1e-9, 6) AS center_longitude
FROM cube_location {where} GROUP BY region"""

DISTRIBUTION = """
SELECT magnitude_category, CAST(sum(event_count) AS BIGINT) AS total_events,
  round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude, round(avg(avg_depth) + 1e-9, 6) AS avg_depth
FROM cube_time {where} GROUP BY magnitude_category"""

HOURLY = """
SELECT hour, CAST(sum(event_count) AS BIGINT) AS total_events,
  round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude, CAST(hour * 15 AS INT) AS theta
FROM cube_time {where} GROUP BY hour"""

SEASONAL = """
SELECT season, CAST(sum(event_count) AS BIGINT) AS total_events,
  round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude, round(avg(avg_depth) + 1e-9, 6) AS avg_depth
FROM cube_time {where} GROUP BY season"""

TABLE_COLUMNS = {
    "dim_time": "time_id, datetime, date, year, month, day, hour, day_of_week, day_name, season, is_weekend",
    "dim_location": "location_id, latitude, longitude, place, region, hemisphere_ns, hemisphere_ew, climate_zone",
    "dim_magnitude": "magnitude_id, magnitude, magnitude_category, magnitude_type, effects_description, energy_joules",
    "fact_earthquakes": (
        "earthquake_id, time_id, location_id, magnitude_id, event_id, depth, depth_category, num_stations, "
        "azimuthal_gap, min_distance, rms, horizontal_error, depth_error, magnitude_error, network, status, "
        "event_type, moon_phase, moon_phase_name"
    ),
    "cube_time_magnitude": (
        "year, month, day_name, hour, season, is_weekend, magnitude_category, event_count, avg_magnitude, "
        "min_magnitude, max_magnitude, avg_depth, total_energy"
    ),
    "cube_location_magnitude": (
        "region, hemisphere_ns, hemisphere_ew, climate_zone, magnitude_category, event_count, avg_magnitude, "
        "max_magnitude, avg_depth, center_latitude, center_longitude"
    ),
    "cube_depth_analysis": (
        "depth_category, magnitude_category, season, event_count, avg_depth, avg_magnitude, avg_stations, "
        "avg_gap, avg_horizontal_error, avg_depth_error"
    ),
    "cube_temporal_trends": (
        "date, year, month, day_of_week, daily_event_count, daily_avg_magnitude, daily_max_magnitude, "
        "daily_total_energy, affected_regions"
    ),
    "cube_moon_phase": (
        "moon_phase_name, moon_phase, magnitude_group, event_count, avg_magnitude, max_magnitude, avg_depth"
    ),
}
RELATIONS = {
    "dim_time": "dim_time",
    "dim_location": "dim_location",
    "dim_magnitude": "dim_magnitude",
    "fact_earthquakes": "fact",
    "cube_time_magnitude": "cube_time",
    "cube_location_magnitude": "cube_location",
    "cube_depth_analysis": "cube_depth",
    "cube_temporal_trends": "cube_trends",
    "cube_moon_phase": "cube_moon",
}


def _audit(tables: list[str]) -> str:
    parts = []
    for table in tables:
        columns = TABLE_COLUMNS[table]
        parts.append(
            f"SELECT '{table}' AS table_name, true AS is_there, count(*) AS row_count, "
            f"CAST({columns.count(',') + 1} AS INT) AS column_count, '{columns}' AS columns "
            f"FROM {RELATIONS[table]}"
        )
    return " UNION ALL ".join(parts)


def _profile() -> str:
    kinds = {
        "time": "string", "latitude": "double", "longitude": "double", "depth": "double",
        "magnitude": "double", "magnitude_type": "string", "num_stations": "int",
        "azimuthal_gap": "double", "min_distance": "double", "rms": "double", "network": "string",
        "event_id": "string", "updated": "string", "place": "string", "event_type": "string",
        "horizontal_error": "double", "depth_error": "double", "magnitude_error": "double",
        "magnitude_stations": "int", "status": "string", "location_source": "string",
        "magnitude_source": "string",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, "
        f"count(*) - count({name}) AS null_count FROM conformed"
        for name, kind in kinds.items()
    )


def _bands(column: str, names: list[tuple[str, str]]) -> str:
    figures = ", ".join(
        f"count(*) FILTER ({inside}) AS {name}_count, "
        f"round(count(*) FILTER ({inside}) * 100.0 / count(*) + 1e-9, 6) AS {name}_percentage"
        for name, inside in names
    )
    return f"SELECT {figures} FROM (SELECT {column} AS v FROM map)"


_BODIES = {
    "csv_scan": f"SELECT {RAW_COLUMNS} FROM raw",
    "csv_by_header": f"SELECT {RAW_COLUMNS} FROM raw",
    "csv_stack": """
SELECT CAST(substr(time, 1, 4) AS INT) AS load_year, id, time, updated, mag, place, status FROM raw""",
    "csv_preview": "SELECT id, time, mag FROM raw ORDER BY id, time, updated LIMIT 5",
    "conform_clean_validate": "SELECT * REPLACE (CAST(num_stations AS DOUBLE) AS num_stations) FROM clean",
    "rejects": f"SELECT event_id, time, {FAILED_RULE} AS failed_rule FROM conformed WHERE {FAILED_RULE} IS NOT NULL",
    "refused_rows": f"""
SELECT event_id, CASE WHEN status = 'reviewed' THEN 'soon' ELSE time END AS time,
  coalesce({FAILED_RULE}, 'time_readable') AS failed_rule
FROM conformed WHERE {FAILED_RULE} IS NOT NULL OR status = 'reviewed'""",
    "quality_audit": f"""
SELECT count(*) AS rows_in, count(*) FILTER (rule IS NULL) AS rows_out,
  count(*) FILTER (rule IS NOT NULL) AS rows_removed,
  count(*) FILTER (rule = 'time_present') AS lost_time_present,
  count(*) FILTER (rule = 'latitude_present') AS lost_latitude_present,
  count(*) FILTER (rule = 'longitude_present') AS lost_longitude_present,
  count(*) FILTER (rule = 'magnitude_present') AS lost_magnitude_present,
  count(*) FILTER (rule = 'magnitude_in_range') AS lost_magnitude_in_range,
  count(*) FILTER (rule = 'depth_in_range') AS lost_depth_in_range,
  count(*) FILTER (rule = 'coordinates_on_globe') AS lost_coordinates_on_globe
FROM (SELECT {FAILED_RULE} AS rule FROM conformed)""",
    "column_profile": _profile(),
    "duplicate_audit": """
SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_events,
  count(*) - count(DISTINCT event_id) AS duplicates FROM enriched""",
    "enrich_calendar": "SELECT event_id, datetime, year, month, day, hour, day_of_week FROM enriched",
    "enrich_categories": "SELECT event_id, time, magnitude_category, depth_category, region FROM enriched",
    "moon_phase": "SELECT event_id, datetime, round(moon_phase + 1e-9, 6) AS moon_phase, moon_phase_name FROM enriched",
    "silver_dedup_first": """
SELECT id, time, updated, status, mag, place FROM raw
QUALIFY row_number() OVER (PARTITION BY id ORDER BY time, updated) = 1""",
    "silver_merge_latest": SILVER_ROUNDED,
    "summary_statistics": """
SELECT count(*) AS total_rows, min(datetime) AS min_datetime, max(datetime) AS max_datetime,
  round(min(magnitude) + 1e-9, 6) AS min_magnitude, round(max(magnitude) + 1e-9, 6) AS max_magnitude,
  round(avg(magnitude) + 1e-9, 6) AS mean_magnitude, round(min(depth) + 1e-9, 6) AS min_depth,
  round(max(depth) + 1e-9, 6) AS max_depth, round(avg(depth) + 1e-9, 6) AS mean_depth,
  count(DISTINCT region) AS unique_regions
FROM silver""",
    "dim_time": "SELECT * FROM dim_time",
    "dim_location": "SELECT * FROM dim_location",
    "dim_magnitude": """
SELECT magnitude_id, round(magnitude + 1e-9, 6) AS magnitude, magnitude_category, magnitude_type,
  effects_description, round(log10(energy_joules) + 1e-9, 6) AS energy_joules FROM dim_magnitude""",
    "fact_earthquakes": FACT_ROUNDED,
    "star_audit": _audit(["dim_time", "dim_location", "dim_magnitude", "fact_earthquakes"])
    + " UNION ALL SELECT 'no_such_table', false, 0, CAST(0 AS INT), ''",
    "star_join_all": """
SELECT event_id, datetime, date, season, is_weekend, round(latitude + 1e-9, 6) AS latitude,
  round(longitude + 1e-9, 6) AS longitude, place, climate_zone, round(magnitude + 1e-9, 6) AS magnitude,
  magnitude_type, effects_description, round(log10(energy_joules) + 1e-9, 6) AS energy_joules,
  round(depth + 1e-9, 6) AS depth, network
FROM star""",
    "cube_time_magnitude": CUBE_TIME,
    "cube_location_magnitude": CUBE_LOCATION,
    "cube_depth_analysis": CUBE_DEPTH,
    "cube_temporal_trends": TRENDS.format(table="cube_trends"),
    "cube_moon_phase": MOON.format(table="cube_moon"),
    "star_cube_time_magnitude": CUBE_TIME,
    "star_cube_location_magnitude": CUBE_LOCATION,
    "star_cube_depth_analysis": CUBE_DEPTH,
    "star_cube_temporal_trends": TRENDS.format(table="cube_trends"),
    "star_cube_moon_phase": MOON.format(table="cube_moon"),
    "cube_audit": _audit([name for name in TABLE_COLUMNS if name.startswith("cube_")]),
    "kpis": """
SELECT count(*) AS total_events, min(datetime) AS min_datetime, max(datetime) AS max_datetime,
  min(date) AS min_date, max(date) AS max_date, round(avg(magnitude) + 1e-9, 6) AS avg_magnitude,
  round(max(magnitude) + 1e-9, 6) AS max_magnitude,
  CAST(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 86400000000) AS INT) AS range_days
FROM star""",
    "top_magnitude_events": """
SELECT event_id, datetime, place, region, magnitude, magnitude_category, depth, depth_category,
  latitude, longitude
FROM star ORDER BY magnitude DESC, datetime DESC, event_id LIMIT 100""",
    "top_events_table": """
SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS "Date & Time", place AS "Location",
  magnitude AS "Magnitude", depth AS "Depth (km)"
FROM star ORDER BY star.magnitude DESC, datetime DESC, event_id LIMIT 10""",
    "days_shown": """
SELECT TIMESTAMP '2021-03-01' AS first_day, max(date) AS last_day,
  CAST(date_diff('day', TIMESTAMP '2021-03-01', max(date)) + 1 AS INT) AS days FROM star""",
    "days_shown_reversed": """
SELECT min(date) AS first_day, max(date) AS last_day,
  CAST(date_diff('day', min(date), max(date)) + 1 AS INT) AS days FROM star""",
    "events_for_map": "SELECT * FROM map",
    "events_for_map_days": """
SELECT event_id, datetime, latitude, longitude, place, region, magnitude, magnitude_category,
  depth, depth_category
FROM star WHERE magnitude >= 4 AND date >= '2021-03-01' AND date <= '2022-08-31'
ORDER BY magnitude DESC, datetime DESC, event_id LIMIT 100""",
    "events_for_map_reversed_days": "SELECT * FROM map",
    "map_points": """
SELECT event_id, latitude, longitude,
  CASE WHEN magnitude < 3 THEN 'green' WHEN magnitude < 4 THEN 'blue' WHEN magnitude < 5 THEN 'orange'
       WHEN magnitude < 6 THEN 'red' ELSE 'darkred' END AS color,
  greatest(3.0, magnitude * 1.5) AS radius, magnitude, round(depth, 1) AS depth, place,
  strftime(datetime, '%Y-%m-%d %H:%M:%S') AS date_text, magnitude_category
FROM map""",
    "map_stats": """
SELECT count(*) AS events_displayed, round(avg(magnitude) + 1e-9, 6) AS avg_magnitude,
  round(max(magnitude) + 1e-9, 6) AS max_magnitude, round(avg(depth) + 1e-9, 6) AS avg_depth FROM map""",
    "map_depth_bands": _bands(
        "depth", [("shallow", "v < 70"), ("intermediate", "v >= 70 AND v < 300"), ("deep", "v >= 300")]
    ),
    "map_magnitude_bands": _bands(
        "magnitude",
        [
            ("minor", "v < 4"),
            ("moderate", "v >= 4 AND v < 5"),
            ("strong", "v >= 5 AND v < 6"),
            ("major", "v >= 6"),
        ],
    ),
    "daily_trend_filtered": TRENDS.format(table="trend"),
    "daily_stats": """
SELECT round(avg(daily_event_count) + 1e-9, 6) AS avg_daily_events, max(daily_event_count) AS max_daily_events,
  count(*) AS total_days FROM trend""",
    "energy_stats": """
SELECT round(log10(sum(daily_total_energy)) + 1e-9, 6) AS total_energy,
  round(log10(avg(daily_total_energy)) + 1e-9, 6) AS avg_daily_energy,
  round(log10(max(daily_total_energy)) + 1e-9, 6) AS max_daily_energy FROM trend""",
    "day_of_week": """
SELECT day_name, CAST(coalesce(sum(daily_event_count), 0) AS BIGINT) AS event_count,
  round(coalesce(avg(daily_avg_magnitude), 0.0) + 1e-9, 6) AS avg_magnitude
FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
  (6, 'Saturday'), (7, 'Sunday')) week(day_of_week, day_name)
LEFT JOIN trend USING (day_of_week) GROUP BY day_name""",
    "magnitude_depth_sample": """
SELECT event_id, magnitude, depth, magnitude_category FROM star WHERE magnitude >= 2
ORDER BY md5(event_id), event_id LIMIT 5000""",
    "filter_events": """
SELECT event_id, datetime, region, magnitude, depth_category FROM star
WHERE magnitude BETWEEN 2.5 AND 7.5 AND date BETWEEN '2021-03-01' AND '2022-08-31'
  AND depth_category IN ('Shallow', 'Deep')
  AND region IN ('NATION_3', 'NATION_8', 'NATION_11', 'NATION_20', 'NATION_1 region', 'NATION_16 region')
  AND magnitude_category IN ('Light', 'Moderate', 'Strong', 'Major')""",
    "filter_events_long_list": """
SELECT event_id, region, magnitude FROM star WHERE magnitude >= 5
  AND region IN (SELECT region FROM dim_location WHERE climate_zone = 'Polar')""",
    "density_grid": """
SELECT CAST(floor(latitude / 5.0) AS INT) AS lat_cell, CAST(floor(longitude / 5.0) AS INT) AS lon_cell,
  count(*) AS event_count, round(sum(magnitude) + 1e-9, 6) AS weight FROM star GROUP BY 1, 2""",
    "cluster_grid": """
SELECT CAST(floor(latitude / 45.0) AS INT) AS lat_cell, CAST(floor(longitude / 45.0) AS INT) AS lon_cell,
  count(*) AS event_count, round(avg(latitude) + 1e-9, 6) AS center_latitude,
  round(avg(longitude) + 1e-9, 6) AS center_longitude, round(max(magnitude) + 1e-9, 6) AS max_magnitude
FROM star GROUP BY 1, 2""",
    "events_by_region": """
SELECT region, event_count, round(avg_magnitude + 1e-9, 6) AS avg_magnitude,
  round(max_magnitude + 1e-9, 6) AS max_magnitude, round(center_latitude + 1e-9, 6) AS center_latitude,
  round(center_longitude + 1e-9, 6) AS center_longitude
FROM (SELECT DISTINCT region, event_count, avg_magnitude, max_magnitude, center_latitude,
        center_longitude FROM cube_location)
ORDER BY cube_location.event_count DESC, region LIMIT 50""".replace("cube_location.event_count", "event_count"),
    "region_rollup": REGIONS.format(where=""),
    "region_top_n": REGIONS.format(where="") + " ORDER BY event_count DESC, region LIMIT 10",
    "region_top_n_min_mag": REGIONS.format(where="WHERE avg_magnitude >= 5.5")
    + " ORDER BY event_count DESC, region LIMIT 10",
    "region_table": """
SELECT region AS "Region", CAST(sum(event_count) AS BIGINT) AS "Event Count",
  round(avg(avg_magnitude) + 1e-9, 6) AS "Avg Magnitude", round(max(max_magnitude) + 1e-9, 6) AS "Max Magnitude"
FROM cube_location WHERE avg_magnitude >= 5.5 GROUP BY region ORDER BY 2 DESC, region LIMIT 10""",
    "region_rollup_weighted": """
SELECT region, count(*) AS event_count, round(avg(magnitude) + 1e-9, 6) AS avg_magnitude,
  round(max(magnitude) + 1e-9, 6) AS max_magnitude, round(avg(latitude) + 1e-9, 6) AS center_latitude,
  round(avg(longitude) + 1e-9, 6) AS center_longitude
FROM star GROUP BY region""",
    "magnitude_distribution": DISTRIBUTION.format(where=""),
    "magnitude_distribution_min_mag": DISTRIBUTION.format(where="WHERE avg_magnitude >= 5.5"),
    "category_table": """
SELECT magnitude_category AS "Category", CAST(sum(event_count) AS BIGINT) AS "Events",
  round(avg(avg_magnitude) + 1e-9, 6) AS "Avg Mag", round(avg(avg_depth) + 1e-9, 6) AS avg_depth
FROM cube_time WHERE avg_magnitude >= 5.5 GROUP BY magnitude_category""",
    "magnitude_distribution_weighted": """
SELECT magnitude_category, count(*) AS total_events, round(avg(magnitude) + 1e-9, 6) AS avg_magnitude,
  round(avg(depth) + 1e-9, 6) AS avg_depth FROM star GROUP BY magnitude_category""",
    "magnitude_share": """
SELECT magnitude_category, CAST(sum(event_count) AS BIGINT) AS total_events,
  round(sum(event_count) * 100.0 / (SELECT sum(event_count) FROM cube_time) + 1e-9, 6) AS percentage
FROM cube_time GROUP BY magnitude_category""",
    "depth_analysis": """
SELECT depth_category, CAST(sum(event_count) AS BIGINT) AS total_events,
  round(avg(avg_depth) + 1e-9, 6) AS avg_depth, round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude,
  round(avg(avg_stations) + 1e-9, 6) AS avg_stations
FROM cube_depth GROUP BY depth_category""",
    "hourly_patterns": HOURLY.format(where=""),
    "hourly_patterns_min_mag": HOURLY.format(where="WHERE avg_magnitude >= 5.5"),
    "seasonal_patterns": SEASONAL.format(where=""),
    "seasonal_patterns_min_mag": SEASONAL.format(where="WHERE avg_magnitude >= 5.5"),
    "seasonal_patterns_strong_events": """
SELECT season, CAST(sum(n) AS BIGINT) AS total_events, round(avg(m) + 1e-9, 6) AS avg_magnitude,
  round(avg(d) + 1e-9, 6) AS avg_depth
FROM (SELECT year, month, day_name, hour, season, is_weekend, magnitude_category,
        count(*) AS n, avg(magnitude) AS m, avg(depth) AS d
      FROM star WHERE magnitude >= 5.5 GROUP BY ALL)
GROUP BY season""",
    "seasonal_with_total": """
SELECT season, total_events, avg_magnitude FROM (
  SELECT season, CAST(sum(event_count) AS BIGINT) AS total_events,
    round(avg(avg_magnitude), 2) AS avg_magnitude FROM cube_time GROUP BY season)
UNION ALL
SELECT '**TOTAL**', CAST(sum(n) AS BIGINT), round(avg(a), 2) FROM (
  SELECT sum(event_count) AS n, round(avg(avg_magnitude), 2) AS a FROM cube_time GROUP BY season)""",
    "season_table": """
SELECT season AS "Season", n AS "Total Events", a AS "Avg Magnitude" FROM (
  SELECT season, CAST(sum(event_count) AS BIGINT) AS n, round(avg(avg_magnitude), 2) AS a
  FROM cube_time WHERE avg_magnitude >= 5.5 GROUP BY season)
UNION ALL
SELECT '**TOTAL**', CAST(sum(n) AS BIGINT), round(avg(a), 2) FROM (
  SELECT sum(event_count) AS n, round(avg(avg_magnitude), 2) AS a
  FROM cube_time WHERE avg_magnitude >= 5.5 GROUP BY season)""",
    "seasons_shown": """
SELECT season, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS total_events,
  coalesce(round(avg(avg_magnitude), 2), 0.0) AS avg_magnitude
FROM (VALUES ('Spring'), ('Summer'), ('Fall'), ('Winter')) names(season)
LEFT JOIN (
  SELECT season, count(*) AS event_count, avg(magnitude) AS avg_magnitude FROM star
  WHERE datetime >= TIMESTAMP '2021-12-01' AND datetime < TIMESTAMP '2022-03-01'
  GROUP BY year, month, day_name, hour, season, is_weekend, magnitude_category) USING (season)
GROUP BY season""",
    "temporal_trends": """
SELECT date, daily_event_count, round(daily_avg_magnitude + 1e-9, 6) AS daily_avg_magnitude,
  round(daily_max_magnitude + 1e-9, 6) AS daily_max_magnitude,
  round(log10(daily_total_energy) + 1e-9, 6) AS daily_total_energy, affected_regions
FROM cube_trends""",
    "moon_phase_analysis": MOON.format(table="cube_moon"),
    "moon_phase_analysis_min_mag": MOON.format(table="cube_moon") + " WHERE cube_moon.avg_magnitude >= 5.5",
    "moon_phase_filtered": MOON.format(table="moon"),
    "phase_statistics": """
SELECT moon_phase_name, CAST(sum(event_count) AS BIGINT) AS event_count,
  round(avg(avg_magnitude) + 1e-9, 6) AS avg_magnitude, round(max(max_magnitude) + 1e-9, 6) AS max_magnitude,
  round(avg(avg_depth) + 1e-9, 6) AS avg_depth
FROM moon GROUP BY moon_phase_name""",
    "phase_table": """
SELECT moon_phase_name AS "Moon Phase", CAST(sum(event_count) AS BIGINT) AS "Total Events",
  round(avg(avg_magnitude) + 1e-9, 6) AS "Avg Magnitude", round(max(max_magnitude) + 1e-9, 6) AS "Max Magnitude",
  round(avg(avg_depth) + 1e-9, 6) AS "Avg Depth (km)"
FROM moon GROUP BY moon_phase_name""",
    "phase_by_group": """
SELECT magnitude_group, moon_phase_name, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS event_count,
  round(coalesce(avg(avg_magnitude), 0.0) + 1e-9, 6) AS avg_magnitude
FROM (SELECT DISTINCT magnitude_group FROM moon)
CROSS JOIN (VALUES ('New Moon'), ('Waxing Crescent'), ('First Quarter'), ('Waxing Gibbous'),
  ('Full Moon'), ('Waning Gibbous'), ('Last Quarter'), ('Waning Crescent')) phases(moon_phase_name)
LEFT JOIN moon USING (magnitude_group, moon_phase_name) GROUP BY magnitude_group, moon_phase_name""",
    "groups_present": "SELECT DISTINCT magnitude_group FROM moon",
    "magnitude_group_share": """
SELECT magnitude_group, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS event_count,
  round(coalesce(sum(event_count), 0) * 100.0 / (SELECT sum(event_count) FROM moon) + 1e-9, 6) AS percentage
FROM (VALUES ('1-3'), ('4'), ('5'), ('6-7'), ('8-9')) groups(magnitude_group)
LEFT JOIN moon USING (magnitude_group) GROUP BY magnitude_group""",
    "full_load": "SELECT event_id, magnitude, depth, place, region, magnitude_category FROM silver",
    "exported_events": "SELECT event_id, magnitude, depth, place, region, magnitude_category FROM silver",
    "exposed_events": "SELECT year, region, count(*) AS events FROM silver GROUP BY year, region",
    "star_of_repeated_events": FACT_ROUNDED,
    "resumed_load": FACT_ROUNDED,
    "incremental_load": SILVER_ROUNDED,
    "loaded_fact": FACT_ROUNDED,
    "reloaded_year": SILVER_ROUNDED,
    "silver_loaded_in_parts": SILVER_ROUNDED,
    "loaded_cube_time_magnitude": CUBE_TIME,
    "loaded_cube_location_magnitude": CUBE_LOCATION,
    "loaded_cube_depth_analysis": CUBE_DEPTH,
    "loaded_cube_temporal_trends": TRENDS.format(table="cube_trends"),
    "loaded_cube_moon_phase": MOON.format(table="cube_moon"),
    "full_load_first_rows": """
SELECT event_id, time, updated, status FROM enriched
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY status, time, updated) = 1""",
    "silver_in_time_order": """
SELECT year, count(*) AS events, CAST(0 AS BIGINT) AS out_of_order FROM silver GROUP BY year""",
    "years_of_empty_files": "SELECT year AS load_year, count(*) AS row_count FROM enriched GROUP BY year",
    "heat_grid": """
SELECT CAST(x + i AS INT) AS x_cell, CAST(y + j AS INT) AS y_cell,
  round(sum(weight * (45 - greatest(22.5 * sqrt(i * i + j * j), 20)) / 25.0) + 1e-9, 6) AS heat,
  CAST(sum(CASE WHEN i = 0 AND j = 0 THEN n ELSE 0 END) AS BIGINT) AS event_count
FROM (
  SELECT floor((longitude + 180.0) / 360.0 * 2048.0 / 22.5) AS x,
    floor((0.5 - ln(tan(radians(greatest(least(latitude, 85.05112877980659), -85.05112877980659)) / 2 + pi() / 4))
      / (2 * pi())) * 2048.0 / 22.5) AS y, count(*) AS n, sum(magnitude) AS weight
  FROM silver GROUP BY 1, 2)
CROSS JOIN (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j))
GROUP BY 1, 2""",
    "ledger_years": """
SELECT CAST(substr(time, 1, 4) AS INT) AS load_year, count(*) AS row_count,
  min(datetime) AS min_datetime, max(datetime) AS max_datetime
FROM enriched GROUP BY 1""",
    "ledger_summary": """
SELECT count(DISTINCT year) AS total_years, min(year) AS first_year, max(year) AS last_year,
  count(*) AS total_events FROM enriched""",
    "missing_years": """
SELECT CAST(y AS INT) AS load_year FROM range(2018, 2027) years(y)
WHERE y NOT IN (SELECT year FROM enriched)""",
    "year_gaps": """
SELECT CAST(year + 1 AS INT) AS gap_start, CAST(following - 1 AS INT) AS gap_end FROM (
  SELECT year, lead(year) OVER (ORDER BY year) AS following
  FROM (SELECT DISTINCT year FROM enriched WHERE year NOT IN (2021, 2022)))
WHERE following - year > 1""",
    "ledger_validate": """
SELECT year AS load_year, count(*) AS row_count FROM enriched WHERE year NOT IN (2020, 2022) GROUP BY year""",
    "ledger_lost_years": """
SELECT year AS load_year, count(*) AS row_count FROM enriched WHERE year IN (2020, 2022) GROUP BY year""",
    "incremental_ingest": SILVER_ROUNDED,
    "ingest_mixed_headers": SILVER_ROUNDED,
    "ingest_quarantine": """
SELECT 'what,ever' AS header, 'no column id, time, latitude, longitude, mag' AS reason,
  CAST(0 AS BIGINT) AS batch
FROM (SELECT count(*) AS n FROM events) WHERE n > 0""",
    "stream_daily_activity": """
SELECT date, daily_event_count, round(daily_avg_magnitude + 1e-9, 6) AS daily_avg_magnitude,
  round(daily_max_magnitude + 1e-9, 6) AS daily_max_magnitude,
  round(log10(daily_total_energy) + 1e-9, 6) AS daily_total_energy, affected_regions
FROM cube_trends""",
}


def oracle_sql() -> dict[str, str]:
    """The SQL for every query, with the relations it builds on."""
    relations = ", ".join(part.strip() for part in (CATALOG, STAR, CUBES))
    return {name: f"WITH {relations}\n{body.strip()}" for name, body in _BODIES.items()}
