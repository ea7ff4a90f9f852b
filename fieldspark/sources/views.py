"""Measurement and planning tables seen through the driver's star schema.

Each view is one SQL text; two placeholders differ between engines: the
milliseconds of a timestamp and an integer of the JSON column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_telemetry": """SELECT event_id, ts AS timestamp, {MS} AS timestamp_ms, CAST(user_id % 7 + 1 AS INT) AS pci,
  CAST(38.0 AS DOUBLE) + (user_id % 50) * CAST(0.001 AS DOUBLE) + value * CAST(0.00001 AS DOUBLE) AS latitude,
  CAST(-121.5 AS DOUBLE) + (user_id % 30) * CAST(0.001 AS DOUBLE) AS longitude,
  CAST(10 + event_id % 5 AS DOUBLE) AS altitude,
  CAST(CASE WHEN event_id % 11 = 0 THEN -999 ELSE -60 - value / 10 END AS DOUBLE) AS level_0_db,
  CAST(-62 - {K} % 30 AS DOUBLE) AS level_1_db,
  CAST({K} AS INT) AS initial_timing_offset_us,
  CAST({K} + (event_id * 7919) % 61 - 30 AS INT) AS current_timing_offset_us,
  {MS} AS timing_measurement_timestamp_ms,
  CAST(1250 AS DOUBLE) + value AS freq_offset_hz, (value - CAST(50 AS DOUBLE)) * CAST(2 AS DOUBLE) AS cfo_est,
  CAST(3500000000 AS DOUBLE) AS dl_carrier_freq, value AS llr_energy,
  CAST(CASE WHEN user_id % 2 = 0 THEN 15 ELSE 30 END AS INT) AS subcarrier_spacing
FROM events WHERE event_type <> 'view'""",
    "fx_gps": """SELECT event_id AS gps_id, ts AS timestamp, {MS} AS timestamp_ms,
  CAST(38.0 AS DOUBLE) + (user_id % 50) * CAST(0.001 AS DOUBLE) AS latitude,
  CAST(-121.5 AS DOUBLE) + (user_id % 30) * CAST(0.001 AS DOUBLE) AS longitude, CAST(10 AS DOUBLE) AS altitude,
  (CAST({K} AS DOUBLE) - 50) / 10 AS velocity_x, (value - CAST(50 AS DOUBLE)) / 25 AS velocity_y, CAST(0 AS DOUBLE) AS velocity_z,
  CAST(2 AS DOUBLE) + value / 10 AS horizontal_accuracy, CAST(3 AS DOUBLE) + value / 8 AS vertical_accuracy
FROM events WHERE event_type = 'view'""",
    "fx_sites": """SELECT s_suppkey AS site_id, CAST(38.0 AS DOUBLE) + (s_suppkey % 10) * CAST(0.002 AS DOUBLE) AS latitude,
  CAST(-121.5 AS DOUBLE) + CAST(FLOOR(s_suppkey / CAST(10 AS DOUBLE)) AS INT) * CAST(0.002 AS DOUBLE) AS longitude,
  CAST(10 + s_nationkey AS DOUBLE) AS tx_height_m, CAST(3500 AS DOUBLE) AS freq_mhz, CAST(43 AS DOUBLE) AS tx_power_dbm
FROM supplier""",
    "fx_sectors": """SELECT s.site_id, a.sector_no, CAST((a.sector_no * 120 + s.site_id * 7) % 360 AS DOUBLE) AS azimuth_deg,
  CAST(65 AS DOUBLE) AS beamwidth_h_deg, CAST(8 AS DOUBLE) AS beamwidth_v_deg, CAST(17 AS DOUBLE) AS tx_antenna_gain_dbi
FROM fx_sites s CROSS JOIN (SELECT 0 AS sector_no UNION ALL SELECT 1 UNION ALL SELECT 2) a""",
    "fx_obstacles": """SELECT p_partkey AS obstacle_id, p_partkey % (SELECT COUNT(*) FROM supplier) AS site_id,
  CAST((p_partkey * 7) % 72 AS INT) AS bearing_bin, CAST(50 + p_size * 10 AS DOUBLE) AS start_m,
  CAST(60 + p_size * 10 + p_partkey % 30 AS DOUBLE) AS end_m,
  CASE p_type WHEN 'ECONOMY' THEN 'wood' WHEN 'STANDARD' THEN 'concrete' WHEN 'SMALL' THEN 'brick'
              WHEN 'MEDIUM' THEN 'glass' WHEN 'LARGE' THEN 'metal' ELSE 'unknown' END AS material
FROM part""",
    "fx_targets": """SELECT c_custkey AS target_id, CAST(38.0 AS DOUBLE) + (c_custkey % 100) * CAST(0.0005 AS DOUBLE) AS latitude,
  CAST(-121.5 AS DOUBLE) + (c_custkey % 77) * CAST(0.0005 AS DOUBLE) AS longitude,
  CAST(c_nationkey AS DOUBLE) AS z_ground_m, CAST(-40 AS DOUBLE) - ABS(c_acctbal) / 200 AS incident_power_dbm
FROM customer""",
    "fx_roaming": """SELECT event_id, {MS} AS timestamp_ms, CAST(user_id % 97 AS INT) AS pci, value AS llr_energy,
  CAST(-88 + ((user_id % 97) * 37) % 177 AS DOUBLE) + value * CAST(0.001 AS DOUBLE) AS latitude,
  CAST(-179.5 + ((user_id % 97) * 53) % 359 AS DOUBLE) + value * CAST(0.001 AS DOUBLE) AS longitude
FROM events WHERE event_type <> 'view'""",
    "fx_illumination": """SELECT c_custkey AS target_id, CAST(60 AS DOUBLE) - (CAST(88 AS DOUBLE) + c_custkey % 37 + c_custkey % 13) AS incident_power_dbm
FROM customer WHERE c_custkey % 5 <> 0""",
    "fx_returns": """SELECT c_custkey AS target_id, CAST(38.0 AS DOUBLE) + (c_custkey % 100) * CAST(0.0005 AS DOUBLE) AS latitude,
  CAST(-121.5 AS DOUBLE) + (c_custkey % 77) * CAST(0.0005 AS DOUBLE) AS longitude,
  CASE WHEN c_custkey % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(92 + c_custkey % 41 AS DOUBLE) END AS path_loss_db,
  CAST(c_custkey % 13 AS DOUBLE) AS environment_loss_db, CAST(c_custkey % 7 AS DOUBLE) / 2 AS terrain_loss_db, c_custkey % 13 = 0 AS los,
  CASE WHEN c_custkey % 7 = 0 THEN 'los' WHEN c_custkey % 7 < 4 THEN 'fresnel' ELSE 'obstructed' END AS terrain_state, CAST(c_custkey % 11 AS DOUBLE) AS sample_error_m
FROM customer WHERE c_custkey % 7 <> 3""",
    "fx_members": """SELECT p_partkey % 2 AS relation_id, (p_partkey * 7919) % 1000003 AS segment_no, p_partkey % 3 = 0 AS backwards,
  CAST(FLOOR(p_partkey / CAST(86 AS DOUBLE)) * 1000 + FLOOR(p_partkey / CAST(2 AS DOUBLE)) % 43 AS DOUBLE) AS a_x,
  CAST(POWER(FLOOR(p_partkey / CAST(2 AS DOUBLE)) % 43, 2) % 101 AS DOUBLE) AS a_y,
  CAST(FLOOR(p_partkey / CAST(86 AS DOUBLE)) * 1000 + (FLOOR(p_partkey / CAST(2 AS DOUBLE)) + 1) % 43 AS DOUBLE) AS b_x,
  CAST(POWER((FLOOR(p_partkey / CAST(2 AS DOUBLE)) + 1) % 43, 2) % 101 AS DOUBLE) AS b_y
FROM part WHERE p_partkey % 97 <> 5""",
}
SPARK = {"{MS}": "(unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000)", "{K}": "CAST(get_json_object(props, '$.k') AS INT)"}
DUCKDB = {"{MS}": "(epoch_us(ts) // 1000)", "{K}": "CAST(json_extract_string(props, '$.k') AS INT)"}
BASE = {"fx_telemetry": ["events"], "fx_gps": ["events"], "fx_roaming": ["events"], "fx_sites": ["supplier"], "fx_sectors": ["supplier"], "fx_obstacles": ["part", "supplier"], "fx_targets": ["customer"], "fx_illumination": ["customer"], "fx_returns": ["customer"], "fx_members": ["part"]}


def _filled(name: str, tokens: dict[str, str]) -> str:
    text = VIEWS[name]
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are read from ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE[name]}
    text = _filled(name, SPARK)
    if name == "fx_sectors":
        text = text.replace("fx_sites s", "(" + _filled("fx_sites", SPARK) + ") s")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **tables)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with its two levels, and weights, as arrays."""
    return view(spark, sf_dir, "fx_telemetry").selectExpr("*", "array(level_0_db, level_1_db) AS channel_level_db", "array(0.5D + (event_id % 10) / 20.0D, 0.5D - (event_id % 10) / 20.0D) AS mrc_weights")


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL with the views as common table expressions."""
    if "fx_sectors" in names and "fx_sites" not in names:
        names = ("fx_sites", *names)
    if not names:
        return query.strip()
    head = ", ".join(f"{n} AS ({_filled(n, DUCKDB)})" for n in names)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
