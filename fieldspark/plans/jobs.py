"""Bundles of queries that belong together, as one call: their tables, their files, or how many rows each part has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import measurement, network
from ..sources.sinks import write_csv

PARTS = measurement.Q | network.Q
PARTS_SQL = measurement.SQL | network.SQL
JOBS = {
    "replay": ("replay_match", "replay_statistics", "top_positions", "transmitter_estimate", "quality_distribution", "triangulation_quality"),
    "motion": ("telemetry_positions", "time_synchronisation", "best_integration_time", "integrated_velocity", "significant_motion", "velocity_statistics"),
    "sensing": ("trajectories", "signal_coverage", "signal_trend", "motion_event_rows", "motion_summary", "location_quality", "second_positions"),
    "planning": ("cell_coverage", "placements", "best_row_per_cell", "weak_places", "uneven_places", "recommendations"),
}


def job(spark: SparkSession, sf_dir: str, name: str) -> dict[str, DataFrame]:
    """The parts of a job by name; nothing runs until they are read."""
    return {part: PARTS[part](spark, sf_dir) for part in JOBS[name]}


def write_job(spark: SparkSession, sf_dir: str, name: str, folder: str) -> None:
    """Each part as CSV in a folder of its name."""
    for part, df in job(spark, sf_dir, name).items():
        write_csv(df, f"{folder}/{part}")


def counted(name: str):
    def run(spark, sf_dir):
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in job(spark, sf_dir, name).items()]
        return reduce(DataFrame.unionByName, rows)

    return run


#: JOB15, JOB16, JOB22, JOB23: rows of each part.
Q = {f"{name}_job": counted(name) for name in JOBS}
SQL = {f"{name}_job": " UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS n FROM ({PARTS_SQL[part]}) AS x" for part in parts) for name, parts in JOBS.items()}
