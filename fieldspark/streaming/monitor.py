"""Structured Streaming versions of the monitoring jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions import score as S

LATE = "300 seconds"
RESET_MS, LEAST_SAMPLES = 5000, 10
#: State of a device or cell is given up once the watermark is so far beyond its last row.
IDLE_MS = 24 * 3_600_000


def telemetry_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """ST1: telemetry files as they arrive, with an event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path).withColumn("event_time", F.timestamp_millis("timestamp_ms"))


def tumbling_positions(stream: DataFrame, width: str = "1 second") -> DataFrame:
    """ST2: means per cell and window; rows more than 300 s late are dropped by the watermark."""
    w = F.window("event_time", width)
    return stream.withWatermark("event_time", LATE).groupBy("pci", w).agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.avg("current_timing_offset_us").alias("timing"))


def health(stream: DataFrame) -> DataFrame:
    """ST3: mean level and status of the last five minutes, each minute; and how many cells had a row of each status."""
    status = lambda x: F.when(x > -80, "Good").when(x > -90, "Fair").otherwise("Poor")
    cells = [F.approx_count_distinct(F.when(status(F.col("level_1_db")) == s, F.col("pci"))).alias(f"n_{s.lower()}") for s in ("Good", "Fair", "Poor")]
    out = stream.withWatermark("event_time", LATE).groupBy(F.window("event_time", "5 minutes", "1 minute")).agg(F.avg("level_1_db").alias("mean_level"), F.approx_count_distinct("pci").alias("n_cells"), F.count("*").alias("n"), *cells)
    return out.withColumn("status", status(F.col("mean_level")))


def baselines(stream: DataFrame, key: str = "device") -> DataFrame:
    """ST4: per device, the mean offset since the last reset, from ten samples on.

    A change of cell or more than five seconds since the reset starts anew, without the
    row that causes it; the old baseline stays until a new one is ready.  The state holds a
    sum and a count, not the samples.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pci, since, total, n, base = state.get if state.exists else (-1, -1, 0.0, 0, float("nan"))
        rows = pd.concat(list(parts)).sort_values(["timestamp_ms", "event_id"])
        out = []
        for r in rows.itertuples():
            reset = pci != r.pci or since < 0 or r.timestamp_ms - since > RESET_MS
            if reset:
                pci, since, total, n = int(r.pci), int(r.timestamp_ms), 0.0, 0
            else:
                total, n = total + float(r.cfo_est), n + 1
                if n >= LEAST_SAMPLES:
                    base = total / n
            out.append((k[0], int(r.event_id), reset, base))
        state.update((pci, since, total, n, base))
        state.setTimeoutTimestamp(max(int(rows["timestamp_ms"].max()), state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame(out, columns=["device", "event_id", "reset", "baseline"])

    return stream.withWatermark("event_time", LATE).groupBy(F.col(key).alias("device")).applyInPandasWithState(step, "device long, event_id long, reset boolean, baseline double", "pci int, since long, total double, n long, base double", "append", GroupStateTimeout.EventTimeTimeout)


def crossings(stream: DataFrame, threshold: float = 20.0) -> DataFrame:
    """ST5: per cell, starts and ends of motion; the state is the last magnitude.  Rows of a batch are compared as columns."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["timestamp_ms", "event_id"])
        m = (rows["current_timing_offset_us"] - rows["initial_timing_offset_us"]).abs().astype(float)
        above = m > threshold
        before = m.shift(fill_value=state.get[0] if state.exists else m.iloc[0]) > threshold
        state.update((float(m.iloc[-1]),))
        state.setTimeoutTimestamp(max(int(rows["timestamp_ms"].max()), state.getCurrentWatermarkMs()) + IDLE_MS)
        hit = above != before
        yield pd.DataFrame({"pci": int(k[0]), "event_id": rows["event_id"][hit], "started": above[hit], "magnitude": m[hit]})

    return stream.withWatermark("event_time", LATE).groupBy("pci").applyInPandasWithState(step, "pci int, event_id long, started boolean, magnitude double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def matched_stream(positions: DataFrame, telemetry: DataFrame, seconds: int = 2) -> DataFrame:
    """ST6: each position with the nearest telemetry at most some seconds away; ties to the earlier, then the smaller id.

    An interval join by cells as long as the tolerance (a position looks into its own and those beside it), with watermarks
    on both sides, then the least difference per position: a position's row comes out once the watermark has passed it, so
    nothing nearer can follow.
    """
    cell = lambda time: F.floor(F.unix_seconds(time) / seconds)
    p = positions.select("gps_id", F.col("event_time").alias("gps_time"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell("event_time") + d)).alias("cell")).withWatermark("gps_time", LATE)
    t = telemetry.select("event_id", "event_time", "pci", cell("event_time").alias("cell_")).withWatermark("event_time", LATE)
    pairs = p.join(t, F.expr(f"cell = cell_ AND event_time BETWEEN gps_time - INTERVAL {seconds} SECONDS AND gps_time + INTERVAL {seconds} SECONDS"))
    apart = F.abs(F.unix_micros("event_time") - F.unix_micros("gps_time"))
    best = F.min(F.struct(apart.alias("dt_us"), "event_time", "event_id", "pci")).alias("x")
    return pairs.groupBy("gps_id", F.window("gps_time", "1 second")).agg(best).select("gps_id", "x.event_id", "x.pci", (F.col("x.dt_us") / 1000).alias("dt_ms"))


def alerts(stream: DataFrame) -> DataFrame:
    """ST7: rows of low SNR, of a level at which other cells interfere, of motion, or in a coverage gap; the first that holds."""
    best = F.greatest("level_0_db", "level_1_db")
    snr = best - (-174 + 10 * F.log10(F.lit(40e6)))
    motion = S.motion_state(F.abs(F.col("current_timing_offset_us") - F.col("initial_timing_offset_us")).cast("double")) == "fast_motion"
    kind = F.when(snr < 8, "low_snr").when(F.least("level_0_db", "level_1_db") > -60, "interference").when(motion, "motion").when(best < -90, "gap")
    return stream.withColumn("alert", kind).filter(F.col("alert").isNotNull()).select("event_id", "pci", "event_time", "alert")


def late_rows(query) -> int:
    """ST8: rows that a query's watermark has dropped, of the last reports that it holds; LateRows counts all."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


class LateRows(StreamingQueryListener):
    """ST8: counts the rows that watermarks drop, by query, from every report of every trigger.

    Register it with ``spark.streams.addListener`` before the query starts: a query itself keeps its last reports only.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> int:
        """Rows of a query dropped so far."""
        return self.dropped.get(str(query.id), 0)
