"""Quality scores and velocity estimates of telemetry and positions, as columns.

Levels are dB with -999 for a missing one; scores lie in [0, 1] unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299_792_458.0
ROUND_LIGHT = 3.0e8
DEFAULT_CARRIER_HZ = 3_562_860_606.0
MISSING_DB = -999.0


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def falling(x: Column, scale: float) -> Column:
    """1 at zero, 0 from ``scale`` on."""
    return F.greatest(F.lit(0.0), 1 - x / scale)


def speed(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def position_quality(accuracy_m: Column, speed_mps: Column) -> Column:
    return clip(falling(accuracy_m, 50) * 0.7 + falling(speed_mps, 10) * 0.3)


def level_score(level_db: Column) -> Column:
    return clip((level_db + 100) / 50)


def signal_quality(best_db: Column, llr: Column) -> Column:
    return clip(level_score(best_db) * 0.8 + clip(llr / 100) * 0.2)


def timing_quality(timing_us: Column, freq_hz: Column) -> Column:
    return clip(falling(F.abs(timing_us), 100) * 0.7 + falling(F.abs(freq_hz), 2000) * 0.3)


def motion_quality(speed_mps: Column) -> Column:
    return clip(falling(speed_mps, 5))


def overall_quality(position: Column, signal: Column, timing: Column, motion: Column) -> Column:
    return clip(0.25 * position + 0.30 * signal + 0.25 * timing + 0.20 * motion)


def rough_distance_m(best_db: Column) -> Column:
    return clip(1000 * F.pow(F.lit(10.0), (best_db + 100) / 20), 50, 5000)


def doppler_velocity(freq_hz: Column, carrier_hz: Column, light: float = LIGHT) -> Column:
    return F.when(carrier_hz > 0, freq_hz * light / carrier_hz).otherwise(0.0)


def radial_velocity(cfo_hz: Column, baseline_hz: Column | None = None, carrier_hz: float = DEFAULT_CARRIER_HZ) -> Column:
    base = F.lit(0.0) if baseline_hz is None else F.coalesce(baseline_hz, F.lit(0.0))
    return ROUND_LIGHT * (cfo_hz - base) / carrier_hz


def timing_velocity(current_us: Column, initial_us: Column, stamp_ms: Column | None = None, baseline_ms: Column | None = None, default_s: float = 0.02) -> Column:
    """From drift over the time since the baseline, or over one burst period where no baseline stamp exists."""
    dt = F.lit(default_s)
    if stamp_ms is not None and baseline_ms is not None:
        dt = F.when((stamp_ms > 0) & (baseline_ms > 0), (stamp_ms - baseline_ms) / 1000.0).otherwise(dt)
    return F.when(dt > 0, (current_us - initial_us) * 1e-6 * LIGHT / dt).otherwise(0.0)


def fused_by_level(cfo: Column, timing: Column, best_db: Column) -> Column:
    return F.when(best_db > -80, 0.7 * cfo + 0.3 * timing).otherwise(0.3 * cfo + 0.7 * timing)


def fused_by_energy(cfo: Column, timing: Column, llr: Column, level_db: Column) -> Column:
    return F.when((llr + F.abs(level_db)) / 100 > 0.5, 0.7 * cfo + 0.3 * timing).otherwise(0.3 * cfo + 0.7 * timing)


def velocity_quality(best_db: Column, freq_hz: Column, timing_us: Column, freq_scale: float = 2000) -> Column:
    return clip(level_score(best_db) * 0.5 + falling(F.abs(freq_hz), freq_scale) * 0.3 + falling(F.abs(timing_us), 100) * 0.2)


def energy_score(llr: Column, best_db: Column) -> Column:
    return clip((llr + F.abs(best_db)) / 100)


def energy_velocity_quality(llr: Column, best_db: Column, freq_hz: Column, timing_us: Column) -> Column:
    return energy_score(llr, best_db) * 0.5 + falling(F.abs(freq_hz), 1000) * 0.3 + falling(F.abs(timing_us), 100) * 0.2


def level_confidence(mean_db: Column) -> Column:
    """Null without a level."""
    return F.when(mean_db.isNotNull(), clip((mean_db + 100) / 100, 0.1, 1))


def motion_state(magnitude_us: Column, slow: float = 10, fast: float = 20) -> Column:
    return F.when(magnitude_us < slow, "stationary").when(magnitude_us < fast, "slow_motion").otherwise("fast_motion")


def valid_levels(levels: Column) -> Column:
    return F.filter(levels, lambda x: x > MISSING_DB)


def array_mean(x: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x))


def array_variance(x: Column) -> Column:
    """Population variance."""
    mean = array_mean(x)
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / F.size(x))


def motion_confidence(magnitude_us: Column, spread: Column) -> Column:
    """Null where the spread is."""
    ratio = F.least(magnitude_us / 100.0, F.lit(1.0)) / (spread + 1e-6)
    return F.when(spread == 0, 0.5).when(spread.isNotNull(), F.greatest(F.least(ratio / 10.0, F.lit(1.0)), F.lit(0.1)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return radius * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bands(score: Column, prefix: str = "n_") -> list[Column]:
    """Counts of scores from 0.8, 0.6, 0.4 and below."""
    return [F.count_if(score >= 0.8).alias(prefix + "excellent"), F.count_if((score >= 0.6) & (score < 0.8)).alias(prefix + "good"), F.count_if((score >= 0.4) & (score < 0.6)).alias(prefix + "fair"), F.count_if(score < 0.4).alias(prefix + "poor")]
