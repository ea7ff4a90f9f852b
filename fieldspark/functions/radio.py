"""Link-budget formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299_792_458.0
WGS84_A, WGS84_E2 = 6_378_137.0, 6.69437999014e-3
# Least SINR (dB) and bits per second and hertz of each modulation.
MODULATIONS = (("QPSK", -2.0, 1.0), ("16QAM", 5.0, 2.4), ("64QAM", 12.0, 4.2), ("256QAM", 20.0, 6.0), ("1024QAM", 28.0, 8.0))


def free_space_loss_db(distance_m: Column, mhz: Column) -> Column:
    return 32.45 + 20 * F.log10(F.greatest(distance_m / 1000, F.lit(1e-3))) + 20 * F.log10(mhz)


def street_canyon_loss_db(d2: Column, d3: Column, mhz: Column, tx_m: Column, rx_m: float, los: Column) -> Column:
    """Urban micro cells: two slopes around the breakpoint in sight, the larger of both laws out of it."""
    ghz = F.greatest(F.lit(0.01), mhz / 1000)
    d3 = F.greatest(d3, F.lit(10.0))
    bend = F.greatest(F.lit(10.0), 4.0 * F.greatest(F.lit(1.0), tx_m - 1) * max(1.0, rx_m - 1) * ghz * 1e9 / 3.0e8)
    near = 32.4 + 21 * F.log10(d3) + 20 * F.log10(ghz)
    far = 32.4 + 40 * F.log10(d3) + 20 * F.log10(ghz) - 9.5 * F.log10(bend * bend + (tx_m - rx_m) * (tx_m - rx_m))
    sight = F.when(F.greatest(F.lit(10.0), d2) <= bend, near).otherwise(far)
    hidden = 22.4 + 35.3 * F.log10(d3) + 21.3 * F.log10(ghz) - 0.3 * (rx_m - 1.5)
    return F.when(los, sight).otherwise(F.greatest(sight, hidden))


def breakpoint_m(tx_m: Column, rx_m: float, ghz: Column) -> Column:
    return F.greatest(F.lit(10.0), 4.0 * F.greatest(F.lit(1.0), tx_m - 1) * max(1.0, rx_m - 1) * ghz * 1e9 / 3.0e8)


def macro_loss_db(d2: Column, d3: Column, mhz: Column, tx_m: Column, rx_m: float, los: Column) -> Column:
    """Urban macro cells: two slopes around the breakpoint in sight, the larger of both laws out of it."""
    ghz, d3 = F.greatest(F.lit(0.01), mhz / 1000), F.greatest(d3, F.lit(10.0))
    bend = breakpoint_m(tx_m, rx_m, ghz)
    near = 28.0 + 22 * F.log10(d3) + 20 * F.log10(ghz)
    far = 28.0 + 40 * F.log10(d3) + 20 * F.log10(ghz) - 9 * F.log10(bend * bend + (tx_m - rx_m) * (tx_m - rx_m))
    sight = F.when(F.greatest(F.lit(10.0), d2) <= bend, near).otherwise(far)
    hidden = 13.54 + 39.08 * F.log10(d3) + 20 * F.log10(ghz) - 0.6 * (rx_m - 1.5)
    return F.when(los, sight).otherwise(F.greatest(sight, hidden))


def scenario_loss_db(model: str, d2: Column, d3: Column, mhz: Column, tx_m: Column, rx_m: float, los: Column) -> Column:
    """broadcast: free space; legacy: free space and 12 dB and more out of sight; macro and canyon: as above."""
    free = free_space_loss_db(d3, mhz)
    if model == "broadcast":
        return free
    if model == "legacy":
        return free + F.when(los, 0.0).otherwise(12.0 + 0.02 * F.greatest(F.lit(0.0), d3 - 50))
    return (macro_loss_db if model == "macro" else street_canyon_loss_db)(d2, d3, mhz, tx_m, rx_m, los)


# Exponents of distance by environment, penetration and cable losses (dB).
EXPONENTS = {"free_space": 2.0, "urban": 3.5, "indoor": 4.0}
PENETRATION_DB, CABLE_DB = 15.0, 2.0


def placement_loss_db(distance_m: Column, mhz: Column, environment: str = "urban", shadow_db: Column | None = None) -> Column:
    """With a shadow term only where one is given (a drawn one: ``8 * F.randn(seed)``)."""
    free = 20 * F.log10(distance_m) + 20 * F.log10(mhz) + 32.44
    shadow = F.lit(0.0) if shadow_db is None else shadow_db
    return free + (EXPONENTS.get(environment, 3.5) - 2) * 20 * F.log10(distance_m) + shadow + PENETRATION_DB


def received_dbm(power_dbm: Column, gain_dbi: Column, loss_db: Column, cable_db: float = CABLE_DB) -> Column:
    return power_dbm + gain_dbi - loss_db - cable_db


# Base loss and loss per obstacle (dB) by kind, and reflection loss (dB) by material.
KIND_DB = {"building": (15.0, 12.0), "house": (8.0, 8.0), "large_structure": (20.0, 15.0), "trees": (3.0, 2.0), "unknown": (0.0, 0.0)}
REFLECTION_DB = {"metal": 3.0, "steel": 3.0, "concrete": 7.0, "brick": 8.0, "stone": 8.0, "glass": 6.0, "wood": 12.0, "unknown": 9.0}


def kind_loss_db(kind: Column, obstacles: Column, scale: float = 0.75, less: float = 2.0) -> Column:
    raw = F.lit(0.0)
    for name, (base, each) in KIND_DB.items():
        raw = F.when(kind == name, base + each * obstacles).otherwise(raw)
    return F.greatest(F.lit(0.0), raw * scale - less)


def reflection_loss_db(material: Column, cos_incidence: Column, base: float = 8.0) -> Column:
    own = F.lit(REFLECTION_DB["unknown"])
    for name, db in REFLECTION_DB.items():
        own = F.when(F.lower(material) == name, db).otherwise(own)
    return base + own + 6.0 * (1 - F.least(F.lit(1.0), F.abs(cos_incidence)))


def carrier_eirp_dbm(power_dbm: Column, gain_dbi: Column, chain_db: float = 0, feeder_db: float = 0) -> Column:
    return power_dbm + chain_db + gain_dbi - feeder_db


def signed_vertical_loss_db(distance_m: Column, tx_abs_m: Column, rx_abs_m: Column, width: float, tilt: float = 0, cap: float = 30) -> Column:
    """From absolute heights: a target above the transmitter counts, too."""
    theta = F.degrees(F.atan2(tx_abs_m - rx_abs_m, F.greatest(distance_m, F.lit(1.0))))
    return F.least(12 * F.pow((theta - tilt) / max(width, 0.1), 2), F.lit(float(cap)))


def symbol_us(spacing_khz: Column, prefix: float = 0.07) -> Column:
    """A symbol with its cyclic prefix."""
    return 1000.0 / spacing_khz * (1 + prefix)


def occupied_mhz(blocks: Column, spacing_khz: Column) -> Column:
    return blocks * 12 * spacing_khz / 1000.0


def diversity(mode: Column, tx: Column, rx: Column) -> tuple[Column, Column]:
    """Diversity gain in dB (told, never added to a power) and parallel streams of an antenna mode."""
    n = F.when(mode == "SIMO", rx).when(mode == "MISO", tx).when(mode == "MIMO", F.least(tx, rx)).otherwise(F.lit(1))
    return 3.0 * F.log2(n.cast("double")), F.when(mode == "MIMO", F.least(tx, rx)).otherwise(F.lit(1)).cast("double")


def ecef_velocity(lat: Column, lon: Column, speed: Column, heading: Column, climb: Column) -> tuple[Column, Column, Column]:
    a, o, h = F.radians(lat), F.radians(lon), F.radians(heading)
    east, north = speed * F.sin(h), speed * F.cos(h)
    return (-F.sin(o) * east - F.sin(a) * F.cos(o) * north + F.cos(a) * F.cos(o) * climb, F.cos(o) * east - F.sin(a) * F.sin(o) * north + F.cos(a) * F.sin(o) * climb, F.cos(a) * north + F.sin(a) * climb)


def earth_bulge_m(u: Column, d: Column, k: float = 4 / 3) -> Column:
    return F.when(d > 0, u * F.greatest(F.lit(0.0), d - u) / (2 * max(1.0, k) * 6_371_000.0)).otherwise(0.0)


def fresnel_radius_m(u: Column, d: Column, wavelength_m: float) -> Column:
    return F.when((d > 0) & (u > 0) & (u < d), F.sqrt(F.greatest(F.lit(0.0), wavelength_m * u * (d - u) / d))).otherwise(0.0)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def horizontal_loss_db(bearing: Column, azimuth: Column, width: Column, cap: float = 30, back: float = 25) -> Column:
    off = angle_between(bearing, azimuth)
    loss = F.least(12 * F.pow(off / F.greatest(width, F.lit(0.1)), 2), F.lit(float(cap)))
    return F.when(width >= 359.9, 0.0).when(off > 90, F.greatest(loss, F.lit(float(back)))).otherwise(loss)


def vertical_loss_db(distance_m: Column, tx_m: Column, rx_m: float, width: Column, tilt: float = 0, cap: float = 30) -> Column:
    theta = F.degrees(F.atan2(F.greatest(F.lit(0.0), tx_m - rx_m), F.greatest(distance_m, F.lit(1.0))))
    return F.least(12 * F.pow((theta - tilt) / F.greatest(width, F.lit(0.1)), 2), F.lit(float(cap)))


def reference_eirp_dbm(power_dbm: Column, gain_dbi: Column, blocks: int = 273, feeder_db: float = 0, offset_db: float = 0) -> Column:
    return power_dbm - 10 * math.log10(12 * max(1, blocks)) + gain_dbi - feeder_db + offset_db


def milliwatts(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10)


def thermal_noise_dbm(mhz: float, figure_db: float) -> float:
    return -174 + 10 * math.log10(mhz * 1e6) + figure_db


def modulation(sinr_db: Column) -> tuple[Column, Column]:
    """Name and efficiency; the lowest one also below its own limit."""
    name, rate = F.lit(MODULATIONS[0][0]), F.lit(MODULATIONS[0][2])
    for label, least, bits in MODULATIONS[1:]:
        name, rate = F.when(sinr_db >= least, label).otherwise(name), F.when(sinr_db >= least, bits).otherwise(rate)
    return name, rate


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(a) * F.sin(a))
    return (n + alt) * F.cos(a) * F.cos(o), (n + alt) * F.cos(a) * F.sin(o), (n * (1 - WGS84_E2) + alt) * F.sin(a)


def distance3(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(p[1:], q[1:], strict=True)), (p[0] - q[0]) * (p[0] - q[0])))


def quotient(x: Column, length: Column) -> Column:
    """x by a length; by one of 0 what floating point has (infinite or no number) and not an error."""
    return F.when(length == 0, x * float("inf")).otherwise(x / length)


def scattering_db(rcs_m2: Column, hz: Column) -> Column:
    return 10 * F.log10(F.greatest(rcs_m2, F.lit(1e-18))) + 10 * math.log10(4 * math.pi) - 20 * F.log10(LIGHT / F.greatest(hz, F.lit(1.0)))


def knife_edge_loss_db(nu: Column) -> Column:
    return F.when(nu <= -0.78, 0.0).otherwise(6.9 + 20 * F.log10(F.sqrt((nu - 0.1) * (nu - 0.1) + 1) + nu - 0.1))
