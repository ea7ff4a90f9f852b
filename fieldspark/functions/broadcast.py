"""Broadcast antennas and powers, and losses of materials, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import interpolated

# Loss in dB by material at some frequencies (MHz).
MATERIAL_MHZ = (628.0, 1900.0, 2500.0, 3500.0)
MATERIAL_DB = {
    "wood": (3.0, 5.0, 6.0, 7.0),
    "concrete": (6.0, 9.0, 10.0, 12.0),
    "brick": (5.0, 7.0, 8.0, 10.0),
    "metal": (25.0, 25.0, 25.0, 25.0),
    "glass": (4.0, 6.0, 7.0, 9.0),
    "unknown": (6.0, 9.0, 10.0, 12.0),
}
DIPOLE_DB = 2.15


def penetration_db(material: Column, mhz: Column, fallback: str = "unknown", scale: float = 0.75, less: float = 0.0, curves: dict | None = None) -> Column:
    """A material's loss, linear between its frequencies and held at its ends, times a scale less a reduction; other materials count as ``fallback``."""
    curves = curves or MATERIAL_DB
    points = lambda name: F.array(*[F.struct(F.lit(f).alias("u"), F.lit(db).alias("z")) for f, db in zip(MATERIAL_MHZ, curves[name], strict=True)])
    raw = interpolated(points(fallback), mhz)
    for name in curves:
        raw = F.when(material == name, interpolated(points(name), mhz)).otherwise(raw)
    return F.greatest(F.lit(0.0), raw * scale - less)


def field_ratio(field: Column, attenuation_db: Column) -> Column:
    """A pattern sample as a field ratio, from the ratio or the attenuation given."""
    return F.coalesce(field, F.pow(F.lit(10.0), -attenuation_db / 20))


def tabulated_loss_db(pattern: Column, bearing: Column, rotation: Column) -> Column:
    """Loss of a tabulated pattern, an array of (u azimuth, z field ratio) sorted by azimuth, interpolated around the circle; 120 dB at most."""
    at = F.pmod(bearing - rotation, F.lit(360.0))
    last, first = F.element_at(pattern, -1), F.element_at(pattern, 1)
    around = F.concat(F.array(F.struct((last["u"] - 360).alias("u"), last["z"].alias("z"))), pattern, F.array(F.struct((first["u"] + 360).alias("u"), first["z"].alias("z"))))
    return F.least(-20 * F.log10(F.greatest(interpolated(around, at), F.lit(1e-6))), F.lit(120.0))


def erp_eirp_dbm(kilowatts: Column) -> Column:
    return 10 * F.log10(kilowatts * 1e6) + DIPOLE_DB


def source_eirp_dbm(erp_kw: Column, erp_h_kw: Column, erp_v_kw: Column, conducted_dbm: Column, chain_db: Column) -> Column:
    """From one radiated power, else its two components, else conducted power with its chain."""
    parts = F.coalesce(erp_h_kw, F.lit(0.0)) + F.coalesce(erp_v_kw, F.lit(0.0))
    return F.when(erp_kw.isNotNull(), erp_eirp_dbm(erp_kw)).when(erp_h_kw.isNotNull() | erp_v_kw.isNotNull(), erp_eirp_dbm(parts)).otherwise(conducted_dbm + chain_db)


def polarised_eirp_dbm(erp_h_kw: Column, loss_h_db: Column, erp_v_kw: Column, loss_v_db: Column) -> Column:
    """Both components after their own patterns, added as powers."""
    mw = lambda kw, loss: F.coalesce(F.pow(F.lit(10.0), (erp_eirp_dbm(kw) - loss) / 10), F.lit(0.0))
    return 10 * F.log10(F.greatest(mw(erp_h_kw, loss_h_db) + mw(erp_v_kw, loss_v_db), F.lit(1e-15)))


def field_strength_dbuv_m(received_dbm: Column, mhz: Column, gain_dbi: float = 0.0) -> Column:
    return received_dbm - gain_dbi + 20 * F.log10(mhz) + 77.2


def valid_power_basis(erp_kw: Column, erp_h_kw: Column, erp_v_kw: Column, conducted_kw: Column, chain_db: Column) -> Column:
    """Exactly one basis; radiated power forbids chain terms."""
    radiated = erp_kw.isNotNull() | erp_h_kw.isNotNull() | erp_v_kw.isNotNull()
    count = erp_kw.isNotNull().cast("int") + (erp_h_kw.isNotNull() | erp_v_kw.isNotNull()).cast("int") + conducted_kw.isNotNull().cast("int")
    return (count == 1) & (~radiated | (F.coalesce(chain_db, F.lit(0.0)) == 0))
