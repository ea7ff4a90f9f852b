"""Empty raster cells filled by a wave front from the filled ones.

All fronts move a cell a step, north, south, west and east at once; where several reach a cell in one
step the east neighbour's value wins over the west's, that over the south's, that over the north's.
Rasters are cut into tiles.  In a round each tile gets the border of its neighbours, as wide as the steps
of the round: within these steps nothing from farther away can reach it, so its own cells come out right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

TILE, BORDER, MOST_STEPS = 64, 16, 256


def steps_in(value: np.ndarray, there: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of all fronts on one tile; ``there`` marks the raster's cells."""
    value = value.copy()
    for _ in range(steps):
        empty = np.isnan(value) & there
        if not empty.any():
            break
        new, good = value.copy(), np.isfinite(value) & there
        for to, source in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            move = empty[to] & good[source]
            new[to][move] = value[source][move]
        value = new
    return value


def filled(cells: DataFrame, keys: list[str], row: str = "i", column: str = "j", value: str = "v", tile: int = TILE, border: int = BORDER, most_steps: int = MOST_STEPS) -> DataFrame:
    """The cells with empty values (null, NaN) filled: keys, row, column, value.

    A row is a cell of the raster, rows and columns number from north to south and west to east; cells without a row are
    outside, and nothing passes there.  Infinite values stay and don't spread.  Cells that no front
    reaches in ``most_steps`` take the mean of the raster's finite values, null where it has none.  One row a cell is expected.
    """
    border = min(border, tile, most_steps)
    whole = cells.select(*keys, F.col(row).cast("long").alias("_i"), F.col(column).cast("long").alias("_j"), F.when(~F.isnan(value), F.col(value)).cast("double").alias("_v"))
    names = [*keys, "_i", "_j", "_v"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)

    def near(at: str):
        """The tiles that hold a cell, or want it for their border."""
        own, place = F.floor(F.col(at) / tile), F.pmod(F.col(at), F.lit(tile))
        return F.filter(F.array(own, F.when(place < border, own - 1), F.when(place >= tile - border, own + 1)), lambda t: t.isNotNull())

    def go(key: tuple, t: pa.Table) -> pa.Table:
        top, left = key[-2].as_py() * tile - border, key[-1].as_py() * tile - border
        i, j, v = t.column("_i").to_numpy() - top, t.column("_j").to_numpy() - left, t.column("_v").to_numpy(zero_copy_only=False)
        size = tile + 2 * border
        value, there = np.full((size, size), np.nan), np.zeros((size, size), bool)
        value[i, j], there[i, j] = v, True
        done = steps_in(value, there, border)[i, j]
        own = np.flatnonzero((i >= border) & (i < border + tile) & (j >= border) & (j < border + tile))
        out = t.select(names).take(pa.array(own))
        new = pa.array(done[own], pa.float64(), mask=np.isnan(done[own]))
        return out.set_column(len(keys) + 2, "_v", new)

    held, n = cut(whole), None
    for _ in range(-(-most_steps // border)):
        left = held.filter("_v IS NULL").count()
        if not left or left == n:
            break
        n = left
        tiles = held.withColumn("_ti", F.explode(near("_i"))).withColumn("_tj", F.explode(near("_j")))
        held = cut(tiles.groupBy(*keys, "_ti", "_tj").applyInArrow(go, kinds))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    if keys:
        mean = held.groupBy(*keys).agg(F.avg(finite).alias("_mean"))
        both = held.alias("h").join(mean.alias("m"), [F.col(f"h.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]).select(*[F.col(f"h.{k}") for k in names], "_mean")
    else:
        both = held.crossJoin(F.broadcast(held.agg(F.avg(finite).alias("_mean"))))
    return both.select(*keys, F.col("_i").alias(row), F.col("_j").alias(column), F.coalesce("_v", "_mean").alias(value))
