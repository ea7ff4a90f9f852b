"""Running values over long keys: ranges of a key's rows, with what the ranges before them carry over.

A window partitioned by a key alone puts all rows of the key into one task.  Here the table is
cut into ranges of (key, order) of about equal size, a window runs inside each range, and one
small row for each range and key hands on what the ranges before have: their sum, least or
greatest value, or last row.  A key with a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column for each entry name: (kind, value), over the rows of the key up to this one, by ``order`` ascending.

    Kinds: ``sum``, ``min``, ``max``, ``count`` (of values that are not null), each also as ``sum_before`` and so on
    without this row; ``last`` (the last value that is not null), ``lag`` (the value on the row before).  ``order`` should tell a key's rows apart.  Null keys are a key.
    """
    named = {name: (kind, f"_v{i}") for i, (name, (kind, _)) in enumerate(values.items())}
    with_values = df.select("*", *[value.alias(f"_v{i}") for i, (_, value) in enumerate(values.values())])
    # written once: a range must hold the same rows whenever a lost task is run again
    rows = cut(with_values.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_it = inside.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    local, carried, before, merged = [], [], [], []
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, v) in named.items():
        mine, theirs = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        plain = kind.removesuffix("_before")
        if plain in ("sum", "count", "min", "max"):
            f = getattr(F, plain)
            local.append(f(v).over(up_to if plain == kind else before_it).alias(f"_l_{name}"))
            carried.append(f(v).alias(f"_c_{name}"))
            over = F.sum if plain == "count" else f
            before.append(over(f"_c_{name}").over(ranges).alias(f"_b_{name}"))
            if plain in ("sum", "count"):
                merged.append(F.when(theirs.isNull(), mine).when(mine.isNull(), theirs).otherwise(mine + theirs).alias(name))
            else:
                merged.append((F.least if plain == "min" else F.greatest)(mine, theirs).alias(name))
        elif kind == "last":
            local.append(F.last(v, True).over(up_to).alias(f"_l_{name}"))
            carried.append(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"_c_{name}"))
            before.append(F.last(f"_c_{name}", True).over(ranges).alias(f"_b_{name}"))
            merged.append(F.coalesce(mine, theirs).alias(name))
        elif kind == "lag":  # the value may be null, so a struct tells whether there is a row
            local.append(F.lag(F.struct(v)).over(inside).alias(f"_l_{name}"))
            carried.append(F.max_by(F.struct(v), at).alias(f"_c_{name}"))
            before.append(F.last(f"_c_{name}").over(ranges).alias(f"_b_{name}"))
            merged.append(F.coalesce(mine, theirs).getField(v).alias(name))
        else:
            raise ValueError(f"no running value of kind {kind}")
    handed = rows.groupBy("_range", *keys).agg(*carried).select("_range", *keys, *before)
    both = rows.select("*", *local).alias("r").join(handed.alias("h"), [F.col("r._range") == F.col("h._range"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys)])
    return both.select(*[F.col(f"r.{n}") for n in df.columns], *merged)


def blocks(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, rows: int = 8192) -> DataFrame:
    """The rows of each key in blocks of ``rows`` in ``order``, each with the last ``before`` rows of the block before it and the
    first ``after`` of the one after it: windows of such frames over (keys, _block) are right for rows whose _own is true.

    Adds _i (number in the key, from 1), _block and _own; a long key is as many tasks as it has blocks.
    """
    if max(before, after) > rows:
        raise ValueError("a border is longer than a block")
    numbered = running(df, keys, order, {"_i": ("count", F.lit(1))})
    block, place = F.floor((F.col("_i") - 1) / rows), F.pmod(F.col("_i") - 1, F.lit(rows))
    near = F.array(block, F.when(place >= rows - before, block + 1), F.when((place < after) & (block > 0), block - 1))
    return numbered.withColumn("_block", F.explode(F.filter(near, lambda b: b.isNotNull()))).withColumn("_own", F.col("_block") == F.floor((F.col("_i") - 1) / rows))
