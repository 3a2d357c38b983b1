"""Windows over ordered keys without one task a key: tiles with a halo, runs and running sums in two levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of a tile, in bins or in the unit of the ordering column.
TILE = 65_536


def _at(column: str | Column, tile: int) -> Column:
    return F.floor(F.col(column) / tile) if isinstance(column, str) else F.floor(column / tile)


def with_halo(df: DataFrame, keys: Sequence[str], reach: int, add: Callable[[WindowSpec], dict[str, Column]], bin: str = "bin", tile: int = TILE) -> DataFrame:
    """``df`` with the columns of ``add``, which look ``reach`` bins before and after a row at most.

    ``add`` gets a window ordered by bin; rows near a border also stand in the neighbouring tile, for others to see.
    """
    spread = df.withColumn("_tile", F.explode(F.sequence(_at(F.col(bin) - reach, tile), _at(F.col(bin) + reach, tile))))
    w = Window.partitionBy(*keys, "_tile").orderBy(bin)
    return spread.withColumns(add(w)).filter(F.col("_tile") == _at(bin, tile)).drop("_tile")


def islands(bins: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """``*keys, first, last, n``: maximal runs of adjacent bins; runs that touch a tile's border, two a tile at most, are joined over tiles."""
    own = bins.select(*keys, "bin").distinct().withColumn("_tile", _at("bin", tile))
    w = Window.partitionBy(*keys, "_tile").orderBy("bin")
    runs = own.withColumn("_i", F.col("bin") - F.row_number().over(w)).groupBy(*keys, "_tile", "_i").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("n"))
    border = (F.col("first") == F.col("_tile") * tile) | (F.col("last") == (F.col("_tile") + 1) * tile - 1)
    order = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce((F.lag("last").over(order) != F.col("first") - 1).cast("int"), F.lit(1))
    edges = runs.filter(border).withColumn("_open", opens).withColumn("_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    out = (*keys, "first", "last", "n")
    return runs.filter(~border).select(*out).unionByName(joined.select(*out))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str = "before", total: str | None = None, tile: int = TILE) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before each one in order, and with the key's ``total`` if named.

    ``order`` starts with a number, whose tiles are summed first; a tile's offset is the sum of the tiles before it.
    """
    own = df.withColumns({"_tile": _at(order[0], tile), "_weight": weight})
    sums = own.groupBy(*keys, "_tile").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    every = F.sum("_sum").over(Window.partitionBy(*keys))
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_tile").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), every.alias("_total"))
    inside = F.coalesce(F.sum("_weight").over(Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = own.withColumn("_inside", inside).join(offsets, [*same, F.col("_tile").eqNullSafe(F.col("_of"))])
    met = met.withColumn(name, F.col("_offset") + F.col("_inside"))
    met = met.withColumn(total, F.col("_total")) if total else met
    return met.drop("_tile", "_weight", "_inside", "_of", "_offset", "_total", *[f"_k{i}" for i in range(len(keys))])
