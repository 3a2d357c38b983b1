"""Synthetic reads from contact matrices by inverse transform sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.scalars import div
from strandweave.operators.matrix import local_vc, proportional


def bucketed_cdf(weights: DataFrame, keys: list[str], order: list[str], buckets: int = 256) -> DataFrame:
    """``low, high`` of each weighted row in (0, 1] of its key, summed in two levels so that no key is held by one task."""
    d = weights.filter("weight > 0").withColumn("b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = d.groupBy(*keys, "b").agg(F.sum("weight").alias("w"))
    w = Window.partitionBy(*keys)
    offsets = sums.select(*keys, "b", F.coalesce(F.sum("w").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"), F.sum("w").over(w).alias("total"))
    inside = F.coalesce(F.sum("weight").over(Window.partitionBy(*keys, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("inside", inside).join(offsets, [*keys, "b"])
    low = F.col("o") + F.col("inside")
    return d.withColumns({"low": low / F.col("total"), "high": (low + F.col("weight")) / F.col("total")}).drop("b", "inside", "o", "total")


def sample_reads(contacts: DataFrame, resolution: int, reads: int, high: int, seed: int = 0, far: int = 10_000_000, slots: int = 1024) -> DataFrame:
    """``chr1, pos1, chr2, pos2``: pixels drawn by their share of counts, each axis placed in a bin of the ``high`` resolution.

    Reads go to chromosomes by all of their contacts, pixels are drawn from those nearer than ``far``, and an axis is drawn from
    the row sums at the high resolution inside of the pixel's bin; positions are starts of bins. Draws fall into slots of the unit
    interval, pixels cover slots, and a draw meets its pixel by slot and range.
    """
    own = contacts.filter((F.col("chr1") == F.col("chr2")) & (F.col("resolution") == resolution) & (F.col("counts") > 0))
    near = own.filter(F.abs(F.col("bin_x") - F.col("bin_y")) < far // resolution)
    cdf = bucketed_cdf(near.withColumn("weight", F.col("counts").cast("double")), ["chr1"], ["bin_x", "bin_y"])
    spread = cdf.withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") * slots), F.least(F.floor(F.col("high") * slots), F.lit(slots - 1)))))
    counts = proportional(own, reads).filter("reads > 0")
    unit = lambda salt: (F.pmod(F.xxhash64("chr1", "i", F.lit(seed), F.lit(salt)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    draws = counts.select(F.col("chrom").alias("chr1"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reads"))).alias("i")).withColumns({"u": unit(1), "f1": unit(2), "f2": unit(3)}).withColumn("slot", F.floor(F.col("u") * slots))
    hits = draws.join(spread, ["chr1", "slot"]).filter("u > low AND u <= high").select("chr1", "bin_x", "bin_y", "f1", "f2")
    sums = local_vc(contacts.filter("chr1 = chr2"), high).select("chrom", div(F.col("bin") * high, resolution).alias("coarse"), "bin", F.col("value").cast("double").alias("weight"))
    # a coarse bin holds few fine ones: one bucket
    fine = bucketed_cdf(sums, ["chrom", "coarse"], ["bin"], 1)
    for b, f, p in (("bin_x", "f1", "pos1"), ("bin_y", "f2", "pos2")):
        at = fine.select(F.col("chrom").alias("chr1"), F.col("coarse").alias(b), F.col("low").alias("l"), F.col("high").alias("h"), F.col("bin").alias("fine"))
        hits = hits.alias("r").join(at.alias("a"), (F.col("r.chr1") == F.col("a.chr1")) & (F.col(f"r.{b}") == F.col(f"a.{b}")) & (F.col(f"r.{f}") > F.col("a.l")) & (F.col(f"r.{f}") <= F.col("a.h")), "left")
        hits = hits.select("r.*", F.coalesce(F.col("a.fine") * high, F.col(f"r.{b}") * resolution).cast("bigint").alias(p))
    return hits.select("chr1", "pos1", F.col("chr1").alias("chr2"), "pos2")
