"""Anchor networks: nodes are runs of adjacent occupied bins, edges are loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import div
from strandweave.operators import signals
from strandweave.session import materialize


def network(loops: DataFrame, resolution: int = 200) -> DataFrame:
    """``chr1, up_start, up_end, chr2, down_start, down_end`` of every distinct edge between an upstream and a downstream node."""
    points = loops.select("chr1", "chr2", div(x.mid1(), resolution).alias("b1"), div(x.mid2(), resolution).alias("b2")).distinct()
    d = points
    for s, side in ((1, "up"), (2, "down")):
        chrom = f"chr{s}"
        own = [chrom]
        nodes = signals.runs(points.select(chrom, F.col(f"b{s}").alias("bin")), resolution, own).select(chrom, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))
        bins = nodes.withColumn(f"b{s}", F.explode(F.sequence(div(f"{side}_start", resolution), div(f"{side}_end", resolution) - 1)))
        d = d.join(bins, [chrom, f"b{s}"])
    return d.select("chr1", "up_start", "up_end", "chr2", "down_start", "down_end").distinct()


def rescue(edges: DataFrame, resolution: int = 200) -> DataFrame:
    """Loops between upstream and downstream nodes that a walk of three edges connects, the nodes widened by a bin; lower start first."""
    up, down = ["chr1", "up_start", "up_end"], ["chr2", "down_start", "down_end"]
    first = edges.select(*[F.col(c).alias(f"a_{c}") for c in up], *down)
    middle = edges.select(*up, *down)
    last = edges.select(*up, *[F.col(c).alias(f"z_{c}") for c in down])
    walks = first.join(middle, down).select(*[f"a_{c}" for c in up], *up).distinct().join(last, up).select(*[f"a_{c}" for c in up], *[f"z_{c}" for c in down]).distinct()
    a, b = (F.col("a_up_start") - resolution, F.col("a_up_end") + resolution), (F.col("z_down_start") - resolution, F.col("z_down_end") + resolution)
    turned = (F.col("a_chr1") == F.col("z_chr2")) & (b[0] < a[0])
    pick = lambda p, q: F.when(turned, q).otherwise(p)
    return walks.select(
        F.col("a_chr1").alias("chr1"), pick(a[0], b[0]).alias("start1"), pick(a[1], b[1]).alias("end1"), F.col("z_chr2").alias("chr2"), pick(b[0], a[0]).alias("start2"), pick(b[1], a[1]).alias("end2")
    ).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component``: the least node that each one is connected with.

    Alternating star contractions: every round points the neighbours of a node to its least neighbour, so distances
    shrink by half; rounds go on until an edge set repeats, which is told by its count and two sums of hashes. Each
    round is written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = materialize(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sums = [F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (1, 2)]]
    print_of = lambda d: tuple(d.agg(*sums).first())
    seen = print_of(e)
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").filter("u <> v").distinct()
        e = materialize(small, "edges")
        before, seen = seen, print_of(e)
        if seen == before:
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
