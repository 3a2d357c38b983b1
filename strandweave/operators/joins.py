"""Joins on intervals, rectangles and neighbourhoods, all as equi-joins on tiles with a residual condition.

Both sides are cut into the tiles they touch; a pair that shares several tiles is kept in its first common one, so no
distinct is needed after the join. Keys hold chromosome and tile, so a chromosome or list of any size is spread; Spark
splits what is still skewed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS, div, tiles

TILE = 1_000_000


def exact_semi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose coordinates are in ``b``."""
    return a.join(b.select(*COORDS), COORDS, "left_semi")


def exact_anti(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*COORDS), COORDS, "left_anti")


def _tiled(a: DataFrame, b: DataFrame, window: int, tile: int) -> tuple[DataFrame, DataFrame, Column, Column, list[str]]:
    """Both sides with a row for each tile they touch, the conditions of a shared tile and of an overlap, and the helper columns of ``a``."""
    wide = a.withColumns({f"{p}{s}_": F.col(f"{p}{s}") + (window if p == "end" else -window) for p in ("start", "end") for s in (1, 2)})
    left = wide.withColumns({"tx": F.explode(tiles(F.greatest(F.col("start1_"), F.lit(0)), F.col("end1_"), tile))}).withColumn("ty", F.explode(tiles(F.greatest(F.col("start2_"), F.lit(0)), F.col("end2_"), tile)))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in COORDS]).withColumn("btx", F.explode(tiles(F.col("b_start1"), F.col("b_end1"), tile))).withColumn("bty", F.explode(tiles(F.col("b_start2"), F.col("b_end2"), tile)))
    on = (F.col("chr1") == F.col("b_chr1")) & (F.col("chr2") == F.col("b_chr2")) & (F.col("tx") == F.col("btx")) & (F.col("ty") == F.col("bty"))
    near = F.lit(True)
    for s in (1, 2):
        near = near & (F.col(f"start{s}_") < F.col(f"b_end{s}")) & (F.col(f"b_start{s}") < F.col(f"end{s}_"))
    return left, right, on, near, ["tx", "ty", *[f"{p}{s}_" for p in ("start", "end") for s in (1, 2)]]


def overlap_pairs(a: DataFrame, b: DataFrame, window: int = 0, tile: int = TILE) -> DataFrame:
    """All columns of ``a`` and, with prefix ``b_``, the coordinates of the rows of ``b`` that overlap on both axes, ``a`` widened by ``window``."""
    left, right, on, near, helpers = _tiled(a, b, window, tile)
    for s, t in ((1, "tx"), (2, "ty")):
        near = near & (F.col(t) == div(F.greatest(F.col(f"start{s}_"), F.col(f"b_start{s}"), F.lit(0)), tile))
    return left.join(right, on & near).drop("btx", "bty", *helpers)


def overlap_semi(a: DataFrame, b: DataFrame, window: int = 0, tile: int = TILE) -> DataFrame:
    """Distinct features of ``a`` that overlap some of ``b``. The join ends at a feature's first match in a tile; no pair is made."""
    left, right, on, near, helpers = _tiled(a.select(*COORDS).distinct(), b.select(*COORDS).distinct(), window, tile)
    return left.join(right, on & near, "left_semi").drop(*helpers).distinct()


def overlap_anti(a: DataFrame, b: DataFrame, window: int = 0, tile: int = TILE) -> DataFrame:
    return a.select(*COORDS).distinct().join(overlap_semi(a, b, window, tile), COORDS, "left_anti")


def bounding_boxes(a: DataFrame, b: DataFrame, window: int = 0, tile: int = TILE) -> DataFrame:
    """For each feature of ``a`` with a match: the box around it and all its matches, with ``n_matches``."""
    pairs = overlap_pairs(a.select(*COORDS).distinct(), b.select(*COORDS).distinct(), window, tile)
    grown = pairs.groupBy(*COORDS).agg(*[F.min(f"b_{c}").alias(f"b_{c}") for c in ("start1", "start2")], *[F.max(f"b_{c}").alias(f"b_{c}") for c in ("end1", "end2")], F.count("*").alias("n_matches"))
    return grown.select(
        *COORDS, F.least("start1", "b_start1").alias("box_start1"), F.greatest("end1", "b_end1").alias("box_end1"), F.least("start2", "b_start2").alias("box_start2"), F.greatest("end2", "b_end2").alias("box_end2"), "n_matches"
    )


def without_shared_anchors(a: DataFrame, b: DataFrame, window: int = 0, bin_size: int = 100) -> DataFrame:
    """Distinct features of ``a``, within a chromosome, that hit no bin of ``b``'s anchors of the same side.

    Anchors of ``b`` are widened and cover a bin at least; the end bin of ``a`` is not looked at, so an anchor inside
    of one bin never hits.
    """
    out = a.filter("chr1 = chr2").select(*COORDS).distinct()
    for s in (1, 2):
        low = F.greatest(div(F.col(f"start{s}") - window, bin_size), F.lit(0).cast("bigint"))
        high = F.greatest(div(F.col(f"end{s}") + window, bin_size), low + 1)
        taken = b.filter("chr1 = chr2").select(F.col(f"chr{s}").alias("chrom"), F.explode(F.sequence(low, high - 1)).alias("bin")).distinct()
        first, last = div(F.col(f"start{s}"), bin_size), div(F.col(f"end{s}"), bin_size)
        probe = out.filter(last > first).withColumn("bin", F.explode(F.sequence(first, last - 1))).withColumn("chrom", F.col(f"chr{s}"))
        out = out.join(probe.join(taken, ["chrom", "bin"], "left_semi").select(*COORDS).distinct(), COORDS, "left_anti")
    return out


def anchor_overlap_route(a: DataFrame, b: DataFrame, bin_size: int = 5000) -> DataFrame:
    """``route`` is removed if both anchors of a row are anchors of ``b`` in the same pair of chromosomes, either side, else kept."""
    sides = F.array(*[F.struct(F.col(f"chr{s}").alias("chrom"), div(x.mid(f"start{s}", f"end{s}"), bin_size).alias("bin")) for s in (1, 2)])
    keys = b.select("chr1", "chr2", F.explode(sides).alias("k")).select("chr1", "chr2", "k.*").distinct()
    d = a.withColumns({"bin1": div(x.mid1(), bin_size), "bin2": div(x.mid2(), bin_size)})
    for s in (1, 2):
        k = keys.select("chr1", "chr2", F.col("chrom").alias(f"k{s}"), F.col("bin").alias(f"bin{s}"), F.lit(True).alias(f"hit{s}"))
        d = d.withColumn(f"k{s}", F.col(f"chr{s}")).join(k, ["chr1", "chr2", f"k{s}", f"bin{s}"], "left")
    both = F.coalesce("hit1", F.lit(False)) & F.coalesce("hit2", F.lit(False))
    return d.withColumn("route", F.when(both, "removed").otherwise("kept")).drop("k1", "k2", "bin1", "bin2", "hit1", "hit2")


def nearest_anchors(a: DataFrame, anchors: DataFrame, bucket: int = 1000) -> DataFrame:
    """Each side snaps to the anchor with the nearest midpoint in its bucket or a neighbour; both must; coordinates only.

    Ties go to the smallest start, then end. The local point is the midpoint of the anchor.
    """
    points = anchors.select(F.col("chrom"), F.col("start").alias("s"), F.col("end").alias("e"), x.mid("start", "end").alias("m")).distinct()
    spread = points.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: div(F.col("m"), bucket) + o)))
    d = a.select(*COORDS).distinct()
    for s in (1, 2):
        m = x.mid(f"start{s}", f"end{s}")
        near = d.withColumns({"chrom": F.col(f"chr{s}"), "bucket": div(m, bucket), "own": m}).join(spread, ["chrom", "bucket"])
        best = near.groupBy(*d.columns).agg(F.min_by(F.struct("s", "e", "m"), F.struct(F.abs(F.col("own") - F.col("m")), "s", "e")).alias(f"n{s}"))
        d = best
    return d.select(
        "chr1", F.col("n1.s").alias("start1"), F.col("n1.e").alias("end1"), "chr2", F.col("n2.s").alias("start2"), F.col("n2.e").alias("end2"), F.col("n1.m").alias("local_x"), F.col("n2.m").alias("local_y")
    ).distinct()


def assign_motifs(a: DataFrame, motifs: DataFrame, window: int = 250, permissive: bool = False) -> DataFrame:
    """Motifs whose midpoint is nearer than ``window`` to each side's midpoint: one is taken, of several the closest if ``permissive``; both sides must have one."""
    step = 3 * window
    points = motifs.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), x.mid("start", "end").alias("m")).distinct()
    spread = points.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: div(F.col("m"), step) + o)))
    d = a
    for s in (1, 2):
        m = x.mid(f"start{s}", f"end{s}")
        near = d.withColumns({"chrom": F.col(f"chr{s}"), "bucket": div(m, step), "own": m}).join(spread, ["chrom", "bucket"]).filter(F.abs(F.col("own") - F.col("m")) < window)
        found = near.groupBy(*d.columns).agg(F.count("*").alias("n"), F.min_by(F.struct("s", "e", "m"), F.struct(F.abs(F.col("own") - F.col("m")), "s", "e")).alias("c"))
        kept = found if permissive else found.filter("n = 1")
        d = kept.select(*d.columns, F.col("c.s").alias(f"motif_start_{s}"), F.col("c.e").alias(f"motif_end_{s}"), F.col("c.m").alias(f"motif_mid_{s}"))
    return d


def contained_anchors(a: DataFrame, anchors: DataFrame, side: int = 1, tile: int = TILE) -> DataFrame:
    """Pairs of rows and the anchors inside of one side: midpoint at or after its start, end before its end."""
    points = anchors.select(F.col("chrom").alias(f"chr{side}"), F.col("start").alias("anchor_start"), F.col("end").alias("anchor_end"), div(x.mid("start", "end"), tile).alias("tile"))
    own = a.withColumn("tile", F.explode(tiles(F.col(f"start{side}"), F.col(f"end{side}"), tile)))
    inside = (x.mid("anchor_start", "anchor_end") >= F.col(f"start{side}")) & (F.col("anchor_end") < F.col(f"end{side}"))
    return own.join(points, [f"chr{side}", "tile"]).filter(inside).drop("tile")


def signal_at(points: DataFrame, signal: DataFrame, bin_size: int, default: float = 0.0) -> DataFrame:
    """``value`` of a binned signal (``chrom, bin, value``) at each interval's midpoint, the default where there is none."""
    d = points.withColumn("bin", div(x.mid("start", "end"), bin_size)).join(signal.select("chrom", "bin", "value"), ["chrom", "bin"], "left")
    return d.withColumn("value", F.coalesce("value", F.lit(default)))


def pair_anchors(forward: DataFrame, reverse: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs within a chromosome: forward ends before reverse starts, midpoint distance over ``least`` and up to ``most``."""
    f = forward.select("chrom", F.col("start").alias("fs"), F.col("end").alias("fe"), x.mid("start", "end").alias("fm"))
    r = reverse.select("chrom", F.col("start").alias("rs"), F.col("end").alias("re"), x.mid("start", "end").alias("rm"))
    left = f.withColumn("tile", F.explode(F.sequence(div("fm", most), div(F.col("fm") + most, most))))
    d = F.col("rm") - F.col("fm")
    return left.join(r.withColumn("tile", div("rm", most)), ["chrom", "tile"]).filter((F.col("fe") < F.col("rs")) & (d > least) & (d <= most)).select(
        F.col("chrom").alias("chr1"), F.col("fs").alias("start1"), F.col("fe").alias("end1"), F.col("chrom").alias("chr2"), F.col("rs").alias("start2"), F.col("re").alias("end2")
    )


def pair_anchors_between(forward: DataFrame, reverse: DataFrame, chroms: DataFrame, blocks: int = 16) -> DataFrame:
    """Every forward anchor with every reverse one of a later chromosome. The result itself is a product, so keep the lists short.

    Each side is shuffled once, no anchor is copied there: a task has one part of either side and pairs what is in them.
    There are as many tasks as the setting says, or few more, as sizes say nothing of the rows they give. In a part, anchors
    of a chromosome stand in ``blocks`` arrays, so that few rows meet and pairs are made from these.
    """
    parts = int(forward.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, math.isqrt(parts))
    index = F.broadcast(chroms.select("chrom", "chr_index"))

    def packed(anchors: DataFrame, s: int, n: int) -> DataFrame:
        h = F.xxhash64("chrom", "start", "end")
        own = anchors.select("chrom", F.struct(F.col("start").alias(f"start{s}"), F.col("end").alias(f"end{s}")).alias("_a"), F.pmod(h, F.lit(n)).cast("int").alias("_part"), F.pmod(F.shiftright(h, 32), F.lit(blocks)).alias("_block"))
        held = own.repartitionById(n, F.col("_part")).groupBy("_part", "chrom", "_block").agg(F.collect_list("_a").alias(f"_{s}"))
        return held.join(index, "chrom").select(F.col("chrom").alias(f"chr{s}"), F.col("chr_index").alias(f"_i{s}"), f"_{s}")

    met = packed(forward, 1, rows).join(packed(reverse, 2, -(-parts // rows)).hint("shuffle_replicate_nl"), F.col("_i1") < F.col("_i2"))
    return met.select("chr1", "chr2", "_2", F.explode("_1").alias("_f")).select("chr1", "chr2", "_f", F.explode("_2").alias("_r")).select("chr1", "_f.*", "chr2", "_r.*")


def unordered_anti(a: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose pair of chromosomes isn't listed, whatever its order."""
    key = lambda p, q: F.array_sort(F.array(p, q))
    return a.withColumn("_k", key("chr1", "chr2")).join(pairs.select(key("chr1", "chr2").alias("_k")), "_k", "left_anti").drop("_k")


# --- rectangles and pixels
def window_pixels(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, tile: int | None = None) -> DataFrame:
    """Columns of ``loops`` with ``dx, dy, bin_x, bin_y, counts`` of the positive pixels in each loop's window of 2 * window + 1 bins.

    A loop is copied to the four tiles at most that its window touches, a pixel has one tile; cells are never enumerated.
    """
    tile = tile or 1 << (2 * window).bit_length()  # as wide as the window or little more
    side = {a: div(x.mid(f"start{s}", f"end{s}"), resolution) - window for s, a in ((1, "x0"), (2, "y0"))}
    span = 2 * window + 1
    own = loops.withColumns(side)
    spread = own.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor((F.col("x0") + span - 1) / tile)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor((F.col("y0") + span - 1) / tile))))
    pixels = contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0)).drop("resolution").withColumns({"tx": div("bin_x", tile), "ty": div("bin_y", tile)})
    dx, dy = F.col("bin_x") - F.col("x0"), F.col("bin_y") - F.col("y0")
    return spread.join(pixels, ["chr1", "chr2", "tx", "ty"]).filter(dx.between(0, span - 1) & dy.between(0, span - 1)).withColumns({"dx": dx, "dy": dy}).drop("tx", "ty", "x0", "y0")


def masked_pixels(loops: DataFrame, contacts: DataFrame, resolution: int, window: int) -> DataFrame:
    """Pixels both of whose bins lie in the window of some loop on their axis."""
    out = contacts.filter(F.col("resolution") == resolution)
    for s, b in ((1, "bin_x"), (2, "bin_y")):
        m = div(x.mid(f"start{s}", f"end{s}"), resolution)
        bins = loops.select("chr1", "chr2", F.explode(F.sequence(m - window, m + window)).alias(b)).distinct()
        out = out.join(bins, ["chr1", "chr2", b], "left_semi")
    return out


def near_pixels(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, tile: int | None = None) -> DataFrame:
    """Pixels nearer than ``window`` bins, by rows and columns together, to some loop centre in either orientation; each row of ``contacts`` once."""
    tile = tile or 1 << (2 * window).bit_length()
    own = loops.select("chr1", "chr2", div(x.mid1(), resolution).alias("cx"), div(x.mid2(), resolution).alias("cy")).distinct()
    both = own.unionByName(own.select("chr1", "chr2", F.col("cy").alias("cx"), F.col("cx").alias("cy")))
    reach = lambda c: F.sequence(F.floor((F.col(c) - window) / tile), F.floor((F.col(c) + window) / tile))
    spread = both.withColumn("tx", F.explode(reach("cx"))).withColumn("ty", F.explode(reach("cy")))
    spread = spread.select(*[F.col(c).alias(f"_{c}") for c in ("chr1", "chr2", "tx", "ty")], "cx", "cy")
    pixels = contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0)).withColumns({"tx": div("bin_x", tile), "ty": div("bin_y", tile)})
    # a pixel has one tile, so the join ends at the first centre near it
    same = [F.col(c) == F.col(f"_{c}") for c in ("chr1", "chr2", "tx", "ty")]
    hit = F.abs(F.col("bin_x") - F.col("cx")) + F.abs(F.col("bin_y") - F.col("cy")) < window
    return pixels.join(spread, [*same, hit], "left_semi").drop("tx", "ty")


def not_below_neighbour(pixels: DataFrame, value: str = "counts") -> DataFrame:
    """Pixels without a strictly greater neighbour among the eight around them; ties stay."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    seen = pixels.select("chr1", "chr2", "bin_x", "bin_y", F.col(value).alias("v"), F.explode(steps).alias("s")).select("chr1", "chr2", (F.col("bin_x") + F.col("s.i")).alias("bin_x"), (F.col("bin_y") + F.col("s.j")).alias("bin_y"), "v")
    best = seen.groupBy("chr1", "chr2", "bin_x", "bin_y").agg(F.max("v").alias("around"))
    return pixels.join(best, ["chr1", "chr2", "bin_x", "bin_y"], "left").filter(F.col("around").isNull() | (F.col("around") <= F.col(value))).drop("around")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
