"""Binned one-dimensional signals: rasters, coverage, runs, smoothing, local maxima, correlation, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import div
from strandweave.operators.tiled import islands, running, with_halo

#: Fixed values of the smoothing kernels.
THREE_TAPS = (0.24, 0.52, 0.24)
FIVE_TAPS = (0.055, 0.245, 0.4, 0.245, 0.055)


def raster(lines: DataFrame, bin_size: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``*keys, bin, value`` of lines ``chrom, start, end, value, line_no``: the last line wins; one narrower than a bin writes nothing."""
    first, stop = div("start", bin_size), div("end", bin_size)
    return lines.filter(first < stop).withColumn("bin", F.explode(F.sequence(first, stop - 1))).groupBy(*keys, "bin").agg(F.max_by("value", "line_no").alias("value"))


def coverage(intervals: DataFrame, bin_size: int = 10, widest: int | None = 400, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``*keys, bin, n``: intervals over each bin, the end's bin included; only intervals narrower than ``widest``."""
    d = intervals.filter("start IS NOT NULL AND end IS NOT NULL AND end >= start")
    if widest is not None:
        d = d.filter(F.col("end") - F.col("start") < widest)
    return d.withColumn("bin", F.explode(F.sequence(div("start", bin_size), div("end", bin_size)))).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def runs(bins: DataFrame, bin_size: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Gaps and islands: maximal runs of adjacent bins as ``start, end, n_bins``, found by tiles."""
    return islands(bins, keys).select(*keys, (F.col("first") * bin_size).alias("start"), (F.col("last") * bin_size + bin_size).alias("end"), F.col("n").alias("n_bins"))


def merged_coverage(intervals: DataFrame, bin_size: int = 10, widest: int | None = 400, least: int = 3, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    return runs(coverage(intervals, bin_size, widest, keys).filter(F.col("n") >= least), bin_size, keys)


def dense(signal: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Every bin from the first to the last of a key, 0 where the signal has none."""
    ends = signal.groupBy(*keys).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    grid = ends.withColumn("bin", F.explode(F.sequence("a", "b"))).drop("a", "b")
    return grid.join(signal, [*keys, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def smooth(signal: DataFrame, taps: Sequence[float] = FIVE_TAPS, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Weighted sum over neighbours of a dense signal; the outermost bins are copied."""
    h = len(taps) // 2

    def total(w: WindowSpec) -> dict[str, Column]:
        terms = [F.lag("value", h - i).over(w) if i < h else F.lead("value", i - h).over(w) if i > h else F.col("value") for i in range(len(taps))]
        out = terms[0] * taps[0]
        for t, k in zip(terms[1:], taps[1:]):
            out = out + t * k
        return {"smooth": F.coalesce(out, F.col("value"))}

    return with_halo(signal, keys, h, total)


def local_maxima(signal: DataFrame, above: float | None = None, keys: Sequence[str] = ("chrom",), value: str = "value") -> DataFrame:
    """Bins of a dense signal strictly greater than both neighbours; the outermost ones never are."""
    d = with_halo(signal, keys, 1, lambda w: {"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)}).filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")))
    return (d if above is None else d.filter(F.col(value) > above)).drop("_p", "_n")


def five_point_peaks(signal: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Bins of a dense signal with a rise over the two before and a fall over the two after."""

    def ok(w: WindowSpec) -> dict[str, Column]:
        v = [F.lag("value", 2).over(w), F.lag("value").over(w), F.col("value"), F.lead("value").over(w), F.lead("value", 2).over(w)]
        return {"_ok": (v[0] < v[1]) & (v[1] < v[2]) & (v[2] > v[3]) & (v[3] > v[4])}

    return with_halo(signal, keys, 2, ok).filter("_ok").drop("_ok")


def best_near(signal: DataFrame, reach: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``best``: of all bins within ``reach`` the one with the greatest value; the bin itself wins ties, then the first."""

    def best(w: WindowSpec) -> dict[str, Column]:
        near = w.rangeBetween(-reach, reach)
        top = F.max_by("bin", F.struct("value", -F.col("bin"))).over(near)
        return {"best": F.when(F.max("value").over(near) > F.col("value"), top).otherwise(F.col("bin"))}

    return with_halo(signal, keys, reach, best)


def runs_with_gap_fill(marks: DataFrame, longer_than: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Half-open runs ``first, stop`` of marked bins, single gaps filled, only those longer than ``longer_than``."""
    d = with_halo(marks.select(*keys, "bin").distinct(), keys, 2, lambda w: {"next": F.lead("bin").over(w)})
    filled = d.unionByName(d.filter(F.col("next") == F.col("bin") + 2).withColumn("bin", F.col("bin") + 1))
    return runs(filled, 1, keys).filter(F.col("n_bins") > longer_than).select(*keys, F.col("start").alias("first"), F.col("end").alias("stop"))


def cumulative(weights: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``cdf``: running share of ``weight`` in order, whose first column is a number."""
    d = running(weights, keys, order, F.col("weight"), "_before", "_all")
    return d.withColumn("cdf", (F.col("_before") + F.col("weight")) / F.col("_all")).drop("_before", "_all")


def rolling_median(curve: DataFrame, reach: int, keys: Sequence[str] = ()) -> DataFrame:
    """Over neighbouring rows of a curve with one row for each distance, so a key is as short as a chromosome in bins."""
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(-reach, reach)
    return curve.withColumn("median", F.percentile("value", 0.5).over(w))


def stride(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every n-th row in order, the first included; the first column of the order is a number."""
    return running(df, keys, order, F.lit(1), "_n").filter(F.col("_n") % n == 0).drop("_n")


def centred(value: Column, log: bool) -> Column:
    """Ratio signals around 0: less 1 or their logarithm, nothing below 0."""
    return F.greatest(F.when(value > 0, F.ln(value)) if log else value - 1, F.lit(0.0))


def track_similarity(signals: DataFrame, log: bool = False) -> DataFrame:
    """``a, b, pearson, cosine`` of each pair of tracks over the bins where one of both is not 0.

    Absent bins are 0 and add nothing to sums, so one join on bins gives the products and the count of the union
    follows from three counts.
    """
    s = signals.withColumn("v", centred(F.col("value"), log)).filter("abs(v) >= 1e-10").select("track", "chrom", "bin", "v")
    single = s.groupBy("track").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    both = s.withColumnsRenamed({"track": "a", "v": "u"}).join(s.withColumnRenamed("track", "b"), ["chrom", "bin"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("uv"), F.count("*").alias("m"))
    one = single.withColumnsRenamed({"track": "a", "n": "na", "s": "sa", "q": "qa"})
    two = single.withColumnsRenamed({"track": "b", "n": "nb", "s": "sb", "q": "qb"})
    n = F.col("na") + F.col("nb") - F.col("m")
    cov = F.col("uv") - F.col("sa") * F.col("sb") / n
    var = (F.col("qa") - F.col("sa") * F.col("sa") / n) * (F.col("qb") - F.col("sb") * F.col("sb") / n)
    return both.join(one, "a").join(two, "b").select("a", "b", (cov / F.sqrt(var)).alias("pearson"), (F.col("uv") / F.sqrt(F.col("qa") * F.col("qb"))).alias("cosine"))


def annotated(anchors: DataFrame, signal: DataFrame, bin_size: int) -> DataFrame:
    from strandweave.operators.joins import signal_at

    return signal_at(anchors, signal, bin_size)


def signal_sieve(loops: DataFrame, signal: DataFrame, bin_size: int = 1000, above: float = 2.0) -> DataFrame:
    """``route`` is good where both midpoints lie on a strict local maximum over ``above``, else bad."""
    ends = signal.groupBy(F.col("chrom").alias("_c")).agg(F.min("bin").alias("_a"), F.max("bin").alias("_z"))
    beside = lambda w: {"_pb": F.lag("bin").over(w), "_nb": F.lead("bin").over(w), "_p": F.lag("value").over(w), "_n": F.lead("value").over(w)}
    d = with_halo(signal, ["chrom"], 1, beside)
    # bins that the signal lacks are 0; the track's first and last bin are never a maximum
    before = F.when(F.col("_pb") == F.col("bin") - 1, F.col("_p")).otherwise(0.0)
    after = F.when(F.col("_nb") == F.col("bin") + 1, F.col("_n")).otherwise(0.0)
    high = d.filter((F.col("value") > above) & (F.col("value") > before) & (F.col("value") > after))
    peaks = high.join(ends, F.col("chrom") == F.col("_c")).filter("bin > _a AND bin < _z").select("chrom", "bin")
    out = loops
    for s in (1, 2):
        p = peaks.select(F.col("chrom").alias(f"chr{s}"), F.col("bin").alias(f"bin{s}"), F.lit(True).alias(f"ok{s}"))
        out = out.withColumn(f"bin{s}", div(x.mid(f"start{s}", f"end{s}"), bin_size)).join(p, [f"chr{s}", f"bin{s}"], "left")
    good = F.coalesce("ok1", F.lit(False)) & F.coalesce("ok2", F.lit(False))
    return out.withColumn("route", F.when(good, "good").otherwise("bad")).drop("bin1", "bin2", "ok1", "ok2")


def profile(peaks: DataFrame, track: DataFrame, bin_size: int, window: int) -> DataFrame:
    """``offset, total, n_peaks``: summed positive signal at each interval's start around peak midpoints, and the peaks that any of it reaches."""
    span = (2 * window + 1) * bin_size
    own = peaks.select("chrom", F.monotonically_increasing_id().alias("peak"), (x.mid("start", "end") - window * bin_size).alias("g"))
    spread = own.withColumn("tile", F.explode(F.sequence(F.floor(F.col("g") / span), F.floor((F.col("g") + span - 1) / span))))
    points = track.filter("value > 0").select("chrom", "start", "value", F.floor(F.col("start") / span).alias("tile"))
    hits = spread.join(points, ["chrom", "tile"]).filter((F.col("start") >= F.col("g")) & (F.col("start") < F.col("g") + span))
    return hits.withColumn("offset", div(F.col("start") - F.col("g"), bin_size)).groupBy("offset").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
