"""Greedy and sequential kernels: one pandas group per tile, in a fixed total order.

Group sizes are bounded by tiles (or by a grid in suppression over whole chromosomes), never by the data; all other
steps are plain DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS, div
from strandweave.operators import signals, windows

FUSE_TILE = 5_000_000
#: A summit has more positive pixels than these.
FEW = 4
BOX = "chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint, n_merged bigint"


# --- coalescing and suppression of features
def fuse_tile(rows: np.ndarray, suppress: bool) -> list[tuple]:
    """Seeds in order of widths and coordinates; each takes all that overlap it, widened by its width unless ``suppress``.

    ``rows``: start1, end1, start2, end2. Returns boxes (or, to suppress, seeds) with the number of features in them.
    """
    w1, w2 = rows[:, 1] - rows[:, 0], rows[:, 3] - rows[:, 2]
    order = np.lexsort((rows[:, 3], rows[:, 1], rows[:, 2], rows[:, 0], w2, w1))
    rows, w1, w2 = rows[order], w1[order], w2[order]
    alive, out = np.ones(len(rows), bool), []
    for i in range(len(rows)):
        if not alive[i]:
            continue
        s1, e1, s2, e2 = rows[i]
        b = 0 if suppress else max(w1[i], w2[i])
        hit = alive & (rows[:, 0] < e1 + b) & (s1 - b < rows[:, 1]) & (rows[:, 2] < e2 + b) & (s2 - b < rows[:, 3])
        hit[i] = True
        alive &= ~hit
        group = rows[hit]
        box = (s1, e1, s2, e2) if suppress else (group[:, 0].min(), group[:, 1].max(), group[:, 2].min(), group[:, 3].max())
        out.append((*map(int, box), int(hit.sum())))
    return out


def fuse(features: DataFrame, suppress: bool = False, tile: int = FUSE_TILE) -> DataFrame:
    """Distinct features coalesced to boxes (or suppressed by their finest neighbour) within midpoint tiles; boxes aren't merged again."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = fuse_tile(pdf[["start1", "end1", "start2", "end2"]].to_numpy("int64"), suppress)
        return pd.DataFrame([(key[0], a, b, key[1], c, d, n) for a, b, c, d, n in found], columns=[c.split()[0] for c in BOX.split(", ")])

    once = features.select(*COORDS).dropna().distinct()
    return once.groupBy("chr1", "chr2", div(x.mid1(), tile).alias("tx"), div(x.mid2(), tile).alias("ty")).applyInPandas(run, BOX)


# --- collapsing pixels
def collapse_tile(px: np.ndarray, py: np.ndarray, v: np.ndarray, reach: int, ratio: float) -> list[int]:
    """Indices of accepted seeds. Strongest first; a box grows around all of its members until it stays."""
    order = np.lexsort((py, px, -v))
    alive, out = np.ones(len(v), bool), []
    for i in order:
        if not alive[i]:
            continue
        alive[i] = False
        members = [i]
        x0, x1, y0, y1 = px[i] - reach, px[i] + reach + 1, py[i] - reach, py[i] + reach + 1
        grown = True
        while grown:
            grown = False
            for j in order:
                if alive[j] and x0 <= px[j] < x1 and y0 <= py[j] < y1:
                    alive[j] = False
                    members.append(j)
                    x0, x1, y0, y1 = min(x0, px[j] - reach), max(x1, px[j] + reach + 1), min(y0, py[j] - reach), max(y1, py[j] + reach + 1)
                    grown = True
        if len(members) > reach and v[i] / np.mean(v[members[1:]]) > ratio:
            out.append(int(i))
    return out


def collapse_centroids(pixels: DataFrame, reach: int, ratio: float = 1.5, tile: int = 250) -> DataFrame:
    """Pixels that seed an accepted cluster, per tile of bins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = collapse_tile(pdf["bin_x"].to_numpy(), pdf["bin_y"].to_numpy(), pdf["counts"].to_numpy("float64"), reach, ratio)
        return pdf.iloc[keep][["chr1", "chr2", "bin_x", "bin_y", "counts"]]

    d = pixels.select("chr1", "chr2", "bin_x", "bin_y", F.col("counts").cast("double").alias("counts"))
    return d.groupBy("chr1", "chr2", div("bin_x", tile).alias("tx"), div("bin_y", tile).alias("ty")).applyInPandas(run, "chr1 string, chr2 string, bin_x bigint, bin_y bigint, counts double")


def collapse_resolutions_tile(rows: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Rows ``(resolution, bin_x, bin_y, counts)``; finest and strongest first; boxes of one bin around; kept if two resolutions meet."""
    rest = sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2]))
    box = lambda r: (r[1] * r[0] - r[0], r[1] * r[0] + 2 * r[0], r[2] * r[0] - r[0], r[2] * r[0] + 2 * r[0])
    out = []
    while rest:
        seed, rest = rest[0], rest[1:]
        a, b, c, d = box(seed)
        seen, grown = {seed[0]}, True
        while grown:
            grown, left = False, []
            for r in rest:
                e, f, g, h = box(r)
                if e < b and a < f and g < d and c < h:
                    a, b, c, d, grown = min(a, e), max(b, f), min(c, g), max(d, h), True
                    seen.add(r[0])
                else:
                    left.append(r)
            rest = left
        if len(seen) > 1:
            out.append(seed)
    return out


def collapse_resolutions(pixels: DataFrame, tile: int = FUSE_TILE) -> DataFrame:
    """Seeds seen at two resolutions or more, as boxes of three bins."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["resolution"].tolist(), pdf["bin_x"].tolist(), pdf["bin_y"].tolist(), pdf["counts"].tolist()))
        out = [(key[0], a * r - r, a * r + 2 * r, key[1], b * r - r, b * r + 2 * r, r) for r, a, b, _ in collapse_resolutions_tile(rows)]
        return pd.DataFrame(out, columns=[*COORDS, "resolution"])

    d = pixels.select("chr1", "chr2", F.col("resolution").cast("bigint"), "bin_x", "bin_y", F.col("counts").cast("double").alias("counts"))
    at = lambda b: div(F.greatest(F.col(b) * F.col("resolution") - F.col("resolution"), F.lit(0).cast("bigint")), tile)
    return d.groupBy("chr1", "chr2", at("bin_x").alias("tx"), at("bin_y").alias("ty")).applyInPandas(run, "chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint, resolution bigint")


def suppress_near(pixels: DataFrame, radius: int, value: str = "high") -> DataFrame:
    """Descending by value: a kept pixel removes all within an integer distance of ``radius``, over whole chromosomes.

    Done by rounds on a grid instead of in one task: a pixel stays once nothing left that is stronger is near it, and
    what stays removes its neighbours. Each round settles the strongest open pixel of every neighbourhood, so rounds
    end by themselves, when nothing is open; a ridge that falls steadily needs one for each pixel that stays on it.
    Each is written to the shared folder.
    """
    from strandweave.session import materialize

    cell = max(1, radius + 1)
    order = lambda p: F.struct(F.col(f"{p}v"), -F.col(f"{p}bin_x"), -F.col(f"{p}bin_y"))
    open_ = pixels.select("chr1", "chr2", F.col("bin_x").cast("bigint"), F.col("bin_y").cast("bigint"), F.col(value).cast("double").alias("v")).withColumns({"cx": div("bin_x", cell), "cy": div("bin_y", cell)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    keep = None
    key = ["chr1", "chr2", "cx", "cy"]

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select("chr1", "chr2", F.col("bin_x").alias("o_bin_x"), F.col("bin_y").alias("o_bin_y"), F.col("v").alias("o_v"), "cx", "cy").withColumn("s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
        dx, dy = F.col("bin_x") - F.col("o_bin_x"), F.col("bin_y") - F.col("o_bin_y")
        return a.join(other, key).filter((F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))) <= radius) & ((dx != 0) | (dy != 0)))

    ids = ["chr1", "chr2", "bin_x", "bin_y"]
    while True:
        open_ = materialize(open_, "suppress-open")
        if open_.isEmpty():
            break
        beaten = pairs(open_, open_).filter(order("o_") > order("")).select(*ids).distinct()
        won = materialize(open_.join(beaten, ids, "left_anti"), "suppress-won")
        keep = won if keep is None else keep.unionByName(won)
        open_ = open_.join(won, ids, "left_anti").join(pairs(open_, won).select(*ids).distinct(), ids, "left_anti")
    return (open_ if keep is None else keep).select(*ids, F.col("v").alias(value))


# --- anchors
def anchorize(loops: DataFrame, resolution: int = 200) -> DataFrame:
    """``axis, chrom, cluster_start, cluster_stop, n, mu, sigma, low, high``: local points clustered as runs of adjacent bins.

    Clusters of two points or more have an integer mean and a population deviation; a single point joins the nearest
    such cluster within 2.5 bins or stands alone with a deviation of 2.5 bins. Bounds are mu -/+ 1.96 sigma.
    """
    points = loops.filter("local_x IS NOT NULL AND local_y IS NOT NULL").select("chr1", "chr2", "local_x", "local_y").distinct()
    axes = F.array(F.struct(F.lit("upstream").alias("axis"), F.col("chr1").alias("chrom"), F.col("local_x").alias("p")), F.struct(F.lit("downstream").alias("axis"), F.col("chr2").alias("chrom"), F.col("local_y").alias("p")))
    p = points.select(F.explode(axes).alias("a")).select("a.*").withColumn("bin", div("p", resolution))
    keys = ["axis", "chrom"]
    bins = signals.runs(p, 1, keys).select(*keys, F.col("start").alias("a"), F.col("end").alias("b"))
    labelled = p.join(bins.withColumn("bin", F.explode(F.sequence("a", F.col("b") - 1))), [*keys, "bin"])
    sums = labelled.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), F.avg("p").alias("m"), F.min("p").alias("p"))
    big = sums.filter("n > 1").select(*keys, "a", "b", F.floor("m").alias("mu"))
    spread = labelled.join(big, [*keys, "a", "b"]).groupBy(*keys, "a", "b", "mu").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("p") - F.col("mu"), 2))).alias("sigma"))
    far = 2.5 * resolution
    reach = F.transform(F.array(*[F.lit(i) for i in range(-3, 4)]), lambda i: div("mu", resolution) + i)
    lone = sums.filter("n = 1").select(*keys, "a", "b", "p")
    near = lone.withColumn("bin", div("p", resolution)).join(spread.select(*keys, F.explode(reach).alias("bin"), "mu"), [*keys, "bin"]).filter(F.abs(F.col("mu") - F.col("p")) < far).select(*keys, "a", "b").distinct()
    alone = lone.join(near, [*keys, "a", "b"], "left_anti").select(*keys, "a", "b", F.col("p").alias("mu"), F.lit(1).cast("bigint").alias("n"), F.lit(far).alias("sigma"))
    whole = spread.select(*keys, "a", "b", "mu", "n", "sigma").unionByName(alone)
    return whole.select(
        *keys, F.col("a").alias("first_bin"), F.col("b").alias("stop_bin"), "n", "mu", "sigma", F.floor(F.col("mu") - 1.96 * F.col("sigma")).alias("low"), F.floor(F.col("mu") + 1.96 * F.col("sigma")).alias("high")
    )


def high_res_counts(loops: DataFrame, resolution: int) -> DataFrame:
    """``chrom, bin, n``: local points of all lists per bin; missing ones are skipped."""
    ends = F.array(F.struct(F.col("chr1").alias("chrom"), F.col("local_x").alias("p")), F.struct(F.col("chr2").alias("chrom"), F.col("local_y").alias("p")))
    return loops.select(F.explode(ends).alias("e")).select("e.*").filter("p IS NOT NULL").groupBy("chrom", div("p", resolution).alias("bin")).agg(F.count("*").alias("n"))


def integrate(loops: DataFrame, resolution: int = 10, reach: int = 10, bounds: bool = True) -> DataFrame:
    """Distinct loops of one bin a side: local points snapped to the best smoothed count around them, if that is a strict local maximum over 1.

    A side whose local point is missing or gives none takes the best of its bounds, widened by ``reach``, under the same
    condition; without ``bounds`` such loops are left out.
    """
    from pyspark.sql import Window

    from strandweave.session import materialize

    counts = high_res_counts(loops, resolution).select("chrom", "bin", F.col("n").cast("double").alias("value"))
    kernel = F.array(*[F.struct(F.lit(i - 2).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(signals.FIVE_TAPS)])
    parts = counts.select("chrom", "value", "bin", F.explode(kernel).alias("s")).select("chrom", (F.col("bin") + F.col("s.o")).alias("bin"), (F.col("value") * F.col("s.k")).alias("v"))
    smooth = parts.groupBy("chrom", "bin").agg(F.round(F.sum("v"), 9).alias("v"))
    # only a bin over 1 can be taken, or keep another from being the best or a maximum, so lower ones don't matter
    w = Window.partitionBy("chrom").orderBy("bin")
    beside = lambda f, o: F.when(f("bin").over(w) == F.col("bin") + o, f("v").over(w)).otherwise(0.0)
    peak = (F.col("bin") > 0) & (F.col("v") > beside(F.lag, -1)) & (F.col("v") > beside(F.lead, 1))
    high = materialize(smooth.filter("v > 1").withColumn("peak", peak), "integrate-high").withColumn("t", div("bin", 64))

    out = loops.select("chr1", "chr2", *([c for c in COORDS if c not in ("chr1", "chr2")] if bounds else []), "local_x", "local_y").distinct()
    one, sites = F.lit(1).cast("bigint"), []
    for s, p in ((1, "local_x"), (2, "local_y")):
        # a local point in bin 0 is not searched beside, but is itself the first guess
        at = div(p, resolution)
        own = {f"a{s}": F.greatest(at - reach, F.least(at, one)), f"b{s}": at + reach + 1, f"pos{s}": at}
        low, stop = F.greatest(div(f"start{s}", resolution) - reach, one), div(f"end{s}", resolution) + reach + 1
        wide = {f"c{s}": low, f"d{s}": stop, f"mid{s}": div(low + stop, 2)} if bounds else {}
        for way in (own, wide) if bounds else (own,):
            sites.append(F.struct(F.col(f"chr{s}").alias("chrom"), *[v.alias(n) for v, n in zip(way.values(), ("a", "b", "pos"))]))
        out = out.withColumns(own | wide)
    spread = out.select(F.explode(F.array(*sites)).alias("e")).select("e.*").filter("pos >= 0").distinct().withColumn("t", F.explode(x.tiles(F.col("a"), F.col("b"), 64)))
    hits = spread.join(high, ["chrom", "t"]).filter("bin >= a AND bin < b")
    best = hits.groupBy("chrom", "a", "b", "pos").agg(F.max_by(F.struct("bin", "peak"), F.struct(F.col("v"), (F.col("bin") == F.col("pos")).cast("int"), -F.col("bin"))).alias("h"))
    found = materialize(best.filter("h.peak").select("chrom", "a", "b", "pos", F.col("h.bin").alias("bin")), "integrate-found")
    for s in (1, 2):
        for n, names in enumerate((("a", "b", "pos"), ("c", "d", "mid")) if bounds else (("a", "b", "pos"),)):
            keys = [f"chr{s}", *[f"{k}{s}" for k in names]]
            out = out.join(found.toDF(*keys, f"bin{s}{n}"), keys, "left")
        out = out.withColumn(f"bin{s}", F.coalesce(*[f"bin{s}{n}" for n in range(1 + bounds)])).filter(F.col(f"bin{s}").isNotNull())
    side = lambda s: [f"chr{s}", (F.col(f"bin{s}") * resolution).alias(f"start{s}"), (F.col(f"bin{s}") * resolution + resolution).alias(f"end{s}")]
    return out.select(*side(1), *side(2)).distinct()


# --- tests
def _beta_fraction(a: float, b: float, t: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * t / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * t / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-12:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    from math import exp, lgamma, log

    if not np.isfinite(t) or df <= 0:
        return 0.0 if np.isinf(t) and df > 0 else float("nan")
    u = df / (df + t * t)
    if u <= 0.0 or u >= 1.0:
        return 1.0 if u >= 1.0 else 0.0
    a, b = df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(u) + b * log(1 - u))
    return front * _beta_fraction(a, b, u) / a if u < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - u) / b


def two_sample_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p of Welch's test; NaN where a side has fewer than two values."""
    if len(a) < 2 or len(b) < 2:
        return float("nan")
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if va + vb == 0:
        return 0.0 if a.mean() != b.mean() else 1.0
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return t_two_sided((a.mean() - b.mean()) / (va + vb) ** 0.5, df)


def one_sample_p(mu: float, a: np.ndarray) -> float:
    if len(a) < 2:
        return float("nan")
    s = a.std(ddof=1)
    return (1.0 if a.mean() == mu else 0.0) if s == 0 else t_two_sided((a.mean() - mu) / (s / len(a) ** 0.5), len(a) - 1)


def t_tests(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the two-sided p of Welch's test between ``side`` a and b; moments are aggregates, only the tail is a UDF."""
    m = samples.groupBy(*keys).pivot("side", ["a", "b"]).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))

    @F.pandas_udf("double")
    def tail(n1: pd.Series, m1: pd.Series, v1: pd.Series, n2: pd.Series, m2: pd.Series, v2: pd.Series) -> pd.Series:
        a, b = v1 / n1, v2 / n2
        df = (a + b) ** 2 / (a**2 / (n1 - 1) + b**2 / (n2 - 1))
        return pd.Series([t_two_sided(t, d) for t, d in zip((m1 - m2) / np.sqrt(a + b), df)])

    return m.filter("a_n > 1 AND b_n > 1 AND a_v + b_v > 0").withColumn("p", tail("a_n", "a_m", "a_v", "b_n", "b_m", "b_v")).select(*keys, "a_n", "b_n", "p")


# --- pinpoint: summits of loops by kernel density
def cone(half: int) -> np.ndarray:
    i = np.abs(np.arange(-half, half + 1))
    k = np.maximum(0, half - (i[:, None] + i[None, :])).astype("float64")
    return k / max(k.max(), 1)


def smear(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Scatter of positive cells with a kernel."""
    h = kernel.shape[0] // 2
    out = np.zeros((image.shape[0] + 2 * h, image.shape[1] + 2 * h))
    for i, j in zip(*np.nonzero(image > 0)):
        out[i : i + kernel.shape[0], j : j + kernel.shape[1]] += image[i, j] * kernel
    return out[h : out.shape[0] - h, h : out.shape[1] - h]


def enriched_boxes(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes around cells over max(.7 maximum, mean + 3 sd of cells over 1), grown greedily over touching cells."""
    inside = image[image > 1]
    if not len(inside):
        return []
    cut = max(0.7 * image.max(), inside.mean() + 3 * inside.std(ddof=1) if len(inside) > 1 else 0.0)
    open_ = sorted(map(tuple, np.argwhere(image > cut)), key=lambda p: (-image[p], p))
    boxes = []
    while open_:
        i, j = open_.pop(0)
        a, b, c, d = i, i + 1, j, j + 1
        grown = True
        while grown:
            touch = [p for p in open_ if a - 1 <= p[0] <= b and c - 1 <= p[1] <= d]
            grown = bool(touch)
            for p in touch:
                open_.remove(p)
                a, b, c, d = min(a, p[0]), max(b, p[0] + 1), min(c, p[1]), max(d, p[1] + 1)
        boxes.append((int(a), int(b), int(c), int(d)))
    return boxes


def summit(raw: np.ndarray, density: np.ndarray) -> tuple[float, float, int] | None:
    """Weighted mean row and column of the parts of a box that stand out, and the pixels there; None where there are too few."""
    if (raw > 0).sum() <= FEW:
        return None
    out = []
    for axis in (1, 0):
        s = (raw.sum(axis) / max(raw.sum(axis).max(), 1e-300)) * (density.sum(axis) / max(density.sum(axis).max(), 1e-300))
        positive = s[s > 0]
        keep = s > max(0.5, 3 * np.median(positive) if len(positive) else 0.0)
        keep = keep if keep.any() else s >= s.max()
        at = np.nonzero(keep)[0]
        out.append(float((at * s[at]).sum() / s[at].sum()))
    return out[0], out[1], int((raw > 0).sum())


def _image(cells, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for c in cells:
        m[c["dx"], c["dy"]] = c["v"]
    return m


def _kernels(resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """The rough and the fine one."""
    return cone(max(400 // resolution + 1, 3)), cone(max(2000 // resolution + 1, 3))


def _summits(m: np.ndarray, smeared: np.ndarray, fine: np.ndarray, coarse: int) -> list[tuple]:
    """Peak, box and pixels in each enriched box of a window, of which ``smeared`` is the coarse image."""
    out = []
    for a, b, c, d in enriched_boxes(smeared):
        a, b, c, d = a * coarse, min(b * coarse, m.shape[0]), c * coarse, min(d * coarse, m.shape[1])
        part = m[a:b, c:d]
        top = summit(part, smear(part, fine)) if (part > 0).sum() > FEW else None
        if top:
            out.append((a + top[0], c + top[1], a, b, c, d, top[2]))
    return out


def _shape(types: dict[str, str], identity: Sequence[str]) -> str:
    return ", ".join(f"{c} {types[c]}" for c in identity) + ", peak_x double, peak_y double, box_start1 bigint, box_end1 bigint, box_start2 bigint, box_end2 bigint, n_pixels bigint"


def pinpoint(windows: DataFrame, identity: list[str], resolution: int, window: int, coarse: int = 20) -> DataFrame:
    """Summits of windows (``cells`` and their first bins ``x0, y0``): coarse boxes, then density at full resolution in each.

    A window is one row, so memory is bounded by its width.
    """
    shape = _shape(dict(windows.dtypes), identity)
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches):
        rough, fine = _kernels(resolution)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = _image(r["cells"], 2 * window + 1)
                n = -(-m.shape[0] // coarse) * coarse
                padded = np.zeros((n, n))
                padded[: m.shape[0], : m.shape[1]] = m
                small = padded.reshape(n // coarse, coarse, n // coarse, coarse).sum((1, 3))
                at = lambda o, v: (r[o] + v) * resolution  # noqa: B023, E731
                for px, py, a, b, c, d, k in _summits(m, smear(small, rough), fine, coarse):
                    rows.append((*[r[k] for k in identity], at("x0", px), at("y0", py), at("x0", a), at("x0", b), at("y0", c), at("y0", d), k))
            yield pd.DataFrame(rows, columns=names)

    return windows.select(*identity, "x0", "y0", "cells").mapInPandas(run, shape)


def smear_all(images: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """``smear`` of many images without negative cells, which the last axis counts, in the same order of sums."""
    h, n = kernel.shape[0] // 2, images.shape[:2]
    out, scaled = np.zeros_like(images), {w: images * w for w in np.unique(kernel[kernel > 0])}
    for i in range(-h, h + 1):
        for j in range(-h, h + 1):
            if kernel[h - i, h - j] and abs(i) < n[0] and abs(j) < n[1]:
                to, source = (tuple(slice(max(0, s * k), m + min(0, s * k)) for k, m in zip((i, j), n)) for s in (-1, 1))
                out[to] += scaled[kernel[h - i, h - j]][source]
    return out


def least_cuts(images: np.ndarray) -> np.ndarray:
    """The cut of ``enriched_boxes`` in many images, which the last axis counts, or less than it by rounding at most; infinite where nothing is over 1."""
    flat = images.reshape(-1, images.shape[2])
    inside = flat > 1
    n = inside.sum(0)
    mean = np.where(inside, flat, 0).sum(0) / np.maximum(n, 1)
    sd = np.sqrt((np.where(inside, flat - mean, 0) ** 2).sum(0) / np.maximum(n - 1, 1))
    return np.where(n > 0, np.maximum(0.7 * flat.max(0), np.where(n > 1, mean + 3 * sd, 0)) * (1 - 1e-9), np.inf)


def _sums_of(n: int, parts: Callable[[slice], np.ndarray], size: int) -> np.ndarray:
    """Sums over ``n`` of ``size`` rows or columns, by their first."""
    if n == 1:
        return parts(slice(0, size))
    out = parts(slice(0, size - n + 1)) + parts(slice(1, size - n + 2))
    for k in range(2, n):
        out += parts(slice(k, size - n + 1 + k))
    return out


def coarse_windows(image: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, span: int, coarse: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows in coarse cells, for some loops after the other, which the last axis counts; the last row and column have what is left."""
    full, rest = divmod(span, coarse)
    steps = [(slice(0, full), coarse, np.arange(full) * coarse)] * (full > 0) + [(slice(full, full + 1), rest, np.array([full * coarse]))] * (rest > 0)
    blocks = []
    for i, m, p in steps:
        rows = _sums_of(m, lambda at: image[at], image.shape[0])
        for j, n, q in steps:
            sums = _sums_of(n, lambda at: rows[:, at], image.shape[1])  # noqa: B023
            blocks.append((i, j, (p[:, None] * sums.shape[1] + q)[:, :, None], sums))
    side, many = full + (rest > 0), windows.CHUNK // 4
    for k in range(0, len(at_x), many):
        part = slice(k, k + many)
        small = np.empty((side, side, len(at_x[part])))
        for i, j, off, sums in blocks:
            small[i, j] = sums.reshape(-1).take(off + (at_x[part] * sums.shape[1] + at_y[part]))
        yield part, small


def pinpoint_in_tiles(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, coarse: int = 20, tile: int = 512) -> DataFrame:
    """``pinpoint`` of the windows of distinct loops, in the tiles of ``windows``, which no window leaves.

    Windows of one place are looked at once. Coarse images of all are made, smeared and judged together; only those in
    which something may stand out are taken one by one.
    """
    rough, fine = _kernels(resolution)
    span, names = 2 * window + 1, ["peak_x", "peak_y", "box_start1", "box_end1", "box_start2", "box_end2", "n_pixels"]

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        image, side = images[0], images[0].shape[1]
        places, of = np.unique(at_x[0].astype("int64") * side + at_y[0], return_inverse=True)
        px, py, found, rows = places // side, places % side, [], []
        for part, small in coarse_windows(image, px, py, span, coarse):
            smeared = smear_all(small, rough)
            over = smeared > least_cuts(smeared)
            for k in np.flatnonzero(over.any((0, 1))):
                i, j = px[part.start + k], py[part.start + k]
                m, (u, v) = image[i : i + span, j : j + span], np.nonzero(over[:, :, k])
                # every box lies in the one around all cells over the cut
                if np.count_nonzero(m[u.min() * coarse : (u.max() + 1) * coarse, v.min() * coarse : (v.max() + 1) * coarse]) > FEW:
                    for r in _summits(m, np.ascontiguousarray(smeared[:, :, k]), fine, coarse):
                        found.append(part.start + k)
                        rows.append(r)
        first, last = (np.searchsorted(np.array(found, "int64"), of, s) for s in ("left", "right"))
        n = last - first
        loop = np.repeat(np.arange(len(of)), n)
        row = np.arange(len(loop)) + np.repeat(first - (n.cumsum() - n), n)
        v = np.array(rows, "float64").reshape(-1, 7)[row]
        held = own.take(pa.array(loop))
        x0, y0 = (a[0][loop] - window + held[t].to_numpy() * tile for a, t in ((at_x, "_tx"), (at_y, "_ty")))
        for c, o, k in zip(names[:6], (x0, y0, x0, x0, y0, y0), range(6)):
            at = (o + v[:, k]) * resolution
            held = held.append_column(c, pa.array(at if k < 2 else at.astype("int64")))
        return held.append_column("n_pixels", pa.array(v[:, 6].astype("int64")))

    return windows.in_packed_tiles(loops, [(contacts, resolution)], window, kernel, _shape(dict(loops.dtypes), COORDS), tile * resolution)


# --- stripes
def stripe_pixels(pixels: DataFrame, resolution: int, near: int = 20_000, far: int = 8_000_000) -> DataFrame:
    """Pixels of a chromosome within the band that stand out; those of bins of low quality are left out before, by ``quality_mask`` with neighbours."""
    d = F.abs(F.col("bin_x") - F.col("bin_y"))
    return pixels.filter((F.col("chr1") == F.col("chr2")) & (F.col("counts") > 0) & (d > near // resolution) & (d < far // resolution) & ((F.col("oe") > 1.5) | (F.col("z") > 1)) & (F.col("oe") > 0))


def stripe_candidates(kept: DataFrame) -> DataFrame:
    """``orientation, chrom, bin``: rows and columns of ``stripe_pixels`` whose summed log enrichment is a five-point peak."""
    ends = F.array(F.struct(F.lit("horizontal").alias("orientation"), F.col("bin_x").alias("bin")), F.struct(F.lit("vertical").alias("orientation"), F.col("bin_y").alias("bin")))
    sums = kept.select(F.col("chr1").alias("chrom"), F.ln("oe").alias("l"), F.explode(ends).alias("e")).groupBy("e.orientation", "chrom", "e.bin").agg(F.sum("l").alias("value"))
    keys = ["orientation", "chrom"]
    wide = sums.select(*keys, F.explode(F.sequence(F.col("bin") - 2, F.col("bin") + 2)).alias("bin")).distinct()
    dense = wide.join(sums, [*keys, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return signals.five_point_peaks(dense, keys)


def stripe_runs(slices: np.ndarray, longer_than: int = 10) -> list[tuple[int, int]]:
    """Runs of columns where the smoothed middle row exceeds 1.25 times at least three of the four rows around it; single gaps filled."""
    k = np.array(signals.FIVE_TAPS)
    smooth = np.apply_along_axis(lambda r: np.concatenate([r[:2], np.convolve(r, k, "valid"), r[-2:]]) if len(r) > 4 else r, 1, slices)
    mark = (smooth[2] > 1.25 * smooth[[0, 1, 3, 4]]).sum(0) >= 3
    for i in range(1, len(mark) - 1):
        if not mark[i] and mark[i - 1] and mark[i + 1]:
            mark[i] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype("int8"), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a > longer_than]


def _geo(v: np.ndarray, above: float = 1.0) -> float:
    v = v[v > above]
    return float(np.exp(np.log(v).mean())) if len(v) else 0.0


def stripe_accepted(part: np.ndarray, strict: bool = False) -> bool:
    """Geometric mean of the middle row over 1.5 and over its neighbours, and greater than the flanks by a one-sided test, of all its values and of those over 1."""
    g, k = _geo(part[2]), 1.1 if strict else 1.0
    if not (g > 1.5 and g > k * _geo(part[1]) and g > k * _geo(part[3])):
        return False
    for above in (0.0, 1.0):
        middle = part[2][part[2] > above]
        for rows in ((0, 1, 3, 4), (0, 1), (3, 4)):
            other = part[list(rows)].ravel()
            other = other[other > above]
            if len(rows) == 2 and len(other) <= 5:
                continue
            p = two_sample_p(middle, other)
            if not (len(middle) > 5 and len(other) > 5 and p / 2 < 0.01 and middle.mean() > other.mean()):
                return False
    return True


def stripes(pixels: DataFrame, resolution: int, near: int = 20_000, far: int = 8_000_000, longer_than: int = 10, strict: bool = False) -> DataFrame:
    """Stripes as features: candidate rows and columns, five slices each, runs and their tests in one group per candidate, whose size is that of five slices.

    Slices hold the pixels that stand out, as the candidates do; a position is counted from the near end of a
    horizontal stripe, from the far end of a vertical one.
    """
    lo, hi = near // resolution, far // resolution
    kept = stripe_pixels(pixels, resolution, near, far)
    cand = stripe_candidates(kept).select("orientation", "chrom", F.col("bin").alias("peak"))
    ends = F.array(
        F.struct(F.lit("horizontal").alias("orientation"), F.col("bin_x").alias("row"), F.col("bin_y").alias("at")),
        F.struct(F.lit("vertical").alias("orientation"), F.col("bin_y").alias("row"), F.col("bin_x").alias("at")),
    )
    cells = kept.select(F.col("chr1").alias("chrom"), F.col("counts").cast("double").alias("v"), F.explode(ends).alias("e")).select("chrom", "v", "e.*")
    spread = cand.withColumn("row", F.explode(F.sequence(F.col("peak") - 2, F.col("peak") + 2)))
    joined = cells.join(spread, ["orientation", "chrom", "row"])
    shape = "orientation string, chrom string, peak bigint, first bigint, stop bigint"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = lo if key[0] == "horizontal" else -hi
        along = pdf["at"].to_numpy() - key[2] - start
        m = np.zeros((5, hi - lo))
        ok = (along >= 0) & (along < hi - lo)
        np.add.at(m, ((pdf["row"].to_numpy() - key[2] + 2)[ok], along[ok]), pdf["v"].to_numpy()[ok])
        rows = [(*key, start + a, start + b) for a, b in stripe_runs(m, longer_than) if stripe_accepted(m[:, a:b], strict)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    found = joined.groupBy("orientation", "chrom", "peak").applyInPandas(run, shape)
    horizontal = F.col("orientation") == "horizontal"
    near_end, far_end = F.col("peak") + F.col("first"), F.col("peak") + F.col("stop")
    own = (F.col("peak") * resolution, F.col("peak") * resolution + resolution)
    other = (near_end * resolution, far_end * resolution)
    pick = lambda a, b: F.when(horizontal, a).otherwise(b)
    return found.select(F.col("chrom").alias("chr1"), pick(own[0], other[0]).alias("start1"), pick(own[1], other[1]).alias("end1"), F.col("chrom").alias("chr2"), pick(other[0], own[0]).alias("start2"), pick(other[1], own[1]).alias("end2"), "orientation")


def localize(image: np.ndarray, compression: int) -> tuple[int, float] | None:
    """Best line of a stripe window (rows across, columns along): its index and p, None where it isn't interior or not significant."""
    m = image + image.mean()
    n = m.shape[1] // max(1, compression) * max(1, compression)
    if n == 0 or m.shape[0] < 3:
        return None
    short = m[:, :n].reshape(m.shape[0], -1, max(1, compression)).sum(2)
    norm = np.sqrt(short.sum(1)[:, None] * short.sum(0)[None, :])
    unit = np.divide(short, norm, out=np.zeros_like(short), where=norm > 0)
    rows = unit.sum(1)
    three = rows[:-2] + rows[1:-1] + rows[2:]
    best = int(three.argmax()) + 1
    others = np.delete(rows, [best - 1, best, best + 1])
    if best <= 1 or best >= len(rows) - 2 or len(others) < 2:
        return None
    p = one_sample_p(rows[best], others)
    return (best, p) if p < 0.01 else None


def localize_stripes(windows: DataFrame, identity: list[str], window: int, compression: int) -> DataFrame:
    """The best row of each window (``cells``, one row each) that stands out."""
    types = dict(windows.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in identity) + ", best int, p double"

    def run(batches):
        for pdf in batches:
            rows = [(*[r[k] for k in identity], *got) for r in pdf.to_dict("records") if (got := localize(_image(r["cells"], 2 * window + 1), compression))]
            yield pd.DataFrame(rows, columns=[*identity, "best", "p"])

    return windows.select(*identity, "cells").mapInPandas(run, shape)


def in_groups(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel of one's own per group of bounded size."""
    return df.groupBy(*keys).applyInPandas(kernel, schema)
