"""Sparse contact matrices: normalization, expectation, pile-ups and the statistics of windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS, div
from strandweave.operators import windows
from strandweave.operators.joins import near_pixels, window_pixels
from strandweave.session import materialize


# --- normalization and expectation
def normalized(contacts: DataFrame, norms: DataFrame, optional: bool = False) -> DataFrame:
    """``nx, ny, value`` with value = counts / (nx * ny); bins without a norm drop out unless ``optional``, then they count as 1."""
    n = norms.select("chrom", "resolution", "bin", "value")
    how = "left" if optional else "inner"
    d = contacts
    for s, b, a in ((1, "bin_x", "nx"), (2, "bin_y", "ny")):
        d = d.join(n.select(F.col("chrom").alias(f"chr{s}"), "resolution", F.col("bin").alias(b), F.col("value").alias(a)), [f"chr{s}", "resolution", b], how)
    if optional:
        d = d.fillna(1.0, ["nx", "ny"])
    return d.withColumn("value", F.col("counts") / (F.col("nx") * F.col("ny")))


def _log_z(d: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """``z`` of the logarithm of ``value`` within its keys: mean and deviation by an aggregate that combines early, then a join."""
    own = d.withColumn("_l", F.ln(value))
    stats = own.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg("_l").alias("_m"), F.stddev_samp("_l").alias("_s"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return own.join(stats, same).withColumn("z", (F.col("_l") - F.col("_m")) / F.col("_s")).drop("_l", "_m", "_s", *[f"_{k}" for k in keys])


def norm_z(norms: DataFrame) -> DataFrame:
    """``z`` of the logarithm of positive finite norms within chromosome and resolution."""
    return _log_z(norms.filter((F.col("value") >= 1e-20) & (F.col("value") < float("inf"))), "value", ["norm", "chrom", "resolution"])


def quality_mask(contacts: DataFrame, norms: DataFrame, least: float = -1.0, neighbours: bool = False) -> DataFrame:
    """Pixels both of whose bins have a norm ``z`` above ``least``; with ``neighbours`` those beside them must, too."""
    good = norm_z(norms).filter(F.col("z") > least).select("chrom", "resolution", "bin")
    out = contacts
    for s, b in ((1, "bin_x"), (2, "bin_y")):
        for o in (-1, 0, 1) if neighbours else (0,):
            out = out.join(good.select(F.col("chrom").alias(f"chr{s}"), "resolution", (F.col("bin") - o).alias(b)), [f"chr{s}", "resolution", b], "left_semi")
    return out


def in_band(pixels: DataFrame, resolution: int, near: int, far: int) -> DataFrame:
    """Pixels of a distance between ``near`` and ``far``, both exclusive."""
    d = F.abs(F.col("bin_x") - F.col("bin_y"))
    return pixels.filter((d > near // resolution) & (d < far // resolution))


def expected(contacts: DataFrame, chroms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, chrom, resolution, d, n, mean, mean_log, sd_log``: over all cells at a distance, absent ones counting 0."""
    d = contacts.filter("chr1 = chr2").groupBy(*keys, F.col("chr1").alias("chrom"), "resolution", F.abs(F.col("bin_x") - F.col("bin_y")).alias("d")).agg(
        F.sum("counts").alias("s"), F.sum(F.log1p("counts")).alias("sl"), F.sum(F.pow(F.log1p("counts"), 2)).alias("ql")
    )
    return _expectation(d, chroms, keys)


def _expectation(d: DataFrame, chroms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``expected`` of sums ``s, sl, ql`` by distance."""
    n = F.greatest(div(F.col("length") + F.col("resolution") - 1, F.col("resolution")) - F.col("d"), F.lit(1).cast("bigint"))
    d = d.join(F.broadcast(chroms.select("chrom", "length")), "chrom").withColumn("n", n)
    mean = F.col("sl") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("ql") - F.col("n") * mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    return d.select(*keys, "chrom", "resolution", "d", "n", (F.col("s") / F.col("n")).alias("mean"), mean.alias("mean_log"), sd.alias("sd_log"))


def share_of_cells(contacts: DataFrame, chroms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, chrom, resolution, d, n, share``: cells with contacts at each distance, and their share of all cells there."""
    d = contacts.filter("chr1 = chr2 AND counts > 0").groupBy(*keys, F.col("chr1").alias("chrom"), "resolution", F.abs(F.col("bin_x") - F.col("bin_y")).alias("d")).agg(F.count("*").alias("n"))
    bins = div(F.col("length") + F.col("resolution") - 1, F.col("resolution"))
    return d.join(F.broadcast(chroms.select("chrom", "length")), "chrom").select(*keys, "chrom", "resolution", "d", "n", (F.col("n") / (bins - F.col("d"))).alias("share"))


def against_expected(contacts: DataFrame, model: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``oe, z, percent`` of each pixel; percent is its share of the way from its distance's mean to that of the least distance with data, within [0, 1]."""
    near = model.groupBy(*keys, "chrom", "resolution").agg(F.min_by("mean", "d").alias("mean1"))
    m = model.select(*keys, F.col("chrom").alias("chr1"), "resolution", "d", "mean", "mean_log", "sd_log").join(near.withColumnRenamed("chrom", "chr1"), [*keys, "chr1", "resolution"], "left")
    d = contacts.filter("chr1 = chr2").withColumn("d", F.abs(F.col("bin_x") - F.col("bin_y"))).join(m, [*keys, "chr1", "resolution", "d"])
    return d.withColumns({
        "oe": x.pseudo_ratio(F.col("counts"), F.col("mean")),
        "z": F.when(F.col("sd_log") > 0, (F.log1p("counts") - F.col("mean_log")) / F.col("sd_log")),
        "percent": x.clamp(F.when(F.col("mean1") != F.col("mean"), (F.col("counts") - F.col("mean")) / (F.col("mean1") - F.col("mean")))),
    }).drop("mean", "mean_log", "sd_log", "mean1")


# --- pile-ups
def _grid(keys: DataFrame, window: int) -> DataFrame:
    span = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * window).cast("bigint"))
    return keys.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))


def pile_up(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, dx, dy, total``: contacts summed over the windows of all distinct loops of a key, every cell of the grid present."""
    once = loops.select(*keys, *COORDS).distinct()
    sums = window_pixels(once, contacts, resolution, window).groupBy(*keys, "dx", "dy").agg(F.sum("counts").alias("total"))
    lists = once.select(*keys).distinct() if keys else once.sparkSession.range(1).select()
    grid = _grid(lists, window)
    return grid.join(sums, [*keys, "dx", "dy"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def pile_up_normalized(loops: DataFrame, contacts: DataFrame, norms: DataFrame, resolution: int, window: int) -> DataFrame:
    """``value``: the pile-up over the product of its row's and column's summed norms, each relative to their mean."""
    once = loops.select(*COORDS).distinct()
    vector = norms.filter(F.col("resolution") == resolution).select("chrom", "bin", "value")

    def factor(s: int, name: str) -> DataFrame:
        offs = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * window).cast("bigint"))
        bins = once.select(F.col(f"chr{s}").alias("chrom"), (div(x.mid(f"start{s}", f"end{s}"), resolution) - window).alias("first")).withColumn(name, F.explode(offs)).withColumn("bin", F.col("first") + F.col(name))
        sums = bins.join(vector, ["chrom", "bin"]).groupBy(name).agg(F.sum("value").alias("s"))
        return sums.select(name, (F.col("s") / F.avg("s").over(Window.partitionBy())).alias(f"f_{name}"))

    d = pile_up(loops, contacts, resolution, window).join(factor(1, "dx"), "dx", "left").join(factor(2, "dy"), "dy", "left")
    f = F.col("f_dx") * F.col("f_dy")
    return d.select("dx", "dy", "total", F.when(f > 0, F.col("total") / f).otherwise(0.0).alias("value"))


def local_vc(contacts: DataFrame, resolution: int) -> DataFrame:
    """Coverage vector from all positive pixels: both bins are credited, the diagonal once."""
    d = contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0))
    ends = F.array_distinct(F.array(F.struct(F.col("chr1").alias("chrom"), F.col("bin_x").alias("bin")), F.struct(F.col("chr2").alias("chrom"), F.col("bin_y").alias("bin"))))
    return d.select("counts", F.explode(ends).alias("e")).groupBy("e.chrom", "e.bin").agg(F.sum("counts").alias("value"))


def distance_strata(pairs: DataFrame, strata: int) -> DataFrame:
    """``stratum`` k for midpoint distances in (2^(k-1), 2^k] Mb, up to ``strata`` - 1."""
    d = F.abs(x.mid2() - x.mid1())
    k = F.ceil(F.log2(d / 1e6)).cast("int")
    return pairs.withColumn("stratum", F.greatest(k, F.lit(0))).filter((d > 500_000) & (F.col("stratum") < strata))


def size_classes(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """Copies of each row for the stacks it counts in: all, and big or small by the chromosomes' indices."""
    idx = chroms.select("chrom", "chr_index")
    d = df.join(F.broadcast(idx.withColumnsRenamed({"chrom": "chr1", "chr_index": "i1"})), "chr1").join(F.broadcast(idx.withColumnsRenamed({"chrom": "chr2", "chr_index": "i2"})), "chr2")
    own = F.when((F.col("i1") < 9) & (F.col("i2") < 9), "big").when((F.col("i1") > 9) & (F.col("i2") > 9), "small")
    return d.withColumn("size_class", F.explode(F.array_compact(F.array(F.lit("all"), own)))).drop("i1", "i2")


def _stacks_in_tiles(points: DataFrame, near: DataFrame, resolution: int, window: int, least: int, tile: int) -> DataFrame:
    """``chr1, stratum, dx, dy, total`` of the pairs of ``flags_pile_up`` within chromosomes, in tiles of ``tile`` bins.

    A pixel has one tile, whose anchors are those whose windows reach it on either axis. Pairs are counted there by bins and stratum,
    and each pixel adds what it has times the numbers of pairs around it. Bounds of strata are compared as integers.
    """
    span, side = 2 * window + 1, tile + 2 * window
    key = ["_tx", "_ty", "chr1"]
    bounds = 1_000_000 * 2 ** np.arange(43, dtype="int64")
    at = {a: F.floor(F.col(b) / tile) for a, b in (("_tx", "bin_x"), ("_ty", "bin_y"))}
    pixels = near.withColumns(at).select(*key, ((F.col("bin_x") - F.col("_tx") * tile) * tile + F.col("bin_y") - F.col("_ty") * tile).cast("int").alias("_cell"), "counts")
    tiles, ends = near.select(*[v.alias(a) for a, v in at.items()], "chr1").distinct(), None
    for s, (t, edge) in enumerate((("_tx", "end"), ("_ty", "start"))):
        b = div("m", resolution)
        own = points.select(F.col("chrom").alias("chr1"), "m", F.col(edge).alias("_edge"), b.alias("_b"), F.explode(F.sequence(F.floor((b - window) / tile), F.floor((b + window) / tile))).alias(t))
        # sizes say little of lists this narrow, so neither side is broadcast
        one = own.join(tiles.hint("merge"), ["chr1", t]).select(*key, F.lit(s).alias("_side"), (F.col("_b") - F.col(t) * tile + window).cast("int").alias("_at"), "m", "_edge")
        ends = one if ends is None else ends.unionByName(one)

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        which, bins, m, edge = (own[c].to_numpy() for c in ("_side", "_at", "m", "_edge"))
        (ax, am, ae), (bx, bm, bs) = ((bins[which == s], m[which == s], edge[which == s]) for s in (0, 1))
        if not (len(ax) and len(bx) and held.num_rows):
            return empty
        pairs: dict[int, np.ndarray] = {}
        rows = max(1, 1_000_000 // len(bx))
        for i in range(0, len(ax), rows):
            d = bm - am[i : i + rows, None]
            ok = (ae[i : i + rows, None] < bs) & (d > least)
            stratum, cell = np.searchsorted(bounds, d[ok]), (ax[i : i + rows, None].astype("int64") * side + bx)[ok]
            for k in np.unique(stratum):
                n = np.bincount(cell[stratum == k], minlength=side * side).astype("float64").reshape(side, side)
                pairs[k] = pairs[k] + n if k in pairs else n
        image = np.bincount(held["_cell"].to_numpy(), held["counts"].to_numpy(), tile * tile)
        cells = np.flatnonzero(image)
        px, py, v = cells // tile, cells % tile, image[cells]
        # two anchors of bins that a pixel's window holds are this near and this far
        apart = (own["_ty"][0].as_py() - own["_tx"][0].as_py()) * tile + py - px
        low, high = (apart - span) * resolution, (apart + span) * resolution
        out = {}
        for k, n in pairs.items():
            mine = (low < bounds[k]) & (high > (bounds[k - 1] if k else least))
            x_, y_, c, total = px[mine], py[mine], v[mine], np.zeros(span * span)
            for part, w in windows.stacks(n, x_, y_, window):
                total += c[part] @ w.reshape(len(w), -1)
            out[k] = total[::-1].astype("int64")  # the last row of a pixel's window is that of the first anchors
        n = len(out)
        lists = pa.ListArray.from_arrays(np.arange(0, n * span * span + 1, span * span, dtype="int32"), np.concatenate([np.empty(0, "int64"), *out.values()]))
        return pa.table({"chr1": pa.array([own["chr1"][0].as_py()] * n, pa.string()), "stratum": pa.array(list(out), pa.int32()), "totals": lists}).cast(arrow)

    schema = "chr1 string, stratum int, totals array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    empty = arrow.empty_table()
    parts = ends.repartition(*key).groupBy(*key).cogroup(pixels.repartition(*key).groupBy(*key)).applyInArrow(run, schema)
    sums = parts.select("chr1", "stratum", F.posexplode("totals").alias("_at", "total")).filter("total > 0").groupBy("chr1", "stratum", "_at").agg(F.sum("total").alias("total"))
    return sums.select("chr1", "stratum", div("_at", span).alias("dx"), (F.col("_at") % span).cast("bigint").alias("dy"), "total")


def flags_pile_up(anchors: DataFrame, intra: DataFrame, inter: DataFrame, chroms: DataFrame, resolution: int, inter_resolution: int, window: int, least: int = 500_000, tile: int = 512) -> DataFrame:
    """``kind, stratum, size_class, dx, dy, total``: pile-ups of all pairs of distinct anchors, by distance and once between chromosomes.

    Intra pairs are those of ``pair_anchors(anchors, anchors, least, any)``, in the strata of ``distance_strata``; there are as many
    strata as the longest distance needs, and every stack is whole. Pairs are never listed: they are counted by bins in tiles, beside
    the pixels. Inter pairs have no bounds, so numbers of anchors per bin are enough and the axes are summed in turn. Rows of one pixel
    count together.
    """
    p = anchors.select("chrom", "start", "end", x.mid("start", "end").alias("m")).distinct()
    span = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * window).cast("bigint"))
    stratum = lambda v: F.greatest(F.ceil(F.log2(v / 1e6)).cast("int"), F.lit(0))

    near = intra.filter((F.col("chr1") == F.col("chr2")) & (F.col("resolution") == resolution) & (F.col("counts") > 0) & (F.col("bin_y") - F.col("bin_x") + 2 * window + 1 > least // resolution)).select("chr1", "bin_x", "bin_y", "counts")
    within = _stacks_in_tiles(p, near, resolution, window, least, tile).withColumns({"kind": F.lit("intra"), "chr2": F.col("chr1")})

    def times(pixels: DataFrame, s: int, value: str) -> DataFrame:
        """``value`` of pixels times the anchors at each bin whose window holds them, ``o`` bins from its first; bins of anchors aren't spread, nor sent to the driver."""
        b, o = (("bin_x", "dx"), ("bin_y", "dy"))[s - 1]
        own = n.select(F.col("chrom").alias(f"chr{s}"), F.col("b").alias("_b"), "n").hint("merge")
        return pixels.withColumn(o, F.explode(span)).withColumn("_b", F.col(b) + window - F.col(o)).join(own, [f"chr{s}", "_b"]).withColumn("v", F.col(value) * F.col("n"))

    n = p.groupBy("chrom", div("m", inter_resolution).alias("b")).agg(F.count("*").alias("n"))
    far = inter.filter((F.col("chr1") != F.col("chr2")) & (F.col("resolution") == inter_resolution) & (F.col("counts") > 0))
    one = times(far, 1, "counts").groupBy("chr1", "chr2", "dx", "bin_y").agg(F.sum("v").alias("one"))
    both = times(one, 2, "one").groupBy("chr1", "chr2", "dx", "dy").agg(F.sum("v").alias("total"))
    between = both.withColumns({"kind": F.lit("inter"), "stratum": F.lit(None).cast("int")})

    sums = size_classes(within.unionByName(between), chroms).groupBy("kind", "stratum", "size_class", "dx", "dy").agg(F.sum("total").alias("total"))
    longest = p.groupBy("chrom").agg((F.max("m") - F.min("m")).alias("d")).agg(F.max("d").alias("d"))
    strata = longest.filter(F.col("d") > least).select(F.lit("intra").alias("kind"), F.explode(F.sequence(F.lit(0), stratum(F.col("d")))).alias("stratum"))
    stacks = strata.unionByName(anchors.sparkSession.range(1).select(F.lit("inter").alias("kind"), F.lit(None).cast("int").alias("stratum")))
    grid = _grid(stacks.withColumn("size_class", F.explode(F.array(F.lit("all"), F.lit("big"), F.lit("small")))), window)
    same = lambda c: F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}"))
    on = same("kind") & same("stratum") & same("size_class") & same("dx") & same("dy")
    return grid.alias("g").join(sums.alias("s"), on, "left").select("g.kind", "g.stratum", "g.size_class", "g.dx", "g.dy", F.coalesce("s.total", F.lit(0)).cast("bigint").alias("total"))


def pile_up_1d(loops: DataFrame, contacts: DataFrame, resolution: int, window: int) -> DataFrame:
    """``chrom, bin, total``: pixels near loops credited to both bins, the diagonal once."""
    near = near_pixels(loops, contacts, resolution, window)
    ends = F.array_distinct(F.array(F.struct(F.col("chr1").alias("chrom"), F.col("bin_x").alias("bin")), F.struct(F.col("chr2").alias("chrom"), F.col("bin_y").alias("bin"))))
    return near.select("counts", F.explode(ends).alias("e")).groupBy("e.chrom", "e.bin").agg(F.sum("counts").alias("total"))


def window_dump(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, identity: Sequence[str], tile: int = 128) -> DataFrame:
    """One dense row-major window a distinct loop that has contacts there, as ``array<array<double>>``."""
    span = 2 * window + 1
    types = dict(loops.dtypes)

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        hit = windows.box_sums(images[0], span)[at_x[0], at_y[0]] > 0
        parts = [v.reshape(-1) for _, v in windows.stacks(images[0], at_x[0][hit], at_y[0][hit], window)]
        n, values = int(hit.sum()), np.concatenate([np.empty(0), *parts])
        rows = pa.ListArray.from_arrays(np.arange(0, n * span * span + 1, span, dtype="int32"), values)
        return own.select(identity).filter(pa.array(hit)).append_column("matrix", pa.ListArray.from_arrays(np.arange(0, n * span + 1, span, dtype="int32"), rows))

    schema = ", ".join(f"{c} {types[c]}" for c in identity) + ", matrix array<array<double>>"
    return windows.in_tiles(loops, [(contacts, resolution)], window, identity, kernel, schema, tile * resolution)


def window_sums(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, identity: Sequence[str], tile: int = 128) -> DataFrame:
    """``*identity, dx, dy, counts`` of the positive cells in the window of each distinct loop, a row a cell."""
    span = 2 * window + 1
    held = window_dump(loops, contacts, resolution, window, identity, tile)
    cells = held.select(*identity, F.posexplode(F.flatten("matrix")).alias("_at", "counts")).filter("counts > 0")
    return cells.select(*identity, div("_at", span).alias("dx"), (F.col("_at") % span).cast("bigint").alias("dy"), F.col("counts").cast("bigint").alias("counts"))


def window_cells(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, identity: Sequence[str], tile: int = 512) -> DataFrame:
    """``cells, x0, y0``: each distinct loop's window as its positive cells ``(dx, dy, v)``, for kernels; no more than the window holds. They are made in the tiles of ``windows``."""
    types, span = dict(loops.dtypes), 2 * window + 1

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        hit = windows.box_sums(images[0], span)[at_x[0], at_y[0]] > 0
        lists = []
        for _, v in windows.stacks(images[0], at_x[0][hit], at_y[0][hit], window):
            k, i, j = np.nonzero(v)
            ends = np.concatenate([[0], np.bincount(k, minlength=len(v)).cumsum()]).astype("int32")
            fields = [pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(v[k, i, j])]
            lists.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["dx", "dy", "v"])))
        kind = pa.list_(pa.struct([("dx", pa.int32()), ("dy", pa.int32()), ("v", pa.float64())]))
        return own.select(identity).filter(pa.array(hit)).append_column("cells", pa.chunked_array([c.cast(kind) for c in lists], kind))

    schema = ", ".join(f"{c} {types[c]}" for c in identity) + ", cells array<struct<dx: int,dy: int,v: double>>"
    held = windows.in_tiles(loops, [(contacts, resolution)], window, identity, kernel, schema, tile * resolution)
    return held.withColumns({"x0": div(x.mid1(), resolution) - window, "y0": div(x.mid2(), resolution) - window})


def anchor_pile_up(loops: DataFrame, contacts: DataFrame, resolution: int, window: int) -> DataFrame:
    """``side, chrom, bin, dx, dy, total``: a pile-up around every upstream and every downstream bin."""
    hits = window_pixels(loops.select(*COORDS).distinct(), contacts, resolution, window)
    side = lambda s: F.struct(F.lit(("upstream", "downstream")[s - 1]).alias("side"), F.col(f"chr{s}").alias("chrom"), div(x.mid(f"start{s}", f"end{s}"), resolution).alias("bin"))
    return hits.select("dx", "dy", "counts", F.explode(F.array(side(1), side(2))).alias("a")).groupBy("a.side", "a.chrom", "a.bin", "dx", "dy").agg(F.sum("counts").alias("total"))


def anchor_scores(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, tile: int = 512) -> DataFrame:
    """``side, chrom, bin, score``: ``apa_scores`` of ``anchor_pile_up``. Of a pile-up only the cells that its score reads are summed, in the tiles of ``windows``."""
    reach, span = 50 // resolution, 2 * window + 1
    near = [(i, j) for i in range(span) for j in range(span) if abs(i - window) <= reach and abs(j - window) <= reach]
    far = [(i, j) for i in range(span) for j in range(span) if i > window + window // 2 and j < window - window // 2]
    # one cell can't be both, as the quarter is away from the centre by more than a fifth of the window
    cells, size = near + far, tile
    names = [f"v{k}" for k in range(len(cells))]

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        px, py, image = at_x[0], at_y[0], images[0]
        hit = windows.box_sums((image > 0).astype("float64"), span)[px, py] > 0
        px, py = px[hit], py[hit]
        values = [image[px + i, py + j] for i, j in cells]
        out = {c: [] for c in ("side", "chrom", "bin", *names)}
        for side, c, t, at in (("upstream", "chr1", "_tx", px), ("downstream", "chr2", "_ty", py)):
            bins = np.unique(at)
            out["side"].append(pa.array([side] * len(bins), pa.string()))
            out["chrom"].append(pa.array([own[c][0].as_py()] * len(bins), pa.string()))
            out["bin"].append(pa.array(bins.astype("int64") + own[t][0].as_py() * size))
            for name, v in zip(names, values):
                out[name].append(pa.array(np.bincount(at, v, size)[bins].astype("int64")))
        return pa.table({c: pa.chunked_array(v) for c, v in out.items()})

    schema = "side string, chrom string, bin bigint, " + ", ".join(f"{v} bigint" for v in names)
    parts = windows.in_tiles(loops, [(contacts, resolution)], window, COORDS, kernel, schema, tile * resolution)
    sums = parts.groupBy("side", "chrom", "bin").agg(*[F.sum(v).alias(v) for v in names])

    def mean(some: list[str]) -> Column:
        n = sum((F.when(F.col(v) > 0, 1).otherwise(0) for v in some), F.lit(0))
        return F.when(n > 0, sum((F.col(v) for v in some), F.lit(0)) / n).otherwise(0.0)

    return sums.select("side", "chrom", "bin", ((mean(names[: len(near)]) + 1) / (mean(names[len(near) :]) + 1)).alias("score"))


# --- statistics of windows (long grids with columns dx, dy, value)
def _corner(w: int, size: int, low_x: bool, low_y: bool) -> Column:
    a = F.col("dx") < size if low_x else F.col("dx") > 2 * w - size
    b = F.col("dy") < size if low_y else F.col("dy") > 2 * w - size
    return a & b


def apa_scores(grid: DataFrame, window: int, resolution: int, keys: Sequence[str], value: str = "total") -> DataFrame:
    """``score`` = (num + 1) / (den + 1): centre against the positive cells of the lower-left quarter."""
    v, reach = F.col(value), 50 // resolution
    centre = (F.abs(F.col("dx") - window) <= reach) & (F.abs(F.col("dy") - window) <= reach)
    quarter = (F.col("dx") > window + window // 2) & (F.col("dy") < window - window // 2)
    num = F.coalesce(F.avg(F.when(centre & (v > 0), v)), F.lit(0.0))
    den = F.coalesce(F.avg(F.when(quarter & (v > 0), v)), F.lit(0.0))
    return grid.groupBy(*keys).agg(((num + 1) / (den + 1)).alias("score"))


def pile_up_statistics(grid: DataFrame, window: int, corner: int, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """Seven values of a full grid: centre over the rest, the upper-right mean, centre over each corner's mean, z against the lower left."""
    v = F.col(value)
    at_centre = (F.col("dx") == window) & (F.col("dy") == window)
    centre = F.max(F.when(at_centre, v))
    mean = lambda lx, ly: F.avg(F.when(_corner(window, corner, lx, ly), v))
    ll = _corner(window, corner, False, True)
    return grid.groupBy(*keys).agg(
        (centre / F.avg(F.when(~at_centre, v))).alias("peak_to_mean"), mean(True, False).alias("ur_mean"), (centre / mean(True, True)).alias("peak_to_ul"), (centre / mean(True, False)).alias("peak_to_ur"),
        (centre / mean(False, True)).alias("peak_to_ll"), (centre / mean(False, False)).alias("peak_to_lr"), ((centre - F.avg(F.when(ll, v))) / F.stddev_samp(F.when(ll, v))).alias("z_ll"),
    )


def manhattan_decay(grid: DataFrame, window: int, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """``d, mean``: mean over the cells of a full grid at each distance by rows and columns below ``window``."""
    d = (F.abs(F.col("dx") - window) + F.abs(F.col("dy") - window)).alias("d")
    return grid.select(*keys, d, F.col(value).alias("v")).filter(F.col("d") < window).groupBy(*keys, "d").agg(F.avg("v").alias("mean"))


def decay_fit(decay: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``amplitude, slope`` of an exponential through the positive means."""
    p = decay.filter("mean > 0")
    return p.groupBy(*keys).agg(F.exp(F.regr_intercept(F.ln("mean"), F.col("d"))).alias("amplitude"), F.regr_slope(F.ln("mean"), F.col("d")).alias("slope"))


def row_profile(grid: DataFrame, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """``dx, row_sum, row_pdf, row_relative``: sums of rows, over their total and over their maximum."""
    rows = grid.groupBy(*keys, "dx").agg(F.sum(value).alias("row_sum"))
    w = Window.partitionBy(*keys)
    return rows.withColumns({"row_pdf": F.col("row_sum") / F.sum("row_sum").over(w), "row_relative": F.col("row_sum") / F.max("row_sum").over(w)})


def amplitude_and_spread(rows: DataFrame, window: int, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.stddev_samp("row_pdf").alias("amplitude"), F.sqrt(F.sum(F.pow(F.col("dx") - window, 2) * F.col("row_pdf"))).alias("spread"))


def sieve_scores(loops: DataFrame, contacts: DataFrame, resolution: int, window: int, identity: Sequence[str]) -> DataFrame:
    """``observed, local_z, local_oe`` of each loop's centre against its window without the centre's row and column; absent cells are 0."""
    hits = window_pixels(loops, contacts, resolution, window)
    away = (F.col("dx") != window) & (F.col("dy") != window)
    c = F.col("counts").cast("double")
    sums = hits.groupBy(*identity).agg(
        F.sum(F.when((F.col("dx") == window) & (F.col("dy") == window), c)).alias("o"), F.sum(F.when(away, c)).alias("s"), F.sum(F.when(away, c * c)).alias("q"))
    # rows and columns below 0 don't exist
    rows = lambda s: F.lit(window) + F.least(div(x.mid(f"start{s}", f"end{s}"), resolution), F.lit(window).cast("bigint"))
    d = loops.withColumn("n", rows(1) * rows(2)).join(sums, list(identity), "left").fillna(0.0, ["o", "s", "q"])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))
    return d.select(*identity, F.col("o").alias("observed"), F.when(sd > 0, (F.col("o") - mean) / sd).alias("local_z"), F.when(mean > 0, F.col("o") / mean).alias("local_oe"))


#: Distances of a model that are broadcast; more are joined by a shuffle.
FEW = 100_000


def _with_model(loops: DataFrame, model: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Loops, which have a ``resolution``, with the model of their distance and its ``mean1``; null between chromosomes and where it has no contacts.

    The model is written, as it is counted and read; it has a row a distance at most.
    """
    model = materialize(model, "model")
    near = model.groupBy(*keys, "chrom", "resolution").agg(F.min_by("mean", "d").alias("mean1"))
    of = [c for c in model.columns if c in ("mean", "mean_log", "sd_log")]
    m = model.join(near, [*keys, "chrom", "resolution"]).select(*keys, F.col("chrom").alias("chr1"), F.col("chrom").alias("chr2"), "resolution", "d", *of, "mean1")
    m = F.broadcast(m) if model.count() <= FEW else m
    d = F.abs(div(x.mid1(), F.col("resolution")) - div(x.mid2(), F.col("resolution")))
    return loops.withColumn("d", d).join(m, [*keys, "chr1", "chr2", "resolution", "d"], "left")


def _expected_means(contacts: DataFrame, chroms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``mean`` of ``expected``, for which rows of one pixel needn't be summed before."""
    return expected(contacts, chroms, keys).select(*keys, "chrom", "resolution", "d", "mean")


def _percent(observed: Column) -> Column:
    return F.when(F.col("mean").isNotNull(), x.clamp(F.when(F.col("mean1") != F.col("mean"), (observed - F.col("mean")) / (F.col("mean1") - F.col("mean")))))


def _expected_in_tiles(layers: Sequence[tuple[DataFrame, int]], chroms: DataFrame, tile: int) -> DataFrame:
    """``expected`` of contacts at several resolutions, rows of one pixel being summed in its tile."""

    def kernel(chr1: str, chr2: str, i: int, bx: np.ndarray, by: np.ndarray, v: np.ndarray) -> pa.Table:
        far, at = np.unique(np.abs(bx - by), return_inverse=True)
        log = np.log1p(v)
        sums = {name: np.bincount(at, w, len(far)) for name, w in (("s", v), ("sl", log), ("ql", log * log))}
        return pa.table({"chrom": pa.array([chr1] * len(far), pa.string()), "resolution": pa.array([layers_at[i]] * len(far), pa.int64()), "d": far.astype("int64"), **sums})

    layers_at = [r for _, r in layers]
    parts = windows.over_pixels([(c.filter("chr1 = chr2"), r) for c, r in layers], kernel, "chrom string, resolution bigint, d bigint, s double, sl double, ql double", tile)
    return _expectation(parts.groupBy("chrom", "resolution", "d").agg(*[F.sum(c).alias(c) for c in ("s", "sl", "ql")]), chroms)


def sieve(loops: DataFrame, contacts: DataFrame | dict[int, DataFrame], chroms: DataFrame, resolutions: Sequence[int], window: int = 10, skip_global: bool = False, bins: int = 1000) -> DataFrame:
    """Per distinct loop and resolution ``observed, local_z, local_oe`` as ``sieve_scores`` has them and, unless skipped, ``global_z, global_oe, percent``; null where there is no expectation.

    Windows of all resolutions are read in the tiles of ``windows``, of ``bins`` of the finest; rows of one pixel count together. ``contacts`` may be given by resolution.
    """
    if window < 5:
        raise ValueError("local statistics need a window of 5 bins")
    layers = [(contacts[r] if isinstance(contacts, dict) else contacts, r) for r in resolutions]
    least, span = math.lcm(*resolutions), 2 * window + 1
    tile = least * max(1, bins * min(resolutions) // least)
    kind = "int64" if all(dict(c.dtypes)["counts"] in ("bigint", "int", "smallint", "tinyint") for c, _ in layers) else "float64"

    def away(image: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Sums of windows without the row and the column of the centre."""
        s = np.zeros((image.shape[0] + 1, image.shape[1] + 1), image.dtype)
        np.cumsum(image, 0, out=s[1:, 1:])
        np.cumsum(s[1:, 1:], 1, out=s[1:, 1:])
        box = lambda a, b, c, e: s[b, e] - s[a, e] - s[b, c] + s[a, c]
        x1, x2, y1, y2 = px + window, px + span, py + window, py + span
        return box(px, x2, py, y2) - box(x1, x1 + 1, py, y2) - box(px, x2, y1, y1 + 1) + image[x1, y1]

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        out = []
        for i, r in enumerate(resolutions):
            px, py, image = at_x[i], at_y[i], images[i].astype(kind)
            o, s, q = (v.astype("float64") for v in (image[px + window, py + window], away(image, px, py), away(image * image, px, py)))
            # rows and columns below 0 don't exist
            rows = [window + np.minimum(at + own[t][0].as_py() * (tile // r), window) for at, t in ((px, "_tx"), (py, "_ty"))]
            n = (rows[0] * rows[1]).astype("float64")
            with np.errstate(all="ignore"):
                mean = s / n
                sd = np.sqrt(np.maximum(q - n * mean * mean, 0) / (n - 1))
                z, oe = (o - mean) / sd, o / mean
            t = own.select(COORDS).append_column("resolution", pa.array(np.full(len(o), r, "int64"))).append_column("observed", pa.array(o))
            out.append(t.append_column("local_z", pa.array(z, mask=~(sd > 0))).append_column("local_oe", pa.array(oe, mask=~(mean > 0))))
        return pa.concat_tables(out)

    types = dict(loops.dtypes)
    d = windows.in_packed_tiles(loops, layers, window, kernel, ", ".join(f"{c} {types[c]}" for c in COORDS) + ", resolution bigint, observed double, local_z double, local_oe double", tile)
    # loops without a place have no window
    lost = loops.select(*COORDS).filter(reduce(Column.__or__, [F.col(c).isNull() for c in COORDS])).distinct()
    none = F.lit(None).cast("double")
    d = d.unionByName(lost.select(*COORDS, F.explode(F.array(*[F.lit(r).cast("bigint") for r in resolutions])).alias("resolution"), F.lit(0.0).alias("observed"), none.alias("local_z"), none.alias("local_oe")))
    if skip_global:
        return d
    o = F.col("observed")
    z = F.when(F.col("sd_log") > 0, (F.log1p(o) - F.col("mean_log")) / F.col("sd_log"))
    d = _with_model(d, _expected_in_tiles(layers, chroms, tile))
    return d.select(*COORDS, "resolution", "observed", "local_z", "local_oe", z.alias("global_z"), F.when(F.col("mean") > 0, o / F.col("mean")).alias("global_oe"), _percent(o).alias("percent"))


def _decay(means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``decay_fit`` of rows of means by distance; NaN where fewer than two are positive."""
    ok = means > 0
    n, d = ok.sum(1), np.arange(means.shape[1])
    y = np.log(means, out=np.zeros_like(means), where=ok)
    with np.errstate(all="ignore"):
        md, my = (ok * d).sum(1) / n, y.sum(1) / n
        away = np.where(ok, d - md[:, None], 0.0)
        slope = np.where(n > 1, (away * np.where(ok, y - my[:, None], 0.0)).sum(1) / (away * away).sum(1), np.nan)
        return np.exp(my - slope * md), slope


def recap(loops: DataFrame, contacts: DataFrame, chroms: DataFrame, resolution: int, window: int, keys: Sequence[str] = (), tile: int = 512) -> DataFrame:
    """Per distinct loop of a key and ``experiment``: ``presence`` against the experiment's expectation, ``total``, the decay's ``amplitude, slope``
    and the rows' ``row_amplitude, row_spread`` over its observed window; a loop without contacts there has a total of 0 and nulls.

    Windows are read in the tiles of ``windows``, a layer an experiment; rows of one pixel count together."""
    each, types, size = [*keys, "experiment", *COORDS], dict(loops.dtypes), 2 * window + 1
    experiments = sorted(r[0] for r in contacts.select("experiment").distinct().collect())
    layers = [(contacts.filter(F.col("experiment") == e), resolution) for e in experiments]
    i, j = np.indices((size, size))
    away = (np.abs(i - window) + np.abs(j - window)).reshape(-1)
    # a distance k has 4k cells, all within the window
    weights = np.stack([(away == k) / max(1, 4 * k) for k in range(window)], 1)
    values = ["observed", "total", "amplitude", "slope", "row_amplitude", "row_spread"]

    def kernel(own: pa.Table, at_x: dict, at_y: dict, images: dict) -> pa.Table:
        held, out = own.select([*keys, *COORDS]), []
        for k, e in enumerate(experiments):
            for part, v in windows.stacks(images[k], at_x[k], at_y[k], window):
                means, rows, total = v.reshape(len(v), -1) @ weights, v.sum(2), v.sum((1, 2))
                amplitude, slope = _decay(means)
                with np.errstate(all="ignore"):
                    pdf = rows / total[:, None]
                    shape = pdf.std(1, ddof=1), np.sqrt(((np.arange(size) - window) ** 2 * pdf).sum(1))
                t = held.slice(part.start, len(v)).append_column("experiment", pa.array([e] * len(v), pa.string()))
                t = t.append_column("observed", pa.array(v[:, window, window])).append_column("total", pa.array(total.astype("int64")))
                for name, a in zip(values[2:], (amplitude, slope, *shape)):
                    t = t.append_column(name, pa.array(a, mask=~np.isfinite(a)))
                out.append(t)
        return pa.concat_tables(out)

    shape = ", ".join(f"{c} {'string' if c == 'experiment' else types[c]}" for c in each) + ", observed double, total bigint, " + ", ".join(f"{v} double" for v in values[2:])
    if not layers:
        layers = [(contacts, resolution)]
    d = windows.in_tiles(loops, layers, window, [*keys, *COORDS], kernel if experiments else lambda own, *_: pa.table({c: pa.array([], pa.null()) for c in [*each, *values]}), shape, tile * resolution)
    model = _expected_means(contacts.filter(F.col("resolution") == resolution), chroms, ["experiment"])
    d = _with_model(d.withColumn("resolution", F.lit(resolution).cast("bigint")), model, ["experiment"])
    return d.select(*each, _percent(F.col("observed")).alias("presence"), *values[1:])


def log_z(contacts: DataFrame, above: float | None = None) -> DataFrame:
    """``z`` of the logarithm of positive counts within a pair of chromosomes."""
    d = _log_z(contacts.filter("counts > 0"), "counts", ["chr1", "chr2", "resolution"])
    return d if above is None else d.filter(F.col("z") > above)


def translocations(contacts: DataFrame, chroms: DataFrame, z: float = 5.0, top: int = 10) -> DataFrame:
    """``chr1, chr2, tenth, flagged``: pairs of autosomes whose tenth largest pixel stands out; pairs without data are flagged too."""
    auto = chroms.filter("is_autosome").select("chrom", "chr_index")
    pairs = auto.select(F.col("chrom").alias("chr1"), F.col("chr_index").alias("i")).join(auto.select(F.col("chrom").alias("chr2"), F.col("chr_index").alias("j")), F.col("i") < F.col("j")).select("chr1", "chr2")
    d = contacts.filter("counts > 0").join(F.broadcast(pairs), ["chr1", "chr2"], "left_semi")
    w = Window.partitionBy("chr1", "chr2").orderBy(F.desc("counts"), "bin_x", "bin_y")
    tenth = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).groupBy("chr1", "chr2").agg(F.min("counts").alias("tenth"))
    all_ = d.agg(F.avg("counts").alias("m"), F.stddev_samp("counts").alias("s"))
    flagged = F.coalesce((F.col("tenth") - F.col("m")) / F.col("s") > z, F.lit(True))
    return pairs.join(tenth, ["chr1", "chr2"], "left").join(F.broadcast(all_), F.lit(True)).select("chr1", "chr2", "tenth", flagged.alias("flagged"))


def max_pixel(loops: DataFrame, contacts: DataFrame, resolution: int, norms: DataFrame | None = None, border: int = 2, tile: int = 16) -> DataFrame:
    """Each loop's strongest pixel within its bounds and ``border`` bins, as a feature of one bin; first in row order among equals.

    With norms a value counts only where nx * ny > .5; a value must be over 1.
    """
    rest = [c for c in loops.columns if c not in COORDS]
    own = loops.withColumns({f"{p}{s}": (div(f"start{s}", resolution) - border) if p == "a" else (div(f"end{s}", resolution) + border + 1) for s in (1, 2) for p in ("a", "b")})
    grid = lambda s: F.sequence(F.floor(F.col(f"a{s}") / tile), F.floor((F.col(f"b{s}") - 1) / tile))
    spread = own.withColumn("tx", F.explode(grid(1))).withColumn("ty", F.explode(grid(2)))
    pixels = contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0))
    pixels = normalized(pixels, norms).filter(F.col("nx") * F.col("ny") > 0.5) if norms is not None else pixels.withColumn("value", F.col("counts").cast("double"))
    pixels = pixels.filter("value > 1").select("chr1", "chr2", "bin_x", "bin_y", "value").withColumns({"tx": div("bin_x", tile), "ty": div("bin_y", tile)})
    hits = spread.join(pixels, ["chr1", "chr2", "tx", "ty"]).filter("bin_x >= a1 AND bin_x < b1 AND bin_y >= a2 AND bin_y < b2")
    best = hits.groupBy(*COORDS, *rest).agg(F.max_by(F.struct("bin_x", "bin_y"), F.struct("value", -F.col("bin_x"), -F.col("bin_y"))).alias("p"))
    px, py = F.col("p.bin_x") * resolution, F.col("p.bin_y") * resolution
    return best.select("chr1", px.alias("start1"), (px + resolution).alias("end1"), "chr2", py.alias("start2"), (py + resolution).alias("end2"), *rest).distinct()


def coarse_to_fine(loops: DataFrame, contacts: DataFrame, resolutions: Sequence[int], norms: DataFrame | None = None) -> DataFrame:
    """``max_pixel`` over and over, from the coarsest resolution to the finest; survivors go on."""
    for r in resolutions:
        loops = max_pixel(loops, contacts, r, norms)
    return loops


def hotspots(contacts: DataFrame, files: int, widest: float = 0.35, lone: bool = True) -> DataFrame:
    """Per pixel over experiments (column ``percent``): n, min, max, range, sd, and a route; pixels that fail the bounds are dropped.

    Without ``lone``, a chromosome with one pixel left gives nothing.
    """
    least = 3 if files > 3 else 2
    d = contacts.groupBy("chr1", "chr2", "bin_x", "bin_y").agg(F.count("*").alias("n"), F.min("percent").alias("low"), F.max("percent").alias("high"), F.stddev_samp("percent").alias("sd"))
    d = d.withColumn("range", F.col("high") - F.col("low")).filter((F.col("range") <= widest) & (F.col("n") >= least) & (F.col("high") <= widest))
    if not lone:
        d = d.join(d.groupBy("chr1").agg(F.count("*").alias("_left")).filter("_left > 1").select("chr1"), "chr1", "left_semi")
    return d.withColumn("route", F.when((F.col("range") > 0.05) & (F.col("low") < 0.05), "candidate").when((F.col("range") < 0.05) & (F.col("low") > 0.05), "ubiquitous").otherwise("other"))


def standing_out(pixels: DataFrame) -> DataFrame:
    """Pixels with some percent contact whose enrichment or z is high."""
    return pixels.filter((F.col("percent") > 0) & ((F.col("oe") > 2) | (F.col("z") > 1.28)))


def anchor_strength(pixels: DataFrame) -> DataFrame:
    """``direction, chrom, bin, counts, oe, percent, z, n``: sums, and the product of oe, over pixels that stand out, for both of their bins."""
    kept = standing_out(pixels)
    ends = F.array(F.struct(F.lit("forward").alias("direction"), F.col("chr1").alias("chrom"), F.col("bin_x").alias("bin")), F.struct(F.lit("reverse").alias("direction"), F.col("chr2").alias("chrom"), F.col("bin_y").alias("bin")))
    return kept.withColumn("e", F.explode(ends)).groupBy("e.direction", "e.chrom", "e.bin").agg(
        F.sum("counts").alias("counts"), F.exp(F.sum(F.ln("oe"))).alias("oe"), F.sum("percent").alias("percent"), F.sum("z").alias("z"), F.count("*").alias("n")
    )


def strongest_in_cells(pixels: DataFrame, compression: int = 5, share: float = 0.95, least: int = 5, values: Sequence[str] = ("counts", "oe", "percent", "z")) -> DataFrame:
    """Pixels that reach a share of the maximum, in any value, over their cell and the eight around it, where these hold over ``least`` pixels."""
    d = pixels.withColumns({"cx": div("bin_x", compression), "cy": div("bin_y", compression)})
    cells = d.groupBy("chr1", "chr2", "cx", "cy").agg(F.count("*").alias("n"), *[F.max(v).alias(f"m_{v}") for v in values])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = cells.withColumn("s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).groupBy("chr1", "chr2", "cx", "cy").agg(F.sum("n").alias("n"), *[F.max(f"m_{v}").alias(f"m_{v}") for v in values])
    reach = F.lit(False)
    for v in values:
        reach = reach | (F.col(v) >= share * F.col(f"m_{v}"))
    return d.join(around.filter(F.col("n") > least), ["chr1", "chr2", "cx", "cy"]).filter(reach).drop("cx", "cy", "n", *[f"m_{v}" for v in values])


def vector_functions(bins: DataFrame) -> DataFrame:
    """Exports of anchor strength: z over n, n times the n-th root of oe, and log oe relative to the median of the positive ones."""
    d = bins.withColumns({"zscore": F.when(F.col("n") > 0, F.col("z") / F.col("n")), "scaled_oe": F.when(F.col("n") > 0, F.pow("oe", 1 / F.col("n")) * F.col("n")), "log_oe": F.ln("oe")})
    medians = d.filter("log_oe > 0").groupBy("direction", "chrom").agg(F.percentile("log_oe", 0.5).alias("_median"))
    return d.join(medians, ["direction", "chrom"], "left").withColumn("oe_log_median", F.when(F.col("_median") > 0, F.col("log_oe") / F.col("_median")).otherwise(0.0)).drop("log_oe", "_median")


def proportional(contacts: DataFrame, reads: int) -> DataFrame:
    """``chrom, contacts, reads``: reads dealt to chromosomes by their share of contacts."""
    d = contacts.filter("chr1 = chr2").groupBy(F.col("chr1").alias("chrom")).agg(F.sum("counts").alias("contacts"))
    return d.withColumn("reads", x.half_up(F.lit(float(reads)) * F.col("contacts") / F.sum("contacts").over(Window.partitionBy())).cast("bigint"))


def extreme_pixels(pixels: DataFrame, resolution: int, near: int = 10_000, far: int = 10_000_000, least: float = 0.005, most: float = 0.4) -> DataFrame:
    """Pixels (with nx, ny, oe, percent) over count, norm, distance, enrichment and percent bounds."""
    d = F.abs(F.col("bin_x") - F.col("bin_y"))
    return pixels.filter((F.col("counts") > 1) & (F.col("nx") >= 1) & (F.col("ny") >= 1) & (d > near // resolution) & (d < far // resolution) & (F.col("oe") > 1.5) & F.col("percent").between(least, most))


def coverage_filter(loops: DataFrame, z: DataFrame, strict: bool = False) -> DataFrame:
    """Drop loops whose norm z (of ``chrom, resolution, bin``, at the loop's own width) is below -1 on both sides or below -2 on one."""
    d = loops.withColumn("resolution", x.width(1))
    for s in (1, 2):
        v = z.select(F.col("chrom").alias(f"chr{s}"), "resolution", F.col("bin").alias(f"b{s}"), F.col("z").alias(f"z{s}"))
        d = d.withColumn(f"b{s}", div(x.mid(f"start{s}", f"end{s}"), F.col("resolution"))).join(v, [f"chr{s}", "resolution", f"b{s}"])
    keep = ~(((F.col("z1") < -1) & (F.col("z2") < -1)) | (F.col("z1") < -2) | (F.col("z2") < -2))
    if strict:
        keep = keep & (F.col("z1") > -1) & (F.col("z2") > -1)
    return d.filter(keep).drop("resolution", "b1", "b2")


def norm_matrix(norms: DataFrame, files: int) -> DataFrame:
    """``file_id, chrom, bin, log_value`` of the bins that are positive in every file."""
    good = norms.filter("value > 0 AND NOT isnan(value)")
    whole = good.groupBy("chrom", "bin").agg(F.count_distinct("file_id").alias("n")).filter(F.col("n") == files).drop("n")
    return good.join(whole, ["chrom", "bin"], "left_semi").select("file_id", "chrom", "bin", F.ln("value").alias("log_value"))


def convolve(pixels: DataFrame, half: int, value: str = "counts") -> DataFrame:
    """Pixels spread with a cone: weight max(0, half - distance) / half by rows and columns."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((half - abs(i) - abs(j)) / half).alias("k")) for i in range(-half, half + 1) for j in range(-half, half + 1) if abs(i) + abs(j) < half])
    return pixels.filter(F.col(value) > 0).withColumn("s", F.explode(steps)).groupBy("chr1", "chr2", (F.col("bin_x") + F.col("s.i")).alias("bin_x"), (F.col("bin_y") + F.col("s.j")).alias("bin_y")).agg(F.sum(F.col(value) * F.col("s.k")).alias("value"))
