"""Projections, filters, routing and set operators on 2-D features (``chr1, start1, end1, chr2, start2, end2``).

All of them are single DataFrame expressions, so Catalyst pushes their filters and prunes their columns. Null
coordinates make a filter drop the row and a projection give null.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS
from strandweave.operators.tiled import running


# --- projections
def expand_anchors(df: DataFrame, size: int, exact: bool = False) -> DataFrame:
    """Each side becomes ``size`` wide around its midpoint; unless ``exact``, a wider side keeps its bounds."""
    new = {}
    for s in (1, 2):
        start = x.mid(f"start{s}", f"end{s}") - size // 2
        keep = (F.col(f"end{s}") - F.col(f"start{s}") > size) & F.lit(not exact)
        new |= {f"start{s}": F.when(keep, F.col(f"start{s}")).otherwise(start), f"end{s}": F.when(keep, F.col(f"end{s}")).otherwise(start + size)}
    return df.withColumns(new)


def domain_points(df: DataFrame, reach: int = 100) -> DataFrame:
    """Corners and quarter-point centres of domains, told apart by ``kind``."""
    w = x.width(1)
    corner = (F.col("start1"), F.col("end2"))
    quarter = ((F.col("start1") + F.lit(0.25) * w).cast("bigint"), (F.col("start1") + F.lit(0.75) * w).cast("bigint"))
    point = lambda p: F.struct((p - reach).alias("start"), (p + reach).alias("end"))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), point(a).alias("a"), point(b).alias("b")) for k, (a, b) in (("corner", corner), ("centre", quarter))])
    return df.withColumn("p", F.explode(both)).withColumns({"start1": F.col("p.a.start"), "end1": F.col("p.a.end"), "start2": F.col("p.b.start"), "end2": F.col("p.b.end"), "kind": F.col("p.kind")}).drop("p")


def shift(df: DataFrame, offset: int) -> DataFrame:
    """Copies moved down and up; only those whose starts both stay above 0."""
    moved = df.withColumn("offset", F.explode(F.array(F.lit(-offset).cast("bigint"), F.lit(offset).cast("bigint"))))
    return moved.withColumns({c: F.col(c) + F.col("offset") for c in ("start1", "end1", "start2", "end2")}).filter("start1 > 0 AND start2 > 0")


def unwrap(df: DataFrame, bounds: Mapping[str, str], keep_original: bool = False) -> DataFrame:
    """Bounds from attribute columns, all or none: a row that misses one stays as it is."""
    values = {b: F.col(a).try_cast("bigint") for b, a in bounds.items()}
    whole = F.lit(True)
    for v in values.values():
        whole = whole & v.isNotNull()
    original = {f"original_{b}": F.col(b) for b in bounds} if keep_original else {}
    return df.withColumns(original | {b: F.when(whole, v).otherwise(F.col(b)) for b, v in values.items()})


def unwrap_local(df: DataFrame, resolution: int, px: str = "local_x", py: str = "local_y") -> DataFrame:
    """One bin at the local point; rows without one are dropped."""
    a, b = F.col(px).try_cast("bigint"), F.col(py).try_cast("bigint")
    return df.filter(a.isNotNull() & b.isNotNull()).withColumns({"start1": a, "end1": a + resolution, "start2": b, "end2": b + resolution})


def round_bounds(df: DataFrame, grid: int) -> DataFrame:
    """Starts go down to the grid, ends too but stay one step above their start."""
    if grid <= 1:
        return df
    out = {}
    for s in (1, 2):
        start = x.div(f"start{s}", grid) * grid
        out |= {f"start{s}": start, f"end{s}": F.greatest(x.div(f"end{s}", grid) * grid, start + grid)}
    return df.withColumns(out)


def project_attributes(df: DataFrame, keys: Sequence[str], attributes: str = "attributes") -> DataFrame:
    """Only the named attributes; a missing one is ``NA``."""
    entries = [y for k in keys for y in (F.lit(k), F.coalesce(F.try_element_at(F.col(attributes), F.lit(k)), F.lit("NA")))]
    return df.withColumn(attributes, F.create_map(*entries))


def without_attributes(df: DataFrame) -> DataFrame:
    return df.select(*COORDS)


# --- filters
def contains_local(df: DataFrame, px: str = "local_x", py: str = "local_y") -> DataFrame:
    """The local point lies in the closed bounds of both sides."""
    return df.filter(F.col(px).try_cast("bigint").between(F.col("start1"), F.col("end1")) & F.col(py).try_cast("bigint").between(F.col("start2"), F.col("end2")))


def away_from_diagonal(df: DataFrame, least: int = 5) -> DataFrame:
    return df.filter(x.div(x.loop_distance(), F.greatest(x.resolution_called_at(), F.lit(1000).cast("bigint"))) > least)


def apa_distance(df: DataFrame, resolution: int, window: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """Midpoint distance in bins between both bounds, each included; at least two windows unless given."""
    d = x.bin_distance(resolution)
    df = df.filter(d >= (2 * window if least is None else least))
    return df if most is None else df.filter(d <= most)


def oracle_score(df: DataFrame, s1: str, s2: str, s5: str, s10: str, strict: bool = False) -> DataFrame:
    """Far loops pass on the coarse scores, the others on the fine ones; strict needs both and ends at the first question."""
    far = x.loop_distance() > 1_000_000
    c, f = (F.col(s5) > 0.85, F.col(s10) > 0.85), (F.col(s1) > 0.2, F.col(s2) > 0.2)
    if strict:
        return df.filter(F.when(far, c[0] & c[1]).otherwise(f[0] & f[1]))
    return df.filter((far & (c[0] | c[1])) | f[0] | f[1])


def size_filter(df: DataFrame, resolution: int, compression: int) -> DataFrame:
    """Stripes: sides of different width, the longer one over one compressed step."""
    return df.filter((x.width(1) != x.width(2)) & (x.div(x.div(F.greatest(x.width(1), x.width(2)), resolution), compression) > 1))


def alone_in_bin(df: DataFrame, resolution: int) -> DataFrame:
    """Loops that no other shares both of its bins with."""
    d = df.withColumns({"bin_x": x.div(x.mid1(), resolution), "bin_y": x.div(x.mid2(), resolution)})
    lone = d.groupBy("chr1", "chr2", "bin_x", "bin_y").count().filter("count = 1").drop("count")
    return d.join(lone, ["chr1", "chr2", "bin_x", "bin_y"], "left_semi")


def distance_band(df: DataFrame, resolution: int, window: int) -> DataFrame:
    """``low, high``: bounds of the loops' distance in bins, widened by four windows. One row."""
    d = x.bin_distance(resolution)
    return df.filter("chr1 = chr2").agg((F.min(d) - 4 * window).alias("low"), (F.max(d) + 4 * window).alias("high"))


# --- routing
def unwrap_route(df: DataFrame, px: str = "local_x", py: str = "local_y") -> DataFrame:
    """``route`` by how far the local point is from the midpoints, and ``best`` for far loops with the point inside."""
    offset = F.abs(F.col(px) - x.mid1()) + F.abs(F.col(py) - x.mid2())
    inside = (F.col(px) >= F.col("start1")) & (F.col(px) < F.col("end1")) & (F.col(py) >= F.col("start2")) & (F.col(py) < F.col("end2"))
    return df.filter(F.col(px).isNotNull() & F.col(py).isNotNull()).withColumns(
        {"route": F.when(offset < 10, "optimal").when(offset > 400, "suboptimal").otherwise("middle"), "best": (x.loop_distance() > 10_000) & inside}
    )


def unwrap_far(df: DataFrame, least: int = 5000, px: str = "local_x", py: str = "local_y") -> DataFrame:
    return df.filter(F.least(F.abs(F.col(px) - F.col(py)), F.abs(x.mid1() - x.mid2())) > least)


def anchor_score_route(df: DataFrame, anchors: DataFrame, resolution: int = 1000, high: float = 1.1, low: float = 1.0) -> DataFrame:
    """Loops between scored forward and reverse anchors: both high pass, one low fails, others are open; unmatched vanish.

    Of several anchors in a bin the last in (start, end, name) order counts.
    """
    def side(word: str, name: str) -> DataFrame:
        picked = anchors.filter(F.lower("name").contains(word)).withColumn("bin", x.div("end", resolution))
        return picked.groupBy("chrom", "bin").agg(F.max_by("score", F.struct("start", "end", "name")).alias(name))

    up = side("forward", "score1").withColumnsRenamed({"chrom": "chr1", "bin": "bin1"})
    down = side("reverse", "score2").withColumnsRenamed({"chrom": "chr2", "bin": "bin2"})
    d = df.withColumns({"bin1": x.div("end1", resolution), "bin2": x.div("end2", resolution)}).join(up, ["chr1", "bin1"]).join(down, ["chr2", "bin2"])
    route = F.when((F.col("score1") > high) & (F.col("score2") > high), "pass").when((F.col("score1") < low) | (F.col("score2") < low), "fail").otherwise("open")
    return d.withColumn("route", route).drop("bin1", "bin2")


# --- enrichment verdicts
def sieve_verdict(df: DataFrame, z: Mapping[int, str], oe: Mapping[int, str], goe: Mapping[int, str], z_low: float = 1.0, oe_low: float = math.log(1.5)) -> DataFrame:
    """``verdict``: good, weak or none, from local z, local and global ratios at 1, 2 and 5 kb."""
    val = lambda c, d: F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c)), F.lit(d))
    zz = {r: val(c, -10.0) for r, c in z.items()}
    lo = {r: F.ln(val(c, 0.1)) for r, c in oe.items()}
    lg = {r: F.ln(val(c, 0.1)) for r, c in goe.items()}
    weak = {r: (zz[r] > z_low) & (lo[r] > oe_low) for r in z}
    med = {r: weak[r] & (lg[r] > oe_low) for r in z}
    strong = {r: (zz[r] > 2.0) & (lo[r] > math.log(2)) & (lg[r] > math.log(2)) for r in z}
    rs = sorted(z)
    mean = lambda v: sum((v[r] for r in rs[1:]), v[rs[0]]) / F.lit(float(len(rs)))
    avg = (mean(zz) > 1.0) & (mean(lo) > math.log(2))
    a, b, c = rs
    good = (
        (strong[a] & (med[b] | med[c] | avg)) | (strong[b] & (med[a] | med[c] | avg)) | (strong[c] & (med[a] | med[b] | avg))
        | (avg & ((med[a] & med[b]) | (weak[b] & weak[c]) | (weak[a] & weak[c])))
    )
    some = F.lit(False)
    for r in rs:
        some = some | (lg[r] > 1.25) | (lo[r] > 1.1) | (zz[r] > 0.5)
    return df.withColumn("verdict", F.when(good, "good").when(some, "weak").otherwise("none"))


def sieve_easy(df: DataFrame, z: Sequence[str], oe: Sequence[str], z_low: float = 0.0, oe_low: float = 0.0) -> DataFrame:
    """Every resolution has a local z and a log ratio above its bound."""
    ok = F.lit(True)
    for a, b in zip(z, oe):
        ok = ok & F.coalesce(F.when(F.isnan(a), None).otherwise(F.col(a)) > z_low, F.lit(False)) & F.coalesce(F.ln(F.when(F.isnan(b), None).otherwise(F.col(b))) > oe_low, F.lit(False))
    return df.filter(ok)


# --- set operators
def union_by_name(lists: Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """All rows of all lists, columns matched by name; ``tag`` adds the ordinal of the list."""
    out = None
    for i, d in enumerate(lists):
        d = d.withColumn(tag, F.lit(str(i))) if tag else d
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_features(df: DataFrame) -> DataFrame:
    return df.select(*COORDS).distinct()


def keep_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row for each set of coordinates: the least in the given order, chosen by an aggregate that combines early."""
    rest = [c for c in df.columns if c not in COORDS]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*COORDS).agg(first).select(*COORDS, "r.*")


def split_round_robin(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """``part`` from 0 to n - 1, dealt out in order, whose first column is a number, within each pair of chromosomes."""
    return running(df, ["chr1", "chr2"], order, F.lit(1), "_n").withColumn("part", (F.col("_n") % n).cast("int")).drop("_n")


def anchors_of(df: DataFrame) -> DataFrame:
    """Distinct anchors of both sides."""
    sides = F.array(*[F.struct(F.col(f"chr{s}").alias("chrom"), F.col(f"start{s}").alias("start"), F.col(f"end{s}").alias("end")) for s in (1, 2)])
    return df.select(F.explode(sides).alias("a")).select("a.*").distinct()


def unique_filtered(df: DataFrame, resolution: int, window: int) -> DataFrame:
    """``total, unique, filtered`` counts of a list before a pile-up, in one pass over distinct coordinates."""
    once = df.groupBy(*COORDS).agg(F.count("*").alias("n"))
    return once.agg(F.sum("n").alias("total"), F.count("*").alias("unique"), F.sum((x.bin_distance(resolution) >= 2 * window).cast("bigint")).alias("filtered"))


def union_bounds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(c) for c, f in (("start1", F.min), ("end1", F.max), ("start2", F.min), ("end2", F.max))])


# --- flat files: one status column a stem
def flat_file(calls: DataFrame, stems: Sequence[str]) -> DataFrame:
    """Pivot of ``stem, status`` to one int column a stem: -1 wins over 1, 0 where a stem has neither."""
    return calls.groupBy(*COORDS).pivot("stem", list(stems)).agg(F.min("status")).fillna(0, list(stems))


def two_way(flat: DataFrame, a: str, b: str) -> DataFrame:
    route = F.when((F.col(a) == 1) & (F.col(b) == 1), "both").when((F.col(a) == 1) & (F.col(b) == -1), "only1").when((F.col(a) == -1) & (F.col(b) == 1), "only2").when((F.col(a) == -1) & (F.col(b) == -1), "neither")
    return flat.withColumn("route", route).filter("route IS NOT NULL")


def common_or_variable(flat: DataFrame, stems: Sequence[str]) -> DataFrame:
    k = len(stems) // 3
    count = lambda v: sum((F.when(F.col(s) == v, 1).otherwise(0) for s in stems), F.lit(0))
    yes, no = count(1), count(-1)
    route = F.when(yes == len(stems), "always").when(no == len(stems), "never").when(no == 0, "mostly").when((yes >= k) & (no >= k), "variable")
    return flat.withColumn("route", route).filter("route IS NOT NULL")


def multi_group(flat: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``present`` and ``absent``: the one group with mean status above .99 (below -.99) while most others are of the other sign."""
    means = {g: sum((F.col(s) for s in ss), F.lit(0)) / F.lit(float(len(ss))) for g, ss in groups.items()}
    half = len(groups) // 2

    def only(sign: int) -> Column:
        hits = sum((F.when(sign * m > 0.99, 1).otherwise(0) for m in means.values()), F.lit(0))
        against = sum((F.when(sign * m < 0, 1).otherwise(0) for m in means.values()), F.lit(0))
        which = F.coalesce(*[F.when(sign * m > 0.99, g) for g, m in means.items()])
        return F.when((hits == 1) & (against > half), which)

    return flat.withColumns({"present": only(1), "absent": only(-1)}).filter("present IS NOT NULL OR absent IS NOT NULL")
