"""What lies beyond the extent of the smallest tables, and what the whole job has over its first form."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.functions.scalars import COORDS
from strandweave.operators import kernels, matrix, sampling
from strandweave.plans import fixtures, matrices

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pixels_beyond_60_mb_have_norms(spark, tmp_path):
    for t in ("nation", "lineitem"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df = df.withColumn("l_partkey", F.col("l_partkey") * 1000) if t == "lineitem" else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    d = str(tmp_path)
    far = matrices.contacts(spark, d).filter("resolution = 5000")
    assert far.filter("bin_y > 12000").count() > far.count() / 2
    assert matrices.pixels(spark, d).count() == far.count()
    length = fixtures.view(spark, d, "fx_chroms").first()["length"]
    assert length > far.agg(F.max("bin_y")).first()[0] * 5000


def test_flags_pile_up_against_listed_pairs(spark):
    rng, w = random.Random(3), 2
    chroms = spark.createDataFrame([("c1", 1), ("c2", 2), ("c10", 10), ("c11", 11)], "chrom string, chr_index int")
    index = {r["chrom"]: r["chr_index"] for r in chroms.collect()}
    points = [(c, s, s + rng.randint(10, 9000)) for c in index for s in (rng.randint(0, 9_000_000) for _ in range(40))]
    points += points[:3]
    # as near as the bounds of strata
    points += [("c1", 1_000_000, 1_000_010), ("c1", 1_500_000, 1_500_010), ("c1", 2_000_000, 2_000_010), ("c1", 2_000_001, 2_000_011)]
    intra = {(c, c, a, a + rng.randint(0, 90)): rng.randint(1, 9) for c in index for a in (rng.randint(0, 90) for _ in range(600))}
    inter = {(a, b, rng.randint(0, 95), rng.randint(0, 95)): rng.randint(1, 9) for a in index for b in index if index[a] < index[b] for _ in range(60)}
    shape = "chr1 string, chr2 string, bin_x bigint, bin_y bigint, counts bigint, resolution bigint"
    frame = lambda m: spark.createDataFrame([(*k, v, 100_000) for k, v in m.items()], shape)
    got = matrix.flags_pile_up(spark.createDataFrame(points, "chrom string, start bigint, end bigint"), frame(intra), frame(inter), chroms, 100_000, 100_000, w)
    want, once = Counter(), set(points)
    for a in once:
        for b in once:
            m, n = (a[1] + a[2]) // 2, (b[1] + b[2]) // 2
            if a[0] == b[0] and a[2] < b[1] and n - m > 500_000:
                stack = ("intra", next(k for k in range(9) if n - m <= 2**k * 1_000_000))
            elif index[a[0]] < index[b[0]]:
                stack = ("inter", None)
            else:
                continue
            i, j = index[a[0]], index[b[0]]
            for name in ["all"] + ["big"] * (i < 9 and j < 9) + ["small"] * (i > 9 and j > 9):
                for dx in range(2 * w + 1):
                    for dy in range(2 * w + 1):
                        want[(*stack, name, dx, dy)] += (inter if stack[0] == "inter" else intra).get((a[0], b[0], m // 100_000 - w + dx, n // 100_000 - w + dy), 0)
    have = {tuple(r)[:5]: r["total"] for r in got.collect()}
    assert len(have) == (5 + 1) * 3 * (2 * w + 1) ** 2
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v}
    assert any(v for k, v in want.items() if k[1] == 3) and any(v for k, v in want.items() if k[0] == "inter" and k[2] == "small")


def test_flags_pile_up_in_small_tiles_lists_no_pairs(spark):
    """Rows of a pixel count together over borders of tiles; only what chromosomes tell is broadcast, and a pixel is shuffled once, without its anchors."""
    rng, w, tile = random.Random(4), 3, 8
    chroms = spark.createDataFrame([("c1", 1), ("c2", 12)], "chrom string, chr_index int")
    points = [(c, s, s + rng.randint(10, 400_000)) for c in ("c1", "c2") for s in (rng.randint(0, 5_000_000) for _ in range(50))]
    points += [("c1", 0, 10), ("c1", 500_000, 500_010), ("c1", 500_001, 500_011), ("c1", 1_000_000, 1_000_010), ("c1", None, 5)]
    rows = [(c, c, a, min(59, a + rng.randint(0, 40)), rng.randint(0, 9), 100_000) for c in ("c1", "c2") for a in (rng.randint(0, 59) for _ in range(900))]
    shape = "chr1 string, chr2 string, bin_x bigint, bin_y bigint, counts bigint, resolution bigint"
    between = [("c1", "c2", a, b, a + b, 100_000) for a in range(20) for b in range(20)]
    anchors = spark.createDataFrame(points, "chrom string, start bigint, end bigint").repartition(3)
    found = matrix.flags_pile_up(anchors, spark.createDataFrame(rows, shape), spark.createDataFrame(between, shape), chroms, 100_000, 100_000, w, tile=tile)
    cells, want = Counter(), Counter()
    for c, _, a, b, n, _ in rows:
        cells[c, a, b] += n
    once = [p for p in points if p[1] is not None]
    for a in once:
        for b in once:
            m, n = (a[1] + a[2]) // 2, (b[1] + b[2]) // 2
            if a[0] == b[0] and a[2] < b[1] and n - m > 500_000:
                k = next(k for k in range(9) if n - m <= 2**k * 1_000_000)
                for i in range(2 * w + 1):
                    for j in range(2 * w + 1):
                        want[k, i, j] += cells[a[0], m // 100_000 - w + i, n // 100_000 - w + j]
    got = {(r["stratum"], r["dx"], r["dy"]): r["total"] for r in found.filter("kind = 'intra' AND size_class = 'all'").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len({k for k, *_ in want}) == 4
    plan = str(found._jdf.queryExecution().executedPlan().toString())
    kept = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("bin_" in line or "_b#" in line or "_tx" in line)]
    assert not kept and "FlatMapCoGroupsInArrow" in plan


def plain_integrate(rows, res, reach):
    """getIdealPosition of the reference over dense arrays; a repeated loop counts as often."""
    size = 60
    data = defaultdict(lambda: [0.0] * size)
    for c1, _, _, c2, _, _, x, y in rows:
        for c, p in ((c1, x), (c2, y)):
            if p is not None:
                for o, k in zip((-2, -1, 0, 1, 2), (0.055, 0.245, 0.4, 0.245, 0.055)):
                    data[c][p // res + o] += k

    def best(d, a, b, pos):
        for i in range(a, b):
            if round(d[i], 9) > round(d[pos], 9):
                pos = i
        return pos

    def is_max(d, i):
        v = [round(d[j], 9) for j in (i - 1, i, i + 1)]
        return i > 0 and v[1] > 1 and v[1] > v[0] and v[1] > v[2]

    def ideal(c, p, start, end):
        d = data[c]
        if p is not None:
            i = best(d, max(1, p // res - reach), min(size - 1, p // res + reach + 1), p // res)
            if is_max(d, i):
                return i
        a, b = max(1, start // res - reach), min(size - 1, end // res + reach + 1)
        i = best(d, a, b, (a + b) // 2)
        return i if is_max(d, i) else -1

    at = [(r[0], ideal(r[0], r[6], r[1], r[2]), r[3], ideal(r[3], r[7], r[4], r[5])) for r in rows]
    return {(a, i * res, b, j * res) for a, i, b, j in at if i > 0 and j > 0}


def test_integrate_takes_the_bounds_where_no_local_point_fits(spark):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        a, b = rng.choice([120, 260, 400]) + rng.randint(-40, 40), rng.choice([130, 330, 470]) + rng.randint(-40, 40)
        x, y = (None if rng.random() < 0.2 else rng.choice([130, 270, 415, 420]) + rng.choice([-20, 0, 0, 10]) for _ in range(2))
        rows.append((f"c{k % 2}", a, a + 50, "c2", b, b + 30, x, y))
    # a local point that is far from any maximum: only the bounds give one
    rows.append(("c0", 260, 290, "c2", 260, 290, 570, 560))
    rows += [("c3", 290, 310, "c2", 255, 285, 300, None)] * 2 + [("c3", 290, 310, "c2", 255 + i, 285, 300, None) for i in range(5)]
    df = spark.createDataFrame(rows, "chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint, local_x bigint, local_y bigint")
    found = lambda **k: {(r["chr1"], r["start1"], r["chr2"], r["start2"]) for r in kernels.integrate(df, 10, 3, **k).collect()}
    assert found() == plain_integrate(rows, 10, 3)
    assert found(bounds=False) < found()


def test_reads_follow_the_row_sums_of_the_high_resolution(spark):
    # c1: two fine bins of a coarse one, 9 : 1, and none in the rest; c2: half of its contacts lie beyond the range of draws
    fine = [("c1", 3, 13, 90), ("c1", 7, 17, 10), ("c2", 1, 11, 50), ("c2", 1, 95, 50)]
    rows = [(c, c, 100, x, y, n) for c, x, y, n in fine] + [("c1", "c1", 1000, 0, 1, 100), ("c2", "c2", 1000, 0, 1, 50), ("c2", "c2", 1000, 0, 9, 50)]
    df = spark.createDataFrame(rows, "chr1 string, chr2 string, resolution bigint, bin_x bigint, bin_y bigint, counts bigint")
    got = sampling.sample_reads(df, 1000, 4000, 100, far=5000).collect()
    by = Counter((r["chr1"], r["pos1"], r["pos2"]) for r in got)
    assert Counter(r["chr1"] for r in got) == {"c1": 2000, "c2": 2000}
    assert set(by) == {("c1", a, b) for a in (300, 700) for b in (1300, 1700)} | {("c2", 100, 1100)}
    first = sum(n for (c, a, _), n in by.items() if c == "c1" and a == 300)
    assert 1700 < first < 1900


def plain_model(pixels, cells):
    """Mean, mean and deviation of logarithms by distance, and the mean at the least one."""
    import numpy as np

    by = defaultdict(list)
    for (a, b), n in pixels.items():
        by[abs(a - b)].append(n)
    out = {}
    for d, v in by.items():
        v = np.array(v + [0] * (cells - d - len(v)), float)
        out[d] = (v.mean(), np.log1p(v).mean(), np.log1p(v).std(ddof=1))
    return out, out[min(out)][0]


def test_sieve_and_recap_against_plain_windows(spark):
    import numpy as np

    rng, cells, w = random.Random(8), 60, 6
    at = {(e, a, a + rng.randint(0, 20)): rng.randint(1, 30) for e in "FO" for a in (rng.randint(0, 59) for _ in range(500))}
    rows = [("c", "c", r, b0, b1, e, n) for r in (100, 1000) for (e, b0, b1), n in at.items() if b1 < cells]
    df = spark.createDataFrame(rows, "chr1 string, chr2 string, resolution bigint, bin_x bigint, bin_y bigint, experiment string, counts bigint")
    chroms = spark.createDataFrame([("c", 6000, 1)], "chrom string, length bigint, chr_index int")
    # at 100 the chromosome has 60 bins, at 1000 only 6 by its length: the second is there for the number of rows
    bins = [(rng.randint(0, 40), rng.randint(0, 20)) for _ in range(25)]
    loops = [("A" if k % 2 else "R", "c", 100 * a, 100 * a + 90, "c", 100 * (a + o), 100 * (a + o) + 90) for k, (a, o) in enumerate(bins)]
    lf = spark.createDataFrame(loops, "list_id string, chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint")
    merged = df.groupBy("chr1", "chr2", "resolution", "bin_x", "bin_y").agg(F.sum("counts").alias("counts"))
    got = {(r["start1"] // 100, r["start2"] // 100): r for r in matrix.sieve(lf, merged, chroms, [100, 1000], w).collect() if r["resolution"] == 100}
    assert set(got) == {(a, a + o) for a, o in bins}
    assert matrix.sieve(lf, merged, chroms, [100, 1000], w).count() == 2 * len(got)
    sums = Counter()
    for (_, a, b), n in at.items():
        sums[a, b] += n * (b < cells)
    sums = {k: n for k, n in sums.items() if n}
    model, first = plain_model(sums, cells)
    close = lambda p, q: (p is None and q is None) or abs(p - q) < 1e-9 * max(1, abs(q))
    for (a, b), r in got.items():
        o, m = sums.get((a, b), 0), model.get(b - a)
        assert r["observed"] == o
        cut = [sums.get((i, j), 0) for i in range(max(0, a - w), a + w + 1) for j in range(max(0, b - w), b + w + 1) if i != a and j != b]
        assert close(r["local_z"], (o - np.mean(cut)) / np.std(cut, ddof=1)) and close(r["local_oe"], o / np.mean(cut))
        assert close(r["global_oe"], o / m[0]) and close(r["global_z"], (np.log1p(o) - m[1]) / m[2])
        assert close(r["percent"], min(1, max(0, (o - m[0]) / (first - m[0]))) if m[0] != first else 0.0)
    with pytest.raises(ValueError):
        matrix.sieve(lf, merged, chroms, [100], 4)

    got = matrix.recap(lf, df, chroms, 100, w, ["list_id"]).collect()
    assert len(got) == 2 * len(set(loops))
    for r in got:
        own = {(a, b): n for (e, a, b), n in at.items() if e == r["experiment"] and b < cells}
        model, first = plain_model(own, cells)
        a, b = r["start1"] // 100, r["start2"] // 100
        m, o = model.get(b - a), own.get((a, b), 0)
        g = np.array([[own.get((a - w + i, b - w + j), 0) for j in range(2 * w + 1)] for i in range(2 * w + 1)], float)
        assert r["total"] == g.sum()
        assert close(r["presence"], None if m is None else min(1, max(0, (o - m[0]) / (first - m[0]))) if m[0] != first else 0.0)
        far = np.abs(np.arange(2 * w + 1) - w)
        decay = [(k, g[far[:, None] + far[None, :] == k].mean()) for k in range(w)]
        xs, ys = zip(*[(k, np.log(v)) for k, v in decay if v > 0])
        slope, cut = np.polyfit(xs, ys, 1)
        pdf = g.sum(1) / g.sum()
        for name, v in (("slope", slope), ("amplitude", np.exp(cut)), ("row_amplitude", pdf.std(ddof=1)), ("row_spread", np.sqrt(((np.arange(2 * w + 1) - w) ** 2 * pdf).sum()))):
            assert abs(r[name] - v) < 1e-7 * max(1, abs(v)), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_of_one_list_reach_all_loops(spark):
    """The rows of list A, which the SQL covers, are within those of all lists."""
    from strandweave.plans import registry, tracks

    q = registry.queries()
    for name in ("j6b_contained_anchors", "j12_window_pixels", "f18_pixel_mask", "j14_near_pixels", "a7_apa_1d", "t1_simple_max", "t3_coarse_to_fine"):
        key = [c for c in q[name](spark, DATA).columns if c != "total"]
        one, all_ = ({tuple(r) for r in q[n](spark, DATA).select(*key).collect()} for n in (name, f"{name}_all"))
        assert one <= all_, name
        # at this size every coarse pixel is near some loop of A
        assert len(one) < len(all_) or name in ("j14_near_pixels", "a7_apa_1d"), name
    n = fixtures.view(spark, DATA, "fx_loops").select(*COORDS).distinct().count()
    assert q["a11_window_dump_all"](spark, DATA).count() == n
    assert q["a9_enhance_lists"](spark, DATA).select("list_id").distinct().count() == 3
    anchors = fixtures.view(spark, DATA, "fx_anchors").groupBy("chrom").agg(F.count_if(F.col("name").startswith("F")).alias("f"), F.count_if(F.col("name").startswith("R")).alias("r")).collect()
    index = {r["chrom"]: r for r in anchors}
    assert q["j11_anchor_pairs_inter_all"](spark, DATA).count() == sum(index[a]["f"] * index[b]["r"] for a in index for b in index if a < b)
    found = {(r["start1"], r["start2"]) for r in tracks.j_p7_pinpoint(spark, DATA).select("start1", "start2").collect()}
    outside = fixtures.view(spark, DATA, "fx_loops").filter("list_id <> 'A'").select("start1", "start2").collect()
    assert found & {tuple(r) for r in outside}
