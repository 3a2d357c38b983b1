"""Windows in tiles against plain ones, over borders of tiles, with repeats, nulls and pixels in several rows."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.functions.scalars import COORDS
from strandweave.operators import joins, kernels, matrix

LOOPS = "list_id string, " + ", ".join(f"{c} {'string' if c.startswith('chr') else 'bigint'}" for c in COORDS)
READS = "experiment string, chr1 string, chr2 string, bin_x bigint, bin_y bigint, counts bigint, resolution bigint"
R = 5000


def shuffles(df) -> int:
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def made(spark):
    """Loops and reads, and the same in plain form: the distinct loops with their bins, and the cells by experiment."""
    rng = random.Random(11)
    at = [(rng.choice("ab"), rng.choice(("c1", "c2")), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)]
    rows = []
    for k, c, a, b in at:
        s1, s2 = a * R + rng.randint(0, R - 1), b * R + rng.randint(0, R - 1)
        rows.append((k, c, s1, s1 + rng.choice((10, 5000)), rng.choice((c, "c2")), s2, s2 + rng.choice((10, 5000))))
    # far from all pixels, twice, in both lists, and without a coordinate
    rows += [("a", "c1", 900_000, 900_010, "c1", 900_000, 900_010), *rows[:5], *[("b", *r[1:]) for r in rows[:5]], ("a", "c1", None, 10, "c1", 5, 10)]
    reads = [(rng.choice("FO"), c, d, rng.randint(0, 45), rng.randint(0, 45), rng.randint(0, 4), R) for c in ("c1", "c2") for d in ("c1", "c2") for _ in range(500)]
    cells = defaultdict(Counter)
    for e, c, d, i, j, v, _ in reads:
        cells[e][c, d, i, j] += v
        cells[None][c, d, i, j] += v
    plain = {r: ((r[2] + r[3]) // 2 // R, (r[5] + r[6]) // 2 // R) for r in rows if r[2] is not None}
    return spark.createDataFrame(rows, LOOPS), spark.createDataFrame(reads, READS), plain, {e: +c for e, c in cells.items()}


def window(cells, loop, centre, w):
    return {(i, j): v for i in range(2 * w + 1) for j in range(2 * w + 1) if (v := cells.get((loop[1], loop[4], centre[0] - w + i, centre[1] - w + j), 0)) > 0}


def test_anchor_scores_are_those_of_whole_pile_ups(made):
    """Each of loops and pixels is shuffled once, and the sums once more."""
    loops, reads, plain, cells = made
    w, piles = 4, defaultdict(Counter)
    for loop in {r[1:]: None for r in plain}:
        centre = plain[next(r for r in plain if r[1:] == loop)]
        for c, v in window(cells[None], ("", *loop), centre, w).items():
            piles["upstream", loop[0], centre[0]][c] += v
            piles["downstream", loop[3], centre[1]][c] += v
    mean = lambda v: sum(v) / len(v) if v else 0
    want = {k: (p[w, w] + 1) / (mean([v for (i, j), v in p.items() if i > 6 and j < 2]) + 1) for k, p in piles.items()}
    found = matrix.anchor_scores(loops, reads, R, w, tile=8)
    assert shuffles(found) == 3
    got = {(r["side"], r["chrom"], r["bin"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_dumped_windows_are_shuffled_once(made):
    loops, reads, plain, cells = made
    w = 3
    want = {r[1:]: got for r, c in plain.items() if (got := window(cells[None], r, c, w))}
    found = matrix.window_dump(loops, reads, R, w, COORDS, tile=8)
    assert shuffles(found) == 2
    got = {tuple(r[c] for c in COORDS): {(i, j): v for i, row in enumerate(r["matrix"]) for j, v in enumerate(row) if v} for r in found.collect()}
    assert got == want
    assert len(want) < len({r[1:] for r in plain})


def test_sums_of_windows_are_shuffled_once(made):
    loops, reads, plain, cells = made
    w = 3
    want = sorted((*r, *c, v) for r, at in {r[1:]: (r, c) for r, c in plain.items()}.items() for c, v in window(cells[None], *at, w).items())
    found = matrix.window_sums(loops, reads, R, w, COORDS, tile=8)
    assert shuffles(found) == 2
    assert sorted(map(tuple, found.collect())) == want


def test_pairs_between_chromosomes_are_spread_over_tasks(spark):
    chroms = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "chrom string, chr_index int")
    rows = [(c, s, s + 5) for c in ("c1", "c2", "c3") for s in range(200)] + [("c3", 7, 12)] * 2
    anchors = spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    found = joins.pair_anchors_between(anchors, anchors, chroms)
    want = Counter((*a, *b) for a in rows for b in rows if a[0] < b[0])
    assert Counter(map(tuple, found.collect())) == want
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < sum(want.values()) / 3


def test_anchors_of_pairs_are_not_copied_before_the_shuffle(spark):
    """Pairs and copies are made above all shuffles, so what is shuffled is one row an anchor, in as many tasks as the setting says."""
    chroms = spark.createDataFrame([("c1", 1), ("c2", 2), ("c2", 2), ("c3", 0)], "chrom string, chr_index int")
    rows = [(c, s, s + 5) for c in ("c1", "c2", "c3", "c4", None) for s in range(-20, 20)] + [("c1", None, 12)] * 2
    anchors = spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    found = joins.pair_anchors_between(anchors.filter("end > 0 or end < -5"), anchors, chroms, blocks=3)
    index = {"c1": [1], "c2": [2, 2], "c3": [0]}
    want = Counter((*a, *b) for a in rows if a[2] > 0 or a[2] < -5 for b in rows for i in index.get(a[0], []) for j in index.get(b[0], []) if i < j)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index(" Exchange ")
    assert found.columns == COORDS and Counter(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == 4


def test_cells_of_windows_are_shuffled_once(made):
    loops, reads, plain, cells = made
    w = 3
    want = {r[1:]: (got, c[0] - w, c[1] - w) for r, c in plain.items() if (got := window(cells[None], r, c, w))}
    found = matrix.window_cells(loops, reads, R, w, COORDS, tile=8)
    assert shuffles(found) == 2
    got = {tuple(r[c] for c in COORDS): ({(p["dx"], p["dy"]): p["v"] for p in r["cells"]}, r["x0"], r["y0"]) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize(("w", "coarse"), [(16, 4), (13, 4), (12, 3), (6, 20)])
def test_pinpoint_in_tiles_finds_what_it_does_in_single_windows(spark, w, coarse):
    """Planted summits, some on borders of tiles, amid noise; two shuffles, and no window is a row on the way."""
    rng = random.Random(w)
    loops, reads = [], [("F", "c1", d, rng.randint(0, 45), rng.randint(0, 45), rng.randint(0, 3), R) for d in ("c1", "c2") for _ in range(300)]
    for d in ("c1", "c2"):
        for _ in range(20):
            a, b = rng.randint(0, 40), rng.randint(0, 40)
            reads += [("O", "c1", d, a + i, b + j, 90 - 20 * (abs(i) + abs(j)) + rng.randint(0, 9), R) for i in range(-2, 3) for j in range(-2, 3) if a + i >= 0 and b + j >= 0]
            for _ in range(6):
                s1, s2 = (max(0, c + rng.randint(-3, 3)) * R + rng.randint(0, R - 1) for c in (a, b))
                loops.append(("a", "c1", s1, s1 + 10, d, s2, s2 + 10))
    loops += [*loops[:9], ("a", "c1", 900_000, 900_010, "c1", 900_000, 900_010), ("a", "c1", None, 10, "c1", 5, 10)]
    loops, reads = spark.createDataFrame(loops, LOOPS), spark.createDataFrame(reads, READS)
    want = kernels.pinpoint(matrix.window_cells(loops, reads, R, w, COORDS, tile=16), COORDS, R, w, coarse)
    found = kernels.pinpoint_in_tiles(loops, reads, R, w, coarse, tile=16)
    assert found.dtypes == want.dtypes and shuffles(found) == 2
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 2


def test_pinpoint_makes_no_rows_of_windows(spark):
    """The query sends no window through a task of its own."""
    from strandweave.plans import tracks

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the test tables")
    plan = tracks.j_p7_pinpoint(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "cells" not in plan


def test_sieve_shuffles_packed_rows_once(made):
    """Two shuffles for all resolutions, and one of loops without a place; the values are those of ``sieve_scores`` over summed pixels."""
    loops, reads, plain, cells = made
    w, many = 5, {R: reads, 2 * R: reads.withColumn("resolution", F.lit(2 * R).cast("bigint"))}
    found = matrix.sieve(loops, many, loops, list(many), w, skip_global=True, bins=8)
    assert shuffles(found) == 3
    want, got = {}, {(r["resolution"], *(r[c] for c in COORDS)): (r["observed"], r["local_z"], r["local_oe"]) for r in found.collect()}
    for r, c in many.items():
        summed = c.groupBy("chr1", "chr2", "resolution", "bin_x", "bin_y").agg(F.sum("counts").alias("counts"))
        for row in matrix.sieve_scores(loops.select(*COORDS).distinct(), summed, r, w, COORDS).collect():
            want[(r, *(row[k] for k in COORDS))] = row["observed"], row["local_z"], row["local_oe"]
    assert got.keys() == want.keys() and len(got) == found.count() == 2 * (len({r[1:] for r in plain}) + 1)
    same = lambda p, q: p is None and q is None or math.isclose(p, q, abs_tol=1e-9)
    assert all(same(p, q) for k in want for p, q in zip(got[k], want[k]))
    assert any(v[1] for v in want.values())


def test_pixels_are_in_one_tile_each(made):
    """The expectation from tiles is that of summed pixels."""
    loops, reads, plain, cells = made
    chroms = loops.sparkSession.createDataFrame([("c1", 300_000), ("c2", 400_000)], "chrom string, length bigint")
    summed = reads.groupBy("chr1", "chr2", "resolution", "bin_x", "bin_y").agg(F.sum("counts").alias("counts")).filter("counts > 0")
    rows = lambda d: {(r["chrom"], r["resolution"], r["d"], r["n"]): (r["mean"], r["mean_log"], r["sd_log"]) for r in d.collect()}
    want, got = rows(matrix.expected(summed, chroms)), rows(matrix._expected_in_tiles([(reads, R)], chroms, 8 * R))
    assert got.keys() == want.keys() and want
    assert all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for k in want for p, q in zip(got[k], want[k]))
