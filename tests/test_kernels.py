import random

import numpy as np
import pandas as pd
import pytest

from strandweave.functions.scalars import COORDS
from strandweave.operators import features, graph, joins, kernels

F2 = "chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint"


def feats(spark, rows):
    return spark.createDataFrame([("c", a, b, "c", x, y) for a, b, x, y in rows], F2)


def boxes(df):
    return sorted(tuple(r[c] for c in ("start1", "end1", "start2", "end2")) for r in df.collect())


def plain_fuse(rows, suppress):
    rest = sorted(set(rows), key=lambda r: (r[1] - r[0], r[3] - r[2], r[0], r[2], r[1], r[3]))
    out = []
    while rest:
        s = rest.pop(0)
        b = 0 if suppress else max(s[1] - s[0], s[3] - s[2])
        hit = [r for r in rest if r[0] < s[1] + b and s[0] - b < r[1] and r[2] < s[3] + b and s[2] - b < r[3]]
        rest = [r for r in rest if r not in hit]
        g = [s, *hit]
        out.append(s if suppress else (min(r[0] for r in g), max(r[1] for r in g), min(r[2] for r in g), max(r[3] for r in g)))
    return sorted(out)


@pytest.mark.parametrize("suppress", [False, True])
def test_fuse(spark, suppress):
    rng = random.Random(2)
    rows = [(a, a + rng.randint(1, 40), b, b + rng.randint(1, 40)) for a, b in ((rng.randint(0, 400), rng.randint(0, 400)) for _ in range(150))]
    assert boxes(kernels.fuse(feats(spark, rows), suppress)) == plain_fuse(rows, suppress)
    assert boxes(kernels.fuse(feats(spark, rows).limit(0))) == []


def test_suppress_near_against_greedy(spark):
    rng = random.Random(4)
    pix = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(300)})
    val = {p: rng.randint(1, 9) for p in pix}
    kept, rest = [], sorted(pix, key=lambda p: (-val[p], p))
    while rest:
        s = rest.pop(0)
        kept.append(s)
        rest = [p for p in rest if int(((p[0] - s[0]) ** 2 + (p[1] - s[1]) ** 2) ** 0.5) > 3]
    df = spark.createDataFrame([("c", "c", a, b, float(v)) for (a, b), v in val.items()], "chr1 string, chr2 string, bin_x bigint, bin_y bigint, high double")
    assert sorted((r["bin_x"], r["bin_y"]) for r in kernels.suppress_near(df, 3).collect()) == sorted(kept)


def test_collapse():
    px, py, v = np.array([5, 6, 7, 30]), np.array([5, 5, 6, 30]), np.array([9.0, 2.0, 3.0, 50.0])
    assert kernels.collapse_tile(px, py, v, 2, 1.5) == [0]
    rows = [(100, 50, 50, 5.0), (200, 25, 25, 9.0), (100, 500, 500, 1.0)]
    assert kernels.collapse_resolutions_tile(rows) == [(100, 50, 50, 5.0)]


def test_t_tail():
    # known values of Student's t
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (2.0, 60, 0.0500), (0.0, 5, 1.0)):
        assert abs(kernels.t_two_sided(t, df) - p) < 6e-4
    a, b = np.array([1.0, 2, 3, 4, 5, 6]), np.array([11.0, 12, 13, 14, 15, 16])
    assert kernels.two_sample_p(a, b) < 1e-4 and kernels.two_sample_p(a, a) == 1.0 and kernels.one_sample_p(3.5, a) == 1.0


def test_stripe_runs_boundary():
    m = np.ones((5, 40))
    m[2, 5:15] = 9.0
    assert kernels.stripe_runs(m, 30) == []
    got = kernels.stripe_runs(m, 8)
    assert len(got) == 1 and got[0][0] <= 5 and got[0][1] >= 15


def test_components(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(90)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {n: find(n) for n in list(parent)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_overlap_boundaries(spark):
    a, far = feats(spark, [(0, 10, 0, 10)]), feats(spark, [(10, 20, 0, 10), (0, 10, 20, 30)])
    assert boxes(joins.overlap_semi(a, far)) == [] and boxes(joins.overlap_anti(a, far)) == [(0, 10, 0, 10)]
    wide = feats(spark, [(0, 5_000_000_000, 0, 5_000_000_000)])
    assert boxes(joins.overlap_semi(wide, feats(spark, [(4_000_000_000, 4_000_000_001, 1, 2)]), tile=1_000_000_000)) == boxes(wide)
    assert boxes(joins.overlap_semi(a, a.limit(0))) == [] and boxes(joins.overlap_semi(a.limit(0), a)) == []


def test_overlap_against_brute_force(spark):
    rng = random.Random(8)
    make = lambda: [(s, s + rng.randint(1, 90), t, t + rng.randint(1, 90)) for s, t in ((rng.randint(0, 900), rng.randint(0, 900)) for _ in range(80))]
    a, b = make(), make()
    for w in (0, 15):
        want = {r for r in a if any(r[0] - w < q[1] and q[0] < r[1] + w and r[2] - w < q[3] and q[2] < r[3] + w for q in b)}
        assert boxes(joins.overlap_semi(feats(spark, a), feats(spark, b), w, tile=50)) == sorted(want)
        assert joins.overlap_pairs(feats(spark, a), feats(spark, b), w, tile=50).count() == sum(r[0] - w < q[1] and q[0] < r[1] + w and r[2] - w < q[3] and q[2] < r[3] + w for r in a for q in b)


def test_feature_rules(spark):
    d = spark.createDataFrame([("c", 100, 100, "c", 95, 105)], F2)
    assert boxes(features.expand_anchors(d, 5)) == [(98, 103, 95, 105)]
    assert boxes(features.expand_anchors(d, 5, exact=True)) == [(98, 103, 98, 103)]
    assert boxes(features.shift(spark.createDataFrame([("c", 10, 20, "c", 30, 40)], F2), 10)) == [(20, 30, 40, 50)]
    calls = spark.createDataFrame([("A", 1, *r) for r in [("c", 1, 2, "c", 3, 4)]] + [("A", -1, "c", 1, 2, "c", 3, 4)], "stem string, status int, " + F2)
    assert features.flat_file(calls, ["A"]).collect()[0]["A"] == -1
    assert features.two_way(spark.createDataFrame([(1, 0)], "a int, b int"), "a", "b").count() == 0


def test_pinpoint_finds_the_summit(spark):
    cells = [(60 + i, 60 + j, float(max(2, 4000 - 800 * (abs(i) + abs(j))))) for i in range(-60, 61) for j in range(-60, 61)]
    df = spark.createDataFrame([("c", 0, 1, "c", 0, 1, 0, 0, cells)], F2 + ", x0 bigint, y0 bigint, cells array<struct<dx:int,dy:int,v:double>>")
    got = kernels.pinpoint(df, COORDS, 100, 60, coarse=4).collect()
    assert len(got) == 1 and abs(got[0]["peak_x"] - 6000) < 150 and abs(got[0]["peak_y"] - 6000) < 150


def test_groups(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 2], "v": [1.0, 2.0, 5.0]}))
    assert sorted(r["v"] for r in kernels.in_groups(df, ["k"], lambda p: p.nlargest(1, "v"), "k bigint, v double").collect()) == [2.0, 5.0]
