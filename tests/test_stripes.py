import numpy as np
import pytest

from strandweave.operators import kernels, matrix

RES, N = 10_000, 400


@pytest.fixture(scope="module")
def striped(spark):
    """A chromosome with a stripe to the right of bin 60 and one above bin 300, on noise."""
    rng = np.random.default_rng(5)
    counts = {(i, j): int(c) for i in range(N) for j in range(i, min(N, i + 160)) if (c := rng.poisson(2)) > 0}
    for k, shape in ((-2, 0.2), (-1, 0.5), (0, 1.0), (1, 0.5), (2, 0.2)):
        for j in range(80, 130):
            counts[(60 + k, j)] = int(rng.poisson(1 + 60 * shape))
        for i in range(190, 250):
            counts[(i, 300 + k)] = int(rng.poisson(1 + 60 * shape))
    contacts = spark.createDataFrame([("c", "c", RES, i, j, c) for (i, j), c in counts.items() if c > 0], "chr1 string, chr2 string, resolution bigint, bin_x bigint, bin_y bigint, counts bigint")
    chroms = spark.createDataFrame([("c", N * RES)], "chrom string, length bigint")
    norms = spark.createDataFrame([("VC", "c", RES, b, 1.0 + (b % 7) * 0.01 if b != 299 else 1e-9) for b in range(-1, N + 1)], "norm string, chrom string, resolution bigint, bin bigint, value double")
    return matrix.against_expected(contacts, matrix.expected(contacts, chroms)), norms


def test_stripes_are_found(striped):
    px, _ = striped
    found = kernels.stripes(px, RES, 20_000, 1_500_000).collect()
    flat = [r for r in found if r["orientation"] == "horizontal" and r["start1"] == 60 * RES]
    up = [r for r in found if r["orientation"] == "vertical" and r["start2"] == 300 * RES]
    assert len(flat) == 1 and len(up) == 1
    assert flat[0]["end1"] == 61 * RES and abs(flat[0]["start2"] - 80 * RES) <= 8 * RES and abs(flat[0]["end2"] - 130 * RES) <= 8 * RES
    assert up[0]["end2"] == 301 * RES and abs(up[0]["start1"] - 190 * RES) <= 8 * RES and abs(up[0]["end1"] - 250 * RES) <= 8 * RES


def test_masked_bins_make_no_stripe(striped):
    px, norms = striped
    good = matrix.quality_mask(px, norms, neighbours=True)
    # bin 299 is poor, so its neighbour 300 is left out as well
    assert good.filter("bin_y BETWEEN 298 AND 300 OR bin_x BETWEEN 298 AND 300").count() == 0 and matrix.quality_mask(px, norms).filter("bin_y = 300").count() > 0
    found = kernels.stripes(good, RES, 20_000, 1_500_000).collect()
    assert [r for r in found if r["start1"] == 60 * RES] and not [r for r in found if r["start2"] == 300 * RES]


def test_acceptance():
    rng = np.random.default_rng(1)
    part = rng.poisson(4, (5, 40)).astype(float)
    assert not kernels.stripe_accepted(part)
    part[2] += 20
    assert kernels.stripe_accepted(part)
    assert not kernels.stripe_accepted(part[:, :4])


def test_localized_line(spark):
    rng = np.random.default_rng(2)
    image = rng.poisson(2, (31, 31)).astype(float)
    image[11:14] += 8  # the best line is the middle of the best three
    image[12] += 15
    best, p = kernels.localize(image, 2)
    assert best == 12 and p < 0.01
    image[11:14] -= 8
    image[12] -= 15
    image[0] += 40
    assert kernels.localize(image, 2) is None
    loop = spark.createDataFrame([("c", 1000, 1010, "c", 2000, 2010)], "chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint")
    cells = [("c", "c", 10, 100 + i - 15, 200 + j - 15, int(2 + (9 + i * j) % 3 + 12 * (17 <= i <= 19) + 15 * (i == 18))) for i in range(31) for j in range(31)]
    contacts = spark.createDataFrame(cells, "chr1 string, chr2 string, resolution bigint, bin_x bigint, bin_y bigint, counts bigint")
    names = ["chr1", "start1", "end1", "chr2", "start2", "end2"]
    got = kernels.localize_stripes(matrix.window_cells(loop, contacts, 10, 15, names), names, 15, 2).collect()
    assert [r["best"] for r in got] == [18]


def test_suppression_along_a_ridge(spark):
    """A round for each pixel that stays."""
    df = spark.createDataFrame([("c", "c", i, 0, float(12 - i)) for i in range(12)], "chr1 string, chr2 string, bin_x bigint, bin_y bigint, high double")
    assert sorted(r["bin_x"] for r in kernels.suppress_near(df, 1).collect()) == [0, 2, 4, 6, 8, 10] and kernels.suppress_near(df.limit(0), 1).count() == 0
