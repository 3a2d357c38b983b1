"""Queries of matrices, pile-ups and their statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS
from strandweave.operators import features, joins
from strandweave.operators import matrix as op
from strandweave.plans.book import Book
from strandweave.plans.fixtures import reads, view
from strandweave.plans.joins import _list

book = Book()
C = ", ".join(COORDS)
RES, W = 5000, 10
SPAN = 2 * W + 1


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def contacts(spark: SparkSession, d: str, merged: bool = True) -> DataFrame:
    return view(spark, d, "fx_contacts_merged" if merged else "fx_contacts")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of one resolution with norms and their values against the expectation."""
    c = op.normalized(contacts(spark, d).filter(f"resolution = {RES}"), view(spark, d, "fx_norms"))
    return op.against_expected(c, op.expected(contacts(spark, d), view(spark, d, "fx_chroms")))


# --- SQL parts
CM = "cm AS (SELECT chr1, chr2, resolution, bin_x, bin_y, CAST(sum(counts) AS BIGINT) AS counts FROM fx_contacts GROUP BY ALL)"
EX = f"""{CM},
ed AS (SELECT chr1 AS chrom, resolution, abs(bin_x - bin_y) AS d, sum(counts) AS s, sum(ln(1 + counts)) AS sl, sum(ln(1 + counts) * ln(1 + counts)) AS ql FROM cm GROUP BY ALL),
en AS (SELECT e.*, greatest((c.length + e.resolution - 1) // e.resolution - d, 1) AS n FROM ed e JOIN fx_chroms c USING (chrom)),
em AS (SELECT chrom, resolution, d, n, s / n AS mean, sl / n AS mean_log, sqrt(greatest(ql - n * (sl / n) * (sl / n), 0) / greatest(n - 1, 1)) AS sd_log FROM en)"""
#: Stages are materialized, as equal chromosomes would else let norms meet norms.
PX = f"""{EX},
p1 AS MATERIALIZED (SELECT c.*, a.value AS nx FROM cm c JOIN fx_norms a ON a.chrom = c.chr1 AND a.resolution = c.resolution AND a.bin = c.bin_x WHERE c.resolution = {RES}),
p2 AS MATERIALIZED (SELECT c.*, b.value AS ny, abs(bin_x - bin_y) AS d FROM p1 c JOIN fx_norms b ON b.chrom = c.chr2 AND b.resolution = c.resolution AND b.bin = c.bin_y),
e1 AS MATERIALIZED (SELECT *, first_value(mean) OVER (PARTITION BY chrom, resolution ORDER BY d) AS mean1 FROM em),
px AS MATERIALIZED (SELECT c.chr1, c.chr2, c.bin_x, c.bin_y, c.counts, nx, ny, counts / (nx * ny) AS value, c.d, (c.counts + 1) / (m.mean + 1) AS oe,
  CASE WHEN m.sd_log > 0 THEN (ln(1 + c.counts) - m.mean_log) / m.sd_log END AS z, CASE WHEN mean1 <> m.mean THEN least(1, greatest(0, (c.counts - m.mean) / (mean1 - m.mean))) ELSE 0 END AS percent
  FROM p2 c JOIN e1 m ON m.chrom = c.chr1 AND m.resolution = c.resolution AND m.d = c.d)"""


def hits(where: str, res: int = RES, w: int = W, keys: str = "", source: str = "cm") -> str:
    """Window hits of distinct loops; tiles make the join an equality."""
    k = f"{keys}, " if keys else ""
    return f"""lp AS (SELECT DISTINCT {k}{C}, ((start1 + end1) // 2) // {res} - {w} AS x0, ((start2 + end2) // 2) // {res} - {w} AS y0 FROM fx_loops WHERE {where}),
lt AS (SELECT lp.*, unnest(range(CAST(floor(x0 / 256e0) AS BIGINT), CAST(floor((x0 + {2 * w}) / 256e0) AS BIGINT) + 1)) AS tx FROM lp), lu AS (SELECT lt.*, unnest(range(CAST(floor(y0 / 256e0) AS BIGINT), CAST(floor((y0 + {2 * w}) / 256e0) AS BIGINT) + 1)) AS ty FROM lt),
ct AS (SELECT *, bin_x // 256 AS tx, bin_y // 256 AS ty FROM {source} WHERE resolution = {res} AND counts > 0),
h AS (SELECT lu.* EXCLUDE (tx, ty), ct.* EXCLUDE (chr1, chr2, tx, ty, resolution), bin_x - x0 AS dx, bin_y - y0 AS dy FROM lu JOIN ct USING (chr1, chr2, tx, ty) WHERE bin_x BETWEEN x0 AND x0 + {2 * w} AND bin_y BETWEEN y0 AND y0 + {2 * w})"""


GRID = f"g AS (SELECT CAST(a.i AS BIGINT) AS dx, CAST(b.i AS BIGINT) AS dy FROM range(0, {SPAN}) a(i) CROSS JOIN range(0, {SPAN}) b(i))"
PILE = f"{CM}, {hits("list_id = 'A'")}, {GRID}, pile AS (SELECT g.dx, g.dy, CAST(coalesce(sum(h.counts), 0) AS BIGINT) AS total FROM g LEFT JOIN h USING (dx, dy) GROUP BY ALL)"


def pile(spark: SparkSession, d: str) -> DataFrame:
    return op.pile_up(_list(spark, d, "A"), contacts(spark, d), RES, W)


# --- expectation and normalization
@book.add(f"WITH {EX} SELECT chrom, resolution, d, n, round(mean, 6) AS mean, round(mean_log, 6) AS mean_log, round(sd_log, 6) AS sd_log FROM em")
def d12_expected(spark, d):
    return r6(op.expected(contacts(spark, d), view(spark, d, "fx_chroms")), "mean", "mean_log", "sd_log")


@book.add(f"WITH {PX} SELECT chr1, bin_x, bin_y, counts, round(value, 6) AS value, round(oe, 6) AS oe, round(z, 6) AS z, round(percent, 6) AS percent FROM px")
def s5_s9_normalized_pixels(spark, d):
    return r6(pixels(spark, d).select("chr1", "bin_x", "bin_y", "counts", "value", "oe", "z", "percent"), "value", "oe", "z", "percent")


@book.add("""SELECT norm, chrom, resolution, bin, round((ln(value) - avg(ln(value)) OVER w) / stddev_samp(ln(value)) OVER w, 6) AS z FROM fx_norms WHERE value >= 1e-20 WINDOW w AS (PARTITION BY norm, chrom, resolution)""")
def m13_norm_z(spark, d):
    return r6(op.norm_z(view(spark, d, "fx_norms")).select("norm", "chrom", "resolution", "bin", "z"), "z")


@book.add("""WITH nz AS (SELECT chrom, bin, (ln(value) - avg(ln(value)) OVER w) / stddev_samp(ln(value)) OVER w AS z FROM fx_norms WINDOW w AS (PARTITION BY norm, chrom, resolution)), la AS MATERIALIZED (SELECT l.loop_id, l.chr2, ((l.start2 + l.end2) // 2) // 5000 AS b2, a.z AS za FROM loops l JOIN nz a ON l.end1 - l.start1 = 5000 AND a.chrom = l.chr1 AND a.bin = ((l.start1 + l.end1) // 2) // 5000)
SELECT la.loop_id, round(za, 6) AS z1, round(b.z, 6) AS z2 FROM la JOIN nz b ON b.chrom = la.chr2 AND b.bin = la.b2 WHERE NOT ((za < -1 AND b.z < -1) OR za < -2 OR b.z < -2)""")
def f5_coverage(spark, d):
    from strandweave.session import table

    return r6(op.coverage_filter(table(spark, d, "loops"), op.norm_z(view(spark, d, "fx_norms"))).select("loop_id", "z1", "z2"), "z1", "z2")


@book.add(f"WITH {PX} SELECT chr1, bin_x, bin_y, counts FROM px WHERE counts > 1 AND nx >= 1 AND ny >= 1 AND d > 2 AND d < 2000 AND oe > 1.5 AND percent BETWEEN 0.005 AND 1")
def f14_extreme_pixels(spark, d):
    return op.extreme_pixels(pixels(spark, d), RES, most=1.0).select("chr1", "bin_x", "bin_y", "counts")


@book.add(f"""WITH {CM}, nz AS (SELECT chrom, bin, (ln(value) - avg(ln(value)) OVER w) / stddev_samp(ln(value)) OVER w AS z FROM fx_norms WINDOW w AS (PARTITION BY norm, chrom, resolution))
SELECT chr1, bin_x, bin_y, counts FROM (SELECT c.* FROM cm c JOIN nz a ON a.chrom = c.chr1 AND a.bin = c.bin_x AND a.z > -1 WHERE c.resolution = 5000 OFFSET 0) c JOIN nz b ON b.chrom = c.chr2 AND b.bin = c.bin_y AND b.z > -1""")
def f19_quality_mask(spark, d):
    return op.quality_mask(contacts(spark, d).filter(f"resolution = {RES}"), view(spark, d, "fx_norms")).select("chr1", "bin_x", "bin_y", "counts")


@book.add(f"""WITH {CM}, n AS (SELECT chrom, bin, CAST(sum(counts) AS BIGINT) AS value FROM (SELECT chr1 AS chrom, bin_x AS bin, counts FROM cm WHERE resolution = 5000 UNION ALL SELECT chr2, bin_y, counts FROM cm WHERE resolution = 5000 AND NOT (chr1 = chr2 AND bin_x = bin_y)) GROUP BY ALL) SELECT chrom, bin, value FROM n""")
def a18_local_vc(spark, d):
    return op.local_vc(contacts(spark, d), RES)


@book.add(f"WITH {CM}, t AS (SELECT chr1 AS chrom, CAST(sum(counts) AS BIGINT) AS contacts FROM cm WHERE resolution = 50000 GROUP BY chr1) SELECT chrom, contacts, CAST(floor(100000e0 * contacts / sum(contacts) OVER () + 0.5) AS BIGINT) AS reads FROM t")
def a19_proportional(spark, d):
    return op.proportional(contacts(spark, d).filter("resolution = 50000"), 100_000)


@book.add("""WITH n AS (SELECT 'f' || CAST(f.i AS STRING) AS file_id, chrom, bin, CASE WHEN (bin + f.i) % 7 = 0 THEN 0 ELSE value * (1 + f.i) END AS value FROM fx_norms CROSS JOIN range(0, 3) f(i)), ok AS (SELECT chrom, bin FROM n WHERE value > 0 GROUP BY ALL HAVING count(DISTINCT file_id) = 3)
SELECT file_id, chrom, bin, round(ln(value), 6) AS log_value FROM n SEMI JOIN ok USING (chrom, bin)""")
def a16_norm_matrix(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.lit(2)))
    n = view(spark, d, "fx_norms").withColumn("i", i).select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("file_id"), "chrom", "bin", F.when((F.col("bin") + F.col("i")) % 7 == 0, 0.0).otherwise(F.col("value") * (1 + F.col("i"))).alias("value"))
    return r6(op.norm_matrix(n, 3), "log_value")


# --- pile-ups
@book.add(f"WITH {PILE} SELECT dx, dy, total FROM pile")
def a5_apa_pileup(spark, d):
    return pile(spark, d)


@book.add(f"""WITH {CM}, {hits("list_id IN ('A', 'N', 'R')", keys="list_id")}, {GRID}, ls AS (SELECT DISTINCT list_id FROM fx_loops)
SELECT ls.list_id, g.dx, g.dy, CAST(coalesce(sum(h.counts), 0) AS BIGINT) AS total FROM ls CROSS JOIN g LEFT JOIN h ON h.list_id = ls.list_id AND h.dx = g.dx AND h.dy = g.dy GROUP BY ALL""")
def a5_apa_multi_list(spark, d):
    return op.pile_up(view(spark, d, "fx_loops"), contacts(spark, d), RES, W, ["list_id"])


def _factor(s: int, o: str) -> str:
    return f"f{o} AS (SELECT {o}, s / avg(s) OVER () AS f FROM (SELECT g.{o}, sum(n.value) AS s FROM lp JOIN (SELECT DISTINCT {o} FROM g) g ON true JOIN fx_norms n ON n.chrom = lp.chr{s} AND n.bin = lp.{'x0' if s == 1 else 'y0'} + g.{o} GROUP BY g.{o}))"


@book.add(f"WITH {PILE}, {_factor(1, 'dx')}, {_factor(2, 'dy')} SELECT dx, dy, total, round(CASE WHEN fdx.f * fdy.f > 0 THEN total / (fdx.f * fdy.f) ELSE 0 END, 3) AS value FROM pile JOIN fdx USING (dx) JOIN fdy USING (dy)")
def a5_apa_agnorm(spark, d):
    return op.pile_up_normalized(_list(spark, d, "A"), contacts(spark, d), view(spark, d, "fx_norms"), RES, W).withColumn("value", F.round("value", 3))


@book.add(f"""WITH {CM}, f AS (SELECT chrom, "start" AS s, "end" AS e, ("start" + "end") // 2 AS m FROM fx_anchors), p AS (SELECT a.chrom AS chr1, a.s AS start1, a.e AS end1, b.chrom AS chr2, b.s AS start2, b.e AS end2, b.m - a.m AS dist FROM f a JOIN f b ON a.chrom = b.chrom AND a.e < b.s AND b.m - a.m > 500000 AND b.m - a.m <= 4000000),
st AS (SELECT *, greatest(CAST(ceil(log2(dist / 1e6)) AS INT), 0) AS stratum, chr1 AS chrom FROM p),
sc AS (SELECT stratum, 'all' AS size_class, * EXCLUDE (stratum) FROM st UNION ALL SELECT stratum, CASE WHEN c.chr_index < 9 THEN 'big' ELSE 'small' END, st.* EXCLUDE (stratum) FROM st JOIN fx_chroms c USING (chrom) WHERE c.chr_index <> 9)
SELECT stratum, size_class, count(*) AS n, CAST(sum(dist) AS BIGINT) AS total_distance FROM sc GROUP BY ALL""")
def a6_flags_strata(spark, d):
    a = view(spark, d, "fx_anchors")
    pairs = op.size_classes(op.distance_strata(joins.pair_anchors(a, a, 500_000, 4_000_000), 3), view(spark, d, "fx_chroms"))
    return pairs.groupBy("stratum", "size_class").agg(F.count("*").alias("n"), F.sum(x.mid2() - x.mid1()).alias("total_distance"))


@book.add()
def a6_flags_pileup(spark, d):
    return op.flags_pile_up(view(spark, d, "fx_anchors"), reads(spark, d, RES), view(spark, d, "fx_inter"), view(spark, d, "fx_chroms"), RES, 100_000, W)


@book.add(f"""WITH {CM}, l AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 50000 AS cx, ((start2 + end2) // 2) // 50000 AS cy FROM fx_loops WHERE list_id = 'A'), o AS (SELECT * FROM l UNION SELECT chr1, chr2, cy, cx FROM l),
n AS (SELECT * FROM cm c SEMI JOIN o ON o.chr1 = c.chr1 AND o.chr2 = c.chr2 AND abs(bin_x - cx) + abs(bin_y - cy) < 3 WHERE resolution = 50000)
SELECT chrom, bin, CAST(sum(counts) AS BIGINT) AS total FROM (SELECT chr1 AS chrom, bin_x AS bin, counts FROM n UNION ALL SELECT chr2, bin_y, counts FROM n WHERE NOT (chr1 = chr2 AND bin_x = bin_y)) GROUP BY ALL""")
def a7_apa_1d(spark, d):
    return op.pile_up_1d(_list(spark, d, "A"), contacts(spark, d), 50_000, 3)


@book.add()
def a7_apa_1d_all(spark, d):
    return op.pile_up_1d(view(spark, d, "fx_loops"), contacts(spark, d), 50_000, 3)


def _strength(spark: SparkSession, d: str) -> DataFrame:
    return op.anchor_strength(pixels(spark, d))


ST = f"""{PX}, k AS (SELECT * FROM px WHERE percent > 0 AND (oe > 2 OR z > 1.28)), sa AS (SELECT direction, chrom, bin, CAST(sum(counts) AS BIGINT) AS counts, exp(sum(ln(oe))) AS oe, sum(percent) AS percent, sum(z) AS z, count(*) AS n FROM (
  SELECT 'forward' AS direction, chr1 AS chrom, bin_x AS bin, * FROM k UNION ALL SELECT 'reverse', chr2, bin_y, * FROM k) GROUP BY ALL)"""


@book.add(f"WITH {ST} SELECT direction, chrom, bin, counts, round(ln(oe), 6) AS log_oe, round(percent, 6) AS percent, round(z, 6) AS z, n FROM sa")
def a8_anchor_strength(spark, d):
    return r6(_strength(spark, d).select("direction", "chrom", "bin", "counts", F.ln("oe").alias("log_oe"), "percent", "z", "n"), "log_oe", "percent", "z")


@book.add(f"""WITH {ST}, md AS (SELECT direction, chrom, median(CASE WHEN ln(oe) > 0 THEN ln(oe) END) AS m FROM sa GROUP BY ALL)
SELECT direction, chrom, bin, round(z / n, 6) AS zscore, round(pow(oe, 1.0 / n) * n, 6) AS scaled_oe, round(CASE WHEN m > 0 THEN ln(oe) / m ELSE 0 END, 6) AS oe_log_median FROM sa JOIN md USING (direction, chrom)""")
def x1_vector_functions(spark, d):
    return r6(op.vector_functions(_strength(spark, d)).select("direction", "chrom", "bin", "zscore", "scaled_oe", "oe_log_median"), "zscore", "scaled_oe", "oe_log_median")


#: The whole of both: pixels pass the quality mask, and lie between 20 kb and 5 Mb.
_NZ = "nz AS MATERIALIZED (SELECT chrom, bin, (ln(value) - avg(ln(value)) OVER w) / stddev_samp(ln(value)) OVER w AS z FROM fx_norms WINDOW w AS (PARTITION BY norm, chrom, resolution))"
STW = f"""{PX}, {_NZ}, good AS MATERIALIZED (SELECT chrom, bin FROM nz WHERE z > -1),
k1 AS MATERIALIZED (SELECT * FROM px WHERE percent > 0 AND (oe > 2 OR z > 1.28) AND d > 4 AND d < 1000), k2 AS MATERIALIZED (SELECT k1.* FROM k1 SEMI JOIN good ON good.chrom = chr1 AND good.bin = bin_x), k AS MATERIALIZED (SELECT k2.* FROM k2 SEMI JOIN good ON good.chrom = chr2 AND good.bin = bin_y),
sa AS (SELECT direction, chrom, bin, CAST(sum(counts) AS BIGINT) AS counts, exp(sum(ln(oe))) AS oe, sum(percent) AS percent, sum(z) AS z, count(*) AS n FROM (SELECT 'forward' AS direction, chr1 AS chrom, bin_x AS bin, * FROM k UNION ALL SELECT 'reverse', chr2, bin_y, * FROM k) GROUP BY ALL)"""


def _strong_pixels(spark: SparkSession, d: str) -> DataFrame:
    return op.in_band(op.quality_mask(pixels(spark, d), view(spark, d, "fx_norms")), RES, 20_000, 5_000_000)


def _strength_whole(spark: SparkSession, d: str) -> DataFrame:
    return op.anchor_strength(_strong_pixels(spark, d))


@book.add(f"WITH {STW} SELECT direction, chrom, bin, counts, round(ln(oe), 6) AS log_oe, round(percent, 6) AS percent, round(z, 6) AS z, n FROM sa")
def a8_anchor_strength_whole(spark, d):
    return r6(_strength_whole(spark, d).select("direction", "chrom", "bin", "counts", F.ln("oe").alias("log_oe"), "percent", "z", "n"), "log_oe", "percent", "z")


@book.add(f"""WITH {STW}, md AS (SELECT direction, chrom, median(CASE WHEN ln(oe) > 0 THEN ln(oe) END) AS m FROM sa GROUP BY ALL)
SELECT direction, chrom, bin, round(z / n, 6) AS zscore, round(pow(oe, 1.0 / n) * n, 6) AS scaled_oe, round(CASE WHEN m > 0 THEN ln(oe) / m ELSE 0 END, 6) AS oe_log_median FROM sa JOIN md USING (direction, chrom)""")
def x1_vector_functions_whole(spark, d):
    return r6(op.vector_functions(_strength_whole(spark, d)).select("direction", "chrom", "bin", "zscore", "scaled_oe", "oe_log_median"), "zscore", "scaled_oe", "oe_log_median")


@book.add(f"""WITH {PX}, q AS (SELECT *, bin_x // 5 AS cx, bin_y // 5 AS cy FROM px), c AS (SELECT chr1, cx, cy, count(*) AS n, max(counts) AS mc, max(oe) AS mo, max(percent) AS mp, max(z) AS mz FROM q GROUP BY ALL),
t AS (SELECT chr1, cx + i AS cx, cy + j AS cy, sum(n) AS n, max(mc) AS mc, max(mo) AS mo, max(mp) AS mp, max(mz) AS mz FROM c CROSS JOIN (SELECT a.i, b.i AS j FROM range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(i)) GROUP BY ALL)
SELECT chr1, bin_x, bin_y, counts FROM q JOIN t USING (chr1, cx, cy) WHERE n > 5 AND (counts >= 0.95 * mc OR oe >= 0.95 * mo OR percent >= 0.95 * mp OR z >= 0.95 * mz)""")
def j_p9_anchor_strength_nms(spark, d):
    return op.strongest_in_cells(pixels(spark, d)).select("chr1", "bin_x", "bin_y", "counts")


@book.add(f"""WITH {hits("list_id = 'A'", res=50000, w=3, source="fx_contacts")} SELECT dx, dy, CAST(sum(counts) AS BIGINT) AS total FROM h GROUP BY ALL""")
def a9_enhance(spark, d):
    d_ = op.pile_up(_list(spark, d, "A"), contacts(spark, d, merged=False), 50_000, 3)
    return d_.filter("total > 0")


@book.add()
def a9_enhance_lists(spark, d):
    return op.pile_up(view(spark, d, "fx_loops"), contacts(spark, d, merged=False), 50_000, 3, ["list_id"]).filter("total > 0")


AP = f"{CM}, {hits('true')}, ap AS (SELECT 'upstream' AS side, chr1 AS chrom, x0 + {W} AS bin, dx, dy, counts FROM h UNION ALL SELECT 'downstream', chr2, y0 + {W}, dx, dy, counts FROM h), as_ AS (SELECT side, chrom, bin, dx, dy, sum(counts) AS v FROM ap GROUP BY ALL)"


@book.add(f"""WITH {AP} SELECT side, chrom, bin, round((coalesce(avg(v) FILTER (WHERE dx = {W} AND dy = {W}), 0) + 1) / (coalesce(avg(v) FILTER (WHERE dx > 15 AND dy < 5), 0) + 1), 6) AS score FROM as_ GROUP BY ALL""")
def a10_m6_anchor_apa_score(spark, d):
    return r6(op.anchor_scores(view(spark, d, "fx_loops"), reads(spark, d, RES), RES, W), "score")


@book.add(f"""WITH {CM}, {hits("list_id = 'A'", res=50000, w=2)} SELECT {C}, sum(counts * (dx * 5 + dy + 1)) AS checksum, sum(counts) AS total FROM h GROUP BY ALL""".replace("sum(counts * (dx * 5 + dy + 1))", "CAST(sum(counts * (dx * 5 + dy + 1)) AS DOUBLE)").replace("sum(counts) AS total FROM h", "CAST(sum(counts) AS DOUBLE) AS total FROM h"))
def a11_window_dump(spark, d):
    dump = op.window_dump(_list(spark, d, "A"), reads(spark, d, 50_000), 50_000, 2, COORDS)
    flat = F.flatten("matrix")
    add = lambda a, b: a + b
    return dump.select(*COORDS, F.aggregate(F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), add).alias("checksum"), F.aggregate(flat, F.lit(0.0), add).alias("total"))


@book.add()
def a11_window_dump_all(spark, d):
    return op.window_dump(view(spark, d, "fx_loops"), reads(spark, d, 50_000), 50_000, 2, COORDS)


STATS = """SELECT round(c / rest, 6) AS peak_to_mean, round(ur, 6) AS ur_mean, round(c / ul, 6) AS peak_to_ul, round(c / ur, 6) AS peak_to_ur, round(c / ll, 6) AS peak_to_ll, round(c / lr, 6) AS peak_to_lr, round((c - ll) / sd, 6) AS z_ll FROM (
  SELECT max(total) FILTER (WHERE dx = 10 AND dy = 10) AS c, avg(total) FILTER (WHERE NOT (dx = 10 AND dy = 10)) AS rest, avg(total) FILTER (WHERE dx < 5 AND dy > 15) AS ur, avg(total) FILTER (WHERE dx < 5 AND dy < 5) AS ul,
    avg(total) FILTER (WHERE dx > 15 AND dy < 5) AS ll, avg(total) FILTER (WHERE dx > 15 AND dy > 15) AS lr, stddev_samp(total) FILTER (WHERE dx > 15 AND dy < 5) AS sd FROM pile)"""


@book.add(f"WITH {PILE} {STATS}")
def m7_pileup_stats(spark, d):
    out = op.pile_up_statistics(pile(spark, d), W, 5)
    return r6(out, *out.columns)


@book.add(f"WITH {PILE} SELECT abs(dx - 10) + abs(dy - 10) AS d, round(avg(total), 6) AS mean FROM pile WHERE abs(dx - 10) + abs(dy - 10) < 10 GROUP BY 1")
def m8_manhattan_decay(spark, d):
    return r6(op.manhattan_decay(pile(spark, d), W), "mean")


@book.add(f"WITH {PILE}, dc AS (SELECT abs(dx - 10) + abs(dy - 10) AS d, avg(total) AS mean FROM pile WHERE abs(dx - 10) + abs(dy - 10) < 10 GROUP BY 1) SELECT round(exp(regr_intercept(ln(mean), d)), 4) AS amplitude, round(regr_slope(ln(mean), d), 6) AS slope FROM dc WHERE mean > 0")
def m9_decay_fit(spark, d):
    return op.decay_fit(op.manhattan_decay(pile(spark, d), W)).select(F.round("amplitude", 4).alias("amplitude"), F.round("slope", 6).alias("slope"))


@book.add(f"WITH {PILE}, rs AS (SELECT dx, CAST(sum(total) AS BIGINT) AS row_sum FROM pile GROUP BY dx) SELECT dx, row_sum, round(row_sum / sum(row_sum) OVER (), 6) AS row_pdf, round(row_sum / max(row_sum) OVER (), 6) AS row_relative FROM rs")
def a18_row_sums(spark, d):
    return r6(op.row_profile(pile(spark, d)), "row_pdf", "row_relative")


@book.add(f"WITH {PILE}, rs AS (SELECT dx, sum(total) AS row_sum FROM pile GROUP BY dx), rp AS (SELECT dx, row_sum / sum(row_sum) OVER () AS p FROM rs) SELECT round(stddev_samp(p), 6) AS amplitude, round(sqrt(sum((dx - 10) * (dx - 10) * p)), 6) AS spread FROM rp")
def m10_amplitude_spread(spark, d):
    return r6(op.amplitude_and_spread(op.row_profile(pile(spark, d)), W), "amplitude", "spread")


@book.add(f"""WITH {hits("true", res=50000, w=3, keys="list_id", source="fx_contacts")} SELECT list_id, experiment, {C}, CAST(sum(counts) AS BIGINT) AS total, CAST(coalesce(max(counts) FILTER (WHERE dx = 3 AND dy = 3), 0) AS BIGINT) AS centre, count(*) AS cells FROM h GROUP BY ALL""")
def a13_recap_stats(spark, d):
    hit = joins.window_pixels(view(spark, d, "fx_loops").select("list_id", *COORDS).distinct(), contacts(spark, d, merged=False), 50_000, 3)
    return hit.groupBy("list_id", "experiment", *COORDS).agg(F.sum("counts").alias("total"), F.coalesce(F.max(F.when((F.col("dx") == 3) & (F.col("dy") == 3), F.col("counts"))), F.lit(0)).alias("centre"), F.count("*").alias("cells"))


@book.add(f"""WITH {EX}, l AS (SELECT DISTINCT {C}, ((start1 + end1) // 2) // 5000 AS bx, ((start2 + end2) // 2) // 5000 AS byy FROM fx_loops),
lc AS MATERIALIZED (SELECT l.*, c.counts FROM l JOIN cm c ON c.resolution = 5000 AND c.chr1 = l.chr1 AND c.chr2 = l.chr2 AND c.bin_x = bx AND c.bin_y = byy), e1 AS MATERIALIZED (SELECT *, first_value(mean) OVER (PARTITION BY chrom, resolution ORDER BY d) AS mean1 FROM em)
SELECT {', '.join('l.' + c for c in COORDS)}, round(CASE WHEN mean1 <> m.mean THEN least(1, greatest(0, (l.counts - m.mean) / (mean1 - m.mean))) ELSE 0 END, 6) AS presence FROM lc l JOIN e1 m ON m.chrom = l.chr1 AND m.resolution = 5000 AND m.d = abs(bx - byy)""")
def m11_m18_presence(spark, d):
    l = view(spark, d, "fx_loops").select(*COORDS).distinct().withColumns({"bin_x": x.div(x.mid1(), RES), "bin_y": x.div(x.mid2(), RES)})
    c = op.against_expected(contacts(spark, d).filter(f"resolution = {RES}"), op.expected(contacts(spark, d), view(spark, d, "fx_chroms")))
    return l.join(c.select("chr1", "chr2", "bin_x", "bin_y", "percent"), ["chr1", "chr2", "bin_x", "bin_y"]).select(*COORDS, F.round("percent", 6).alias("presence"))


@book.add(f"""WITH {CM}, {hits("true", res=50000, w=4)}, s AS (SELECT {C}, sum(counts) FILTER (WHERE dx = 4 AND dy = 4) AS o, coalesce(sum(counts) FILTER (WHERE dx <> 4 AND dy <> 4), 0) AS s, coalesce(sum(counts * counts) FILTER (WHERE dx <> 4 AND dy <> 4), 0) AS q FROM h GROUP BY ALL),
n AS (SELECT l.*, coalesce(o, 0) AS oo, coalesce(s, 0) AS ss, coalesce(q, 0) AS qq, (4 + least(x0 + 4, 4)) * (4 + least(y0 + 4, 4)) AS n FROM lp l LEFT JOIN s USING ({C})),
v AS (SELECT *, ss / n AS mean, sqrt((qq - n * (ss / n) * (ss / n)) / (n - 1)) AS sd FROM n)
SELECT {C}, CAST(oo AS DOUBLE) AS observed, round(CASE WHEN sd > 0 THEN (oo - mean) / sd END, 6) AS local_z, round(CASE WHEN mean > 0 THEN oo / mean END, 6) AS local_oe FROM v""")
def m5_sieve_scores(spark, d):
    return r6(op.sieve_scores(view(spark, d, "fx_loops").select(*COORDS).distinct(), contacts(spark, d), 50_000, 4, COORDS), "local_z", "local_oe")


@book.add()
def m5_sieve_whole(spark, d):
    return op.sieve(view(spark, d, "fx_loops"), {r: reads(spark, d, r) for r in (RES, 50_000)}, view(spark, d, "fx_chroms"), [RES, 50_000], W)


@book.add()
def a13_recap_observed(spark, d):
    return op.recap(view(spark, d, "fx_loops"), reads(spark, d, RES), view(spark, d, "fx_chroms"), RES, W, ["list_id"])


@book.add("SELECT chr1, chr2, bin_x, bin_y, z FROM (SELECT *, round((ln(counts) - avg(ln(counts)) OVER w) / stddev_samp(ln(counts)) OVER w, 6) AS z FROM fx_inter WHERE counts > 0 WINDOW w AS (PARTITION BY chr1, chr2)) WHERE z > 2")
def m4_log_zscore(spark, d):
    return r6(op.log_z(view(spark, d, "fx_inter"), 2.0).select("chr1", "chr2", "bin_x", "bin_y", "z"), "z")


@book.add("""WITH k AS (SELECT * FROM (SELECT *, (ln(counts) - avg(ln(counts)) OVER w) / stddev_samp(ln(counts)) OVER w AS z FROM fx_inter WINDOW w AS (PARTITION BY chr1, chr2)) WHERE z > 1),
p AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.chr1 = a.chr1 AND b.chr2 = a.chr2 AND b.bin_x BETWEEN a.bin_x - 1 AND a.bin_x + 1 AND b.bin_y BETWEEN a.bin_y - 1 AND a.bin_y + 1 AND b.counts > a.counts))
SELECT chrom, bin, count(*) AS n FROM (SELECT chr1 AS chrom, bin_x AS bin FROM p UNION ALL SELECT chr2, bin_y FROM p) GROUP BY ALL""")
def a15_inter_peak_counts(spark, d):
    p = joins.not_below_neighbour(op.log_z(view(spark, d, "fx_inter"), 1.0))
    ends = F.array(F.struct(F.col("chr1").alias("chrom"), F.col("bin_x").alias("bin")), F.struct(F.col("chr2").alias("chrom"), F.col("bin_y").alias("bin")))
    return p.select(F.explode(ends).alias("e")).groupBy("e.chrom", "e.bin").agg(F.count("*").alias("n"))


def hot(spark: SparkSession, d: str) -> DataFrame:
    c = contacts(spark, d, merged=False).filter("resolution = 50000").withColumn("percent", F.least(F.col("counts") / F.lit(2000.0), F.lit(1.0)))
    return op.hotspots(c, 2)


@book.add("""WITH t AS (SELECT chr1, chr2, bin_x, bin_y, count(*) AS n, min(least(counts / 2000e0, 1)) AS low, max(least(counts / 2000e0, 1)) AS high, stddev_samp(least(counts / 2000e0, 1)) AS sd FROM fx_contacts WHERE resolution = 50000 GROUP BY ALL)
SELECT chr1, bin_x, bin_y, n, round(low, 6) AS low, round(high, 6) AS high, round(sd, 6) AS sd, CASE WHEN high - low > 0.05 AND low < 0.05 THEN 'candidate' WHEN high - low < 0.05 AND low > 0.05 THEN 'ubiquitous' ELSE 'other' END AS route FROM t WHERE high - low <= 0.35 AND n >= 2 AND high <= 0.35""")
def a14_hotspot_stats(spark, d):
    return r6(hot(spark, d).select("chr1", "bin_x", "bin_y", "n", "low", "high", "sd", "route"), "low", "high", "sd")


@book.add(f"""WITH {STW}, q AS (SELECT *, bin_x // 5 AS cx, bin_y // 5 AS cy FROM k), c AS (SELECT chr1, cx, cy, count(*) AS n, max(counts) AS mc, max(oe) AS mo, max(percent) AS mp, max(z) AS mz FROM q GROUP BY ALL),
t AS (SELECT chr1, cx + i AS cx, cy + j AS cy, sum(n) AS n, max(mc) AS mc, max(mo) AS mo, max(mp) AS mp, max(mz) AS mz FROM c CROSS JOIN (SELECT a.i, b.i AS j FROM range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(i)) GROUP BY ALL)
SELECT chr1, bin_x, bin_y, counts FROM q JOIN t USING (chr1, cx, cy) WHERE n > 5 AND (counts >= 0.95 * mc OR oe >= 0.95 * mo OR percent >= 0.95 * mp OR z >= 0.95 * mz)""")
def j_p9_anchor_strength_nms_whole(spark, d):
    return op.strongest_in_cells(op.standing_out(_strong_pixels(spark, d))).select("chr1", "bin_x", "bin_y", "counts")


#: The whole of it: percent contact against each experiment's own expectation, norms above 1 on both bins, 100 kb to 10 Mb.
@book.add(f"""WITH ed AS (SELECT experiment, chr1 AS chrom, resolution, abs(bin_x - bin_y) AS d, sum(counts) AS s FROM fx_contacts WHERE resolution = {RES} GROUP BY ALL),
em AS (SELECT experiment, chrom, d, s / greatest((c.length + resolution - 1) // resolution - d, 1) AS mean FROM ed JOIN fx_chroms c USING (chrom)), e1 AS MATERIALIZED (SELECT *, first_value(mean) OVER (PARTITION BY experiment, chrom ORDER BY d) AS mean1 FROM em),
n1 AS MATERIALIZED (SELECT chrom, bin FROM fx_norms WHERE value > 1), c1 AS MATERIALIZED (SELECT *, abs(bin_x - bin_y) AS d FROM fx_contacts c SEMI JOIN n1 ON n1.chrom = c.chr1 AND n1.bin = c.bin_x WHERE resolution = {RES} AND abs(bin_x - bin_y) > 20 AND abs(bin_x - bin_y) < 2000),
c2 AS MATERIALIZED (SELECT c1.* FROM c1 SEMI JOIN n1 ON n1.chrom = c1.chr2 AND n1.bin = c1.bin_y),
pc AS (SELECT c2.chr1, c2.chr2, bin_x, bin_y, CASE WHEN mean1 <> mean THEN least(1, greatest(0, (counts - mean) / (mean1 - mean))) ELSE 0 END AS p FROM c2 JOIN e1 ON e1.experiment = c2.experiment AND e1.chrom = c2.chr1 AND e1.d = c2.d),
t AS (SELECT chr1, chr2, bin_x, bin_y, count(*) AS n, min(p) AS low, max(p) AS high, stddev_samp(p) AS sd FROM pc GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY chr1) AS rest FROM t WHERE high - low <= 0.35 AND n >= 2 AND high <= 0.35)
SELECT chr1, bin_x, bin_y, n, round(low, 6) AS low, round(high, 6) AS high, round(sd, 6) AS sd, CASE WHEN high - low > 0.05 AND low < 0.05 THEN 'candidate' WHEN high - low < 0.05 AND low > 0.05 THEN 'ubiquitous' ELSE 'other' END AS route FROM k WHERE rest > 1""")
def a14_hotspot_whole(spark, d):
    c = contacts(spark, d, merged=False).filter(f"resolution = {RES}")
    norms = view(spark, d, "fx_norms").filter("value > 1")
    kept = op.in_band(c, RES, 100_000, 10_000_000)
    for s, b in ((1, "bin_x"), (2, "bin_y")):
        kept = kept.join(norms.select(F.col("chrom").alias(f"chr{s}"), F.col("bin").alias(b)), [f"chr{s}", b], "left_semi")
    p = op.against_expected(kept, op.expected(c, view(spark, d, "fx_chroms"), ["experiment"]), ["experiment"])
    return r6(op.hotspots(p, 2, lone=False).select("chr1", "bin_x", "bin_y", "n", "low", "high", "sd", "route"), "low", "high", "sd")


# --- arg-max pixels
def _max(name: str, source: str, res: int, normed: bool) -> str:
    value = "c.counts / (nx * b.value)" if normed else "CAST(c.counts AS DOUBLE)"
    first = f"n{name} AS MATERIALIZED (SELECT c.*, a.value AS nx FROM cm c JOIN fx_norms a ON a.chrom = c.chr1 AND a.bin = c.bin_x AND a.resolution = c.resolution WHERE c.resolution = {res}), " if normed else ""
    norm = "JOIN fx_norms b ON b.chrom = c.chr2 AND b.bin = c.bin_y AND b.resolution = c.resolution" if normed else ""
    ok = "AND nx * b.value > 0.5" if normed else ""
    return f"""{first}v{name} AS MATERIALIZED (SELECT c.chr1, c.chr2, c.bin_x, c.bin_y, {value} AS value FROM {'n' + name if normed else 'cm'} c {norm} WHERE c.resolution = {res} AND c.counts > 0 {ok}),
x{name} AS (SELECT l.{', l.'.join(COORDS)}, v.bin_x, v.bin_y, row_number() OVER (PARTITION BY l.{', l.'.join(COORDS)} ORDER BY value DESC, v.bin_x, v.bin_y) AS n FROM {source} l JOIN v{name} v ON v.chr1 = l.chr1 AND v.chr2 = l.chr2 AND value > 1
  AND v.bin_x >= l.start1 // {res} - 2 AND v.bin_x < l.end1 // {res} + 3 AND v.bin_y >= l.start2 // {res} - 2 AND v.bin_y < l.end2 // {res} + 3),
{name} AS (SELECT DISTINCT chr1, bin_x * {res} AS start1, bin_x * {res} + {res} AS end1, chr2, bin_y * {res} AS start2, bin_y * {res} + {res} AS end2 FROM x{name} WHERE n = 1)"""


@book.add(f"WITH {CM}, l AS (SELECT DISTINCT {C} FROM fx_loops WHERE list_id = 'A'), {_max('m', 'l', 5000, True)} SELECT * FROM m")
def t1_simple_max(spark, d):
    return op.max_pixel(features.distinct_features(_list(spark, d, "A")), contacts(spark, d), RES, view(spark, d, "fx_norms"))


@book.add(f"WITH {CM}, l AS (SELECT DISTINCT {C} FROM fx_loops WHERE list_id = 'A'), {_max('m', 'l', 50000, False)}, {_max('f', 'm', 5000, False)} SELECT * FROM f")
def t3_coarse_to_fine(spark, d):
    return op.coarse_to_fine(features.distinct_features(_list(spark, d, "A")), contacts(spark, d), [50_000, 5000])


@book.add()
def t1_simple_max_all(spark, d):
    return op.max_pixel(features.distinct_features(view(spark, d, "fx_loops")), contacts(spark, d), RES, view(spark, d, "fx_norms"))


@book.add()
def t3_coarse_to_fine_all(spark, d):
    return op.coarse_to_fine(features.distinct_features(view(spark, d, "fx_loops")), contacts(spark, d), [50_000, 5000])


@book.add("""WITH s AS (SELECT a.i, b.i AS j, (3 - abs(a.i) - abs(b.i)) / 3e0 AS k FROM range(-3, 4) a(i) CROSS JOIN range(-3, 4) b(i) WHERE abs(a.i) + abs(b.i) < 3)
SELECT chr1, chr2, bin_x + i AS bin_x, bin_y + j AS bin_y, round(sum(counts * k), 6) AS value FROM fx_inter CROSS JOIN s WHERE counts > 0 GROUP BY ALL""")
def j_p8_convolve2d(spark, d):
    return r6(op.convolve(view(spark, d, "fx_inter"), 3), "value")
