"""Queries of signals, kernels, graphs and sampling, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS
from strandweave.operators import features, graph, joins, kernels, sampling
from strandweave.operators import matrix as mx
from strandweave.operators import signals as op
from strandweave.plans.book import Book
from strandweave.plans.fixtures import reads, view
from strandweave.plans.joins import RASTER
from strandweave.plans.matrices import RES, contacts, hot, pixels, r6
from strandweave.session import table

book = Book()
C = ", ".join(COORDS)

TRACKS = """tr AS (SELECT track, chrom, bin, arg_max(value, line_no) AS value FROM (SELECT track, chrom, value, line_no, unnest(range("start" // 1000, "end" // 1000)) AS bin FROM fx_signal) GROUP BY ALL)"""
DENSE = f"""{TRACKS}, e AS (SELECT track, chrom, min(bin) AS a, max(bin) AS b FROM tr GROUP BY track, chrom), gr AS (SELECT track, chrom, unnest(range(a, b + 1)) AS bin FROM e), dn AS (SELECT track, chrom, bin, coalesce(value, 0) AS value FROM gr LEFT JOIN tr USING (track, chrom, bin))"""
KEYS = ["track", "chrom"]


def raster(spark: SparkSession, d: str) -> DataFrame:
    return op.raster(view(spark, d, "fx_signal").filter("track = 'click'"), 1000)


def dense(spark: SparkSession, d: str) -> DataFrame:
    return op.dense(tracks(spark, d), KEYS)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return op.raster(view(spark, d, "fx_signal"), 1000, KEYS)


# --- rasters, coverage, runs
@book.add(f"WITH {TRACKS} SELECT track, chrom, bin, round(value, 6) AS value FROM tr")
def s4_bedgraph_raster(spark, d):
    return r6(tracks(spark, d), "value")


@book.add(f"WITH {TRACKS} SELECT track, chrom, bin * 1000 AS \"start\", bin * 1000 + 1000 AS \"end\", round(value, 6) AS value FROM tr WHERE value > 0")
def k3_bedgraph_export(spark, d):
    from strandweave.sources.text import bedgraph_rows

    return r6(bedgraph_rows(tracks(spark, d), 1000, keys=["track"]), "value")


_COV = """cv AS (SELECT chrom, bin, count(*) AS n FROM (SELECT chrom, unnest(range("start" // 10, "end" // 10 + 1)) AS bin FROM fx_bed WHERE "end" - "start" < 400) GROUP BY ALL)"""


@book.add(f"WITH {_COV}, k AS (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS i FROM cv WHERE n >= 3) SELECT chrom, min(bin) * 10 AS \"start\", max(bin) * 10 + 10 AS \"end\", count(*) AS n_bins FROM k GROUP BY chrom, i")
def a4_w1_merge_bed(spark, d):
    return op.merged_coverage(view(spark, d, "fx_bed"))


@book.add("""WITH b AS (SELECT c.chrom, start1 AS s, end1 AS e FROM bed_files f JOIN chroms c ON regexp_replace(lower(trim(f.chrom)), '^chr', '') = regexp_replace(lower(c.chrom), '^chr', '') WHERE end1 >= start1 AND end1 - start1 < 400),
cv AS (SELECT chrom, bin, count(*) AS n FROM (SELECT chrom, unnest(range(s // 10, e // 10 + 1)) AS bin FROM b) GROUP BY ALL), k AS (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS i FROM cv WHERE n >= 2)
SELECT chrom, min(bin) * 10 AS "start", max(bin) * 10 + 10 AS "end", count(*) AS n_bins FROM k GROUP BY chrom, i""")
def a4_merge_bed_files(spark, d):
    from strandweave.operators.periods import chrom_key

    known = table(spark, d, "chroms").select(F.col("chrom").alias("known"), chrom_key(F.col("chrom")).alias("k"))
    bed = table(spark, d, "bed_files").withColumn("k", chrom_key(F.col("chrom"))).join(F.broadcast(known), "k").select(F.col("known").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"))
    return op.merged_coverage(bed, least=2)


@book.add(f"WITH {DENSE} SELECT track, chrom, bin, round(coalesce(0.055 * lag(value, 2) OVER w + 0.245 * lag(value) OVER w + 0.4 * value + 0.245 * lead(value) OVER w + 0.055 * lead(value, 2) OVER w, value), 6) AS smooth FROM dn WINDOW w AS (PARTITION BY track, chrom ORDER BY bin)")
def w3_smooth5(spark, d):
    return r6(op.smooth(dense(spark, d), keys=KEYS).select("track", "chrom", "bin", "smooth"), "smooth")


@book.add(f"WITH {DENSE} SELECT track, chrom, bin, round(coalesce(0.24 * lag(value) OVER w + 0.52 * value + 0.24 * lead(value) OVER w, value), 6) AS smooth FROM dn WINDOW w AS (PARTITION BY track, chrom ORDER BY bin)")
def w2_smooth3(spark, d):
    return r6(op.smooth(dense(spark, d), op.THREE_TAPS, keys=KEYS).select("track", "chrom", "bin", "smooth"), "smooth")


@book.add(f"WITH {DENSE}, q AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM dn WINDOW w AS (PARTITION BY track, chrom ORDER BY bin)) SELECT track, chrom, bin FROM q WHERE value > p AND value > n")
def w4_local_max(spark, d):
    return op.local_maxima(dense(spark, d), keys=KEYS).select("track", "chrom", "bin")


@book.add(f"WITH {DENSE}, q AS (SELECT *, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, lead(value) OVER w AS c, lead(value, 2) OVER w AS e2 FROM dn WINDOW w AS (PARTITION BY track, chrom ORDER BY bin)) SELECT track, chrom, bin FROM q WHERE a < b AND b < value AND value > c AND c > e2")
def w5_peak_shape(spark, d):
    return op.five_point_peaks(dense(spark, d), keys=KEYS).select("track", "chrom", "bin")


@book.add(f"WITH {TRACKS}, q AS (SELECT a.track, a.chrom, a.bin, a.value, max(b.value) AS top, arg_max(b.bin, (b.value, -b.bin)) AS top_bin FROM tr a JOIN tr b ON a.track = b.track AND a.chrom = b.chrom AND b.bin BETWEEN a.bin - 10 AND a.bin + 10 GROUP BY ALL) SELECT track, chrom, bin, CASE WHEN top > value THEN top_bin ELSE bin END AS best FROM q")
def w6_best_near(spark, d):
    return op.best_near(tracks(spark, d), 10, KEYS).select("track", "chrom", "bin", "best")


@book.add(f"""WITH {TRACKS}, m AS (SELECT track, chrom, bin, lead(bin) OVER (PARTITION BY track, chrom ORDER BY bin) AS nx FROM tr WHERE value > 50), f AS (SELECT track, chrom, bin FROM m UNION SELECT track, chrom, bin + 1 FROM m WHERE nx = bin + 2),
k AS (SELECT track, chrom, bin, bin - row_number() OVER (PARTITION BY track, chrom ORDER BY bin) AS i FROM f) SELECT track, chrom, min(bin) AS first, max(bin) + 1 AS stop FROM k GROUP BY track, chrom, i HAVING count(*) > 1""")
def w7_runs_gap_fill(spark, d):
    return op.runs_with_gap_fill(tracks(spark, d).filter("value > 50"), 1, keys=KEYS)


@book.add(f"WITH {TRACKS} SELECT track, chrom, bin, round(sum(value) OVER (PARTITION BY track, chrom ORDER BY bin) / sum(value) OVER (PARTITION BY track, chrom), 6) AS cdf FROM tr")
def w8_cdf(spark, d):
    return r6(op.cumulative(tracks(spark, d).withColumnRenamed("value", "weight"), ["bin"], KEYS).select("track", "chrom", "bin", "cdf"), "cdf")


@book.add("""WITH dc AS (SELECT chr1 AS chrom, abs(bin_x - bin_y) AS d, CAST(sum(counts) AS DOUBLE) AS value FROM fx_contacts WHERE resolution = 50000 GROUP BY ALL) SELECT chrom, d, round(quantile_cont(value, 0.5) OVER (PARTITION BY chrom ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS median FROM dc""")
def w9_rolling_median(spark, d):
    curve = contacts(spark, d, merged=False).filter("resolution = 50000").groupBy(F.col("chr1").alias("chrom"), F.abs(F.col("bin_x") - F.col("bin_y")).alias("d")).agg(F.sum("counts").cast("double").alias("value"))
    return r6(op.rolling_median(curve, 3, ["chrom"]).select("chrom", "d", "median"), "median")


@book.add('SELECT chrom, "start", "end", name FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY "start", name) AS n FROM fx_anchors) WHERE (n - 1) % 7 = 0')
def w11_stride(spark, d):
    return op.stride(view(spark, d, "fx_anchors"), 7, ["start", "name"], ["chrom"]).select("chrom", "start", "end", "name")


_VEC = "v AS (SELECT track, chrom, bin, CASE WHEN {expr} > 0 THEN {expr} ELSE 0 END AS v FROM tr), s AS (SELECT * FROM v WHERE abs(v) >= 1e-10), pr AS (SELECT a.track AS a, b.track AS b FROM (SELECT DISTINCT track FROM s) a JOIN (SELECT DISTINCT track FROM s) b ON a.track < b.track)"


def _similar(expr: str) -> str:
    vec = _VEC.format(expr=expr)
    return f"""WITH {TRACKS}, {vec},
j AS (SELECT pr.a, pr.b, k.chrom, k.bin, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y FROM pr JOIN (SELECT DISTINCT track, chrom, bin FROM s) k ON k.track IN (pr.a, pr.b) LEFT JOIN s x ON x.track = pr.a AND x.chrom = k.chrom AND x.bin = k.bin LEFT JOIN s y ON y.track = pr.b AND y.chrom = k.chrom AND y.bin = k.bin),
u AS (SELECT DISTINCT * FROM j)
SELECT a, b, round(corr(x, y), 6) AS pearson, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM u GROUP BY a, b HAVING sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) > 0"""


@book.add(_similar("value - 1"))
def m1_m2_similarity(spark, d):
    return r6(op.track_similarity(tracks(spark, d)), "pearson", "cosine")


@book.add(_similar("CASE WHEN value > 0 THEN ln(value) ELSE 0 END"))
def m1_m2_similarity_log(spark, d):
    return r6(op.track_similarity(tracks(spark, d), log=True), "pearson", "cosine")


@book.add(f"""WITH {RASTER}, q AS (SELECT *, lag(bin) OVER w AS pb, lead(bin) OVER w AS nb, lag(value) OVER w AS p, lead(value) OVER w AS n FROM r WINDOW w AS (PARTITION BY chrom ORDER BY bin)),
pk AS (SELECT chrom, bin FROM q WHERE value > 2 AND pb IS NOT NULL AND nb IS NOT NULL AND value > CASE WHEN pb = bin - 1 THEN p ELSE 0 END AND value > CASE WHEN nb = bin + 1 THEN n ELSE 0 END)
SELECT {C}, loop_key, CASE WHEN a.bin IS NOT NULL AND b.bin IS NOT NULL THEN 'good' ELSE 'bad' END AS route FROM fx_loops l LEFT JOIN pk a ON a.chrom = l.chr1 AND a.bin = ((start1 + end1) // 2) // 1000 LEFT JOIN pk b ON b.chrom = l.chr2 AND b.bin = ((start2 + end2) // 2) // 1000""")
def f10_signal_sieve(spark, d):
    return op.signal_sieve(view(spark, d, "fx_loops").select(*COORDS, "loop_key"), raster(spark, d))


@book.add("""WITH p AS (SELECT row_number() OVER () AS id, chrom, ("start" + "end") // 2 - 5000 AS g FROM fx_anchors) SELECT (s."start" - g) // 100 AS "offset", round(sum(value), 6) AS total, count(*) AS n FROM p JOIN fx_signal s ON s.chrom = p.chrom AND s.value > 0 AND s."start" >= g AND s."start" < g + 10100 GROUP BY 1""")
def a12_ata_profile(spark, d):
    return r6(op.profile(view(spark, d, "fx_anchors"), view(spark, d, "fx_signal"), 100, 50), "total")


@book.add("""SELECT chrom, bin, count(*) AS n FROM (SELECT chr1 AS chrom, local_x // 200 AS bin FROM loops WHERE local_x IS NOT NULL UNION ALL SELECT chr2, local_y // 200 FROM loops WHERE local_y IS NOT NULL) GROUP BY ALL""")
def a17_high_res_counts(spark, d):
    return kernels.high_res_counts(table(spark, d, "loops"), 200)


# --- anchors and networks
@book.add("""WITH q AS (SELECT DISTINCT chr1, chr2, local_x, local_y FROM loops WHERE local_x IS NOT NULL AND local_y IS NOT NULL), p AS (SELECT 'upstream' AS axis, chr1 AS chrom, local_x AS p, local_x // 200 AS bin FROM q UNION ALL SELECT 'downstream', chr2, local_y, local_y // 200 FROM q),
b AS (SELECT axis, chrom, bin, bin - row_number() OVER (PARTITION BY axis, chrom ORDER BY bin) AS i FROM (SELECT DISTINCT axis, chrom, bin FROM p)), s AS (SELECT axis, chrom, i, min(bin) AS fb, max(bin) + 1 AS sb, count(*) AS n, CAST(floor(avg(p)) AS BIGINT) AS mu, min(p) AS p FROM p JOIN b USING (axis, chrom, bin) GROUP BY ALL),
g AS (SELECT s.*, (SELECT sqrt(avg((p.p - s.mu) * (p.p - s.mu))) FROM p WHERE p.axis = s.axis AND p.chrom = s.chrom AND p.bin >= s.fb AND p.bin < s.sb) AS sigma FROM s WHERE n > 1),
l AS (SELECT s.* FROM s WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.axis = s.axis AND g.chrom = s.chrom AND abs(g.mu - s.p) < 500)),
w AS (SELECT axis, chrom, fb, sb, n, mu, sigma FROM g UNION ALL SELECT axis, chrom, fb, sb, 1, p, 500e0 FROM l)
SELECT axis, chrom, fb AS first_bin, sb AS stop_bin, n, mu, round(sigma, 6) AS sigma, CAST(floor(mu - 1.96 * sigma) AS BIGINT) AS low, CAST(floor(mu + 1.96 * sigma) AS BIGINT) AS high FROM w""")
def j_p3_anchorize(spark, d):
    return r6(kernels.anchorize(table(spark, d, "loops"), 200), "sigma")


@book.add("""WITH q AS (SELECT chr1, chr2, local_x, local_y FROM fx_loops), c AS (SELECT chrom, bin, CAST(count(*) AS DOUBLE) AS v FROM (SELECT chr1 AS chrom, local_x // 100 AS bin FROM q UNION ALL SELECT chr2, local_y // 100 FROM q) GROUP BY ALL),
k AS (SELECT * FROM (VALUES (-2, 0.055e0), (-1, 0.245e0), (0, 0.4e0), (1, 0.245e0), (2, 0.055e0)) t(o, w)), sm AS (SELECT chrom, bin + o AS bin, round(sum(v * w), 9) AS v FROM c CROSS JOIN k GROUP BY ALL),
pk AS (SELECT a.chrom, a.bin FROM sm a LEFT JOIN sm b ON b.chrom = a.chrom AND b.bin = a.bin - 1 LEFT JOIN sm e ON e.chrom = a.chrom AND e.bin = a.bin + 1 WHERE a.v > 1 AND a.v > coalesce(b.v, 0) AND a.v > coalesce(e.v, 0)),
st AS (SELECT DISTINCT chrom, pos FROM (SELECT chr1 AS chrom, local_x // 100 AS pos FROM q UNION SELECT chr2, local_y // 100 FROM q)),
ar AS (SELECT chrom, pos, unnest(range(greatest(pos - 10, 1), pos + 11)) AS bin FROM st), bs AS (SELECT ar.chrom, pos, ar.bin, row_number() OVER (PARTITION BY ar.chrom, pos ORDER BY coalesce(v, 0) DESC, CASE WHEN ar.bin = pos THEN 0 ELSE 1 END, ar.bin) AS n FROM ar LEFT JOIN sm USING (chrom, bin)),
ok AS (SELECT chrom, pos, bin FROM bs SEMI JOIN pk USING (chrom, bin) WHERE n = 1)
SELECT DISTINCT chr1, a.bin * 100 AS start1, a.bin * 100 + 100 AS end1, chr2, b.bin * 100 AS start2, b.bin * 100 + 100 AS end2 FROM q JOIN ok a ON a.chrom = chr1 AND a.pos = local_x // 100 JOIN ok b ON b.chrom = chr2 AND b.pos = local_y // 100""")
def j_p4_integrate(spark, d):
    return kernels.integrate(view(spark, d, "fx_loops"), 100, 10, bounds=False)


@book.add()
def j_p4_integrate_bounds(spark, d):
    return kernels.integrate(table(spark, d, "loops"), 100, 10)


NET = """np AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 2000 AS b1, ((start2 + end2) // 2) // 2000 AS b2 FROM loops),
n1 AS (SELECT chr1, b1, bin0 FROM (SELECT chr1, b1, min(b1) OVER (PARTITION BY chr1, i) AS bin0 FROM (SELECT chr1, b1, b1 - row_number() OVER (PARTITION BY chr1 ORDER BY b1) AS i FROM (SELECT DISTINCT chr1, b1 FROM np)))),
n2 AS (SELECT chr2, b2, bin0 FROM (SELECT chr2, b2, min(b2) OVER (PARTITION BY chr2, i) AS bin0 FROM (SELECT chr2, b2, b2 - row_number() OVER (PARTITION BY chr2 ORDER BY b2) AS i FROM (SELECT DISTINCT chr2, b2 FROM np)))),
m1 AS (SELECT chr1, bin0, max(b1) + 1 AS stop FROM n1 GROUP BY ALL), m2 AS (SELECT chr2, bin0, max(b2) + 1 AS stop FROM n2 GROUP BY ALL),
ne AS (SELECT DISTINCT chr1, m1.bin0 * 2000 AS up_start, m1.stop * 2000 AS up_end, chr2, m2.bin0 * 2000 AS down_start, m2.stop * 2000 AS down_end FROM np JOIN n1 USING (chr1, b1) JOIN n2 USING (chr2, b2) JOIN m1 ON m1.chr1 = np.chr1 AND m1.bin0 = n1.bin0 JOIN m2 ON m2.chr2 = np.chr2 AND m2.bin0 = n2.bin0)"""
NET = NET.replace("SELECT DISTINCT chr1, m1.bin0", "SELECT DISTINCT np.chr1, m1.bin0").replace("m1.stop * 2000 AS up_end, chr2,", "m1.stop * 2000 AS up_end, np.chr2,")


def net(spark: SparkSession, d: str) -> DataFrame:
    return graph.network(table(spark, d, "loops"), 2000)


@book.add(f"WITH {NET} SELECT * FROM ne")
def g1_network(spark, d):
    return net(spark, d)


@book.add(f"""WITH {NET}, wk AS (SELECT DISTINCT a.chr1, a.up_start, a.up_end, z.chr2, z.down_start, z.down_end FROM ne a JOIN ne m ON m.chr2 = a.chr2 AND m.down_start = a.down_start AND m.down_end = a.down_end JOIN ne z ON z.chr1 = m.chr1 AND z.up_start = m.up_start AND z.up_end = m.up_end),
q AS (SELECT chr1, chr2, up_start - 2000 AS a, up_end + 2000 AS b, down_start - 2000 AS c, down_end + 2000 AS e FROM wk)
SELECT DISTINCT chr1, CASE WHEN chr1 = chr2 AND c < a THEN c ELSE a END AS start1, CASE WHEN chr1 = chr2 AND c < a THEN e ELSE b END AS end1, chr2, CASE WHEN chr1 = chr2 AND c < a THEN a ELSE c END AS start2, CASE WHEN chr1 = chr2 AND c < a THEN b ELSE e END AS end2 FROM q""")
def g2_rescue(spark, d):
    return graph.rescue(net(spark, d), 2000)


@book.add(f"""WITH RECURSIVE {NET}, ed AS (SELECT 'u_' || chr1 || '_' || CAST(up_start AS STRING) AS src, 'd_' || chr2 || '_' || CAST(down_start AS STRING) AS dst FROM ne), eb AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
reach AS (SELECT DISTINCT src AS node, src AS seen FROM eb UNION SELECT reach.node, eb.dst FROM reach JOIN eb ON eb.src = reach.seen) SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def g3_components(spark, d):
    key = lambda p, c, s: F.concat_ws("_", F.lit(p), c, s)
    return graph.components(net(spark, d).select(key("u", "chr1", "up_start").alias("src"), key("d", "chr2", "down_start").alias("dst")))


# --- greedy kernels: checked against plain versions in the tests
@book.add()
def u4_fuse_bbox(spark, d):
    return kernels.fuse(table(spark, d, "loops"))


@book.add()
def u5_fuse_nms(spark, d):
    return kernels.fuse(table(spark, d, "loops"), suppress=True)


@book.add()
def j_p1_centroid_collapse(spark, d):
    return kernels.collapse_centroids(contacts(spark, d).filter("resolution = 50000"), 2)


@book.add()
def j_p2_hotspot_nms(spark, d):
    return kernels.suppress_near(hot(spark, d), 6)


@book.add()
def j_p6_multires_collapse(spark, d):
    return kernels.collapse_resolutions(contacts(spark, d).filter("counts >= 40"))


@book.add()
def j_p7_pinpoint(spark, d):
    return kernels.pinpoint_in_tiles(view(spark, d, "fx_loops"), reads(spark, d, RES), RES, 16, coarse=4)


@book.add()
def j_p10_stripes(spark, d):
    good = mx.quality_mask(pixels(spark, d), view(spark, d, "fx_norms"), neighbours=True)
    return kernels.stripes(good.select("chr1", "chr2", "bin_x", "bin_y", "counts", "oe", "z"), RES)


@book.add()
def j_p11_stripe_localize(spark, d):
    loops = features.size_filter(view(spark, d, "fx_loops"), 100, 5)
    return kernels.localize_stripes(mx.window_cells(loops, reads(spark, d, RES), RES, 15, COORDS), COORDS, 15, 2)


@book.add()
def m15_t_tests(spark, d):
    side = F.when(F.col("experiment") == "F", "a").otherwise("b")
    samples = contacts(spark, d, merged=False).filter("resolution = 50000").select("chr1", "bin_x", side.alias("side"), F.col("counts").cast("double").alias("value"))
    return kernels.t_tests(samples, ["chr1", "bin_x"])


@book.add()
def r1_seer(spark, d):
    return sampling.sample_reads(contacts(spark, d), 50_000, 100_000, RES)


@book.add("""WITH t AS (SELECT chr1, bin_x, counts FROM fx_contacts WHERE resolution = 50000) SELECT chr1, bin_x, count(*) AS n, round(exp(avg(ln(counts)) FILTER (WHERE counts > 1)), 6) AS geo_mean, round(quantile_cont(counts, 0.9) FILTER (WHERE counts > 1), 6) AS p90, round(median(counts), 6) AS median FROM t GROUP BY ALL""")
def m14_m16_percentiles(spark, d):
    above = F.when(F.col("counts") > 1, F.col("counts").cast("double"))
    return contacts(spark, d, merged=False).filter("resolution = 50000").groupBy("chr1", "bin_x").agg(
        F.count("*").alias("n"), F.round(F.exp(F.avg(F.ln(above))), 6).alias("geo_mean"), F.round(F.percentile(above, 0.9), 6).alias("p90"), F.round(F.median("counts"), 6).alias("median"))


@book.add("SELECT chr1, bin_x, bin_y, round(percent_rank() OVER (PARTITION BY chr1 ORDER BY counts), 6) AS rank FROM fx_inter")
def m17_rank_percentile(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "fx_inter").select("chr1", "bin_x", "bin_y", F.round(F.percent_rank().over(Window.partitionBy("chr1").orderBy("counts")), 6).alias("rank"))


@book.add("""WITH dc AS (SELECT chr1 AS chrom, abs(bin_x - bin_y) AS d, CAST(sum(counts) AS DOUBLE) AS value FROM fx_contacts WHERE resolution = 50000 GROUP BY ALL), md AS (SELECT chrom, d, quantile_cont(value, 0.5) OVER (PARTITION BY chrom ORDER BY d ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS median FROM dc),
lp AS (SELECT DISTINCT list_id, chr1, abs(((start1 + end1) // 2) // 50000 - ((start2 + end2) // 2) // 50000) AS d FROM fx_loops) SELECT list_id, chr1, lp.d, round(value / median, 6) AS enrichment FROM lp JOIN md ON md.chrom = lp.chr1 AND md.d = lp.d JOIN dc ON dc.chrom = lp.chr1 AND dc.d = lp.d WHERE median > 0""")
def m12_rolling_enrichment(spark, d):
    curve = contacts(spark, d, merged=False).filter("resolution = 50000").groupBy(F.col("chr1"), F.abs(F.col("bin_x") - F.col("bin_y")).alias("d")).agg(F.sum("counts").cast("double").alias("value"))
    smooth = op.rolling_median(curve, 10, ["chr1"]).filter("median > 0")
    at = F.abs(x.div(x.mid1(), 50_000) - x.div(x.mid2(), 50_000))
    return view(spark, d, "fx_loops").select("list_id", "chr1", at.alias("d")).distinct().join(smooth, ["chr1", "d"]).select("list_id", "chr1", "d", F.round(F.col("value") / F.col("median"), 6).alias("enrichment"))


@book.add("""WITH t AS (SELECT experiment, chr1 AS chrom, resolution, abs(bin_x - bin_y) AS d, count(*) AS n FROM fx_contacts GROUP BY ALL)
SELECT experiment, chrom, resolution, d, n, round(n / ((length + resolution - 1) // resolution - d)::DOUBLE, 6) AS share FROM t JOIN fx_chroms USING (chrom)""")
def m19_share_of_cells(spark, d):
    return r6(mx.share_of_cells(contacts(spark, d, merged=False), view(spark, d, "fx_chroms"), ["experiment"]), "share")


@book.add("""WITH t AS (SELECT chr1, bin_x // 20 AS tx, bin_y // 20 AS ty, bin_x, bin_y, counts, row_number() OVER (PARTITION BY chr1, chr2, bin_x // 20, bin_y // 20 ORDER BY counts DESC, bin_x, bin_y) AS n FROM fx_inter) SELECT chr1, tx, ty, bin_x, bin_y, counts FROM t WHERE n = 1""")
def g4_tile_max(spark, d):
    t = view(spark, d, "fx_inter").withColumns({"tx": x.div("bin_x", 20), "ty": x.div("bin_y", 20)})
    return joins.first_of(t, ["chr1", "chr2", "tx", "ty"], [F.desc("counts"), F.col("bin_x"), F.col("bin_y")]).select("chr1", "tx", "ty", "bin_x", "bin_y", "counts")
