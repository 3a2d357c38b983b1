"""Queries of interval, nearest, band and pixel joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.scalars import COORDS
from strandweave.operators import features, signals
from strandweave.operators import joins as op
from strandweave.operators.matrix import window_sums
from strandweave.plans.book import Book
from strandweave.plans.fixtures import reads, view
from strandweave.session import table

book = Book()
C = ", ".join(COORDS)
AC, BC = (", ".join(f"{t}.{c}" for c in COORDS) for t in "ab")
SAME = " AND ".join(f"a.{c} = b.{c}" for c in COORDS)


def _list(spark: SparkSession, d: str, ids: str) -> DataFrame:
    return view(spark, d, "fx_loops").filter(F.col("list_id").isin(*ids))


def _near(w: int) -> str:
    return f"a.chr1 = b.chr1 AND a.chr2 = b.chr2 AND a.start1 - {w} < b.end1 AND b.start1 < a.end1 + {w} AND a.start2 - {w} < b.end2 AND b.start2 < a.end2 + {w}"


_A = f"a AS (SELECT DISTINCT {C} FROM fx_loops WHERE list_id = 'A')"
_R = f"b AS (SELECT DISTINCT {C} FROM fx_loops WHERE list_id = 'R')"


@book.add(f"SELECT {AC}, a.loop_key FROM fx_loops a WHERE a.list_id = 'A' AND EXISTS (SELECT 1 FROM fx_loops b WHERE b.list_id = 'R' AND {SAME})")
def j1_retain_exact(spark, d):
    return op.exact_semi(_list(spark, d, "A"), _list(spark, d, "R")).select(*COORDS, "loop_key")


@book.add(f"SELECT {C} FROM fx_loops WHERE list_id = 'A' INTERSECT SELECT {C} FROM fx_loops WHERE list_id = 'R'")
def j3_intersect_exact(spark, d):
    return op.exact_semi(features.distinct_features(_list(spark, d, "A")), _list(spark, d, "R"))


@book.add(f"SELECT {C} FROM fx_loops WHERE list_id = 'A' EXCEPT SELECT {C} FROM fx_loops WHERE list_id = 'R'")
def j3_subtract_exact(spark, d):
    return op.exact_anti(features.distinct_features(_list(spark, d, "A")), _list(spark, d, "R"))


@book.add(f"WITH {_A}, {_R} SELECT DISTINCT {AC} FROM a JOIN b ON {_near(0)}")
def j2_intersect_overlap(spark, d):
    return op.overlap_semi(_list(spark, d, "A"), _list(spark, d, "R"))


@book.add(f"WITH {_A}, {_R} SELECT {C} FROM a EXCEPT SELECT DISTINCT {AC} FROM a JOIN b ON {_near(0)}")
def j2_subtract_overlap(spark, d):
    return op.overlap_anti(_list(spark, d, "A"), _list(spark, d, "R"))


@book.add(f"WITH {_A}, {_R} SELECT DISTINCT {AC} FROM a JOIN b ON {_near(5000)}")
def j2_intersect_window(spark, d):
    return op.overlap_semi(_list(spark, d, "A"), _list(spark, d, "R"), window=5000)


@book.add(f"""WITH {_A}, {_R} SELECT {AC}, least(a.start1, min(b.start1)) AS box_start1, greatest(a.end1, max(b.end1)) AS box_end1, least(a.start2, min(b.start2)) AS box_start2, greatest(a.end2, max(b.end2)) AS box_end2, count(*) AS n_matches
FROM a JOIN b ON {_near(1000)} GROUP BY {AC}""")
def j2b_bounding_box(spark, d):
    return op.bounding_boxes(_list(spark, d, "A"), _list(spark, d, "R"), window=1000)


def _taken(s: int) -> str:
    low = f"greatest(CAST(trunc((start{s} - 2000) / 100e0) AS BIGINT), 0)"
    return f"t{s} AS (SELECT DISTINCT chr{s} AS chrom, unnest(range({low}, greatest((end{s} + 2000) // 100, {low} + 1))) AS bin FROM loops WHERE resolution > 2000 AND chr1 = chr2)"


@book.add(f"""WITH a AS (SELECT DISTINCT {C} FROM loops WHERE resolution <= 2000 AND chr1 = chr2), {_taken(1)}, {_taken(2)}, p AS (SELECT {C}, unnest(range(start1 // 100, end1 // 100)) AS bin, chr1 AS chrom FROM a), q AS (SELECT {C}, unnest(range(start2 // 100, end2 // 100)) AS bin, chr2 AS chrom FROM a)
SELECT {C} FROM a EXCEPT (SELECT {C} FROM p JOIN t1 USING (chrom, bin) UNION SELECT {C} FROM q JOIN t2 USING (chrom, bin))""")
def j4_subtract_shared_anchors(spark, d):
    loops = table(spark, d, "loops")
    return op.without_shared_anchors(loops.filter("resolution <= 2000"), loops.filter("resolution > 2000"), window=2000)


@book.add(f"""WITH k AS (SELECT DISTINCT chr1, chr2, chr1 AS chrom, ((start1 + end1) // 2) // 5000 AS bin FROM fx_loops WHERE list_id = 'R' UNION SELECT DISTINCT chr1, chr2, chr2, ((start2 + end2) // 2) // 5000 FROM fx_loops WHERE list_id = 'R')
SELECT {C}, loop_key, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.chr1 = a.chr1 AND k.chr2 = a.chr2 AND k.chrom = a.chr1 AND k.bin = ((a.start1 + a.end1) // 2) // 5000) AND EXISTS (SELECT 1 FROM k WHERE k.chr1 = a.chr1 AND k.chr2 = a.chr2 AND k.chrom = a.chr2 AND k.bin = ((a.start2 + a.end2) // 2) // 5000)
  THEN 'removed' ELSE 'kept' END AS route FROM fx_loops a WHERE list_id = 'A'""")
def j5_subtract_by_anchor(spark, d):
    return op.anchor_overlap_route(_list(spark, d, "A").select(*COORDS, "loop_key"), _list(spark, d, "R"))


def _snap(s: int) -> str:
    return f"""n{s} AS (SELECT {C}, s, e, m FROM (SELECT l.*, q.*, row_number() OVER (PARTITION BY {C} ORDER BY abs((start{s} + end{s}) // 2 - m), s, e) AS n FROM l JOIN q ON q.chrom = l.chr{s} AND abs(((start{s} + end{s}) // 2) // 1000 - m // 1000) <= 1) WHERE n = 1)"""


@book.add(f"""WITH l AS (SELECT DISTINCT {C} FROM fx_loops), q AS (SELECT DISTINCT chrom, "start" AS s, "end" AS e, ("start" + "end") // 2 AS m FROM fx_anchors), {_snap(1)}, {_snap(2)}
SELECT DISTINCT chr1, n1.s AS start1, n1.e AS end1, chr2, n2.s AS start2, n2.e AS end2, n1.m AS local_x, n2.m AS local_y FROM n1 JOIN n2 USING ({C})""")
def j6_nearest_anchor(spark, d):
    return op.nearest_anchors(view(spark, d, "fx_loops"), view(spark, d, "fx_anchors"))


@book.add(f"""WITH l AS (SELECT DISTINCT {C} FROM fx_loops WHERE list_id = 'A') SELECT {C}, q."start" AS anchor_start, q."end" AS anchor_end FROM l JOIN fx_anchors q ON q.chrom = l.chr1 AND (q."start" + q."end") // 2 >= start1 AND q."end" < end1""")
def j6b_contained_anchors(spark, d):
    return op.contained_anchors(features.distinct_features(_list(spark, d, "A")), view(spark, d, "fx_anchors"))


@book.add(f"""WITH l AS (SELECT DISTINCT {C} FROM fx_loops) SELECT {C}, q."start" AS anchor_start, q."end" AS anchor_end FROM l JOIN fx_anchors q ON q.chrom = l.chr1 AND (q."start" + q."end") // 2 >= start1 AND q."end" < end1""")
def j6b_contained_anchors_all(spark, d):
    return op.contained_anchors(features.distinct_features(view(spark, d, "fx_loops")), view(spark, d, "fx_anchors"))


def _motif(permissive: bool) -> str:
    def side(s: int) -> str:
        return f"""m{s} AS (SELECT * FROM (SELECT l.*, q.s AS s{s}, q.e AS e{s}, q.m AS m{s}, row_number() OVER (PARTITION BY {C} ORDER BY abs((start{s} + end{s}) // 2 - m), s, e) AS n, count(*) OVER (PARTITION BY {C}) AS c
          FROM l JOIN q ON q.chrom = l.chr{s} AND abs((start{s} + end{s}) // 2 - m) < 1500) WHERE n = 1{'' if permissive else ' AND c = 1'})"""

    return f"""WITH l AS (SELECT DISTINCT {C} FROM fx_loops), q AS (SELECT DISTINCT chrom, "start" AS s, "end" AS e, ("start" + "end") // 2 AS m FROM fx_anchors), {side(1)}, {side(2)}
SELECT {C}, s1 AS motif_start_1, e1 AS motif_end_1, m1.m1 AS motif_mid_1, s2 AS motif_start_2, e2 AS motif_end_2, m2.m2 AS motif_mid_2 FROM m1 JOIN m2 USING ({C})"""


@book.add(_motif(False))
def j7_motif_unique(spark, d):
    return op.assign_motifs(features.distinct_features(view(spark, d, "fx_loops")), view(spark, d, "fx_anchors"), window=1500)


@book.add(_motif(True))
def j7_motif_permissive(spark, d):
    return op.assign_motifs(features.distinct_features(view(spark, d, "fx_loops")), view(spark, d, "fx_anchors"), window=1500, permissive=True)


#: A track rasterised at 1 kb, the last line winning.
RASTER = """r AS (SELECT chrom, bin, arg_max(value, line_no) AS value FROM (SELECT chrom, value, line_no, unnest(range("start" // 1000, "end" // 1000)) AS bin FROM fx_signal WHERE track = 'click') GROUP BY ALL)"""


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return signals.raster(view(spark, d, "fx_signal").filter("track = 'click'"), 1000)


@book.add(f"""WITH {RASTER} SELECT a.chrom, a."start", a."end", a.name, round(coalesce(r.value, 0), 6) AS value FROM fx_anchors a LEFT JOIN r ON r.chrom = a.chrom AND r.bin = ((a."start" + a."end") // 2) // 1000""")
def j8_signal_lookup(spark, d):
    return op.signal_at(view(spark, d, "fx_anchors"), _raster(spark, d), 1000).select("chrom", "start", "end", "name", F.round("value", 6).alias("value"))


def _side(word: str, n: int) -> str:
    return f"""s{n} AS (SELECT chrom, bin, score AS v{n} FROM (SELECT chrom, "end" // 1000 AS bin, score, row_number() OVER (PARTITION BY chrom, "end" // 1000 ORDER BY "start" DESC, "end" DESC, name DESC) AS n FROM fx_anchors WHERE contains(lower(name), '{word}')) WHERE n = 1)"""


@book.add(f"""WITH {_side('forward', 1)}, {_side('reverse', 2)}
SELECT {C}, loop_key, CASE WHEN v1 > 1.1 AND v2 > 1.1 THEN 'pass' WHEN v1 < 1 OR v2 < 1 THEN 'fail' ELSE 'open' END AS route FROM fx_loops l JOIN s1 ON s1.chrom = l.chr1 AND s1.bin = l.end1 // 1000 JOIN s2 ON s2.chrom = l.chr2 AND s2.bin = l.end2 // 1000""")
def j9_anchor_score_route(spark, d):
    return features.anchor_score_route(view(spark, d, "fx_loops"), view(spark, d, "fx_anchors")).select(*COORDS, "loop_key", "route")


def _oriented(spark: SparkSession, d: str, word: str) -> DataFrame:
    return view(spark, d, "fx_anchors").filter(F.lower("name").contains(word))


@book.add("""SELECT f.chrom AS chr1, f."start" AS start1, f."end" AS end1, r.chrom AS chr2, r."start" AS start2, r."end" AS end2 FROM fx_anchors f JOIN fx_anchors r ON f.chrom = r.chrom
WHERE f.name LIKE 'Forward%' AND r.name LIKE 'Reverse%' AND f."end" < r."start" AND (r."start" + r."end") // 2 - (f."start" + f."end") // 2 > 20000 AND (r."start" + r."end") // 2 - (f."start" + f."end") // 2 <= 300000""")
def j10_anchor_pairs_intra(spark, d):
    return op.pair_anchors(_oriented(spark, d, "forward"), _oriented(spark, d, "reverse"), 20_000, 300_000)


@book.add("""SELECT f.chrom AS chr1, f."start" AS start1, f."end" AS end1, r.chrom AS chr2, r."start" AS start2, r."end" AS end2 FROM fx_anchors f JOIN fx_chroms i ON i.chrom = f.chrom JOIN fx_chroms j ON i.chr_index < j.chr_index JOIN fx_anchors r ON r.chrom = j.chrom
WHERE f.name LIKE 'Forward%' AND r.name LIKE 'Reverse%' AND f.score >= 1.8 AND r.score >= 1.8""")
def j11_anchor_pairs_inter(spark, d):
    high = lambda w: _oriented(spark, d, w).filter("score >= 1.8")
    return op.pair_anchors_between(high("forward"), high("reverse"), view(spark, d, "fx_chroms"))


@book.add()
def j11_anchor_pairs_inter_all(spark, d):
    return op.pair_anchors_between(_oriented(spark, d, "forward"), _oriented(spark, d, "reverse"), view(spark, d, "fx_chroms"))


@book.add("""WITH a AS (SELECT i.chrom AS chr1, j.chrom AS chr2 FROM fx_chroms i JOIN fx_chroms j ON i.chr_index < j.chr_index WHERE i.is_autosome AND j.is_autosome),
t AS (SELECT chr1, chr2, min(counts) AS tenth FROM (SELECT *, row_number() OVER (PARTITION BY chr1, chr2 ORDER BY counts DESC, bin_x, bin_y) AS n FROM fx_inter SEMI JOIN a USING (chr1, chr2)) WHERE n <= 10 GROUP BY ALL),
g AS (SELECT avg(counts) AS m, stddev_samp(counts) AS s FROM fx_inter SEMI JOIN a USING (chr1, chr2))
SELECT chr1, chr2, tenth, coalesce((tenth - m) / s > 2.5, true) AS flagged FROM a LEFT JOIN t USING (chr1, chr2) CROSS JOIN g""")
def t2_translocation_top10(spark, d):
    from strandweave.operators.matrix import translocations

    return translocations(view(spark, d, "fx_inter"), view(spark, d, "fx_chroms"), z=2.5)


@book.add("SELECT chr1, chr2, resolution, bin_x, bin_y, counts FROM fx_inter WHERE NOT ((chr1 = 'chr1' AND chr2 = 'chr2') OR (chr1 = 'chr3' AND chr2 = 'chr4'))")
def j13_skip_translocations(spark, d):
    pairs = spark.createDataFrame([("chr2", "chr1"), ("chr3", "chr4")], "chr1 string, chr2 string")
    return op.unordered_anti(view(spark, d, "fx_inter"), pairs)


@book.add(f"""WITH l AS (SELECT DISTINCT {C}, ((start1 + end1) // 2) // 50000 - 3 AS x0, ((start2 + end2) // 2) // 50000 - 3 AS y0 FROM fx_loops WHERE list_id = 'A')
SELECT {C}, bin_x - x0 AS dx, bin_y - y0 AS dy, CAST(sum(counts) AS BIGINT) AS counts FROM l JOIN fx_contacts c ON c.resolution = 50000 AND c.chr1 = l.chr1 AND c.chr2 = l.chr2 AND bin_x BETWEEN x0 AND x0 + 6 AND bin_y BETWEEN y0 AND y0 + 6 GROUP BY ALL""".replace(f"SELECT {C}, bin_x", "SELECT " + ", ".join(f"l.{c}" for c in COORDS) + ", bin_x"))
def j12_window_pixels(spark, d):
    return window_sums(_list(spark, d, "A"), reads(spark, d, 50_000), 50_000, 3, COORDS)


@book.add("""WITH l AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 5000 AS cx, ((start2 + end2) // 2) // 5000 AS cy FROM fx_loops WHERE list_id = 'A'),
bx AS (SELECT DISTINCT chr1, chr2, unnest(range(cx - 2, cx + 3)) AS bin_x FROM l), byy AS (SELECT DISTINCT chr1, chr2, unnest(range(cy - 2, cy + 3)) AS bin_y FROM l)
SELECT experiment, chr1, chr2, bin_x, bin_y, counts FROM fx_contacts SEMI JOIN bx USING (chr1, chr2, bin_x) SEMI JOIN byy USING (chr1, chr2, bin_y) WHERE resolution = 5000""")
def f18_pixel_mask(spark, d):
    return op.masked_pixels(_list(spark, d, "A"), view(spark, d, "fx_contacts"), 5000, 2).select("experiment", "chr1", "chr2", "bin_x", "bin_y", "counts")


@book.add("""WITH l AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 50000 AS cx, ((start2 + end2) // 2) // 50000 AS cy FROM fx_loops WHERE list_id = 'A'),
o AS (SELECT * FROM l UNION SELECT chr1, chr2, cy, cx FROM l)
SELECT DISTINCT experiment, chr1, chr2, bin_x, bin_y, counts FROM fx_contacts c SEMI JOIN o ON o.chr1 = c.chr1 AND o.chr2 = c.chr2 AND abs(bin_x - cx) + abs(bin_y - cy) < 3 WHERE resolution = 50000""")
def j14_near_pixels(spark, d):
    return op.near_pixels(_list(spark, d, "A"), view(spark, d, "fx_contacts"), 50_000, 3).select("experiment", "chr1", "chr2", "bin_x", "bin_y", "counts")


@book.add()
def j12_window_pixels_all(spark, d):
    return window_sums(view(spark, d, "fx_loops"), reads(spark, d, 50_000), 50_000, 3, COORDS)


@book.add()
def f18_pixel_mask_all(spark, d):
    return op.masked_pixels(view(spark, d, "fx_loops"), view(spark, d, "fx_contacts"), 5000, 2).select("experiment", "chr1", "chr2", "bin_x", "bin_y", "counts")


@book.add()
def j14_near_pixels_all(spark, d):
    return op.near_pixels(view(spark, d, "fx_loops"), view(spark, d, "fx_contacts"), 50_000, 3).select("experiment", "chr1", "chr2", "bin_x", "bin_y", "counts")


@book.add("""SELECT chr1, chr2, bin_x, bin_y, counts FROM fx_inter a WHERE NOT EXISTS (SELECT 1 FROM fx_inter b WHERE b.chr1 = a.chr1 AND b.chr2 = a.chr2 AND b.bin_x BETWEEN a.bin_x - 1 AND a.bin_x + 1 AND b.bin_y BETWEEN a.bin_y - 1 AND a.bin_y + 1 AND b.counts > a.counts)""")
def j15_nms_3x3(spark, d):
    return op.not_below_neighbour(view(spark, d, "fx_inter")).select("chr1", "chr2", "bin_x", "bin_y", "counts")
