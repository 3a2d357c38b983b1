"""Queries of projections, filters, routing and set operators, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS
from strandweave.operators import features as op
from strandweave.plans.book import Book
from strandweave.plans.fixtures import view
from strandweave.session import table
from strandweave.sources import text

book = Book()
C = ", ".join(COORDS)
_MID = "(start1 + end1) // 2 AS mid1, (start2 + end2) // 2 AS mid2"
STEMS = [f"S{i}" for i in range(1, 8)]
GROUPS = {"g1": ["S1", "S2"], "g2": ["S3"], "g3": ["S4", "S5"], "g4": ["S6", "S7"]}


def loops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loops")


def fx(name: str):
    return lambda spark, d: view(spark, d, name)


fx_loops, fx_stems = fx("fx_loops"), fx("fx_stem_loops")


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return op.flat_file(fx_stems(spark, d), STEMS)


# --- projections
def _expand(size: int, exact: bool) -> str:
    def side(s: int) -> str:
        m = f"(start{s} + end{s}) // 2 - {size // 2}"
        keep = "false" if exact else f"end{s} - start{s} > {size}"
        return f"CASE WHEN {keep} THEN start{s} ELSE {m} END AS start{s}, CASE WHEN {keep} THEN end{s} ELSE {m} + {size} END AS end{s}"

    return f"SELECT loop_id, chr1, {side(1)}, chr2, {side(2)} FROM loops"


@book.add(_expand(6000, False))
def e1_expand(spark, d):
    return op.expand_anchors(loops(spark, d).select("loop_id", *COORDS), 6000)


@book.add(_expand(2001, True))
def e1_expand_exact(spark, d):
    return op.expand_anchors(loops(spark, d).select("loop_id", *COORDS), 2001, exact=True)


@book.add(f"""
SELECT loop_id, 'corner' AS kind, chr1, start1 - 100 AS start1, start1 + 100 AS end1, chr2, end2 - 100 AS start2, end2 + 100 AS end2 FROM loops
UNION ALL SELECT loop_id, 'centre', chr1, q1 - 100, q1 + 100, chr2, q2 - 100, q2 + 100 FROM (
  SELECT *, CAST(floor(start1 + 0.25 * (end1 - start1)) AS BIGINT) AS q1, CAST(floor(start1 + 0.75 * (end1 - start1)) AS BIGINT) AS q2 FROM loops)""")
def e2_domain_points(spark, d):
    return op.domain_points(loops(spark, d).select("loop_id", *COORDS))


@book.add("""SELECT loop_id, o AS "offset", chr1, start1 + o AS start1, end1 + o AS end1, chr2, start2 + o AS start2, end2 + o AS end2
FROM loops CROSS JOIN (SELECT CAST(-5000000 AS BIGINT) AS o UNION ALL SELECT CAST(5000000 AS BIGINT)) WHERE start1 + o > 0 AND start2 + o > 0""")
def e3_offset(spark, d):
    return op.shift(loops(spark, d).select("loop_id", *COORDS), 5_000_000)


@book.add("""SELECT loop_id, chr1, CASE WHEN ok THEN highres_start_1 ELSE start1 END AS start1, CASE WHEN ok THEN highres_end_1 ELSE end1 END AS end1, chr2, start2, end2, start1 AS original_start1, end1 AS original_end1
FROM (SELECT *, highres_start_1 IS NOT NULL AND highres_end_1 IS NOT NULL AS ok FROM loops)""")
def e4_unwrap(spark, d):
    d = loops(spark, d).select("loop_id", *COORDS, "highres_start_1", "highres_end_1")
    return op.unwrap(d, {"start1": "highres_start_1", "end1": "highres_end_1"}, keep_original=True).drop("highres_start_1", "highres_end_1")


@book.add("SELECT loop_id, chr1, local_x AS start1, local_x + 10 AS end1, chr2, local_y AS start2, local_y + 10 AS end2 FROM loops WHERE local_x IS NOT NULL AND local_y IS NOT NULL")
def e5_unwrap_local(spark, d):
    return op.unwrap_local(loops(spark, d), 10).select("loop_id", *COORDS)


@book.add("""SELECT loop_id, chr1, start1 // 7000 * 7000 AS start1, greatest(end1 // 7000 * 7000, start1 // 7000 * 7000 + 7000) AS end1, chr2, start2 // 7000 * 7000 AS start2, greatest(end2 // 7000 * 7000, start2 // 7000 * 7000 + 7000) AS end2 FROM loops""")
def e6_round(spark, d):
    return op.round_bounds(loops(spark, d).select("loop_id", *COORDS), 7000)


@book.add("""SELECT loop_id, coalesce(CAST(local_x AS STRING), 'NA') AS local_x, coalesce(CAST(resolution AS STRING), 'NA') AS resolution, 'NA' AS absent FROM loops""")
def e7_attr_project(spark, d):
    open_ = loops(spark, d).select("loop_id", F.map_filter(F.create_map(F.lit("localX"), F.col("local_x").cast("string"), F.lit("resolution"), F.col("resolution").cast("string")), lambda k, v: v.isNotNull()).alias("attributes"))
    kept = op.project_attributes(open_, ["localX", "resolution", "absent"])
    return kept.select("loop_id", *[F.try_element_at("attributes", F.lit(k)).alias(n) for k, n in (("localX", "local_x"), ("resolution", "resolution"), ("absent", "absent"))])


@book.add(f"SELECT {C}, CASE list_id WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END AS list_uid FROM fx_loops")
def e8_list_uid(spark, d):
    return op.union_by_name([fx_loops(spark, d).filter(F.col("list_id") == v).select(*COORDS) for v in "ANR"], "list_uid")


@book.add("""SELECT loop_id, concat_ws('_', chr1, start1, end1, chr2, start2, end2) AS code, chr1 || '_' || CAST(((start1 + end1) // 2) // 5000 AS STRING) AS key1, chr2 || '_' || CAST(((start2 + end2) // 2) // 5000 AS STRING) AS key2,
  greatest(end1 - start1, end2 - start2, 1) AS called_at_width, least(abs(end1 - start2), abs((start1 + end1) // 2 - (start2 + end2) // 2)) AS distance FROM loops""")
def e9_e12_keys(spark, d):
    return loops(spark, d).select("loop_id", x.loop_code().alias("code"), x.anchor_key(1, 5000).alias("key1"), x.anchor_key(2, 5000).alias("key2"), x.resolution_called_at().alias("called_at_width"), x.loop_distance().alias("distance"))


@book.add("""SELECT loop_id, local_x // 5000 - (((start1 + end1) // 2) // 5000 - 10) AS dx, (local_x // 5000) * 5000 - 5000 AS box_start, (local_x // 5000) * 5000 + 10000 AS box_end, (start1 // 5000) * 5000 AS grid_start,
  greatest((end1 // 5000) * 5000 + 1, (start1 // 5000) * 5000 + 5000) AS grid_end FROM loops WHERE local_x IS NOT NULL""")
def e13_e15_bins(spark, d):
    b, g = x.div("local_x", 5000), x.div("start1", 5000) * 5000
    return loops(spark, d).filter("local_x IS NOT NULL").select(
        "loop_id", (b - (x.div(x.mid1(), 5000) - 10)).alias("dx"), (b * 5000 - 5000).alias("box_start"), (b * 5000 + 10000).alias("box_end"), g.alias("grid_start"), F.greatest(x.div("end1", 5000) * 5000 + 1, g + 5000).alias("grid_end"))


@book.add("""SELECT motif_id, chrom, "start", regexp_replace(motif_id, '[^A-Za-z0-9._-]', '_', 'g') AS sane, split_part(motif_id, '_HUMAN', 1) AS motif, CASE strand WHEN '+' THEN 'forward' WHEN '-' THEN 'reverse' ELSE 'none' END AS suffix FROM fx_fimo""")
def e16_e17_names(spark, d):
    return view(spark, d, "fx_fimo").select("motif_id", "chrom", "start", x.sane_name(F.col("motif_id")).alias("sane"), x.motif_name(F.col("motif_id")).alias("motif"), x.strand_suffix(F.col("strand")).alias("suffix"))


@book.add("""SELECT loop_id, round(least(1, greatest(0, s / 30)), 6) AS clamped, round(ln(1 + abs(s)), 6) AS ln1, round(sqrt(abs(s)), 6) AS root, round(exp(s / 100), 6) AS ex, CAST(floor(s + 0.5) AS BIGINT) AS half_up, CAST(ceil(s) AS BIGINT) AS up,
  round((s + 1) / (4 + 1e0), 6) AS ratio FROM (SELECT loop_id, score AS s FROM loops WHERE score IS NOT NULL AND NOT isnan(score))""")
def e18_e21_math(spark, d):
    s = F.col("score")
    return loops(spark, d).filter("score IS NOT NULL AND NOT isnan(score)").select(
        "loop_id", F.round(x.clamp(s / 30), 6).alias("clamped"), F.round(F.ln(1 + F.abs(s)), 6).alias("ln1"), F.round(F.sqrt(F.abs(s)), 6).alias("root"), F.round(F.exp(s / 100), 6).alias("ex"), x.half_up(s).alias("half_up"), F.ceil(s).alias("up"), F.round(x.pseudo_ratio(s, F.lit(4.0)), 6).alias("ratio"))


@book.add("""SELECT loop_id, CAST(start1 AS STRING) || ',' || CAST(end1 AS STRING) AS vector, CAST(start1 + end1 AS DOUBLE) AS total, coalesce(CAST(local_x AS DOUBLE), -1) AS number FROM loops""")
def e20_e22_vectors(spark, d):
    v = x.vector_text(F.array("start1", "end1"))
    attributes = F.map_filter(F.create_map(F.lit("localX"), F.col("local_x").cast("string")), lambda k, w: w.isNotNull())
    return loops(spark, d).select("loop_id", v.alias("vector"), F.aggregate(x.vector_of(v), F.lit(0.0), lambda a, b: a + b).alias("total"), x.attribute(attributes, "localX", -1.0).alias("number"))


# --- filters
@book.add("SELECT loop_id FROM loops WHERE local_x BETWEEN start1 AND end1 AND local_y BETWEEN start2 AND end2")
def f1_contain(spark, d):
    return op.contains_local(loops(spark, d)).select("loop_id")


@book.add("SELECT file_id, chrom, start1, end1 FROM bed_files WHERE score > 5 AND NOT isnan(score)")
def f2_score_cut(spark, d):
    return text.bed_cut(table(spark, d, "bed_files").filter("NOT isnan(score)"), above=5.0).select("file_id", "chrom", "start1", "end1")


@book.add("""SELECT DISTINCT file_id, chrom, start1, end1, score FROM bed_files WHERE score >= (SELECT quantile_cont(score, 0.9) FROM bed_files WHERE score IS NOT NULL AND NOT isnan(score)) AND NOT isnan(score)""")
def f3_percentile(spark, d):
    return text.bed_cut(table(spark, d, "bed_files").select("file_id", "chrom", "start1", "end1", "score"), percentile=90.0).distinct()


@book.add("SELECT loop_id FROM loops WHERE least(abs(end1 - start2), abs((start1 + end1) // 2 - (start2 + end2) // 2)) // greatest(end1 - start1, end2 - start2, 1000) > 5")
def f4_near_diagonal(spark, d):
    return op.away_from_diagonal(loops(spark, d)).select("loop_id")


_DIST = "least(abs(end1 - start2), abs((start1 + end1) // 2 - (start2 + end2) // 2))"


@book.add(f"SELECT * FROM (SELECT {C}, loop_key FROM fx_loops WHERE ({_DIST} > 1000000 AND (score_5k > 0.85 OR score_10k > 0.85)) OR score_1k > 0.2 OR score_2k > 0.2)")
def f6_oracle_score(spark, d):
    return op.oracle_score(fx_loops(spark, d), "score_1k", "score_2k", "score_5k", "score_10k").select(*COORDS, "loop_key")


@book.add(f"SELECT {C}, loop_key FROM fx_loops WHERE CASE WHEN {_DIST} > 1000000 THEN score_5k > 0.85 AND score_10k > 0.85 ELSE score_1k > 0.2 AND score_2k > 0.2 END")
def f6_oracle_score_strict(spark, d):
    return op.oracle_score(fx_loops(spark, d), "score_1k", "score_2k", "score_5k", "score_10k", strict=True).select(*COORDS, "loop_key")


@book.add(f"""SELECT loop_id, CASE WHEN o < 10 THEN 'optimal' WHEN o > 400 THEN 'suboptimal' ELSE 'middle' END AS route, dist > 10000 AND local_x >= start1 AND local_x < end1 AND local_y >= start2 AND local_y < end2 AS best
FROM (SELECT *, abs(local_x - (start1 + end1) // 2) + abs(local_y - (start2 + end2) // 2) AS o, {_DIST} AS dist FROM loops) WHERE local_x IS NOT NULL AND local_y IS NOT NULL""")
def f7_unwrap_route(spark, d):
    return op.unwrap_route(loops(spark, d)).select("loop_id", "route", "best")


@book.add("SELECT loop_id FROM loops WHERE local_x IS NOT NULL AND local_y IS NOT NULL AND least(abs(local_x - local_y), abs((start1 + end1) // 2 - (start2 + end2) // 2)) > 5000")
def f7_unwrap_far(spark, d):
    return op.unwrap_far(op.unwrap_route(loops(spark, d))).select("loop_id")


_Z, _OE, _GOE = ({r: f"{n}_{r}" for r in (1, 2, 5)} for n in ("z", "oe", "goe"))
_SIEVE = """sv AS (SELECT loop_id, z * 1.0 AS z_1, z * 0.8 AS z_2, z * 0.6 AS z_5, o * 1.2 AS oe_1, o * 1.0 AS oe_2, o * 0.9 AS oe_5, o * 1.4 AS goe_1, o * 1.1 AS goe_2, o * 0.7 AS goe_5
  FROM (SELECT loop_id, CASE WHEN isnan(_sieve_local_zscore) THEN NULL ELSE _sieve_local_zscore END AS z, CASE WHEN isnan(_sieve_obs_over_global_expected) THEN NULL ELSE _sieve_obs_over_global_expected END AS o FROM loops)),
lv AS (SELECT loop_id, coalesce(z_1, -10) AS z1, coalesce(z_2, -10) AS z2, coalesce(z_5, -10) AS z5, ln(coalesce(oe_1, 0.1)) AS o1, ln(coalesce(oe_2, 0.1)) AS o2, ln(coalesce(oe_5, 0.1)) AS o5, ln(coalesce(goe_1, 0.1)) AS g1, ln(coalesce(goe_2, 0.1)) AS g2, ln(coalesce(goe_5, 0.1)) AS g5 FROM sv)"""


def _sieved(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    z, o = n("_sieve_local_zscore"), n("_sieve_obs_over_global_expected")
    ks = {"z_1": z * 1.0, "z_2": z * 0.8, "z_5": z * 0.6, "oe_1": o * 1.2, "oe_2": o * 1.0, "oe_5": o * 0.9, "goe_1": o * 1.4, "goe_2": o * 1.1, "goe_5": o * 0.7}
    return loops(spark, d).select("loop_id", *[c.alias(k) for k, c in ks.items()])


@book.add(f"""WITH {_SIEVE},
b AS (SELECT *, z1 > 1 AND o1 > ln(1.5) AS w1, z2 > 1 AND o2 > ln(1.5) AS w2, z5 > 1 AND o5 > ln(1.5) AS w5, (z1 + z2 + z5) / 3 > 1 AND (o1 + o2 + o5) / 3 > ln(2) AS avg_ok,
  z1 > 2 AND o1 > ln(2) AND g1 > ln(2) AS s1, z2 > 2 AND o2 > ln(2) AND g2 > ln(2) AS s2, z5 > 2 AND o5 > ln(2) AND g5 > ln(2) AS s5 FROM lv),
m AS (SELECT *, w1 AND g1 > ln(1.5) AS m1, w2 AND g2 > ln(1.5) AS m2, w5 AND g5 > ln(1.5) AS m5 FROM b)
SELECT loop_id, CASE WHEN (s1 AND (m2 OR m5 OR avg_ok)) OR (s2 AND (m1 OR m5 OR avg_ok)) OR (s5 AND (m1 OR m2 OR avg_ok)) OR (avg_ok AND ((m1 AND m2) OR (w2 AND w5) OR (w1 AND w5))) THEN 'good'
  WHEN greatest(g1, g2, g5) > 1.25 OR greatest(o1, o2, o5) > 1.1 OR greatest(z1, z2, z5) > 0.5 THEN 'weak' ELSE 'none' END AS verdict FROM m""")
def f11_f12_sieve_verdict(spark, d):
    return op.sieve_verdict(_sieved(spark, d), _Z, _OE, _GOE).select("loop_id", "verdict")


@book.add(f"WITH {_SIEVE} SELECT loop_id FROM sv WHERE z_1 > 0 AND z_2 > 0 AND z_5 > 0 AND ln(oe_1) > 0 AND ln(oe_2) > 0 AND ln(oe_5) > 0")
def f13_sieve_easy(spark, d):
    return op.sieve_easy(_sieved(spark, d), list(_Z.values()), list(_OE.values())).select("loop_id")


_BD = "CAST(floor(abs((start1 + end1) // 2 - (start2 + end2) // 2) / 5000e0 + 0.5) AS BIGINT)"


@book.add(f"SELECT min(d) - 40 AS low, max(d) + 40 AS high FROM (SELECT {_BD} AS d FROM loops WHERE chr1 = chr2)")
def f15_distance_band(spark, d):
    return op.distance_band(loops(spark, d), 5000, 10)


@book.add(f"SELECT loop_id FROM loops WHERE {_BD} BETWEEN 20 AND 400")
def f16_apa_distance(spark, d):
    return op.apa_distance(loops(spark, d), 5000, 10, most=400).select("loop_id")


@book.add("SELECT file_id, chrom, start1, end1 FROM bed_files WHERE end1 - start1 < 400")
def f17_bed_width(spark, d):
    return table(spark, d, "bed_files").filter("end1 - start1 < 400").select("file_id", "chrom", "start1", "end1")


@book.add("""SELECT DISTINCT l.loop_id FROM loops l JOIN (SELECT chr1, chr2, ((start1 + end1) // 2) // 5000 AS bx, ((start2 + end2) // 2) // 5000 AS by, count(*) AS n FROM loops GROUP BY ALL) g
  ON l.chr1 = g.chr1 AND l.chr2 = g.chr2 AND ((l.start1 + l.end1) // 2) // 5000 = g.bx AND ((l.start2 + l.end2) // 2) // 5000 = g.by WHERE n = 1""")
def f20_alone_in_bin(spark, d):
    return op.alone_in_bin(loops(spark, d), 5000).select("loop_id").distinct()


@book.add("SELECT loop_key, start1, end1, start2, end2 FROM fx_loops WHERE end1 - start1 <> end2 - start2 AND (greatest(end1 - start1, end2 - start2) // 100) // 10 > 1")
def f21_stripe_size(spark, d):
    return op.size_filter(fx_loops(spark, d), 100, 10).select("loop_key", "start1", "end1", "start2", "end2")


# --- set operators
@book.add("SELECT loop_id, list_id, score, CAST(NULL AS BIGINT) AS local_x FROM loops WHERE resolution = 5000 UNION ALL SELECT loop_id, list_id, CAST(NULL AS DOUBLE), local_x FROM loops WHERE resolution = 10000")
def u1_union_by_name(spark, d):
    base = loops(spark, d)
    return op.union_by_name([base.filter("resolution = 5000").select("loop_id", "list_id", "score"), base.filter("resolution = 10000").select("loop_id", "list_id", "local_x")])


@book.add(f"SELECT DISTINCT {C} FROM fx_loops")
def u2_union_distinct(spark, d):
    return op.distinct_features(fx_loops(spark, d))


@book.add(f"SELECT {C}, list_id, loop_key FROM (SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY list_id, loop_key) AS n FROM fx_loops) WHERE n = 1")
def u3_dedup_keep_first(spark, d):
    return op.keep_first(fx_loops(spark, d).select(*COORDS, "list_id", "loop_key"), ["list_id", "loop_key"])


@book.add(f"SELECT loop_id, CAST((row_number() OVER (PARTITION BY chr1, chr2 ORDER BY start1, end1, start2, end2, loop_id) - 1) % 4 AS INT) AS part FROM (SELECT DISTINCT loop_id, {C} FROM loops)")
def u6_split_round_robin(spark, d):
    return op.split_round_robin(loops(spark, d).select("loop_id", *COORDS).distinct(), 4, ["start1", "end1", "start2", "end2", "loop_id"]).select("loop_id", "part")


@book.add("SELECT chr1, chr2, count(*) AS n, min(start1) AS first, max(end2) AS last FROM loops GROUP BY chr1, chr2")
def u7_split_by_chrom(spark, d):
    return loops(spark, d).groupBy("chr1", "chr2").agg(F.count("*").alias("n"), F.min("start1").alias("first"), F.max("end2").alias("last"))


@book.add(f"SELECT {C} FROM fx_loops WHERE list_id IN ('A', 'N') EXCEPT SELECT {C} FROM fx_loops WHERE list_id = 'R'")
def u8_set_difference(spark, d):
    l = fx_loops(spark, d)
    return l.filter("list_id IN ('A', 'N')").select(*COORDS).distinct().join(l.filter("list_id = 'R'").select(*COORDS), COORDS, "left_anti")


@book.add('SELECT chr1 AS chrom, start1 AS "start", end1 AS "end" FROM loops UNION SELECT chr2, start2, end2 FROM loops')
def u9_distinct_anchors(spark, d):
    return op.anchors_of(loops(spark, d))


@book.add(f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS \"unique\", CAST(sum(CASE WHEN {_BD} >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS filtered FROM (SELECT {C}, count(*) AS n FROM loops GROUP BY ALL)")
def u10_unique_filtered(spark, d):
    return op.unique_filtered(loops(spark, d), 5000, 10)


@book.add("SELECT list_id, chr1, min(start1) AS start1, max(end1) AS end1, min(start2) AS start2, max(end2) AS end2 FROM loops GROUP BY list_id, chr1")
def a3_union_bounds(spark, d):
    return op.union_bounds(loops(spark, d), ["list_id", "chr1"])


# --- flat files
_FLAT = f"flat AS (SELECT {C}, " + ", ".join(f"coalesce(min(CASE WHEN stem = '{s}' THEN status END), 0) AS {s}" for s in STEMS) + f" FROM fx_stem_loops GROUP BY {C})"


@book.add(f"WITH {_FLAT} SELECT * FROM flat")
def a1_flat_file(spark, d):
    return _flat(spark, d)


@book.add(f"WITH {_FLAT} SELECT {C}, CASE WHEN S1 = 1 AND S2 = 1 THEN 'both' WHEN S1 = 1 THEN 'only1' WHEN S2 = 1 THEN 'only2' ELSE 'neither' END AS route FROM flat WHERE S1 <> 0 AND S2 <> 0")
def f8_two_way_diff(spark, d):
    return op.two_way(_flat(spark, d), "S1", "S2").select(*COORDS, "route")


_LIST = "[" + ", ".join(STEMS) + "]"


@book.add(f"""WITH {_FLAT}, c AS (SELECT *, len(list_filter({_LIST}, lambda v: v = 1)) AS yes, len(list_filter({_LIST}, lambda v: v = -1)) AS no FROM flat),
r AS (SELECT {C}, CASE WHEN yes = 7 THEN 'always' WHEN no = 7 THEN 'never' WHEN no = 0 THEN 'mostly' WHEN yes >= 2 AND no >= 2 THEN 'variable' END AS route FROM c) SELECT * FROM r WHERE route IS NOT NULL""")
def f9_common_variable(spark, d):
    return op.common_or_variable(_flat(spark, d), STEMS).select(*COORDS, "route")


_MEANS = "[" + ", ".join("(" + " + ".join(v) + f") / {len(v)}.0" for v in GROUPS.values()) + "]"


@book.add(f"""WITH {_FLAT}, m AS (SELECT {C}, list_transform({_MEANS}, lambda v: CAST(v AS DOUBLE)) AS m FROM flat),
r AS (SELECT {C}, CASE WHEN len(list_filter(m, lambda v: v > 0.99)) = 1 AND len(list_filter(m, lambda v: v < 0)) > 2 THEN 'g' || CAST(list_position(list_transform(m, lambda v: v > 0.99), true) AS STRING) END AS present,
  CASE WHEN len(list_filter(m, lambda v: v < -0.99)) = 1 AND len(list_filter(m, lambda v: v > 0)) > 2 THEN 'g' || CAST(list_position(list_transform(m, lambda v: v < -0.99), true) AS STRING) END AS absent FROM m)
SELECT * FROM r WHERE present IS NOT NULL OR absent IS NOT NULL""")
def a2_multi_diff(spark, d):
    return op.multi_group(_flat(spark, d), GROUPS).select(*COORDS, "present", "absent")


# --- sources and sinks
@book.add("""SELECT chrom, "start", "end", name, score FROM (SELECT regexp_split_to_array(trim(regexp_replace(raw, chr(13) || '$', '')), '\\s+') AS w, w[1] AS chrom, CASE WHEN regexp_full_match(w[2], '[+-]?[0-9]+') THEN TRY_CAST(w[2] AS BIGINT) END AS "start", CASE WHEN regexp_full_match(w[3], '[+-]?[0-9]+') THEN TRY_CAST(w[3] AS BIGINT) END AS "end", w[4] AS name,
  CASE WHEN regexp_full_match(w[5], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|[+-]?inf(inity)?)') THEN CAST(w[5] AS DOUBLE) END AS score FROM bed_lines)
WHERE chrom LIKE 'chr%' AND chrom <> 'chrom' AND "start" IS NOT NULL AND "end" IS NOT NULL AND NOT contains(chrom, chr(13))""")
def s2_bed_scan(spark, d):
    lines = table(spark, d, "bed_lines").select(F.regexp_replace("raw", r"\r\z", "").alias("value"))
    return text.bed_lines(lines).filter(~F.col("chrom").contains("\r"))


@book.add("""SELECT split_part(motif_id, '_HUMAN', 1) AS motif, chrom, "start", "end", CASE strand WHEN '+' THEN 'forward' ELSE 'reverse' END AS strand FROM fx_fimo WHERE contains(motif_id, '_HUMAN')""")
def s6_fimo_route(spark, d):
    line = F.concat_ws("\t", "motif_id", F.lit("x"), "chrom", "start", "end", "strand").alias("value")
    return text.motif_hits(view(spark, d, "fx_fimo").select(line))


@book.add("""SELECT track, chrom, "start", "end", value FROM fx_signal WHERE chrom = 'chr2' AND "start" < 2000000 AND "end" > 1000000""")
def s7_track_range(spark, d):
    return text.track_range(view(spark, d, "fx_signal"), "2", 1_000_000, 2_000_000).select("track", "chrom", "start", "end", "value")


@book.add("""SELECT chrom, "start", "end", ("start" + "end") // 2 AS mid, (("start" + "end") // 2) // 750 AS bucket FROM fx_anchors""")
def s8_bucketed_bed(spark, d):
    return text.bucketed(view(spark, d, "fx_anchors").select("chrom", "start", "end"), 750)


@book.add("SELECT chrom, chr_index, length FROM chroms WHERE chrom IN ('chr3', 'chrX')")
def s10_pick_chromosomes(spark, d):
    return text.pick_chromosomes(table(spark, d, "chroms"), "chr3,chrX").select("chrom", "chr_index", "length")


@book.add("SELECT a.chrom AS chr1, b.chrom AS chr2 FROM chroms a JOIN chroms b ON a.chr_index <= b.chr_index")
def s11_work_units(spark, d):
    return text.chromosome_pairs(table(spark, d, "chroms"), inter=True)


@book.add("SELECT min(resolution) AS finest, max(resolution) AS coarsest FROM fx_contacts")
def s12_resolutions(spark, d):
    return text.finest_and_coarsest(view(spark, d, "fx_contacts"))


@book.add(f"SELECT {C} FROM loops")
def s13_clean_scan(spark, d):
    return op.without_attributes(loops(spark, d))


@book.add("SELECT experiment, chr1, bin_x, bin_y, counts FROM fx_contacts WHERE resolution = 5000 AND counts > 0 AND bin_x BETWEEN 100 AND 399 AND bin_y BETWEEN 100 AND 499")
def s5_block_range(spark, d):
    return text.pixels_in(view(spark, d, "fx_contacts"), 5000, 100, 400, 100, 500).select("experiment", "chr1", "bin_x", "bin_y", "counts")


@book.add("""SELECT 0 AS str1, chr1, bin_x * 5000 AS pos1, 0 AS frag1, 0 AS str2, chr2, bin_y * 5000 AS pos2, 1 AS frag2, CAST(floor(counts / 3e0 + 0.5) AS BIGINT) AS score FROM fx_contacts WHERE resolution = 5000 AND floor(counts / 3e0 + 0.5) > 0""")
def k8_mnd_rows(spark, d):
    return text.mnd_rows(view(spark, d, "fx_contacts").filter("resolution = 5000").withColumn("value", F.col("counts") / 3.0), 5000)


@book.add("""SELECT c.chrom, r."start", r."end" FROM (SELECT DISTINCT chrom, "start", "end" FROM fx_anchors) r JOIN chroms c USING (chrom)""")
def k2_bed_export(spark, d):
    d = view(spark, d, "fx_anchors").select("chrom", "start", "end").distinct().join(table(spark, d, "chroms").select("chrom", "chr_index"), "chrom")
    return text.bed_rows(d)


