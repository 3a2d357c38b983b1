"""Files written and read again, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.functions.scalars import COORDS
from strandweave.operators import signals
from strandweave.plans import matrices, tracks
from strandweave.plans.book import Book
from strandweave.plans.fixtures import view
from strandweave.session import shared_dir, table
from strandweave.sources import text

book = Book()
C = ", ".join(COORDS)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandweave-{name}-{uuid.uuid4().hex}"


@book.add(f"SELECT {C}, list_id, loop_key, round(score_5k, 6) AS score FROM fx_loops")
def s1_k1_bedpe(spark, d):
    path = _folder(spark, "bedpe")
    text.write_bedpe(view(spark, d, "fx_loops").select(*COORDS, "list_id", "loop_key", F.col("score_5k").cast("double").alias("score")), path)
    of = lambda k, t: F.col("attributes")[k].cast(t)
    return text.read_bedpe(spark, path).select(*COORDS, of("list_id", "string").alias("list_id"), of("loop_key", "bigint").alias("loop_key"), F.round(of("score", "double"), 6).alias("score"))


@book.add('SELECT c.chrom, r."start", r."end" FROM fx_anchors r JOIN chroms c USING (chrom)')
def s3_k2_bed(spark, d):
    path = _folder(spark, "bed")
    text.write_bed(view(spark, d, "fx_anchors").select("chrom", "start", "end").join(table(spark, d, "chroms").select("chrom", "chr_index"), "chrom"), path)
    return text.read_bed_simple(spark, path)


@book.add(f'WITH {tracks.DENSE} SELECT chrom, bin * 1000 AS "start", bin * 1000 + 1000 AS "end", round(value, 6) AS value FROM dn WHERE track = \'click\'')
def k4_bedgraph_with_zeros(spark, d):
    path = _folder(spark, "bedgraph")
    text.write_bedgraph(signals.dense(tracks.raster(spark, d)), path, 1000, zeros=True)
    return text.read_bedgraph(spark, path).select("chrom", "start", "end", F.round("value", 6).alias("value"))


@book.add("""SELECT CASE WHEN name LIKE 'Forward%' THEN 'forward' ELSE 'reverse' END AS route, chrom, "start", "end", name FROM fx_anchors""")
def k5_routed_bed(spark, d):
    path = _folder(spark, "routed")
    rows = view(spark, d, "fx_anchors").select(F.when(F.col("name").startswith("Forward"), "forward").otherwise("reverse").alias("route"), "chrom", "start", "end", "name")
    text.write_routed(rows, path, ["route"])
    return spark.read.csv(path, sep="\t", schema="chrom string, start bigint, end bigint, name string, route string").select("route", "chrom", "start", "end", "name")


@book.add()
def k6_dense_grid(spark, d):
    grid = matrices.book.queries["a5_apa_pileup"](spark, d)
    m = text.grid_array(grid, matrices.W)
    rows = [(i, j, int(v)) for i, line in enumerate(m) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "dx bigint, dy bigint, total bigint").select(*[F.col(c).cast(t) for c, t in grid.dtypes])


@book.add()
def k7_window_chunks(spark, d):
    path = _folder(spark, "windows")
    dump = matrices.book.queries["a11_window_dump"](spark, d)
    text.write_windows(dump, path)
    return spark.read.schema(dump.schema).parquet(path)


@book.add("""SELECT a.chrom, a."start" // 5000 * 5000 AS "start", a."start" // 5000 * 5000 + 5000 AS "end", CASE WHEN name LIKE 'Forward%' THEN 'upstream' ELSE 'downstream' END AS name, score, CASE WHEN name LIKE 'Forward%' THEN '+' ELSE '-' END AS strand,
  a."start" // 5000 * 5000 AS thick_start, a."start" // 5000 * 5000 + 5000 AS thick_end, CASE WHEN name LIKE 'Forward%' THEN '0,128,0' ELSE '128,0,0' END AS rgb FROM fx_anchors a JOIN fx_chroms USING (chrom)""")
def k10_anchor_scores(spark, d):
    side = F.when(F.col("name").startswith("Forward"), "upstream").otherwise("downstream").alias("side")
    return text.anchor_score_rows(view(spark, d, "fx_anchors").select("chrom", F.expr("start div 5000").alias("bin"), side, "score"), view(spark, d, "fx_chroms"), 5000)


# these come back as the query that was written gives them
book.sql |= {"k6_dense_grid": matrices.book.sql["a5_apa_pileup"], "k7_window_chunks": matrices.book.sql["a11_window_dump"]}
