"""Readers and writers of BED, BEDPE, bedGraph and motif files, and of grids.

Readers take text through ``spark.read.text`` with explicit columns, so nothing is inferred and a broken line is null,
not an error. Writers write folders of part files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def bed_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``chrom, start, end, name, score`` of BED text; lines without a ``chr`` prefix and the ``chrom x1`` header are skipped."""
    w = lines.select(_words(F.col(text)).alias("w")).filter(F.get("w", F.lit(0)).startswith("chr") & (F.get("w", F.lit(0)) != "chrom"))
    at = lambda i: F.get("w", F.lit(i))
    d = w.select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).alias("name"), at(4).try_cast("double").alias("score"))
    return d.filter("start IS NOT NULL AND end IS NOT NULL")


def read_bed(spark: SparkSession, path: str, chroms: DataFrame | None = None, above: float | None = None, percentile: float | None = None) -> DataFrame:
    """Distinct BED rows; a score cut-off, or a percentile of all input rows taken before duplicates go."""
    d = bed_lines(spark.read.text(path))
    if chroms is not None:
        d = d.join(F.broadcast(chroms.select("chrom")), "chrom", "left_semi")
    return bed_cut(d, above, percentile).dropDuplicates()


def bed_cut(bed: DataFrame, above: float | None = None, percentile: float | None = None) -> DataFrame:
    if above is not None:
        return bed.filter(F.col("score") > above)
    if percentile is not None:
        cut = bed.filter("score IS NOT NULL AND NOT isnan(score)").agg(F.percentile("score", percentile / 100).alias("cut"))
        return bed.join(F.broadcast(cut), F.col("score") >= F.col("cut")).filter("NOT isnan(score)").drop("cut")
    return bed


def read_bed_simple(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end`` with repeated rows."""
    return bed_lines(spark.read.text(path)).select("chrom", "start", "end")


def read_bedgraph(spark: SparkSession, path: str, chroms: DataFrame | None = None) -> DataFrame:
    """``chrom, start, end, value, line_no``; unknown chromosomes are dropped."""
    w = spark.read.text(path).select(_words(F.col("value")).alias("w"), F.monotonically_increasing_id().alias("line_no")).filter(F.size("w") >= 4)
    at = lambda i: F.get("w", F.lit(i))
    d = w.select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).try_cast("double").alias("value"), "line_no").dropna()
    return d if chroms is None else d.join(F.broadcast(chroms.select("chrom")), "chrom", "left_semi")


def read_bedpe(spark: SparkSession, path: str, attributes: bool = True) -> DataFrame:
    """Features of a BEDPE file with a header; other columns become a map by name, or are not read at all."""
    d = spark.read.csv(path, sep="\t", header=True)
    names = [c.lstrip("#") for c in d.columns]
    d = d.toDF(*names)
    fixed = [F.col(c) if c.startswith("chr") else F.col(c).try_cast("bigint").alias(c) for c in COORDS]
    if not attributes:
        return d.select(*fixed)
    rest = [c for c in names if c not in COORDS]
    entries = [y for c in rest for y in (F.lit(c), F.col(f"`{c}`"))]
    return d.select(*fixed, F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("attributes") if entries else F.create_map().cast("map<string,string>").alias("attributes"))


def motif_hits(lines: DataFrame, marker: str = "_HUMAN", text: str = "value") -> DataFrame:
    """``motif, chrom, start, end, strand`` of the lines that hold the marker; broken ones are dropped."""
    w = lines.filter(F.col(text).contains(marker)).select(F.split(text, "\t").alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    return w.select(x.motif_name(at(0), marker).alias("motif"), at(2).alias("chrom"), at(3).try_cast("bigint").alias("start"), at(4).try_cast("bigint").alias("end"), x.strand_suffix(at(5)).alias("strand")).dropna()


def pick_chromosomes(chroms: DataFrame, names: str | None = None) -> DataFrame:
    return chroms if not names else chroms.filter(F.col("chrom").isin([n.strip() for n in names.split(",")]))


def chromosome_pairs(chroms: DataFrame, inter: bool) -> DataFrame:
    """Work units: a chromosome with itself, with ``inter`` also with later ones. The catalogue has a fixed size."""
    a, b = (chroms.select(F.col("chrom").alias(f"chr{s}"), F.col("chr_index").alias(f"i{s}")) for s in (1, 2))
    return a.join(b, (F.col("i1") <= F.col("i2")) if inter else (F.col("i1") == F.col("i2"))).select("chr1", "chr2")


def finest_and_coarsest(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.min("resolution").alias("finest"), F.max("resolution").alias("coarsest"))


def pixels_in(contacts: DataFrame, resolution: int, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Positive pixels of a half-open rectangle of bins; the range reaches the scan."""
    return contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0) & (F.col("bin_x") >= x0) & (F.col("bin_x") < x1) & (F.col("bin_y") >= y0) & (F.col("bin_y") < y1))


def track_range(signal: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Entries of a track that overlap a range, with or without the ``chr`` prefix of the name."""
    return signal.filter(F.col("chrom").isin(chrom, f"chr{chrom}") & (F.col("start") < end) & (F.col("end") > start))


def bucketed(bed: DataFrame, size: int) -> DataFrame:
    return bed.withColumn("mid", x.mid("start", "end")).withColumn("bucket", x.div("mid", size))


# --- writers
def write_bedpe(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, mode="overwrite")


def bed_rows(df: DataFrame) -> DataFrame:
    """Sorted by the chromosome's index as text, then by start."""
    return df.withColumn("_k", F.col("chr_index").cast("string")).orderBy("_k", "start", "end").select("chrom", "start", "end")


def write_bed(df: DataFrame, path: str) -> None:
    bed_rows(df).write.csv(path, sep="\t", mode="overwrite")


def bedgraph_rows(bins: DataFrame, bin_size: int, zeros: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    d = bins if zeros else bins.filter("value > 0")
    return d.select(*keys, "chrom", (F.col("bin") * bin_size).alias("start"), (F.col("bin") * bin_size + bin_size).alias("end"), "value")


def write_bedgraph(bins: DataFrame, path: str, bin_size: int, zeros: bool = False) -> None:
    bedgraph_rows(bins, bin_size, zeros).write.csv(path, sep=" ", mode="overwrite")


def write_routed(df: DataFrame, path: str, routes: Sequence[str]) -> None:
    """One pass into a folder for each route."""
    df.write.partitionBy(*routes).csv(path, sep="\t", mode="overwrite")


def grid_array(grid: DataFrame, window: int, value: str = "total") -> np.ndarray:
    """A pile-up grid as a matrix; it has (2 * window + 1) squared cells whatever the input."""
    m = np.zeros((2 * window + 1,) * 2)
    cells = grid.select("dx", "dy", value).limit(m.size + 1).collect()
    if len(cells) > m.size or len({(r["dx"], r["dy"]) for r in cells}) < len(cells):
        raise ValueError("a cell of the grid occurs more than once")
    for r in cells:
        m[r["dx"], r["dy"]] = r[value]
    return m


def write_grid(grid: DataFrame, path: str, window: int, value: str = "total") -> None:
    np.savetxt(path, grid_array(grid, window, value))


def write_windows(dump: DataFrame, path: str, per_file: int = 100) -> None:
    dump.write.option("maxRecordsPerFile", per_file).parquet(path, mode="overwrite")


def mnd_rows(pixels: DataFrame, resolution: int) -> DataFrame:
    """Pairs text: rounded positive cells in genomic coordinates."""
    n = x.half_up(F.col("value")).cast("bigint")
    return pixels.withColumn("n", n).filter("n > 0").select(F.lit(0).alias("str1"), "chr1", (F.col("bin_x") * resolution).alias("pos1"), F.lit(0).alias("frag1"), F.lit(0).alias("str2"), "chr2", (F.col("bin_y") * resolution).alias("pos2"), F.lit(1).alias("frag2"), F.col("n").alias("score"))


def write_mnd(pixels: DataFrame, path: str, resolution: int) -> None:
    mnd_rows(pixels, resolution).write.csv(path, sep=" ", mode="overwrite")


def anchor_score_rows(scores: DataFrame, chroms: DataFrame, resolution: int) -> DataFrame:
    """BED9 rows of anchor scores by chromosome index and start."""
    d = scores.join(F.broadcast(chroms.select("chrom", "chr_index")), "chrom")
    start = F.col("bin") * resolution
    colour = F.when(F.col("side") == "upstream", "0,128,0").otherwise("128,0,0")
    return d.orderBy("chr_index", start).select("chrom", start.alias("start"), (start + resolution).alias("end"), F.col("side").alias("name"), "score", F.when(F.col("side") == "upstream", "+").otherwise("-").alias("strand"), start.alias("thick_start"), (start + resolution).alias("thick_end"), colour.alias("rgb"))
