"""Registered queries of the data-preparation operators of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import drift, periods, rejects
from strandweave.session import table
from strandweave.streaming.periods import streamed_periods

#: Unified field names that get a column of their own in p1_table.
MEASURES = {f"{r}_sieve_{m}": f"{m}_{r}" for r in (500, 1000, 2000, 5000, 10000, 25000) for m in ("local_zscore", "obs_over_global_expected")}

STREAM_TILE = 1 << 26


def _sieve(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "sieve_files"), table(spark, d, "sieve_lines")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_changes(*_sieve(spark, d))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return drift.path_statistics(_sieve(spark, d)[1])


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.typed_table(*_sieve(spark, d), MEASURES)


def p1_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    cast = F.explode("failed_casts").alias("cast")
    return drift.typed_table(*_sieve(spark, d)).select("file_id", cast).groupBy("file_id", "cast").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.bed_periods(table(spark, d, "bed_files"), table(spark, d, "chroms"))


def p2_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over the table's files, whose maps are kept in Spark's state store. Tiles are wide, as state is kept by tile and file."""
    name = f"{d}/bed_files.parque[t]"  # a pattern, as a stream takes no path of a single file
    stream = spark.readStream.schema(table(spark, d, "bed_files").schema).option("maxFilesPerTrigger", 64).parquet(name)
    return streamed_periods(periods.bed_rows(stream, table(spark, d, "chroms")), ["file_id", "chrom"], tile=STREAM_TILE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "bed_lines"), table(spark, d, "chroms")).select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(table(spark, d, "bed_lines"), table(spark, d, "chroms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p1_table, p1_failed_casts, p2_found, p2_streamed, p4_found, p4_loaded)}


_CELLS = r"""
WITH header AS (
  SELECT file_id, unnest(string_split(rtrim(line, chr(13)), chr(9))[7:]) AS path, unnest(range(7, 1 + len(string_split(rtrim(line, chr(13)), chr(9))))) AS pos FROM sieve_lines WHERE line_no = 1),
body AS (SELECT file_id, line_no, string_split(rtrim(line, chr(13)), chr(9)) AS c FROM sieve_lines WHERE line_no > 1),
cell AS (
  SELECT * FROM (SELECT file_id, path, line_no, array_to_string(c[1:6], chr(9)) AS loop, c[pos] AS v FROM body JOIN header USING (file_id))
  WHERE v NOT IN ('', 'NA', 'NaN', '.')),
kind AS (
  SELECT file_id, path, count(v) AS n, count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) AS n_integer,
    count(*) FILTER (WHERE regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND NOT regexp_full_match(v, '[+-]?[0-9]+')) AS n_decimal
  FROM header LEFT JOIN cell USING (file_id, path) GROUP BY file_id, path),
field AS (
  SELECT *, n - n_integer - n_decimal AS n_text, CASE WHEN n = 0 THEN NULL WHEN n > n_integer + n_decimal THEN 'text' WHEN n_decimal > 0 THEN 'decimal' ELSE 'integer' END AS type FROM kind)
"""

_CHANGES = (
    _CELLS
    + r""",
pair AS (SELECT file_id, stem, row_number() OVER w AS ord, lag(file_id) OVER w AS before FROM sieve_files WINDOW w AS (PARTITION BY stem ORDER BY seq)),
gone AS (SELECT p.file_id, f.path FROM pair p JOIN field f ON f.file_id = p.before WHERE NOT EXISTS (SELECT 1 FROM field g WHERE g.file_id = p.file_id AND g.path = f.path)),
new AS (SELECT p.file_id, f.path FROM pair p JOIN field f USING (file_id) WHERE p.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM field g WHERE g.file_id = p.before AND g.path = f.path)),
renamed AS (
  SELECT g.file_id, g.path AS field_before, n.path AS field_after
  FROM gone g JOIN pair p USING (file_id) JOIN new n USING (file_id)
    JOIN cell a ON a.file_id = p.before AND a.path = g.path JOIN cell b ON b.file_id = p.file_id AND b.path = n.path AND a.loop = b.loop
  GROUP BY ALL HAVING bool_and(a.v = b.v)),
kept AS (
  SELECT p.stem, p.ord, f.file_id, f.path, f.type, p.ord - row_number() OVER (PARTITION BY p.stem, f.path ORDER BY p.ord) AS run FROM field f JOIN pair p USING (file_id)),
known AS (
  SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY stem, path, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS type_before FROM kept)
SELECT file_id, 'renamed' AS change_kind, field_before, field_after FROM renamed
UNION ALL SELECT file_id, 'removed', path, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = gone.file_id AND r.field_before = gone.path)
UNION ALL SELECT file_id, 'added', '', path FROM new WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = new.file_id AND r.field_after = new.path)
UNION ALL SELECT file_id, 'retyped', path, path FROM known WHERE type <> type_before
UNION ALL SELECT r.file_id, 'retyped', r.field_before, r.field_after FROM renamed r JOIN pair p USING (file_id)
  JOIN field a ON a.file_id = p.before AND a.path = r.field_before JOIN field b ON b.file_id = r.file_id AND b.path = r.field_after WHERE a.type <> b.type
"""
)

_PERIODS = """
WITH rows AS (
  SELECT DISTINCT b.file_id, c.chrom, b.start1, b.end1
  FROM bed_files b JOIN chroms c ON regexp_replace(lower(trim(b.chrom)), '^chr', '') = regexp_replace(lower(c.chrom), '^chr', '')
  WHERE b.end1 > b.start1),
reach AS (SELECT *, max(end1) OVER (PARTITION BY file_id, chrom ORDER BY start1, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM rows),
island AS (SELECT *, sum(CASE WHEN so_far >= start1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, chrom ORDER BY start1, end1 ROWS UNBOUNDED PRECEDING) AS n FROM reach),
period AS (SELECT file_id, chrom, n, min(start1) AS start1, max(end1) AS end1 FROM island GROUP BY ALL)
SELECT file_id, chrom, 'period' AS kind, start1, end1 FROM period
UNION ALL SELECT a.file_id, a.chrom, 'gap', a.end1, b.start1 FROM period a JOIN period b ON a.file_id = b.file_id AND a.chrom = b.chrom AND b.n = a.n + 1
"""

_LINES = r"""
WITH line AS (SELECT line_id, file_id, line_no, CASE WHEN ends_with(raw, chr(13)) THEN raw[:-2] ELSE raw END AS raw FROM bed_lines),
data AS (
  SELECT * FROM line WHERE trim(raw, chr(9) || chr(13) || ' ') <> '' AND NOT starts_with(raw, '#') AND NOT starts_with(raw, 'track') AND NOT starts_with(raw, 'browser') AND NOT regexp_matches(raw, '^( *chrom *|"chrom")(\t|$)')),
token AS (
  SELECT line_id, file_id, line_no, regexp_full_match(raw, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS closed,
    list_transform(regexp_extract_all(chr(9) || raw, '\t(?:"(?:[^"]|"")*"|[^"\t]*)'),
      lambda x: CASE WHEN x[2] = '"' THEN replace(x[3:-2], '""', '"') ELSE trim(x[2:], ' ') END) AS f
  FROM data),
judged AS (
  SELECT line_id, file_id, line_no, f, CASE WHEN NOT closed THEN 'quoting' WHEN len(f) NOT IN (3, 5) THEN 'columns'
    WHEN c.chrom IS NULL OR NOT regexp_full_match(f[2], '[0-9]+') OR NOT regexp_full_match(f[3], '[0-9]+')
      OR NOT coalesce(TRY_CAST(f[2] AS HUGEINT) < TRY_CAST(f[3] AS HUGEINT) AND TRY_CAST(f[3] AS HUGEINT) <= c.length, false) THEN 'value'
    WHEN len(f) = 5 AND NOT (regexp_full_match(f[5], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(f[5] AS DOUBLE)), false)) THEN 'value' END AS reason
  FROM token LEFT JOIN chroms c ON c.chrom = f[1])
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CHANGES,
        "p1_statistics": _CELLS + "SELECT file_id, path, n, n_integer, n_decimal, n_text, type FROM field",
        "p2_found": _PERIODS,
        "p2_streamed": _PERIODS,
        "p4_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p4_loaded": _LINES
        + "SELECT line_id, file_id, line_no, f[1] AS chr1Name, CAST(f[2] AS BIGINT) AS start1, CAST(f[3] AS BIGINT) AS end1, CASE WHEN len(f) = 5 THEN f[4] END AS name, CASE WHEN len(f) = 5 THEN CAST(f[5] AS DOUBLE) END AS score FROM judged WHERE reason IS NULL",
    }
