"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import copies, mixing, packing, pii, tokens, topn
from strandweave.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found_copies(table(spark, d, "feature_records"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.distinct_records(table(spark, d, "feature_records")).select("record_id", "n_copies")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "loops"), ["list_id", "chr1"], "score", "_sieve_local_zscore", "loop_id", 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("list_id", "chr1", "loop_id")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return packing.store_sizes(tokens.count_tokens(table(spark, d, "documents")))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = {r["spec"]: int(r["capacity_tokens"]) for r in table(spark, d, "pack_capacity").collect()}  # a fixed table of three rows
    return packing.pack_containers(_sizes(spark, d), capacities)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return packing.share_report(_packed(spark, d))


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.faults(_packed(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_schedule(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.schedule_report(mixing.mix(sizes, targets), mixing.plans_of(sizes, targets)[0])


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    return mixing.faults(p7_mix(spark, d), table(spark, d, "mix_targets"))


#: The key of the registered query; a run of one's own gives its own.
DEMONSTRATION_KEY = b"a key for tests and demonstrations"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "given_names"), DEMONSTRATION_KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_records, p5_found, p5_ranked, p6_pack, p6_fill, p6_shares, p6_faults, p7_mix, p7_shares, p7_schedule, p7_faults, p8_found, p8_redacted)}


# Keys are marked where a known field name and an assignment follow; the text up to the next mark is the value.
_RECORDS = r"""
WITH marked AS (
  SELECT record_id, regexp_replace(rec, '(?i)["“'']?(highres[ ._-]*(?:start|end)[ ._-]*[12]|start[12]|end[12]|chr[12]|score|list[ ._-]*uid|name)["”'']?\s*[=:]', chr(1) || '\1' || chr(2), 'g') AS m
  FROM feature_records),
cells AS (
  SELECT record_id, lower(regexp_replace(split_part(p, chr(2), 1), '[ ._-]', '', 'g')) AS field, split_part(p, chr(2), 2) AS v
  FROM (SELECT record_id, unnest(string_split(m, chr(1))) AS p FROM marked) WHERE contains(p, chr(2))),
canon AS (
  SELECT DISTINCT record_id, field, CASE WHEN field = 'score' THEN CAST(CAST(regexp_extract(v, '[+-]?[0-9]+(\.[0-9]+)?') AS DECIMAL(18, 6)) AS VARCHAR)
    WHEN regexp_matches(field, '(start|end)[12]$') THEN regexp_replace(v, '[^0-9]', '', 'g')
    ELSE lower(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) END AS v
  FROM cells),
whole AS (SELECT record_id, string_agg(field || '=' || v, ';' ORDER BY field, v) AS k FROM canon GROUP BY record_id),
first AS (SELECT k, min(record_id) AS first_id, count(*) AS n_copies FROM whole GROUP BY k)
"""

_TOP = """
WITH once AS (
  SELECT DISTINCT list_id, chr1, loop_id, score, CASE WHEN isnan(_sieve_local_zscore) THEN NULL ELSE _sieve_local_zscore END AS _sieve_local_zscore
  FROM loops WHERE score IS NOT NULL AND NOT isnan(score)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY list_id, chr1 ORDER BY score DESC, _sieve_local_zscore DESC NULLS LAST, loop_id) AS INTEGER) AS rank FROM once)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _RECORDS + "SELECT first_id, record_id AS copy_id FROM whole JOIN first USING (k) WHERE record_id <> first_id",
        "p3_records": _RECORDS + "SELECT first_id AS record_id, n_copies FROM first",
        # rules that hold for any right answer: every e-mail packed whole, no container overfull, no use too many
        "p6_faults": "SELECT spec, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS cut_without_need FROM pack_capacity",
        "p7_faults": "SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source, CAST(0 AS BIGINT) AS unlisted, CAST(0 AS BIGINT) AS over_repeated, CAST(0 AS BIGINT) AS doubled FROM mix_targets",
        "p5_found": _TOP + "SELECT list_id, chr1, loop_id FROM ranked WHERE rank <= 5",
        "p5_ranked": _TOP + "SELECT list_id, chr1, loop_id, score, _sieve_local_zscore, rank FROM ranked WHERE rank <= 5",
    }
