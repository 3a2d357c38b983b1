"""Views over the star-schema tables that have the shapes of interval lists, matrices and signals.

Written once, for DuckDB; the Spark form differs in integer division and quotes, and in the extent of chromosomes and
norms: the SQL ends at 60 Mb, Spark where the contacts do, if that is farther.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strandweave.session import table

_SITE = "'chr' || CAST(l_suppkey % 5 + 1 AS STRING)"
_X = "l_partkey * 2500"
_Y = "l_partkey * 2500 + CAST(l_quantity AS BIGINT) * 20000 + l_orderkey % 4 * 5000"

VIEWS = {
    "fx_chroms": "SELECT 'chr' || CAST(n_nationkey + 1 AS STRING) AS chrom, CAST(n_nationkey AS INT) AS chr_index, CAST(60000000 AS BIGINT) AS length, n_nationkey < 4 AS is_autosome FROM nation WHERE n_nationkey < 5",
    "fx_loops": f"""SELECT l_returnflag AS list_id, {_SITE} AS chr1, {_X} AS start1, {_X} + 1000 * (1 + l_linenumber % 3) AS end1, {_SITE} AS chr2, {_Y} AS start2, {_Y} + 1000 * (1 + l_orderkey % 3) AS end2,
        {_X} + l_orderkey % 3500 AS local_x, {_Y} + (l_orderkey + l_linenumber * 100) % 3500 AS local_y,
        l_discount * 10 AS score_1k, l_tax * 12.5 AS score_2k, l_quantity / 50 AS score_5k, l_discount * 5 + l_tax * 6 AS score_10k, l_orderkey AS loop_key FROM lineitem""",
    "fx_stem_loops": """SELECT DISTINCT 'S' || CAST(l_linenumber AS STRING) AS stem, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS status,
        'chr' || CAST(l_suppkey % 5 + 1 AS STRING) AS chr1, (l_partkey // 20) * 50000 AS start1, (l_partkey // 20) * 50000 + 10000 AS end1,
        'chr' || CAST(l_suppkey % 5 + 1 AS STRING) AS chr2, (l_partkey // 20) * 50000 + (1 + CAST(l_quantity AS BIGINT) // 10) * 200000 AS start2, (l_partkey // 20) * 50000 + (1 + CAST(l_quantity AS BIGINT) // 10) * 200000 + 10000 AS end2 FROM lineitem""",
    "fx_contacts": f"""SELECT l_linestatus AS experiment, r.resolution, {_SITE} AS chr1, {_SITE} AS chr2, ({_X}) // r.resolution AS bin_x, ({_Y}) // r.resolution AS bin_y, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS counts
        FROM lineitem CROSS JOIN (SELECT CAST(5000 AS BIGINT) AS resolution UNION ALL SELECT CAST(50000 AS BIGINT)) r GROUP BY 1, 2, 3, 4, 5, 6""",
    "fx_inter": """SELECT 'chr' || CAST(l_suppkey % 5 + 1 AS STRING) AS chr1, 'chr' || CAST(l_partkey % 5 + 1 AS STRING) AS chr2, CAST(100000 AS BIGINT) AS resolution, l_orderkey * 3 % 200 AS bin_x, l_partkey * 7 % 200 AS bin_y,
        CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS counts FROM lineitem WHERE l_suppkey % 5 < l_partkey % 5 GROUP BY 1, 2, 3, 4, 5""",
    "fx_norms": """SELECT 'VC' AS norm, 'chr' || CAST(n_nationkey + 1 AS STRING) AS chrom, CAST(5000 AS BIGINT) AS resolution, t.bin, 0.5e0 + CAST((t.bin * 37 + n_nationkey * 11) % 200 AS DOUBLE) / 100e0 AS value
        FROM nation CROSS JOIN (SELECT UNNEST(RANGE(0, 12001)) AS bin) t WHERE n_nationkey < 5""",
    "fx_anchors": """SELECT 'chr' || CAST(p_partkey % 5 + 1 AS STRING) AS chrom, p_partkey * 2500 + p_size * 13 % 500 AS "start", p_partkey * 2500 + p_size * 13 % 500 + 20 AS "end",
        CASE WHEN p_partkey % 2 = 0 THEN 'Forward_' ELSE 'Reverse_' END || CAST(p_partkey AS STRING) AS name, CAST(p_size AS DOUBLE) / 25e0 AS score FROM part""",
    "fx_signal": """SELECT event_type AS track, 'chr' || CAST(user_id % 5 + 1 AS STRING) AS chrom, event_id * 500 AS "start", event_id * 500 + 500 * (1 + event_id % 4) AS "end", value, event_id AS line_no FROM events""",
    "fx_bed": """SELECT event_type AS file_id, 'chr' || CAST(user_id % 5 + 1 AS STRING) AS chrom, event_id % 300 * 200 AS "start", event_id % 300 * 200 + 50 + event_id % 5 * 100 AS "end" FROM events""",
    "fx_fimo": """SELECT p_brand || CASE WHEN p_size % 3 = 0 THEN '_OTHER' ELSE '_HUMAN.H11MO.A' END AS motif_id, 'chr' || CAST(p_partkey % 5 + 1 AS STRING) AS chrom, p_partkey * 2500 AS "start", p_partkey * 2500 + p_size AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""",
}
#: Contacts of all experiments together, in one aggregate.
MERGED = VIEWS["fx_contacts"].replace("l_linestatus AS experiment, ", "").replace("GROUP BY 1, 2, 3, 4, 5, 6", "GROUP BY 1, 2, 3, 4, 5")
#: Contacts before they are added up, for operators that add what one pixel has themselves: rows of one resolution.
READS = f"SELECT l_linestatus AS experiment, CAST({{resolution}} AS BIGINT) AS resolution, {_SITE} AS chr1, {_SITE} AS chr2, ({_X}) // {{resolution}} AS bin_x, ({_Y}) // {{resolution}} AS bin_y, CAST(l_quantity AS BIGINT) AS counts FROM lineitem"
TABLES = {"fx_chroms": "nation", "fx_norms": "nation", "fx_anchors": "part", "fx_fimo": "part", "fx_signal": "events", "fx_bed": "events"}
#: The last 5 kb bin of norms: that of the farthest contact and two more, so that its window and the ends of its loop fit.
_LAST = f"(SELECT greatest(12000L, max({_Y}) // 5000 + 2) AS last FROM lineitem)"
BLOCK = 4096


def _to_the_end(spark: SparkSession, name: str, text: str) -> str:
    """The view with the extent that the data has. Bins are made in blocks, by as many tasks as a shuffle has."""
    if name == "fx_chroms":
        return text.replace("CAST(60000000 AS BIGINT)", "greatest(60000000L, last * 5000)").replace("FROM nation", f"FROM nation CROSS JOIN {_LAST} e")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    blocks = f"(SELECT /*+ REPARTITION({parts}, n_nationkey, block) */ * FROM (SELECT n_nationkey, last, EXPLODE(SEQUENCE(0L, last // {BLOCK})) AS block FROM nation CROSS JOIN {_LAST} e WHERE n_nationkey < 5))"
    bins = f"(SELECT n_nationkey, EXPLODE(SEQUENCE(block * {BLOCK}, least(block * {BLOCK} + {BLOCK - 1}, last))) AS bin FROM {blocks})"
    return text.replace("FROM nation CROSS JOIN (SELECT UNNEST(RANGE(0, 12001)) AS bin) t", f"FROM {bins} t")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view in Spark."""
    base = TABLES.get(name, "lineitem")
    text = MERGED if name == "fx_contacts_merged" else VIEWS[name]
    used = {base}
    if name in ("fx_chroms", "fx_norms"):
        text, used = _to_the_end(spark, name, text), {base, "lineitem"}
    text = text.replace("//", " div ").replace('"', "`")
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def reads(spark: SparkSession, sf_dir: str, resolution: int) -> DataFrame:
    """The rows that ``fx_contacts`` adds up at one resolution."""
    text = READS.format(resolution=resolution).replace("//", " div ").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


def with_views(sql: str) -> str:
    """DuckDB text with the fixture views it uses in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    return f"WITH {heads},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"
