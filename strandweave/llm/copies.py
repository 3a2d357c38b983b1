"""Duplicates hidden by formatting: dictionary-encoded canonical values, sorted integer tuples, grouped tuples.

A record is cut into raw (field, value) cells, once. Each distinct raw cell is canonicalised and numbered once, from 0 on; every
canonical cell has the least number of those written so for its integer; a record becomes the sorted tuple of its integers, and equal tuples are
copies. Cells that stand for a thousandth of all cells or more are at most a thousand: they meet their integers by a
broadcast of that bounded size, so no value, however many records share it, gathers in one task. The others are spread
by a shuffle.

Canonical values: text compares by its letters and digits in lower case. Numbers are read whole: marks that group
digits, a plus sign, leading zeros and zeros at the end of a fraction don't count, a typographic minus is a minus, a
zero has no sign, and powers of ten are written out. What isn't a number in a number's field compares as trimmed text
in lower case, so different texts there are never equal.

Defined results: null or empty texts, and texts without any field, hold no record and take no part; a record id that
occurs in several rows is one record with the union of their fields; of very long texts and names every field counts;
a record that has a field twice with equal values has it once; ties don't arise, as the smallest id stands for its
copies; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import materialize

#: A separator counts only where a field name and an assignment follow, so values may hold separators.
BETWEEN = r"""[;,|\t\n\r]\s*+(?=["“']?[A-Za-z_][\w .\-]*+["”']?\s*+[=:])"""
MARK, OTHER = "\x01", "\x02"
#: Canonical names of the fields by how their values compare; other fields compare as text.
POSITION = r"^(?:highres)?(?:start|end)[12]$"
NUMBER = ("score",)
#: Signs that mean a minus, and marks that group digits.
MINUS = "−–﹣－"
GROUPING = r"_'’´`  \x{00a0}\x{2009}\x{202f}"
CELL = ["_h", "raw_field", "raw_value"]
BLANK, OPENING, CLOSING = " \t\n\r\x0b\x0c\xa0\u2009\u202f", "\"“”'‘’«»{([", "\"“”'‘’«»})];,.|"
#: A cell is common if at least one cell in so many is like it.
COMMON = 1000


def cells(records: DataFrame, record_id: str = "record_id", text: str = "rec") -> DataFrame:
    """``record_id, raw_field, raw_value``: the cells as written."""
    clean = F.when(F.contains(F.col(text), F.lit(MARK)), F.translate(F.col(text), MARK, OTHER)).otherwise(F.col(text))
    marked = F.regexp_replace(clean, BETWEEN, MARK)
    pieces = records.filter(F.col(record_id).isNotNull()).select(F.col(record_id).alias("record_id"), F.explode(F.split(marked, MARK)).alias("piece"))
    found = pieces.select("record_id", "piece", F.instr("piece", "=").alias("a"), F.instr("piece", ":").alias("b"))
    cut = found.select("record_id", "piece", F.expr("CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END").alias("at")).filter("at > 0")
    return cut.select("record_id", F.expr("substr(piece, 1, at - 1)").alias("raw_field"), F.trim(F.expr("substr(piece, at + 1)")).alias("raw_value"))


def _hashed(raw: DataFrame) -> DataFrame:
    """With a hash by which sorts and joins compare first."""
    return raw.withColumn("_h", F.xxhash64("raw_field", "raw_value"))


def canonical_field(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))


def _bare(raw: Column) -> Column:
    """Without what encloses or ends a value, and with plain minus signs."""
    inner = F.rtrim(F.ltrim(raw, F.lit(BLANK + OPENING)), F.lit(BLANK + CLOSING))
    return F.when(inner.rlike(f"[{MINUS}]"), F.translate(inner, MINUS, "-" * len(MINUS))).otherwise(inner)


def canonical(cells: DataFrame) -> DataFrame:
    """``cells`` (``raw_field, raw_value``) with ``field`` and ``value``.

    A position may be grouped by dots and commas too; a decimal number by commas before three digits each. The steps
    are columns of their own, so none is computed twice, and few, so that the compiled code stays small enough for the JVM to optimise.
    """
    plain, kind = r"^(?:[1-9][0-9]*|0)\z", F.col("_kind")
    steps = cells.withColumn("field", canonical_field(F.col("raw_field"))).filter("field <> ''")
    steps = steps.withColumn("_kind", F.when(F.col("field").isin(*NUMBER), 2).when(F.col("field").rlike(POSITION), F.when(F.col("raw_value").rlike(plain), 3).otherwise(1)).otherwise(0))
    steps = steps.withColumn("_bare", F.when(kind.isin(1, 2), _bare(F.col("raw_value"))))
    joined = [F.regexp_replace("_bare", rf"(?<=[0-9])(?:[{GROUPING}]+|{marks})(?=[0-9])", "") for marks in (r"[.,](?=[0-9]{3}(?:[.,][0-9]{3})*\z)", r",(?=[0-9]{3}(?![0-9]))")]
    steps = steps.withColumn("_number", F.when(kind == 1, joined[0]).when(kind == 2, joined[1]))
    written_out = F.when(F.col("_number").rlike(r"^[+-]?[0-9]*\.?[0-9]*[eE][+-]?[0-9]+\z"), F.col("_number").try_cast("decimal(38,18)").cast("string"))
    steps = steps.withColumn("_number", F.regexp_replace(F.coalesce(written_out, "_number"), r"^([+-]?)\.(?=[0-9])", "$10."))
    short = F.regexp_replace("_number", r"^\+?(-?)0*([0-9]+)(?:(\.[0-9]*[1-9])0*|\.0*)?\z", "$1$2$3")
    text = F.lower(F.regexp_replace("raw_value", r"[^\p{L}\p{N}]", ""))
    value = F.when(kind == 0, text).when(kind == 3, F.col("raw_value")).when(F.col("_number").rlike(r"^[+-]?[0-9]+(?:\.[0-9]*)?\z"), F.regexp_replace(short, r"^-0\z", "0")).otherwise(F.lower("_bare"))
    return steps.withColumn("value", value).drop("_kind", "_bare", "_number")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``code``: counted from 0 on without holes, in each partition behind the sum of those before it.

    Numbers are stored with their rows, as numbering isn't repeatable when a lost task runs again.
    """
    held = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "canonical")
    part, within = F.shiftright("_n", 33).alias("_part"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition of the shuffle that wrote them
    sizes = held.groupBy(part).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(*rows.columns, (F.col("_before") + within).alias("code"))


def dictionary(raw: DataFrame) -> DataFrame:
    """``_h, raw_field, raw_value, n, code``: each distinct raw cell with its count and the integer of its canonical cell, the least of those that are written so."""
    distinct = _hashed(raw).groupBy(*CELL).agg(F.count("*").alias("n"))
    numbered = _numbered(canonical(distinct).withColumn("_v", F.xxhash64("field", "value")))
    return numbered.withColumn("code", F.min("code").over(Window.partitionBy("_v", "field", "value"))).select(*CELL, "n", "code")


def encode(records: DataFrame, record_id: str = "record_id", text: str = "rec") -> DataFrame:
    """``record_id, codes``: each record as the sorted tuple of its cells' integers."""
    raw = materialize(cells(records, record_id, text), "cells")
    known = materialize(dictionary(raw), "dictionary")
    share = raw.count() / COMMON
    common, rest = known.filter(F.col("n") >= share), known.filter(F.col("n") < share).drop("n")
    marked = _hashed(raw).join(F.broadcast(common.drop("n")), CELL, "left")
    met = marked.filter("code IS NOT NULL").select("record_id", "code")
    spread = marked.filter("code IS NULL").drop("code").join(rest, CELL).select("record_id", "code")
    # cells of a record come from everywhere, so nothing is gained by collecting them before the shuffle
    return met.unionByName(spread).repartition("record_id").groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def copy_groups(encoded: DataFrame) -> DataFrame:
    """``_t, codes, first_id, n_copies``, ``_t`` being a hash of the tuple; counted before and after the shuffle, so a group may hold any share of the rows."""
    return encoded.groupBy(F.xxhash64("codes").alias("_t"), "codes").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n_copies"))


def found_copies(records: DataFrame, record_id: str = "record_id", text: str = "rec") -> DataFrame:
    """``first_id, copy_id``: the smallest id of each group with each of the others."""
    encoded = materialize(encode(records, record_id, text), "tuples")
    groups = copy_groups(encoded).filter("n_copies > 1")
    return encoded.withColumn("_t", F.xxhash64("codes")).join(groups, ["_t", "codes"]).filter(F.col("record_id") != F.col("first_id")).select("first_id", F.col("record_id").alias("copy_id"))


def distinct_records(records: DataFrame, record_id: str = "record_id", text: str = "rec") -> DataFrame:
    """``record_id, n_copies, text``: each record once, as its first row writes it."""
    groups = copy_groups(encode(records, record_id, text)).select(F.col("first_id").alias("record_id"), "n_copies")
    written = records.groupBy(F.col(record_id).alias("record_id")).agg(F.min(text).alias("rec"))
    return groups.join(written, "record_id")
