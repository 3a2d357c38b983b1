"""Rows that fail to parse: load the valid ones, keep the others with the first reason that holds.

Lines are cut into (row, column, value) cells, the cells meet a rule table, failed validations are aggregated by row
and the clean rows are what an anti-join leaves. Only failed cells are shuffled.

Defined results: null, blank, comment and header lines are neither loaded nor bad; a final carriage return isn't part
of a line; repeated lines are judged each for itself by its id; very long lines are cut by built-in splitting, without
recursion; an empty table gives empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
SKIPPED = r"^(?:#|track|browser)"
DIGITS = r"^[0-9]+\z"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: column, validation, rank of the reason, reason
RULES = [
    ("quotes", "closed", 1, "quoting"),
    ("width", "three_or_five", 2, "columns"),
    ("chr1Name", "known", 3, "value"),
    ("start1", "digits", 3, "value"),
    ("end1", "digits", 3, "value"),
    ("span", "ordered_within", 3, "value"),
    ("score", "finite", 3, "value"),
]
HELD = "￿"


def _quotes_closed(parts: Column) -> Column:
    """Judged on the text between double quotes: even parts lie outside of enclosed fields, odd ones inside."""
    last = F.size(parts) - 1
    outside = F.filter(parts, lambda x, i: i % 2 == 0)

    def fits(x: Column, i: Column) -> Column:
        first, final = i == 0, i == F.size(outside) - 1
        opens, closes = x.endswith("\t"), x.startswith("\t")
        return F.when(first & final, F.lit(True)).when(x == "", True).when(first, opens).when(final, closes).otherwise(opens & closes)

    return (last % 2 == 0) & F.forall(F.transform(outside, fits), lambda x: x)


def _fields(parts: Column) -> Column:
    """Cut at tabs outside of enclosed fields; enclosing quotes go, doubled ones become one, other fields lose outer spaces."""
    held = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, "\t", HELD)).otherwise(x)), '"')

    def clean(x: Column) -> Column:
        inner = F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.when(x.startswith('"'), F.translate(inner, HELD, "\t")).otherwise(F.trim(x))

    return F.transform(F.split(held, "\t", -1), clean)


def tokenize(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """``line_id, file_id, line_no, closed, fields, length`` of the lines that are data; length is that of a known chromosome.

    ``chroms`` is the genome catalogue, whose size is fixed, so it is broadcast.
    """
    raw = lines.select("line_id", "file_id", "line_no", F.regexp_replace("raw", r"\r\z", "").alias("raw"))
    first = F.trim(F.get(F.split("raw", "\t", 2), F.lit(0)))
    data = raw.filter(F.col("raw").isNotNull() & (F.trim(F.translate("raw", "\t\r", "  ")) != "") & ~F.col("raw").rlike(SKIPPED) & ~first.isin("chrom", '"chrom"'))
    cut = data.select("line_id", "file_id", "line_no", F.split("raw", '"', -1).alias("parts")).select("line_id", "file_id", "line_no", _quotes_closed(F.col("parts")).alias("closed"), _fields(F.col("parts")).alias("fields"))
    catalogue = chroms.groupBy(F.col("chrom").alias("known")).agg(F.max("length").alias("length"))
    return cut.join(F.broadcast(catalogue), F.get("fields", F.lit(0)) == F.col("known"), "left").drop("known")


def _cells() -> Column:
    """The cells of a line; a line with broken quotes or a wrong width has no other cells than those."""

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"))

    at = lambda i: F.get("fields", F.lit(i))
    width = F.size("fields")
    base = [cell("quotes", F.col("closed"))]
    narrow = [cell("chr1Name", F.coalesce(F.col("length"), F.lit(-1))), cell("start1", at(1)), cell("end1", at(2)), cell("span", F.concat_ws("|", at(1), at(2), F.coalesce(F.col("length"), F.lit(-1))))]
    return (
        F.when(~F.col("closed"), F.array(*base))
        .when(width == 3, F.array(*base, cell("width", width), *narrow))
        .when(width == 5, F.array(*base, cell("width", width), *narrow, cell("score", at(4))))
        .otherwise(F.array(*base, cell("width", width)))
    )


def _valid() -> Column:
    v = F.col("value")
    span = F.split(v, "\\|")
    start, end, length = (F.get(span, F.lit(i)).try_cast("decimal(38,0)") for i in range(3))
    number = v.try_cast("double")
    rule = F.col("rule")
    return F.coalesce(
        F.when(rule == "closed", v == "true")
        .when(rule == "three_or_five", v.isin("3", "5"))
        .when(rule == "known", v != "-1")
        .when(rule == "digits", v.rlike(DIGITS))
        .when(rule == "ordered_within", (start < end) & (end <= length))
        .when(rule == "finite", v.rlike(NUMBER) & (F.abs(number) < float("inf"))),
        F.lit(False),
    )


def failed_cells(tokens: DataFrame) -> DataFrame:
    """``line_id, column, value, rank, reason`` of every validation that fails. The rule table has seven rows."""
    rules = tokens.sparkSession.createDataFrame(RULES, "column string, rule string, rank int, reason string")
    return tokens.select("line_id", F.explode(_cells()).alias("cell")).select("line_id", "cell.*").join(F.broadcast(rules), "column").filter(~_valid())


def rejected(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """``line_id, reason, n_failed, columns``: lines that can't be loaded, their first reason and all columns that fail."""
    return (
        failed_cells(tokenize(lines, chroms))
        .groupBy("line_id")
        .agg(F.min(F.struct("rank", "reason")).getField("reason").alias("reason"), F.count("*").alias("n_failed"), F.array_sort(F.collect_set("column")).alias("columns"))
    )


def loaded(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """``line_id, file_id, line_no, chr1Name, start1, end1, name, score`` of the lines that load; 3 fields leave name and score null."""
    tokens = tokenize(lines, chroms)
    at = lambda i: F.get("fields", F.lit(i))
    return tokens.join(rejected(lines, chroms).select("line_id"), "line_id", "left_anti").select(
        "line_id", "file_id", "line_no", at(0).alias("chr1Name"), at(1).try_cast("bigint").alias("start1"), at(2).try_cast("bigint").alias("end1"), at(3).alias("name"), at(4).try_cast("double").alias("score")
    )
