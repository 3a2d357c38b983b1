"""Schemas that drift between files: path-value maps, path-type statistics, change report, typed projection.

Every line of a file becomes a map from field path to (text, raw type), once. Statistics per file and path decide each
field's type; successive files of a stem are compared; a projection casts all files to one set of typed fields and
names the values that would not cast.

Lines meet what is known of their file on (file, chunk of line numbers), so a file may hold any share of all lines;
statistics and renames are aggregated before their shuffles. Histories of a field are kept in windows over its stem,
which hold a row for each file.

Defined results: a null line or a line with fewer cells than its header has missing values there; surplus cells are
ignored; a header that repeats a name keeps the first column of it; files without a header have no fields; files
with a null stem, seq or id take no part; repeated rows change nothing; empty tables give empty results. Only the
columns named here are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import materialize

#: Number of leading coordinate columns, and the texts that mean a missing value.
COORDINATES = 6
MISSING = ("", "NA", "NaN", ".")
#: Whole cells of a line that are an integer or another decimal number, and the marks that stand for them.
INTEGER = r"(?<![^\t])[+-]?[0-9]+(?![^\t])"
DECIMAL = r"(?<![^\t])[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?![^\t])"
MARKS, NO_MARK = ("\x01", "\x02"), "\x03"
#: Lines of a file that are met by one row of its header.
CHUNK = 50_000


def _cells(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"\r\z", ""), "\t", -1)


def _marked(line: Column) -> Column:
    """The line with a mark in place of each number; both kinds are told apart for all cells at once, in compiled code."""
    clean = F.when(line.rlike("[\x01\x02]"), F.translate(line, "".join(MARKS), NO_MARK * 2)).otherwise(line)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"\r\z", ""), INTEGER, MARKS[0]), DECIMAL, MARKS[1])


def headers(lines: DataFrame) -> DataFrame:
    """``file_id, chunks, fields``: the attribute fields of each file in their order, null where a name is repeated, and its chunks of lines."""
    names = F.slice(F.col("cells"), COORDINATES + 1, F.greatest(F.size("cells"), F.lit(1)))
    return (
        lines.filter(F.col("line").isNotNull() & F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.min(F.when(F.col("line_no") == 1, F.col("line"))).alias("line"), F.max("line_no").alias("last"))
        .filter(F.col("line").isNotNull())
        .select("file_id", F.floor(F.col("last") / CHUNK).cast("int").alias("chunks"), _cells(F.col("line")).alias("cells"))
        .select("file_id", "chunks", F.transform(names, lambda x, i: F.when(F.array_position(names, x) - 1 == i, x)).alias("fields"))
    )


def _chunked(heads: DataFrame) -> DataFrame:
    return heads.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks")))).drop("chunks")


def load_path_values(lines: DataFrame, heads: DataFrame, *others: str) -> DataFrame:
    """``file_id, line_no, loop, values, *others``: per line a map path -> struct(text, raw); missing values are absent. ``others`` are columns of ``heads``."""
    body = lines.filter((F.col("line_no") > 1) & F.col("line").isNotNull()).select("file_id", "line_no", "line", F.floor(F.col("line_no") / CHUNK).cast("int").alias("chunk"))
    cut = body.join(_chunked(heads), ["file_id", "chunk"]).withColumn("cells", _cells(F.col("line"))).withColumn("marks", F.split(_marked(F.col("line")), "\t", -1))
    # fields, cells and marks go side by side, each array made once a line
    behind = lambda c: F.slice(c, COORDINATES + 1, F.greatest(F.size(c), F.lit(1)))
    side = F.arrays_zip(F.col("fields").alias("path"), behind("cells").alias("text"), behind("marks").alias("mark"))
    present = F.filter(side, lambda x: x["path"].isNotNull() & x["text"].isNotNull() & ~x["text"].isin(*MISSING))
    raw = lambda mark: F.when(mark == MARKS[0], "integer").when(mark == MARKS[1], "decimal").otherwise("text")
    entry = F.transform(present, lambda x: F.struct(x["path"], F.struct(x["text"].alias("text"), raw(x["mark"]).alias("raw"))))
    return cut.select("file_id", "line_no", F.array_join(F.slice("cells", 1, COORDINATES), "\t", "").alias("loop"), *others, F.map_from_entries(entry).alias("values"))


def statistics_of(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """``file_id, path, n, n_integer, n_decimal, n_text, type``; type is null where no value is present."""
    counted = (
        cells.select("file_id", F.explode("values").alias("path", "value"))
        .groupBy("file_id", "path")
        .agg(F.count("*").alias("n"), *[F.count(F.when(F.col("value.raw") == t, 1)).alias(f"n_{t}") for t in ("integer", "decimal", "text")])
    )
    fields = heads.select("file_id", F.explode(F.array_compact("fields")).alias("path"))
    kind = F.when(F.col("n_text") > 0, "text").when(F.col("n_decimal") > 0, "decimal").when(F.col("n") > 0, "integer")
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "n_integer", "n_decimal", "n_text")]
    return fields.join(counted, ["file_id", "path"], "left").select("file_id", "path", *zeros, kind.alias("type"))


def path_statistics(lines: DataFrame) -> DataFrame:
    """``statistics_of`` all ``lines``."""
    heads = materialize(headers(lines), "heads")
    return statistics_of(load_path_values(lines, heads), heads)


def _in_stems(files: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` of all files with a place in a stem: ``stem, ord, file_after``, the ``gone`` fields that the next file hasn't and the ``new`` ones that the one before hadn't.

    Those are null where that file is missing, and ``drops`` and ``gains`` say whether there are any.
    """
    stem = Window.partitionBy("stem").orderBy("seq", "file_id")
    once = files.select("file_id", "stem", "seq").filter(F.col("stem").isNotNull() & F.col("seq").isNotNull() & F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    paths = F.coalesce(F.array_compact("fields"), F.array().cast("array<string>"))
    placed = once.join(heads, "file_id", "left").select(
        "file_id", "stem", "seq", "fields", "chunks", paths.alias("paths")
    ).select("*", F.row_number().over(stem).alias("ord"), F.lead("file_id").over(stem).alias("file_after"), F.lag("paths").over(stem).alias("before"), F.lead("paths").over(stem).alias("after"))
    return placed.select(
        "file_id", "stem", "ord", "file_after", "fields", "chunks", F.array_except("paths", "after").alias("gone"), F.array_except("paths", "before").alias("new"),
        (F.size(F.array_except("after", "paths")) > 0).alias("gains_next"), (F.size(F.array_except("before", "paths")) > 0).alias("dropped_last"),
    )


def _history(placed: DataFrame, statistics: DataFrame) -> DataFrame:
    """``file_id, stem, ord, path, n..., type`` with the run of successive files that a field stays in, and its earlier type there."""
    field = Window.partitionBy("stem", "path").orderBy("ord")
    run = Window.partitionBy("stem", "path", "run").orderBy("ord")
    return (
        placed.select("file_id", "stem", "ord").join(statistics, "file_id")
        .withColumn("run", F.col("ord") - F.row_number().over(field))
        .withColumn("run_start", F.first("ord").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("type_before", F.last("type", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    )


def _read(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files in their stems, the path-value maps of their lines, and the history of their fields; each is written once."""
    placed = materialize(_in_stems(files, headers(lines)), "stems")
    # a rename needs a field that is gone and a new one between the same two files
    leaving = F.when(F.col("gains_next"), F.col("gone")).alias("gone")
    coming = F.when(F.col("dropped_last"), F.col("new")).alias("new")
    heads = placed.filter("fields IS NOT NULL").select("file_id", "fields", "chunks", "file_after", leaving, coming)
    cells = materialize(load_path_values(lines, heads, "file_after", "gone", "new"), "cells")
    history = materialize(_history(placed, statistics_of(cells, heads)), "history")
    return placed, cells, history


def _renames(cells: DataFrame) -> DataFrame:
    """``file_id, field_before, field_after`` of the gone and new fields that hold the same texts in every loop that both files hold."""

    def held(paths: str) -> Column:
        each = F.transform(paths, lambda p: F.struct(p.alias("path"), F.try_element_at("values", p).getField("text").alias("text")))
        return F.filter(each, lambda x: x["text"].isNotNull())

    sides = [
        cells.filter(f"size({paths}) > 0").select(F.col(later).alias("later"), "loop", F.lit(side).alias("side"), F.explode(held(paths)).alias("x"))
        for side, paths, later in ((0, "gone", "file_after"), (1, "new", "file_id"))
    ]
    by_loop = sides[0].unionByName(sides[1]).groupBy("later", "loop").agg(F.collect_set(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("x"))).alias("b"))
    pairs = by_loop.filter("size(a) > 0 AND size(b) > 0").select("later", F.explode("a").alias("a"), "b").select("later", "a", F.explode("b").alias("b"))
    return (
        pairs.groupBy(F.col("later").alias("file_id"), F.col("a.path").alias("field_before"), F.col("b.path").alias("field_after"))
        .agg(F.min(F.col("a.text") == F.col("b.text")).alias("equal"))
        .filter("equal")
        .drop("equal")
    )


def _changes(placed: DataFrame, history: DataFrame, renames: DataFrame) -> DataFrame:
    out = ("file_id", "change_kind", "field_before", "field_after")
    renamed = renames.select("file_id", F.lit("renamed").alias("change_kind"), "field_before", "field_after")
    gone = placed.filter("file_after IS NOT NULL").select(F.col("file_after").alias("file_id"), F.explode("gone").alias("field_before"))
    new = placed.select("file_id", F.explode("new").alias("field_after"))
    removed = gone.join(renames, ["file_id", "field_before"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), "field_before", F.lit("").alias("field_after"))
    added = new.join(renames, ["file_id", "field_after"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("field_before"), "field_after")
    retyped = history.filter((F.col("ord") > F.col("run_start")) & (F.col("type") != F.col("type_before"))).select(
        "file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("field_before"), F.col("path").alias("field_after")
    )
    # both sides of a rename have a value, so the last type of the gone field is its own
    before = placed.filter("file_after IS NOT NULL").select("file_id", "file_after").join(history, "file_id").select(F.col("file_after").alias("file_id"), F.col("path").alias("field_before"), F.col("type").alias("type_before"))
    after = history.select("file_id", F.col("path").alias("field_after"), F.col("type").alias("type_after"))
    retyped_with_name = (
        renames.join(before, ["file_id", "field_before"]).join(after, ["file_id", "field_after"]).filter("type_before <> type_after").select("file_id", F.lit("retyped").alias("change_kind"), "field_before", "field_after")
    )
    return renamed.select(*out).unionByName(retyped_with_name).unionByName(removed).unionByName(added).unionByName(retyped)


def field_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_id, change_kind, field_before, field_after``: every change of a file against the one before it in its stem."""
    placed, cells, history = _read(files, lines)
    return _changes(placed, history, materialize(_renames(cells), "renames"))


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold over rows sorted by stem, ord and whether a row is a rename; the state is the names of the stem at hand.

    A renamed field keeps its first name. A field that comes back keeps its name unless that went on with a rename;
    a field whose name another one still has gets a number.
    """
    stem, held, used = None, {}, {}
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.stem != stem:
                stem, held, used = r.stem, {}, {}
            field = held.pop(r.renamed_from, None) if isinstance(r.renamed_from, str) else held.get(r.path)
            if field is None:
                used[r.path] = used.get(r.path, 0) + 1
                field = r.path if used[r.path] == 1 else f"{r.path}#{used[r.path]}"
            held[r.path] = field
            out.append((r.stem, r.path, r.run_start, field))
        yield pd.DataFrame(out, columns=["stem", "path", "run_start", "field"])


def _unified(cells: DataFrame, history: DataFrame, share: float = 0.5) -> DataFrame:
    """``file_id, path, field, type``: the first name that a field had in its stem, and one type for all its files.

    The type is text where more than ``share`` of the present values are neither integer nor decimal, else decimal
    where any is one, else integer; a field that never has a value is text.
    """
    renames = _renames(cells).groupBy("file_id", F.col("field_after").alias("path")).agg(F.min("field_before").alias("renamed_from"))
    starts = history.filter(F.col("ord") == F.col("run_start")).join(renames, ["file_id", "path"], "left").select("stem", "ord", "path", "run_start", "renamed_from")
    lineage = starts.repartition("stem").sortWithinPartitions("stem", "ord", F.col("renamed_from").isNull(), "path").mapInPandas(_follow, "stem string, path string, run_start int, field string")
    named = materialize(history.join(lineage, ["stem", "path", "run_start"]), "lineage")
    kind = F.when((F.col("all_n") == 0) | (F.col("all_text") > share * F.col("all_n")), "text").when(F.col("all_decimal") > 0, "decimal").otherwise("integer")
    types = named.groupBy("stem", "field").agg(F.sum("n").alias("all_n"), F.sum("n_text").alias("all_text"), F.sum("n_decimal").alias("all_decimal")).select("stem", "field", kind.alias("unified"))
    return named.join(types, ["stem", "field"]).select("file_id", "stem", "path", "field", F.col("unified").alias("type"))


def unified_fields(files: DataFrame, lines: DataFrame, share: float = 0.5) -> DataFrame:
    """``_unified`` of all ``lines``."""
    _, cells, history = _read(files, lines)
    return _unified(cells, history, share)


def typed_table(files: DataFrame, lines: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """All lines as one table: coordinates, one typed map per type, wanted fields as columns, and the casts that failed.

    ``columns`` maps a field's unified name to the name of its own double column (null where absent or not a number).
    ``failed_casts`` lists ``field=text`` for present values that aren't of the field's unified type.
    """
    placed, read, history = _read(files, lines)
    wanted = _unified(read, history).groupBy("file_id", "stem").agg(F.collect_list(F.struct("path", "field", "type")).alias("fields"))
    cells = F.filter(
        F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["type"].alias("type"), F.try_element_at("values", f["path"]).getField("text").alias("text"))),
        lambda x: x["text"].isNotNull(),
    )
    wanted = _chunked(wanted.join(placed.select("file_id", "chunks"), "file_id"))
    rows = read.withColumn("chunk", F.floor(F.col("line_no") / CHUNK).cast("int")).join(wanted, ["file_id", "chunk"]).select("file_id", "stem", "line_no", "loop", cells.alias("cells"))
    texts = F.map_from_entries(F.array_distinct(F.transform("cells", lambda x: F.struct(x["field"], x["text"]))))
    rows = rows.withColumn("by_field", texts) if columns else rows

    def typed(kind: str, to: str) -> Column:
        of = F.filter("cells", lambda x: (x["type"] == kind) & x["text"].try_cast(to).isNotNull())
        return F.map_from_entries(F.array_distinct(F.transform(of, lambda x: F.struct(x["field"], x["text"].try_cast(to)))))

    def fails(x: Column) -> Column:
        return ((x["type"] == "integer") & x["text"].try_cast("bigint").isNull()) | ((x["type"] == "decimal") & x["text"].try_cast("double").isNull())

    def own(field: str) -> Column:
        return F.try_element_at("by_field", F.lit(field)).try_cast("double")

    parts = F.split("loop", "\t")
    names = ("chr1", "start1", "end1", "chr2", "start2", "end2")
    place = [F.get(parts, F.lit(i)).alias(n) if n.startswith("chr") else F.get(parts, F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(names)]
    failed = F.transform(F.filter("cells", fails), lambda x: F.concat(x["field"], F.lit("="), x["text"]))
    return rows.select(
        "file_id", "stem", "line_no", *place, *[own(field).alias(name) for field, name in (columns or {}).items()],
        typed("integer", "bigint").alias("integers"), typed("decimal", "double").alias("decimals"), typed("text", "string").alias("texts"), failed.alias("failed_casts"),
    )
