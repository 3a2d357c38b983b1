"""Column expressions of interval features. Integer division truncates; rounding is floor(x + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ["chr1", "start1", "end1", "chr2", "start2", "end2"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division of bigints."""
    return F.call_function("div", col(a), b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def mid(start: Column | str, end: Column | str) -> Column:
    return div(col(start) + col(end), 2)


def mid1() -> Column:
    return mid("start1", "end1")


def mid2() -> Column:
    return mid("start2", "end2")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def width(side: int) -> Column:
    return F.col(f"end{side}") - F.col(f"start{side}")


def resolution_called_at() -> Column:
    return F.greatest(width(1), width(2), F.lit(1).cast("bigint"))


def loop_distance() -> Column:
    """Base pairs: the smaller of the inner and the midpoint distance."""
    return F.least(F.abs(F.col("end1") - F.col("start2")), F.abs(mid1() - mid2()))


def bin_distance(resolution: int) -> Column:
    return half_up(F.abs(mid1() - mid2()) / F.lit(resolution)).cast("bigint")


def loop_code() -> Column:
    return F.concat_ws("_", *COORDS)


def anchor_key(side: int, resolution: int) -> Column:
    return F.concat_ws("_", f"chr{side}", div(mid(f"start{side}", f"end{side}"), resolution))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def pseudo_ratio(observed: Column, expected: Column, pseudo: float = 1.0) -> Column:
    return (observed + pseudo) / (expected + pseudo)


def attribute(attributes: Column | str, key: str, default: float | None = None) -> Column:
    """A number of an open attribute map, or the default."""
    number = F.try_element_at(col(attributes), F.lit(key)).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def vector_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def vector_of(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: v.try_cast("double"))


def sane_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def motif_name(name: Column, marker: str = "_HUMAN") -> Column:
    return F.substring_index(name, marker, 1)


def strand_suffix(strand: Column) -> Column:
    return F.when(strand == "+", "forward").when(strand == "-", "reverse").otherwise("none")


def tiles(start: Column, end: Column, size: int) -> Column:
    """All tiles that a half-open stretch touches; none for an empty one."""
    return F.when(end > start, F.sequence(div(start, size), div(end - 1, size))).otherwise(F.array().cast("array<bigint>"))
