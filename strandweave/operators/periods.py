"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Each entity is cut into coordinate tiles. An ordered disjoint-interval map per (entity, tile) is kept in keyed state:
an insertion finds its overlaps by binary search, merges them and so updates the gaps. Intervals are first merged
beside the input, then inserted per key after the shuffle, and pieces that reach over tiles are joined from the two
outermost pieces of each tile. A tile of width T can't hold more than T / 2 disjoint pieces, so state is bounded
whatever share of the rows an entity has. Of an interval over more than LONG tiles only both ends are cut into tiles;
the tiles between are one run of the entity, under which what other intervals left there is hidden.

Here the state is the map of the key at hand, as rows come sorted by key; ``streaming.periods`` keeps the same maps in
the state store of a Structured Streaming query.

Defined results: rows with a null key, a null bound or an end not after the start are ignored; intervals that touch
form one period; repeated rows change nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.session import materialize

#: Width of a tile, the rows that are merged at once beside the input, and the tiles that an interval is cut into at most.
TILE = 1 << 20
HELD = 200_000
LONG = 1024


class IntervalMap:
    """Disjoint half-open intervals in order; touching ones are one."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def merged(rows: pa.Table, keys: Sequence[str]) -> pa.Table:
    """``keys, tile, s, e`` with the overlapping and touching intervals of each key and tile as one."""
    code = np.zeros(rows.num_rows, "int64")
    for k in (*keys, "tile"):
        column = rows[k].combine_chunks().dictionary_encode("encode")
        _, code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    s, e = (rows[c].to_numpy() for c in "se")
    order = np.lexsort((s, code))
    code, s, e = code[order], s[order], e[order]
    # the furthest end so far in the group: ends as ranks, so that groups can be told apart by a sum
    ends, rank = np.unique(e, return_inverse=True)
    reach = np.maximum.accumulate(code * len(ends) + rank)
    reach = ends[reach - code * len(ends)]
    new = np.ones(len(s), bool)
    new[1:] = (code[1:] != code[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return rows.take(pa.array(order[first])).set_column(len(keys) + 1, "s", pa.array(s[first])).set_column(len(keys) + 2, "e", pa.array(reach[last]))


def _combine(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from merged(pa.Table.from_batches(held), keys).to_batches()
                held, n = [], 0
        if n:
            yield from merged(pa.Table.from_batches(held), keys).to_batches()

    return run


def tile_rows(key: tuple, m: IntervalMap) -> list[tuple]:
    """``*key, kind, s, e`` of a tile: its outermost pieces, the periods between them, and all gaps; of an entity's runs (tile null) just these."""
    last = len(m.starts) - 1
    kinds = ["run" if key[-1] is None else "edge" if i in (0, last) else "period" for i in range(last + 1)]
    rows = [(*key, kind, s, e) for kind, s, e in zip(kinds, m.starts, m.ends)]
    return rows if key[-1] is None else rows + [(*key, "gap", s, e) for s, e in m.gaps()]


def _by_key(keys: Sequence[str]):
    """Rows come sorted by key and tile; one map is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m, shape = None, IntervalMap(), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape)], [*keys, "tile", "kind", "s", "e"])

        for batch in batches:
            shape = [*(batch.schema.field(k).type for k in keys), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            rows: list[tuple] = []
            for *key, s, e in zip(*[c.to_pylist() for c in batch.columns]):
                if key != at:
                    if at is not None:
                        rows += tile_rows(tuple(at), m)
                    at, m = key, IntervalMap()
                m.insert(s, e)
            if rows:
                yield out(rows)
        if at is not None:
            yield out(tile_rows(tuple(at), m))

    return run


def cut(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int) -> DataFrame:
    """``*keys, tile, s, e``: intervals in pieces by tile; the inner tiles of a long one as a piece with a null tile."""
    clean = df.select(*keys, F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).dropna().filter("s < e")
    ends = clean.withColumns({"a": F.expr(f"(s - pmod(s, {tile}L)) div {tile}L"), "b": F.expr(f"(e - 1 - pmod(e - 1, {tile}L)) div {tile}L")})
    short = "transform(sequence(a, b), t -> named_struct('tile', t, 's', greatest(s, t * {0}L), 'e', if(t = b, e, (t + 1) * {0}L)))".format(tile)
    long = "array(named_struct('tile', a, 's', s, 'e', (a + 1) * {0}L), named_struct('tile', CAST(NULL AS BIGINT), 's', (a + 1) * {0}L, 'e', b * {0}L), named_struct('tile', b, 's', b * {0}L, 'e', e))".format(tile)
    return ends.select(*keys, F.expr(f"explode(CASE WHEN b - a <= {LONG} THEN {short} ELSE {long} END)").alias("x")).select(*keys, "x.*")


def stitch(found: DataFrame, keys: Sequence[str], start: str, end: str, tile: int) -> DataFrame:
    """``*keys, kind, start, end`` from ``tile_rows`` of all tiles. Windows hold two rows a tile and the runs."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = found.filter("kind IN ('edge', 'run')").withColumns({"reach": F.max("e").over(before), "last_tile": F.lag("tile").over(order)})
    joined = (
        edges.withColumn("n", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(order))
        .groupBy(*keys, "n")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(*keys, F.lit("period").alias("kind"), "s", "e")
    )
    # of two edges of one tile, the tile itself knows the gaps between
    between = edges.filter((F.col("reach") < F.col("s")) & ~F.col("last_tile").eqNullSafe(F.col("tile"))).select(*keys, F.lit("gap").alias("kind"), F.col("reach").alias("s"), F.col("s").alias("e"))
    inner = found.filter("kind IN ('period', 'gap')")
    if not found.filter("kind = 'run'").isEmpty():
        runs = F.max(F.when(F.col("kind") == "run", F.col("e"))).over(before)
        hidden = found.filter("kind IN ('edge', 'run')").withColumn("covered", runs).filter(f"kind = 'edge' AND covered >= (tile + 1) * {tile}L").select(*keys, "tile").distinct()
        inner = inner.join(hidden, [*keys, "tile"], "left_anti")
    return inner.select(*keys, "kind", "s", "e").unionByName(joined).unionByName(between).select(*keys, "kind", F.col("s").alias(start), F.col("e").alias(end))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start1", end: str = "end1", tile: int = TILE) -> DataFrame:
    """``*keys, kind, start, end``: kind is ``period`` for a maximal covered stretch, ``gap`` between two successive ones.

    ``tile`` should be well above the usual interval length and well below the span of an entity.
    """
    pieces = cut(df, keys, start, end, tile)
    shape = T.StructType([*(pieces.schema[k] for k in keys), *[T.StructField(c, T.LongType()) for c in ("tile", "s", "e")]])
    kinds = T.StructType([*shape.fields[:-2], T.StructField("kind", T.StringType()), *shape.fields[-2:]])
    combined = pieces.mapInArrow(_combine(keys), shape)
    found = combined.repartition(*keys, "tile").sortWithinPartitions(*keys, "tile").mapInArrow(_by_key(keys), kinds)
    return stitch(materialize(found, "tiles"), keys, start, end, tile)


def chrom_key(name: Column) -> Column:
    """A chromosome name without prefix, letter case and blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\s+", "")), "^chr", "")


def bed_rows(bed: DataFrame, chroms: DataFrame) -> DataFrame:
    """``file_id, chrom, start1, end1`` with the catalogue's names; names that are in no way one are ignored.

    ``chroms`` is the genome catalogue, whose size is fixed, so it is broadcast.
    """
    names = chroms.select(F.col("chrom").alias("known"), chrom_key(F.col("chrom")).alias("k")).dropDuplicates(["k"])
    rows = bed.select("file_id", chrom_key(F.col("chrom")).alias("k"), "start1", "end1").join(F.broadcast(names), "k")
    return rows.select("file_id", F.col("known").alias("chrom"), "start1", "end1")


def bed_periods(bed: DataFrame, chroms: DataFrame, tile: int = TILE) -> DataFrame:
    """Periods and gaps per file and chromosome."""
    return merge_intervals(bed_rows(bed, chroms), ["file_id", "chrom"], tile=tile)
