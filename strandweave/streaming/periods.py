"""Continuous periods over a stream of intervals.

Per entity and tile an ordered disjoint-interval map is the keyed state of a Structured Streaming query; every batch
inserts its intervals by binary search and emits the periods and gaps that the tile then has, under the tile's next
version. A tile of width T holds T / 2 pieces at most, so state is bounded by tiles. ``settled`` joins the last
versions of all tiles to whole periods, as the batch form does. Rows with a null key or bound, or an end not after the
start, are ignored; intervals over more than LONG tiles are handled as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandweave.operators.periods import TILE, IntervalMap, cut, stitch
from strandweave.session import shared_dir


def stream_periods(stream: DataFrame, keys: Sequence[str], start: str = "start1", end: str = "end1", tile: int = TILE) -> DataFrame:
    """``*keys, tile, version, kind, start, end`` of the tiles that changed; write it in update mode."""
    pieces = cut(stream, keys, start, end, tile)
    names = [*keys, "tile", "version", "kind", start, end]
    longs = {c: T.StructField(c, T.LongType()) for c in ("tile", "version", start, end)}
    shape = T.StructType([*(pieces.schema[k] for k in keys), longs["tile"], longs["version"], T.StructField("kind", T.StringType()), longs[start], longs[end]])
    held = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("version", T.LongType())])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, version = IntervalMap(), 0
        if state.exists:
            starts, ends, version = state.get
            m.starts, m.ends = list(starts), list(ends)
        for pdf in batches:
            for a, b in zip(pdf["s"].tolist(), pdf["e"].tolist()):
                m.insert(a, b)
        state.update((m.starts, m.ends, version + 1))
        rows = [(*key, version + 1, "period", a, b) for a, b in zip(m.starts, m.ends)] + [(*key, version + 1, "gap", a, b) for a, b in m.gaps()]
        yield pd.DataFrame(rows, columns=names)

    return pieces.groupBy(*keys, "tile").applyInPandasWithState(update, shape, held, "update", GroupStateTimeout.NoTimeout)


def settled(emitted: DataFrame, keys: Sequence[str], start: str = "start1", end: str = "end1", tile: int = TILE) -> DataFrame:
    """``*keys, kind, start, end``: the whole periods and gaps after all that ``stream_periods`` emitted."""
    rows = emitted.select(*keys, "tile", "version", "kind", F.col(start).alias("s"), F.col(end).alias("e"))
    last = rows.groupBy(*keys, "tile").agg(F.max("version").alias("version"), F.max(F.struct("version", (-F.col("s")).alias("s"))).getField("s").alias("low"), F.max(F.struct("version", "e")).getField("e").alias("high"))
    last = last.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "tile", "version")], "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "tile", "version")]
    outer = (F.col("s") == -F.col("low")) | (F.col("e") == F.col("high"))
    kind = F.when(F.col("kind") == "gap", F.when(F.col("tile").isNotNull(), "gap")).when(F.col("tile").isNull(), "run").when(outer, "edge").otherwise("period")
    found = rows.join(last, same).select(*keys, "tile", kind.alias("kind"), "s", "e").filter("kind IS NOT NULL")
    return stitch(found, keys, start, end, tile)


def streamed_periods(stream: DataFrame, keys: Sequence[str], start: str = "start1", end: str = "end1", tile: int = TILE) -> DataFrame:
    """Run a stream over all that is there now and give its settled periods; state and output lie in the shared folder."""
    from uuid import uuid4

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/strandweave-stream-{uuid4().hex}"
    shape = stream_periods(stream, keys, start, end, tile)
    query = (
        shape.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    )
    query.awaitTermination()
    return settled(spark.read.schema(shape.schema).parquet(f"{path}/out/batch=*"), keys, start, end, tile)
