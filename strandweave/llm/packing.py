"""Filling fixed-capacity containers: deficit round-robin over source queues.

Items fall into blocks by their id. In each block every container is a window: each source's deficit grows by its
target share of the capacity, the source with the largest deficit gives its largest item that fits, and what is left
of a deficit goes on to the next window. The deficits a block starts with follow from the token sums of the blocks
before it, so they are carried across partitions without running them one after the other. The last room of a
container goes to the item that fits best, whatever its source. An item is cut only if it exceeds the capacity: into
full pieces and a rest.

Defined results: every row is an item, so repeated rows are packed as often as they come; a null source is a source of
its own; items without tokens go into a container of their block and take no room; an empty table gives no container;
extra columns are not read. Memory of a task is that of a block, whose size is set in tokens and items.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import materialize

#: A block holds about so many tokens, and so many items, at most; a task up to so many blocks.
BLOCK_TOKENS, BLOCK_ITEMS, BLOCKS_EACH = 4_000_000, 200_000, 64
SCHEMA = "spec string, container string, doc_id bigint, source string, piece int, n_pieces int, token_start bigint, tokens bigint, container_tokens bigint, capacity bigint"


class Queue:
    """Items of one source by size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list[tuple]] = {}

    def put(self, size: int, item: tuple) -> None:
        held = self.items.get(size)
        if held is None:
            self.items[size] = [item]
            insort(self.sizes, size)
        else:
            held.append(item)

    def fitting(self, room: int) -> int:
        """The largest size that fits, 0 if none does."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int) -> tuple:
        held = self.items[size]
        item = held.pop()
        if not held:
            del self.items[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return item


def pack(items: Sequence[tuple[int, str, int]], capacity: int, shares: dict[str, float], deficits: dict[str, float]) -> list[list[tuple]]:
    """Containers of ``(doc_id, source, piece, n_pieces, token_start, tokens)`` for items ``(doc_id, source, tokens)``."""
    queues: dict[str, Queue] = {}
    containers: list[list[tuple]] = []
    empty = []
    deficits = dict(deficits)
    for doc, source, tokens in sorted(items, key=lambda x: (x[0], x[2], x[1])):
        if tokens <= 0:
            empty.append((doc, source, 0, 1, 0, 0))
            continue
        n = -(-tokens // capacity)
        for k in range(n):
            size = min(capacity, tokens - k * capacity)
            piece = (doc, source, k, n, k * capacity, size)
            queues.setdefault(source, Queue()).put(size, piece)
    while queues:
        for s, share in shares.items():
            deficits[s] = deficits.get(s, 0.0) + share * capacity
        held, room = [], capacity
        while room:
            sizes = {s: n for s, q in queues.items() if (n := q.fitting(room))}
            if not sizes:
                break
            best = max(sizes, key=lambda s: (sizes[s], deficits.get(s, 0.0), s))
            # what fits best closes a container; before that the source that is owed most goes first
            pick = best if held and (sizes[best] == room or 4 * room <= capacity) else max(sizes, key=lambda s: (deficits.get(s, 0.0), s))
            size = sizes[pick]
            held.append(queues[pick].take(size))
            deficits[pick] = deficits.get(pick, 0.0) - size
            room -= size
            if not queues[pick].sizes:
                del queues[pick]
        containers.append(held)
    if empty:
        if not containers:
            containers.append([])
        containers[-1] += empty
    return containers


def pack_containers(sized: DataFrame, capacities: dict[str, int], shares: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pack ``sized`` (``doc_id, source, tokens``) for every named capacity.

    ``shares`` are target token proportions by source; without them the sources' own proportions, with which all
    sources last to the end. The driver sees two sums. A block knows of the sources it holds only, so their number
    isn't bounded.
    """
    if any(c <= 0 for c in capacities.values()):
        raise ValueError("a capacity must be positive")
    named = sized.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens")).filter("doc_id IS NOT NULL")
    total, items = (int(x or 0) for x in named.agg(F.sum("tokens"), F.count("*")).first())
    blocks = max(1, -(-total // block_tokens), -(-items // block_items))
    placed = named.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    if shares is None:
        share = named.groupBy("source").agg((F.sum("tokens") / F.lit(max(total, 1))).alias("share"))
    else:
        share = sized.sparkSession.createDataFrame(list(shares.items()), "source string, share double")
    held = placed.groupBy("block", "source").agg(F.sum("tokens").alias("t"))
    own_before = F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each block
    all_before = held.groupBy("block").agg(F.sum("t").alias("all")).select("block", F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    owed = (
        held.select("block", "source", zero(own_before).alias("own")).join(all_before, "block").join(share, "source", "left")
        .select(F.col("block").alias("of_block"), F.col("source").alias("of_source"), F.coalesce("share", F.lit(0.0)).alias("share"), (zero(F.col("all")) * F.coalesce("share", F.lit(0.0)) - F.col("own")).alias("owed"))
    )
    specs = sorted(capacities.items())

    def run(key: tuple, items: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = []
        listed = list(zip(items["doc_id"].tolist(), items["source"].tolist(), items["tokens"].tolist()))
        deficits, targets = dict(zip(start["of_source"], start["owed"])), dict(zip(start["of_source"], start["share"]))
        for spec, capacity in specs:
            for n, held in enumerate(pack(listed, capacity, targets, deficits)):
                filled = sum(p[5] for p in held)
                rows += [(spec, f"{spec}-{key[0]}-{n}", *p, filled, capacity) for p in held]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # blocks are small in bytes and long in work, so they must not be coalesced by size
    parts = max(min(blocks, 4096), -(-blocks // BLOCKS_EACH))
    return placed.repartition(parts, "block").groupBy("block").cogroup(owed.repartition(parts, "of_block").groupBy("of_block")).applyInPandas(run, SCHEMA)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, the least number that could hold all tokens, tokens, mean and least fill, pieces of cut items."""
    once = packed.groupBy("spec", "container").agg(F.max("container_tokens").alias("held"), F.max("capacity").alias("capacity"), F.sum((F.col("n_pieces") > 1).cast("int")).alias("cut"))
    return once.groupBy("spec").agg(
        F.count("*").alias("containers"), F.ceil(F.sum("held") / F.max("capacity")).alias("least_containers"), F.sum("held").alias("tokens"), (F.sum("held") / F.sum("capacity")).alias("fill"),
        F.min(F.col("held") / F.col("capacity")).alias("least_fill"), F.sum("cut").alias("pieces_of_cut_items"),
    )


def share_report(packed: DataFrame, window_tokens: int = 65_536) -> DataFrame:
    """``spec, source, share, windows, mean_share, mean_off, most_off``: how the shares of windows of successive containers differ from the share in all.

    A window holds containers of ``window_tokens`` together, at least one; the last one of a block may hold fewer.
    """
    at = F.regexp_extract("container", r"-(\d+)-(\d+)\z", 1).cast("bigint").alias("block"), F.regexp_extract("container", r"-(\d+)-(\d+)\z", 2).cast("bigint").alias("no")
    parts = packed.select("spec", "source", "tokens", "capacity", *at).withColumn("window", F.floor(F.col("no") * F.col("capacity") / F.greatest(F.lit(window_tokens), F.col("capacity"))))
    cells = parts.groupBy("spec", "block", "window", "source").agg(F.sum("tokens").alias("t"))
    windows = cells.groupBy("spec", "block", "window").agg(F.sum("t").alias("all")).filter("all > 0")
    totals = cells.groupBy("spec", "source").agg(F.sum("t").alias("t"))
    shares = totals.join(totals.groupBy("spec").agg(F.sum("t").alias("all")), "spec").select("spec", "source", (F.col("t") / F.col("all")).alias("share"))
    met = cells.join(windows, ["spec", "block", "window"]).join(shares, ["spec", "source"])
    off = F.abs(F.col("t") / F.col("all") - F.col("share"))
    counted = met.groupBy("spec", "source").agg(F.max("share").alias("share"), F.count("*").alias("held"), F.sum(F.col("t") / F.col("all")).alias("sum_share"), F.sum(off).alias("sum_off"), F.max(off).alias("most_off"))
    # windows without a source are off by its whole share
    n = windows.groupBy("spec").agg(F.count("*").alias("windows"))
    return counted.join(n, "spec").select(
        "spec", "source", "share", "windows", (F.col("sum_share") / F.col("windows")).alias("mean_share"), ((F.col("sum_off") + (F.col("windows") - F.col("held")) * F.col("share")) / F.col("windows")).alias("mean_off"),
        F.when(F.col("held") < F.col("windows"), F.greatest("most_off", "share")).otherwise(F.col("most_off")).alias("most_off"),
    )


def faults(packed: DataFrame) -> DataFrame:
    """``spec, documents, overfull, incomplete, cut_without_need``: documents that are packed, and how many containers or documents break a rule."""
    docs = packed.groupBy("spec", "doc_id").agg(F.max("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, F.col("n_pieces"))).alias("due"), F.max("n_pieces").alias("most"))
    by_doc = docs.groupBy("spec").agg(
        F.count("*").alias("documents"), F.count(F.when(~F.col("pieces").eqNullSafe(F.col("due")), 1)).alias("incomplete"), F.count(F.when((F.col("most") > 1) & (F.col("tokens") <= F.col("capacity")), 1)).alias("cut_without_need")
    )
    over = packed.groupBy("spec", "container").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("capacity")).groupBy("spec").agg(F.count(F.when(F.col("t") > F.col("capacity"), 1)).alias("overfull"))
    return by_doc.join(over, "spec")


def store_sizes(sized: DataFrame) -> DataFrame:
    """Sizes are read several times; texts are tokenised once."""
    return materialize(sized, "sizes")
