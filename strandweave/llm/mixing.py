"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the run, linear in time, that starts near the corpus' own proportions and whose
integral is the source's demand of tokens. A document's place in the cumulative tokens of its source is inverted
through the integral into a training position in [0, 1), and documents are range-sorted by position. Where a source
can't meet its demand with its repeats, it gives all it has and the others take its shortage in proportion to their
shares, as far as they have any; the report states what came out.

Defined results: documents of unlisted or null sources have share 0 and aren't used; a source without documents gives
nothing; items without tokens take part and weigh nothing; repeated rows are separate documents; an empty table gives
an empty mix; extra columns are not read. Cumulative sums are taken in two levels, so no source is held by one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.tokens import source_key

BUCKET_TOKENS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """Of one source: target share, cap of repeats, tokens it has, tokens to give, and its weights at both ends."""

    source: str
    target: float
    repeats: int
    supply: int
    demand: float
    start: float
    end: float


def plan(targets: dict[str, tuple[float, int]], supply: dict[str, int], wanted: float, tilt: float = 1.0) -> list[Plan]:
    """Demands within the caps, then linear schedules with them as integrals; ``tilt`` 0 keeps weights constant."""
    cap = {s: supply.get(s, 0) * r for s, (_, r) in targets.items()}
    demand, open_, left = {s: 0.0 for s in targets}, {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}, wanted
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        short = {s for s in open_ if cap[s] <= left * targets[s][0] / weight}
        if not short:
            demand |= {s: left * targets[s][0] / weight for s in open_}
            break
        for s in short:
            demand[s] = float(cap[s])
        left -= sum(demand[s] for s in short)
        open_ -= short
    total = sum(demand.values())
    if not total:
        return []
    share = {s: d / total for s, d in demand.items() if d > 0}
    natural = sum(supply.get(s, 0) for s in share)
    lean = {s: supply.get(s, 0) / natural - w for s, w in share.items()}
    # weights may not fall below 0 at the end
    most = min([1.0, *(share[s] / x for s, x in lean.items() if x > share[s])])
    return [Plan(s, targets[s][0], targets[s][1], supply.get(s, 0), demand[s], w + tilt * most * lean[s], w - tilt * most * lean[s]) for s, w in sorted(share.items())]


def _inverse(cumulative: Column, total: float) -> Column:
    """t with total * (start * t + (end - start) * t^2 / 2) = cumulative."""
    u, v, c = F.col("start"), F.col("end"), cumulative / F.lit(total)
    d = v - u
    root = F.sqrt(F.greatest(u * u + 2 * d * c, F.lit(0.0)))
    # this form is stable for small slopes, where it becomes c / u
    return F.least(2 * c / (u + root), F.lit(1.0))


def plans_of(sized: DataFrame, targets: DataFrame, wanted: int | None = None, tilt: float = 1.0) -> tuple[list[Plan], int]:
    """The plan of every listed source that gives anything, and the wanted total, that of all documents unless given.

    The driver reads as many rows as there are listed sources.
    """
    listed = {r["s"]: (float(r["w"]), int(r["r"])) for r in targets.groupBy(source_key(F.col("source")).alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).filter("s IS NOT NULL AND w IS NOT NULL AND r IS NOT NULL").collect()}
    clean = sized.filter("doc_id IS NOT NULL")
    sums = clean.groupBy(F.when(F.col("source").isin(*listed), F.col("source")).alias("s")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("t")).collect() if listed else []
    supply = {r["s"]: int(r["t"]) for r in sums}
    total = wanted if wanted is not None else sum(supply.values())
    return plan(listed, supply, total, tilt), total


def mix(sized: DataFrame, targets: DataFrame, wanted: int | None = None, tilt: float = 1.0, seed: int = 0) -> DataFrame:
    """``doc_id, source, repeat_no, tokens, position``, sorted by position.

    ``sized`` is ``doc_id, source, tokens``; ``targets`` is ``source, target_share, max_repeats``.
    """
    clean = sized.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens")).filter("doc_id IS NOT NULL")
    plans, total = plans_of(sized, targets, wanted, tilt)
    spark = sized.sparkSession
    shape = "source string, supply bigint, demand double, start double, end double"
    ways = spark.createDataFrame([(p.source, p.supply, p.demand, p.start, p.end) for p in plans], shape)
    given = sum(p.demand for p in plans)
    buckets = max(1, math.ceil(total / BUCKET_TOKENS))

    epochs = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("demand") / F.col("supply")).cast("int") - 1, F.lit(0)))
    used = clean.join(F.broadcast(ways), "source").withColumn("epoch", F.explode(epochs)).withColumn("h", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    placed = used.withColumn("bucket", F.least(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)))
    key = ("source", "epoch", "bucket")
    sums_before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*key).agg(F.sum("tokens").alias("t")).select(*key, F.coalesce(F.sum("t").over(sums_before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, list(key))
    middle = F.col("epoch") * F.col("supply") + F.col("offset") + F.col("inside") + F.col("tokens") / 2
    chosen = run.withColumn("middle", middle).filter(F.col("middle") <= F.col("demand"))
    return chosen.select("doc_id", "source", (F.col("epoch") + 1).cast("int").alias("repeat_no"), "tokens", _inverse(F.col("middle"), given or 1.0).alias("position")).orderBy("position", "doc_id", "repeat_no")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, uses, documents, most_repeats, max_repeats`` of every listed source."""
    got = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses")).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count("*").alias("documents"), F.max("uses").alias("most_repeats")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(Window.partitionBy())).alias("actual_share"), zero("tokens"), zero("uses"), zero("documents"), zero("most_repeats"), "max_repeats"
    )


def schedule_report(mixed: DataFrame, plans: list[Plan], steps: int = 10) -> DataFrame:
    """``step, source, scheduled_share, actual_share``: tokens by stretch of the run against the integral of the source's weights over it."""
    shape = "step int, source string, scheduled_share double"
    rows = [(k, p.source, p.start + (p.end - p.start) * (k + 0.5) / steps) for p in plans for k in range(steps)]
    wanted = mixed.sparkSession.createDataFrame(rows, shape)
    got = mixed.groupBy(F.least(F.floor(F.col("position") * steps), F.lit(steps - 1)).cast("int").alias("step"), "source").agg(F.sum("tokens").alias("t"))
    shares = got.withColumn("actual_share", F.col("t") / F.sum("t").over(Window.partitionBy("step")))
    return wanted.join(shares, ["step", "source"], "left").select("step", "source", "scheduled_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"))


def faults(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, unlisted, over_repeated, doubled`` of every listed source: uses that break a rule; ``unlisted`` counts those of no listed source."""
    listed = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("cap"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("repeat_no").alias("numbers"), F.max("repeat_no").alias("last"))
    met = uses.join(F.broadcast(listed), "source", "left")
    strange = met.filter("cap IS NULL").agg(F.count("*").alias("unlisted"))
    by = met.groupBy("source").agg(F.count(F.when(F.col("n") > F.col("cap"), 1)).alias("over_repeated"), F.count(F.when((F.col("numbers") < F.col("n")) | (F.col("last") != F.col("n")), 1)).alias("doubled"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return listed.join(by, "source", "left").select("source", F.lit(int(strange.first()["unlisted"])).cast("bigint").alias("unlisted"), zero("over_repeated"), zero("doubled"))
