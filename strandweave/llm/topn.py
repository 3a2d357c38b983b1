"""The N best items of every group, with a consistent tie rule.

Rows are ranked by score, second score and identifier. A first rank in which repeated rows tie lets the optimiser keep
the first N items of each group in every task before the shuffle and again after it; repeats are dropped among what is
left, and ``row_number`` gives the ranks, all in the partitioning of the one shuffle. So a group of any size sends N
items a task at most (with their repeats).

Defined results: items whose score is null or NaN take no part; a null or NaN second score comes last among ties; the
identifier decides what is still tied; groups whose key is null are groups of their own; an empty table gives an empty
result; extra columns are not read. Repeated rows of an item count once. Where they may differ in their scores,
``repeats_agree=False`` takes the best of them first, by an aggregate that has to shuffle every item. Spark prunes by
rank only up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); beyond it results are the same, unpruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Sequence[str], score: str, then: str, identifier: str, n: int = 5, repeats_agree: bool = True) -> DataFrame:
    """``*group, identifier, score, then, rank`` with rank from 1 to ``n``."""
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).cast("double")
    scored = df.select(*group, F.col(identifier).alias("_id"), number(score).alias("_score"), number(then).alias("_then")).filter(F.col("_score").isNotNull() & F.col("_id").isNotNull())
    order = Window.partitionBy(*group).orderBy(F.desc("_score"), F.desc_nulls_last("_then"), F.asc("_id"))
    if repeats_agree:
        first = scored.withColumn("_tied", F.dense_rank().over(order)).filter(F.col("_tied") <= n)
        ranked = first.groupBy(*group, "_id").agg(F.any_value("_score").alias("_score"), F.any_value("_then").alias("_then")).withColumn("rank", F.row_number().over(order))
    else:
        once = scored.groupBy(*group, "_id").agg(F.max(F.struct("_score", "_then")).alias("best")).select(*group, "_id", "best.*")
        ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(*group, F.col("_id").alias(identifier), F.col("_score").alias(score), F.col("_then").alias(then), "rank")
