"""Places of rows in an order, found without a sort or a window in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.sources.shared import save


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place", weight: Column | None = None, total: str = "") -> DataFrame:
    """rows with `name`: how many rows of the same `by` come before in `order` (nulls first), or the sum of their weight; and, if `total` names
    a column, with the whole number or sum.

    Rows are range-partitioned by both, so one value of `by` is spread over tasks, sorted and saved with their place in the task.
    What lies before a task's rows is the sum over the tasks before it: one row for each task and value of `by` that meets it. Rows
    that are equal in both get different places. rows is read twice; save it first if that is costly. Two columns, _at and _task,
    must be free.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    at = save(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), name)
    least = at.groupBy("_task", *by).agg(F.min("_at").alias("_least"), (F.count("*") if weight is None else F.sum(weight)).alias("_sum"))
    keys = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row a task
    before = least.withColumn("_before", F.coalesce(F.sum("_sum").over(keys.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_sum").over(keys))
    same = F.lit(True)
    side = before.select(F.col("_task").alias("_t"), *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], "_least", "_before", "_total")
    for i, c in enumerate(by):
        same = same & at[c].eqNullSafe(F.col(f"_by_{i}"))
    met = at.join(side, (at["_task"] == F.col("_t")) & same)
    own = F.col("_at") - F.col("_least")
    if weight is not None:
        own = F.coalesce(F.sum(weight).over(W.partitionBy("_task", *by).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return met.select(*rows.columns, (F.col("_before") + own).alias(name), *([F.col("_total").alias(total)] if total else []))
