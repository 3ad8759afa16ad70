"""Running totals and places over a whole order, without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..session import materialise


def running_total(rows: DataFrame, order: list[str], n: str | None = None, name: str = "before") -> DataFrame:
    """rows with the total of n (or the number of rows, without n) over all rows before each, in an order without ties.

    Rows are dealt by ranges of the order; each part adds up for itself, and what the parts before it hold is added
    from a table of one row a part. The dealt rows are a table, so that a lost task can't deal them anew.
    """
    part, total, base, inside = fresh((*rows.columns, name), "_part", "_sum", "_base", "_inside")
    dealt = materialise(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    value = F.col(n).cast("bigint") if n else F.lit(1).cast("bigint")
    parts = dealt.groupBy(part).agg(F.sum(value).alias(total))
    earlier = F.coalesce(F.sum(total).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(value).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn(inside, within).join(F.broadcast(parts.select(part, earlier.alias(base))), part)
    return placed.withColumn(name, F.col(base) + F.col(inside)).drop(part, base, inside)
