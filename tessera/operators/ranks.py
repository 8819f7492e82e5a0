"""Global positions without a single-task window: a range shuffle, counts by partition, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def materialised(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with each row's place (from 0) in the order given, which should be total; a column of that name is replaced.

    The rows are dealt by ranges and numbered in each; only one count for each partition meets in one task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at, part, total, before = (fresh(df, c) for c in ("_at", "_part", "_n", "_before"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    dealt = materialised(dealt)
    of = F.shiftright(at, 33)
    counts = dealt.groupBy(of.alias(part)).agg(F.count("*").alias(total))
    offsets = counts.select(part, (F.sum(total).over(Window.orderBy(part)) - F.col(total)).alias(before))
    joined = dealt.withColumn(part, of).join(F.broadcast(offsets), part)  # a row for each partition
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before)
