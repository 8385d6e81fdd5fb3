"""Global order statistics without a single-task window (M-5 ranks, L-4/L-6 heads, A-7 shards).

``Window.orderBy(...)`` without a partition moves every row into one task. Here a global running
sum is built the way a distributed prefix sum is: range-partition by the order key, number rows
inside each partition (an Arrow-batched pass over the sorted partition), total each partition, and
add the prefix sum of the earlier partitions' totals (numbered rows are checkpointed once, see below).
The totals table has one row per partition
(a bounded, known size), so broadcasting it is safe.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clashlens.session import ensure_checkpoint_dir


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: Sequence[Column | str], weight: str | None = None, out: str = "cum",
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``weight`` (1 when None) over all rows up to and including this one in ``order``.

    ``order`` must be a total order (end it with a unique key) for the result to be deterministic.
    """
    p = _partitions(df, num_partitions)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    ranged = (df.withColumn("_w", w).repartitionByRange(p, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_local", T.LongType())])

    def number(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = 0
        for pdf in it:
            cs = np.cumsum(pdf["_w"].to_numpy(dtype=np.int64)) + acc
            if len(cs):
                acc = int(cs[-1])
            pdf["_local"] = cs
            yield pdf

    # The range bounds come from sampling: two plan branches over the range exchange could each
    # sample their own bounds. The locally numbered rows are therefore written once to the shared
    # checkpoint folder (reliable, survives executor loss), and the totals read the same rows.
    ensure_checkpoint_dir(df.sparkSession)
    local = ranged.mapInPandas(number, schema).checkpoint(eager=True)
    # one row per range partition: a bounded table, its broadcast never grows with the data
    totals = local.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(before), F.lit(0)).cast("long").alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off", "_w"))


HEX_DIGITS = 4       # of a hexadecimal hash: 65,536 buckets of about equal size


def hash_numbers(df: DataFrame, hashed: str, ties: Sequence[str], out: str, groups: Sequence[str] = (),
                 limit: Column | None = None, lead: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``: the 1-based place of each row in the order of a hexadecimal hash column, then ``ties``.

    With ``groups`` places count within each group; columns in ``lead`` (of few values) come before the hash in the order. The first digits of the hash cut the order into buckets;
    one aggregation counts them (at most 16^HEX_DIGITS rows a group, which bounds its broadcast), running
    sums give where each begins, and places inside a bucket are a window over that bucket alone. With
    ``limit`` (largest place wanted, by group) buckets that begin beyond it are left out before any sort.
    """
    g, first = list(groups), list(lead)
    rows = df.withColumn("_bucket", F.substring(hashed, 1, HEX_DIGITS))
    counts = rows.groupBy(*g, *first, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*g).orderBy(*first, "_bucket") if g else Window.orderBy(*first, "_bucket")
    earlier = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*g, *first, "_bucket", F.coalesce(earlier, F.lit(0)).cast("long").alias("_before"))
    if limit is not None:
        starts = starts.where(F.col("_before") < limit)
    inside = Window.partitionBy(*g, *first, "_bucket").orderBy(hashed, *ties)
    rows = (rows.join(F.broadcast(starts), [*g, *first, "_bucket"]).withColumn(out, F.col("_before") + F.row_number().over(inside))
            .drop("_bucket", "_before"))
    return rows if limit is None else rows.where(F.col(out) <= limit)


def row_number(df: DataFrame, order: Sequence[Column | str], out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Global 1-based row number in ``order`` (a total order)."""
    return running_sum(df, order, None, out, num_partitions)


def value_ranks(counts: DataFrame, groups: Sequence[str], value: str, out: str, num_partitions: int | None = None) -> DataFrame:
    """(groups, value, out): average rank of each distinct value, from rows (groups, value, _c) with its count.

    Ties share the mean of their positions. Only distinct values are sorted; a value that stands in a
    third of all rows is one row here.
    """
    g = list(groups)
    cum = running_sum(counts.select(*g, value, "_c"), [*g, value], "_c", "_cum", num_partitions)
    # rows of earlier groups are included in _cum; subtract where this group starts
    if g:
        start = cum.groupBy(*g).agg(F.min(F.col("_cum") - F.col("_c")).alias("_start"))
        cum = cum.join(start, g)
    else:
        cum = cum.withColumn("_start", F.lit(0).cast("long"))
    return cum.select(*g, value, (F.col("_cum") - F.col("_c") - F.col("_start") + (F.col("_c") + 1) / 2.0).alias(out))


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str, num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = average rank (ties share the mean of their positions) of ``value`` within ``groups``."""
    g = list(groups)
    counts = df.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(value_ranks(counts, g, value, out, num_partitions), [*g, value])
