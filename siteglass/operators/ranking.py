"""Exact ranks and running totals that never sort one whole group in one task.

Rows are numbered inside small buckets of the order, bucket sizes are summed along
the order, and the two are added. The result equals ``row_number`` over the whole
group, whatever the group's size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, saved

BUCKET_BITS = 16


def id_bucket(c: Column, bits: int = BUCKET_BITS) -> Column:
    """Bucket of a dense sequence number; keeps the order of the numbers."""
    return F.shiftright(c.cast("long"), bits)


def running_total(
    df: DataFrame,
    keys: list[str],
    buckets: list[Column],
    order: list[Column],
    amount: Column,
    out: str,
) -> DataFrame:
    """Sum of ``amount`` over the rows of a group up to and including each row.

    ``buckets`` must be a prefix of ``order`` or a monotone function of it, and
    ``order`` must be unique inside a group.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    df = df.withColumns({**dict(zip(names, buckets)), "_amount": amount.cast("long")})
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = (
        df.groupBy(*keys, *names)
        .agg(F.sum("_amount").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    numbered = df.withColumn("_inside", F.sum("_amount").over(inside))
    left, right = numbered.alias("l"), sizes.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, *names]]
    joined = left.join(right, same, "inner")
    kept = [F.col(f"l.{c}") for c in df.columns if c not in (*names, "_amount")]
    return joined.select(*kept, (F.col("l._inside") + F.col("r._before")).alias(out))


def ranked(
    df: DataFrame, keys: list[str], buckets: list[Column], order: list[Column], out: str = "rank"
) -> DataFrame:
    """``row_number`` inside each group, computed bucket by bucket."""
    return running_total(df, keys, buckets, order, F.lit(1), out)


def positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """``row_number`` over a whole table, without bringing it into one task.

    Rows are range-sorted; a row's number is its place in its partition plus the rows of the
    partitions before. Of the partitions, one count each goes through the driver. ``order``
    should be unique; rows that tie are numbered in any order.
    """
    given = saved(df, "rows")
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(
        ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "positions"
    )
    discard(given)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("start"))
    parts = sorted((r["_part"], r["n"], r["start"]) for r in sizes.collect())
    before = [0, *accumulate(n for _, n, _ in parts)]
    shifts = [(part, rows - start) for (part, _, start), rows in zip(parts, before)]
    table = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    joined = placed.join(table, "_part")
    return joined.withColumn(out, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")
