"""Dense row numbers and neighbours over a whole table, without a window that gathers it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmark.sources.scratch import stored

_LOCAL_BITS = (1 << 33) - 1


def in_order(df: DataFrame, order: list[str], name: str = "ordered", keep: list[str] | None = None) -> DataFrame:
    """Range-partition and sort by ``order``, and store (only ``keep``, if given) with the place of each row: ``_part``, ``_pos``.

    The table is stored, so that later passes see the same ranges also when a task is run again. The order must be
    total: rows with equal keys have no defined place. No number of ranges is given, so the adaptive planner merges
    small ones: ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` can be as high as the largest table needs.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))
    )
    return stored(placed if keep is None else placed.select(*keep, "_part", "_pos"), name)


def _running_before(per_part: DataFrame, value: str, out: str) -> DataFrame:
    """Running sum of earlier partitions. One row per range partition, so one task and a broadcast are bounded."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(out))


def number_rows(df: DataFrame, order: list[str], out: str = "row_no", keep: list[str] | None = None) -> DataFrame:
    """Dense numbers 0, 1, 2, … by ``order`` over the whole table.

    One range exchange and one stored table (of the columns ``keep``, if given); the offsets are counts per partition.
    """
    placed = in_order(df, order, "numbered", keep)
    offsets = _running_before(placed.groupBy("_part").agg(F.count("*").alias("_n")), "_n", "_offset")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def run_ids(df: DataFrame, order: list[str], changes: Column, out: str = "run_no") -> DataFrame:
    """Number the runs of rows in ``order``; a run starts where ``changes`` differs from the row before.

    Neighbours are compared inside each range partition; the first row of a partition is compared with the last row
    of the partition before it, taken from one row per partition. So a file or model with a third of all rows is
    still spread over many tasks.
    """
    placed = in_order(df.withColumn("_key", changes), order, "runs")
    inside = Window.partitionBy("_part").orderBy("_pos")
    edges = placed.groupBy("_part").agg(F.max_by("_key", "_pos").alias("_last"))
    # empty partitions have no row here, so the last key of the nearest earlier partition is taken
    earlier = edges.select(
        "_part", F.lag(F.struct("_last")).over(Window.orderBy("_part")).alias("_before")
    )
    lagged = F.lag(F.struct("_key")).over(inside)
    started = placed.withColumn("_prev", lagged).join(F.broadcast(earlier), "_part")
    prev = F.when(F.col("_pos") == 0, F.col("_before._last")).otherwise(F.col("_prev._key"))
    first = F.when(F.col("_pos") == 0, F.col("_before").isNull()).otherwise(F.lit(False))
    flagged = stored(
        started.withColumn("_start", (first | ~F.col("_key").eqNullSafe(prev)).cast("long")).drop("_prev", "_before"),
        "run-starts",
    )
    counts = _running_before(flagged.groupBy("_part").agg(F.sum("_start").alias("_n")), "_n", "_offset")
    running = F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        flagged.withColumn("_run", running)
        .join(F.broadcast(counts), "_part")
        .withColumn(out, F.col("_run") + F.col("_offset") - 1)
        .drop("_part", "_pos", "_key", "_start", "_run", "_offset")
    )
