"""Tables laid out in an order, without sorting all in one task or giving all rows of one value to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import prepared

_AT_BITS = 33  # of monotonically_increasing_id() that hold a row's place in its partition


def laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `_part`, the number of their range of `order`, and `_at`, their place in it.

    One range shuffle, into as many ranges as the session shuffles to. Ranges are of all of `order`, so a value that
    many rows have in its first column is split where they differ in the others. The layout is kept as a checkpoint:
    ranges come from a sample, and all that is derived from them has to see the same ones.
    """
    prepared(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    return placed.select(*rows.columns, F.shiftright("_id", _AT_BITS).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << _AT_BITS) - 1)).alias("_at"))


def up_to_here() -> W:
    """The rows of a range up to the current one."""
    return W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)


def before_range() -> W:
    """The ranges before the current one, for tables with a row for each."""
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: list[str], first: int = 0, name: str = "pos") -> DataFrame:
    """`rows` with their place in `order`, from `first`: the place in their range, and the sizes of the ranges before."""
    at = laid_out(rows, order)
    before = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before_range()), F.lit(0)).alias("_before"))
    out = at.join(F.broadcast(before), "_part")  # a row for each range
    return out.select(*rows.columns, (F.col("_at") + F.col("_before") + first).alias(name))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """`rows` with their place in their group in `order`, from 0; a group may be of any size, and lie in many ranges.

    The groups' pieces by range join without a hint: while there are few, their rows stay where they lie.
    """
    at = laid_out(rows, [group, *order])
    pieces = at.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = at.join(pieces.select(group, "_part", (before - F.col("_first")).alias("_shift")), [group, "_part"])
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
