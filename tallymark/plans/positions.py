"""Ranks, tiles and exact quantiles by range-partitioned positions: no window over the whole table and no task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merkle import in_key_order


def tiles(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """rows with `tile` (from 1): cut in key order into `parts` runs of sizes at most one apart, the longer ones first."""
    placed = in_key_order(rows, keys)
    size = placed.agg(F.count("*").alias("size"))  # one row
    short, extra = F.expr(f"size div {parts}"), F.col("size") % parts
    cut = extra * (short + 1)
    tile = F.when(F.col("before") < cut, F.floor(F.col("before") / (short + 1))).otherwise(extra + F.floor((F.col("before") - cut) / F.nullif(short, F.lit(0))))
    return placed.join(F.broadcast(size)).withColumn("tile", (tile + 1).cast("long")).drop("before", "size")


def quantiles(rows: DataFrame, value: str, steps: dict[str, float]) -> DataFrame:
    """One row with a column per step: the interpolated quantile of the values that are not null; null where there is none.

    Values are counted before they are put in order, so a value that a third of all rows have is one row of the sort.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    placed = in_key_order(counts, ["v"], F.col("n"))
    last = placed.agg((F.sum("n") - 1).alias("last")).where("last IS NOT NULL")
    at = last.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), (F.lit(p) * F.col("last")).alias("at")) for k, p in steps.items()))).alias("s")).select("s.*")
    low = F.floor("at")
    sides = F.array(F.struct(low.alias("place"), (low + 1 - F.col("at")).alias("share")), F.struct((low + 1).alias("place"), (F.col("at") - low).alias("share")))
    ends = at.select("step", F.explode(sides).alias("e")).select("step", "e.*").where("share > 0")  # at most two rows a step
    hit = placed.join(F.broadcast(ends), (F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    return hit.agg(*(F.sum(F.when(F.col("step") == k, F.col("v") * F.col("share"))).alias(k) for k in steps))
