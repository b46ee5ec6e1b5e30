"""Range-checksum comparison: fences every so many keys, one checksum per range and side, and descent into dirty ranges.

Positions in key order come from a range-partitioned sort: rows are counted within their partition and offset by the counts of
the partitions before it, so there is no window over the whole table. Works for any sortable key tuple.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def in_key_order(rows: DataFrame, keys: list[str], counted: Column | None = None, parts: int | None = None) -> DataFrame:
    """rows with `before`: how many rows (where `counted` holds; or the sum of `counted`, if it is a number) stand before each in key order."""
    spark = rows.sparkSession
    flag = (F.lit(True) if counted is None else counted).cast("long")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__one", flag).repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.col("__one")).withColumn("__part", F.spark_partition_id()).persist()
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.sum("__one").alias("n")).collect()}  # one row per partition
    offset = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1))])

    def number(batches):
        base = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            one = batch.column(names.index("__one")).to_numpy().astype(np.int64)
            if base is None:
                base = int(offset[batch.column(names.index("__part"))[0].as_py()])
            upto = np.cumsum(one)
            keep = [i for i, c in enumerate(names) if c not in ("__one", "__part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(base + upto - one)], names=[*(names[i] for i in keep), "before"])
            base += int(upto[-1])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return placed.mapInArrow(number, ", ".join([*fields, "before long"]))


def fences(source: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Every `every`-th key in key order: the inclusive upper ends of all ranges but the open last one."""
    return in_key_order(source.select(*keys), keys).where((F.col("before") + 1) % every == 0).select(*keys)


def range_ids(rows: DataFrame, keys: list[str], ends: DataFrame) -> DataFrame:
    """rows with range_id: how many fences are less than the row's key; a range is (fence, next fence]."""
    extra = [c for c in rows.columns if c not in keys]
    marks = ends.select(*keys, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra), F.lit(True).alias("__fence"))
    both = rows.select(*keys, *extra, F.lit(False).alias("__fence")).unionByName(marks)
    return in_key_order(both, keys, F.col("__fence")).where("NOT __fence").drop("__fence").withColumnRenamed("before", "range_id")


def checksums(rows: DataFrame) -> DataFrame:
    """(range_id, fp_total, row_count) of rows(range_id, fp)."""
    return rows.groupBy("range_id").agg(F.sum(F.col("fp").cast("decimal(20,0)")).cast("decimal(38,0)").alias("fp_total"), F.count("*").alias("row_count"))


def dirty(a: DataFrame, b: DataFrame) -> DataFrame:
    """(range_id, row_count) of the ranges whose checksum or count differs; row_count is the larger."""
    left = a.select("range_id", F.col("fp_total").alias("ta"), F.col("row_count").alias("na"))
    both = left.join(b.select("range_id", F.col("fp_total").alias("tb"), F.col("row_count").alias("nb")), "range_id", "full_outer")
    return both.where(~(F.col("ta").eqNullSafe(F.col("tb")) & F.col("na").eqNullSafe(F.col("nb")))).select("range_id", F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))).alias("row_count"))


def ntile_fences(rows: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """(range_id, bucket, keys..., fp_total, row_count): each range of rows(range_id, keys, fp) cut into `fanout` equal parts in one pass."""
    cut = F.ntile(fanout).over(Window.partitionBy("range_id").orderBy(*keys))
    key = F.max(F.struct(*keys)).alias("__k")
    return rows.withColumn("bucket", cut).groupBy("range_id", "bucket").agg(key, F.sum(F.col("fp").cast("decimal(20,0)")).cast("decimal(38,0)").alias("fp_total"), F.count("*").alias("row_count")).select("range_id", "bucket", "__k.*", "fp_total", "row_count")


def drill(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., kind) of rows(keys, fp) that differ, by a sort-merge full outer join on the key."""
    both = a.select(*keys, F.col("fp").alias("fa")).join(b.select(*keys, F.col("fp").alias("fb")), keys, "full_outer")
    kind = F.when(F.col("fb").isNull(), "source_only").when(F.col("fa").isNull(), "target_only").when(F.col("fa") != F.col("fb"), "changed")
    return both.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")


def dirty_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(range_id, na, nb) of the ranges whose checksum or count differs: the rows of either side."""
    left = a.select("range_id", F.col("fp_total").alias("ta"), F.col("row_count").alias("na"))
    both = left.join(b.select("range_id", F.col("fp_total").alias("tb"), F.col("row_count").alias("nb")), "range_id", "full_outer")
    return both.where(~(F.col("ta").eqNullSafe(F.col("tb")) & F.col("na").eqNullSafe(F.col("nb")))).select("range_id", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


def merkle_compare(source: DataFrame, target: DataFrame, keys: list[str], every: int = 200_000, fanout: int = 10, drill_cap: int = 100_000, rounds: int = 40, dirty_only: bool = True) -> DataFrame:
    """(keys..., kind): rows(keys, fp) that differ, by descent from coarse ranges into the dirty ones.

    Each round narrows both sides to dirty ranges and writes them, so plans do not grow with the rounds; ranges over `drill_cap`
    rows are cut again at the NTILE keys of the side that has more rows there, so rows that only one side has are cut as well.
    With dirty_only off, all large ranges are cut whether they differ or not (descent by size), and checksums are compared once at
    the end. A descent that has not come under `drill_cap` after `rounds` rounds raises: one key has more rows than that.
    """
    scratch = Scratch(source.sparkSession, "merkle")
    ends = scratch.save(fences(source, keys, every))
    a, b = (scratch.save(range_ids(t, keys, ends)) for t in (source, target))
    for left in range(rounds, -1, -1):
        sums = [scratch.save(checksums(t)) for t in (a, b)]
        bad = scratch.save(dirty_sides(*sums))
        if dirty_only:
            sized = bad
        else:
            sized = sums[0].select("range_id", F.col("row_count").alias("na")).join(sums[1].select("range_id", F.col("row_count").alias("nb")), "range_id", "full_outer").select("range_id", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
        large = sized.where(F.greatest("na", "nb") > drill_cap)
        done = not large.limit(1).count()
        if dirty_only or done:
            a, b = (scratch.save(t.join(bad.select("range_id"), "range_id", "left_semi")) for t in (a, b))
        if done:
            return drill(a, b, keys)
        if not left:
            break
        more = [t.join(large.where(which).select("range_id"), "range_id", "left_semi") for t, which in ((a, "na >= nb"), (b, "nb > na"))]
        finer = ntile_fences(more[0].unionByName(more[1]), keys, fanout).select(*keys)
        finer = scratch.save((finer if dirty_only else finer.unionByName(ends)).distinct())
        ends = finer
        a, b = (scratch.save(range_ids(t.drop("range_id"), keys, finer)) for t in (a, b))
    raise RuntimeError(f"ranges of more than {drill_cap} rows remain after {rounds} rounds")


def tuple_range(keys: list[str], low: list | None, high: list | None) -> Column:
    """(low, high] over a key tuple in lexicographic order; None is open."""

    def beyond(bound: list, last: Column) -> Column:
        """The tuple is greater than the bound, or equal to it and `last` holds."""
        return reduce(lambda rest, kv: (F.col(kv[0]) > F.lit(kv[1])) | ((F.col(kv[0]) == F.lit(kv[1])) & rest), reversed(list(zip(keys, bound, strict=True))), last)

    parts = [beyond(low, F.lit(False))] if low is not None else []
    parts += [~beyond(high, F.lit(False))] if high is not None else []
    return reduce(lambda x, y: x & y, parts, F.lit(True))
