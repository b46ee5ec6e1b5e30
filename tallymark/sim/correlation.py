"""Sign of the correlation of two elements' overlap with decoding failure: exact for tiny sketches, by simulation for others."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trials import Config, _generator, core_left, incidence


def _stuck(masks: tuple[int, ...]) -> bool:
    """Whether peeling cells with a single element leaves elements over; an element is a bit mask of its cells."""
    alive = list(masks)
    while alive:
        once = many = 0
        for m in alive:
            many |= once & m
            once |= m
        lone = once & ~many
        left = [m for m in alive if not m & lone]
        if len(left) == len(alive):
            return True
        alive = left
    return False


def exact(spark: SparkSession, grid: list[tuple[int, int, int]]) -> DataFrame:
    """(cells, k, d, p_fail, c_f, sign) by enumeration of all multisets of k-subsets; tasks are dealt by the lowest subset.

    c_f = (mean overlap of a pair given failure - k^2 / M) / (k (M - k) / M); sums are exact decimals.
    """
    tasks = [(m, k, d, first) for m, k, d in grid for first in range(math.comb(m, k))]

    def work(batches):
        for batch in batches:
            out = []
            for m, k, d, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                masks = [sum(1 << c for c in s) for s in itertools.combinations(range(m), k)]
                failing = overlap = 0
                for rest in itertools.combinations_with_replacement(range(first, len(masks)), d - 1):
                    chosen = (first, *rest)
                    picked = tuple(masks[i] for i in chosen)
                    if _stuck(picked):
                        weight = math.factorial(d)
                        for times in Counter(chosen).values():
                            weight //= math.factorial(times)
                        failing += weight
                        overlap += weight * sum((a & b).bit_count() for a, b in itertools.combinations(picked, 2))
                out.append((m, k, d, str(failing), str(overlap)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["cells", "k", "d", "failing", "overlap"])

    parts = spark.createDataFrame(tasks, "cells int, k int, d int, first int").repartition(spark.sparkContext.defaultParallelism).mapInArrow(work, "cells int, k int, d int, failing string, overlap string")
    total = parts.groupBy("cells", "k", "d").agg(*(F.sum(F.col(c).cast("decimal(30,0)")).cast("decimal(38,0)").alias(c) for c in ("failing", "overlap")))
    m, k, d = (F.col(c).cast("double") for c in ("cells", "k", "d"))
    ways = spark.createDataFrame([(*g, float(math.comb(g[0], g[1]) ** g[2])) for g in grid], "cells int, k int, d int, ways double")
    pairs = d * (d - 1) / 2
    lift = F.col("overlap").cast("double") / (F.nullif(F.col("failing"), F.lit(0)).cast("double") * pairs) - k * k / m
    return total.join(ways, ["cells", "k", "d"]).select("cells", "k", "d", (F.col("failing").cast("double") / F.col("ways")).alias("p_fail"), (lift / (k * (m - k) / m)).alias("c_f")).withColumn("sign", F.signum(F.when(F.abs("c_f") > 1e-12, F.col("c_f")).otherwise(F.lit(0.0))))


def simulated(spark: SparkSession, cells: int, k: int, d: int, trials: int, seed: int = 4) -> DataFrame:
    """(trials, failed, c_f) over random sketches."""
    config = Config(cells, d, k)

    def work(batches):
        import numpy as np

        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                element, cell, _ = incidence(config, _generator(seed << 20, t))
                load = np.bincount(cell, minlength=cells)
                out.append((core_left(config, element, cell) > 0, float((load * (load - 1)).sum() / 2)))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.bool_()), pa.array([o for _, o in out], pa.float64())], names=["failed", "overlap"])

    rows = spark.range(trials).mapInArrow(work, "failed boolean, overlap double")
    mean = F.avg(F.when(F.col("failed"), F.col("overlap"))) / (d * (d - 1) / 2)
    return rows.agg(F.count("*").alias("trials"), F.count_if("failed").alias("failed"), ((mean - k * k / cells) / (k * (cells - k) / cells)).alias("c_f"))
