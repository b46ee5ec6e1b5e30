"""Monte-Carlo trials of sketches, distributed over executors.

A trial is a row; its random numbers come from a counter-based generator keyed by its configuration and number, so results do
not depend on how trials are dealt to tasks, and a lost task's trials come out the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    cells: int
    d: int
    k: int = 3
    negative: float = 0.0  # share of elements of the other side; -1: a fair coin each
    degrees: tuple[tuple[int, float], ...] = ()  # (degree, probability) of an irregular sketch; empty: k for all


IRREGULAR = ((2, 0.15), (3, 0.725), (18, 0.125))


def _generator(config: int, trial: int, part: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([config << 8 | part, trial], np.uint64)))


def incidence(c: Config, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, cell) of a random sketch and the elements' signs; the cells of an element are distinct."""
    if c.degrees:
        degree = rng.choice([g for g, _ in c.degrees], c.d, p=[p for _, p in c.degrees])
    else:
        degree = np.full(c.d, c.k)
    degree = np.minimum(degree, c.cells)
    element = np.repeat(np.arange(c.d), degree)
    cell = rng.integers(0, c.cells, len(element))
    while len(element):
        order = np.lexsort((cell, element))
        twin = np.zeros(len(element), bool)
        twin[order[1:]] = (element[order][1:] == element[order][:-1]) & (cell[order][1:] == cell[order][:-1])
        if not twin.any():
            break
        cell[twin] = rng.integers(0, c.cells, int(twin.sum()))
    if c.negative < 0:
        sign = rng.integers(0, 2, c.d) * 2 - 1
    else:
        sign = np.ones(c.d, np.int64)
        sign[: round(c.negative * c.d)] = -1
    return element, cell, sign


def core_left(c: Config, element: np.ndarray, cell: np.ndarray) -> int:
    """Elements that peeling cannot reach: the 2-core of the incidence."""
    alive = np.ones(c.d, bool)
    while True:
        live = alive[element]
        load = np.bincount(cell[live], minlength=c.cells)
        free = np.unique(element[live & (load[cell] == 1)])
        if not len(free):
            return int(alive.sum())
        alive[free] = False


def second_moment(c: Config, counts: np.ndarray) -> float:
    """Estimated size from signed counts: (sum of squares - square of the sum / M) / mean of (degree - degree^2 / M)."""
    gain = sum(p * (g - g * g / c.cells) for g, p in c.degrees) if c.degrees else c.k * (1 - c.k / c.cells)
    return float((counts @ counts - counts.sum() ** 2 / c.cells) / gain)


def run(spark: SparkSession, configs: list[Config], trials: int, seed: int = 1) -> DataFrame:
    """(config, trial, d_hat, ratio, left, failed) of every configuration and trial."""
    import dataclasses

    table = [dataclasses.asdict(c) for c in configs]

    def work(batches):
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                which, trial = divmod(n, trials)
                c = Config(**table[which])
                element, cell, sign = incidence(c, _generator(seed << 20 | which, trial))
                d_hat = second_moment(c, np.bincount(cell, sign[element], c.cells))
                left = core_left(c, element, cell)
                out.append((which, trial, d_hat, d_hat / c.d if c.d else None, left, left > 0))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["config", "trial", "d_hat", "ratio", "left", "failed"])

    return spark.range(len(configs) * trials).mapInArrow(work, "config int, trial long, d_hat double, ratio double, left long, failed boolean")


def summary(results: DataFrame, configs: list[Config]) -> DataFrame:
    """Per configuration: mean and relative deviation of d_hat / d with its theory value, quantiles, and the same for failed trials."""
    theory = results.sparkSession.createDataFrame([(i, c.cells, c.d, math.sqrt(2 * (c.d - 1) / (c.d * (c.cells - 1))) if c.d else 0.0) for i, c in enumerate(configs)], "config int, cells int, d int, rsd_theory double")
    lost = lambda c: F.when(F.col("failed"), c)
    got = results.groupBy("config").agg(
        F.count("*").alias("trials"), F.avg("ratio").alias("mean_ratio"), (F.stddev_samp("ratio") / F.avg("ratio")).alias("rsd"),
        *(F.percentile("ratio", p).alias(f"q{round(p * 1000):03d}") for p in (0.001, 0.01, 0.05, 0.5, 0.95, 0.99)),
        F.avg(F.col("failed").cast("int")).alias("p_fail"), F.count_if("failed").alias("n_failed"), F.avg(lost(F.col("ratio"))).alias("mean_ratio_failed"), F.percentile(lost(F.col("ratio")), 0.01).alias("q010_failed"),
    )
    return theory.join(got, "config")


def guidance(summaries: DataFrame, target: float = 1.56) -> DataFrame:
    """alpha that covers the low 1% of estimates after a failed first round: target / q01, rounded up to four digits."""
    return summaries.where("n_failed > 0").select("config", "cells", "d", "q010_failed", (F.ceil(F.lit(target) / F.col("q010_failed") * 10000) / 10000).alias("alpha"))


def retry_success(spark: SparkSession, cells: int, ds: list[int], gammas: list[float], trials: int, seed: int = 2, joint: bool = True) -> DataFrame:
    """(d, gamma, trials, failed_first, decoded): second rounds of ceil(gamma * d_hat) cells after first rounds of `cells`."""

    def work(batches):
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                which, trial = divmod(n, trials)
                one = Config(cells, ds[which])
                element, cell, sign = incidence(one, _generator(seed << 20 | which, trial))
                failed = core_left(one, element, cell) > 0
                d_hat = second_moment(one, np.bincount(cell, sign[element], cells))
                for g in gammas:
                    size = max(4, math.ceil(g * max(d_hat, 0)))
                    ok = not failed
                    if failed:
                        two = Config(size, ds[which])
                        e2, c2, _ = incidence(two, _generator(seed << 20 | which, trial, 1))
                        both = Config(cells + size, ds[which])
                        ok = core_left(both, np.append(element, e2), np.append(cell, c2 + cells)) == 0 if joint else core_left(two, e2, c2) == 0
                    out.append((ds[which], g, failed, ok))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], names=["d", "gamma", "failed", "ok"])

    rows = spark.range(len(ds) * trials).mapInArrow(work, "d int, gamma double, failed boolean, ok boolean")
    return rows.groupBy("d", "gamma").agg(F.count("*").alias("trials"), F.count_if("failed").alias("failed_first"), F.count_if("ok").alias("decoded"), F.count_if(F.col("failed") & F.col("ok")).alias("decoded_after_failure"))


def scopes(results: DataFrame, from_cells: int = 256) -> DataFrame:
    """Success of (cells, gamma, trials, failed_first, decoded, decoded_after_failure) rows overall, by size, and after failures only."""
    total = lambda ok, n: (F.sum(ok).alias("success"), F.sum(n).alias("of"))
    parts = []
    for name, rows, keys in (("all", results, ["gamma"]), (f"all_from_{from_cells}", results.where(F.col("cells") >= from_cells), ["gamma"]), ("by_cells", results, ["gamma", "cells"])):
        for kind, cols in (("", total("decoded", "trials")), ("failed_only_", total("decoded_after_failure", "failed_first"))):
            got = rows.groupBy(*keys).agg(*cols)
            parts.append(got.select(F.lit(kind + name).alias("scope"), "gamma", (F.col("cells") if "cells" in keys else F.lit(None).cast("int")).alias("cells"), "success", "of", (F.col("success") / F.nullif("of", F.lit(0))).alias("rate")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aligned(size: float, step: int = 64) -> int:
    """Cells of a table: a multiple of `step`, at least one."""
    return max(step, math.ceil(size / step) * step)


def strata(d: int, rng: np.random.Generator, levels: int = 16, cells: int = 80) -> tuple[float, bool, int]:
    """(estimate, complete, elements recovered) of small sketches by trailing zeros, decoded from the sparsest down to the first that fails."""
    level = np.minimum(rng.geometric(0.5, d) - 1, levels - 1)
    held, recovered = np.bincount(level, minlength=levels), 0
    for i in range(levels - 1, -1, -1):
        c = Config(cells, int(held[i]))
        element, cell, _ = incidence(c, rng)
        left = core_left(c, element, cell)
        if left:
            return float(recovered << (i + 1)), False, recovered + c.d - left
        recovered += c.d
    return float(recovered), True, recovered


def strata_first(d: int, rng: np.random.Generator, factor: float, cell_bytes: int = 32, levels: int = 16, cells: int = 80) -> tuple[int, int]:
    """(bytes, rounds): strata, then tables for what they left, sized by their estimate less what they recovered, doubled on failure."""
    spent, rounds = levels * cells * cell_bytes, 1
    d_hat, complete, recovered = strata(d, rng, levels, cells)
    if complete or recovered >= d:
        return spent, rounds
    size = aligned(factor * max(d_hat - recovered, 1))
    while True:
        spent, rounds = spent + size * cell_bytes, rounds + 1
        c = Config(size, d - recovered)
        element, cell, _ = incidence(c, rng)
        if not core_left(c, element, cell):
            return spent, rounds
        size = aligned(2 * size)


def joint_jump(d: int, first: int, rng: np.random.Generator, factor: float, cell_bytes: int = 32) -> tuple[int, int]:
    """(bytes, rounds): a first table, then one sized by its estimate, then as much again as was sent; all tables are peeled jointly."""
    c = Config(first, d)
    element, cell, sign = incidence(c, rng)
    total, rounds = first, 1
    size = aligned(factor * second_moment(c, np.bincount(cell, sign[element], first)))
    while core_left(Config(total, d), element, cell):
        more, at, _ = incidence(Config(size, d), rng)
        element, cell = np.append(element, more), np.append(cell, at + total)
        total, rounds = total + size, rounds + 1
        size = aligned(total)
    return total * cell_bytes, rounds


def crossover(spark: SparkSession, firsts: list[int], ds: list[int], trials: int, factor: float = 1.4, cell_bytes: int = 32, seed: int = 4) -> DataFrame:
    """Joint jumps from every first size against strata with what they recover credited: mean bytes, rounds, and shares of three rounds or more."""
    grid = [(m, d) for m in firsts for d in ds]

    def work(batches):
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                which, trial = divmod(n, trials)
                m, d = grid[which]
                key = seed << 20 | which
                out.append((m, d, *joint_jump(d, m, _generator(key, trial), factor, cell_bytes), *strata_first(d, _generator(key, trial, 1), factor, cell_bytes)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], names=names)

    names = ["first", "d", "jump_bytes", "jump_rounds", "strata_bytes", "strata_rounds"]
    rows = spark.range(len(grid) * trials).mapInArrow(work, ", ".join(f"{n} long" for n in names))
    late = lambda c: F.avg((F.col(c) >= 3).cast("int"))
    got = rows.groupBy("first", "d").agg(F.count("*").alias("trials"), *(F.avg(c).alias(f"mean_{c}") for c in names[2:]), late("jump_rounds").alias("jump_late"), late("strata_rounds").alias("strata_late"))
    return got.withColumn("jump_over_strata", F.col("mean_jump_bytes") / F.col("mean_strata_bytes"))


def pipelines(spark: SparkSession, ds: list[int], trials: int, first: int = 64, alpha: float = 1.52, margin: float = 1.2, cell_bytes: int = 32, seed: int = 3) -> DataFrame:
    """(pipeline, d, mean_bytes, p95_bytes, mean_rounds) of blind doubling, one jump, one joint jump, strata first, and an oracle that knows d."""

    def cost(name: str, d: int, which: int, trial: int) -> tuple[int, int]:
        if name == "strata_first":
            return strata_first(d, _generator(seed << 20 | which, trial, 254), alpha * margin, cell_bytes)
        if name == "oracle":
            rng, size = _generator(seed << 20 | which, trial, 255), aligned(1.05 * d) if d else first
            while core_left(Config(size, d), *incidence(Config(size, d), rng)[:2]):
                size = aligned(1.1 * size + 1)
            return size * cell_bytes, 1
        size, spent, rounds = first, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        while True:
            c = Config(size, d)
            element, cell, sign = incidence(c, _generator(seed << 20 | which, trial, rounds))
            spent, rounds = spent + size * cell_bytes, rounds + 1
            alone = core_left(c, element, cell) == 0
            if name == "one_jump_joint" and held:
                e0, c0, m0 = held[-1]
                alone = core_left(Config(m0 + size, d), np.append(e0, element), np.append(c0, cell + m0)) == 0
            if alone:
                return spent, rounds
            held.append((element, cell, size))
            if name == "blind_doubling":
                size *= 2
            else:
                size = max(2 * size if rounds > 1 else 0, math.ceil(alpha * margin * max(second_moment(c, np.bincount(cell, sign[element], size)), 1)), 4)

    names = ["blind_doubling", "one_jump", "one_jump_joint", "strata_first", "oracle"]

    def work(batches):
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                which, trial = divmod(n, trials)
                for name in names:
                    out.append((name, ds[which], *cost(name, ds[which], which, trial)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["pipeline", "d", "bytes", "rounds"])

    rows = spark.range(len(ds) * trials).mapInArrow(work, "pipeline string, d int, bytes long, rounds int")
    return rows.groupBy("pipeline", "d").agg(F.avg("bytes").alias("mean_bytes"), F.percentile("bytes", 0.95).alias("p95_bytes"), F.avg("rounds").alias("mean_rounds"))
