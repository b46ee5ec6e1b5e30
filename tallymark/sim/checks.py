"""Checks of trial results against the chi-square law of the estimate, and regressions over trial summaries.

The estimate of a sketch of M cells, divided by the true size, is close to chi-square with M - 1 degrees of freedom over M - 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.merkle import in_key_order
from .trials import Config


def chi_square_cdf(x: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(chi-square <= x): the regularised lower gamma function, by its series below the mode and by its continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float) / 2, np.asarray(freedom, float) / 2)
    out = np.zeros(x.shape)
    known = np.array([math.lgamma(v) for v in np.unique(a)])
    log_gamma = known[np.searchsorted(np.unique(a), a)]
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - log_gamma)
    low = (x > 0) & (x < a + 1)
    if low.any():
        b, y = a[low], x[low]
        term = total = 1 / b
        step = 0
        while (term > total * 1e-16).any():
            step += 1
            term = term * y / (b + step)
            total = total + term
        out[low] = total * front[low]
    high = x >= a + 1
    if high.any():
        b, y = a[high], x[high]
        at = y + 1 - b
        c, d = np.full(y.shape, 1e300), 1 / at
        fraction, step, change = d, 0, np.full(y.shape, 2.0)
        while (np.abs(change - 1) > 1e-15).any() and step < 10_000:
            step += 1
            by, at = step * (b - step), at + 2
            d = 1 / (at + by * d)
            c = at + by / c
            change = c * d
            fraction = fraction * change
        out[high] = 1 - front[high] * fraction
    return out


def chi_square_quantile(p: float, freedom: int) -> float:
    """The x with P(chi-square <= x) = p, by bisection."""
    low, high = 0.0, freedom + 40 * math.sqrt(2 * freedom) + 40
    for _ in range(200):
        mid = (low + high) / 2
        if float(chi_square_cdf(np.array([mid]), freedom)[0]) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def order_bound_rank(n: int, p: float, confidence: float = 0.95) -> int:
    """The largest r for which the r-th smallest of n draws lies at or below the p-quantile with the given confidence; 0 if none does."""
    below, at = 0.0, n * math.log1p(-p)  # P(fewer than r of n fall below the quantile), by the binomial law
    for r in range(n + 1):
        below += math.exp(at)
        if below > 1 - confidence:
            return r
        at += math.log((n - r) / (r + 1)) + math.log(p) - math.log1p(-p) if r < n else 0
    return n


def _theory(results: DataFrame, configs: list[Config], p: float) -> DataFrame:
    rows = [(i, c.cells, c.d, chi_square_quantile(p, c.cells - 1) / (c.cells - 1)) for i, c in enumerate(configs)]
    return F.broadcast(results.sparkSession.createDataFrame(rows, "config int, cells int, d int, threshold double"))  # as many rows as configurations


def failed_threshold(results: DataFrame, configs: list[Config], p: float = 0.01) -> DataFrame:
    """How often estimates after a failed decode fall to the p-quantile of the chi-square law, with its binomial error; null where none failed."""
    got = results.where("failed AND ratio IS NOT NULL").join(_theory(results, configs, p), "config").groupBy("config", "cells", "d", "threshold")
    rate = F.col("n_below") / F.col("n_failed")
    counted = got.agg(F.count("*").alias("n_failed"), F.count_if(F.col("ratio") <= F.col("threshold")).alias("n_below")).withColumn("rate", rate)
    return counted.withColumn("standard_error", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n_failed"))).withColumn("off", F.abs(F.col("rate") - p))


@F.pandas_udf(DoubleType())
def _cdf(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series(chi_square_cdf(x.to_numpy(), freedom.to_numpy()))


def against_chi_square(results: DataFrame, configs: list[Config]) -> DataFrame:
    """(config, cells, d, n, ks, rsd, rsd_theory): the largest gap between the distribution of the estimates and the chi-square law.

    Equal estimates are counted before they are put in order, and places come from a range-partitioned sort, so that no task
    holds all trials of a configuration.
    """
    counts = results.where("ratio IS NOT NULL").groupBy("config", "ratio").agg(F.count("*").alias("n"))
    placed = in_key_order(counts, ["config", "ratio"], F.col("n"))
    whole = placed.groupBy("config").agg(F.min("before").alias("start"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("ratio")).alias("s1"), F.sum(F.col("n") * F.col("ratio") * F.col("ratio")).alias("s2"))
    each = placed.join(F.broadcast(whole), "config").join(_theory(results, configs, 0.5), "config")
    law = each.withColumn("law", _cdf(F.col("ratio") * (F.col("cells") - 1), F.col("cells") - 1))
    before = F.col("before") - F.col("start")
    gap = F.greatest((before + F.col("n")) / F.col("size") - F.col("law"), F.col("law") - before / F.col("size"))
    deviation = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("size")) / F.nullif(F.col("size") - 1, F.lit(0)))
    got = law.groupBy("config", "cells", "d", "size", "s1", "s2").agg(F.max(gap).alias("ks"))
    theory = F.sqrt(2 * (F.col("d") - 1) / (F.col("d") * (F.col("cells") - 1)))
    return got.select("config", "cells", "d", F.col("size").alias("n"), "ks", deviation.alias("rsd"), theory.alias("rsd_theory"))


def failed_order_bounds(results: DataFrame, p: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """(config, n_failed, rank, bound): the order statistic of failed trials that lies at or below their p-quantile with the given confidence.

    The bound is null where too few trials failed to give one.
    """
    counts = results.where("failed AND ratio IS NOT NULL").groupBy("config", "ratio").agg(F.count("*").alias("n"))
    placed = in_key_order(counts, ["config", "ratio"], F.col("n"))
    whole = placed.groupBy("config").agg(F.min("before").alias("start"), F.sum("n").alias("n_failed"))
    rank = F.udf(lambda n: order_bound_rank(n, p, confidence), "long")  # one call a configuration
    ranked = F.broadcast(whole.withColumn("rank", rank("n_failed")))
    place = F.col("before") - F.col("start")
    hit = F.when((place < F.col("rank")) & (F.col("rank") <= place + F.col("n")), F.col("ratio"))
    return placed.join(ranked, "config").groupBy("config", "n_failed", "rank").agg(F.max(hit).alias("bound"))


def sign_projection(points: DataFrame) -> DataFrame:
    """Bias after failures regressed on the sign projection, per (cells, k, d), each point also predicted from the others.

    points(cells, k, d, rho, failed_mean, failed_variance, failed_n, fail_rate): z = d rho^2 - 1, y = failed_mean - 1, weights
    the inverse squared errors of the means; y = slope z. A point left out takes its own share out of two sums, so one window
    of sums gives all predictions. Points without rho, or without a positive error, take no part.
    """
    group = Window.partitionBy("cells", "k", "d")
    z, y = F.col("d") * F.col("rho") * F.col("rho") - 1, F.col("failed_mean") - 1
    error = F.sqrt(F.col("failed_variance") / F.nullif("failed_n", F.lit(0)))
    base = points.where("rho IS NOT NULL").withColumn("z", z).withColumn("y", y).withColumn("error", error).where("error > 0")
    weight = 1 / (F.col("error") * F.col("error"))
    sums = base.withColumn("wzy", weight * F.col("z") * F.col("y")).withColumn("wzz", weight * F.col("z") * F.col("z"))
    sums = sums.withColumn("szy", F.sum("wzy").over(group)).withColumn("szz", F.sum("wzz").over(group)).withColumn("p_fail", F.avg("fail_rate").over(group))
    rest = F.nullif(F.col("szz") - F.col("wzz"), F.lit(0.0))
    fitted = sums.withColumn("slope", F.col("szy") / F.nullif("szz", F.lit(0.0))).withColumn("slope_error", 1 / F.sqrt(F.nullif("szz", F.lit(0.0))))
    left = fitted.withColumn("predicted", (F.col("szy") - F.col("wzy")) / rest * F.col("z")).withColumn("predicted_error", F.abs("z") / F.sqrt(rest))
    spread = F.sqrt(2 * (F.col("d") - 1) / (F.col("d") * (F.col("cells") - 1)))
    bound = F.abs(F.col("z") / F.nullif(F.col("d") - 1, F.lit(0))) * spread * F.sqrt((1 - F.col("p_fail")) / F.nullif("p_fail", F.lit(0.0)))
    residual = (F.col("y") - F.col("predicted")) / F.sqrt(F.col("error") * F.col("error") + F.col("predicted_error") * F.col("predicted_error"))
    out = left.withColumn("bound", bound).withColumn("residual_z", residual).withColumn("inside", F.abs("y") <= F.col("bound"))
    return out.select("cells", "k", "d", "rho", "y", "error", "slope", "slope_error", "predicted", "predicted_error", "residual_z", "bound", "inside")


def sweep_rollup(runs: DataFrame, expected: int) -> DataFrame:
    """runs(profile, d_hat, capacity, passed): range, mean and relative sample deviation of the estimates, and whether all expected runs passed."""
    mean = F.avg("d_hat")
    return runs.groupBy("profile").agg(
        F.count("*").alias("runs"), F.min("d_hat").alias("d_hat_min"), F.max("d_hat").alias("d_hat_max"), mean.alias("d_hat_mean"), (F.stddev_samp("d_hat") / F.nullif(mean, F.lit(0.0))).alias("d_hat_rsd"),
        F.min("capacity").alias("capacity_min"), F.max("capacity").alias("capacity_max"), ((F.count("*") == expected) & F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False))).alias("whole"),
    )
