import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import decode, sketch
from tallymark.sim import checks, sweep, trials


def test_chi_square_law():
    for x in (0.1, 1.0, 3.0, 20.0):  # two degrees of freedom have a closed form, and one is an error function
        assert abs(checks.chi_square_cdf(np.array([x]), 2)[0] - (1 - math.exp(-x / 2))) < 1e-13
        assert abs(checks.chi_square_cdf(np.array([x]), 1)[0] - math.erf(math.sqrt(x / 2))) < 1e-13
    assert checks.chi_square_cdf(np.array([0.0, -1.0]), 5).tolist() == [0, 0]
    for nu in (1, 63, 255, 4095):
        for p in (0.01, 0.5, 0.95):
            assert abs(checks.chi_square_cdf(np.array([checks.chi_square_quantile(p, nu)]), nu)[0] - p) < 1e-11
    assert abs(checks.chi_square_quantile(0.95, 10) - 18.307038053275146) < 1e-9


def test_order_bound_rank_equals_exact_sums():
    for n in (0, 1, 30, 59, 300, 1000):
        for p in (0.01, 0.05, 0.5):
            sure = [r for r in range(1, n + 1) if 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(r)) >= 0.95]
            assert checks.order_bound_rank(n, p) == max(sure, default=0)


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([(0, t, float(r), f) for t, (r, f) in enumerate([(0.5, True), (0.5, True), (0.7, False), (1.1, True), (1.6, False)])] + [(1, 0, None, True)], "config int, trial long, ratio double, failed boolean")


CONFIGS = [trials.Config(9, 20), trials.Config(16, 0)]


def test_distance_from_the_law(results):
    (got,) = checks.against_chi_square(results, CONFIGS).collect()
    values = np.array([0.5, 0.5, 0.7, 1.1, 1.6])
    law, n = checks.chi_square_cdf(values * 8, 8), len(values)
    ks = max(max(abs((values <= v).mean() - f), abs((values < v).mean() - f)) for v, f in zip(values, law))
    assert (got.config, got.n) == (0, n) and abs(got.ks - ks) < 1e-12 and abs(got.rsd - values.std(ddof=1)) < 1e-12
    assert abs(got.rsd_theory - math.sqrt(2 * 19 / (20 * 8))) < 1e-12
    assert checks.against_chi_square(results.limit(0), CONFIGS).count() == 0


def test_estimates_after_failures(results, spark):
    (got,) = checks.failed_threshold(results, CONFIGS, 0.3).collect()
    limit = checks.chi_square_quantile(0.3, 8) / 8
    assert (got.n_failed, got.n_below, got.threshold) == (3, sum(v <= limit for v in (0.5, 0.5, 1.1)), limit)
    (bound,) = checks.failed_order_bounds(results, 0.5, 0.8).collect()
    assert (bound.n_failed, bound.rank, bound.bound) == (3, checks.order_bound_rank(3, 0.5, 0.8), 0.5)
    assert [r.bound for r in checks.failed_order_bounds(results, 0.01).collect()] == [None]
    assert checks.failed_threshold(results.limit(0), CONFIGS).count() == 0
    config = [trials.Config(64, 200, negative=-1)]
    (law,) = checks.against_chi_square(trials.run(spark, config, 1500), config).collect()
    assert law.ks < 0.06 and abs(law.rsd / law.rsd_theory - 1) < 0.1


def test_projection_recovers_a_slope(spark):
    rows = [(64, 3, 50, i / 8, 1 + 0.01 * (50 * (i / 8) ** 2 - 1), 0.04, 100 + i, 0.2) for i in range(9)] + [(64, 3, 50, None, 2.0, 0.1, 5, 0.9), (64, 3, 60, 0.5, 1.2, 0.04, 50, 0.0)]
    got = checks.sign_projection(spark.createDataFrame(rows, "cells int, k int, d int, rho double, failed_mean double, failed_variance double, failed_n int, fail_rate double")).collect()
    many, alone = [r for r in got if r.d == 50], [r for r in got if r.d == 60]
    assert len(many) == 9 and all(abs(r.slope - 0.01) < 1e-12 and abs(r.predicted - r.y) < 1e-9 for r in many)
    assert alone[0].predicted is None and alone[0].bound is None


def test_sweep_rollup(spark):
    rows = [("a", 10.0, 64, True), ("a", 14.0, 128, True), ("b", 10.0, 64, True), ("b", 10.0, 64, None), ("c", 3.0, 64, True)]
    got = {r.profile: r for r in checks.sweep_rollup(spark.createDataFrame(rows, "profile string, d_hat double, capacity int, passed boolean"), 2).collect()}
    assert (got["a"].whole, got["b"].whole, got["c"].whole) == (True, False, False)
    assert got["a"].d_hat_mean == 12 and abs(got["a"].d_hat_rsd - math.sqrt(8) / 12) < 1e-12 and got["c"].d_hat_rsd is None


def test_second_rounds_equal_decoding_one_by_one(spark):
    rows = spark.range(600).select(F.pmod(F.xxhash64("id"), F.lit(1 << 56)).alias("fp"), "id")
    a, b = rows.where("id >= 40"), rows.where("id < 580")
    got = {r.trial: r for r in sweep.second_rounds(a, b, 4, cells=32, seed=11).collect()}
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(-1)))
    for t in range(4):
        one, two = sweep.trial_seeds(11, t)
        view = sketch.to_arrays(sketch.sketch(both, 32, one, "s"), 32)
        first = decode.peel([view], [one])
        assert (got[t].d_hat, got[t].decoded_first) == (first.d_hat, first.complete)
        if not first.complete:
            size = math.ceil(1.52 * first.d_hat)
            again = decode.peel([view, sketch.to_arrays(sketch.sketch(both, size, two, "s"), size)], [one, two])
            assert (got[t].second_cells, got[t].decoded_second) == (size, again.complete)
    total = sweep.sweep_summary(sweep.second_rounds(a, b, 4, cells=32, seed=11)).collect()[0]
    assert total.trials == 4 and total.failed_first == total.decoded_second + total.failed_second
    same = sweep.second_rounds(a, a, 3, cells=32).collect()
    assert all(r.decoded_first and r.decoded_second is None for r in same) and len(same) == 3


def test_strata_and_joint_jumps(spark):
    rng = trials._generator(5, 1)
    assert trials.strata(0, rng) == (0.0, True, 0) and trials.strata(30, rng) == (30.0, True, 30)
    estimate, complete, recovered = trials.strata(5000, rng)
    assert not complete and recovered < 5000 and 1500 < estimate < 15000
    assert trials.strata_first(30, rng, 1.4) == (16 * 80 * 32, 1) and trials.joint_jump(0, 64, rng, 1.4) == (64 * 32, 1)
    got = {(r["first"], r.d): r for r in trials.crossover(spark, [64], [0, 400], 10).collect()}
    assert got[64, 0].jump_over_strata == 0.05 and got[64, 0].trials == 10 and got[64, 400].mean_jump_rounds >= 2
    cost = {(r.pipeline, r.d): r for r in trials.pipelines(spark, [0, 300], 8).collect()}
    assert cost["strata_first", 0].mean_rounds == 1 and cost["oracle", 300].mean_bytes < cost["one_jump", 300].mean_bytes
