"""Summary of a log of reconciliation runs: one aggregate row of 32 metrics, turned into (metric, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fleet import Checker, Dialect

RUNS = "run_id, src_table, dst_table, m1, m2, rounds, outcome, residual, d_final, d_plus, d_minus, d_hat_r1, n_rows_src, n_rows_dst"


def derived_runs(events: DataFrame) -> DataFrame:
    """A run log with every outcome, made from an event stream."""
    return events.sparkSession.sql(f"SELECT {derived(Dialect())}", events=events)


def derived(d: Dialect) -> str:
    """The select list and source of the derived log, in either dialect."""
    cents = d.whole("value * 100")
    inner = f"SELECT event_id, user_id, {cents} % 800 AS c FROM {{events}}"
    size = "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 + c END"
    return f"""CAST(event_id AS VARCHAR(20)) AS run_id, 'T' || CAST(user_id % 300 AS VARCHAR(20)) AS src_table, 't' || CAST(user_id % 300 AS VARCHAR(20)) AS dst_table, 512 AS m1,
      CASE WHEN d_final > 393 THEN CAST(ceil(1.824e0 * d_hat_r1) AS BIGINT) ELSE 0 END AS m2, CASE WHEN d_final > 393 THEN 2 ELSE 1 END AS rounds,
      CASE WHEN event_id % 97 = 3 THEN 'SQLException: scan' WHEN event_id % 101 = 5 THEN 'dHatTooLarge' ELSE 'OK' END AS outcome, 0 AS residual, d_final,
      CASE WHEN event_id % 3 = 0 THEN d_final ELSE d_final - 1 * (CASE WHEN d_final > 1 THEN 1 ELSE 0 END) END AS d_plus, CASE WHEN event_id % 3 = 0 THEN 0 WHEN d_final > 1 THEN 1 ELSE 0 END AS d_minus, d_hat_r1, 1000 + c AS n_rows_src, 1000 + event_id % 50 AS n_rows_dst
    FROM (SELECT event_id, c, user_id, {size} AS d_final, CASE WHEN event_id % 4 < 2 THEN 1e0 * ({size}) ELSE ({size}) * (9e-1 + (event_id % 21) / 1e2) END AS d_hat_r1 FROM ({inner}) x) y"""


def statement(d: Dialect, runs: str) -> str:
    ok = "outcome = 'OK'"
    fast, second = f"{ok} AND rounds = 1", f"{ok} AND rounds = 2"
    lone = f"{ok} AND d_final >= 3 AND (d_plus = 0 OR d_minus = 0)"
    n = lambda w: f"count(*) FILTER (WHERE {w})"
    of = lambda f, x, w: f"{f}(CASE WHEN {w} THEN {x} END)"
    most = "greatest(n_rows_src, n_rows_dst)"
    ratio = "d_hat_r1 / nullif(d_final, 0)"
    wide = {
        "runs_total": "count(*)", "table_tasks": "count(DISTINCT lower(src_table) || '|' || lower(dst_table))", "runs_completed": n(ok), "runs_completed_residual_zero": n(f"{ok} AND residual = 0"),
        "runs_fast_path": n(fast), "fast_path_share": d.r(f"1e0 * {n(fast)} / nullif({n(ok)}, 0)", 4), "fast_path_rows_max": of("max", most, fast), "fast_path_d_min": of("min", "d_final", fast), "fast_path_d_max": of("max", "d_final", fast),
        "runs_second_round": n(second), "second_round_rows_max": of("max", most, second), "second_round_d_min": of("min", "d_final", second), "second_round_d_max": of("max", "d_final", second),
        "second_round_dhat_ratio_min": d.r(of("min", ratio, second), 3), "second_round_dhat_ratio_max": d.r(of("max", ratio, second), 3), "second_round_m2_over_d_min": d.r(of("min", "m2 * 1e0 / nullif(d_final, 0)", second), 3),
        "runs_fallback": n(f"NOT ({ok})"), "fallback_sql_error": n("outcome LIKE '%SQLException%'"), "fallback_cost_exit": n("outcome LIKE '%dHatTooLarge%'"),
        "zero_difference_runs": n(f"{ok} AND d_final = 0"), "zero_difference_share": d.r(f"1e0 * {n(f'{ok} AND d_final = 0')} / nullif({n(ok)}, 0)", 4), "zero_difference_dhat_exact": f"CASE WHEN {n(f'{ok} AND d_final = 0 AND d_hat_r1 <> 0')} = 0 THEN 1 ELSE 0 END",
        "unit_difference_runs": n(f"{ok} AND d_final = 1"), "unit_difference_dhat_exact": f"CASE WHEN {n(f'{ok} AND d_final = 1 AND abs(d_hat_r1 - 1) >= 1e-9')} = 0 THEN 1 ELSE 0 END",
        "one_sided_runs": n(lone), "one_sided_tables": f"count(DISTINCT CASE WHEN {lone} THEN lower(src_table) END)",
    }
    sets = {"fast_path": f"{fast} AND d_final >= 3", "one_sided": lone}
    names = {"fast_path": ("fast_path_distinct_sets_d_ge3", "fast_path_dhat_ratio_mean", "fast_path_dhat_ratio_sd"), "one_sided": ("one_sided_distinct_sets", "one_sided_dhat_ratio_mean", "one_sided_dhat_ratio_sd")}
    rows = [f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM {runs} r" for k, v in wide.items()]
    for key, where in sets.items():
        distinct = f"(SELECT max({ratio}) AS x FROM {runs} r WHERE {where} GROUP BY lower(src_table), d_final, {d.r('d_hat_r1', 3)}) s"
        rows += [f"SELECT '{name}' AS metric, CAST({v} AS DOUBLE) AS value FROM {distinct}" for name, v in zip(names[key], ("count(*)", d.r("avg(x)", 4), d.r("stddev_samp(x)", 4)), strict=True)]
    return " UNION ALL ".join(rows)


def summarize(runs: DataFrame) -> DataFrame:
    """(metric, value) of a run log: one aggregation of the log for the plain metrics, one per family of distinct sets."""
    spark = runs.sparkSession
    parts = statement(Dialect(), "{runs}").split(" UNION ALL ")
    plain = [p for p in parts if "FROM {runs} r" in p and "GROUP BY" not in p]
    named = [(p.split("'")[1], p[p.index("CAST(") :].split(" AS value FROM")[0]) for p in plain]
    wide = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in named) + " FROM {runs} r", runs=runs)
    out = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k, _ in named))).alias("m")).select("m.*")
    for p in parts:
        if p not in plain:
            out = out.unionByName(spark.sql(p, runs=runs))
    return out


def checker_sql() -> str:
    d = Checker()
    return f"WITH runs AS (SELECT {derived(d).replace('{events}', 'events')}) {statement(d, 'runs')}"
