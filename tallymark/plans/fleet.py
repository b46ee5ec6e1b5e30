"""Fleet analytics over comparison logs.

The facts are DataFrames; each analysis is one SQL statement over them, written once for both dialects that it must run in
(ours, and the one that checks it). Where the engines differ - quantiles, rounding a double to an integer - the statement asks
its dialect. Totals that other rows need are one-row subqueries, so nothing is formatted into the text from the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merkle import in_key_order
from . import positions

# Fixed values of the deployment that the analyses describe.
CELLS, ALPHA, BETA, CELL_BYTES, PERIODIC_RUNS = 512, 1.52, 1.3, 32, 30
LADDER = (0.10, 0.25, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99, 0.999)
TIERS = ((1_000, "1_<1K"), (1_000_000, "2_1K-1M"), (10_000_000, "3_1-10M"), (100_000_000, "4_10-100M"))


# The columns that have a ladder, and the rows it stands on.
LADDERS = {"dur_s": "dur_s IS NOT NULL", "n_rows": "true", "d_ms": "d_row > 0"}


def _steps_sql(x: str, where: str) -> str:
    """The quantiles of a ladder as a common table of the checking engine."""
    return f"steps_{x} AS (SELECT {', '.join(f'quantile_cont({x}, {p}) AS q{i}' for i, p in enumerate(LADDER))}, max({x}) AS mx FROM eligible WHERE {where})"


class Dialect:
    """Text of the few functions that differ between the engines."""

    spark = True

    def q(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def whole(self, x: str) -> str:
        """A double as the nearest integer, halves to even."""
        return f"CAST(rint({x}) AS BIGINT)" if self.spark else f"CAST(round_even({x}, 0) AS BIGINT)"

    def total(self, x: str) -> str:
        return f"CAST(sum({x}) AS BIGINT)"

    def seconds(self, a: str, b: str) -> str:
        return f"timestampdiff(SECOND, date_trunc('second', {a}), date_trunc('second', {b}))" if self.spark else f"date_diff('second', {a}, {b})"

    def up(self, x: str) -> str:
        return f"CAST(ceil({x}) AS INT)"

    def r(self, x: str, n: int) -> str:
        """Half up, by the same double operations in either engine."""
        return f"floor(({x}) * 1e{n} + 5e-1) / 1e{n}"

    def pct(self, a: str, b: str, n: int = 1) -> str:
        return self.r(f"1e2 * ({a}) / nullif({b}, 0)", n)

    def share(self, condition: str, n: int = 1) -> str:
        return self.pct(f"count(*) FILTER (WHERE {condition})", "count(*)", n)


class Checker(Dialect):
    spark = False


def tier(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {top} THEN '{name}'" for top, name in TIERS) + " ELSE '5_>100M' END"


def derived_log(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, progress): a comparison log with every special case, made from an event stream."""
    e = events
    cents = F.rint(F.col("value") * 100).cast("long")
    execs = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("task_id"), (F.col("user_id") % 5).alias("account_id"), F.col("ts").alias("create_time"), F.col("event_type").alias("exec_type"), F.when(F.col("event_id") % 50 == 49, "failed").otherwise("success").alias("status"), F.when(F.col("event_id") % 40 == 0, 10).alias("sample_percent"))
    empty = F.col("user_id") % 13 == 0
    k = F.col("user_id") % 5
    scale = F.when(k == 0, 90).when(k == 1, 9_000).when(k == 2, 900_000).when(k == 3, 9_000_000).otherwise(90_000_000)
    rows = F.when(empty, 0).otherwise((1 + F.col("user_id") % 9) * scale).cast("long")
    start = F.date_trunc("second", "ts").cast("timestamp_ntz")
    lasts = F.when(F.col("event_id") % 17 == 0, 1).otherwise(20 + (cents % 900) * (1 + F.col("user_id") % 4))
    none = empty | (F.col("event_id") % 7).isin(0, 1, 2)
    m = F.col("event_id") % 11
    progress = e.select(
        F.when(F.col("event_id") % 200 == 7, -F.col("event_id")).otherwise(F.col("event_id")).alias("exec_id"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("source_db"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("_"), F.col("event_type"))).otherwise("")).alias("source_table"),
        F.when(F.col("user_id") % 11 != 0, "bigint").alias("pk_type"),
        F.when(F.col("event_id") % 60 == 59, "failed").otherwise("success").alias("status"),
        start.alias("start_time"),
        (start + F.make_dt_interval(secs=lasts.cast("decimal(18,6)"))).alias("end_time"),
        rows.alias("source_rows"),
        F.when(empty, 0).otherwise(rows + F.col("event_id") % 3).cast("long").alias("target_rows"),
        F.when(empty | (F.col("event_id") % 7).isin(0, 1, 2, 3), 0).otherwise((cents % 60) * F.when(m == 0, 1000).when(m == 1, 10000).otherwise(1)).cast("long").alias("changed_rows"),
        F.when(none, 0).otherwise(F.col("event_id") % 5).cast("long").alias("source_only_rows"),
        F.when(none, 0).otherwise(F.col("event_id") % 3).cast("long").alias("target_only_rows"),
    )
    return execs, progress


def facts(execs: DataFrame, progress: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of all analyses: full-scan successful comparisons with sizes, differences, duration and flags."""
    whole = execs.where("status = 'success' AND sample_percent IS NULL")
    done = progress.where("status = 'success'")
    rec = done.join(whole.select(F.col("id").alias("exec_id"), "task_id", "account_id", F.col("create_time").alias("exec_time"), "exec_type"), "exec_id").select(
        "exec_id", "task_id", "account_id", "exec_time", "exec_type", "pk_type",
        F.concat_ws("|", F.col("task_id").cast("string"), F.concat_ws(".", "source_db", "source_table")).alias("series"),
        F.greatest("source_rows", "target_rows").alias("n_rows"),
        (F.col("source_rows") + F.col("target_rows")).alias("both_rows"),
        F.col("changed_rows").alias("n_diff"), F.col("source_only_rows").alias("n_src"), F.col("target_only_rows").alias("n_tgt"),
        (F.col("changed_rows") + F.col("source_only_rows") + F.col("target_only_rows")).alias("d_row"),
        (2 * F.col("changed_rows") + F.col("source_only_rows") + F.col("target_only_rows")).alias("d_ms"),
        F.timestamp_diff("SECOND", F.date_trunc("second", "start_time"), F.date_trunc("second", "end_time")).alias("dur_s"),
        ((F.col("source_rows") == 0) & (F.col("target_rows") == 0)).alias("is_empty"),
        F.col("pk_type").isNull().alias("no_pk"),
    )
    usual = rec.where("d_row > 0").groupBy("series").agg(F.median("dur_s").alias("usual"))
    idle = F.coalesce((F.col("d_row") == 0) & (F.col("usual") > 10) & (F.col("dur_s") < F.col("usual") * 0.1), F.lit(False))
    r = rec.join(usual, "series", "left").withColumn("bucket", F.expr(tier("n_rows"))).withColumn("idle", idle).drop("usual")
    eligible = r.where("NOT is_empty AND NOT idle AND NOT no_pk")
    by = Window.partitionBy("series")
    order = by.orderBy("exec_time", "exec_id")
    seq = eligible.withColumn("runs", F.count("*").over(by)).withColumn("rn", F.row_number().over(order)).where(F.col("runs") >= PERIODIC_RUNS)
    isle = seq.withColumn("grp", F.col("rn") - F.row_number().over(Window.partitionBy("series", F.col("d_ms") > 0).orderBy("rn")))
    segs = isle.where("d_ms > 0").groupBy("series", "grp").agg(F.count("*").alias("len"), F.sum("dur_s").alias("sec"), F.min("rn").alias("r0"), F.max("rn").alias("r1"), F.min("d_ms").alias("dmin"), F.max("d_ms").alias("dmax"), F.count_distinct("d_ms").alias("nvals"), F.max("runs").alias("runs"))
    after = by.orderBy("rn")
    pairs = seq.select("*", F.lag("d_ms").over(after).alias("prev"), F.lead("d_ms").over(after).alias("next_d"), F.lag("exec_time").over(after).alias("prev_time"), F.sum(F.when(F.col("d_ms") == 0, 1).otherwise(0)).over(by).alias("zero_runs"))
    return {"execs": execs, "progress": progress, "rec": rec, "r": r, "ne": r.where("NOT is_empty"), "eligible": eligible, "seq": seq, "segs": segs, "pairs": pairs}


FACTS_SQL = f"""
WITH execs AS (
  SELECT event_id AS id, user_id % 7 AS task_id, user_id % 5 AS account_id, ts AS create_time, event_type AS exec_type,
         CASE WHEN event_id % 50 = 49 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 40 = 0 THEN 10 END AS sample_percent
  FROM events),
sized AS (
  SELECT *, CAST(round_even(value * 100, 0) AS BIGINT) AS cents, date_trunc('second', ts) AS start_time,
         CASE WHEN user_id % 13 = 0 THEN 0 ELSE (1 + user_id % 9) * CASE user_id % 5 WHEN 0 THEN 90 WHEN 1 THEN 9000 WHEN 2 THEN 900000 WHEN 3 THEN 9000000 ELSE 90000000 END END AS source_rows
  FROM events),
progress AS (
  SELECT CASE WHEN event_id % 200 = 7 THEN -event_id ELSE event_id END AS exec_id, 'db' || (user_id % 3) AS source_db,
         't' || user_id || CASE WHEN user_id % 4 = 0 THEN '_' || event_type ELSE '' END AS source_table,
         CASE WHEN user_id % 11 <> 0 THEN 'bigint' END AS pk_type, CASE WHEN event_id % 60 = 59 THEN 'failed' ELSE 'success' END AS status, start_time,
         start_time + to_seconds(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 20 + (cents % 900) * (1 + user_id % 4) END) AS end_time, source_rows,
         CASE WHEN user_id % 13 = 0 THEN 0 ELSE source_rows + event_id % 3 END AS target_rows,
         CASE WHEN user_id % 13 = 0 OR event_id % 7 < 4 THEN 0 ELSE (cents % 60) * CASE event_id % 11 WHEN 0 THEN 1000 WHEN 1 THEN 10000 ELSE 1 END END AS changed_rows,
         CASE WHEN user_id % 13 = 0 OR event_id % 7 < 3 THEN 0 ELSE event_id % 5 END AS source_only_rows,
         CASE WHEN user_id % 13 = 0 OR event_id % 7 < 3 THEN 0 ELSE event_id % 3 END AS target_only_rows
  FROM sized),
rec AS (
  SELECT p.exec_id, e.task_id, e.account_id, e.create_time AS exec_time, e.exec_type, p.pk_type, e.task_id || '|' || p.source_db || '.' || p.source_table AS series,
         greatest(source_rows, target_rows) AS n_rows, source_rows + target_rows AS both_rows, changed_rows AS n_diff, source_only_rows AS n_src, target_only_rows AS n_tgt,
         changed_rows + source_only_rows + target_only_rows AS d_row, 2 * changed_rows + source_only_rows + target_only_rows AS d_ms,
         date_diff('second', start_time, end_time) AS dur_s, source_rows = 0 AND target_rows = 0 AS is_empty, pk_type IS NULL AS no_pk
  FROM progress p JOIN execs e ON e.id = p.exec_id WHERE p.status = 'success' AND e.status = 'success' AND sample_percent IS NULL),
usual AS (SELECT series, median(dur_s) AS usual FROM rec WHERE d_row > 0 GROUP BY series),
r AS (SELECT rec.*, {tier("n_rows")} AS bucket, coalesce(d_row = 0 AND usual > 10 AND dur_s < usual * 0.1, false) AS idle FROM rec LEFT JOIN usual USING (series)),
ne AS (SELECT * FROM r WHERE NOT is_empty),
eligible AS (SELECT * FROM ne WHERE NOT idle AND NOT no_pk),
seq AS (SELECT *, count(*) OVER s AS runs, row_number() OVER (s ORDER BY exec_time, exec_id) AS rn FROM eligible WINDOW s AS (PARTITION BY series) QUALIFY runs >= {PERIODIC_RUNS}),
isle AS (SELECT *, rn - row_number() OVER (PARTITION BY series, d_ms > 0 ORDER BY rn) AS grp FROM seq),
segs AS (SELECT series, grp, count(*) AS len, sum(dur_s) AS sec, min(rn) AS r0, max(rn) AS r1, min(d_ms) AS dmin, max(d_ms) AS dmax, count(DISTINCT d_ms) AS nvals, max(runs) AS runs FROM isle WHERE d_ms > 0 GROUP BY series, grp),
pairs AS (SELECT *, lag(d_ms) OVER w AS prev, lead(d_ms) OVER w AS next_d, lag(exec_time) OVER w AS prev_time, sum(CASE WHEN d_ms = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series) AS zero_runs FROM seq WINDOW w AS (PARTITION BY series ORDER BY rn)),
longest_first AS (SELECT dur_s, d_row, n_rows, row_number() OVER (ORDER BY dur_s DESC, exec_id) AS rn FROM eligible WHERE dur_s IS NOT NULL),
deciles AS (SELECT dur_s, d_row, n_rows, ntile(10) OVER (ORDER BY dur_s, exec_id) AS decile FROM eligible),
{", ".join(_steps_sql(x, where) for x, where in LADDERS.items())}
"""

Text = Callable[[Dialect], str]
ANALYSES: dict[str, Text] = {}


def analysis(name: str):
    def keep(f: Text) -> Text:
        ANALYSES[name] = f
        return f

    return keep


@analysis("a00_scope")
def _(d):
    return """SELECT count(*) AS recs, count(*) FILTER (WHERE is_empty) AS empty_recs, count(*) FILTER (WHERE no_pk) AS no_pk_recs, count(*) FILTER (WHERE idle) AS idle_recs,
      count(*) FILTER (WHERE NOT is_empty AND NOT idle AND NOT no_pk) AS eligible_recs, count(DISTINCT exec_id) AS execs, count(DISTINCT task_id) AS tasks,
      count(DISTINCT series) AS series, min(exec_time) AS t0, max(exec_time) AS t1 FROM {r}"""


@analysis("a00_data_quality")
def _(d):
    return f"""SELECT raw.recs AS raw_progress_recs, raw.execs AS raw_progress_execs, x.n AS raw_execs, x.sampled AS sampled_execs, lost.recs AS unmatched_progress_recs,
      lost.execs AS unmatched_progress_execs, timeless.n AS matched_null_duration_recs, keyless.n AS nonempty_no_pk_recs, keyless.share AS pct_table_time_no_pk
    FROM (SELECT count(*) AS recs, count(DISTINCT exec_id) AS execs FROM {{progress}}) raw,
      (SELECT count(*) AS n, count(DISTINCT CASE WHEN sample_percent IS NOT NULL THEN id END) AS sampled FROM {{execs}}) x,
      (SELECT count(*) AS recs, count(DISTINCT exec_id) AS execs FROM {{progress}} p WHERE NOT EXISTS (SELECT 1 FROM {{execs}} e WHERE e.id = p.exec_id)) lost,
      (SELECT count(*) FILTER (WHERE dur_s IS NULL) AS n FROM {{rec}}) timeless,
      (SELECT count(*) FILTER (WHERE no_pk) AS n, {d.pct("sum(dur_s) FILTER (WHERE no_pk)", "sum(dur_s)", 3)} AS share FROM {{ne}}) keyless"""


@analysis("a02_zero_difference_by_scope")
def _(d):
    scopes = (("1_all", "{r}", "true"), ("2_not_empty", "{ne}", "true"), ("3_not_idle", "{ne}", "NOT idle"), ("4_deployable", "{eligible}", "true"), ("5_from_1e3", "{eligible}", "n_rows >= 1000"), ("6_from_1e6", "{eligible}", "n_rows >= 1000000"))
    return " UNION ALL ".join(f"SELECT '{name}' AS scope, count(*) AS recs, {d.share('d_row = 0')} AS pct_d0 FROM {t} WHERE {w}" for name, t, w in scopes)


@analysis("a03_by_table_size")
def _(d):
    return f"""SELECT e.bucket, count(*) AS recs, {d.share("d_row = 0")} AS pct_d0, {d.whole("median(n_rows)")} AS med_n, {d.whole("median(dur_s)")} AS med_dur_s, {d.whole(d.q("dur_s", 0.9))} AS p90_dur_s,
      {d.r("sum(dur_s) / 3.6e3", 1)} AS table_hours, {d.pct("sum(dur_s)", "max(t.sec)")} AS pct_table_time, {d.pct("sum(n_rows)", "max(t.n)")} AS pct_max_side_rows
    FROM {{eligible}} e, (SELECT sum(dur_s) AS sec, sum(n_rows) AS n FROM {{eligible}}) t GROUP BY e.bucket"""


@analysis("a04_time_concentration")
def _(d):
    slices = (("1_top 0.1%", "rn <= greatest(1, floor(1e-3 * n))"), ("2_top 1%", "rn <= greatest(1, floor(1e-2 * n))"), ("3_top 5%", "rn <= greatest(1, floor(5e-2 * n))"), ("4_top 10%", "rn <= greatest(1, floor(1e-1 * n))"), ("5_bottom 50%", "rn > floor(n / 2e0)"))
    ranked = "(SELECT e.*, t.n, t.sec FROM {longest_first} e, (SELECT count(*) AS n, sum(dur_s) AS sec FROM {longest_first}) t)"
    return " UNION ALL ".join(f"SELECT '{name}' AS slice, count(*) AS recs, {d.pct('sum(dur_s)', 'max(sec)')} AS pct_of_total_time, {d.share('d_row > 0')} AS pct_d_gt0, {d.r('median(dur_s) / 3.6e3', 4)} AS med_hours, {d.r('median(n_rows) / 1e6', 4)} AS med_n_millions FROM {ranked} x WHERE {w}" for name, w in slices)


def _ladder(d: Dialect, x: str, capacity: bool = False) -> str:
    """Twelve quantiles and the maximum of x, each with the share of the sum of x at or below it."""
    marks = [(f"p{p * 100:g}", f"q{i}") for i, p in enumerate(LADDER)] + [("max", "CAST(mx AS DOUBLE)")]
    sums = ", ".join(f"sum(CASE WHEN e.{x} <= q.{v if v.startswith('q') else 'mx'} THEN e.{x} END) AS s{i}" for i, (_, v) in enumerate(marks))
    one = f"(SELECT {', '.join(f'max(q.{v}) AS {v}' for _, v in marks[:-1])}, max(q.mx) AS mx, {sums}, sum(e.{x}) AS total FROM (SELECT {x} FROM {{eligible}} WHERE {LADDERS[x]}) e, {{steps_{x}}} q)"
    names = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(marks))
    v = "CASE m.i " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(marks)) + " END"
    below = "CASE m.i " + " ".join(f"WHEN {i} THEN s{i}" for i in range(len(marks))) + " END"
    fits = f", CASE WHEN {v} <= {CELLS} / {BETA}e0 THEN 'yes' ELSE 'no' END AS fits_first_round" if capacity else ""
    return f"SELECT m.quantile, {d.r(v, 3)} AS v, {d.pct(below, 'total', 2)} AS cum_pct{fits} FROM {one} o, (VALUES {names}) AS m(i, quantile)"


@analysis("a05_duration_ladder")
def _(d):
    return _ladder(d, "dur_s")


@analysis("a05_size_ladder")
def _(d):
    return _ladder(d, "n_rows")


@analysis("a05_difference_ladder")
def _(d):
    return _ladder(d, "d_ms", True)


@analysis("a06_size_by_duration_decile")
def _(d):
    return f"""SELECT decile, count(*) AS recs, {d.whole("median(dur_s)")} AS med_dur_s, {d.whole(d.q("n_rows", 0.1))} AS n_p10, {d.whole("median(n_rows)")} AS n_p50, {d.whole(d.q("n_rows", 0.9))} AS n_p90,
      {d.r("median(n_rows * 1e0 / nullif(dur_s, 0))", 0)} AS med_rows_per_s, {d.share("d_row = 0")} AS pct_d0, {d.pct("sum(n_rows)", "max(n)", 2)} AS pct_max_side_rows, {d.pct("sum(dur_s)", "max(sec)", 2)} AS pct_table_time
    FROM (SELECT e.*, t.n, t.sec FROM {{deciles}} e, (SELECT sum(n_rows) AS n, sum(dur_s) AS sec FROM {{deciles}}) t) x GROUP BY decile"""


def _batch_tail(d: Dialect, batch: str, least: int) -> str:
    return f"""SELECT count(*) AS batches, {d.whole("median(n)")} AS med_tables, {d.whole("median(med)")} AS med_table_s, {d.r("median(mx) / 3.6e3", 2)} AS med_slowest_h, {d.r("median(mx / nullif(med, 0))", 0)} AS slowest_over_median, {d.r("1e2 * median(mx * 1e0 / nullif(tot, 0))", 1)} AS pct_in_slowest
    FROM (SELECT count(*) AS n, median(dur_s) AS med, max(dur_s) AS mx, sum(dur_s) AS tot FROM {{eligible}} WHERE dur_s IS NOT NULL GROUP BY {batch} HAVING count(*) >= {least}) b"""


@analysis("a07_batch_tail")
def _(d):
    return _batch_tail(d, "exec_id", 10)


@analysis("a07_batch_tail_by_day")
def _(d):
    return _batch_tail(d, "task_id, account_id, CAST(exec_time AS DATE)", 10)


@analysis("a08_workload_concentration")
def _(d):
    mine, large = "a.account_id = top.account_id", "n_rows >= 100000000"
    return f"""SELECT {d.pct(f"sum(dur_s) FILTER (WHERE {mine})", "sum(dur_s)")} AS top_pct_time, {d.pct(f"sum(n_rows) FILTER (WHERE {mine})", "sum(n_rows)")} AS top_pct_rows, {d.share(mine)} AS top_pct_recs,
      {d.pct(f"count(*) FILTER (WHERE {mine} AND {large})", f"count(*) FILTER (WHERE {large})")} AS top_pct_large, {d.pct(f"count(*) FILTER (WHERE {mine} AND {large} AND d_row > 0)", f"count(*) FILTER (WHERE {large} AND d_row > 0)")} AS top_pct_large_dirty,
      {d.pct(f"count(*) FILTER (WHERE NOT ({mine}) AND d_row = 0)", f"count(*) FILTER (WHERE NOT ({mine}))")} AS others_pct_d0
    FROM {{eligible}} a, (SELECT account_id FROM {{eligible}} GROUP BY account_id ORDER BY sum(dur_s) DESC, account_id LIMIT 1) top"""


@analysis("a09_series_level")
def _(d):
    s = f"(SELECT CASE WHEN count(*) >= {PERIODIC_RUNS} THEN 'periodic' ELSE 'low-frequency' END AS kind, {tier('max(n_rows)')} AS bucket, sum(d_row) AS sd FROM {{eligible}} GROUP BY series)"
    return f"SELECT kind, bucket, count(*) AS series, {d.share('sd = 0')} AS pct_never_diff FROM {s} s GROUP BY kind, bucket UNION ALL SELECT kind, '_total', count(*), {d.share('sd = 0')} FROM {s} s GROUP BY kind"


@analysis("a10_capacity_read")
def _(d):
    return f"SELECT count(*) AS d_pos_recs, {d.share(f'd_ms <= {CELLS} / {BETA}e0')} AS pct_round1_decodes, {d.share(f'd_ms <= 4096 / {BETA}e0')} AS pct_fits_4096_cells, {d.share('d_ms > 1e6', 2)} AS pct_d_over_1e6 FROM {{eligible}} WHERE d_row > 0"


def _correlation(x: str, y: str) -> str:
    """Pearson's correlation of two columns from their sums; null where one of them does not vary."""
    apart = lambda v: f"(count(*) * sum({v} * {v}) - sum({v}) * sum({v}))"
    return f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / nullif(sqrt({apart(x)} * {apart(y)}), 0)"


@analysis("a11_within_table_rank_correlation")
def _(d):
    rank = lambda x: f"CAST(rank() OVER (PARTITION BY series ORDER BY {x}) AS DOUBLE)"
    return f"""SELECT count(*) AS series, {d.whole("median(runs)")} AS med_runs, {d.r(d.q("rho", 0.25), 3)} AS rho_p25, {d.r("median(rho)", 3)} AS rho_p50, {d.r(d.q("rho", 0.75), 3)} AS rho_p75, {d.share("rho > 0")} AS pct_positive, {d.share("rho > 0.3")} AS pct_gt_0_3, {d.share("rho < -0.3")} AS pct_lt_neg_0_3, {d.r("median(rho_nt)", 3)} AS rho_n_t_p50, {d.r("median(rho_dn)", 3)} AS rho_d_n_p50
    FROM (SELECT series, count(*) AS runs, {_correlation("rd", "rt")} AS rho, {_correlation("rn", "rt")} AS rho_nt, {_correlation("rd", "rn")} AS rho_dn FROM (SELECT series, d_ms, dur_s, {rank("d_ms")} AS rd, {rank("dur_s")} AS rt, {rank("n_rows")} AS rn FROM {{eligible}} WHERE dur_s IS NOT NULL) b
      GROUP BY series HAVING count(*) >= 20 AND count(DISTINCT d_ms) >= 5 AND min(dur_s) < max(dur_s)) c"""


@analysis("a12_zero_against_positive")
def _(d):
    t = "(SELECT series, median(dur_s) FILTER (WHERE d_row > 0) / nullif(median(dur_s) FILTER (WHERE d_row = 0), 0) AS ratio, median(n_rows) AS med_n FROM {eligible} WHERE dur_s IS NOT NULL GROUP BY series HAVING count(*) FILTER (WHERE d_row = 0) >= 3 AND count(*) FILTER (WHERE d_row > 0) >= 3)"
    cols = f"count(*) AS series, {d.r(d.q('ratio', 0.25), 2)} AS p25, {d.r('median(ratio)', 2)} AS p50, {d.r(d.q('ratio', 0.75), 2)} AS p75, {d.share('ratio > 1.1')} AS pct_slower_10"
    return f"SELECT 'all' AS scope, {cols} FROM {t} t WHERE ratio IS NOT NULL UNION ALL SELECT 'large', {cols} FROM {t} t WHERE ratio IS NOT NULL AND med_n >= 1000000"


@analysis("a13_difference_distribution")
def _(d):
    return " UNION ALL ".join(f"SELECT '{x}' AS metric, count(*) AS n, {d.whole(d.q(x, 0.5))} AS p50, {d.whole(d.q(x, 0.9))} AS p90, {d.whole(d.q(x, 0.99))} AS p99, max({x}) AS mx FROM {{eligible}} WHERE d_row > 0" for x in ("d_row", "d_ms"))


@analysis("a13_relative_difference_by_size")
def _(d):
    x = "d_ms * 1e0 / n_rows"
    return f"SELECT bucket, count(*) AS n, {', '.join(f'{d.r(d.q(x, p), 9)} AS {name}' for name, p in (('p01', 0.01), ('p25', 0.25), ('p50', 0.5), ('p90', 0.9)))} FROM {{eligible}} WHERE d_row > 0 AND n_rows >= 1000 GROUP BY bucket"


@analysis("a14_composition")
def _(d):
    parts = (("n_diff", "pct_different"), ("n_src", "pct_only_source"), ("n_tgt", "pct_only_target"))
    return f"SELECT 'magnitude' AS weighting, {', '.join(f'{d.pct(f"sum({c})", "sum(d_row)")} AS {n}' for c, n in parts)} FROM {{eligible}} WHERE d_row > 0 UNION ALL SELECT 'occurrence', {', '.join(d.share(f'{c} > 0') for c, _ in parts)} FROM {{eligible}} WHERE d_row > 0"


@analysis("a15_cadence")
def _(d):
    gap = f"(SELECT {d.seconds('prev_time', 'exec_time')} / 3.6e3 AS h FROM {{pairs}} WHERE prev_time IS NOT NULL)"
    return f"""SELECT a.runs AS table_runs, a.days AS series_days, a.runs - a.days AS extra_same_day_runs, {d.pct("a.runs - a.days", "a.runs", 2)} AS pct_extra, g.p50 AS gap_p50_h, g.p95 AS gap_p95_h, {d.pct("p.n", "a.runs", 2)} AS periodic_pct_recs, {d.pct("p.sec", "a.sec", 2)} AS periodic_pct_time, {d.pct("p.rows", "a.rows", 2)} AS periodic_pct_rows
    FROM (SELECT count(*) AS runs, count(DISTINCT series || '|' || CAST(CAST(exec_time AS DATE) AS VARCHAR(10))) AS days, sum(dur_s) AS sec, sum(n_rows) AS rows FROM {{eligible}}) a,
      (SELECT {d.r(d.q("h", 0.5), 2)} AS p50, {d.r(d.q("h", 0.95), 2)} AS p95 FROM {gap} h) g, (SELECT count(*) AS n, sum(dur_s) AS sec, sum(n_rows) AS rows FROM {{seq}}) p"""


@analysis("a16_segment_stability")
def _(d):
    cols = f"count(*) AS segs, {d.share('nvals = 1')} AS pct_constant, {d.share('dmax <= 2 * dmin')} AS pct_max_le_2min, {d.r('median(dmax * 1e0 / dmin)', 2)} AS med_max_over_min, {d.r('sum(sec) / 3.6e3', 1)} AS table_hours"
    return " UNION ALL ".join(f"SELECT '{name}' AS subset, {cols} FROM {{segs}} WHERE {w}" for name, w in (("len>=2", "len >= 2"), ("len>=30", "len >= 30"), ("len>=2, constant", "len >= 2 AND nvals = 1")))


@analysis("a16_recurrence")
def _(d):
    return f"SELECT count(*) AS series_with_diff, {d.whole('median(n)')} AS med_segments, max(n) AS max_segments, {d.share('n >= 2')} AS pct_multi FROM (SELECT series, count(*) AS n FROM {{segs}} GROUP BY series) s"


@analysis("a16_length_histogram")
def _(d):
    bins = " ".join(f"WHEN len <= {top} THEN '{name}'" for top, name in ((1, "1_single"), (4, "2_2-4"), (14, "3_5-14"), (33, "4_15-33"), (59, "5_34-59"), (87, "6_60-87")))
    return f"SELECT bin, count(*) AS segs, {d.pct('count(*)', 'sum(count(*)) OVER ()')} AS pct, min(len) AS min_len, max(len) AS max_len FROM (SELECT CASE {bins} ELSE '7_88+' END AS bin, len FROM {{segs}}) b GROUP BY bin"


@analysis("a16_censoring")
def _(d):
    return """SELECT CASE WHEN len = 1 THEN '1_single' WHEN len <= 14 THEN '2_mid' ELSE '3_long' END AS kind, count(*) AS segs, count(*) FILTER (WHERE r0 > 1) AS start_observed, count(*) FILTER (WHERE r1 < runs) AS end_observed, count(*) FILTER (WHERE r0 > 1 AND r1 < runs) AS fully_observed
    FROM {segs} GROUP BY CASE WHEN len = 1 THEN '1_single' WHEN len <= 14 THEN '2_mid' ELSE '3_long' END"""


@analysis("a16_long_segment_span")
def _(d):
    return f"SELECT count(*) AS segs_ge34, {d.r('median(len * 1e0 / runs)', 3)} AS med_span, {d.r(d.q('len * 1e0 / runs', 0.25), 3)} AS p25_span, count(*) FILTER (WHERE len = runs) AS whole_series FROM {{segs}} WHERE len >= 34"


@analysis("a16_positive_segment_length")
def _(d):
    return f"""SELECT count(*) AS segs, {d.whole(d.q("len", 0.5))} AS p50_len, {d.whole(d.q("len", 0.9))} AS p90_len, max(len) AS max_len, {d.share("len >= 30")} AS pct_ge30, count(*) FILTER (WHERE r0 = 1) AS left_censored, count(*) FILTER (WHERE r1 = runs) AS right_censored,
      count(*) FILTER (WHERE r0 = 1 OR r1 = runs) AS either_censored, count(*) FILTER (WHERE len >= 30 AND (r0 = 1 OR r1 = runs)) AS ge30_censored, {d.r("sum(sec) / 3.6e3", 1)} AS table_hours FROM {{segs}}"""


@analysis("a17_adjacent_ratio")
def _(d):
    steps = ", ".join(f"{d.r(d.q('rho', p), 9)} AS p{p * 100:02.0f}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"SELECT count(*) AS pairs, {steps}, {d.r('max(rho)', 9)} AS mx FROM (SELECT d_ms * 1e0 / prev AS rho FROM {{pairs}} WHERE prev > 0 AND d_ms > 0) x"


@analysis("a17_transitions")
def _(d):
    return f"""SELECT transition, n AS pairs, {d.pct("n", "sum(n) OVER ()", 2)} AS pct_all, {d.pct("n", "sum(n) OVER (PARTITION BY left(transition, 1))", 2)} AS pct_given_prev
    FROM (SELECT CASE WHEN prev = 0 THEN '0' ELSE '+' END || '->' || CASE WHEN d_ms = 0 THEN '0' ELSE '+' END AS transition, count(*) AS n FROM {{pairs}} WHERE prev IS NOT NULL GROUP BY CASE WHEN prev = 0 THEN '0' ELSE '+' END || '->' || CASE WHEN d_ms = 0 THEN '0' ELSE '+' END) t"""


@analysis("a17_state_persistence")
def _(d):
    return f"""SELECT count(*) AS pairs, {d.share("(prev = 0) = (d_ms = 0)", 2)} AS pct_unchanged, {d.share("(prev = 0) <> (d_ms = 0)", 2)} AS pct_flipped,
      {d.pct("count(*) FILTER (WHERE prev = 0 AND d_ms = 0)", "count(*) FILTER (WHERE prev = 0)", 2)} AS pct_stay_zero, {d.pct("count(*) FILTER (WHERE prev > 0 AND d_ms > 0)", "count(*) FILTER (WHERE prev > 0)", 2)} AS pct_stay_positive FROM {{pairs}} WHERE prev IS NOT NULL"""


@analysis("a17_prior_hit")
def _(d):
    rho, fits = "d_ms * 1e0 / prev", f"greatest({CELLS}e0, {ALPHA}e0 * prev) >= {BETA}e0 * d_ms"
    both = "prev > 0 AND d_ms > 0"
    rules = (("rho<=1.11", both, f"{rho} <= 1.11e0"), ("rho<=alpha/beta", both, f"{rho} <= {ALPHA}e0 / {BETA}e0"), ("rho<=alpha", both, f"{rho} <= {ALPHA}e0"), ("fits, dirty now", "prev IS NOT NULL AND d_ms > 0", fits), ("fits or clean", "prev IS NOT NULL", f"d_ms = 0 OR {fits}"), ("rho>4", both, f"{rho} > 4"))
    return " UNION ALL ".join(f"SELECT '{name}' AS criterion, count(*) AS pairs, {d.share(c, 2)} AS pct FROM {{pairs}} WHERE {w}" for name, w, c in rules)


@analysis("a18_jump_instances")
def _(d):
    return f"""SELECT series, exec_id, prev AS prev_d_ms, d_ms AS cur_d_ms, {d.r("d_ms * 1e0 / prev", 1)} AS ratio, {d.up(f"log2({BETA}e0 * d_ms / ({ALPHA}e0 * prev))")} AS doubling_rounds
    FROM {{pairs}} WHERE prev > 0 AND d_ms > 4 * prev ORDER BY d_ms * 1e0 / prev DESC, exec_id LIMIT 15"""


@analysis("a18_blind_rounds")
def _(d):
    t = f"(SELECT bucket, CASE WHEN {BETA}e0 * d_ms <= {CELLS} THEN 1 ELSE 1 + {d.up(f'log2({BETA}e0 * d_ms / {CELLS})')} END AS rounds FROM {{eligible}} WHERE d_row > 0)"
    cols = f"count(*) AS recs, {d.whole('median(rounds)')} AS med_rounds, {d.whole(d.q('rounds', 0.9))} AS p90_rounds, max(rounds) AS max_rounds, {d.share('rounds = 1')} AS pct_one, {d.share('rounds >= 9')} AS pct_ge9"
    return f"SELECT bucket, {cols} FROM {t} t GROUP BY bucket UNION ALL SELECT '_total', {cols} FROM {t} t"


@analysis("a18_prior_miss")
def _(d):
    return f"""SELECT series, exec_id, exec_time, n_rows, d_ms, dur_s, runs AS series_runs, CAST(zero_runs AS BIGINT) AS zero_runs, next_d, 1 + {d.up(f"log2({BETA}e0 * d_ms / {CELLS})")} AS blind_rounds
    FROM {{pairs}} WHERE prev = 0 AND d_ms > 100000 ORDER BY d_ms DESC, exec_id LIMIT 10"""


@analysis("a19_ledger")
def _(d):
    return f"""SELECT {d.r("sum(n_rows) / 1e8", 1)} AS max_side_1e8, {d.r("sum(both_rows) / 1e8", 1)} AS both_side_1e8, {d.r("sum(dur_s) / 3.6e3", 0)} AS table_hours, {d.total("d_row")} AS diffs_row, {d.total("d_ms")} AS diffs_ms, {d.pct("sum(dur_s) FILTER (WHERE d_row = 0)", "sum(dur_s)")} AS pct_time_clean,
      {d.r("sum(n_rows) FILTER (WHERE d_row = 0) / 1e8", 1)} AS max_side_clean_1e8, {d.r("sum(both_rows) FILTER (WHERE d_row = 0) / 1e8", 1)} AS both_side_clean_1e8, {d.r("sum(n_rows) * 1e0 / nullif(sum(d_ms), 0)", 0)} AS rows_per_diff, {d.r("sum(both_rows) * 1e0 / nullif(sum(d_ms), 0)", 0)} AS both_rows_per_diff FROM {{eligible}}"""


@analysis("a19_byte_ledger")
def _(d):
    mb = lambda x: d.r(f"{x} / 1.048576e6", 2)
    cost = f"ceil({ALPHA}e0 * d_ms) * {CELL_BYTES}"
    return f"""SELECT exec_id, min(task_id) AS task_id, count(*) AS tables, count(*) FILTER (WHERE d_row > 0) AS dirty_tables, count(*) FILTER (WHERE {BETA}e0 * d_ms > {CELLS}) AS first_round_failures, {d.r("sum(n_rows) / 1e8", 2)} AS max_side_1e8, {d.r("sum(dur_s) / 3.6e3", 2)} AS table_hours, {d.total("d_row")} AS d_row, {d.total("d_ms")} AS d_ms,
      {mb(f"count(*) * {CELLS}e0 * {CELL_BYTES}")} AS round1_mb, {mb(f"sum(CASE WHEN d_row > 0 THEN {cost} ELSE 0 END)")} AS round2_all_mb, {mb(f"sum(CASE WHEN {BETA}e0 * d_ms > {CELLS} THEN {cost} ELSE 0 END)")} AS round2_needed_mb
    FROM {{eligible}} GROUP BY exec_id ORDER BY sum(n_rows) DESC, exec_id LIMIT 5"""


def _longest_first(eligible: DataFrame) -> DataFrame:
    timed = eligible.where("dur_s IS NOT NULL").select("dur_s", "d_row", "n_rows", "exec_id", (-F.col("dur_s")).alias("shorter"))
    return in_key_order(timed, ["shorter", "exec_id"]).select("dur_s", "d_row", "n_rows", (F.col("before") + 1).alias("rn"))


def _deciles(eligible: DataFrame) -> DataFrame:
    return positions.tiles(eligible.select("dur_s", "d_row", "n_rows", "exec_id"), ["dur_s", "exec_id"], 10).withColumnRenamed("tile", "decile")


def _steps(x: str) -> Callable[[DataFrame], DataFrame]:
    return lambda eligible: positions.quantiles(eligible.where(LADDERS[x]), x, {f"q{i}": p for i, p in enumerate(LADDER)} | {"mx": 1.0})


#: Tables made from the eligible records by position in key order, for the analyses that read them.
ORDERED: dict[str, Callable[[DataFrame], DataFrame]] = {"longest_first": _longest_first, "deciles": _deciles, **{f"steps_{x}": _steps(x) for x in LADDERS}}


def run(spark: SparkSession, frames: dict[str, DataFrame], name: str) -> DataFrame:
    """One analysis over the facts."""
    text = ANALYSES[name](Dialect())
    frames = frames | {k: make(frames["eligible"]) for k, make in ORDERED.items() if "{" + k + "}" in text}
    return spark.sql(text, **{k: v for k, v in frames.items() if "{" + k + "}" in text})


def checker_sql(name: str) -> str:
    """The statement of an analysis over the derived log, for the engine that checks it."""
    text = ANALYSES[name](Checker())
    for k in ("execs", "progress", "rec", "r", "ne", "eligible", "seq", "segs", "pairs", *ORDERED):
        text = text.replace("{" + k + "}", k)
    return f"{FACTS_SQL} SELECT * FROM ({text}) result"
