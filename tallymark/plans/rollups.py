"""Roll-ups of benchmark runs and other small aggregations over result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def benchmark_rollup(runs: DataFrame) -> DataFrame:
    """(pair, scenario, network, algorithm, n, median_s, min_s, max_s) of measured, passed runs(…, phase, status, e2e_s)."""
    good = runs.where("phase = 'measure' AND status = 'PASS' AND e2e_s IS NOT NULL")
    return good.groupBy("pair", "scenario", "network", "algorithm").agg(F.count("*").alias("n"), F.median("e2e_s").alias("median_s"), F.min("e2e_s").alias("min_s"), F.max("e2e_s").alias("max_s"))


def repeat_gate(runs: DataFrame, limit: float = 0.15, repeats: int = 2) -> DataFrame:
    """(network, algorithm, workers, n, spread, verdict): PASS where exactly `repeats` runs are within `limit` of each other."""
    got = runs.groupBy("network", "algorithm", "workers").agg(F.count("*").alias("n"), (F.max("e2e_s") / F.min("e2e_s") - 1).alias("spread"))
    return got.withColumn("verdict", F.when((F.col("n") == repeats) & (F.col("spread") <= limit), "PASS").otherwise("RERUN"))


def last_result(lines: DataFrame, marker: str = "RESULT") -> DataFrame:
    """(file, fields) from lines(file, pos, line): the key=value pairs of the last marked line of each file."""
    marked = lines.where(F.col("line").startswith(marker)).withColumn("fields", F.substring("line", len(marker) + 2, 1 << 30))
    return marked.groupBy("file").agg(F.max_by("fields", "pos").alias("fields")).withColumn("fields", F.str_to_map("fields", F.lit(" "), F.lit("=")))


def bucket_integrity(rows: DataFrame, buckets: list[str], total: str) -> DataFrame:
    """rows with `whole`: whether the rank buckets add up to the total."""
    return rows.withColumn("whole", F.aggregate(F.array(*(F.coalesce(F.col(b), F.lit(0)).cast("long") for b in buckets)), F.lit(0).cast("long"), lambda a, b: a + b) == F.col(total))


def anonymise(name: Column) -> Column:
    """A stable short alias of a name; 'T_unknown' for null."""
    return F.coalesce(F.concat(F.lit("T"), F.substring(F.sha2(name, 256), 1, 8)), F.lit("T_unknown"))


def value_signature(text: Column, amount: Column, category: Column, at: Column) -> Column:
    """Lower-cased text, cents rounded half up, category and second, joined by the unit separator; null is empty."""
    cents = F.round(amount.cast("decimal(24,6)") * 100, 0).cast("decimal(38,0)").cast("string")
    parts = (F.lower(text), cents, category.cast("string"), F.substring(F.substring_index(at.cast("string"), ".", 1), 1, 19))
    joined = F.coalesce(parts[0], F.lit(""))
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\x1f"), F.coalesce(p, F.lit("")))
    return joined


def sampled_fences(rows: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> DataFrame:
    """(fence) at about equal steps of a numeric key, from one approximate percentile pass; distinct, at most parts - 1."""
    steps = [i / parts for i in range(1, parts)]
    return rows.agg(F.percentile_approx(column, steps, accuracy).alias("f")).select(F.explode(F.array_distinct("f")).alias("fence"))


def failed_only_spread(summaries: DataFrame) -> DataFrame:
    """Failure-conditioned bias of summaries(mean_ratio_failed, rsd, p_fail) against its bound rsd * sqrt((1 - p) / p)."""
    bound = F.col("rsd") * F.sqrt((1 - F.col("p_fail")) / F.nullif("p_fail", F.lit(0.0)))
    return summaries.withColumn("bias_failed", F.abs(F.col("mean_ratio_failed") - 1)).withColumn("bound", bound).withColumn("within", F.col("bias_failed") <= F.col("bound") + 1e-12)


def missing_from_grid(results: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows of the expected grid that the results do not have."""
    return grid.join(results.select(*grid.columns).distinct(), grid.columns, "left_anti")


def suffix_shards(table: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, low, high, n): `shards` ranges of equal width over the number that ends a text key, and the keys in each; keys without one are left out."""
    number = F.nullif(F.regexp_extract(key, "([0-9]{1,18})$", 1), F.lit("")).cast("long")
    numbered = table.select(number.alias("number")).where("number IS NOT NULL")
    ends = numbered.agg(F.min("number").alias("first"), F.max("number").alias("last"))
    width = F.ceil((F.col("last") - F.col("first") + 1) / F.lit(shards)).cast("long")
    placed = numbered.join(F.broadcast(ends)).withColumn("width", width)  # one row of bounds
    shard = F.expr("(number - first) div width").cast("int")
    return placed.groupBy(shard.alias("shard")).agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n"))


def snapped_fences(table: DataFrame, key: str, parts: int) -> DataFrame:
    """(fence, probe, key): evenly spaced probes over an integer key, each snapped to the least key that is not below it; two scans, no sort."""
    k = F.col(key).cast("long")
    bounds = table.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).collect()[0]
    if bounds["lo"] is None:
        return table.sparkSession.createDataFrame([], "fence int, probe long, key long")
    probes = [bounds["lo"] + (bounds["hi"] - bounds["lo"]) * i // parts for i in range(1, parts)]
    row = table.agg(*(F.min(F.when(k >= p, k)).alias(f"k{i}") for i, p in enumerate(probes)))
    each = F.array(*(F.struct(F.lit(i + 1).alias("fence"), F.lit(p).cast("long").alias("probe"), F.col(f"k{i}").alias("key")) for i, p in enumerate(probes)))
    return row.select(F.explode(each).alias("f")).select("f.*")
