"""Readers and writers of comparison logs, run logs, snapshots and result files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXECS = "id LONG, task_id LONG, account_id LONG, create_time TIMESTAMP_NTZ, exec_type STRING, status STRING, sample_percent INT"
PROGRESS = "exec_id LONG, source_db STRING, source_table STRING, pk_type STRING, status STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, source_rows LONG, target_rows LONG, changed_rows LONG, source_only_rows LONG, target_only_rows LONG"
RUNS = "run_id STRING, src_table STRING, dst_table STRING, m1 LONG, m2 LONG, rounds LONG, outcome STRING, residual LONG, d_final LONG, d_plus LONG, d_minus LONG, d_hat_r1 DOUBLE, n_rows_src LONG, n_rows_dst LONG"


def read_csv_log(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV exports with a header each; columns are matched by name, absent ones are null."""
    wanted = spark.createDataFrame([], schema).schema
    parts = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        parts.append(raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name in raw.columns)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*(F.col(f.name) if f.name in whole.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines run log; of the records of one run the last counts, by file name, then by place in the file."""
    raw = spark.read.schema(RUNS).json(path).withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    last = Window.partitionBy("run_id").orderBy(F.desc("__file"), F.desc("__at"))
    return raw.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__file", "__at")


def content_sums(*columns: str) -> list[Column]:
    """(records, sum_high, sum_low): number of rows, and sums of both 60-bit halves of their MD5, the sums as text.

    Sums over all rows need no order, and unlike xors they see a row that is there twice. Null is a mark of its own.
    """
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)).cast("binary"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(19,0)")), F.lit(0)).cast("string")
    return [F.count("*").alias("records"), half(1).alias("sum_high"), half(17).alias("sum_low")]


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Fingerprints (fp, id) as Parquet with a manifest of their number and content, written last so that its presence means done."""
    rows.select("fp", "id").write.parquet(f"{path}/data")
    sums = rows.sparkSession.read.parquet(f"{path}/data").agg(*content_sums("fp", "id")).collect()[0]
    rows.sparkSession.createDataFrame([(json.dumps(sums.asDict()),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """A written snapshot; with verify its content is counted and summed again and held against the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").collect()[0][0])
    rows = spark.read.parquet(f"{path}/data")
    if verify:
        sums = rows.agg(*content_sums("fp", "id")).collect()[0].asDict()
        if sums != manifest:
            raise ValueError(f"snapshot does not match its manifest: {sums} != {manifest}")
    return rows


def write_csv(frame: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file with a header."""
    frame.coalesce(1).write.option("header", True).csv(path)


def shard(rows: DataFrame, column: str, shards: int, index: int) -> DataFrame:
    """Rows of one of `shards` hash shards of a column."""
    return rows.where(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(shards)) == index)
