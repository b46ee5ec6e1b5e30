import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import queries
from tallymark.datagen import generate
from tallymark.operators import keyvalue, reconcile, sketch
from tallymark.plans import fleet, positions, rollups
from tallymark.sim import trials
from tallymark.sources import logs
from tallymark.spec import PkType, TableSpec, ValueType
from tallymark.streaming import merge as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    cols = sorted(frame.columns)
    shown = frame[cols].astype(object).where(frame[cols].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v)
    return sorted(map(str, shown.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, checker, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), checker.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_facts_of_an_empty_log(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(0)
    frames = fleet.facts(*fleet.derived_log(events))
    for name in fleet.ANALYSES:
        fleet.run(spark, frames, name).collect()


def test_positions_of_hot_and_few_values(spark):
    values = [7] * 500 + list(range(101)) + [None, None]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x long, i long").repartition(5)
    steps = {"low": 0.0, "tenth": 0.1, "mid": 0.5, "high": 0.999, "top": 1.0}
    got = positions.quantiles(rows, "x", steps).collect()[0]
    assert np.allclose([got[k] for k in steps], np.quantile([v for v in values if v is not None], list(steps.values())))
    assert positions.quantiles(rows.where("x IS NULL"), "x", steps).collect() == [(None,) * len(steps)]
    for n in (0, 4, 10, 23):
        tiles = {r.i: r.tile for r in positions.tiles(rows.where(F.col("i") < n), ["i"], 10).collect()}
        assert [tiles[i] for i in range(n)] == [1 + k for k, part in enumerate(np.array_split(np.arange(n), 10)) for _ in part]


def test_generated_differences_are_counted_exactly(spark):
    p = generate.Profile(256, 4, 2, 1, block=256)
    assert (p.d_row, p.d_ms) == (7, 11)
    wide = generate.Profile(20_000, 28, 2, 3, dirty_blocks=4, block=5_000)
    assert wide.counts == (28, 4, 4)
    spec = TableSpec((("key_01", PkType.INT64),), (("value_00", ValueType.INT), ("value_01", ValueType.STRING), ("value_02", ValueType.DECIMAL4), ("value_03", ValueType.DATETIME_SEC)))
    for profile in (p, wide):
        a, b = generate.table(spark, profile, "source"), generate.table(spark, profile, "target")
        assert a.select("key_01").distinct().count() == a.count() == profile.rows
        got = {r.kind: r["count"] for r in reconcile.full_outer(a, b, spec).groupBy("kind").count().collect()}
        assert (got.get("changed", 0), got.get("source_only", 0), got.get("target_only", 0)) == profile.counts


def test_generated_key_values(spark):
    sides = [keyvalue.with_ids(keyvalue.digests(generate.key_values(spark, 300, 12, 5, 4, s))).select("key", "id", "fp") for s in ("source", "target")]
    got = {r.kind: r["count"] for r in keyvalue.compare(*sides, buckets=32).groupBy("kind").count().collect()}
    assert got == {"changed": 12, "source_only": 5, "target_only": 4}


def test_trials_follow_theory(spark):
    configs = [trials.Config(256, 100), trials.Config(256, 400, negative=-1), trials.Config(256, 150, degrees=trials.IRREGULAR), trials.Config(64, 0)]
    got = {r.config: r for r in trials.summary(trials.run(spark, configs, 400), configs).collect()}
    for i in (0, 1):
        assert abs(got[i].mean_ratio - 1) < 0.03 and abs(got[i].rsd / got[i].rsd_theory - 1) < 0.2
    assert got[0].p_fail < 0.05 and got[1].p_fail == 1.0 and abs(got[2].mean_ratio - 1) < 0.05
    again = trials.run(spark, configs[:1], 20).orderBy("trial").collect()
    assert again == trials.run(spark, configs[:1], 20).repartition(3).orderBy("trial").collect()
    assert trials.guidance(trials.summary(trials.run(spark, configs, 50), configs)).where("alpha < 1").count() == 0


def test_second_rounds_and_pipelines(spark):
    got = trials.retry_success(spark, 64, [80], [1.6, 2.4], 60).orderBy("gamma").collect()
    assert got[0].failed_first > 40 and got[0].decoded <= got[1].decoded <= 60
    table = spark.createDataFrame([(64, *g) for g in map(tuple, got)], "cells int, d int, gamma double, trials long, failed_first long, decoded long, decoded_after_failure long")
    assert {r.scope for r in trials.scopes(table, 32).collect()} == {"all", "all_from_32", "by_cells", "failed_only_all", "failed_only_all_from_32", "failed_only_by_cells"}
    cost = {(r.pipeline, r.d): r for r in trials.pipelines(spark, [0, 200], 20).collect()}
    assert cost["oracle", 0].mean_bytes == 64 * 32 and cost["one_jump_joint", 200].mean_bytes <= cost["one_jump", 200].mean_bytes and cost["blind_doubling", 200].mean_rounds > cost["one_jump", 200].mean_rounds


def test_log_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,task_id,status\n1,2,success\n")
    (tmp_path / "b.csv").write_text("status,id,sample_percent\nfailed,3,10\n")
    got = logs.read_csv_log(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], logs.EXECS).orderBy("id").collect()
    assert [(r.id, r.task_id, r.status, r.sample_percent) for r in got] == [(1, 2, "success", None), (3, None, "failed", 10)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "1.jsonl").write_text("\n".join(json.dumps({"run_id": r, "rounds": n}) for r, n in (("x", 1), ("y", 1), ("x", 2))))
    (tmp_path / "runs" / "2.jsonl").write_text(json.dumps({"run_id": "y", "rounds": 7}))
    assert {(r.run_id, r.rounds) for r in logs.read_run_log(spark, str(tmp_path / "runs")).collect()} == {("x", 2), ("y", 7)}
    rows = spark.range(50).select(F.xxhash64("id").alias("fp"), "id")
    logs.write_snapshot(rows, str(tmp_path / "snap"))
    assert logs.read_snapshot(spark, str(tmp_path / "snap")).count() == 50
    spark.range(1).select(F.lit(1).cast("long").alias("fp"), F.lit(1).cast("long").alias("id")).write.mode("append").parquet(str(tmp_path / "snap" / "data"))
    with pytest.raises(ValueError):
        logs.read_snapshot(spark, str(tmp_path / "snap"))
    assert sum(logs.shard(rows, "id", 4, i).count() for i in range(4)) == 50
    twice = rows.where("id = 3").unionByName(rows.where("id = 3"))  # a row and its copy cancel in an xor, not in a sum
    one, two = (f.agg(*logs.content_sums("fp", "id")).collect()[0] for f in (rows, rows.unionByName(twice)))
    assert (one.sum_high, one.sum_low) != (two.sum_high, two.sum_low)
    assert rows.limit(0).agg(*logs.content_sums("fp", "id")).collect()[0] == (0, "0", "0")


def test_streamed_sketch_equals_batch_sketch(spark, tmp_path):
    rows = spark.range(400).select(F.pmod(F.xxhash64("id"), F.lit(1 << 56)).alias("fp"), "id")
    for i in range(3):
        rows.where(F.col("id") % 3 == i).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("fp long, id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream.maintain(source, str(tmp_path / "cells"), str(tmp_path / "check"), 64).awaitTermination()
    a, b = (sketch.to_arrays(s, 64) for s in (stream.current(spark, str(tmp_path / "cells")), sketch.sketch(rows, 64)))
    assert np.array_equal(a, b)


def test_rollups(spark):
    lines = spark.createDataFrame([("a", 1, "RESULT n=1 s=2"), ("a", 5, "RESULT n=7 s=9"), ("a", 9, "other n=8"), ("b", 2, "RESULT n=3")], "file string, pos long, line string")
    assert {r.file: r.fields for r in rollups.last_result(lines).collect()} == {"a": {"n": "7", "s": "9"}, "b": {"n": "3"}}
    rows = spark.createDataFrame([(1, 2, 3), (1, None, 1), (2, 2, 5)], "b0 int, b1 int, total long")
    assert [r.whole for r in rollups.bucket_integrity(rows, ["b0", "b1"], "total").collect()] == [True, True, False]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS s").select(rollups.anonymise(F.col("s")).alias("a")).collect()[0].a == "T_unknown"
    grid = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert rollups.missing_from_grid(grid.where("b = 2"), grid).collect()[0].b == 3
    configs = [trials.Config(64, 52)]
    got = rollups.failed_only_spread(trials.summary(trials.run(spark, configs, 300), configs)).collect()[0]
    assert got.within
