import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import queries
from tallymark.functions import canonical as C
from tallymark.functions import hashing as H
from tallymark.operators import decode, estimators, keyvalue, merkle, rateless, reconcile, sketch
from tallymark.sim import correlation
from tallymark.sources import codec
from tallymark.spec import ORDERS, PkType, TableSpec, ValueType, pk_type, value_type

SF = "/root/testdata/sf0.001"

# Fixed values shared with other implementations of the same mapper.
GOLDEN_POSITIONS = [
    (0x206D7A4C58CD2C, 6000, 0, [3301, 359, 5223]),
    (0x206D7A4C58CD2C, 600, 0, [301, 359, 423]),
    (0x206D7A4C58CD2C, 6000, 0x1234, [1021, 161, 2602]),
    (0xBC6A786948D774, 6000, 0, [1431, 5820, 2338]),
    (0x20D, 6000, 0, [5167, 4921, 4024]),
]


def test_golden_vectors():
    assert H._sm(0) == 0 and H._sm(1) == 0x5692161D100B05E5 and H._sm(0x123456789ABCDEF0) == 0x9629F58E8EC5B906
    fps = np.array([0x206D7A4C58CD2C, 0xBC6A786948D774], np.uint64)
    assert H.checksum(fps).tolist() == [0xF5AA3C0C47B695A8, 0x2AE6BC9BD7B884D7]
    for fp, cells, seed, want in GOLDEN_POSITIONS:
        assert H.positions(np.array([fp], np.uint64), cells, seed)[0].tolist() == want


def test_positions_are_distinct_and_columns_agree(spark):
    fps = np.random.default_rng(1).integers(0, 2**56, 50_000, dtype=np.uint64)
    for cells in (4, 5, 64, 6000):
        at = H.positions(fps, cells, 7)
        assert at.min() >= 0 and at.max() < cells and all((at[:, i] != at[:, j]).all() for i, j in ((0, 1), (0, 2), (1, 2)))
    some = [int(v) for v in fps[:500].view(np.int64)] + [0, -1, -(1 << 63), (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in some], "x long").select(H.sm64_column(F.col("x")).alias("y"), H.unsigned_mod(F.col("x"), 1000).alias("m")).collect()
    x = np.array(some, np.int64).view(np.uint64)
    assert [r.y for r in got] == H.sm64(x).view(np.int64).tolist() and [r.m for r in got] == (x % np.uint64(1000)).tolist()
    with pytest.raises(ValueError):
        H.positions(fps, 3)


def test_key_ids(spark):
    rows = [bytes(range(n)) for n in range(40)]
    assert H.cheap_ids(rows).tolist() == [H.cheap_id(r) for r in rows]
    spec = TableSpec((("k", PkType.INT64),), ())
    frame = spark.createDataFrame([(v,) for v in (0, 1, -5, 10**12)], "k long")
    assert [r.id for r in sketch.fingerprints(frame, spec).collect()] == [r.id for r in frame.select(sketch.key_id(spec).alias("id")).collect()]


def test_type_names():
    assert pk_type("BIGINT") is PkType.INT64 and pk_type("interval") is PkType.STRING and pk_type("bigserial") is PkType.INT64 and pk_type("numeric(10,2)") is PkType.DECIMAL
    assert value_type("VarChar") is ValueType.STRING and value_type("numeric4") is ValueType.DECIMAL4
    with pytest.raises(ValueError):
        value_type("blob")


def test_canonical_text_and_codec(spark):
    spec = TableSpec((("k", PkType.DECIMAL), ("s", PkType.STRING)), (("m", ValueType.MONEY2), ("v", ValueType.STRING)))
    frame = spark.sql("SELECT CAST('10.500' AS DECIMAL(10,3)) AS k, 'Ab  ' AS s, CAST(2.675 AS DOUBLE) AS m, CAST(NULL AS STRING) AS v")
    row = frame.select(C.row_text(spec).alias("t"), C.pk_wire(spec).alias("w"), *(c.alias(f"b{i}") for i, c in enumerate(C.pk_unwire(C.pk_wire(spec), 2)))).collect()[0]
    assert row.t == "10.5\x1fab\x1f268\x1f<null>" and row.b0 == "10.5" and row.b1 == "ab" and row.w.startswith("CK1:")
    raw = frame.select(C.pk_bytes(spec).alias("b")).collect()[0].b
    assert bytes(raw) == b"\x01\x02\x01\x00\x00\x00\x00\x0410.5\x02\x00\x00\x00\x00\x02ab"


def copies(spark):
    return queries.copies(spark, SF, "orders")


def test_reconcile_equals_full_outer_join(spark):
    source, target, spec = copies(spark)
    want = sorted(map(tuple, reconcile.full_outer(source, target, spec).collect()))
    assert want and sorted(map(tuple, reconcile.reconcile(source, target, spec, seed=3).collect())) == want
    assert sorted(map(tuple, reconcile.reconcile(source, target, spec, seed=3, cells=16).collect())) == want  # second round
    assert sorted(map(tuple, reconcile.reconcile(source, target, spec, seed=3, cells=16, cap=20).collect())) == want  # exact way
    assert reconcile.reconcile(source, source, spec, seed=3).count() == 0


def test_compare_outcomes(spark):
    source, target, spec = copies(spark)
    with reconcile.Session(source, spec) as a, reconcile.Session(target, spec) as b:
        one = reconcile.compare(a, b, seed=9)
        assert one.status == "OK" and one.rounds == 1 and 40 < one.d_hat < 95
        two = reconcile.compare(a, b, cells=16, seed=9)
        assert two.status == "OK" and two.rounds == 2
        assert reconcile.compare(a, b, cells=16, cap=20, seed=9).status == "FALLBACK"


def test_sketches_merge_and_travel(spark):
    source, target, spec = copies(spark)
    a, b = sketch.fingerprints(source, spec), sketch.fingerprints(target, spec)
    whole = sketch.to_arrays(sketch.sketch(a, 64), 64)
    parts = sketch.merge(sketch.sketch(a.where("id % 2 = 0"), 64).unionByName(sketch.sketch(a.where("id % 2 <> 0"), 64)))
    assert (sketch.to_arrays(parts, 64) == whole).all()
    view, seed = codec.from_text(codec.to_text(sketch.to_arrays(sketch.sketch(a, 512, 5), 512), 5))
    other, _ = codec.from_text(codec.to_text(sketch.to_arrays(sketch.sketch(b, 512, 5), 512), 5))
    diff = view.copy()
    diff[0] -= other[0]
    diff[1:] ^= other[1:]
    assert decode.peel([diff], [seed]).complete
    raw = bytearray(codec.encode(view, 5))
    raw[11] = 9
    with pytest.raises(ValueError):
        codec.decode(bytes(raw))


def test_duplicate_keys_are_not_decodable(spark):
    spec = TableSpec((("k", PkType.INT64),), ())
    frame = spark.createDataFrame([(1,), (1,)], "k long")
    view = sketch.to_arrays(sketch.sketch(sketch.fingerprints(frame, spec), 64), 64)
    assert not decode.peel([view], [0]).complete


def test_merkle_over_composite_string_keys(spark):
    rows = [(f"k{i % 7}", i, i * 31) for i in range(2000)]
    a = spark.createDataFrame(rows, "s string, n long, fp long")
    b = spark.createDataFrame([(s, n, fp + (n % 500 == 3)) for s, n, fp in rows if n % 400 != 9] + [("zz", 1, 5)], "s string, n long, fp long")
    got = {(r.s, r.n): r.kind for r in merkle.merkle_compare(a, b, ["s", "n"], every=300, drill_cap=40, fanout=4).collect()}
    want = {(f"k{i % 7}", i): "changed" for i in range(3, 2000, 500)} | {(f"k{i % 7}", i): "source_only" for i in range(9, 2000, 400)} | {("zz", 1): "target_only"}
    assert got == want
    assert merkle.fences(a, ["s", "n"], 300).count() == 6
    assert merkle.merkle_compare(a, a, ["s", "n"], every=300).count() == 0


def test_key_value_digests_ignore_written_order(spark):
    schema = "key string, type string, str string, list array<string>, set array<string>, hash map<string,string>"
    a = spark.createDataFrame([("a", "set", None, None, ["x", "y"], None), ("b", "hash", None, None, None, {"p": "1", "q": "2"}), ("c", "list", None, ["x", "y"], None, None), ("d", "string", "v", None, None, None)], schema)
    b = spark.createDataFrame([("a", "set", None, None, ["y", "x"], None), ("b", "hash", None, None, None, {"q": "2", "p": "1"}), ("c", "list", None, ["y", "x"], None, None), ("e", "string", "v", None, None, None)], schema)
    rows = [keyvalue.with_ids(keyvalue.digests(t)).select("key", "id", "fp") for t in (a, b)]
    assert {(r.key, r.kind) for r in keyvalue.compare(*rows, buckets=8).collect()} == {("c", "changed"), ("d", "source_only"), ("e", "target_only")}


def test_estimators(spark):
    rng = np.random.default_rng(2)
    rows = [(int(f), 1) for f in rng.integers(0, 2**56, 4000)] + [(int(f), -1) for f in rng.integers(0, 2**56, 1000)]
    frame = spark.createDataFrame(rows, "fp long, sign long")
    assert 2500 < estimators.strata_estimate(estimators.strata_cells(frame)) < 10000
    assert 0 < estimators.tug_of_war(frame.withColumn("sign", F.when(F.col("sign") > 0, 1).otherwise(-1)), 128).collect()[0].d_hat


def test_every_query_of_the_library_is_checked():
    assert len(queries.ORACLES) >= 60 and set(queries.ORACLES) <= set(queries.QUERIES)


def test_rateless_prefixes_decode(spark):
    a = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 56)).alias("fp"), "id")
    b = a.where("id % 50 <> 7").unionByName(spark.range(5000, 5020).select(F.pmod(F.xxhash64("id"), F.lit(1 << 56)).alias("fp"), "id"))
    got, used = rateless.reconcile_rateless(a, b, first=64, growth=1.5)
    assert got.complete and {r for _, r in got.plus} == set(range(7, 3000, 50)) and {r for _, r in got.minus} == set(range(5000, 5020))
    assert used <= 4 * 80
    same, few = rateless.reconcile_rateless(a, a, first=8)
    assert same.complete and few == 8 and not same.plus
    stuck, cap = rateless.reconcile_rateless(a, b, first=4, cap=8)
    assert not stuck.complete and cap == 8
    whole = rateless.coded_symbols(a, 100)
    parts = rateless.coded_symbols(a, 100, shards=4).groupBy("idx").agg(F.sum("cnt").alias("cnt"), *(F.bit_xor(c).alias(c) for c in ("fp_xor", "id_xor", "hash_xor")))
    assert (rateless.to_array(whole, 100) == rateless.to_array(parts, 100)).all()


def test_rateless_query_is_whole_past_the_cap(spark, monkeypatch):
    few = rateless.reconcile_rateless
    monkeypatch.setattr(rateless, "reconcile_rateless", lambda a, b: few(a, b, first=4, cap=8))
    got = {tuple(r) for r in queries.QUERIES["s15_rateless_reconcile_orders"](spark, SF).collect()}
    want = {tuple(r) for r in reconcile.full_outer(*queries.copies(spark, SF, "orders")).collect()}
    assert len(want) > 8 and got == want


def test_exact_and_simulated_signs_agree(spark):
    for m, k, d in ((4, 2, 3), (5, 2, 4)):
        one = correlation.exact(spark, [(m, k, d)]).collect()[0]
        many = correlation.simulated(spark, m, k, d, 4000).collect()[0]
        assert abs(many.failed / many.trials - one.p_fail) < 0.04 and abs(many.c_f - one.c_f) < 0.1


def test_scans_read_only_named_columns(spark):
    source, target, spec = copies(spark)
    plan = sketch.sketch(sketch.fingerprints(source, spec), 64)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey" in plan and "o_orderdate" not in plan
    assert plan.count("Exchange") == 1  # partial sketches meet once
    lines = queries.table(spark, SF, "lineitem").where("l_shipdate < timestamp_ntz'1995-01-01'").select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in lines._jdf.queryExecution().executedPlan().toString()


def test_descent_cuts_rows_that_one_side_alone_has(spark):
    """300 rows of the target lie below every key of the source: one range, which only the target's keys can cut."""
    a = spark.range(0, 1000).selectExpr("id AS k", "id * 7 AS fp")
    b = a.where("k % 50 <> 3").unionByName(spark.range(-300, 0).selectExpr("id AS k", "id AS fp"))
    want = {(k, "source_only") for k in range(1000) if k % 50 == 3} | {(k, "target_only") for k in range(-300, 0)}
    for dirty_only in (True, False):
        got = merkle.merkle_compare(a, b, ["k"], every=200, drill_cap=40, dirty_only=dirty_only)
        assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(RuntimeError):
        merkle.merkle_compare(a.withColumn("k", F.lit(1)), b, ["k"], every=200, drill_cap=40, rounds=2)
