"""The library's registered queries, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical as C
from .functions import hashing as H
from .datagen import generate
from .operators import estimators, keyvalue, merkle, pushdown, rateless, reconcile, sketch
from .plans import fleet, rollups, run_summary
from .sim import checks, correlation, sweep, trials
from .sources import logs
from .spec import CUSTOMER, ORDERS, PART, PkType, TableSpec, ValueType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CELLS = 512
TABLES = {"orders": (ORDERS, "o_totalprice"), "customer": (CUSTOMER, "c_acctbal"), "part": (PART, "p_retailprice")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target_copy(source: DataFrame, key: str, money: str) -> DataFrame:
    """A second copy with known differences: some rows missing, some with another price, some added under negative keys."""
    k = F.col(key)
    kept = source.where(k % 97 != 0).withColumn(money, F.when(k % 89 == 1, F.col(money) + 1.25).otherwise(F.col(money)))
    return kept.unionByName(source.where(k % 101 == 2).withColumn(key, -(k + 1)))


def copies(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, TableSpec]:
    spec, money = TABLES[name]
    source = table(spark, sf_dir, name)
    return source, target_copy(source, spec.keys[0], money), spec


def target_sql(name: str) -> str:
    spec, money = TABLES[name]
    key = spec.keys[0]
    return f"(SELECT * REPLACE (CASE WHEN {key} % 89 = 1 THEN {money} + 1.25 ELSE {money} END AS {money}) FROM {name} WHERE {key} % 97 <> 0 UNION ALL SELECT * REPLACE (-({key} + 1) AS {key}) FROM {name} WHERE {key} % 101 = 2)"


def text_sql(spec: TableSpec) -> str:
    shown = {"int": "CAST({c} AS VARCHAR)", "string": "{c}", "money2": "CAST(CAST(round(CAST({c} AS DECIMAL(24,6)) * 100, 0) AS DECIMAL(38,0)) AS VARCHAR)"}
    parts = [f"coalesce(CAST({c} AS VARCHAR), '<NULL>')" for c in spec.keys] + [f"coalesce({shown[k.value].format(c=c)}, '<NULL>')" for c, k in spec.values]
    return "lower(" + " || chr(31) || ".join(parts) + ")"


def fp_of(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 14) AS BIGINT)"


WRAP = "18446744073709551616::UHUGEINT"


def sm64_sql(x: str) -> str:
    """The mixer over a UBIGINT expression, through one lambda per step so that nothing is written twice."""
    step = lambda v, shift, mul: f"list_transform(list_transform([{v}], lambda a: xor(a, a >> {shift})), lambda a: ((a::UHUGEINT * {mul}::UHUGEINT) % {WRAP})::UBIGINT)[1]"
    return f"list_transform([{step(step(x, 30, H.MUL1), 27, H.MUL2)}], lambda a: xor(a, a >> 31))[1]"


def plus_sql(x: str, constant: int) -> str:
    return f"(({x}::UHUGEINT + {constant}::UHUGEINT) % {WRAP})::UBIGINT"


def signed(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN CAST({x}::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({x} AS BIGINT) END"


def unsigned(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN ({x}::HUGEINT + 18446744073709551616::HUGEINT)::UBIGINT ELSE {x}::UBIGINT END"


def id_sql(key: str) -> str:
    start = f"xor({H._sm(H.CHECKSUM_SEED ^ 0x0101000000000008)}::UBIGINT, {unsigned(key)})"
    return f"({sm64_sql(sm64_sql(start))} & {H.FP_MASK}::UBIGINT)"


def symbols_sql(name: str, source: str) -> str:
    spec, _ = TABLES[name]
    return f"SELECT {fp_of(text_sql(spec))}::UBIGINT AS fp, {id_sql(spec.keys[0])} AS id FROM {source} t"


def positions_sql(cells: int, seed: int = 0) -> str:
    """CTEs that give `placed` (fp, id, s, chk, p) with three distinct cells from `symbols` (fp, id, s); eight tries per stream."""
    a, b, c = H.seeds(seed)
    tries = lambda base: "[" + ", ".join(f"({sm64_sql(plus_sql('fp', (base + k * H.RETRY_STEP) & H.MASK))} % {cells})::INTEGER" for k in range(8)) + "]"
    return f"""tried AS (SELECT fp, id, s, {sm64_sql(plus_sql("fp", H.CHECKSUM_SEED))} AS chk, ({sm64_sql(plus_sql("fp", a))} % {cells})::INTEGER AS pa, {tries(b)} AS tb, {tries(c)} AS tc FROM symbols),
second AS (SELECT *, list_filter(tb, lambda x: x <> pa)[1] AS pb FROM tried),
third AS (SELECT *, list_filter(tc, lambda x: x <> pa AND x <> pb)[1] AS pc FROM second),
placed AS (SELECT fp, id, s, chk, unnest([pa, pb, pc]) AS p FROM third)"""


CELLS_SQL = f"SELECT p AS cell, CAST(sum(s) AS BIGINT) AS cnt, {signed('bit_xor(fp)')} AS fp_xor, {signed('bit_xor(id)')} AS id_xor, {signed('bit_xor(chk)')} AS chk_xor FROM placed GROUP BY p"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _per_table() -> None:
    for name, (spec, _) in TABLES.items():
        key = spec.keys[0]
        target = target_sql(name)
        text = text_sql(spec)
        both = f"(SELECT {key} AS k, md5({text}) AS a FROM {name}) s FULL OUTER JOIN (SELECT {key} AS k, md5({text}) AS b FROM {target} t) t ON s.k = t.k"
        kind = "CASE WHEN b IS NULL THEN 'source_only' WHEN a IS NULL THEN 'target_only' WHEN a <> b THEN 'changed' END"
        found = f"SELECT CAST(coalesce(s.k, t.k) AS VARCHAR) AS pk, {kind} AS kind FROM {both} WHERE {kind} IS NOT NULL"
        signed_symbols = f"WITH symbols AS (SELECT *, 1 AS s FROM ({symbols_sql(name, name)}) UNION ALL SELECT *, -1 FROM ({symbols_sql(name, target)}))"

        @register(f"o20_fp_rows_{name}", f"SELECT {key} AS pk, {text} AS canonical, md5({text}) AS digest, {fp_of(text)} AS fp FROM {name}")
        def _(spark, sf_dir, name=name, spec=spec, key=key):
            t = table(spark, sf_dir, name)
            return t.select(F.col(key).alias("pk"), C.row_text(spec).alias("canonical"), F.md5(C.row_text(spec)).alias("digest"), C.fingerprint(spec).alias("fp"))

        @register(f"o26_fingerprint_scan_{name}", f"SELECT CAST(fp AS BIGINT) AS fp, CAST(id AS BIGINT) AS id, CAST({key} AS VARCHAR) AS pk FROM (SELECT {fp_of(text)} AS fp, {id_sql(key)} AS id, {key} FROM {name} t)")
        def _(spark, sf_dir, name=name, spec=spec):
            return sketch.fingerprints(table(spark, sf_dir, name), spec)

        @register(f"o50_reconcile_{name}", found)
        def _(spark, sf_dir, name=name):
            return reconcile.reconcile(*copies(spark, sf_dir, name), seed=20240301)

        @register(f"o51_full_outer_classify_{name}", found)
        def _(spark, sf_dir, name=name):
            return reconcile.full_outer(*copies(spark, sf_dir, name))

        @register(f"o70_sketch_cells_{name}", f"WITH symbols AS (SELECT *, 1 AS s FROM ({symbols_sql(name, name)})), {positions_sql(CELLS)} {CELLS_SQL}")
        def _(spark, sf_dir, name=name, spec=spec):
            return sketch.sketch(sketch.fingerprints(table(spark, sf_dir, name), spec), CELLS)

        @register(f"o72_difference_cells_{name}", f"{signed_symbols}, {positions_sql(CELLS)}, cells AS ({CELLS_SQL}) SELECT * FROM cells WHERE cnt <> 0 OR fp_xor <> 0 OR id_xor <> 0 OR chk_xor <> 0")
        def _(spark, sf_dir, name=name):
            source, target, spec = copies(spark, sf_dir, name)
            return sketch.subtract(*(sketch.sketch(sketch.fingerprints(t, spec), CELLS) for t in (source, target)))

        @register(f"o73_d_hat_{name}", f"{signed_symbols}, {positions_sql(CELLS)}, cells AS ({CELLS_SQL}) SELECT (CAST(sum(cnt * cnt) AS DOUBLE) - CAST(sum(cnt) AS DOUBLE) * CAST(sum(cnt) AS DOUBLE) / {CELLS}) / (3 * (1 - 3e0 / {CELLS})) AS d_hat FROM cells")
        def _(spark, sf_dir, name=name):
            source, target, spec = copies(spark, sf_dir, name)
            diff = sketch.subtract(*(sketch.sketch(sketch.fingerprints(t, spec), CELLS) for t in (source, target)))
            return sketch.estimate(diff, CELLS)


_per_table()

KEYED = f"SELECT o_orderkey AS k, {fp_of(text_sql(ORDERS))} AS fp FROM"


def keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source, target, spec = copies(spark, sf_dir, "orders")
    return tuple(t.select(F.col("o_orderkey").alias("k"), C.fingerprint(spec).alias("fp")) for t in (source, target))  # type: ignore[return-value]


EVERY = 500
RANGES_SQL = f"""WITH a AS ({KEYED} orders), b AS ({KEYED} {target_sql("orders")} t),
fences AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS n FROM a) WHERE n % {EVERY} = 0),
ra AS (SELECT a.*, (SELECT count(*) FROM fences f WHERE f.k < a.k) AS range_id FROM a), rb AS (SELECT b.*, (SELECT count(*) FROM fences f WHERE f.k < b.k) AS range_id FROM b),
ca AS (SELECT range_id, CAST(sum(fp) AS DECIMAL(38,0)) AS total, count(*) AS n FROM ra GROUP BY 1), cb AS (SELECT range_id, CAST(sum(fp) AS DECIMAL(38,0)) AS total, count(*) AS n FROM rb GROUP BY 1)"""


@register("o78_fences", f"{RANGES_SQL} SELECT k FROM fences")
def _(spark, sf_dir):
    return merkle.fences(keyed(spark, sf_dir)[0], ["k"], EVERY)


@register("o77_range_checksums", f"{RANGES_SQL} SELECT range_id, CAST(total AS VARCHAR) AS fp_total, n AS row_count FROM ca")
def _(spark, sf_dir):
    a, _b = keyed(spark, sf_dir)
    return merkle.checksums(merkle.range_ids(a, ["k"], merkle.fences(a, ["k"], EVERY))).withColumn("fp_total", F.col("fp_total").cast("string"))


@register("o81_dirty_ranges", f"{RANGES_SQL} SELECT coalesce(ca.range_id, cb.range_id) AS range_id, greatest(coalesce(ca.n, 0), coalesce(cb.n, 0)) AS row_count FROM ca FULL OUTER JOIN cb ON ca.range_id = cb.range_id WHERE ca.total IS DISTINCT FROM cb.total OR ca.n IS DISTINCT FROM cb.n")
def _(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    ends = merkle.fences(a, ["k"], EVERY)
    return merkle.dirty(*(merkle.checksums(merkle.range_ids(t, ["k"], ends)) for t in (a, b)))


@register("o80_ntile_localisation", f"{RANGES_SQL} SELECT range_id, bucket, max(k) AS k, CAST(CAST(sum(fp) AS DECIMAL(38,0)) AS VARCHAR) AS fp_total, count(*) AS row_count FROM (SELECT *, CAST(ntile(10) OVER (PARTITION BY range_id ORDER BY k) AS INTEGER) AS bucket FROM ra) GROUP BY range_id, bucket")
def _(spark, sf_dir):
    a, _b = keyed(spark, sf_dir)
    rows = merkle.range_ids(a, ["k"], merkle.fences(a, ["k"], EVERY))
    return merkle.ntile_fences(rows, ["k"], 10).withColumn("fp_total", F.col("fp_total").cast("string"))


@register("o82_merkle_compare", f"WITH a AS ({KEYED} orders), b AS ({KEYED} {target_sql('orders')} t) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'source_only' WHEN a.k IS NULL THEN 'target_only' ELSE 'changed' END AS kind FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.fp IS DISTINCT FROM b.fp")
def _(spark, sf_dir):
    return merkle.merkle_compare(*keyed(spark, sf_dir), ["k"], every=2000, drill_cap=200)


@register("o82_size_descent", ORACLES["o82_merkle_compare"])
def _(spark, sf_dir):
    return merkle.merkle_compare(*keyed(spark, sf_dir), ["k"], every=2000, drill_cap=500, dirty_only=False)


@register("o42_tuple_range", "SELECT o_orderpriority, o_orderkey FROM orders WHERE (o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 700)) AND (o_orderpriority < '4-NOT SPECIFIED' OR (o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey <= 900))")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(merkle.tuple_range(["o_orderpriority", "o_orderkey"], ["2-HIGH", 700], ["4-NOT SPECIFIED", 900])).select("o_orderpriority", "o_orderkey")


CHECK = f"((fp::UHUGEINT * fp::UHUGEINT + fp::UHUGEINT * {pushdown.LINEAR}::UHUGEINT + {pushdown.CONSTANT}::UHUGEINT) % {pushdown.MODULUS}::UHUGEINT)::BIGINT"


@register("o85_pushdown_cells", f"""WITH pos AS (SELECT o_orderkey AS id, fp, fp % 1024 AS a, (fp >> 20) % 1024 AS b, (fp >> 40) % 1024 AS c, {CHECK} AS chk FROM (SELECT o_orderkey, {fp_of(text_sql(ORDERS))} AS fp FROM orders)),
spread AS (SELECT a AS cell, id, fp, chk FROM pos UNION ALL SELECT b, id, fp, chk FROM pos WHERE b <> a UNION ALL SELECT c, id, fp, chk FROM pos WHERE c <> a AND c <> b)
SELECT CAST(cell AS INTEGER) AS cell, count(*) AS cnt, bit_xor(fp) AS fp_xor, bit_xor(id) AS id_xor, bit_xor(chk) AS chk_xor FROM spread GROUP BY cell""")  # fmt: skip
def _(spark, sf_dir):
    return pushdown.pushdown_cells(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.fingerprint(ORDERS).alias("fp")), 1024)


KV_KEY = "'k:' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')"
KV_SQL = f"""SELECT {KV_KEY} AS key, c_custkey AS n, md5(encode('string') || '\\x00'::BLOB || '\\x00\\x00\\x00\\x06'::BLOB || encode('string') || '\\x01'::BLOB || unhex(lpad(hex(octet_length(encode(c_name))), 8, '0')) || encode(c_name)) AS digest FROM customer"""


def kv_store(customers: DataFrame) -> DataFrame:
    key = F.concat(F.lit("k:"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return customers.select(key.alias("key"), F.lit("string").alias("type"), F.col("c_name").alias("str"), F.col("c_custkey").alias("n"))


@register("o29_kv_digests", f"SELECT key, digest, CAST('0x' || substr(digest, 1, 14) AS BIGINT) AS fp FROM ({KV_SQL})")
def _(spark, sf_dir):
    return keyvalue.digests(kv_store(table(spark, sf_dir, "customer")), include_key=False)


def sized_sql(x: str) -> str:
    """The bytes of a text after their length as four bytes."""
    return f"unhex(lpad(hex(octet_length(encode({x}))), 8, '0')) || encode({x})"


def items_sql(*xs: str) -> str:
    return f"unhex('03{len(xs):08x}')" + "".join(f" || unhex('01') || {sized_sql(x)}" for x in xs)


def members_sql(*xs: str) -> str:
    """A set of texts that differ, in the order of their bytes."""
    ordered = f"list_sort([{', '.join(f'encode({x})' for x in xs)}])"
    each = "".join(f" || unhex(lpad(hex(octet_length({ordered}[{i}])), 8, '0')) || {ordered}[{i}]" for i in range(1, len(xs) + 1))
    return f"unhex('{len(xs):08x}'){each}"


NAME, SEGMENT, KEY_TEXT = "c_name", "c_mktsegment", "CAST(c_custkey AS VARCHAR)"
# One key in six of every kind; the digits of a number sort before the letters of a name, so a hash of both has it first.
KIND_BYTES = {
    "string": f"unhex('01') || {sized_sql(NAME)}",
    "list": f"CASE WHEN c_custkey % 12 = 1 THEN {items_sql()} ELSE {items_sql(NAME, SEGMENT, NAME)} END",
    "set": members_sql(NAME, SEGMENT, KEY_TEXT),
    "hash": f"unhex('00000002') || {sized_sql(KEY_TEXT)} || {sized_sql(NAME)} || {sized_sql(NAME)} || {sized_sql(SEGMENT)}",
    "zset": items_sql(KEY_TEXT, NAME),
    "stream": items_sql(SEGMENT),
}
KINDS_SQL = " UNION ALL ".join(
    f"SELECT {KV_KEY} AS key, '{kind}' AS type, md5(encode('{kind}') || unhex('00{len(kind):08x}') || encode('{kind}') || {value}) AS digest FROM customer WHERE c_custkey % 6 = {i}" for i, (kind, value) in enumerate(KIND_BYTES.items())
)


def kinds_store(customers: DataFrame) -> DataFrame:
    name, segment, number = F.col(NAME), F.col(SEGMENT), F.col("c_custkey").cast("string")
    values = {
        "string": name.alias("str"),
        "list": F.when(F.col("c_custkey") % 12 == 1, F.array().cast("array<string>")).otherwise(F.array(name, segment, name)).alias("list"),
        "set": F.array(name, segment, number).alias("set"),
        "hash": F.create_map(name, segment, number, name).alias("hash"),
        "zset": F.array(number, name).alias("zset"),
        "stream": F.array(segment).alias("stream"),
    }
    kind = F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return customers.select(F.concat(F.lit("k:"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("key"), kind.alias("type"), *values.values())


@register("o29_kv_digests_by_kind", f"SELECT key, type, digest, CAST('0x' || substr(digest, 1, 14) AS BIGINT) AS fp FROM ({KINDS_SQL})")
def _(spark, sf_dir):
    store = kinds_store(table(spark, sf_dir, "customer"))
    return keyvalue.digests(store, include_key=False).join(store.select("key", "type"), "key").select("key", "type", "digest", "fp")


BUCKETS = 64
BUCKET_ROWS = f"SELECT c_custkey AS n, {fp_of(text_sql(CUSTOMER))} AS fp, {id_sql('c_custkey')} AS id FROM"
VECTOR = "CAST({sm} % {b} AS INTEGER)"


def vector_sql(source: str) -> str:
    wrapped = "(sum(fp::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"
    return f"SELECT CAST({sm64_sql('id')} % {BUCKETS} AS INTEGER) AS bucket, count(*) AS n, bit_xor(fp) AS fp_xor, {signed(wrapped)} AS fp_sum, CAST(bit_xor(id) AS BIGINT) AS id_xor FROM ({BUCKET_ROWS} {source} t) GROUP BY 1"


@register("o83_bucket_vector", vector_sql("customer"))
def _(spark, sf_dir):
    return keyvalue.bucket_vector(sketch.fingerprints(table(spark, sf_dir, "customer"), CUSTOMER), BUCKETS)


@register("o84_bucket_compare", ORACLES["o51_full_outer_classify_customer"].replace(" AS pk,", " AS key,"))
def _(spark, sf_dir):
    source, target, spec = copies(spark, sf_dir, "customer")
    rows = [sketch.fingerprints(t, spec).select(F.col("pk").alias("key"), "id", "fp") for t in (source, target)]
    return keyvalue.compare(*rows, buckets=BUCKETS)


LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
L = ", ".join(LINES)
OTHER_LINES = f"(SELECT {L} FROM lineitem WHERE l_partkey % 97 <> 0 UNION ALL SELECT {L} FROM lineitem WHERE l_partkey % 101 = 2)"


@register("o114_multiset_difference", f"SELECT {L}, 'plus' AS side, count(*) AS copies FROM (SELECT {L} FROM lineitem EXCEPT ALL SELECT {L} FROM {OTHER_LINES} x) GROUP BY ALL UNION ALL SELECT {L}, 'minus', count(*) FROM (SELECT {L} FROM {OTHER_LINES} x EXCEPT ALL SELECT {L} FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINES)
    other = lines.where("l_partkey % 97 <> 0").unionByName(lines.where("l_partkey % 101 = 2"))
    return reconcile.multiset_difference(lines, other)


@register("o17_composite_key_codec", "SELECT conv_id, turn, 'CK1:' || rtrim(translate(to_base64(encode(CAST(conv_id AS VARCHAR))), '+/', '-_'), '=') || '.' || rtrim(translate(to_base64(encode(CAST(turn AS VARCHAR))), '+/', '-_'), '=') AS wire, CAST(conv_id AS VARCHAR) AS back_0, CAST(turn AS VARCHAR) AS back_1 FROM conversations")
def _(spark, sf_dir):
    spec = TableSpec((("conv_id", PkType.INT64), ("turn", PkType.INT64)), ())
    wire = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.pk_wire(spec).alias("wire"))
    return wire.select("*", *(c.alias(f"back_{i}") for i, c in enumerate(C.pk_unwire(F.col("wire"), 2))))


@register("o04_hash_shard_counts", None)
def _(spark, sf_dir):
    shard = F.pmod(F.crc32(F.col("o_orderkey").cast("string").cast("binary")), F.lit(16)).alias("shard")
    return table(spark, sf_dir, "orders").groupBy(shard).agg(F.count("*").alias("n"))


@register("o36_probe", f"SELECT p_partkey AS pk, {text_sql(PART)} AS canonical, md5({text_sql(PART)}) AS digest, {fp_of(text_sql(PART))} AS fp FROM part ORDER BY 1")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("pk"), C.row_text(PART).alias("canonical"), F.md5(C.row_text(PART)).alias("digest"), C.fingerprint(PART).alias("fp")).orderBy("pk")


def _fleet() -> None:
    for name in fleet.ANALYSES:

        @register(name, fleet.checker_sql(name))
        def _(spark, sf_dir, name=name):
            return fleet.run(spark, fleet.facts(*fleet.derived_log(table(spark, sf_dir, "events"))), name)


_fleet()

# Written by itself, not from the analysis' own text: the engine's correlation, and null where the ranks of a series do not vary.
ORACLES["a11_within_table_rank_correlation"] = f"""{fleet.FACTS_SQL},
timed AS (SELECT series, d_ms, dur_s, n_rows FROM r WHERE is_empty = false AND idle = false AND no_pk = false AND dur_s IS NOT NULL),
ranked AS (SELECT series, d_ms, dur_s, rank() OVER d AS by_d, rank() OVER t AS by_t, rank() OVER n AS by_n FROM timed
  WINDOW d AS (PARTITION BY series ORDER BY d_ms), t AS (PARTITION BY series ORDER BY dur_s), n AS (PARTITION BY series ORDER BY n_rows)),
long AS (SELECT series FROM timed GROUP BY series HAVING count(*) > 19 AND count(DISTINCT d_ms) > 4 AND count(DISTINCT dur_s) > 1),
each AS (SELECT series, count(*) AS size, corr(by_d, by_t) AS dt,
    CASE WHEN count(DISTINCT by_n) > 1 THEN corr(by_n, by_t) END AS nt, CASE WHEN count(DISTINCT by_n) > 1 THEN corr(by_d, by_n) END AS dn
  FROM ranked JOIN long USING (series) GROUP BY series)
SELECT count(*) AS series, CAST(round_even(quantile_cont(size, 0.5), 0) AS BIGINT) AS med_runs, floor(quantile_cont(dt, 0.25) * 1000 + 0.5e0) / 1000 AS rho_p25, floor(quantile_cont(dt, 0.5) * 1000 + 0.5e0) / 1000 AS rho_p50,
  floor(quantile_cont(dt, 0.75) * 1000 + 0.5e0) / 1000 AS rho_p75, floor(1000e0 * sum(CASE WHEN dt > 0 THEN 1 ELSE 0 END) / nullif(count(*), 0) + 0.5e0) / 10 AS pct_positive,
  floor(1000e0 * sum(CASE WHEN dt > 0.3 THEN 1 ELSE 0 END) / nullif(count(*), 0) + 0.5e0) / 10 AS pct_gt_0_3, floor(1000e0 * sum(CASE WHEN dt < -0.3 THEN 1 ELSE 0 END) / nullif(count(*), 0) + 0.5e0) / 10 AS pct_lt_neg_0_3,
  floor(quantile_cont(nt, 0.5) * 1000 + 0.5e0) / 1000 AS rho_n_t_p50, floor(quantile_cont(dn, 0.5) * 1000 + 0.5e0) / 1000 AS rho_d_n_p50
FROM each"""


@register("a20_run_summary", run_summary.checker_sql())
def _(spark, sf_dir):
    return run_summary.summarize(run_summary.derived_runs(table(spark, sf_dir, "events")))


@register("o35_jump_keys", f"SELECT o_orderkey AS i, o_orderkey * 16 + ((o_orderkey * {generate.STEP} + {generate.SALT}) % {generate.PRIME}) % 16 AS k FROM orders")
def _(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("i"), generate.jump_key(i).alias("k"))


@register("o30_base36", "SELECT c_custkey AS n, c_custkey AS back FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), generate.from_base36(generate.base36(F.col("c_custkey"), 8)).alias("back"))


@register("o60_generated_profile", None)
def _(spark, sf_dir):
    p = generate.Profile(20_000, 28, 2, 3, dirty_blocks=4, block=5_000)
    spec = TableSpec((("key_01", PkType.INT64),), tuple((f"value_{k:02d}", t) for k, t in enumerate((ValueType.INT, ValueType.STRING, ValueType.DECIMAL4, ValueType.DATETIME_SEC))))
    return reconcile.reconcile(generate.table(spark, p, "source"), generate.table(spark, p, "target"), spec, seed=5)


@register("s14_streaming_estimate", """WITH s AS (SELECT event_id AS idx, user_id % 7 - 3 AS cnt FROM events), t AS (SELECT *, 8e0 * (idx + 1) / ((2e0 * idx + 3) * (2e0 * idx + 3)) AS q FROM s)
SELECT avg((t.cnt - t.q * z.cnt) * (t.cnt - t.q * z.cnt) / (t.q * (1 - t.q))) AS d_hat FROM t, (SELECT cnt FROM s WHERE idx = 0) z WHERE t.idx >= 1""")  # fmt: skip
def _(spark, sf_dir):
    return estimators.streaming_estimate(table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 7 - 3).alias("cnt")))


@register("s03_trial_summary", None)
def _(spark, sf_dir):
    configs = [trials.Config(64, 40), trials.Config(64, 80, negative=-1), trials.Config(128, 100, degrees=trials.IRREGULAR)]
    return trials.summary(trials.run(spark, configs, 300), configs)


@register("s06_retry_success", None)
def _(spark, sf_dir):
    return trials.retry_success(spark, 64, [40, 80], [1.6, 1.8, 2.0], 150)


@register("s12_pipelines", None)
def _(spark, sf_dir):
    return trials.pipelines(spark, [0, 10, 200], 40)


@register("s13_crossover", None)
def _(spark, sf_dir):
    return trials.crossover(spark, [64, 256, 1024], [0, 10, 100, 1000], 30)


LAW = [trials.Config(64, 51, negative=-1), trials.Config(64, 80), trials.Config(256, 205, negative=-1)]


@register("s05_failed_threshold", None)
def _(spark, sf_dir):
    return checks.failed_threshold(trials.run(spark, LAW, 400), LAW)


@register("s19b_trial_distribution", None)
def _(spark, sf_dir):
    return checks.against_chi_square(trials.run(spark, LAW, 400), LAW)


@register("s03_failed_order_bounds", None)
def _(spark, sf_dir):
    return checks.failed_order_bounds(trials.run(spark, LAW, 400))


@register("s19_second_rounds_orders", None)
def _(spark, sf_dir):
    source, target, spec = copies(spark, sf_dir, "orders")
    return sweep.second_rounds(sketch.fingerprints(source, spec), sketch.fingerprints(target, spec), 8)


# Summaries of trials by load and sign projection; the table has none, so they come of its events.
POINTS = """SELECT 64 AS cells, 3 AS k, 40 + 10 * (user_id % 3) AS d, CASE WHEN event_id % 8 < 7 THEN CAST(event_id % 8 AS DOUBLE) / 7 END AS rho, avg(1 + value / 1000) AS failed_mean, var_samp(value / 1000) AS failed_variance,
  count(*) AS failed_n, avg(CASE WHEN user_id % 5 = 0 THEN 1e0 ELSE 0.1e0 END) AS fail_rate FROM events GROUP BY user_id % 3, event_id % 8"""


@register("s18_sign_projection", f"""WITH p AS (SELECT *, d * pow(rho, 2) - 1 AS z, failed_mean - 1 AS y, sqrt(failed_variance / failed_n) AS error FROM ({POINTS}) WHERE rho IS NOT NULL),
u AS (SELECT * FROM p WHERE error > 0),
g AS (SELECT cells, k, d, sum(z * y / pow(error, 2)) / sum(pow(z / error, 2)) AS slope, pow(sum(pow(z / error, 2)), -0.5) AS slope_error, avg(fail_rate) AS pf FROM u GROUP BY ALL),
o AS (SELECT a.d, a.rho, sum(b.z * b.y / pow(b.error, 2)) / sum(pow(b.z / b.error, 2)) * a.z AS predicted, abs(a.z) * pow(sum(pow(b.z / b.error, 2)), -0.5) AS predicted_error FROM u a JOIN u b ON a.d = b.d AND a.rho <> b.rho GROUP BY a.d, a.rho, a.z),
v AS (SELECT *, abs(z / (d - 1)) * sqrt(2e0 * (d - 1) / (d * (cells - 1))) * sqrt((1 - pf) / pf) AS bound FROM u JOIN g USING (cells, k, d) JOIN o USING (d, rho))
SELECT cells, k, d, rho, round(y, 6) AS y, round(error, 6) AS error, round(slope, 6) AS slope, round(slope_error, 6) AS slope_error, round(predicted, 6) AS predicted, round(predicted_error, 6) AS predicted_error,
  round((y - predicted) / sqrt(pow(error, 2) + pow(predicted_error, 2)), 6) AS residual_z, round(bound, 6) AS bound, abs(y) <= bound AS inside FROM v""")  # fmt: skip
def _(spark, sf_dir):
    got = checks.sign_projection(spark.sql(POINTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")))
    return got.select(*(F.round(c, 6).alias(c) if c not in ("cells", "k", "d", "rho", "inside") else F.col(c) for c in got.columns))


SWEEP_RUNS = "SELECT user_id % 6 AS profile, 1 + abs(value) AS d_hat, 64 * (1 + event_id % 9) AS capacity, CASE WHEN user_id % 6 = 2 AND event_id % 50 = 0 THEN NULL ELSE user_id % 6 <> 4 OR event_id % 70 <> 0 END AS passed FROM events WHERE value IS NOT NULL"


@register("s19c_sweep_rollup", f"""SELECT profile, count(*) AS runs, min(d_hat) AS d_hat_min, max(d_hat) AS d_hat_max, round(avg(d_hat), 6) AS d_hat_mean, round(sqrt((sum(d_hat * d_hat) - pow(sum(d_hat), 2) / count(*)) / (count(*) - 1)) / avg(d_hat), 6) AS d_hat_rsd,
  min(capacity) AS capacity_min, max(capacity) AS capacity_max, count(*) = 12 AND count(*) FILTER (WHERE passed) = count(*) AS whole FROM ({SWEEP_RUNS}) GROUP BY profile""")  # fmt: skip
def _(spark, sf_dir):
    got = checks.sweep_rollup(spark.sql(SWEEP_RUNS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")), 12)
    return got.withColumn("d_hat_mean", F.round("d_hat_mean", 6)).withColumn("d_hat_rsd", F.round("d_hat_rsd", 6))


BENCH_RUNS = "SELECT user_id % 5 AS pair, event_type AS scenario, user_id % 3 AS network, user_id % 2 AS algorithm, event_id % 4 AS workers, CASE WHEN event_id % 6 = 0 THEN 'warm' ELSE 'measure' END AS phase, CASE WHEN event_id % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN event_id % 14 <> 0 THEN 1 + abs(value) END AS e2e_s FROM events"


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BENCH_RUNS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@register("o96_benchmark_rollup", f"SELECT pair, scenario, network, algorithm, count(*) AS n, median(e2e_s) AS median_s, min(e2e_s) AS min_s, max(e2e_s) AS max_s FROM ({BENCH_RUNS}) WHERE phase = 'measure' AND status = 'PASS' AND e2e_s IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    return rollups.benchmark_rollup(bench_runs(spark, sf_dir))


@register("o97_repeat_gate", f"SELECT *, CASE WHEN n = 2 AND spread <= 0.15 THEN 'PASS' ELSE 'RERUN' END AS verdict FROM (SELECT network, algorithm, workers, count(*) AS n, max(e2e_s) / min(e2e_s) - 1 AS spread FROM ({BENCH_RUNS}) GROUP BY ALL)")
def _(spark, sf_dir):
    return rollups.repeat_gate(bench_runs(spark, sf_dir))


@register("o37_value_signature", "SELECT event_id, lower(event_type) || chr(31) || CAST(CAST(round(CAST(value AS DECIMAL(24,6)) * 100, 0) AS DECIMAL(38,0)) AS VARCHAR) || chr(31) || CAST(user_id AS VARCHAR) || chr(31) || strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS signature FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", rollups.value_signature(F.col("event_type"), F.col("value"), F.col("user_id"), F.col("ts")).alias("signature"))


@register("o33_anonymised_series", "SELECT user_id, 'T' || substr(sha256('u' || user_id), 1, 8) AS alias FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", rollups.anonymise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("alias")).distinct()


@register("o06_sampled_fences", None)
def _(spark, sf_dir):
    return rollups.sampled_fences(table(spark, sf_dir, "orders"), "o_orderkey", 16)


@register("o06_snapped_fences", "SELECT CAST(i AS INTEGER) AS fence, probe, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= probe) AS key FROM (SELECT i, lo + (hi - lo) * i // 16 AS probe FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), range(1, 16) t(i))")
def _(spark, sf_dir):
    return rollups.snapped_fences(table(spark, sf_dir, "orders"), "o_orderkey", 16)


@register("o05_suffix_shards", """WITH n AS (SELECT CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer), e AS (SELECT min(number) AS a, max(number) AS z FROM n)
SELECT CAST((number - a) // CAST(ceil((z - a + 1) / 12) AS BIGINT) AS INTEGER) AS shard, min(number) AS low, max(number) AS high, count(*) AS n FROM n, e GROUP BY 1""")
def _(spark, sf_dir):
    return rollups.suffix_shards(table(spark, sf_dir, "customer"), "c_name", 12)


@register("o11_content_sums", """SELECT count(*) AS records, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_high, CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS VARCHAR) AS sum_low
FROM (SELECT md5(coalesce(CAST(o_orderkey AS VARCHAR), '\\N') || chr(31) || coalesce(o_orderstatus, '\\N') || chr(31) || coalesce(CAST(o_custkey AS VARCHAR), '\\N')) AS h FROM orders)""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(*logs.content_sums("o_orderkey", "o_orderstatus", "o_custkey"))


FIRST = 25


@register("o111_first_candidates", f"SELECT CAST(pk AS BIGINT) AS pk, kind FROM ({ORACLES['o51_full_outer_classify_orders']}) ORDER BY CAST(pk AS BIGINT) LIMIT {FIRST}")
def _(spark, sf_dir):
    """The first candidates in key order: each partition keeps its own first ones, so nothing is sorted whole."""
    found = reconcile.full_outer(*copies(spark, sf_dir, "orders"))
    return found.select(F.col("pk").cast("long").alias("pk"), "kind").orderBy("pk").limit(FIRST)


@register("s15_rateless_reconcile_orders", ORACLES["o51_full_outer_classify_orders"])
def _(spark, sf_dir):
    return rateless.reconcile_tables(*copies(spark, sf_dir, "orders"))


@register("s16_exact_sign", None)
def _(spark, sf_dir):
    return correlation.exact(spark, [(4, 2, 3), (5, 2, 4), (5, 3, 4), (6, 3, 3)])


@register("s17_simulated_sign", None)
def _(spark, sf_dir):
    return correlation.simulated(spark, 6, 3, 3, 2000)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders differ between two copies, and how."""
    return QUERIES["o50_reconcile_orders"](spark, sf_dir)
