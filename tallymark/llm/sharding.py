"""Minimax contiguous partition of documents into shards, in DataFrame and SQL functions only.

The atoms are groups of equal texts, ordered by a 64-bit hash of the text; 2^18 leading-bit blocks of that order bound what is
gathered, however many groups there are (with fewer groups than blocks nearly every group is a block of its own). One SQL row
holds the ordered block sizes; a nested ``aggregate`` binary-searches the smallest capacity that a greedy sweep can meet with
the wanted number of shards. A last sweep cuts within that capacity, at the block nearest to each equal share that still leaves
the rest to fit (a backward sweep tells which do), so the last shards are not short. Texts are read twice and never shuffled.

Slots are numbered within (block, salt), so a block that holds a hot group is spread over all partitions, and offset by prefix
counts. Defined results: a null text is an empty one (size 16, crc32 0) and groups with the empty texts; repeated rows each
get a slot; an empty table gives an empty result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK_BITS = 18
HOT_SHARE = 1000


def minimax_cuts(blocks: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first block of every shard but the first) of blocks(block, bytes); at most 2^18 rows meet in one array."""
    row = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "bytes"))).alias("a"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest"))
    value = lambda expr: row.select(F.expr(expr).alias("x")).collect()[0]["x"]  # noqa: E731  one step each: nested in one plan, an inner sweep would run for every element of the outer
    needed = "aggregate(a, named_struct('n', 1, 'fill', 0L), (t, x) -> if(t.fill + x.bytes <= (s.lo + s.hi) div 2, named_struct('n', t.n, 'fill', t.fill + x.bytes), named_struct('n', t.n + 1, 'fill', x.bytes)), t -> t.n)"
    search = f"""aggregate(sequence(1, 62),
        named_struct('lo', greatest(largest, cast(ceil(total / {shards}) as bigint)), 'hi', greatest(largest, cast(ceil(total / {shards}) as bigint)) + largest),
        (s, i) -> if(s.lo >= s.hi, s, if({needed} <= {shards}, named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2), named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi))),
        s -> s.lo)"""
    capacity = value(search)
    # least[k - 1]: how few bytes may stand before the last k shards if k shards of this capacity are to take the rest
    least = value(f"""aggregate(reverse(a), named_struct('fill', 0L, 'rest', total, 'least', cast(array() as array<bigint>)),
        (t, x) -> if(t.fill + x.bytes <= {capacity}L, named_struct('fill', t.fill + x.bytes, 'rest', t.rest - x.bytes, 'least', t.least),
            named_struct('fill', x.bytes, 'rest', t.rest - x.bytes, 'least', concat(t.least, array(t.rest)))),
        t -> t.least)""")
    floor = f"coalesce(get(array({', '.join(f'{n}L' for n in least) or '0L'}), {shards} - t.j - 1), 0L)"
    full = f"t.fill + x.bytes > {capacity}L"
    due = f"(t.j < {shards} AND t.fill > 0 AND t.before >= {floor} AND 2 * t.before + x.bytes > 2 * total / {shards} * t.j)"
    cuts = value(f"""aggregate(a, named_struct('j', 1, 'fill', 0L, 'before', 0L, 'cuts', cast(array() as array<bigint>)),
        (t, x) -> if({full} OR {due}, named_struct('j', t.j + 1, 'fill', x.bytes, 'before', t.before + x.bytes, 'cuts', concat(t.cuts, array(x.block))),
            named_struct('j', t.j, 'fill', t.fill + x.bytes, 'before', t.before + x.bytes, 'cuts', t.cuts)),
        t -> t.cuts)""")
    return capacity, list(cuts)


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - BLOCK_BITS).alias("block"),
    )
    saved = scratch.save(rows)
    blocks = scratch.save(saved.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    _, cuts = minimax_cuts(blocks, shards)
    total = saved.count()
    hot = [r["block"] for r in blocks.where(F.col("n") * HOT_SHARE > total).select("block").collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(parts, 16)))
    shard = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c <= F.col("block"))) if cuts else F.lit(0)
    placed = saved.withColumn("salt", F.when(F.col("block").isin(hot), salt).otherwise(F.lit(0)) if hot else F.lit(0)).withColumn("salt", F.col("salt").cast("long")).withColumn("shard", shard.cast("int"))
    counts = placed.groupBy("shard", "block", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("block", "salt").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(bases, ["block", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
