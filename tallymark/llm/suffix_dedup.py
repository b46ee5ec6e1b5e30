"""Exact removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

No suffix array of the corpus is built. Every `length`-byte string has one anchor, the 100-byte string inside it of smallest
hash, and equal strings have equal anchors at the same place; so the strings of an anchor's neighbourhood (a *segment*: some
50 starts, 250 bytes) only ever repeat in segments of the same anchor. Anchors that occur once are dropped before any text
moves. Equal segments are then counted and merged, so copies of a document or passage cost one segment however many there
are, and the distinct segments of an anchor meet in one block, where the transform's intervals are expanded backward,
breadth-first, to find every start whose string is repeated. An anchor with very many distinct segments (the edges of a passage
that many documents share) is not gathered: its segments are cut again at anchors of 180 bytes, which parts them by context and
merges what is inside the passage, and only strings at anchors that are still crowded are counted by content across tasks.

Equal texts are one text for all of this, known by their MD5: of `length` bytes or more they are removed whole, and count as often
as they occur for the others. So a group of copies, or a repeated row, costs what one text costs. Texts are shuffled three times:
to merge the equal ones (combined within each task first), to cut out one representative of each segment, and to cut out what is
removed.

Defined results: a null text is an empty one; texts under `length` bytes are kept whole; a very long text is a slice of its own and
otherwise treated alike; repeated rows are repeats of each other; ids, null or shared, play no part but to be returned; ties (which
occurrence stands for a segment) do not show in the result; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import kernels as K
from .scratch import Scratch

U64 = np.uint64
ANCHOR, FINE_ANCHOR = 100, 180
HOT_SEGMENTS = 512
BLOCK_BYTES = 2 << 20


def anchors(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, segment hash, first start in the text, starts) of every anchor of a slice; k bytes are hashed."""
    prefix = K.prefix_hash(buf)
    n = len(buf) - k + 1
    lens = np.diff(off)
    if n <= 0 or not (lens >= length).any():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    _, inverse = K.powers(len(prefix))
    h = K.mix((prefix[k:] - prefix[:n]) * inverse[:n])
    bits = U64(max(24, int(len(buf)).bit_length()))
    place = (U64(1) << bits) - U64(1)
    low = (h & ~place) | np.arange(n, dtype=np.uint64)
    window, p = length - k + 1, 1
    while p * 2 <= window:
        low = np.minimum(low[:-p], low[p:])
        p *= 2
    if window > p:
        low = np.minimum(low[: len(low) - (window - p)], low[window - p :])
    owner, at = K.runs(np.maximum(lens - length + 1, 0))
    start = off[:-1][owner] + at
    anchor = (low[start] & place).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    width = np.diff(np.append(begin, len(start)))
    first, spot = start[begin], anchor[begin]
    content = K.span_hash(prefix, first, first + width + length - 1)
    content = K.mix(content + (spot - first).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return owner[begin], h[spot], content, at[begin], width


def segments_of(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(h, s, t, n, at, width) of every anchor of texts(t, n, text): t names the text, which occurs n times."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                owner, h, s, at, width = anchors(buf, off, length, k)
                if len(owner):
                    own = pa.array(owner + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(at.astype(np.int32)), pa.array(width.astype(np.int32))], names=["h", "s", "t", "n", "at", "width"])

    return texts.select("t", "n", "text").mapInArrow(run, "h long, s long, t binary, n long, at int, width int")


def cut_segments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, s, n, crowd, body): the bytes of one occurrence of each segment; texts(t, text) holds every t once."""
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "s", "n", "crowd", "at", "width")).alias("parts"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                parts = batch.column(1).slice(i, 1).flatten().flatten()
                at, width = parts[4].to_numpy(), parts[5].to_numpy()
                body = [text[a : a + w + length - 1] for a, w in zip(at.tolist(), width.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*parts[:4], pa.array(body, pa.binary())], names=["h", "s", "n", "crowd", "body"])

    return texts.select("t", "text").join(lists, "t").select("text", "parts").mapInArrow(run, "h long, s long, n long, crowd boolean, body binary")


def expand(segments: DataFrame, length: int) -> DataFrame:
    """(h, s, starts) of the segments with repeated strings, found block by block; all segments of an anchor share a block."""

    def block(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        hits = bwt.repeated_starts(t.column(3).to_pylist(), t.column(2).to_numpy(), length)
        keep = np.array([len(x) > 0 for x in hits])
        if keep.any():
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().filter(pa.array(keep)), t.column(1).combine_chunks().filter(pa.array(keep)), pa.array([x.astype(np.int32) for x in hits if len(x)], pa.list_(pa.int32()))], names=["h", "s", "starts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)) if len(h) else np.zeros(1, int)
            if held and len(h) and held[-1].column(0)[held[-1].num_rows - 1].as_py() != h[0] and size > BLOCK_BYTES:
                yield from block(held)
                held, size = [], 0
            lengths = np.diff(np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset : batch.column(3).offset + len(h) + 1])
            total, lo = np.append(0, np.cumsum(lengths)), 0
            for e in edges[1:]:
                if size + total[e] - total[lo] > BLOCK_BYTES and e < len(h):
                    held.append(batch.slice(lo, e - lo))
                    yield from block(held)
                    held, size, lo = [], 0, int(e)
            if lo < len(h):
                held.append(batch.slice(lo))
                size += int(total[len(h)] - total[lo])
        if held:
            yield from block(held)

    ready = segments.select("h", "s", "n", "body").repartition(F.col("h")).sortWithinPartitions("h", "s")
    return ready.mapInArrow(run, "h long, s long, starts array<int>")


def crowded(distinct: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    """distinct(h, s, ...) with `crowd`: whether the anchor has more than `hot` distinct segments."""
    many = scratch.save(distinct.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("crowd")))
    return distinct.join(many, "h", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))


def split_hot(segments: DataFrame, length: int, hot: int, scratch: Scratch) -> DataFrame:
    """(h, s, starts) of crowded anchors, by way of finer anchors inside their segments."""
    k = min(max(FINE_ANCHOR, length * 9 // 10), length)

    def cut(batches):
        for batch in batches:
            bodies = batch.column(3).to_pylist()
            off = np.append(0, np.cumsum([len(b) for b in bodies])).astype(np.int64)
            raw = b"".join(bodies)
            owner, h, content, at, width = anchors(np.frombuffer(raw, np.uint8), off, length, k)
            own = pa.array(owner, pa.int64())
            body = [raw[a : a + w + length - 1] for a, w in zip((off[owner] + at).tolist(), width.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in (0, 1, 2)), pa.array(at.astype(np.int32), pa.int32()), pa.array(h.view(np.int64), pa.int64()), pa.array(content.view(np.int64), pa.int64()), pa.array(body, pa.binary())], names=["h0", "s0", "n", "at", "h", "s", "body"])

    parts = scratch.save(segments.select("h", "s", "n", "body").mapInArrow(cut, "h0 long, s0 long, n long, at int, h long, s long, body binary"))
    distinct = scratch.save(parts.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min("body").alias("body")))
    repeated = scratch.save(distinct.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h"))
    finer = scratch.save(crowded(distinct.join(repeated, "h"), hot, scratch))
    hits = expand(finer.where("NOT crowd"), length).unionByName(count_hot(finer.where("crowd"), length))
    back = parts.select("h0", "s0", "at", "h", "s").join(scratch.save(hits), ["h", "s"])
    starts = F.array_distinct(F.flatten(F.collect_list(F.transform("starts", lambda x: x + F.col("at")))))
    return back.groupBy(F.col("h0").alias("h"), F.col("s0").alias("s")).agg(starts.alias("starts"))


def count_hot(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many distinct segments to gather: strings counted by (anchor, place, content)."""

    def run(batches):
        for batch in batches:
            bodies = batch.column(3)
            sizes = np.array([len(b.as_py()) for b in bodies], np.int64)
            off = np.append(0, np.cumsum(sizes))
            buf = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8)
            owner, at = K.runs(np.maximum(sizes - length + 1, 0))
            start = off[:-1][owner] + at
            g = K.span_hash(K.prefix_hash(buf), start, start + length)
            g2 = K.span_hash(K.prefix_hash(buf[::-1]), len(buf) - start - length, len(buf) - start) if len(buf) else g
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(owner)) for j in (0, 1, 2)), pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(g2.view(np.int64))], names=["h", "s", "n", "start", "g", "g2"])

    strings = segments.select("h", "s", "n", "body").mapInArrow(run, "h long, s long, n long, start int, g long, g2 long")
    scratch = Scratch(segments.sparkSession, "hot")
    many = scratch.save(strings.groupBy("g", "g2").agg(F.sum("n").alias("all")).where("all > 1").select("g", "g2"))
    return strings.join(many, ["g", "g2"]).groupBy("h", "s").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = HOT_SEGMENTS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes) and kept (the remaining bytes) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    K.small_batches(spark)
    k = min(anchor, length)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("t"), text.alias("text"))
    texts = scratch.save(rows.where(F.octet_length("text") >= length).groupBy("t").agg(F.first("text").alias("text"), F.count("*").alias("n")))
    scratch.tidy()
    found = segments_of(texts, length, k)
    repeated = scratch.save(found.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h"))
    scratch.tidy()
    places = scratch.save(found.join(repeated, "h").select("h", "s", "t", "n", "at", "width"))
    scratch.tidy()
    scratch.drop(repeated)
    distinct = places.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("t", "at", "width")).alias("o"))
    distinct = scratch.save(distinct.select("h", "s", "n", "o.*"))
    segments = scratch.save(cut_segments(texts, crowded(distinct, hot, scratch), length))
    scratch.tidy()
    hits = expand(segments.where("NOT crowd"), length)
    large = segments.where("crowd")
    if large.limit(1).count():
        hits = hits.unionByName(split_hot(large, length, hot, scratch))
    hits = scratch.save(hits)
    scratch.drop(segments, distinct)
    scratch.tidy()
    covers = places.where("n = 1").join(hits, ["h", "s"]).select("t", "at", "starts")
    spans = covers.groupBy("t").agg(F.collect_list(F.struct("at", "starts")).alias("covers"), F.lit(False).alias("whole"))
    copied = texts.where("n > 1").select("t", F.lit(None).cast(spans.schema["covers"].dataType).alias("covers"), F.lit(True).alias("whole"))

    def cut(batches):
        for batch in batches:
            texts_, out, sizes, kept = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                text = texts_[i].as_py()
                if batch.column(3)[i].as_py():
                    out.append([{"start": 0, "end": len(text)}])
                    text_kept = b""
                elif batch.column(2)[i].is_valid:
                    edge = np.zeros(len(text) + 1, np.int32)
                    at, starts = batch.column(2).slice(i, 1).flatten().flatten()
                    counts = np.diff(np.frombuffer(starts.buffers()[1], np.int32)[starts.offset : starts.offset + len(starts) + 1])
                    where = np.repeat(at.to_numpy(), counts) + starts.flatten().to_numpy()
                    np.add.at(edge, where, 1)
                    np.add.at(edge, where + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[0::2], turn[1::2], strict=True)])
                    text_kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                else:
                    out.append([])
                    text_kept = text
                sizes.append(len(text))
                kept.append(text_kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    marked = rows.join(spans.unionByName(copied), "t", "left").select("doc_id", "text", "covers", "whole")
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
