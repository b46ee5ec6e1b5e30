"""Fuzzy repeated passages by collinear chaining.

Seeds are 7-word strings chosen by winnowing (in any 18 words at least one), so a passage that two texts share keeps common
seeds under scattered edits. Every seed links its occurrences to one canonical place, that of the lowest document id, and
never to each other: a passage in n documents gives n - 1 pairs. Per pair of texts the ordered matches are chained with a
linear gap cost, the best predecessor found by prefix maxima in a Fenwick tree; chains are then aligned word by word (gaps
between anchors by longest common subsequence, at any length, ends by X-drop extension), split where the alignment is poor, and
reported when at least ``min_words`` long and ``identity`` alike.

A canonical place that shares too little hides a passage that later texts share. So seeds that some text is left with outside all
passages found are linked again, by longer keys that no place with a short part of the passage can answer: every string of
``min_words`` words around them (which finds every passage that long without edits, whoever came first) and pairs of seeds half
that far apart (for edited ones). Here only places outside all passages link, and to a place inside one where there is any.

Equal texts, known by their MD5, are one text for all of this; further copies are reported as whole-text passages of the first.
Words are folded to lower case (A-Z). Texts move to be merged, and to hand out the word hashes of the stretches to align.

Defined results: null texts and texts under ``min_words`` words have no passages; very long texts are a slice of their own and
treated alike; the texts of rows that share an id are told apart, a passage between two of them has that id on both sides;
repeated rows (of one id and text) are not reported against each other; a passage repeated inside one document only is not
reported; null ids come last and are reported as null; ties between places go to the lower id, then text, then position; empty
tables give an empty result; ``passages`` reads only doc_id and text, ``remove_passages`` returns all other columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

U64 = np.uint64
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Options:
    seed_words: int = 7
    window: int = 12
    min_words: int = 50
    identity: float = 0.8
    gap_cost: float = 0.1
    drop: int = 6
    copies: bool = True


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = K.LOWER[buf]
    starts, ends, first = K.word_spans(buf, off)
    return K.span_hash(K.prefix_hash(buf), starts, ends), first


def seeds(buf: np.ndarray, off: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed hash, word position) of the winnowed seeds of a slice."""
    h, first = word_hashes(buf, off)
    k, w = options.seed_words, options.window
    n = len(h) - k + 1
    counts = np.diff(first)
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none.view(np.uint64), none
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = K.mix(grams * U64(0x9FB21C651E98DF25) + h[j : j + n])
    bits = U64(max(24, int(n).bit_length()))
    place = (U64(1) << bits) - U64(1)
    low, p = (grams & ~place) | np.arange(n, dtype=np.uint64), 1
    while p * 2 <= w:
        low = np.minimum(low[:-p], low[p:])
        p *= 2
    if w > p:
        low = np.minimum(low[: len(low) - (w - p)], low[w - p :])
    owner, at = K.runs(np.maximum(counts - k - w + 2, 0))
    spot = (low[first[:-1][owner] + at] & place).astype(np.int64)
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])
    spot, owner = spot[new], owner[new]
    same = (grams[spot[1:]] == grams[spot[:-1]]) & (owner[1:] == owner[:-1])
    ends = ~(np.append(False, same) & np.append(same, False)) if len(spot) else same  # of a run of one word the first and the last
    spot, owner = spot[ends], owner[ends]
    return owner, grams[spot], spot - first[owner]


def chain(x: np.ndarray, y: np.ndarray, gain: float, cost: float) -> list[np.ndarray]:
    """Disjoint chains of matches (x, y), best first; both coordinates rise strictly along a chain.

    score(j) = gain + max(0, max over earlier i of score(i) - cost * (x_j - x_i + y_j - y_i)): the maximum is a prefix maximum
    over y of score(i) + cost * (x_i + y_i), kept in a Fenwick tree.
    """
    order = np.lexsort((-y, x))  # of one x the larger y first, so that they cannot follow each other
    xs, ys = x[order].tolist(), y[order].tolist()
    level = {v: i + 1 for i, v in enumerate(sorted(set(ys)))}
    size = len(level)
    tree_score, tree_at = [-1e300] * (size + 1), [-1] * (size + 1)
    score, back = [], []
    for j, (a, b) in enumerate(zip(xs, ys, strict=True)):
        r = level[b]
        i, best, at = r - 1, -1e300, -1
        while i > 0:
            if tree_score[i] > best:
                best, at = tree_score[i], tree_at[i]
            i &= i - 1
        best -= cost * (a + b)
        s = gain + (best if best > 0 else 0.0)
        score.append(s)
        back.append(at if best > 0 else -1)
        s += cost * (a + b)
        while r <= size:
            if s > tree_score[r]:
                tree_score[r], tree_at[r] = s, j
            r += r & -r
    used, out = set(), []
    for j in sorted(range(len(xs)), key=lambda j: -score[j]):
        path = []
        while j >= 0 and j not in used:
            used.add(j)
            path.append(j)
            j = back[j]
        if path:
            out.append(order[np.array(path[::-1])])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, a bit for every word of b."""
    where: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & where.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray, drop: int) -> tuple[int, int]:
    """(words, matches) of the best ungapped extension over the heads of a and b: a match gains 1, a mismatch costs 2."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    fell = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > drop)
    stop = int(fell[0]) if len(fell) else n
    if not stop or total[:stop].max() <= 0:
        return 0, 0
    words = int(total[:stop].argmax()) + 1
    return words, int(same[:words].sum())


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, options: Options) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, start in b, end in b, identity) along one chain; a, b are word hashes, x, y its anchors in them."""
    k = options.seed_words
    pieces: list[list] = []  # [x0, x1, y0, y1, matches]
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if pieces:
            last = pieces[-1]
            dx, dy = p - last[1], q - last[3]
            over = -min(dx, dy, 0)
            if over:  # anchors overlap: the rest of the later one
                p, q, dx, dy = p + over, q + over, dx + over, dy + over
            gap_a, gap_b = a[last[1] : p], b[last[3] : q]
            same = int((gap_a == gap_b).sum()) if dx == dy else 0
            if max(dx, dy) and (dx != dy or same < 0.8 * dx):
                if max(dx, dy) <= 15 or 2 * min(dx, dy) >= max(dx, dy):  # else too few words could be equal
                    same = max(same, _common(gap_a, gap_b))
            if max(dx, dy) <= 15 or same >= 0.5 * max(dx, dy):
                last[1], last[3], last[4] = p + k - over, q + k - over, last[4] + same + k - over
                continue
            p, q = p - over, q - over
        pieces.append([p, p + k, q, q + k, k])
    out = []
    for x0, x1, y0, y1, matches in pieces:
        n, m = _extend(a[:x0][::-1], b[:y0][::-1], options.drop)
        x0, y0, matches = x0 - n, y0 - n, matches + m
        n, m = _extend(a[x1:], b[y1:], options.drop)
        x1, y1, matches = x1 + n, y1 + n, matches + m
        alike = matches / max(x1 - x0, y1 - y0)
        if min(x1 - x0, y1 - y0) >= options.min_words and alike >= options.identity:
            out.append((x0, x1, y0, y1, min(alike, 1.0)))
    return out


def distinct_texts(docs: DataFrame, min_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows(d, t, text), texts(t, d, n, text)): every row with its text's name, and each text that can hold a passage once, with its lowest id."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.unhex(F.md5(text)).alias("t"), text.alias("text"))
    once = rows.where(F.octet_length("text") >= 2 * min_words - 1).groupBy("t").agg(F.min("d").alias("d"), F.count("*").alias("n"), F.first("text").alias("text"))
    texts = scratch.save(once)
    del once
    scratch.tidy()
    return rows, texts


def line_up_keys(texts: DataFrame, found: DataFrame, options: Options, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(keys that two texts or more have, as (h, t, pos); the passages that they lead to).

    found(h, d, t, pos): places of keys. Every place is linked to the lowest (d, t, pos) of its key; passages are rows
    (t, ct, d, cd, start_word, end_word, source_start, source_end, identity), the later text first. With a column `open` only open places
    are linked, to the lowest that is not open, if there is one.
    """
    flagged = "open" in found.columns
    reach = options.seed_words + options.window + options.min_words
    grain = 16  # stretches begin and end on multiples, so that the many pairs of one text ask for few different ones
    flag = ["open"] if flagged else []
    canon = found.groupBy("h").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(F.struct(*flag, "d", "t", "pos")).alias("c"), *(F.max(c).alias("some") for c in flag)).where("t0 <> t1 AND some" if flagged else "t0 <> t1")
    canon = scratch.save(canon.select("h", F.col("c.d").alias("cd"), F.col("c.t").alias("ct"), F.col("c.pos").alias("cpos")))
    scratch.tidy()
    pairs = found.join(canon, "h")
    if flagged:
        later = F.struct("d", "t") > F.struct("cd", "ct")
        swap = lambda a, b, name: F.when(later, F.col(a)).otherwise(F.col(b)).alias(name)
        shared = scratch.save(pairs.where("open AND t <> ct").select("h", *(swap(a, b, a) for a, b in SIDES), *(swap(b, a, b) for a, b in SIDES)))
    else:
        shared = scratch.save(pairs)
    del pairs
    scratch.drop(canon)
    scratch.tidy()
    met = shared.where("t <> ct").groupBy("t", "ct").agg(F.min("d").alias("d"), F.min("cd").alias("cd"), F.collect_set(F.struct("pos", "cpos")).alias("at"))

    def chains(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x, y = (c.to_numpy().astype(np.int64) for c in batch.column(4).slice(i, 1).flatten().flatten())
                for use in chain(x, y, float(options.seed_words), options.gap_cost):
                    a, b = x[use], y[use]
                    lo, clo = (max(0, int(z[0]) - reach) // grain * grain for z in (a, b))
                    hi, chi = (-(-(int(z[-1]) + options.seed_words + reach) // grain) * grain for z in (a, b))
                    rows.append((i, lo, hi, clo, chi, (a - lo).astype(np.int32), (b - clo).astype(np.int32)))
            if rows:
                owner, *cols = zip(*rows, strict=True)
                kinds = [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in range(4)), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["t", "ct", "d", "cd", "lo", "hi", "clo", "chi", "x", "y"])

    linked = scratch.save(met.select("t", "ct", "d", "cd", "at").mapInArrow(chains, "t binary, ct binary, d long, cd long, lo int, hi int, clo int, chi int, x array<int>, y array<int>"))
    scratch.tidy()
    wanted = linked.select("t", "lo", "hi").unionByName(linked.select(F.col("ct").alias("t"), F.col("clo").alias("lo"), F.col("chi").alias("hi"))).distinct()
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))

    def hand_out(batches):
        for batch in batches:
            for lo_, hi_, buf, off in K.text_slices(batch):
                h, first = word_hashes(buf, off)
                short = (h >> U64(32)).astype(np.uint32)
                for i in range(hi_ - lo_):
                    words = short[first[i] : first[i + 1]]
                    lo, hi = batch.column(2).slice(lo_ + i, 1).flatten().flatten()
                    cut = [words[a:b].tobytes() for a, b in zip(lo.to_pylist(), hi.to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[lo_ + i], len(cut)), lo, hi, pa.array(cut, pa.binary())], names=["t", "lo", "hi", "words"])

    cuts = scratch.save(texts.join(lists, "t").select("t", "text", "parts").mapInArrow(hand_out, "t binary, lo int, hi int, words binary"))
    scratch.tidy()

    def line_up(batches):
        for batch in batches:
            rows = []
            xs, ys, wa, wb = (batch.column(c) for c in (6, 7, 8, 9))
            for i in range(batch.num_rows):
                a, b = np.frombuffer(wa[i].as_py(), np.uint32), np.frombuffer(wb[i].as_py(), np.uint32)
                rows += [(i, *p) for p in align(a, b, xs[i].values.to_numpy(), ys[i].values.to_numpy(), options)]
            if rows:
                owner, x0, x1, y0, y1, alike = (np.array(c) for c in zip(*rows, strict=True))
                lo, clo = batch.column(4).to_numpy()[owner], batch.column(5).to_numpy()[owner]
                at = [pa.array((v + o).astype(np.int32)) for v, o in ((x0, lo), (x1, lo), (y0, clo), (y1, clo))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in range(4)), *at, pa.array(alike.astype(np.float64))], names=["t", "ct", "d", "cd", *PLACES, "identity"])

    side = lambda k, lo, hi, name: cuts.select(F.col("t").alias(k), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("words").alias(name))
    both = linked.join(side("t", "lo", "hi", "wa"), ["t", "lo", "hi"]).join(side("ct", "clo", "chi", "wb"), ["ct", "clo", "chi"])
    lined = both.select("t", "ct", "d", "cd", "lo", "clo", "x", "y", "wa", "wb").mapInArrow(line_up, "t binary, ct binary, d long, cd long, " + ", ".join(f"{c} int" for c in PLACES) + ", identity double")
    lined = scratch.save(lined)
    scratch.drop(linked, cuts)
    return shared, lined


def merged(covers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of one list of stretches in eights of words, widened by seven words and joined where they meet; ends ascend."""
    lo, hi = (c.to_numpy() for c in covers.flatten().flatten())
    order = np.argsort(lo, kind="stable")
    lo, hi = 8 * lo[order].astype(np.int64) - 7, np.maximum.accumulate(8 * hi[order].astype(np.int64) + 7)
    new = np.append(True, lo[1:] > hi[:-1])[: len(lo)]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)] if len(hi) else hi


def within(covers: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    lo, hi = covers
    if not len(lo):
        return np.zeros(len(start), bool)
    at = np.searchsorted(lo, start, "right") - 1
    return (at >= 0) & (end <= hi[np.maximum(at, 0)])


NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def longer_keys(texts: DataFrame, shared: DataFrame, lined: DataFrame, options: Options, scratch: Scratch) -> DataFrame:
    """(h, d, t, pos, open): longer keys around every shared seed that some text has outside the passages found; open where the key is outside."""
    k, least = options.seed_words, options.min_words
    sides = lined.select("t", F.col("start_word").alias("lo"), F.col("end_word").alias("hi")).unionByName(lined.select(F.col("ct").alias("t"), F.col("source_start").alias("lo"), F.col("source_end").alias("hi")))
    # on multiples of eight, inwards: the many passages of one hub are few different stretches
    covers = sides.select("t", F.ceil(F.col("lo") / 8).cast("int").alias("lo"), F.floor(F.col("hi") / 8).cast("int").alias("hi")).distinct().groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))
    covers = scratch.save(covers)
    seeds_of = shared.groupBy("t").agg(F.collect_set(F.struct("h", "pos")).alias("seeds"))

    def outside(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                h, pos = (c.to_numpy() for c in batch.column(0).slice(i, 1).flatten().flatten())
                known = merged(batch.column(1).slice(i, 1)) if batch.column(1)[i].is_valid else NOTHING
                out.append(np.unique(h[~within(known, pos, pos + k)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["h"])

    loose = scratch.save(seeds_of.join(covers, "t", "left").select("seeds", "covers").mapInArrow(outside, "h long").distinct())
    again = shared.join(loose, "h").groupBy("t").agg(F.collect_set(F.struct("pos", "h")).alias("seeds"))

    def keys(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                words, first = word_hashes(buf, off)
                total = np.zeros(len(words) + 1, np.uint64)
                p, inverse = K.powers(len(words) + 1)
                np.cumsum(words * p[: len(words)], out=total[1:])
                for i in range(hi - lo):
                    pos, h = (c.to_numpy() for c in batch.column(3).slice(lo + i, 1).flatten().flatten())
                    known = merged(batch.column(4).slice(lo + i, 1)) if batch.column(4)[lo + i].is_valid else NOTHING
                    order = np.lexsort((h, pos))
                    pos, h = pos[order].astype(np.int64), h[order].view(np.uint64)
                    begin, end = first[i], first[i + 1]
                    starts = np.unique((pos[:, None] - np.arange(least - k + 1)).ravel())
                    starts = starts[(starts >= 0) & (starts + least <= end - begin)] + begin
                    window = K.mix((total[starts + least] - total[starts]) * inverse[starts])
                    at, key, is_open = [starts - begin], [window], [~within(known, starts - begin, starts - begin + least)]
                    near = np.searchsorted(pos, pos + least // 2)
                    for step in range(3):
                        other = near + step
                        use = np.flatnonzero(other < len(pos))
                        use = use[pos[other[use]] - pos[use] <= 2 * least]
                        pair = K.mix(h[use] * U64(3) + h[other[use]])
                        at += [pos[use], pos[other[use]]]
                        key += [K.mix(pair + U64(1)), K.mix(pair + U64(2))]
                        is_open += [~within(known, pos[use], pos[other[use]] + k)] * 2
                    at, key, is_open = np.concatenate(at).astype(np.int32), np.concatenate(key), np.concatenate(is_open)
                    run = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])  # one place for a run of equal keys, an open one if there is any
                    order = np.lexsort((~is_open, run))
                    order = order[np.append(True, run[order][1:] != run[order][:-1])[: len(order)]]
                    at, key, is_open = at[order], key[order], is_open[order]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.repeat(batch.column(1)[lo + i], len(at)), pa.repeat(batch.column(0)[lo + i], len(at)), pa.array(at), pa.array(is_open)], names=["h", "d", "t", "pos", "open"])

    return texts.join(again.join(covers, "t", "left"), "t").select("t", "d", "text", "seeds", "covers").mapInArrow(keys, SEEDS + ", open boolean")


SIDES = [("d", "cd"), ("t", "ct"), ("pos", "cpos")]
PLACES = ["start_word", "end_word", "source_start", "source_end"]
SEEDS = "h long, d long, t binary, pos int"


def passages_of(texts: DataFrame, options: Options, scratch: Scratch) -> DataFrame:
    """(t, ct, d, cd, places, identity): the passages between different texts(t, d, n, text)."""

    def find(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                owner, h, pos = seeds(buf, off, options)
                if len(owner):
                    own = pa.array(owner + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1).take(own), batch.column(0).take(own), pa.array(pos.astype(np.int32))], names=["h", "d", "t", "pos"])

    shared, lined = line_up_keys(texts, texts.select("t", "d", "text").mapInArrow(find, SEEDS), options, scratch)
    keyed = scratch.save(longer_keys(texts, shared.select("h", "t", "pos"), lined, options, scratch))
    scratch.drop(shared)
    scratch.tidy()
    if not keyed.limit(1).count():
        return lined
    again, more = line_up_keys(texts, keyed, options, scratch)
    scratch.drop(keyed, again)
    old = lined.select(F.col("t").alias("t_"), F.col("ct").alias("ct_"), *(F.col(c).alias(c + "_") for c in PLACES))
    middle, source = F.expr("(start_word + end_word) div 2"), F.expr("(source_start + source_end) div 2")
    known = (F.col("t") == F.col("t_")) & (F.col("ct") == F.col("ct_")) & middle.between(F.col("start_word_"), F.col("end_word_")) & source.between(F.col("source_start_"), F.col("source_end_"))
    return scratch.save(lined.unionByName(more.join(old, known, "left_anti").distinct()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(t, words) of texts(t, text)."""

    def count(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(K.word_spans(buf, off)[2]).astype(np.int32))], names=["t", "words"])

    return texts.select("t", "text").mapInArrow(count, "t binary, words int")


def copied(texts: DataFrame, options: Options) -> DataFrame:
    """(t, first, words) of the texts of ``min_words`` words or more that several rows have."""
    many = texts.where("n > 1")
    return word_counts(many).where(F.col("words") >= options.min_words).join(many.select("t", F.col("d").alias("first")), "t")


def passages(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, source_id, start_word, end_word, source_start, source_end, n_words, identity: one row per passage of a document that an earlier one has."""
    scratch = Scratch(docs.sparkSession, "chains")
    K.small_batches(docs.sparkSession)
    rows, texts = distinct_texts(docs, options.min_words, scratch)
    lined = passages_of(texts, options, scratch)
    who = rows.select("t", F.col("d").alias("own"))
    out = who.join(lined, "t").select(F.col("own").alias("d"), "cd", *PLACES, "identity")
    whole = scratch.save(copied(texts, options))
    scratch.drop(texts)
    if options.copies:
        whole = who.join(whole, "t").where("own <> first")
        out = out.unionByName(whole.select(F.col("own").alias("d"), F.col("first").alias("cd"), F.lit(0).alias("start_word"), F.col("words").alias("end_word"), F.lit(0).alias("source_start"), F.col("words").alias("source_end"), F.lit(1.0).alias("identity")))
    return out.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), F.nullif("cd", F.lit(NO_ID)).alias("source_id"), *PLACES, (F.col("end_word") - F.col("start_word")).alias("n_words"), "identity")


def remove_passages(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """docs with the words of every repeated passage cut from the later documents' texts; n_chars follows. Other columns stay.

    Cuts are found per text and met by its MD5, so rows that share an id keep apart; a copy under a higher id is cut whole.
    """
    scratch = Scratch(docs.sparkSession, "cuts")
    K.small_batches(docs.sparkSession)
    _, texts = distinct_texts(docs, options.min_words, scratch)
    lined = passages_of(texts, options, scratch)
    lists = lined.select("t", F.struct("start_word", "end_word").alias("cut")).distinct().groupBy("t").agg(F.collect_list("cut").alias("cuts"))
    marks = lists.join(copied(texts, options).select("t", "first"), "t", "full_outer")
    name, cuts, first, own = K.fresh(docs.columns, "text_md5", "cuts", "first_id", "own_id")
    marks = scratch.save(marks.select(F.col("t").alias(name), F.col("cuts").alias(cuts), F.col("first").alias(first)))
    scratch.drop(texts, lined)
    named = docs.withColumn(name, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rest = [c for c in docs.columns if c != "text"]
    joined = named.join(marks, name, "left").select("text", cuts, F.coalesce(F.col(own) > F.col(first), F.lit(False)).alias(own), *rest)

    def cut(batches):
        for batch in batches:
            texts = batch.column(0)
            out = []
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                if batch.column(2)[i].as_py():
                    raw = ""
                if not raw or not batch.column(1)[i].is_valid:
                    out.append(raw)
                    continue
                buf = np.frombuffer(raw.encode(), np.uint8)
                starts, ends, _ = K.word_spans(buf, np.array([0, len(buf)]))
                gone = np.zeros(len(buf) + 1, np.int32)
                lo, hi = batch.column(1).slice(i, 1).flatten().flatten()
                for a, b in zip(lo.to_pylist(), hi.to_pylist(), strict=True):
                    gone[starts[a]] += 1
                    gone[starts[b] if b < len(starts) else len(buf)] -= 1
                out.append(buf[np.cumsum(gone[:-1]) <= 0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[3:]], names=["text", *batch.schema.names[3:]])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    cleaned = joined.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in ["text", *rest]))
    if "n_chars" in rest:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kinds["n_chars"])))
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))
