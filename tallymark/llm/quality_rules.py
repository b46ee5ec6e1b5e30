"""Quality rules: fixed base rules on word statistics, then a hashed n-gram logistic regression with calibrated probabilities.

The regression is trained on a bounded sample of the labelled quality rows (``Rules.sample`` rows at most, two thirds to
fit and one third to calibrate) and every document is scored, whole, in Arrow batches against fixed thresholds.
One scan, no shuffle of texts: the only exchange is the top-``sample`` of the label table.

Defined results: a null text has no words and fails the base rules; an empty text likewise; a very long text is judged whole, as
a slice of its own; repeated rows are each judged, alike, and count once in the sample; null labels and ids labelled both ways are
left out, and of several texts of one labelled id the least is fitted; without labels of both classes the verdict is that of the base rules; an empty table gives an empty result; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import linear as L

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, p_good double, kept boolean"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    threshold: float = 0.5
    sample: int = 4500


def word_stats(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The five counts of every text of a slice."""
    starts, ends, first = K.word_spans(buf, off)
    n_words = np.diff(first)
    prefix = K.prefix_hash(buf)
    h = K.span_hash(prefix, starts, ends)
    counted = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~K.WHITE[buf] & ((buf & 0xC0) != 0x80), out=counted[1:])
    marks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=marks[1:])

    # lines with a word: the words' ends tell which lines have one
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(buf)]
    nexts = np.append(line_starts[1:], len(buf))
    line_ends = np.where(buf[np.maximum(nexts - 1, 0)] == 10, nexts - 1, nexts) if len(buf) else nexts
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    text_of = np.searchsorted(off, line_starts, "right") - 1
    earlier, _ = K.seen_before(K.span_hash(prefix, line_starts, line_ends), text_of)

    # words inside a window that is found twice or more
    sizes = np.maximum(n_words - window + 1, 0)
    owner, at = K.runs(sizes)
    begin = first[:-1][owner] + at
    wh = np.zeros(len(begin), np.uint64)
    for j in range(window):
        wh = wh * np.uint64(0x9FB21C651E98DF25) + h[begin + j] if len(begin) else wh
    _, twice = K.seen_before(wh, owner)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + window, -1)
    return {
        "n_words": n_words,
        "word_chars": counted[off[1:]] - counted[off[:-1]],
        "n_symbols": marks[off[1:]] - marks[off[:-1]],
        "n_dup_lines": np.bincount(text_of[earlier], minlength=len(off) - 1),
        "n_repeat_words": K.sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), first),
    }


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> dict | None:
    """Weights, bias and calibration; None without labelled documents of both classes."""
    got = L.fetch_rows(docs, L.sample_labels(labels, "doc_id", "quality", rules.sample), "doc_id", "text")
    y, rows = got.y, got.rows
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    weights, bias = L.train(rows, y, L.BUCKETS, ~held)
    check = held if held.any() else ~held
    slope, shift = L.platt((rows.dot(weights) + bias)[check], y[check])
    return {"weights": weights.astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def verdicts(m: dict | None, rules: Rules, buf: np.ndarray, off: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray | None, np.ndarray]:
    """(counts, base_failed, p_good or None, kept) of the texts of a slice."""
    s = word_stats(buf, off, rules.window)
    failed = (s["n_words"] < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_percent * s["n_words"])
    if m is None:
        return s, failed, None, ~failed
    p = L.sigmoid(m["slope"] * L.scores(buf, off, m["weights"], m["bias"]) + m["shift"])
    return s, failed, p, ~failed & (p >= rules.threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the five counts, base_failed, p_good (null without a model) and kept, for every row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rules))

    def judge(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                s, failed, p, good = verdicts(model.value, rules, buf, off)
                p = pa.nulls(hi - lo, pa.float64()) if p is None else pa.array(p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(s[k].astype(np.int64)) for k in STATS), pa.array(failed), p, pa.array(good)], names=["doc_id", *STATS, "base_failed", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(judge, SCHEMA)


def keep_rows(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, all their columns as they are: one scan, no join."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rules))

    def sieve(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                yield batch.slice(lo, hi - lo).filter(pa.array(verdicts(model.value, rules, buf, off)[3]))

    return docs.mapInArrow(sieve, docs.schema)
