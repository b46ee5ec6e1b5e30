"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then are calibrated and combined.

The text view is a logistic regression on hashed word and character n-grams, the metadata view one on hashed source,
language and length features. Both start from the same labelled rows. In every round both score all unlabelled documents in one
scan, and each hands the ``hand_over`` documents of each class that it is surest of, as pseudo-labels, to the *other* view, which
is trained again. Held-out labelled rows then calibrate both views and fit the weights that combine their logits, and every
document is scored whole, in one scan.

The driver holds at most ``Options.labelled`` labelled documents, chosen by hash of their id, and 4 x ``hand_over`` pseudo-labelled
ones a round; candidates for those come from the whole table. The scores of a round (one narrow row per document) are written.

Defined results: a null text is an empty one, a null metadata value a value of its own; very long texts are scored whole;
repeated rows score alike, and ids count once in fitting (the surest row of an id speaks for it, ties go to the smaller id);
null ids are scored but never fitted; without labelled documents of both classes the probabilities are null and everything is
kept; an empty table gives an empty result; only doc_id, text, lang, source and n_chars are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import linear as L
from .scratch import Scratch

META = ["lang", "source", "n_chars"]
META_BUCKETS = 1 << 12
SCHEMA = "doc_id long, p_text double, p_meta double, p_quality double, kept boolean"


@dataclass(frozen=True)
class Options:
    labelled: int = 2000
    rounds: int = 3
    hand_over: int = 80
    sure: float = 0.95
    threshold: float = 0.5


def meta_row(lang: str | None, source: str | None, n_chars: str | None) -> np.ndarray:
    """Buckets of a document's metadata features."""
    size = "none" if n_chars is None else str(int(n_chars).bit_length())
    names = (f"lang={lang}", f"source={source}", f"size={size}", f"{lang}|{size}", f"{source}|{size}")
    return np.array([zlib.crc32(n.encode()) % META_BUCKETS for n in names], np.int32)


class View:
    """One classifier with its own growing set of labelled rows."""

    def __init__(self, rows: L.Rows, buckets: int, y: np.ndarray, use: np.ndarray, steps: int):
        self.rows, self.buckets, self.y, self.use, self.steps = rows, buckets, y.copy(), use.copy(), steps
        self.model: tuple | None = None
        self.given: list[int] = []

    def fit(self) -> np.ndarray:
        self.model = L.train(self.rows, self.y, self.buckets, self.use, self.steps, start=self.model)
        return self.rows.dot(self.model[0]) + self.model[1]

    def learn(self, rows: L.Rows, y: np.ndarray) -> None:
        self.rows = self.rows.joined(rows)
        self.y, self.use = np.append(self.y, y), np.append(self.use, np.ones(len(y), bool))


def meta_rows(extra: list[list]) -> L.Rows:
    share = np.full(5, 0.2, np.float32)
    return L.Rows.of([(meta_row(*x), share) for x in zip(*extra, strict=True)])


def weights(text: View, page: View) -> dict:
    return {"text": text.model[0].astype(np.float32), "text_bias": text.model[1], "meta": page.model[0].astype(np.float32), "meta_bias": page.model[1]}


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def logits_of(docs: DataFrame, model) -> DataFrame:
    """(id, text, page): both views' logits of every document with an id."""

    def score(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, scorer.logits(batch, lo, hi, buf, off))], names=["id", "text", "page"])

    return columns(docs).where("doc_id IS NOT NULL").mapInArrow(score, "id long, text double, page double")


def surest(scored: DataFrame, view: str, label: int, calibration: tuple[float, float], skip: list[int], options: Options) -> list[int]:
    """Ids of the documents that a view is surest to be of this class, at most ``hand_over``."""
    z = F.lit(calibration[0]) * F.col(view) + F.lit(calibration[1])
    z = z if label else -z
    free = scored.where(z >= float(np.log(options.sure / (1 - options.sure))))
    if skip:
        free = free.where(~F.col("id").isin(skip))
    return [r["id"] for r in free.orderBy(z.desc(), "id").limit(options.hand_over).select("id").collect()]


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> dict | None:
    spark = docs.sparkSession
    got = L.fetch_rows(docs, L.sample_labels(labels, "doc_id", "quality", options.labelled), "doc_id", "text", META)
    y = got.y
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    first = np.arange(len(y))  # the labelled rows stay in front
    text = View(got.rows, L.BUCKETS, y, ~held, 60)
    page = View(meta_rows(got.extra), META_BUCKETS, y, ~held, 60)
    del got
    views, handed = (text, page), 0
    logits = [v.fit() for v in views]
    for v in views:
        v.steps = 25  # later rounds go on from the weights of the one before
    labelled = labels.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    scratch = Scratch(spark, "cotraining")
    for _ in range(options.rounds):
        model = spark.sparkContext.broadcast(weights(text, page))
        free = logits_of(docs, model).join(labelled, "id", "left_anti").groupBy("id").agg(F.max("text").alias("text"), F.max("page").alias("page"))
        scored = scratch.save(free)
        model.destroy()
        given: list[tuple[int, int, int]] = []
        for me, other in ((0, 1), (1, 0)):
            calibration = L.platt(logits[me][first[~held]], y[~held])
            for label in (1, 0):
                taken = [i for o, _, i in given if o == other]
                given += [(other, label, i) for i in surest(scored, ("text", "page")[me], label, calibration, views[other].given + taken, options)]
        scratch.drop(scored)
        if not given:
            break
        new = L.fetch_rows(docs, spark.createDataFrame([(i, -1) for i in sorted({i for _, _, i in given})], "__id long, __y int"), "doc_id", "text", META)
        place = {i: k for k, i in enumerate(new.ids.tolist())}
        for o, rows in ((0, new.rows), (1, meta_rows(new.extra))):
            mine = [(place[i], label, i) for v, label, i in given if v == o and i in place]
            views[o].learn(L.Rows.of([(rows.index[rows.at[k] : rows.at[k + 1]], rows.value[rows.at[k] : rows.at[k + 1]]) for k, _, _ in mine]), np.array([label for _, label, _ in mine], y.dtype))
            views[o].given += [i for _, _, i in mine]
            handed += len(mine)
        del new
        logits = [v.fit() for v in views]
    logits = [z[: len(y)] for z in logits]
    calibration = [L.platt(z[held], y[held]) for z in logits]
    both = np.stack([a * z + b for (a, b), z in zip(calibration, logits, strict=True)], 1)
    return weights(text, page) | {"calibration": calibration, "mix": combine(both[held], y[held]), "handed": handed}


def combine(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-negative weights and intercept of a logistic regression on the two calibrated logits."""
    w = np.array([1.0, 0.2, 0.0])
    x = np.hstack([np.clip(z, -20, 20), np.ones((len(z), 1))])
    for _ in range(60):
        p = L.sigmoid(x @ w)
        gradient = x.T @ (p - y) + 0.5 * (w - [1.0, 0.0, 0.0])
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(3)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        w[:2] = np.maximum(w[:2], 0)
    return w


class Scorer:
    """Applies a fitted model to slices; metadata features are few and remembered."""

    def __init__(self, model: dict | None):
        self.model, self.memo = model, {}

    def _meta(self, key: tuple) -> float:
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = self.model["meta_bias"] + float(self.model["meta"][meta_row(*key)].mean())
        return self.memo[key]

    def logits(self, batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both views' logits of rows lo..hi of a batch that has lang, source and n_chars."""
        m = self.model
        lang, source, n_chars = (batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo).to_pylist() for c in META)
        keys = zip(lang, source, (None if n is None else str(n) for n in n_chars), strict=True)
        return L.scores(buf, off, m["text"], m["text_bias"]), np.array([self._meta(k) for k in keys], np.float64)

    def __call__(self, batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(text, metadata, combined) probabilities of rows lo..hi of a batch."""
        m = self.model
        if m is None:
            return None
        z = [np.clip(a * x + b, -20, 20) for (a, b), x in zip(m["calibration"], self.logits(batch, lo, hi, buf, off), strict=True)]
        return L.sigmoid(z[0]), L.sigmoid(z[1]), L.sigmoid(m["mix"][0] * z[0] + m["mix"][1] * z[1] + m["mix"][2])


def classify(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality and kept for every row of docs(doc_id, text, lang, source, n_chars)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, options))

    def score(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                got = scorer(batch, lo, hi, buf, off)
                cols = [pa.nulls(hi - lo, pa.float64())] * 3 + [pa.array(np.ones(hi - lo, bool))] if got is None else [*map(pa.array, got), pa.array(got[2] >= options.threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["doc_id", "p_text", "p_meta", "p_quality", "kept"])

    return columns(docs).mapInArrow(score, SCHEMA)


def keep_rows(docs: DataFrame, labels: DataFrame, options: Options = Options(), fit_on: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, all their columns as they are: one scan, no join.

    It is fitted on `fit_on` where that is given: rows that earlier stages have thinned may lack labelled rows of one class.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if fit_on is None else fit_on, labels, options))

    def sieve(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                got, part = scorer(batch, lo, hi, buf, off), batch.slice(lo, hi - lo)
                yield part if got is None else part.filter(pa.array(got[2] >= options.threshold))

    return docs.mapInArrow(sieve, docs.schema)
