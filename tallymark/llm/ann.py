"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one shared priority queue, exact reranking.

The split planes are fitted on at most ``Options.sample`` vectors (lowest ids by hash); every row is then indexed, by routing
it to one leaf of each tree. Leaves keep their size as the table grows: past the fitted planes a leaf is split further by
random directions through its centre, ``extra`` levels of them, chosen from the row count. A query walks all trees with one
queue ordered by the smallest margin on the path, until it has opened enough leaves. Neighbouring leaves of a tree make a part of
about ``part_rows`` rows; a query travels once to each part that it opens leaves of, and meets their rows there: exact cosines in
double precision leave it its best few of the part, and those are merged. Parts that got far more rows are dealt out by salt, and
their queries go to every salt.

How many leaves are enough is measured on every table: ``probes`` of its queries are compared with all rows, and ``visits`` is
raised until they reach ``recall`` of their true neighbours. Where no plane helps that may be most leaves.

Vectors that are one another times a power of two (equal ones above all) have equal cosines with everything; they are one row with
their smallest ids, as many as a result can need, so a vector that a third of all rows hold is neither a hot leaf nor a loss.

Defined results: vectors that are null, all zero, of another length than the most common one (no cosine is defined between
lengths), or that hold null or non-finite components take no part, as query or candidate; a query's own id is no candidate of it;
repeated ids are one candidate; ties go to the smaller id, however many tie; a table with fewer candidates gives all of them; an
empty table gives an empty result; only the id and vector columns are read, so others cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch


@dataclass(frozen=True)
class Options:
    trees: int = 8
    sample: int = 20_000
    leaf: int = 24
    rows_per_leaf: int = 96
    visits: int = 64
    probes: int = 64
    recall: float = 0.95
    part_rows: int = 20_000
    crowd: int = 60_000
    seed: int = 5


class Forest:
    """Split planes of all trees; leaves are numbered within their tree and know the mean of their sample vectors."""

    def __init__(self, x: np.ndarray, options: Options, rows: int):
        rng = np.random.default_rng(options.seed)
        self.dim = x.shape[1]
        planes, cuts, kids, self.roots, centres = [], [], [], [], []
        for _ in range(options.trees):
            leaves = []

            def grow(members):
                if len(members) <= options.leaf:
                    leaves.append(x[members].mean(0) if len(members) else np.zeros(self.dim))  # noqa: B023
                    return -len(leaves)  # noqa: B023
                a, b = x[rng.choice(members, 2, replace=False)]
                plane = a - b
                if not plane.any():
                    plane = rng.standard_normal(self.dim)
                plane = plane / np.linalg.norm(plane)
                at = x[members] @ plane
                cut = float(np.median(at))
                side = at > cut
                if side.all() or not side.any():  # copies: deal them out evenly, no plane parts them
                    leaves.append(x[members].mean(0))  # noqa: B023
                    return -len(leaves)  # noqa: B023
                node = len(planes)
                planes.append(plane)
                cuts.append(cut)
                kids.append((0, 0))
                kids[node] = (grow(members[~side]), grow(members[side]))
                return node

            self.roots.append(grow(np.arange(len(x))))
            centres.append(np.array(leaves))
        self.planes = np.array(planes).reshape(-1, self.dim)
        self.cuts, self.kids, self.centres = np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), centres
        leaves = min(len(c) for c in centres)
        self.extra = int(np.clip(np.ceil(np.log2(max(rows, 1) / (leaves * options.rows_per_leaf))), 0, 24)) if rows else 0
        turns = rng.standard_normal((options.trees, 24, self.dim))
        self.turns = turns / np.linalg.norm(turns, axis=2, keepdims=True)
        self.visits = options.visits
        self.part_leaves = max(1, options.part_rows // options.rows_per_leaf)

    def part(self, keys: np.ndarray) -> np.ndarray:
        """The part of each leaf key: some leaves of a tree that follow each other."""
        place = (((keys >> 24) & 0xFFFFFF) << self.extra) | (keys & 0xFFFFFF)
        return (keys >> 48 << 48) | place // self.part_leaves

    def route(self, x: np.ndarray) -> list[np.ndarray]:
        """Leaf key of every vector in each tree."""
        out = []
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(node >= 0)
                if not len(inner):
                    break
                at = node[inner]
                side = np.einsum("ij,ij->i", x[inner], self.planes[at]) > self.cuts[at]
                node[inner] = np.where(side, self.kids[at, 1], self.kids[at, 0])
            leaf = -node - 1
            away = x - self.centres[t][leaf]
            bits = np.zeros(len(x), np.int64)
            for level in range(self.extra):
                bits = bits * 2 + (away @ self.turns[t, level] > 0)
            out.append((t << 48) | (leaf.astype(np.int64) << 24) | bits)
        return out

    def search(self, q: np.ndarray) -> list[int]:
        """Keys of the leaves that one query opens, best first."""
        at = self.planes @ q - self.cuts if len(self.planes) else self.cuts
        heap = [(-np.inf, t, root, -1, 0) for t, root in enumerate(self.roots)]
        away: dict[tuple[int, int], np.ndarray] = {}
        found: list[int] = []
        while heap and len(found) < self.visits:
            near, t, node, level, bits = heapq.heappop(heap)
            margin = -near
            if node >= 0:
                m = at[node]
                low, high = self.kids[node]
                heapq.heappush(heap, (-min(margin, -m), t, low, -1, 0))
                heapq.heappush(heap, (-min(margin, m), t, high, -1, 0))
                continue
            leaf, level = -node - 1, max(level, 0)
            if level == self.extra:
                found.append((t << 48) | (int(leaf) << 24) | bits)
                continue
            if (t, leaf) not in away:
                away[t, leaf] = self.turns[t, : self.extra] @ (q - self.centres[t][leaf])
            m = away[t, leaf][level]
            heapq.heappush(heap, (-min(margin, -m), t, node, level + 1, bits * 2))
            heapq.heappush(heap, (-min(margin, m), t, node, level + 1, bits * 2 + 1))
        return found

    def margins(self, q: np.ndarray) -> list[np.ndarray]:
        """Per tree the smallest margin on the path to each leaf, by (leaf, bits): search opens leaves from the largest down."""
        at = self.planes @ q - self.cuts if len(self.planes) else self.cuts
        out = []
        for t, root in enumerate(self.roots):
            node, m, leaf = np.array([root]), np.array([np.inf]), np.zeros(len(self.centres[t]))
            while len(node):
                end = node < 0
                leaf[-node[end] - 1] = m[end]
                node, m = node[~end], m[~end]
                node, m = self.kids[node].T.ravel(), np.concatenate([np.minimum(m, -at[node]), np.minimum(m, at[node])])
            leaf = leaf[:, None]
            turn = (q - self.centres[t]) @ self.turns[t, : self.extra].T
            for level in range(self.extra):
                side = turn[:, level, None]
                leaf = np.stack([np.minimum(leaf, -side), np.minimum(leaf, side)], 2).reshape(len(leaf), -1)
            out.append(leaf)
        return out

    def opened(self, q: np.ndarray, near: np.ndarray) -> np.ndarray:
        """How many leaves a query opens until it has met each of these vectors."""
        leaves = self.margins(q)
        best = np.full(len(near), -np.inf)
        for t, keys in enumerate(self.route(near)):
            best = np.maximum(best, leaves[t][(keys >> 24) & 0xFFFFFF, keys & 0xFFFFFF])
        return np.sum([[(m >= b).sum() for b in best] for m in leaves], 0)


def vectors(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    """A list<float> column without nulls as a matrix of doubles."""
    return batch.column(i).flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def firsts(group: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of every group, each id once: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g, i = group[order], ids[order]
    if len(order) > 1:  # the same row met twice has one score, so it stands beside itself
        once = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))
        order, g = order[once], g[once]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    sizes = np.diff(np.append(start, len(g)))
    return order[np.arange(len(g)) - np.repeat(start, sizes) < n]


def best_in_leaves(leaf: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, opened: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the n best rows, by exact cosines, in the leaves that each query opened; leaf is ascending."""
    norm, own = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    u, uq = x / norm[:, None], q / own[:, None]
    names, first = np.unique(leaf, return_index=True)
    ends = np.append(first[1:], len(leaf))
    wanted, asker = np.concatenate(opened), np.repeat(np.arange(len(q)), [len(o) for o in opened])
    at = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
    hit = np.flatnonzero(names[at] == wanted) if len(names) else np.zeros(0, int)
    hit = hit[np.argsort(at[hit], kind="stable")]
    at, asker = at[hit], asker[hit]
    edge = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    least, found = np.full(len(q), -2.0), []
    for lo, hi in zip(edge, np.append(edge[1:], len(at)), strict=True):
        a, b = first[at[lo]], ends[at[lo]]
        step = max(1, 2_000_000 // (b - a))
        for c in range(lo, hi, step):
            who = asker[c : min(c + step, hi)]
            rough = uq[who] @ u[a:b].T
            if b - a >= n:
                least[who] = np.maximum(least[who], np.partition(rough, b - a - n, axis=1)[:, b - a - n])
            i, j = np.nonzero(rough >= least[who][:, None] - 1e-9)
            i, j = who[i], j + a
            score = np.einsum("ij,ij->i", x[j], q[i]) / (norm[j] * own[i])
            keep = firsts(i, ids[j], score, n)
            found.append((i[keep], ids[j][keep], score[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, name, score = (np.concatenate([f[k] for f in found]) for k in range(3))
    keep = firsts(i, name, score, n)
    return i[keep], name[keep], score[keep]


def compare_all(data: DataFrame, qids: np.ndarray, q: np.ndarray, n: int) -> DataFrame:
    """qid, id, score: the n best rows of data(id, v) for each query vector, per partition of data; nothing but these is shuffled."""
    asked = data.sparkSession.sparkContext.broadcast((qids, q))
    dim = q.shape[1]

    def scan(batches):
        names, wide = asked.value[0], asked.value[1].astype(np.float64)
        who, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        one = [np.zeros(1, np.int64)] * len(wide)  # all rows as one leaf
        for batch in batches:
            if batch.num_rows:
                new = best_in_leaves(np.zeros(batch.num_rows, np.int64), batch.column(0).to_numpy(), vectors(batch, 1, dim), wide, one, n)
                who, ids, score = np.append(who, new[0]), np.append(ids, new[1]), np.append(score, new[2])
                keep = firsts(who, ids, score, n)
                who, ids, score = who[keep], ids[keep], score[keep]
        yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(ids), pa.array(score)], names=["qid", "id", "score"])

    return data.select("id", "v").mapInArrow(scan, "qid long, id long, score double")


def held(frame: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a bounded frame(id, v) on the driver."""
    got = frame.toArrow()
    v = got.column("v").combine_chunks()
    flat = v.flatten().to_numpy() if len(got) else np.zeros(0)
    return got.column("id").to_numpy(), flat.reshape(-1, dim)


def enough_visits(forest: Forest, data: DataFrame, queries: DataFrame, k: int, options: Options) -> int:
    """Leaves to open so that a sample of the queries meets ``recall`` of its k true neighbours."""
    qids, q = held(queries.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(options.probes), forest.dim)
    if not len(qids):
        return options.visits
    ordered = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    true = compare_all(data, qids, q, k + 1).where("qid <> id").withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= k)
    near = true.join(data.select("id", "v"), "id").select("qid", "v").collect()  # probes x k vectors
    need = []
    for qid, own in zip(qids.tolist(), unit(q.astype(np.float64)), strict=True):
        mine = [r["v"] for r in near if r["qid"] == qid]
        if mine:
            need += forest.opened(own, unit(np.array(mine, np.float64))).tolist()
    return max(options.visits, int(np.quantile(need, options.recall, method="higher"))) if need else options.visits


def nearest(rows: DataFrame, is_query, k: int = 5, options: Options = Options(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, its k nearest found among all other rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    K.small_batches(spark)
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    kind = "array<double>" if "double" in rows.schema[vector_col].dataType.simpleString() else "array<float>"
    clean = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    common = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = common[0]["n"] if common else 1
    # vectors over the power of two below their largest component; their k + 1 smallest ids are all that any result can hold
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).cast("double"))
    clean = clean.where(F.size("v") == dim).withColumn("power", power).withColumn("way", F.transform("v", lambda x: x.cast("double") / F.col("power") + F.lit(0.0))).drop("power")
    few = clean.withColumn("nth", F.row_number().over(Window.partitionBy("way").orderBy("id"))).where(F.col("nth") <= k + 1)
    data = scratch.save(few.groupBy("way").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min_by("v", "id").alias("v")).withColumn("id", F.element_at("ids", 1)))
    total = data.count()
    asked = clean.where(is_query(F.col("id"))).select("id", "way")
    owners = scratch.save(asked.join(data.select("way", F.col("id").alias("qid")), "way").select(F.col("id").alias("query_id"), "qid").distinct())
    queries = scratch.save(owners.select(F.col("qid").alias("id")).distinct().join(data.select("id", "v"), "id"))
    if not total:
        scored = spark.createDataFrame([], "qid long, id long, score double")
    else:
        _, sample = held(data.orderBy(F.xxhash64("id"), "id").limit(options.sample).select("id", "v"), dim)
        built = Forest(unit(sample.astype(np.float64)), options, total)
        del sample
        built.visits = enough_visits(built, data, queries, k, options)
        scored = meet_in_leaves(data, queries, spark.sparkContext.broadcast(built), dim, k, kind, options, scratch)
    ordered = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = scored.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= k + 1).select("qid", "id", "score")
    spread = scratch.save(top.join(data.select("id", "ids"), "id").select("qid", F.explode("ids").alias("vec_id"), "score"))
    mine = owners.join(spread, "qid").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def meet_in_leaves(data: DataFrame, queries: DataFrame, forest, dim: int, k: int, kind: str, options: Options, scratch: Scratch) -> DataFrame:
    """qid, id, score: the best rows for each query in the leaves that it opens, part by part; a row may come from several parts."""
    names = ["part", "kind", "id", "v", "leaf", "opened"]
    schema = f"part long, kind int, id long, v {kind}, leaf long, opened array<long>"

    def index(batches):
        for batch in batches:
            x = vectors(batch, 1, dim)
            for keys in forest.value.route(unit(x)) if len(x) else []:
                yield pa.RecordBatch.from_arrays([pa.array(forest.value.part(keys)), pa.array(np.zeros(len(x), np.int32)), batch.column(0), batch.column(1), pa.array(keys), pa.nulls(len(x), pa.list_(pa.int64()))], names=names)

    def parts_only(batches):
        for batch in batches:
            x = vectors(batch, 1, dim)
            for keys in forest.value.route(unit(x)) if len(x) else []:
                yield pa.RecordBatch.from_arrays([pa.array(forest.value.part(keys))], names=["part"])

    def ask(batches):
        for batch in batches:
            owner, part, opened = [], [], []
            for i, q in enumerate(unit(vectors(batch, 1, dim))):
                keys = np.sort(np.array(forest.value.search(q), np.int64))
                of = forest.value.part(keys)  # ascending, as the keys are
                edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                owner += [i] * len(edge)
                part += of[edge].tolist()
                opened += np.split(keys, edge[1:])
            if owner:
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.ones(len(owner), np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.nulls(len(owner), pa.int64()), pa.array(opened, pa.list_(pa.int64()))], names=names)

    rows, asks = (t.select("id", "v").mapInArrow(f, schema) for t, f in ((data, index), (queries, ask)))
    sizes = data.select("id", "v").mapInArrow(parts_only, "part long").groupBy("part").count()
    crowded = scratch.save(sizes.where(F.col("count") > options.crowd).select("part", F.ceil(F.col("count") / options.part_rows).cast("int").alias("salts")))
    if crowded.limit(1).count():
        rows = rows.join(crowded, "part", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0)))
        asks = asks.join(crowded, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    else:
        rows, asks = (t.withColumn("salt", F.lit(0)) for t in (rows, asks))
    met = rows.select("salt", *names).unionByName(asks.select("salt", *names))

    def rerank(batches):
        """Sorted by part and salt, rows before queries: rows are held until the next part, queries are answered as they come."""
        here, held, made = None, [], None
        for batch in batches:
            n = batch.num_rows
            salt, part, what = (batch.column(i).to_numpy() for i in range(3))
            turn = np.append(True, (salt[1:] != salt[:-1]) | (part[1:] != part[:-1]) | (what[1:] != what[:-1]))
            edge = np.flatnonzero(turn[:n])
            for a, b in zip(edge, np.append(edge[1:], n), strict=True):
                run = batch.slice(a, b - a)
                if (part[a], salt[a]) != here:
                    here, held, made = (part[a], salt[a]), [], None
                if not what[a]:
                    held.append(run)
                    continue
                if not held:
                    continue
                if made is None:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = [run]  # any: the rows now stand in the arrays
                    order = np.argsort(t.column(5).to_numpy(), kind="stable")
                    made = t.column(5).to_numpy()[order], t.column(3).to_numpy()[order], vectors(t, 4, dim)[order]
                qids, q, lists = run.column(3).to_numpy(), vectors(run, 4, dim), run.column(6)
                who, ids, score = best_in_leaves(*made, q, [lists[i].values.to_numpy() for i in range(len(q))], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(ids), pa.array(score)], names=["qid", "id", "score"])

    ready = met.repartition(F.col("part"), F.col("salt")).sortWithinPartitions("part", "salt", "kind")
    return ready.mapInArrow(rerank, "qid long, id long, score double").distinct()
