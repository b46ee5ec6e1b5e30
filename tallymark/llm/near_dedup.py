"""MinHash near-duplicates by a chosen-path similarity join.

Documents with equal shingle sets are one class. Every class has 64 minwise tokens; a tree branches a class into the two
tokens of smallest hash under the path so far, so classes that share tokens choose the same branches, and classes that share
a whole path meet in a node. Several trees are grown on the same tokens: at Jaccard 0.8 one tree of depth 3 misses a pair with
probability 0.14, and the misses of trees are not independent (four miss 1.3e-3, ten none of 100,000 simulated pairs, by ``missed``;
where every node is branched to the last level four miss 3.1e-3, ten 1e-4). Nodes of up to ``small`` classes are compared exhaustively on 64-byte
sketches; larger ones branch further, and what is still large after ``deeper`` levels (dense clusters do not split) is compared
exhaustively too, in pairs of blocks spread over tasks. Nothing is capped.

Candidates become links only by an exact count on full sets, in two passes. First each class's best candidate and the one of
lowest key are confirmed, which joins up clusters of any size. Then the classes that candidates connect, confirmed or not, form groups; a group whose classes
are not all linked yet is cut into blocks of about 128, and each pair of blocks that could still join two components is one
unit of work: exact intersections by matrix product, of which only a spanning forest of links comes out. So no pair is ever
emitted for being in the same group, and none that could join two components is left out. Sets travel only for candidates.

Defined results: null or wordless texts have an empty set and link with nothing; equal sets are linked; repeated rows and ids
are rows of one class; ties go to the smaller id; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .scratch import Scratch

U64 = np.uint64
COORDS = 64


@dataclass(frozen=True)
class Options:
    words: int = 5
    numerator: int = 80
    denominator: int = 100
    trees: int = 10
    depth: int = 3
    small: int = 2048
    deeper: int = 2
    block: int = 128

    @property
    def least_matches(self) -> int:
        """Sketch coordinates that must agree: five standard deviations under the mean at the threshold."""
        p = self.numerator / self.denominator
        return max(1, int(COORDS * (p - 5 * (p * (1 - p) / COORDS) ** 0.5)))


_rng = np.random.default_rng(977)
_A = _rng.integers(1, 2**62, COORDS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of 64 minwise tokens (uint32) per non-empty set, zeros for an empty one."""
    out = np.zeros((len(off) - 1, COORDS), np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for i in range(COORDS):
            out[some, i] = np.minimum.reduceat(((sets * _A[i] + _B[i]) >> U64(32)).astype(np.uint32), off[:-1][some])
    return out


def set_keys(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit key of each set as a signed integer: equal sets have equal keys."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(K.mix(sets ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    return K.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def describe(docs: DataFrame, options: Options) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set) and sig of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch):
                sets, at = K.shingle_sets(buf, off, options.words)
                n, sig = np.diff(at), signatures(sets, at)
                none = n == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(set_keys(sets, at), mask=none), K.fixed_binary(sig, none)], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key long, sig binary")


def branch(paths: np.ndarray, sig: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two child paths of each row's path, by the two tokens of smallest hash under it; and the coordinates chosen."""
    token = sig.astype(np.uint64) | (np.arange(COORDS, dtype=np.uint64) << U64(40))
    rank = K.mix(token ^ paths[:, None])
    if used is not None:
        np.put_along_axis(rank, used, U64(0xFFFFFFFFFFFFFFFF), 1)
    two = np.argpartition(rank, 1, axis=1)[:, :2]
    return K.mix(np.take_along_axis(rank, two, 1) + U64(0x632BE59BD9B4E019)), two


def tree_paths(sig: np.ndarray, tree: int, depth: int) -> list[np.ndarray]:
    """The 2^depth leaf paths of every row in one tree."""
    level = [(np.full(len(sig), K.mix(np.array([tree + 1], np.uint64))[0]), None)]
    for _ in range(depth):
        grown = []
        for paths, used in level:
            child, two = branch(paths, sig, used)
            grown += [(child[:, c], two[:, c : c + 1] if used is None else np.hstack([used, two[:, c : c + 1]])) for c in (0, 1)]
        level = grown
    return [p for p, _ in level]


def missed(similarity: float, pairs: int, options: Options, crowded: bool = False, seed: int = 1) -> float:
    """Share of simulated pairs of this Jaccard similarity that meet in no node; crowded: as if every node were branched to the last level."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, (pairs, COORDS)).astype(np.uint32)
    b = np.where(rng.random((pairs, COORDS)) < similarity, a, rng.integers(0, 1 << 32, (pairs, COORDS)).astype(np.uint32))
    for tree in range(options.trees):
        x, y = tree_paths(a, tree, options.depth), tree_paths(b, tree, options.depth)
        for _ in range(options.deeper if crowded else 0):
            x, y = ([c for p in side for c in branch(p, sig)[0].T] for side, sig in ((x, a), (y, b)))
        x, y = np.stack(x, 1), np.stack(y, 1)
        apart = ~(x[:, :, None] == y[:, None, :]).any((1, 2))
        a, b = a[apart], b[apart]
    return len(a) / pairs


def tree_nodes(reps: DataFrame, options: Options) -> DataFrame:
    """(node, key): the leaf paths of every class in every tree."""

    def run(batches):
        for batch in batches:
            sig = K.binary_rows(batch.column(1), np.uint32, COORDS)
            keys, nodes = batch.column(0).to_numpy(), []
            for tree in range(options.trees):
                nodes += tree_paths(sig, tree, options.depth)
            if len(keys):
                node = np.concatenate(nodes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(keys, len(nodes)))], names=["node", "key"])

    return reps.select("key", "sig").mapInArrow(run, "node long, key long")


def branch_further(members: DataFrame, reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sig = K.binary_rows(batch.column(2), np.uint32, COORDS)
            child, _ = branch(batch.column(0).to_numpy().view(np.uint64), sig)
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), pa.array(np.repeat(batch.column(1).to_numpy(), 2))], names=["node", "key"])

    return members.join(reps.select("key", "sig"), "key").select("node", "key", "sig").mapInArrow(run, "node long, key long")


def sized(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("size", F.count("*").over(Window.partitionBy("node"))).where("size > 1")


def node_members(reps: DataFrame, options: Options, scratch: Scratch) -> DataFrame:
    """(node, key, sketch) of every node of two classes or more; oversized nodes branched, then cut into block pairs."""
    got = scratch.save(sized(tree_nodes(reps, options)))
    parts = []
    for level in range(options.deeper + 1):
        parts.append(got.where(F.col("size") <= options.small).select("node", "key"))
        large = got.where(F.col("size") > options.small)
        if not large.limit(1).count():
            break
        if level == options.deeper:
            blocks = F.ceil(F.col("size") / F.lit(max(options.small // 2, 1))).cast("int")
            own = F.pmod(F.xxhash64("key"), blocks).cast("int")
            split = large.select("node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            parts.append(split.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "key"))
        else:
            got = scratch.save(sized(branch_further(large.select("node", "key"), reps).distinct()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)

    def sketch(batches):
        for batch in batches:
            sig = K.binary_rows(batch.column(1), np.uint32, COORDS)
            small = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), K.fixed_binary(small)], names=["key", "first_id", "sketch"])

    sketches = reps.select("key", "sig", "first_id").mapInArrow(sketch, "key long, first_id long, sketch binary")
    return scratch.save(out.join(sketches, "key").select("node", "key", "sketch", "first_id"))


def _pairs(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes i < j of all pairs inside groups of these sizes that begin at these rows."""
    group, at = K.runs(sizes)
    rows, rest = first[group] + at, sizes[group] - at - 1
    owner, step = K.runs(rest)
    return rows[owner], rows[owner] + 1 + step


def best_partners(members: DataFrame, options: Options) -> DataFrame:
    """Pairs of classes whose sketches agree enough within a node.

    members(node, key, sketch, label, first_id): per class v of a node with partners of another label, its best partner w, how many
    coordinates matches, the partner of lowest key, and v's first_id.
    """
    least = options.least_matches

    def compare(label, sk, i, j):
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
        same = np.zeros(len(i), np.uint8)
        for lo in range(0, len(i), 20000):
            same[lo : lo + 20000] = (sk[i[lo : lo + 20000]] == sk[j[lo : lo + 20000]]).sum(1)
        keep = same >= least
        return i[keep], j[keep], same[keep]

    def best(key, i, j, same):
        v, w, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([same, same]).astype(np.int64)
        order = np.lexsort((key[w], -s, v))
        v, w, s = v[order], w[order], s[order]
        lead = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        return v[lead], w[lead], s[lead], np.minimum.reduceat(key[w], lead)

    def best_in_large(key, label, sk, a, b):
        """The same for one large node, row against later rows; memory is linear in the node."""
        top, who, low = np.full(b - a, -1), np.zeros(b - a, np.int64), np.full(b - a, (1 << 63) - 1)
        for i in range(a, b - 1):
            same = (sk[i + 1 : b] == sk[i]).sum(1)
            hit = np.flatnonzero((same >= least) & (label[i + 1 : b] != label[i]))
            if not len(hit):
                continue
            n, j = same[hit], hit + i + 1 - a
            better = j[(n > top[j]) | ((n == top[j]) & (key[i] < key[who[j]]))]
            top[better], who[better] = same[better + a - i - 1], i
            low[j] = np.minimum(low[j], key[i])
            m = hit[np.lexsort((key[j + a], -n))[0]] + i + 1
            k = i - a
            if same[m - i - 1] > top[k] or (same[m - i - 1] == top[k] and key[m] < key[who[k]]):
                top[k], who[k] = same[m - i - 1], m
            low[k] = min(low[k], key[j + a].min())
        v = np.flatnonzero(top >= 0)
        return v + a, who[v], top[v], low[v]

    def emit(node, key, label, first_id, sk):
        edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(edge, len(node)))
        found = []
        few = (sizes > 1) & (sizes <= 48)
        lot, lots = 0, np.cumsum(np.where(few, sizes * (sizes - 1) // 2, 0))
        chosen = np.flatnonzero(few)
        while lot < len(chosen):
            upto = max(lot + 1, int(np.searchsorted(lots[chosen], (lots[chosen[lot - 1]] if lot else 0) + 200_000)))
            take = chosen[lot:upto]
            pairs = compare(label, sk, *_pairs(sizes[take], edge[take]))
            if len(pairs[0]):
                found.append(best(key, *pairs))
            lot = upto
        for g in np.flatnonzero(sizes > 48):
            got = best_in_large(key, label, sk, edge[g], edge[g] + sizes[g])
            if len(got[0]):
                found.append(got)
        if not found:
            return None
        v, w, s, low = (np.concatenate([f[k] for f in found]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(key[v]), pa.array(key[w]), pa.array(s), pa.array(low), first_id.take(pa.array(v))], names=["v", "w", "matches", "low", "first_id"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
            if cut or (held and held[-1].column(0)[0].as_py() != node[0]):
                held.append(batch.slice(0, cut))
                yield from work(held)
                held = []
            held.append(batch.slice(cut))
        yield from work(held)

    def work(held):
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                sk = K.binary_rows(t.column(2).combine_chunks(), np.uint8, COORDS)
                got = emit(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(3).to_numpy(), t.column(4).chunk(0), sk)
                if got is not None:
                    yield got

    ready = members.repartition(F.col("node")).sortWithinPartitions("node", "key")
    found = ready.select("node", "key", "sketch", "label", "first_id").mapInArrow(run, "v long, w long, matches long, low long, first_id long")
    best_of = F.max(F.struct("matches", (-F.col("w")).alias("w"))).alias("m")
    return found.groupBy("v").agg(best_of, F.min("low").alias("low"), F.first("first_id").alias("first_id")).select("v", (-F.col("m.w")).alias("w"), "low", "first_id")


def full_sets(docs: DataFrame, wanted: DataFrame, options: Options) -> DataFrame:
    """(key, shingles as sorted 64-bit integers) of the classes of wanted(key, first_id)."""

    def run(batches):
        for batch in batches:
            for _, _, buf, off in K.text_slices(batch):
                sets, at = K.shingle_sets(buf, off, options.words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets, at)), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)], pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # the same kind of join at every size: a broadcast on small inputs only would make growth hard to read
    found = texts.join(wanted.select("first_id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").mapInArrow(run, "key long, shingles binary")
    return found.dropDuplicates(["key"])


def confirm(edges: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """Those of edges(a, b) whose full sets are similar enough, by exact integer arithmetic."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = np.zeros(len(x), bool)
            for i in range(len(x)):
                p, q = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good[i] = options.denominator * both >= options.numerator * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ends(best: DataFrame) -> DataFrame:
    """(a, b): both candidate pairs of every class of best(v, w, low)."""
    return best.select(F.col("v").alias("a"), F.explode(F.array("w", "low")).alias("b"))


def candidate_groups(best: DataFrame, members: DataFrame, options: Options, scratch: Scratch) -> DataFrame:
    """(v, label): the components of the candidate graph, by rounds of candidates outside the own component (Boruvka).

    members has only classes with candidates; the smallest class of a component has no row, it is its own label.
    """
    edges = ends(best)
    while True:
        labels = connected_components(edges, scratch)
        named = members.join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        fresh = scratch.save(best_partners(named, options))
        if not fresh.limit(1).count():
            return labels
        edges = labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(ends(fresh))


def block_pairs(classes: DataFrame, options: Options, scratch: Scratch) -> DataFrame:
    """(pair, key, label): classes(key, grp, label) dealt to the pairs of blocks of their group that may hold links between labels.

    A label with half a block of classes has blocks of its own, and no pair is made of two blocks of one label.
    """
    half = max(options.block // 2, 1)
    sizes = scratch.save(classes.groupBy("grp", "label").agg(F.count("*").alias("n")))
    groups = scratch.save(sizes.groupBy("grp").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.sum(F.when(F.col("n") < half, F.col("n"))).alias("pooled")).where("labels > 1").drop("labels"))
    small = classes.join(groups.where(F.col("all") <= options.block), "grp").select(F.col("grp").alias("pair"), "key", "label")
    if not groups.where(F.col("all") > options.block).limit(1).count():
        return small
    sizes = sizes.join(groups.where(F.col("all") > options.block), "grp").withColumn("own", F.col("n") >= half).withColumn("blocks", F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("pooled")) / options.block).cast("int"))
    sizes = scratch.save(sizes.select("grp", "label", "own", "blocks"))
    name = lambda i: F.when(F.col("own"), F.xxhash64("label", i)).otherwise(F.xxhash64(F.lit("pool"), i))
    every = sizes.select("grp", F.when(F.col("own"), F.col("label")).alias("owner"), "own", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    every = scratch.save(every.select("grp", "owner", name(F.col("i")).alias("blk")).distinct())
    other = every.select("grp", F.col("owner").alias("owner2"), F.col("blk").alias("blk2"))
    pairs = every.join(other, "grp").where("blk <= blk2 AND (owner IS NULL OR owner2 IS NULL OR owner <> owner2)")
    pairs = scratch.save(pairs.select("grp", F.xxhash64("grp", "blk", "blk2").alias("pair"), F.explode(F.array_distinct(F.array("blk", "blk2"))).alias("blk")))
    dealt = classes.join(sizes, ["grp", "label"]).select("grp", "key", "label", name(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).alias("blk"))
    return dealt.join(pairs, ["grp", "blk"]).select("pair", "key", "label").unionByName(small)


def block_links(dealt: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """(a, b): a spanning forest of the exact links between labels within each pair of blocks."""

    def links(key, label, shingles):
        m = len(key)
        sizes = np.array([len(s) for s in shingles])
        values, at = np.unique(np.concatenate(shingles), return_inverse=True)
        row = np.repeat(np.arange(m), sizes)
        often = np.bincount(at, minlength=len(values)) > 1  # a shingle of one set alone meets nothing
        place = np.cumsum(often) - 1
        keep = often[at]
        row, at = row[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((m, m), np.float32)
        for lo in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            part = np.zeros((m, 4096), np.float32)
            part[row[a:b], at[a:b] - lo] = 1
            both += part @ part.T
        both = np.rint(both).astype(np.int64)
        near = options.denominator * both >= options.numerator * (sizes[:, None] + sizes[None, :] - both)
        i, j = np.nonzero(np.triu(near, 1) & (label[:, None] != label[None, :]))
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(int(label[p])), root(int(label[q]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield key[p], key[q]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            pair, key, label = (t.column(c).to_numpy() for c in range(3))
            edge = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
            found = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    found += links(key[a:b], label[a:b], [np.frombuffer(s, np.uint64) for s in t.column(3).slice(a, b - a).to_pylist()])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                pair = batch.column(0).to_numpy()
                cut = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if pair[0] != pair[-1] else 0
                if cut or (held and held[-1].column(0)[0].as_py() != pair[0]):
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield from flush()
                held.append(batch.slice(cut))
        yield from flush()

    ready = dealt.join(sets, "key").select("pair", "key", "label", "shingles").repartition(F.col("pair")).sortWithinPartitions("pair", "key")
    return ready.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    K.small_batches(spark)
    rows = scratch.save(describe(docs, options))
    reps = scratch.save(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig")))
    members = node_members(reps, options, scratch)
    best = scratch.save(best_partners(members.withColumn("label", F.col("key")), options))
    sets = scratch.save(full_sets(docs, best, options))
    scratch.tidy()
    links = scratch.save(confirm(ends(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, options))
    labels = connected_components(links, scratch)
    wanted = best.select(F.col("v").alias("key"))
    groups = candidate_groups(best, scratch.save(members.join(wanted, "key", "left_semi")), options, scratch)
    classes = wanted.join(groups.select(F.col("v").alias("key"), F.col("label").alias("grp")), "key", "left").join(labels.withColumnRenamed("v", "key"), "key", "left")
    classes = classes.select("key", F.coalesce("grp", "key").alias("grp"), F.coalesce("label", "key").alias("label"))
    more = scratch.save(block_links(block_pairs(scratch.save(classes), options, scratch), sets, options))
    if more.limit(1).count():
        labels = connected_components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more), scratch)
    classed = reps.select("key", "first_id").join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = scratch.save(classed.groupBy("label").agg(F.min("first_id").alias("component_id")))
    classed = scratch.save(classed.join(smallest, "label").select("key", "component_id"))
    scratch.tidy()
    joined = rows.select("doc_id", "n_shingles", "key").join(classed, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
