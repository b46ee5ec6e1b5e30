"""Connected components of an edge table; nothing but a yes or no reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LINKS = "v long, r long, changed boolean"
TASK_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it is joined to) over the links a - b, for every vertex but those that are smallest themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, before[side], low)  # hook the roots, not the vertices
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[x] != root[y]
        if not apart.any():
            break
        x, y = x[apart], y[apart]
    joined = np.flatnonzero(root != np.arange(len(ids)))
    return ids[joined], ids[root[joined]]


def _merge_locally(batches):
    """Components over the links (v, r, jumped) of one partition: every vertex met points at the smallest id it is joined to here."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    v, r, jumped = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
    del held
    vertex, low = forest(v, r)
    given = np.unique(np.stack([v, r], 1)[v != r], axis=0)
    changed = bool(jumped.any()) or len(given) != len(vertex) or not (np.array_equal(given[:, 0], vertex) and np.array_equal(given[:, 1], low))
    for lo in range(0, len(vertex), 50_000):
        part = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(vertex[part]), pa.array(low[part]), pa.array(np.full(len(vertex[part]), changed))], names=["v", "r", "changed"])


def _merge_first(batches):
    """The same for raw links (v, r), 2^20 at a time, before they are dealt: of a hub's links one a task is left."""
    held, size = [], 0

    def flush():
        v, r = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        vertex, low = forest(v, r)
        return pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(low), pa.array(np.ones(len(vertex), bool))], names=["v", "r", "jumped"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TASK_LINKS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(v, label): the smallest id reachable over edges(a, b), for every vertex but those that are smallest themselves.

    Links are merged where they stand, then point from the larger to the smaller id and are dealt by the larger, which has one link
    a task left: a hub is never a hot key. A round shortens every
    link by one jump (a join of two written tables, whose hot keys adaptive execution can split) and merges what meets in a
    partition; it ends when a round changes nothing. A task merges about 2^20 links, in arrays, whatever their number.
    """

    def merged(links: DataFrame, n: int) -> DataFrame:
        dealt = links.repartition(max(1, -(-n // TASK_LINKS)), "v")
        return scratch.save(dealt.select("v", "r", "jumped").mapInArrow(_merge_locally, LINKS))

    first = scratch.save(edges.where("a <> b").select("a", "b").mapInArrow(_merge_first, "v long, r long, jumped boolean"))
    n = first.count()
    links = merged(first, n)
    scratch.drop(first)
    for _ in range(rounds):
        up = links.select(F.col("v").alias("r"), F.col("r").alias("up"))
        further = merged(links.select("v", "r").join(up, "r", "left").select("v", F.coalesce("up", "r").alias("r"), F.col("up").isNotNull().alias("jumped")), n)
        scratch.drop(links)
        links = further
        if not links.where("changed").limit(1).count():
            return links.select("v", F.col("r").alias("label"))
    raise RuntimeError("components did not settle")
