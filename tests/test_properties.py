import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.functions import hashing as H
from tallymark.operators import decode, rateless
from tallymark.operators.sketch import _fold, estimate_array
from tallymark.sources import codec

fingerprints = st.lists(st.integers(0, H.FP_MASK), max_size=60, unique=True)


def view(plus, minus, cells, seed):
    fp = np.array([*plus, *minus], np.uint64)
    sign = np.array([1] * len(plus) + [-1] * len(minus), np.int64)
    out = np.zeros((4, cells), np.uint64)
    _fold(fp, (fp >> np.uint64(3)).view(np.int64), sign, cells, seed, out)
    return out


@settings(max_examples=60, deadline=None)
@given(fingerprints, st.integers(0, 2**63 - 1), st.integers(0, 60))
def test_peeling_gives_back_what_was_put_in(fps, seed, cut):
    plus, minus = fps[:cut], fps[cut:]
    got = decode.peel([view(plus, minus, 512, seed)], [seed])
    assert got.complete and {f for f, _ in got.plus} == set(plus) and {f for f, _ in got.minus} == set(minus)
    assert all(r == f >> 3 for f, r in got.plus + got.minus)


@settings(max_examples=40, deadline=None)
@given(fingerprints, st.integers(0, 60), st.integers(4, 300), st.integers(0, 2**64 - 1))
def test_sketches_are_linear_and_travel(fps, cut, cells, seed):
    a, b, both = view(fps[:cut], [], cells, seed), view(fps[cut:], [], cells, seed), view(fps, [], cells, seed)
    merged = a.copy()
    merged[0] += b[0]
    merged[1:] ^= b[1:]
    assert (merged == both).all()
    back, s = codec.decode(codec.encode(both, seed))
    assert (back == both).all() and s == seed


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, H.FP_MASK), min_size=1, max_size=400, unique=True), st.integers(4, 5000), st.integers(0, 2**63 - 1))
def test_positions_are_distinct_cells(fps, cells, seed):
    at = H.positions(np.array(fps, np.uint64), cells, seed)
    assert ((at >= 0) & (at < cells)).all() and all(len(set(row)) == 3 for row in at.tolist())


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300))
def test_estimates_are_near(seed, d):
    rng = np.random.default_rng(seed)
    hats = [estimate_array(view(rng.integers(0, 2**56, d).tolist(), [], 512, int(s))) / d for s in rng.integers(1, 2**40, 30)]
    assert abs(np.mean(hats) - 1) < 0.1


@settings(max_examples=20, deadline=None)
@given(fingerprints, st.integers(0, 60))
def test_rateless_prefix_decodes(fps, cut):
    fp = np.array(fps, np.uint64)
    sign = np.array([1] * len(fps[:cut]) + [-1] * len(fps[cut:]), np.int64)
    work = np.zeros((4, 400), np.uint64)
    h = rateless.symbol_hash(fp, fp)
    for which, at in rateless.indexes(h, 400):
        np.add.at(work[0].view(np.int64), at, sign[which])
        for k, v in ((1, fp), (2, fp), (3, h)):
            np.bitwise_xor.at(work[k], at, v[which])
    got = rateless.decode(work)
    assert got.complete and {f for f, _ in got.plus} == set(fps[:cut]) and {f for f, _ in got.minus} == set(fps[cut:])
