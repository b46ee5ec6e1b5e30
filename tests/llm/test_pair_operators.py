import collections
import datetime as dt
import re

import numpy as np
import pytest

from tallymark.llm import ann, bwt, chaining, components, near_dedup, suffix_dedup, url_filters
from tallymark.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, words):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return {(d, len(sets[i])): low.get(root(i)) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("small, block", [(2048, 128), (3, 4)])
def test_near_duplicates_against_brute_force(prose, small, block):
    rows = [(r.doc_id, r.text) for r in prose.collect()]
    got = near_dedup.near_duplicates(prose, near_dedup.Options(words=2, small=small, block=block)).collect()
    truth = brute_components(rows, 2)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_trees_meet_pairs_at_the_threshold():
    options = near_dedup.Options()
    assert near_dedup.missed(0.8, 20_000, options) <= 2e-4  # four trees: 1.5e-3
    assert near_dedup.missed(0.8, 8_000, options, crowded=True) <= 4e-4  # four trees: 3e-3


def test_near_duplicates_defined_results(odd, odd_rows, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert [r.component_id for i in (4, 5, 6) for r in by_id[i]] == [4, 4, 4, 4]
    assert by_id[None][0].component_id == 4 and not by_id[None][0].kept
    assert all(by_id[i][0].kept and by_id[i][0].n_shingles == 0 for i in (0, 1, 2))
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(90)] + [(200, 200 + i) for i in range(1, 50)] + [(249, 300), (300, 5)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert set(got.values()) == {0} and len(got) == 91 + 51 - 1
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_interval_expansion_against_brute_force():
    rng = np.random.default_rng(8)
    for length in (9, 20, 60):
        for trial in range(12):
            base = bytes(rng.choice(list(b"ab" if trial % 2 else b"abcd"), 400).tolist())
            segments = [base[a : a + length + int(rng.integers(0, 90))] for a in rng.integers(0, 200, 9)] + [b"a" * 150]
            weights = rng.choice([1, 1, 2], len(segments))
            count = collections.Counter()
            for s, w in zip(segments, weights, strict=True):
                for i in range(len(s) - length + 1):
                    count[s[i : i + length]] += w
            want = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in segments]
            assert [g.tolist() for g in bwt.repeated_starts(segments, weights, length)] == want


def brute_removed(rows, length):
    seen = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = collections.Counter()
    for d, b in raw:
        mark = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                mark[j : j + length] = b"\x01" * length
        out[(d, len(b), bytes(x for x, m in zip(b, mark, strict=True) if not m), len(re.findall(b"\x01+", bytes(mark))))] += 1
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_repeated_strings_against_brute_force(prose, hot):
    rows = [(r.doc_id, r.text) for r in prose.collect()]
    got = suffix_dedup.remove_repeats(prose, 200, hot).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == brute_removed(rows, 200)


def test_repeated_strings_defined_results(odd, odd_rows, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == brute_removed([r[:2] for r in odd_rows], 200)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_chaining_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(100):
        at = np.unique(rng.integers(0, 40, (int(rng.integers(1, 25)), 2)), axis=0)
        x, y = at[:, 0], at[:, 1]
        chains = chaining.chain(x, y, 8.0, 0.3)
        best: dict[int, float] = {}
        for j in sorted(range(len(x)), key=lambda j: (x[j], y[j])):
            best[j] = 8 + max([0.0] + [best[i] - 0.3 * (x[j] - x[i] + y[j] - y[i]) for i in best if x[i] < x[j] and y[i] < y[j]])
        top, score = chains[0], 8.0
        for p, q in zip(top[:-1], top[1:], strict=True):
            assert x[p] < x[q] and y[p] < y[q]
            score = 8 + score - 0.3 * (x[q] - x[p] + y[q] - y[p])
        assert abs(score - max(best.values())) < 1e-9
        assert sorted(i for c in chains for i in c) == list(range(len(x)))


def test_passages_finds_planted_ones_only(prose):
    got = chaining.passages(prose).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    planted = {(100 + i, i) for i in range(8)} | {(200 + i, 20 + i) for i in range(8)} | {(300 + i, 300) for i in range(1, 6)}
    assert planted <= pairs and all(d > s >= 300 for d, s in pairs - planted)
    for r in got:
        if r.doc_id > 300 and r.source_id == 300:
            assert abs(r.start_word - 80) <= 2 and abs(r.end_word - 150) <= 2 and r.identity >= 0.8
    left = {r.doc_id: r.text for r in chaining.remove_passages(prose).collect()}
    assert len(left[300].split()) == 210 and abs(len(left[301].split()) - 140) <= 2 and left[100].split() == []
    assert all(len(left[i].split()) == 150 for i in range(60))


def test_passages_defined_results(odd, odd_rows, none):
    got = {(r.doc_id, r.source_id) for r in chaining.passages(odd).collect()}
    assert {(5, 4), (6, 4), (None, 4)} <= got and not {d for d, _ in got} & {0, 1, 2, 3, 4, 8, 9}
    cleaned = chaining.remove_passages(odd)
    assert cleaned.schema == odd.schema and cleaned.count() == len(odd_rows)
    assert chaining.passages(none).count() == 0 and chaining.remove_passages(none).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[50]  # a hot vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0] * 3), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, lambda c: c % 25 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 400, 25))
    for q, found in got.items():
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        want = np.lexsort((np.arange(400), -score))[:5]
        assert [v for _, v, _ in found] == want.tolist() and [r for r, _, _ in found] == [1, 2, 3, 4, 5]
    few = ann.nearest(frame.where("vec_id < 3"), lambda c: c >= 0, 5).collect()
    assert len(few) == 6
    assert ann.nearest(frame.where("false"), lambda c: c >= 0, 5).count() == 0


def test_url_filters(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = [(1, "host", "a.example.com", "block", day(10)), (2, "host", "a.example.com", "lift", day(20)), (3, "domain", "example.com", "block", day(5)), (4, "prefix", "a.example.com/ok", "allow", day(0)), (5, "host", "b.test", "block", day(3)), (6, "host", "b.test", "allow", day(3)), (7, None, "x", "block", day(1)), (8, "host", None, "block", day(1))]
    pages = [(1, "http://a.example.com/x", day(12), "block", 1), (2, "http://a.example.com/x", day(22), "block", 3), (3, "http://a.example.com/x", day(2), "pass", None), (4, "https://u@A.Example.com:80/ok/p?q", day(12), "allow", 4), (5, "http://b.test/", day(3), "allow", 6), (6, None, day(3), "pass", None), (7, "http://b.test", None, "pass", None), (8, "nonsense", day(9), "pass", None), (9, "http://notexample.com/", day(9), "pass", None), (9, "http://notexample.com/", day(9), "pass", None), (None, "http://x.example.com", day(40), "block", 3)]
    captures = spark.createDataFrame([(*p[:3], "extra") for p in pages], "page_id long, url string, fetched_at timestamp_ntz, verdict string")
    listed = spark.createDataFrame(entries, "entry_id long, kind string, pattern string, action string, listed_at timestamp_ntz")
    got = url_filters.filter_urls(captures, listed).select("page_id", "verdict", "entry_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((p[0], p[3], p[4]) for p in pages)
    assert url_filters.filter_urls(captures.where("false"), listed).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(captures, listed.where("false")).collect()} == {"pass"}


def test_forest_recall_on_isotropic_vectors():
    """The hardest case for planes: no direction tells more than another."""
    rng = np.random.default_rng(6)
    x = ann.unit(rng.standard_normal((12_000, 48)))
    forest = ann.Forest(x[:6000], ann.Options(visits=900), len(x))
    leaves = collections.defaultdict(list)
    for keys in forest.route(x):
        for i, k in enumerate(keys.tolist()):
            leaves[k].append(i)
    assert forest.extra == 0 and sum(map(len, leaves.values())) == 8 * len(x)  # every row in one leaf of every tree
    hit = 0
    for q in range(0, 12_000, 300):
        found = {i for k in forest.search(x[q]) for i in leaves.get(k, ())}
        score = x @ x[q]
        score[q] = -2
        hit += len(found & set(np.argsort(-score)[:5].tolist()))
    assert hit / (5 * 40) >= 0.9
    deep = ann.Forest(x[:500], ann.Options(rows_per_leaf=16, visits=900), len(x))
    assert deep.extra > 0 and len(set(deep.route(x)[0].tolist())) > 2 * len(deep.centres[0])
    assert len(deep.search(x[0])) == 900 or len(deep.search(x[0])) == 8 * len(deep.centres[0]) << deep.extra


@pytest.mark.parametrize("crowd", [60_000, 300])
def test_few_visits_lose_no_neighbours(spark, crowd):
    """Opened leaves follow the measured recall, whatever the options begin with; crowded parts are dealt out by salt."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    options = ann.Options(visits=5, sample=800, rows_per_leaf=12, part_rows=250, crowd=crowd)
    got = collections.defaultdict(set)
    for r in ann.nearest(frame, lambda c: c % 50 == 0, 5, options).collect():
        got[r.query_id].add(r.vec_id)
    unit = ann.unit(x.astype(np.float64))
    hit = 0
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hit += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert hit / 600 >= 0.9


def test_margins_order_leaves_as_the_search_does():
    x = ann.unit(np.random.default_rng(3).standard_normal((900, 12)))
    forest = ann.Forest(x[:300], ann.Options(rows_per_leaf=4), len(x))
    forest.visits = 60
    leaves, found = forest.margins(x[0]), forest.search(x[0])
    worth = [leaves[k >> 48][(k >> 24) & 0xFFFFFF, k & 0xFFFFFF] for k in found]
    assert forest.extra > 0 and worth == sorted(np.concatenate([m.ravel() for m in leaves]).tolist(), reverse=True)[:60]


def test_repeated_rows_and_null_ids_cost_one_text(spark):
    """Copies of one row, texts without ids and texts that share an id are told apart by their bytes alone."""
    rng = np.random.default_rng(21)
    text = lambda n: "".join(rng.choice(list("abcdefghij klm"), n).tolist())
    part, lone = text(350), text(900)
    rows = [(1, text(2000))] * 2000 + [(None, part + text(300) + part), (None, lone), (None, text(500)), (7, part + text(100)), (7, text(400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == brute_removed(rows[:2] + rows[2000:], 200) + collections.Counter({(1, 2000, b"", 1): 1998})


def test_repeated_strings_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == brute_removed(rows, 200)


def test_nearest_ties_go_to_the_smaller_id(spark):
    """Forty multiples of one vector, by powers of two and by other factors whose cosines are equal all the same."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((150, 8)).round(3)
    for i in range(40):
        x[51 + i] = x[50] * 2.0 ** (i % 7 - 3)
    axes = np.zeros((41, 8))
    axes[:, 0] = [3.0 + i for i in range(41)]  # parallel to an axis: every factor gives the cosine exactly
    x = np.concatenate([x, axes])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, lambda c: c.isin(50, 150, 170), 5, ann.Options(part_rows=96, crowd=50)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {50: [51, 52, 53, 54, 55], 150: [151, 152, 153, 154, 155], 170: [150, 151, 152, 153, 154]}


def test_common_subsequence_of_any_length():
    rng = np.random.default_rng(9)
    for n, m in ((0, 5), (3, 0), (40, 60), (500, 700)):
        a, b = rng.integers(0, 9, n).astype(np.uint32), rng.integers(0, 9, m).astype(np.uint32)
        row = [0] * (m + 1)
        for x in a.tolist():
            last = 0
            for j in range(m):
                row[j + 1], last = max(row[j + 1], row[j], last + (b[j] == x)), row[j + 1]
        assert chaining._common(a, b) == row[-1]


@pytest.fixture(scope="module")
def hidden(spark):
    """A 60-word passage of documents 10 and 11 whose halves stand in 0 to 5 as well, rows that share an id, and columns named as inner ones are."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows, want = [], []
    for k in range(12):
        p, base = words(60), 100 * k
        rows += [(base + i, words(30) + (p[:42] if i % 2 else p[18:]) + words(30)) for i in range(6)]
        rows += [(base + 10, words(40) + p + words(20)), (base + 11, words(10) + p + words(50))]
        want.append((base + 11, base + 10))
    long, gap = words(40), [words(450), words(450)]
    rows += [(5000 + i, words(20) + long + words(0) + gap[0][: 440 + i] + words(30)) for i in range(2)]
    rows += [(6000, long_ := words(80)), (6000, words(60)), (6001, long_ + words(40)), (6001, words(9))]
    frame = spark.createDataFrame([(d, " ".join(w), "x", i) for i, (d, w) in enumerate(rows)], "doc_id long, text string, cuts string, t int")
    return frame, want


def test_passages_do_not_depend_on_who_came_first(hidden):
    frame, want = hidden
    got = chaining.passages(frame).collect()
    found = {(r.doc_id, r.source_id): r for r in got}
    assert set(want) <= set(found) and all(58 <= found[w].n_words <= 62 for w in want)
    assert (5001, 5000) in found and (6001, 6000) in found
    assert {a for a, _ in found} == {a for a, _ in want} | {5001, 6001}


def test_removal_tells_rows_of_one_id_apart(hidden):
    frame, _ = hidden
    before = {r.t: r.text.split() for r in frame.collect()}
    after = chaining.remove_passages(frame)
    assert after.columns == frame.columns
    for r in after.collect():
        lost = len(before[r.t]) - len(r.text.split())
        assert r.cuts == "x" and (lost == 80 if r.doc_id == 6001 and len(before[r.t]) > 100 else 58 <= lost <= 62 if r.doc_id < 5000 and r.doc_id % 100 == 11 else lost > 400 if r.doc_id == 5001 else lost == 0)
