import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymark.llm import bpe, cotraining, kernels, packing, quality_rules, sharding
from tallymark.llm.queries import packed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules_counts_and_defined_results(spark, odd, odd_rows, none, labels):
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(odd_rows)
    by_id = {r[0]: r[1] for r in odd_rows}
    for r in got:
        n = brute_stats(by_id[r.doc_id])
        assert n == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none, labels).count() == 0
    bare = quality_rules.quality_rules(odd, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) and r.p_good is None for r in bare)
    assert quality_rules.keep_rows(odd, labels).columns == odd.columns


@pytest.mark.parametrize("sf, model, most_bad", [("sf0.01", quality_rules.quality_rules, 0.2), ("sf0.1", cotraining.classify, 0.1)])
def test_quality_models_on_held_out_labels(spark, sf, model, most_bad):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    fitted, rest = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    got = model(docs, fitted).join(rest, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < most_bad


def test_cotraining_exchanges_pseudo_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = cotraining.fit(docs, labels)
    assert model["handed"] > 0 and (model["mix"][:2] >= 0).all()


def test_cotraining_defined_results(odd, odd_rows, none, labels):
    assert cotraining.classify(odd, labels).count() == len(odd_rows)
    assert all(r.kept and r.p_quality is None for r in cotraining.classify(odd, labels.where("false")).collect())
    assert cotraining.classify(none, labels).count() == 0
    assert cotraining.keep_rows(odd, labels).schema == odd.schema


def test_codec_equals_the_library(odd, odd_rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = {r[0]: r[1] or "" for r in odd_rows}
    got = bpe.encode_decode(odd, path).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        ids = whole.encode(texts[r.doc_id] if r.doc_id is not None else odd_rows[-1][1], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == whole.decode(ids, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.encode_decode(odd, path, digest=True).collect()}
    assert digest[9].ids_sha256 == hashlib.sha256(np.array(whole.encode(texts[9], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(none, path).count() == 0


@pytest.mark.parametrize("leaf", [8, 40, 500])
def test_tree_concatenation_is_exact(leaf):
    tokenizer = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(leaf)
    parts = ["a", "b", "th", "the", "é", "'s", "'", "1", "..", "😀", "ing", "́", "Q", "你", "&&"]
    for _ in range(60):
        text = "".join(rng.choice(parts, rng.integers(20, 400)))
        assert bpe.encode_long(tokenizer, text, leaf) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [4, 16, 100])
def test_halves_of_texts_are_joined_exactly(leaf):
    """Whole texts cut anywhere: inside words, contractions, special tokens, characters' neighbours and white space."""
    path = public_tokenizers.path("word_bpe_49k.json")
    codec, whole = bpe.Codec(path, leaf), Tokenizer.from_file(path)
    rng = np.random.default_rng(leaf)
    pieces = ["a", "the ", " ", "isn't", "it's ", "É", "ü", "12", "3.5", "...", "😀", "<|endoftext|>", "\n", "\t", "你好", "́", "Running ", "x", "'", "&&", "unbelievable "]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 120))) for _ in range(120)] + ["", " ", "x" * 700, "ab1'" * 200]
    raw = [t.encode() for t in texts]
    got = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert codec.joins > 100
    for t, (ids, text) in zip(texts, got, strict=True):
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text.decode() == whole.decode(want, skip_special_tokens=False)


def test_the_tree_serves_the_tables(spark):
    """Production leaves: texts of the table that are over 8 KB are halved, joined, and equal the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("octet_length(text) > 8192").collect()]
    codec, whole = bpe.Codec(path), Tokenizer.from_file(path)
    raw = [t.encode() for t in docs]
    got = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert len(docs) > 20 and codec.joins >= len(docs)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == [e.ids for e in whole.encode_batch(docs, add_special_tokens=False)]


def test_packing_is_whole_gapless_and_tight(spark, odd, odd_rows, none):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in odd_rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        head, at, j = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            end = head + j * 1024
            want[(r[0], j, at, end - at, zlib.crc32(ids[at:end].tobytes()))] += 1
            at, j = end, j + 1
    rows = packed(odd).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packed(none).count() == 0


def test_endless_white_space_is_packed_exactly(spark):
    text = "a" + " " * 1_200_000 + "b"
    rows = packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_ids=True).orderBy("piece").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [i for r in rows for i in r.ids] == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 101, 60)
        histogram = dict(collections.Counter(sizes.tolist()))
        before = packing.best_fit(histogram, 100)
        squares = sum(b.fill**2 * b.count for b in before)
        n = sum(b.count for b in before)
        after = packing.local_search(before, 100)
        assert sum(b.count for b in after) <= n and sum(b.fill**2 * b.count for b in after) >= squares
        total = collections.Counter()
        for b in after:
            assert b.fill <= 100
            for k, v in b.items.items():
                total[k] += v * b.count
        assert total == collections.Counter(sizes.tolist())
    assert packing.exchange(collections.Counter([5, 3]), collections.Counter([7]), 1) == ([3, 5], [7])
    assert packing.exchange(collections.Counter([9]), collections.Counter([7]), 2) == ([9], [7])


def best_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, fill = (lo + hi) // 2, 1, 0
        for s in sizes:
            used, fill = (used + 1, s) if fill + s > mid else (used, fill + s)
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


def test_minimax_cuts_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for n, shards in ((1, 4), (30, 4), (200, 7), (5, 40)):
        sizes = rng.integers(1, 50, n).tolist()
        capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(list(enumerate(sizes)), "block long, bytes long"), shards)
        assert capacity == best_capacity(sizes, shards)
        edges = [0, *cuts, n]
        assert len(edges) <= shards + 1 and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False)) <= capacity


def test_sharding_slots_groups_and_defined_results(odd, odd_rows, none):
    rows = sharding.shard_by_bytes(odd, 5).collect()
    assert len(rows) == len(odd_rows)
    sizes = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == sizes
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.text_crc32].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    assert sharding.shard_by_bytes(none, 5).count() == 0


def test_shingles_of_short_texts():
    raw = [b"", b"One", b"one two", b"a a a a", b"  b  "]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    sets, at = kernels.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, 2)
    assert np.diff(at).tolist() == [0, 1, 1, 1, 1] and len(set(sets.tolist())) == 4
