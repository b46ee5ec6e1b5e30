"""Exact BPE encoding and decoding of whole texts by tree concatenation.

A text of more than ``LEAF_BYTES`` is halved, wherever the middle falls, until its parts are short enough; all leaves of a slice
of texts are encoded side by side, as texts of their own. Then, around every join, a window that begins some units before it and
ends some after it is encoded again, and doubled until its first and last units come out as the two halves have them; what lies
between these replaces the units there. Two adjacent tokens of one valid encoding stay valid neighbours, so a window that agrees
on both sides gives exactly the encoding of the whole.

Within a leaf the vocabulary drops white space, so ASCII white space is an exact cut, and most words can be encoded pre-token by
pre-token; these units repeat, and a worker remembers the ids of those it has met, up to ``MEMO_BYTES``. A unit of over ``LONG``
bytes is a tree again, token by token (``encode_long``). Decoding looks the tokens' strings up by id, for a whole slice at once.

One scan, no shuffle. Defined results: a null text is an empty one (no ids, empty decoded text); very long texts, with or without
white space, go through the tree; repeated rows are each encoded; ids are returned as they are; an empty table gives an empty
result; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LEAF, LONG, LEAF_BYTES = 1024, 4096, 8192
MEMO_BYTES, MEMO_ENTRY = 32 << 20, 190  # an entry's objects and its place in the dictionary, besides its bytes
SLICE_BYTES = 3 << 19  # more words share a look-up in a longer slice
Token = tuple[int, int, int]
_tokenizers: dict[str, object] = {}


def load(path: str):
    """The tokenizer without truncation and padding; one per Python worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def _tokens(encoding, base: int) -> list[Token]:
    return [(i, base + a, base + b) for i, (a, b) in zip(encoding.ids, encoding.offsets, strict=True)]


def _join(tokenizer, text: str, left: list[Token], right: list[Token], lo: int, hi: int) -> list[Token]:
    """Tokens of text[lo:hi] from those of its two halves."""
    width = 8
    while True:
        a, b = max(0, len(left) - width), min(len(right), width)
        while a > 0 and left[a][1] < left[a - 1][2]:  # never start inside a character
            a -= 1
        while 0 < b < len(right) and right[b][1] < right[b - 1][2]:
            b += 1
        start, end = (left[a][1] if a else lo), (right[b][1] if b < len(right) else hi)
        window = _tokens(tokenizer.encode(text[start:end], add_special_tokens=False), start)
        good_left = a == 0 or window[:2] == left[a : a + 2]
        if good_left and b == len(right):
            return left[:a] + window
        if good_left:
            at = {t: k for k, t in enumerate(right[:b])}
            for j in range(len(window) - 3, 0, -1):  # the window's own end is not an end of the text
                k = at.get(window[j])
                if k is not None and k + 1 < len(right) and window[j + 1] == right[k + 1] and (k == 0 or right[k][1] >= right[k - 1][2]):
                    return left[:a] + window[:j] + right[k:]
        if a == 0 and b == len(right):
            return window
        width *= 2


def encode_long(tokenizer, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text by tree concatenation."""
    spans = [(0, len(text))]
    while spans[0][1] - spans[0][0] > leaf or spans[-1][1] - spans[-1][0] > leaf:
        spans = [half for lo, hi in spans for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)) if half[0] < half[1]]
    parts = [(lo, hi, _tokens(e, lo)) for (lo, hi), e in zip(spans, tokenizer.encode_batch([text[lo:hi] for lo, hi in spans], add_special_tokens=False), strict=True)]
    while len(parts) > 1:
        joined = [(a[0], b[1], _join(tokenizer, text, a[2], b[2], a[0], b[1])) for a, b in zip(parts[0::2], parts[1::2], strict=False)]
        parts = joined + parts[len(joined) * 2 :]
    return [t[0] for t in parts[0][2]]


LETTER, DIGIT, MARK, ODD = 1, 2, 3, 9
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x27] = ODD  # an apostrophe may open a contraction


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of what can be encoded on its own.

    Words of ASCII and Latin-1 letters, digits and marks are lower-cased and cut where the vocabulary's pre-tokenizer cuts
    them: into runs of letters, single digits and runs of marks. Any other word is one unit, left as it is.
    """
    starts, ends, _ = K.word_spans(buf, off)
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] & 0xC0 == 0x80) & (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    special = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    kind[special] = ODD
    odd_before = np.append(0, np.cumsum(kind == ODD))
    odd = odd_before[ends] > odd_before[starts]
    folded = K.LOWER[buf]
    upper = lead[folded[lead + 1] <= 0x9E] + 1
    folded[upper] += 0x20
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    owner, at = K.runs((ends - starts)[odd])
    whole = starts[odd][owner] + at
    folded[whole] = buf[whole]
    cut[whole] = False
    cut[starts] = True
    inside = ~K.WHITE[buf]
    begin = np.flatnonzero(cut[:-1] & inside)
    stop = np.append(begin[1:], len(buf))
    return folded, begin, np.minimum(stop, ends[np.searchsorted(starts, begin, "right") - 1]) if len(begin) else stop[:0]


def halves(buf: np.ndarray, off: np.ndarray, leaf: int, whole: list[bytes]) -> np.ndarray:
    """Where the texts of a slice are halved until no part is over `leaf` bytes; never inside a character or a string of `whole`.

    Those are the vocabulary's added tokens, which are matched before anything else: a window can end inside one without a sign.
    """
    reach = max(map(len, whole), default=1)
    out = []
    for i in np.flatnonzero(np.diff(off) > leaf).tolist():
        size = int(off[i + 1] - off[i])
        parts = 1 << (-(-size // leaf) - 1).bit_length()
        for j in range(1, parts):
            at = int(off[i]) + size * j // parts
            while at < off[i + 1] and buf[at] & 0xC0 == 0x80:
                at += 1
            near, inside = max(int(off[i]), at - reach + 1), True
            while inside:  # past an added token, and past one that this step may have led into
                around = buf[near : min(int(off[i + 1]), at + reach)].tobytes().lower()
                ends = [k + near + len(w) for w in whole for k in range(max(0, at - near - len(w) + 1), at - near) if around.startswith(w, k)]
                inside = bool(ends)
                at = max(ends, default=at)
                near = max(near, at - reach + 1)
            if at < off[i + 1]:
                out.append(at)
    return np.array(sorted(set(out)), np.int64)


class Codec:
    """Encodes texts leaf by leaf and unit by unit, and decodes as the tokenizer's decode of all ids does: token strings joined by spaces."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES):
        self.tokenizer = load(path)
        if self.tokenizer.decoder is not None:
            raise ValueError("decoding by token needs a vocabulary without a decoder")
        strings = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.strings = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.leaf, self.joins = leaf, 0
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct units, as 32-bit integers; short ones are remembered."""
        if self.held > MEMO_BYTES:
            self.ids, self.held = {}, 0
        known = self.ids
        new = [w for w in words if w not in known]
        short = [w for w in new if len(w) <= LONG]
        for w, e in zip(short, self.tokenizer.encode_batch([w.decode() for w in short], add_special_tokens=False), strict=True):
            known[w] = ids = array("I", e.ids).tobytes()
            self.held += len(w) + len(ids) + MEMO_ENTRY
        if len(short) == len(new):
            return [known[w] for w in words]
        long = {w: array("I", encode_long(self.tokenizer, w.decode())).tobytes() for w in new if len(w) > LONG}
        return [long[w] if len(w) > LONG else known[w] for w in words]

    def _window(self, text: bytes, head: tuple[bytes, bytes] | None, tail: tuple[bytes, bytes] | None) -> bytes | None:
        """Ids between the window's first and last unit (bytes, ids), None if it does not agree with one of them; no unit, no claim."""
        if head is None and tail is None and len(text) > LONG:
            return array("I", encode_long(self.tokenizer, text.decode())).tobytes()
        got = self.tokenizer.encode(text.decode(), add_special_tokens=False)
        ids, a, b = array("I", got.ids).tobytes(), 0, len(got.ids)
        if head is not None:
            a = len(head[1]) // 4
            if ids[: 4 * a] != head[1] or (a < b and got.offsets[a][0] < len(head[0].decode())):
                return None
        if tail is not None:
            b -= len(tail[1]) // 4
            if b < a or ids[4 * b :] != tail[1] or (b > 0 and got.offsets[b - 1][1] > len(text.decode()) - len(tail[0].decode())):
                return None
        return ids[4 * a : 4 * b]

    def _join(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, ids_of, cut: int, lo: int, hi: int, segments: dict[int, tuple[int, bytes]]) -> None:
        """Encode again around one cut among the units lo..hi of a text; segments hold (end, ids) of units replaced, by their first."""
        self.joins += 1
        at, width = int(np.searchsorted(starts, cut)), 2
        while True:
            p, q = max(lo, at - width), min(hi, at + width)
            for a, (b, _) in segments.items():  # never begin or end inside what another join replaced
                if a < p < b or p == a:
                    p = max(lo, a - 1)
                if a < q < b or q == b:
                    q = min(hi, b + 1)
            if p >= q:
                return
            unit = lambda j: (raw[starts[j] : ends[j]], ids_of(j))
            head = unit(p) if p > lo and p not in segments else None
            tail = unit(q - 1) if q < hi and not any(a <= q - 1 < b for a, (b, _) in segments.items()) else None
            if (p > lo and head is None) or (q < hi and tail is None):
                width *= 2
                continue
            a, b = p + (head is not None), q - (tail is not None)
            got = self._window(raw[starts[p] : ends[q - 1]], head, tail) if a < b else None
            if got is not None:
                for k in [k for k in segments if a <= k < b]:
                    del segments[k]
                segments[a] = (b, got)
                return
            width *= 2

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each UTF-8 text of a slice.

        The slice's distinct units are encoded, or remembered; what they gave is then gathered for all units at once.
        """
        cuts = halves(buf, off, self.leaf, self.added)
        buf, starts, ends = units(buf, np.union1d(off, cuts))
        _, index, which = np.unique(K.span_hash(K.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        parts = self._ids([raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
        if len(cuts):
            first = np.searchsorted(starts, off)
            keep, whose = np.ones(len(starts), bool), np.searchsorted(off, cuts, "right") - 1
            for i in np.unique(whose).tolist():
                segments: dict[int, tuple[int, bytes]] = {}
                mine = cuts[whose == i].tolist()
                step = 1
                while step <= len(mine):  # neighbouring leaves first, then what they make
                    for j in range(step - 1, len(mine), 2 * step):
                        self._join(raw, starts, ends, lambda u: parts[which[u]], mine[j], int(first[i]), int(first[i + 1]), segments)
                    step *= 2
                for a, (b, ids) in segments.items():
                    keep[a + 1 : b] = False
                    which[a] = len(parts)
                    parts.append(ids)
            which, starts = which[keep], starts[keep]
        ids, at = _gather(parts, which, np.searchsorted(starts, off))
        sizes = self.sizes[ids]
        upto = np.append(0, np.cumsum(sizes))
        text = self.strings[np.repeat(self.begin[ids] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        ids_raw, ends_at = ids.tobytes(), upto[at]
        return [(ids_raw[4 * at[i] : 4 * at[i + 1]], text[ends_at[i] : max(ends_at[i + 1] - 1, ends_at[i])]) for i in range(len(off) - 1)]


def _gather(parts: list[bytes], which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts that `which` names, end to end, and where those of each text begin; its units begin at `first`."""
    flat = np.frombuffer(b"".join(parts), np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64) // 4
    begin = np.cumsum(sizes) - sizes
    counts = sizes[which]
    at = np.append(0, np.cumsum(counts))
    shift = np.repeat(begin[which] - at[:-1], counts)
    return flat[shift + np.arange(len(shift))], at[first]


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """One codec, with its memory of words, per Python worker; a worker serves many tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and decoded text of every document; with digest, their count and SHA-256 only."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")

    K.small_batches(docs.sparkSession)

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for lo, hi, buf, off in K.text_slices(batch, limit=SLICE_BYTES):
                got = codec.encode(buf, off)
                n = pa.array([len(i) // 4 for i, _ in got], pa.int64())
                if digest:
                    cols = [pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])]
                else:
                    cols = [pa.array([i for i, _ in got], pa.binary()), pa.array([d.decode() for _, d in got])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, *cols], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
