"""The 64-bit mixer, cell positions, checksum and key id: numpy forms for Arrow batches and column forms for pure plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
K = 3
MAPPER_VERSION = 2
FP_MASK = (1 << 56) - 1
# Fixed values that both sides of a comparison must share.
MUL1 = 0xBF58476D1CE4E5B9
MUL2 = 0x94D049BB133111EB
BUCKET_SEEDS = (0xA1B2C3D4E5F60718, 0x1234567890ABCDEF, 0xFEDCBA9876543210)
CHECKSUM_SEED = 0x9E3779B97F4A7C15
RETRY_STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def sm64(x: np.ndarray) -> np.ndarray:
    """Two xor-shift-multiply rounds, without a pre-increment: 0 stays 0."""
    x = np.asarray(x, U64).copy()
    for shift, mul in ((30, MUL1), (27, MUL2)):
        x ^= x >> U64(shift)
        x *= U64(mul)
    return x ^ (x >> U64(31))


def _sm(x: int) -> int:
    return int(sm64(np.array([x & MASK], U64))[0])


def checksum(fp: np.ndarray) -> np.ndarray:
    return sm64(np.asarray(fp, U64) + U64(CHECKSUM_SEED))


def seeds(hash_seed: int) -> tuple[int, ...]:
    return BUCKET_SEEDS if hash_seed == 0 else tuple(_sm(b ^ (hash_seed & MASK)) for b in BUCKET_SEEDS)


def positions(fp: np.ndarray, cells: int, hash_seed: int = 0) -> np.ndarray:
    """Three distinct cells per fingerprint; a stream that meets an earlier cell steps on until it does not."""
    if cells <= K:
        raise ValueError(f"a sketch needs more than {K} cells")
    fp = np.asarray(fp, U64)
    out = np.empty((len(fp), K), np.int64)
    for i, base in enumerate(seeds(hash_seed)):
        salted = fp + U64(base)
        out[:, i] = (sm64(salted) % U64(cells)).astype(np.int64)
        clash = (out[:, :i] == out[:, i : i + 1]).any(1)
        while clash.any():
            salted[clash] += U64(RETRY_STEP)
            out[clash, i] = (sm64(salted[clash]) % U64(cells)).astype(np.int64)
            clash = (out[:, :i] == out[:, i : i + 1]).any(1)
    return out


def cheap_id(raw: bytes) -> int:
    """56-bit id of encoded key bytes: 8-byte big-endian chunks chained through the mixer, the tail always mixed."""
    h, n = CHECKSUM_SEED, len(raw) // 8 * 8
    for i in range(0, n, 8):
        h = _sm(h ^ int.from_bytes(raw[i : i + 8], "big"))
    return _sm(h ^ int.from_bytes(raw[n:], "big")) & FP_MASK


def cheap_ids(rows: list[bytes]) -> np.ndarray:
    """cheap_id of many keys; keys of one length are chained together."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros(len(rows), U64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        n = int(size) // 8 * 8
        grid = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), int(size))
        h = np.full(len(at), U64(CHECKSUM_SEED))
        for i in range(0, n, 8):
            h = sm64(h ^ np.ascontiguousarray(grid[:, i : i + 8]).view(">u8").ravel().astype(U64))
        tail = np.zeros(len(at), U64)
        for i in range(n, int(size)):
            tail = (tail << U64(8)) | grid[:, i].astype(U64)
        out[at] = sm64(h ^ tail)
    return (out & U64(FP_MASK)).astype(np.int64)


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(x: Column, constant: int) -> Column:
    """x * constant modulo 2^64 on signed longs: by 32-bit halves of x and 16-bit limbs of the constant, no product overflows."""
    c = [F.lit((constant >> (16 * k)) & 0xFFFF).cast("long") for k in range(4)]
    word = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    limb = lambda v: F.shiftleft(v.bitwiseAND(F.lit(0xFFFF)), 16)
    low, high = word(x), F.shiftrightunsigned(x, 32)
    p0, p1 = low * c[0], low * c[1]
    bottom = word(p0) + limb(p1)
    cross = low * c[2] + limb(low * c[3]) + high * c[0] + limb(high * c[1])
    top = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(bottom, 32) + cross
    return F.shiftleft(word(top), 32).bitwiseOR(word(bottom))


def add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64 on signed longs, by halves, so that it cannot overflow under ANSI arithmetic."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def sm64_column(x: Column) -> Column:
    """The mixer as an expression on signed longs (bit patterns of unsigned ones)."""

    def folded(v: Column, shift: int) -> Column:
        return bind(v, lambda w: w.bitwiseXOR(F.shiftrightunsigned(w, shift)))

    for shift, mul in ((30, MUL1), (27, MUL2)):
        x = _bound_times(folded(x, shift), mul)
    return folded(x, 31)


def _bound_times(x: Column, constant: int) -> Column:
    return bind(x, lambda w: _times(w, constant))


def unsigned_mod(h: Column, m: int) -> Column:
    """Remainder of the unsigned value of a signed long."""
    half = F.pmod(F.shiftrightunsigned(h, 1), F.lit(m).cast("long"))
    return F.pmod(half * 2 + h.bitwiseAND(F.lit(1)), F.lit(m).cast("long"))


def literal(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")
