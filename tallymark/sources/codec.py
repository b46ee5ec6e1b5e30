"""The exchange format of a sketch: big-endian header (magic, size, mapper version, seed), then four channels of 64-bit words."""

from __future__ import annotations

import base64
import struct

import numpy as np

from ..functions.hashing import MAPPER_VERSION

MAGIC = 0x49425333
HEADER = struct.Struct(">IiiQ")


def encode(view: np.ndarray, seed: int) -> bytes:
    """Bytes of a 4 x M sketch."""
    return HEADER.pack(MAGIC, view.shape[1], MAPPER_VERSION, seed & (1 << 64) - 1) + view.astype(">u8").tobytes()


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """(4 x M sketch, seed); refuses another format, another mapper or a wrong length."""
    magic, cells, version, seed = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError(f"not a sketch: magic {magic:#x}")
    if version != MAPPER_VERSION:
        raise ValueError(f"mapper version {version}, expected {MAPPER_VERSION}")
    if cells < 4 or len(raw) != HEADER.size + 32 * cells:
        raise ValueError("the sketch's length does not fit its size")
    return np.frombuffer(raw, ">u8", 4 * cells, HEADER.size).reshape(4, cells).astype(np.uint64), seed


def to_text(view: np.ndarray, seed: int) -> str:
    return base64.b64encode(encode(view, seed)).decode()


def from_text(text: str) -> tuple[np.ndarray, int]:
    return decode(base64.b64decode(text))
