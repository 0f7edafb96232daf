"""Sequences as packed bases, for the operators on contigs; the coding of words is the core's."""

from __future__ import annotations

import numpy as np

from strandloom.functions.codes import clean, codes, mixed, words

__all__ = ["clean", "codes", "mixed", "pack", "unpack", "words"]


#: The four codes of every byte.
_FOUR = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint64)


def pack(v: np.ndarray) -> bytes:
    """Codes of bases as bytes: their number, four bases a byte, and the runs of undetermined ones (start and length)."""
    n = len(v)
    two = np.zeros(-(-n // 4) * 4, np.uint8)
    two[:n] = v & np.uint64(3)
    four = (two[0::4] << 6) | (two[1::4] << 4) | (two[2::4] << 2) | two[3::4]
    bad = np.flatnonzero(np.diff(np.concatenate([[0], (v == 4).astype(np.int8), [0]])))
    return np.array([n], np.int64).tobytes() + four.tobytes() + bad.astype(np.int64).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The codes that `pack` was given."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    size = -(-n // 4)
    four = np.frombuffer(blob, np.uint8, size, 8)
    v = _FOUR[four].ravel()[:n]
    edges = np.frombuffer(blob, np.int64, -1, 8 + size) if len(blob) > 8 + size else np.zeros(0, np.int64)
    for a, b in edges.reshape(-1, 2):
        v[a:b] = 4
    return v
