"""Majority-vote fingerprints of hashed terms."""

from __future__ import annotations

import numpy as np
import xxhash


def vote(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """64-bit fingerprint: a bit is set if the hashes that have it hold over half of the weight."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    if weights is None:
        # Sums of up to 255 rows fit a byte each.
        held = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total = len(hashes)
    else:
        held, total = weights.astype(np.float64) @ bits, weights.sum()
    return int.from_bytes(np.packbits(2 * held > total).tobytes(), "big")


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``words``-word shingle, A-Z in lower case, joined by single spaces.

    Words are runs of bytes other than space and 0x09-0x0D. Fewer words than asked for make one
    shingle of them all; no word makes none. Repeats count.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - words + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Fingerprint of a whole text over its word shingles; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    return vote(hashes) if len(hashes) else 0


def signed(value: int) -> int:
    """The same 64 bits as a signed number, as Spark's long holds them."""
    return value - (1 << 64) if value >> 63 else value
