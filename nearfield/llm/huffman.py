"""Canonical length-limited Huffman code for integer symbols, as numpy arrays; no Spark here.

Codes are at most ``limit`` bits. A block is a bit string of whole codes, most significant bit first, with the bit
offset of every ``STRIDE``-th symbol kept beside it, so that a block is decoded by one table lookup per step for all
checkpoints at once.
"""

from __future__ import annotations

import numpy as np

STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths (uint8, 0 for absent symbols) of at most ``limit`` bits, by package-merge.

    The limit rises to what the number of symbols needs. One symbol gets one bit.
    """
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    n = len(present)
    if n == 0:
        return lengths
    if n == 1:
        lengths[present] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    taken, steps = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        steps[:own] += 1
        taken = 2 * (taken - own)
    steps[:taken] += 1
    lengths[order] = steps
    return lengths


class Code:
    """Tables of one canonical code, built from the lengths alone."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max(initial=0)))
        present = np.flatnonzero(lengths)
        order = present[np.lexsort((present, lengths[present]))]
        spans = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.left = np.zeros(len(lengths), np.uint32)  # codes, moved to the left of `bits` bits
        self.left[order] = np.cumsum(spans) - spans
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.length = np.zeros(1 << self.bits, np.uint8)
        self.length[: spans.sum()] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offsets of the checkpoints (uint64)."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        ends = np.cumsum(self.lengths[ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        window = (self.left[ids] << np.uint32(32 - self.bits)) >> (starts & 7).astype(np.uint32)
        at, size = starts >> 3, (int(ends[-1]) + 7) // 8
        out = np.zeros(size + 4)
        for k in range((self.bits + 14) // 8):
            out += np.bincount(at + k, weights=(window >> np.uint32(24 - 8 * k)) & np.uint32(255), minlength=size + 4)
        return out[:size].astype(np.uint8).tobytes(), starts[::STRIDE].astype(np.uint64)

    def decode(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` symbols (uint32) of a block."""
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.empty((STRIDE, len(offsets)), np.uint32)
        at, shift, mask, last = offsets.astype(np.int64), 32 - self.bits, (1 << self.bits) - 1, len(window) - 1
        for step in range(STRIDE):
            key = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32)) & np.uint32(mask)
            out[step] = self.symbol[key]
            at += self.length[key]
        return out.T.reshape(-1)[:n]
