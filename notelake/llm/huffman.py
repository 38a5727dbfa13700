"""Canonical length-limited Huffman codes over integers, with vectorised packing and table-driven decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import U64, ranges

#: Ids between two bit-offset checkpoints; every such segment is decoded on its own.
SEGMENT = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for symbols with the given positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("too many symbols for this limit")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    is_leaf, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        kind = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        at = np.argsort(both, kind="stable")
        both, kind = both[at], kind[at]
        is_leaf.append(kind)
        half = len(both) // 2 * 2
        packages = both[:half].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(is_leaf):
        leaves = int(kind[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Symbols in ascending order and their code lengths; the codes themselves follow canonically."""

    symbols: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        self.limit = int(self.lengths.max(initial=1))
        order = np.lexsort((self.symbols, self.lengths))
        self.sorted_lengths, self.sorted_symbols = self.lengths[order], self.symbols[order]
        # in units of the longest code each code takes 2^(limit - length), so canonical codes are running sums
        width = 1 << (self.limit - self.sorted_lengths)
        left = np.cumsum(width) - width
        self.codes = np.zeros(int(self.symbols.max(initial=0)) + 1, np.uint64)
        self.bits = np.zeros(len(self.codes), np.int64)
        self.codes[self.sorted_symbols] = (left >> (self.limit - self.sorted_lengths)).astype(U64)
        self.bits[self.sorted_symbols] = self.sorted_lengths
        self._table = None

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray, limit: int) -> Code:
        order = np.argsort(symbols)
        return Code(symbols[order].astype(np.int64), code_lengths(counts[order], limit))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for every value of the next ``limit`` bits."""
        if self._table is None:
            width = 1 << (self.limit - self.sorted_lengths)
            symbol, length = np.repeat(self.sorted_symbols, width), np.repeat(self.sorted_lengths, width)
            rest = (1 << self.limit) - len(symbol)
            self._table = np.append(symbol, np.zeros(rest, np.int64)).astype(np.uint32), np.append(length, np.ones(rest, np.int64)).astype(np.int64)
        return self._table

    def pack(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of texts of so many ids each, every text from a whole byte on.

        Returns all bytes, the bytes of each text, and the bit length of each segment of SEGMENT ids of a text.
        """
        n = self.bits[ids]
        ends = np.cumsum(n)
        last = np.cumsum(counts)
        bits = np.diff(np.append(0, np.append(0, ends)[last]))
        size = bits + 7 >> 3
        shift = 8 * (np.cumsum(size) - size) - (np.cumsum(bits) - bits)
        at = ends - n + np.repeat(shift, counts)
        word = at >> 5
        # a code of at most 32 bits lies in two 32-bit words: put it in a 64-bit frame that opens at its word
        frame = self.codes[ids] << (U64(64) - (at & 31).astype(U64) - n.astype(U64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(ids) else np.zeros(0, np.int64)
        total = int(size.sum())
        out = np.zeros((total + 3 >> 2) + 1, np.uint32)
        if len(ids):
            merged = np.bitwise_or.reduceat(frame, first)
            out[word[first]] = (merged >> U64(32)).astype(np.uint32)
            out[word[first] + 1] |= (merged & U64(0xFFFFFFFF)).astype(np.uint32)
        pieces = -(-counts // SEGMENT)
        starts = np.repeat(last - counts, pieces) + ranges(pieces) * SEGMENT
        segments = np.add.reduceat(n, starts) if len(starts) else n[:0]
        return out.astype(">u4").view(np.uint8)[:total], size, segments.astype(np.uint16)

    def unpack(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of segments that begin at the given bits: one table look-up for each id, all segments in step."""
        symbol, length = self.table()
        data = np.append(data, np.zeros(8, np.uint8)).astype(U64)
        # the 32 bits from each byte on hold a whole code of up to 25 bits, wherever in the byte it starts
        quad = ((data[:-3] << U64(24)) | (data[1:-2] << U64(16)) | (data[2:-1] << U64(8)) | data[3:]).astype(np.uint32)
        order = np.argsort(-counts, kind="stable")
        at, live = starts[order].astype(np.int64), counts[order]
        out = np.zeros((int(counts.max(initial=0)), len(counts)), np.uint32)
        shift = 32 - self.limit
        for k in range(len(out)):
            m = int(np.searchsorted(-live, -k, side="left"))  # segments with more than k ids
            p = at[:m]
            v = (quad[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(shift)
            out[k, :m] = symbol[v]
            at[:m] = p + length[v]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        column = np.repeat(back, counts)
        return out[ranges(counts), column]
