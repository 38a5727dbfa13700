"""Words of whole texts as spans and 64-bit hashes, in numpy: no object is made for a word.

A word is a run of bytes other than the six ASCII white spaces (or than those that ``space`` marks, line ends among them).
Its hash takes eight bytes at a time through a bijective finaliser that is not linear, so words of up to eight bytes
differ in their hashes but for their length's part, and no family of words is known to collide. Words beyond ``LONG``
bytes are hashed whole by XXH3.
"""

from __future__ import annotations

import numpy as np

from .common import U64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z become a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] = np.arange(97, 123)
#: Bytes that are looked at together, and the longest word that is hashed by eights.
PIECE, LONG = 1 << 20, 256
LENGTH, STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def finish(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of x moves about half of the bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """``buffer`` has all texts, each with a line end behind it; ``start`` and ``end`` are places in it, ``lens`` words for each text."""

    def __init__(self, docs: list[bytes], *, fold: bool = False, space: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
        #: Of each text, its bytes with the line end, and where that ends in the buffer.
        self.sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
        self.borders = np.cumsum(self.sizes)
        n = int(self.borders[-1]) if len(docs) else 0
        flat = np.frombuffer(b"\n".join([*docs, bytes(16 + -n % 8)]), np.uint8)
        if fold:
            flat = FOLDED[flat]
        self._eights = flat[: len(flat) // 8 * 8].view("<u8")
        self.buffer = flat[:n]
        edges, was = [], True
        for at in range(0, n, PIECE):
            blank = space[self.buffer[at : at + PIECE]]
            edges.append(at + np.flatnonzero(blank != np.append(was, blank[:-1])))
            was = bool(blank[-1])
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = np.zeros(len(self.start), U64)
        #: Hashes of words' first bytes, 0 for shorter words.
        self.heads = [np.zeros(len(self.start), U64) for _ in prefixes]
        for low in range(0, len(self.start), PIECE // 8):
            some = slice(low, low + PIECE // 8)
            self._hash(some, prefixes)
        self.lens = np.diff(np.append(0, np.searchsorted(self.start, self.borders)))

    def trim(self, marks: np.ndarray, strip: bytes) -> Words:
        """Take marked bytes off both ends of each word; what is left empty is no word. ``strip`` has the marked bytes."""
        start, end = self.start.copy(), self.end.copy()
        for _ in range(64):
            low = np.flatnonzero((start < end) & marks[self.buffer[np.minimum(start, len(self.buffer) - 1)]]) if len(start) else start
            high = np.flatnonzero((start < end) & marks[self.buffer[np.maximum(end - 1, 0)]]) if len(start) else start
            if not len(low) and not len(high):
                break
            start[low] += 1
            end[high] = np.maximum(end[high] - 1, start[high])
        else:  # longer runs of marks than words have
            for i in np.union1d(low, high).tolist():
                word = self.buffer[start[i] : end[i]].tobytes()
                start[i] += len(word) - len(word.lstrip(strip))
                end[i] = start[i] + len(word.strip(strip))
        left = start < end
        of = np.repeat(np.arange(len(self.lens)), self.lens)[left]
        self.start, self.end, self.lens = start[left], end[left], np.bincount(of, minlength=len(self.lens))
        self.hash, self.heads = np.zeros(len(self.start), U64), []
        for low in range(0, len(self.start), PIECE // 8):
            self._hash(slice(low, low + PIECE // 8), ())
        return self

    def eight(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first min(size, 8) bytes from each place on, as numbers."""
        word, shift = at >> 3, ((at & 7) << 3).astype(U64)
        got = (self._eights[word] >> shift) | ((self._eights[word + 1] << U64(1)) << (U64(63) - shift))
        return got & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (np.minimum(size, 8) << 3).astype(U64)))

    def _hash(self, some: slice, prefixes: tuple[int, ...]) -> None:
        start, size = self.start[some], self.end[some] - self.start[some]
        head = self.eight(start, size)
        h = finish(head + size.astype(U64) * LENGTH)
        for n, out in zip(prefixes, self.heads):
            out[some] = np.where(size >= n, finish((head & U64((1 << 8 * n) - 1)) + U64(n * 0x9FB21C651E98DF25 & (1 << 64) - 1)), U64(0))
        at = np.flatnonzero((size > 8) & (size <= LONG))
        done = 8
        while len(at):
            h[at] = finish(h[at] * STEP + self.eight(start[at] + done, size[at] - done))
            done += 8
            at = at[size[at] > done]
        long = np.flatnonzero(size > LONG)
        if len(long):
            import xxhash

            h[long] = np.array([xxhash.xxh3_64_intdigest(self.buffer[a:b]) for a, b in zip(start[long].tolist(), (start + size)[long].tolist())], U64)
        self.hash[some] = h

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Each text's kept words, joined by single spaces."""
        kept = np.flatnonzero(keep)
        size = self.end[kept] - self.start[kept] + 1
        ends = np.cumsum(size)
        at = np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = self.buffer[at]
        out[ends - 1] = 32
        flat = out.tobytes()
        cut = np.concatenate([[0], ends])[np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(self.lens)), self.lens)[kept], minlength=len(self.lens))))]
        return [flat[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
