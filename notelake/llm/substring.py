"""Substring dedup by difference-cover anchors.

Positions of a document are in the cover if they are, modulo 13, in a perfect difference set: for any two starts i and
j some shift below 13 puts both i + shift and j + shift in the cover. So two equal windows of 20 words share an 8-word
anchor at cover positions, and only the hashes of such anchors, 4 in 13 positions, are compared over all documents.
Where an anchor occurs twice, the windows of 20 words around it are extended to (their 128-bit hashes), and those are
compared. Every comparison is a merge of sorted hash lists: a block of documents sends each distinct hash once, however
often it occurs, and hears back which occur elsewhere. No pair of occurrences is ever formed.

Texts cross one shuffle, by block; the three passes over them share that exchange.

Null and empty texts have no words and come back with zero counts and the hash of the empty string. A table without
rows gives no rows. Rows with the same doc_id are judged in the order of their texts, the first counting as earlier;
null ids come before all others. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix, partitions, texts, with_blocks
from .words import Words

#: A perfect difference set (fixed values): every residue modulo 13 is a difference of two of them.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
A1, A2 = U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)


def rolling(x: np.ndarray, n: int, a: U64) -> np.ndarray:
    """sum x[i+k] * a^k over k < n, for each i at which n words follow; by doubling."""
    out, done, size, part, power = None, 0, 1, x, int(a)
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                m = len(x) - done - size + 1
                out = out[:m] + U64(pow(int(a), done, 1 << 64)) * part[done : done + m]
            done += size
        if done == n:
            return mix(out)
        part = part[: len(part) - size] + U64(power) * part[size:]
        power = power * power % (1 << 64)
        size *= 2


class Block:
    """The words of a block's documents, one after the other in the order of ids."""

    def __init__(self, t: pa.Table):
        ids, raw = t.column("doc_id").to_pylist(), texts(t)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i]))
        self.ids = [ids[i] for i in order]
        self.words = Words([raw[i] for i in order])
        self.lens, self.x = self.words.lens, self.words.hash
        self.ends = np.cumsum(self.lens)
        self.pos = np.arange(len(self.x)) - np.repeat(self.ends - self.lens, self.lens)
        self.left = np.repeat(self.ends, self.lens) - np.arange(len(self.x))  # words from here to the document's end

    def hashes(self, n: int, a: U64) -> np.ndarray:
        return rolling(self.x, n, a) if len(self.x) >= n else np.zeros(0, U64)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the cover, and the hashes of the windows there."""
        h = self.hashes(width, A1)
        at = np.flatnonzero((self.left[: len(h)] >= width) & np.isin(self.pos[: len(h)] % PERIOD, COVER))
        return at, h[at]


def blobs(block: int, buckets: int, *keys: np.ndarray) -> pa.Table:
    """One row for each bucket with its share of the keys, which are sorted and distinct by the first."""
    b = (keys[0] >> U64(33)) % U64(buckets)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    rows = [[k[order[cut[i] : cut[i + 1]]].tobytes() for i in full] for k in keys]
    return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32())} | {f"k{i + 1}": pa.array(r, pa.binary()) for i, r in enumerate(rows)})


def read(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), U64)


def shared(t: pa.Table, later_only: bool) -> pa.Table:
    """Of a bucket, for each block the keys that other blocks have too: all such, or those that an earlier block has."""
    two = "k2" in t.column_names
    t = t.sort_by("block")
    k1 = read(t, "k1")
    k2 = read(t, "k2") if two else np.zeros(len(k1), U64)
    block = np.repeat(np.array(t.column("block").to_pylist(), np.int32), [len(x) // 8 for x in t.column("k1").to_pylist()])
    order = np.lexsort((block, k2, k1)) if two else np.argsort(k1, kind="stable")
    k1, k2, block = k1[order], k2[order], block[order]
    same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    hit = np.concatenate([[False], same])
    if not later_only:
        hit = hit | np.concatenate([same, [False]])
    k1, k2, block = k1[hit], k2[hit], block[hit]
    order = np.argsort(block, kind="stable")
    k1, k2, block = k1[order], k2[order], block[order]
    of, at = np.unique(block, return_index=True)
    at = np.append(at, len(block))
    return pa.table({
        "block": pa.array(of, pa.int32()),
        "k1": pa.array([k1[at[i] : at[i + 1]].tobytes() for i in range(len(of))], pa.binary()),
        "k2": pa.array([k2[at[i] : at[i + 1]].tobytes() if two else b"" for i in range(len(of))], pa.binary()),
    })


REQUEST1, REQUEST2, REPLY = "bucket int, block int, k1 binary", "bucket int, block int, k1 binary, k2 binary", "block int, k1 binary, k2 binary"


def remove_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words covered by a window that also starts earlier are gone from ``kept``.

    ``window`` is at least 20, so that anchors of window - 12 words stay selective.
    """
    if window < 20:
        raise ValueError("window must be at least 20")
    width = window - PERIOD + 1
    d, n_blocks = with_blocks(docs, id_col, text_col, BLOCK_BYTES)
    buckets = max(partitions(docs.sparkSession), n_blocks // 4)
    by_block = d.groupBy("block")

    def ask_anchors(key: tuple, t: pa.Table) -> pa.Table:
        return blobs(key[0].as_py(), buckets, np.unique(Block(t).anchors(width)[1]))

    def ask_windows(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        b = Block(t)
        at, h = b.anchors(width)
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(h), bool)
        twice[order[1:][s[1:] == s[:-1]]] = True
        twice[order[:-1][s[1:] == s[:-1]]] = True
        elsewhere = np.sort(read(reply, "k1"))
        if len(elsewhere):
            twice |= elsewhere[np.minimum(np.searchsorted(elsewhere, h), len(elsewhere) - 1)] == h
        at = at[twice]
        # extend: a window that holds the anchor starts up to 12 words before it, within the document
        cover = np.zeros(len(b.x) + 1, np.int64)
        np.add.at(cover, at - np.minimum(b.pos[at], PERIOD - 1), 1)
        np.add.at(cover, at + 1, -1)
        h1, h2 = b.hashes(window, A1), b.hashes(window, A2)
        if not len(h1):
            return blobs(key[0].as_py(), buckets, h1, h2)
        go = (np.cumsum(cover)[: len(h1)] > 0) & (b.left[: len(h1)] >= window)
        h1, first = np.unique(h1[go], return_index=True)
        return blobs(key[0].as_py(), buckets, h1, h2[go][first])

    def finish(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        b = Block(t)
        gone = np.zeros(len(b.x) + 1, np.int64)
        h1, h2 = b.hashes(window, A1), b.hashes(window, A2)
        if len(h1):
            ok = np.flatnonzero(b.left[: len(h1)] >= window)
            g1, g2 = h1[ok], h2[ok]
            order = np.lexsort((g2, g1))
            again = np.zeros(len(ok), bool)  # not the first of its kind in this block (lexsort keeps the order of ties)
            again[order[1:]] = (g1[order][1:] == g1[order][:-1]) & (g2[order][1:] == g2[order][:-1])
            k1, k2 = read(reply, "k1"), read(reply, "k2")
            if len(k1):
                o = np.argsort(k1)
                k1, k2 = k1[o], k2[o]
                at = np.minimum(np.searchsorted(k1, g1), len(k1) - 1)
                again |= (k1[at] == g1) & (k2[at] == g2)
            np.add.at(gone, ok[again], 1)
            np.add.at(gone, ok[again] + window, -1)
        keep = np.cumsum(gone)[:-1] == 0
        before = np.append(0, np.cumsum(keep))
        removed = b.lens - (before[b.ends] - before[b.ends - b.lens])
        kept = [k.decode() for k in b.words.joined(keep)]
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(b.lens, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    def merge_anchors(key: tuple, t: pa.Table) -> pa.Table:
        return shared(t, later_only=False)

    def merge_windows(key: tuple, t: pa.Table) -> pa.Table:
        return shared(t, later_only=True)

    reply1 = by_block.applyInArrow(ask_anchors, REQUEST1).groupBy("bucket").applyInArrow(merge_anchors, REPLY)
    reply2 = by_block.cogroup(reply1.groupBy("block")).applyInArrow(ask_windows, REQUEST2).groupBy("bucket").applyInArrow(merge_windows, REPLY)
    return by_block.cogroup(reply2.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
