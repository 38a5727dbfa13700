"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case without punctuation around them. A document is compared with the test items that share a
seed with it, a run of ``least`` words found by its running Karp-Rabin hash. For each such pair the seeds are extended to
their longest matches, and these are marked, longest first, where they overlap no earlier one, until none of ``least``
words is left. An item is leaked if its marked words reach
``coverage`` of it; order plays no part, so reordered passages are caught.

Items are a query set that is sent to the documents in blocks of bounded size, one block at a time, so documents are
never shuffled. An item shorter than ``least`` words is looked for as a whole.

Null texts and texts without words match nothing; items without words are never leaked. Repeated rows, of documents and of
items, are judged and returned one by one. Empty tables give no rows. Very long texts are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ranges, sliced, texts
from .words import Words

#: Bytes of item texts that are sent out at once.
BLOCK_BYTES = 8 << 20
PUNCTUATION = b".,;:!?\"'()[]{}*%$&#-_|<>"
A = U64(0xD6E8FEB86659FD93)


MARKS = np.isin(np.arange(256), np.frombuffer(PUNCTUATION, np.uint8))


def words(text: bytes) -> list[bytes]:
    """Words in lower case (ASCII), without punctuation at their ends; what is left empty is no word."""
    return [x for x in (w.strip(PUNCTUATION) for w in text.lower().split()) if x]


def hashed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of these words of all texts, and the texts' numbers of words."""
    w = Words(docs, fold=True).trim(MARKS, PUNCTUATION)
    return w.hash, w.lens


def windows(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n numbers."""
    out = np.zeros(max(len(x) - n + 1, 0), U64)
    for k in range(n):
        out = out * A + x[k : k + len(out)]
    return out


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low..high-1: the range's number and the place, for each place."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low, n) + ranges(n)


def tiles(item, doc, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles, longest first, ties by place; each position in one tile at most.

    Runs of equal words are the diagonals of the two texts' match table. The longest that is still
    free is marked; of a run that others have cut, the free pieces come up again at their own lengths.
    """
    item, doc = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    order = np.argsort(doc, kind="stable")
    known = doc[order]
    i, at = expanded(np.searchsorted(known, item, "left"), np.searchsorted(known, item, "right"))
    j = order[at]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    if not len(i):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.append(first, len(i)))
    long = size >= least
    heap = [(-n, a, b) for n, a, b in zip(size[long].tolist(), i[first][long].tolist(), j[first][long].tolist())]
    heapq.heapify(heap)
    free_i, free_d, found = np.ones(len(item), bool), np.ones(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        ok = free_i[a : a + n] & free_d[b : b + n]
        if ok.all():
            found.append((a, b, n))
            free_i[a : a + n] = free_d[b : b + n] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= least:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return found


class Index:
    """Seeds of a block of items, as sorted arrays."""

    def __init__(self, items: list[tuple[int, bytes]], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        h, self.lens = hashed([t for _, t in items])
        self.words, code = np.unique(h, return_inverse=True)
        #: Numbers of the items' words from 1 on, one item after the other.
        self.codes = (code + 1).astype(np.uint32)
        self.ends = np.cumsum(self.lens)
        of, left = np.repeat(np.arange(len(items)), self.lens), np.repeat(self.ends, self.lens) - np.arange(len(h))
        need = np.minimum(least, self.lens)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(need[need > 0]).tolist():
            at = np.flatnonzero((need[of] == n) & (left >= n))
            seed = windows(self.codes.astype(U64), n)[at]
            order = np.argsort(seed, kind="stable")
            self.seeds[n] = seed[order], of[at][order].astype(np.uint32)

    def item(self, k: int) -> np.ndarray:
        return self.codes[self.ends[k] - self.lens[k] : self.ends[k]]

    def leaks(self, docs: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, words marked, words of the item) for each item that shares a seed with a text."""
        h, lens = hashed(docs)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        x = np.where(self.words[at] == h, at + 1, 0) if len(self.words) else np.zeros(len(h), np.int64)
        ends = np.cumsum(lens)
        of, left = np.repeat(np.arange(len(docs)), lens), np.repeat(ends, lens) - np.arange(len(h))
        unknown = np.append(0, np.cumsum(x == 0))
        found: list[np.ndarray] = []
        for n, (known, items) in self.seeds.items():
            place = np.flatnonzero((left[: max(len(x) - n + 1, 0)] >= n) & (unknown[n:] == unknown[: max(len(unknown) - n, 0)]))
            seed = windows(x.astype(U64), n)[place]
            low = np.searchsorted(known, seed, "left")
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == seed) if len(known) else place[:0]
            which, k = expanded(low[hit], np.searchsorted(known, seed[hit], "right"))
            p = place[hit][which]
            found.append(np.stack([of[p], items[k].astype(np.int64), p], 1))
        hits = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        border = np.flatnonzero(np.concatenate([[True], (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0)])) if len(hits) else []
        out = []
        for group in np.split(hits, border[1:]) if len(hits) else []:
            d, k = int(group[0, 0]), int(group[0, 1])
            item, p = self.item(k), np.unique(group[:, 2])
            least = min(self.least, len(item))
            # a tile lies within a run of seeds; what lies between runs is one gap that matches nothing
            first = np.flatnonzero(np.append(True, np.diff(p) > least))
            parts = [y for a, b in zip(p[first], p[np.append(first[1:], len(p)) - 1]) for y in ([0], x[a : b + least])]
            marked = sum(n for _, _, n in tiles(item, np.concatenate(parts), least))
            out.append((d, k, marked, len(item)))
        return out


def contamination(docs: DataFrame, items: DataFrame, *, least: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, coverage) for each leaked item of each document."""
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, matched_words long, item_words long"
    out = None
    for block in blocks(items, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, least))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                ids = b.column(0).to_pylist()
                rows = [(ids[d], index.value.ids[k], m, n) for d, k, m, n in index.value.leaks(texts(b)) if m >= coverage * n]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=[x.split()[0] for x in schema.split(", ")])

        part = got.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most BLOCK_BYTES of text (or one item); at least one block, perhaps empty."""
    rows, size, some = [], 0, False
    for r in items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull()).orderBy(item_id, item_text).toLocalIterator():
        t = r[1].encode()
        if rows and size + len(t) > BLOCK_BYTES:
            yield rows
            rows, size, some = [], 0, True
        rows.append((r[0], t))
        size += len(t)
    if rows or not some:
        yield rows


def leaked_udf(items: DataFrame, *, least: int = 5, coverage: float = 0.8):
    """Column functions, one for each block of items, that tell whether a text leaks one of its items."""
    for block in blocks(items, "item_id", "text"):
        index = items.sparkSession.sparkContext.broadcast(Index(block, least))

        @F.pandas_udf("boolean")
        def leaked(column, index=index):
            import pandas as pd

            out = np.zeros(len(column), bool)
            for low in range(0, len(column), 500):
                hits = index.value.leaks([(t or "").encode() for t in column[low : low + 500]])
                out[[low + d for d, _, m, n in hits if m >= coverage * n]] = True
            return pd.Series(out)

        yield leaked
