"""Lexical retrieval packing: a sharded BM25 index hands each seed document its unused neighbours, which fill its window.

Documents are dealt to shards by content, so like documents meet wherever they stood in the input. A routing table is
fitted on a bounded sample (``sample`` documents, by a hash of the row): document frequencies of hashed words, and 64
clusters of the sample's vectors. A document's place is its cluster, then two of its words that others share, drawn with
chances by their weight and by the words alone, so that documents with the same rare words draw the same; then a hash of
the row, which splits any number of equal texts. Places are cut into even parts, and a part's documents, in order of
place, into shards of bounded size; each shard has its own index over all words of its documents.

A window is opened by a seed. All unused documents of the shard that share a word with it are its neighbours, best BM25
score first, and are taken until the window is full. A document that doesn't fit is cut, and its rest is the seed of the
next window. Where a seed has no neighbour left, the next document of the shard is a seed in the same window. What is
left at the end of a shard fills sequences whose lengths are powers of two. No sequence holds padding.

Null texts are empty; every document has at least its end id. Rows with the same id are packed one by one. An empty
table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, sliced, texts
from .kmeans_tree import kmeans, nearest
from .tokens import encoder
from .words import Words

#: Hashed vocabulary of the index, and BM25's constants.
TERMS, K1, B = 1 << 18, 1.2, 0.75
#: A shard is closed at so many ids or documents (fewer than 2^13, so that keys fit 32 bits).
SHARD_IDS, SHARD_DOCS = 1_000_000, 1500
#: Clusters are BRANCH by BRANCH, of vectors of so many hashed words; bytes of text in a part, parts at
#: most, and sampled places for each part.
BRANCH, WIDTH, PART_BYTES, PARTS, PLACES = 8, 1024, 12 << 20, 1 << 16, 40
#: Pieces that a worker remembers: JVM and Python share an executor's memory with the sort of a part.
REMEMBERED = 500_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def distinct_terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word) of all distinct words of each text, in ascending order."""
    of = np.repeat(np.arange(len(w.lens), dtype=np.uint64), w.lens)
    key = np.sort((of << U64(18)) | (w.hash % U64(TERMS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> U64(18)).astype(np.int64), (key & U64(TERMS - 1)).astype(np.int64)


class Routes:
    """Places of documents; fitted on the distinct terms of sampled documents."""

    def __init__(self, sample: list[np.ndarray]):
        n = len(sample)
        df = np.bincount(np.concatenate(sample), minlength=TERMS) if n else np.zeros(TERMS, np.int64)
        #: A word that no other sampled document has gets little weight: it may be alone.
        self.weight = np.where(df > 1, np.log1p(n / np.maximum(df, 1)), 0.05).astype(np.float32)
        draw = (mix(np.arange(1, TERMS + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)) >> U64(11)).astype(np.float64) / (1 << 53)
        #: Each word's place in a race, whose first win.
        self.rank = np.empty(TERMS, np.int64)
        self.winners = np.argsort(-np.log(np.maximum(draw, 1e-300)) / self.weight, kind="stable")
        self.rank[self.winners] = np.arange(TERMS)
        self.centres = np.zeros((1, WIDTH))
        if n:
            of = np.repeat(np.arange(n), [len(s) for s in sample])
            x = self.vectors(of, np.concatenate(sample), n)
            rng = np.random.default_rng(17)
            top = kmeans(x, BRANCH, rng)
            at = nearest(x, top)
            # children follow their parent, so near clusters are near places
            self.centres = np.concatenate([kmeans(x[at == i], BRANCH, rng) for i in range(len(top)) if (at == i).any()])

    def vectors(self, of: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        x = np.bincount(of * WIDTH + term % WIDTH, self.weight[term], n * WIDTH).reshape(n, WIDTH)
        return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)

    def places(self, w: Words, rows: np.ndarray) -> np.ndarray:
        """A positive long for each text: cluster, two drawn words, 20 bits of the row's hash."""
        of, term = distinct_terms(w)
        n = len(w.lens)
        leaf = nearest(self.vectors(of, term, n), self.centres)
        count, rank = np.bincount(of, minlength=n), self.rank[term]
        has, drawn = count > 0, np.zeros((2, n), np.int64)
        first = (np.cumsum(count) - count)[has]
        for k in (0, 1):
            if len(first):
                least = np.minimum.reduceat(rank, first)
                drawn[k, has] = np.where(least < TERMS, self.winners[np.minimum(least, TERMS - 1)], 0)
                rank = np.where(rank == np.repeat(least, count[has]), TERMS, rank)
        return (leaf << 56) | (drawn[0] << 38) | (drawn[1] << 20) | (mix(rows.view(U64)) >> U64(44)).astype(np.int64)


class Bm25:
    """The index of one shard over hashed words; weights are whole numbers, so that sums are exact in any order."""

    def __init__(self, docs: list[np.ndarray]):
        n = self.n = len(docs)
        lens = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(n, dtype=np.uint64), lens)
        key = np.sort((doc << U64(18)) | (np.concatenate(docs) % TERMS).astype(U64)) if n else doc
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        term = (key & U64(TERMS - 1)).astype(np.int64)
        df = np.bincount(term, minlength=TERMS)
        keep = df[term] > 1  # a word of one document finds no other
        key, term, tf = key[keep], term[keep], tf[keep]
        doc = key >> U64(18)
        d = doc.astype(np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = np.rint(1024 * idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[d] / max(lens.mean(), 1e-9)))) if n else tf
        weight = np.maximum(weight, 1)
        self.terms, self.at = term, np.searchsorted(d, np.arange(n + 1))
        # words that a quarter of the documents have are rows of a matrix, the rest lists
        common = np.flatnonzero(df > max(n / 4, 1))
        self.row = np.full(TERMS, -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n))
        thick = self.row[term] >= 0
        self.matrix[self.row[term[thick]], d[thick]] = weight[thick]
        term, d, weight, doc = (x[~thick] for x in (term, d, weight, doc))
        order = np.argsort((term.astype(np.uint32) << np.uint32(13)) | doc.astype(np.uint32))
        self.doc, self.weight = d[order], weight[order]
        self.first = np.append(0, np.cumsum(np.bincount(term, minlength=TERMS)))

    def neighbours(self, d: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share words with d, best first, ties in row order."""
        terms = self.terms[self.at[d] : self.at[d + 1]]
        row = self.row[terms]
        ask = np.zeros(len(self.matrix))
        ask[row[row >= 0]] = 1
        score = ask @ self.matrix
        terms = terms[row < 0]
        low, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        if len(terms):
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        some = np.flatnonzero(score)
        return some[np.lexsort((some, -score[some]))]


def fill(sizes: list[int], index: Bm25, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    out, now, room = [], [], window
    used = np.zeros(len(sizes), bool)

    def place(d: int, start: int = 0) -> None:
        nonlocal now, room
        while start < sizes[d]:
            take = min(room, sizes[d] - start)
            now.append((d, start, take))
            start, room = start + take, room - take
            if not room:
                out.append(now)
                now, room = [], window

    for seed in range(len(sizes)):
        if used[seed]:
            continue
        used[seed] = True
        place(seed)
        d = seed
        while room < window:  # what is open belongs to d: fill it up with all of d's neighbours
            before = len(out)
            for m in index.neighbours(d, used):
                used[m] = True
                place(m)
                if len(out) > before:
                    d = m  # its rest, if any, is the next seed
                    break
            else:
                break  # none is left: the next seed goes on in this window
    left = window - room
    while now:  # powers of two, largest first
        size = 1 << (left.bit_length() - 1)
        part, got = [], 0
        while got < size:
            d, start, n = now.pop(0)
            take = min(n, size - got)
            part.append((d, start, take))
            got += take
            if take < n:
                now.insert(0, (d, start + take, n - take))
        out.append(part)
        left -= size
    return out


def routed(docs: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text) of ``docs`` dealt to parts and sorted by place."""
    spark = docs.sparkSession
    row = F.xxhash64("doc_id", "text")
    n, size = docs.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16))).first()
    parts = min(PARTS, max(1, -(-int(size or 0) // PART_BYTES)))
    share = min(1.0, 2 * sample / max(n, 1))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            of, term = distinct_terms(Words(texts(b), fold=True))
            cut = np.searchsorted(of, np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([x.astype(np.uint32).tobytes() for x in np.split(term, cut)], pa.binary())], names=["row", "terms"])

    picked = docs.withColumn("row", row).where(F.pmod(F.col("row"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
    rows = picked.mapInArrow(terms, "row long, terms binary").collect()
    seen = [np.frombuffer(r.terms, np.uint32).astype(np.int64) for r in sorted(rows)]
    routes = spark.sparkContext.broadcast(Routes(seen))

    schema, cuts = "doc_id long, text string, row long, place long, part int", np.zeros(0, np.int64)

    def placing(cuts: np.ndarray):
        # the part is found here too: a second function would be a second Python process for each task
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, 500):
                at = routes.value.places(Words(texts(b), fold=True), b.column("row").to_numpy())
                part = np.searchsorted(cuts, at, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(part)], names=["doc_id", "text", "row", "place", "part"])

        return place

    if parts > 1:
        # even parts by the places of PLACES rows for each part, of which only these longs are collected; equal texts differ in the last bits
        want = PLACES * parts
        some = docs.withColumn("row", row).where(F.pmod(F.col("row"), F.lit(1 << 30)) < int(min(1.0, 2 * want / n) * (1 << 30)))
        known = some.mapInArrow(placing(cuts), schema).select("place").limit(want).collect()
        known = np.sort(np.array([r.place for r in known], np.int64))
        if len(known):  # a table of one repeated row may have none in the sample; its rows have one place anyway
            cuts = known[np.linspace(0, len(known), parts + 1)[1:-1].astype(np.int64)]

    placed = docs.withColumn("row", row).mapInArrow(placing(cuts), schema)
    placed = placed.repartitionById(parts, "part") if parts > 1 else placed.repartition(1)
    return placed.sortWithinPartitions("place", "row", "doc_id").select("doc_id", "text")


def pack(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, spaces_kept: bool = False, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids: ``ids`` has a piece's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces_kept, REMEMBERED)
        base = TaskContext.get().partitionId() << 40
        made = 0
        ids: list = []
        toks: list[np.ndarray] = []
        words: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            nonlocal made, ids, toks, words, total
            sequences = fill([len(t) for t in toks], Bm25(words), window)
            rows: list[list] = [[] for _ in range(8)]
            for s in sequences:
                offset = 0
                length = sum(x[2] for x in s)
                for d, start, n in s:
                    for col, v in zip(rows, (ids[d], start, n, toks[d][start : start + n].astype("<u4").tobytes(), len(toks[d]), base + made, offset, length)):
                        col.append(v)
                    offset += n
                made += 1
            ids, toks, words, total = [], [], [], 0
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in sliced(batches, 600):
            got = enc([t or "" for t in b.column(1).to_pylist()], terms=True)
            for i, (x, w) in zip(b.column(0).to_pylist(), got):
                ids.append(i)
                toks.append(np.append(x, np.uint32(end_id)))
                words.append(w)
                total += len(toks[-1])
                if total >= SHARD_IDS or len(ids) >= SHARD_DOCS:
                    yield shard()
        if ids:
            yield shard()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return routed(plain, sample).mapInArrow(run, SCHEMA)
