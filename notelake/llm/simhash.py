"""SimHash near-duplicates with pigeonring filtering.

Fingerprints that are equal are one row from the start. Two fingerprints within ``distance`` bits, cut into five
consecutive segments on a ring, have by the pigeonring principle a start from which every chain of k segments differs
in at most k * distance / 5 bits. For two bits: none in the first two segments, at most one in the first three or four.
The first two segments are the key of a candidate bucket, five keys for a fingerprint; longer chains prune the pairs
within a bucket before the full Hamming check. Each bucket gives links that span its groups, not all its pairs.

A bucket beyond ``dense`` fingerprints is split by longer chains: the first three segments may differ in one bit, which is
then in the third. So a fingerprint owns the place of its third segment and visits the places that differ from it in one
bit, and only owners and visitors of a place are compared; a place that is still too full is split once more by the
fourth segment. After that owners of a place differ in the fifth segment alone, so no group grows with the corpus.

Null texts count as empty: their fingerprint is zero and is linked like any other. Rows with the same doc_id are
fingerprinted one by one and come back one by one, all in the component of their own text. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, sliced, texts
from .components import apart, components

#: Bits of a fingerprint's segments on the ring, from the lowest (fixed here: five nearly equal ones).
SEGMENTS = (13, 13, 13, 13, 12)
WORDS = 3


def fingerprint(text: bytes) -> int:
    """Majority bits of the hashes of a text's shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1)[: len(words) - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[WORDS - 1 :].tolist())], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp has the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t) for t in texts(b)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment(fp: Column, i: int) -> Column:
    i %= len(SEGMENTS)
    return F.shiftrightunsigned(fp, sum(SEGMENTS[:i])).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def pigeonring_links(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links that span the groups of one bucket, whose fingerprints agree in two segments from ``start`` on."""
    m = len(SEGMENTS)
    x = fps.view(U64)
    parts = [(x >> U64(sum(SEGMENTS[: s % m]))) & U64((1 << SEGMENTS[s % m]) - 1) for s in range(start, start + m)]
    seen, links = np.zeros(len(x), bool), []
    for root in range(len(x)):
        if seen[root]:
            continue
        queue = [root]
        seen[root] = True
        while queue:  # each fingerprint meets those that no group has yet
            u = queue.pop()
            rest = np.flatnonzero(~seen)
            gone = np.zeros(len(rest), np.int64)
            for k, p in enumerate(parts, 1):
                gone = gone + np.bitwise_count(p[rest] ^ p[u]).astype(np.int64)
                ok = gone <= k * distance // m
                rest, gone = rest[ok], gone[ok]
            rest = rest[np.bitwise_count(x[rest] ^ x[u]) <= distance]
            seen[rest] = True
            links += [(int(fps[u]), int(fps[v])) for v in rest]
            queue += rest.tolist()
    return links


def met(own: np.ndarray, visit: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links between owners and visitors of a place; the chains run from segment ``start``."""
    m, out = len(SEGMENTS), []
    parts = [(U64(sum(SEGMENTS[: s % m])), U64((1 << SEGMENTS[s % m]) - 1)) for s in range(start, start + m)]
    x, y = own.view(U64), visit.view(U64)
    for i, u in enumerate(x):
        rest, gone = np.arange(len(y)), np.zeros(len(y), np.int64)
        for k, (shift, mask) in enumerate(parts, 1):
            gone = gone + np.bitwise_count(((y[rest] ^ u) >> shift) & mask).astype(np.int64)
            ok = gone <= k * distance // m
            rest, gone = rest[ok], gone[ok]
        rest = rest[(np.bitwise_count(y[rest] ^ u) <= distance) & (y[rest] != u)]
        out += [(int(own[i]), int(visit[j])) for j in rest]
    return out


def links(distinct: DataFrame, distance: int = 2, dense: int = 512) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all within ``distance`` bits."""
    if distance != 2:
        raise ValueError("the chain budgets are for two bits")
    m = len(SEGMENTS)
    key = lambda i: (segment(F.col("fp"), i) * (1 << 13) + segment(F.col("fp"), i + 1)) * m + i
    keyed = distinct.select("fp", F.explode(F.array(*[key(i) for i in range(m)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(apart(sizes, "key"), "key")

    def rows_of(got: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of([link for k, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for link in pigeonring_links(np.array(f, np.int64), k % m, distance)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, own, visit in zip(*(b.column(c) for c in ("start", "own", "visit"))):
                yield rows_of(met(np.array(own.as_py(), np.int64), np.array(visit.as_py(), np.int64), start.as_py(), distance))

    def split(rows: DataFrame, k: int) -> DataFrame:
        """Rows (start, place, fp, own) dealt out by the k-th segment of their chain: owners to theirs, visitors to all within a bit."""
        own = F.coalesce(*[F.when(F.col("start") == i, segment(F.col("fp"), i + k)) for i in range(m)])
        near = F.concat(F.array(own), F.transform(F.array(*[F.lit(1 << i).cast("long") for i in range(max(SEGMENTS))]), lambda bit: own.bitwiseXOR(bit)))
        # the shorter segment has a bit less; its visitors' extra place has no owner
        rows = rows.select("start", "place", "fp", "own", F.explode(F.when(F.col("own"), F.array(own)).otherwise(near)).alias("at"))
        rows = rows.select("start", F.xxhash64("place", "at", F.lit(k)).alias("place"), "fp", "own")
        counts = rows.groupBy("start", "place").agg(F.sum(F.col("own").cast("long")).alias("owners"), F.count("*").alias("n"))
        return rows.join(counts.where("owners > 0 and n > owners").withColumnRenamed("place", "p").withColumnRenamed("start", "s"), (F.col("place") == F.col("p")) & (F.col("start") == F.col("s"))).drop("p", "s")

    def compared(rows: DataFrame) -> DataFrame:
        of = lambda c: F.collect_list(F.when(c, F.col("fp")))
        return rows.groupBy("start", "place").agg(of(F.col("own")).alias("own"), of(~F.col("own")).alias("visit")).mapInArrow(meet, "u long, v long")

    sparse = shared.where(F.col("n") <= dense).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps")).mapInArrow(run, "u long, v long")
    full = shared.where(F.col("n") > dense).select((F.col("key") % m).cast("int").alias("start"), F.col("key").alias("place"), "fp", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    third = durable(split(full, 2))
    again = third.where(F.col("n") > 4 * dense).select("start", "place", "fp", "own")
    return sparse.union(compared(third.where(F.col("n") <= 4 * dense))).union(compared(split(again, 3))).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach."""
    fps = durable(fingerprints(docs, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    # every fingerprint's group, then each group's least id
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(apart(least, "root"), "root").select("fp", "component_id")
    return fps.join(apart(named, "fp"), "fp").select("doc_id", "fp", "component_id")
