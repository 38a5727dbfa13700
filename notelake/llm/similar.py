"""Near-duplicates whose sets of five-word shingles are at least 0.8 alike (Jaccard), whatever the shape of the edit.

This is the SimHash operator at the width that word shingles need. At a Jaccard similarity of 0.8, 128-bit fingerprints
differ in 19 bits on average (standard deviation 4), so segments of bits as bucket keys, as in ``simhash``, would be 3 or
4 bits wide and a bucket would hold a tenth of the corpus. Buckets are therefore keyed by the shingle hashes themselves:
the least hashes under ``ROWS`` orders make one of ``TABLES`` keys. Texts of similarity J share no key with a chance of
(1 - J^4)^26: 8e-7 at 0.8, less above, and the same for scattered edits, appended, cut and replaced blocks.

Buckets with the same least set are one group, whose sets meet in one task, in chunks of ``CHUNK``. There each set that
no link has reached yet is compared by pigeonring filtering: from some of the eight 16-bit segments of the fingerprints
on the ring, every chain of k consecutive segments must differ in at most k * DISTANCE / 8 bits, the whole ring among
them (which a pair at 0.8 exceeds with a chance of 1e-6). What is left is confirmed by the exact similarity of the two
sets, counted through an inverted index of the chunk, so none below 0.8 is linked. Only links that span the groups leave
the task, never pairs. Of a group of several chunks, the sets that are not in its largest component yet visit the other
chunks in a second round; so all pairs of the group are compared but those that links connect already.

Equal sets are one row from the start. Texts without words are near-duplicates of each other; fewer than five words are
one shingle. Null texts count as empty. Rows are grouped by their texts alone, so rows without an id, and rows with the same
id, take part one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, mix, ranges, sliced, texts
from .components import apart, components
from .substring import rolling
from .words import Words

BITS, SHINGLE, BASE = 128, 5, U64(0xC2B2AE3D27D4EB4F)
#: Keys of a text, minimum hashes in each, and the multipliers that make the hashes.
TABLES, ROWS = 26, 4
_TIMES = np.random.default_rng(20240301).integers(1 << 63, size=(TABLES * ROWS, 1), dtype=np.uint64) * U64(2) + U64(1)
#: Segments of a fingerprint on the ring, and the bits in which two near-duplicates differ at most.
SEGMENTS, DISTANCE = 8, 40
#: Sets of a chunk.
CHUNK = 1024
#: Sets are alike from NEAR_OF / NEAR_IN of their union on.
NEAR_IN, NEAR_OF = 4, 5


def shingles(docs: list[bytes]) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles of five words; fewer than five words are one shingle."""
    w = Words(docs, fold=True)
    ends = np.cumsum(w.lens)
    all_ = rolling(w.hash, SHINGLE, BASE) if len(w.hash) >= SHINGLE else w.hash
    out = []
    for n, end in zip(w.lens.tolist(), ends.tolist()):
        x = all_[end - n : end - SHINGLE + 1] if n >= SHINGLE else rolling(w.hash[end - n : end], n, BASE) if n else all_[:0]
        x = np.sort(mix(x))
        out.append(x[np.append(True, x[1:] != x[:-1])] if n else x)
    return out


def keys(x: np.ndarray) -> np.ndarray:
    """The keys of a set, none if it is empty."""
    if not len(x):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(x), 512):
        np.minimum(least, (_TIMES * x[None, at : at + 512]).min(1), out=least)
    out = np.arange(1, TABLES + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, TABLES):
        out = mix((out ^ row) * BASE)
    return out.view(np.int64)


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    """Two longs with the 128 majority bits of a set of hashes."""
    h = np.stack([mix(x * _TIMES[0]), mix(x * _TIMES[1])], 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64).tolist())


def prints(docs: list[bytes]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """For each text a long that names its set, the set's size, its fingerprint and its keys."""
    for x in shingles(docs):
        yield mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64).item(), len(x), *fingerprint(x), keys(x)


def chained(hi: np.ndarray, lo: np.ndarray, i: int) -> np.ndarray:
    """Which fingerprints pass the pigeonring's chains with the i-th; the last link of a chain is the whole distance."""
    halves = hi.view(U64) ^ hi.view(U64)[i], lo.view(U64) ^ lo.view(U64)[i]
    ring = [np.bitwise_count((halves[k // 4] >> U64(16 * (k % 4))) & U64(0xFFFF)).astype(np.int16) for k in range(SEGMENTS)]
    some = np.zeros(len(hi), bool)
    for start in range(SEGMENTS):
        ok, gone = np.ones(len(hi), bool), np.zeros(len(hi), np.int16)
        for k in range(SEGMENTS):
            gone = gone + ring[(start + k) % SEGMENTS]
            ok &= gone <= (k + 1) * DISTANCE // SEGMENTS
        some |= ok
    return some


class Inverted:
    """Which sets of a list have a hash."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray):
        self.which = which
        lens = np.array([len(sets[i]) for i in which])
        flat = np.concatenate([sets[i] for i in which])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], np.repeat(np.arange(len(which)), lens)[order]

    def common(self, x: np.ndarray) -> np.ndarray:
        """How many hashes each listed set shares with x."""
        low, high = np.searchsorted(self.hashes, x, "left"), np.searchsorted(self.hashes, x, "right")
        n = high - low
        return np.bincount(self.owner[np.repeat(low, n) + ranges(n)], minlength=len(self.which))


def spanning(sets: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> list[tuple[int, int]]:
    """Links (by position) that span the components of all pairs that are alike."""
    sizes, left, out = np.array([len(x) for x in sets]), np.ones(len(sets), bool), []
    index = Inverted(sets, np.arange(len(sets)))
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            i = queue.pop()
            if 2 * left.sum() < len(index.which):
                index = Inverted(sets, np.flatnonzero(left))
            at = index.which
            # sets whose sizes differ by more cannot be 0.8 alike
            ok = left[at] & (NEAR_OF * np.minimum(sizes[at], sizes[i]) >= NEAR_IN * np.maximum(sizes[at], sizes[i]))
            ok[ok] = chained(np.append(hi[at[ok]], hi[i]), np.append(lo[at[ok]], lo[i]), -1)[:-1]
            if not ok.any():
                continue
            alike = ok & ((NEAR_IN + NEAR_OF) * index.common(sets[i]) >= NEAR_IN * (sizes[at] + sizes[i]))
            near = at[alike].tolist()
            left[near] = False
            out += [(i, j) for j in near]
            queue += near
    return out


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component, component_id) of each row.

    ``text_hash`` is Spark's xxhash64 of the text, ``component`` names the group, ``component_id`` is its least doc_id.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64), pa.int64()))

    def print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            *longs, k = zip(*prints(texts(b)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in longs), lists(list(k))], names=["doc_id", "text_hash", "set", "n", "hi", "lo", "keys"])

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("hi"), b.column("lo"), lists(shingles(texts(b)))], names=["set", "hi", "lo", "x"])

    def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (head, chunk); one chunk's sets are held at a time."""
        now, rows = None, []

        def close() -> pa.RecordBatch:
            found = spanning([r[3] for r in rows], *(np.array([r[k] for r in rows], np.int64) for k in (1, 2))) if len(rows) > 1 else []
            pairs = [sorted((rows[i][0], rows[j][0])) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in sliced(batches):
            x = b.column("x")
            flat, cut = x.values.to_numpy(zero_copy_only=False).view(U64), x.offsets.to_numpy()
            for i, (key, name, hi, lo) in enumerate(zip(zip(b.column("head").to_pylist(), b.column("chunk").to_pylist()), *(b.column(c).to_pylist() for c in ("set", "hi", "lo")))):
                if key != now:
                    if rows:
                        yield close()
                    now, rows = key, []
                rows.append((name, hi, lo, flat[cut[i] : cut[i + 1]].copy()))
        if rows:
            yield close()

    fps = durable(named.mapInArrow(print_rows, "doc_id long, text_hash long, set long, n long, hi long, lo long, keys array<long>"))
    distinct = durable(fps.groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "doc_id", "n", "hi", "lo", "keys")).alias("p")))

    keyed = distinct.select("set", F.explode("p.keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("set").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = durable(keyed.join(apart(heads, "key"), "key").select("head", "set").distinct())
    # the head is a member by its own keys; a group's chunks are even, and the head is in each of them
    sizes = members.groupBy("head").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = members.join(apart(sizes, "head"), "head").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    wanted = distinct.select("set", "p.hi", "p.lo", "p.text_hash", F.col("p.doc_id").alias("id")).join(apart(members.select("set").distinct(), "set"), "set", "left_semi")
    held = named.join(wanted.withColumnRenamed("text_hash", "hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sets = durable(held.select("set", "hi", "lo", "text").dropDuplicates(["set"]).mapInArrow(set_rows, "set long, hi long, lo long, x array<long>"))

    def linked(dealt: DataFrame) -> DataFrame:
        """Links within the chunks (head, chunk) that sets are dealt to."""
        rows = dealt.join(apart(sets, "set"), "set").select("head", "chunk", "set", "hi", "lo", "x")
        return durable(rows.repartition("head", "chunk").sortWithinPartitions("head", "chunk", "set").mapInArrow(link_rows, "u long, v long").distinct())

    dealt = members.select("head", "set", F.explode(F.when(F.col("head") == F.col("set"), every).otherwise(F.array("chunk"))).alias("chunk"))
    links = linked(dealt)
    several = members.where("chunks > 1")
    if not several.isEmpty():
        label = components(links).withColumnRenamed("node", "set")
        named_ = durable(several.join(apart(label, "set"), "set", "left").select("head", "set", "chunk", "chunks", F.coalesce("root", "set").alias("label")))
        largest = named_.groupBy("head", "label").agg(F.count("*").alias("n")).groupBy("head").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        named_ = named_.join(apart(largest, "head"), "head")
        links = links.union(linked(named_.select("head", "set", F.explode(F.when(F.col("label") == F.col("largest"), F.array("chunk")).otherwise(every)).alias("chunk"))))
    roots = components(links).withColumnRenamed("node", "set")
    of_set = distinct.select("set", "least").join(apart(roots, "set"), "set", "left").select("set", F.coalesce("root", "set").alias("component"), "least")
    least = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = of_set.select("set", "component").join(apart(least, "component"), "component")
    return fps.select("doc_id", "text_hash", "set").join(apart(of_set, "set"), "set").select("doc_id", "text_hash", "component", "component_id")
