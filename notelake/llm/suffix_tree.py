"""Language model scoring by a probabilistic suffix tree over words.

Contexts are suffixes of the words so far. The tree grows by their length: every context that occurs ``least`` times or
more in the training tokens is a candidate, unless its suffix is followed by one kind of word alone (then so is it, and
nothing below can diverge). A candidate is kept if its next-word distribution diverges from that of its suffix: the
Kullback-Leibler divergence, summed over its occurrences, must reach ``nats`` for each kind of next word. It is at most
n ln(s / n) for n occurrences and s of the suffix, so where no number of occurrences up to n reaches ``nats``, neither the
context nor a longer one around it can be kept, and it is no candidate. Growth ends when no candidate is left or at
``depth`` words. Each word is scored in the longest kept context that is a suffix of what
precedes it. A context's distribution is smoothed towards that of its longest kept suffix, with as much weight as it has
kinds of next words, and the root's by adding 0.1 to each count.

All counts are over the whole training set, so what the tree holds grows with the input. Documents are read once and held
as blocks of word numbers in the shared folder. For each length a block asks, once for each pair of context and next word
in it, with its own training count; requests meet by context and are answered with the whole count, the context's kinds
of next words and whether it is kept. A next word that follows the suffix once in all is that one occurrence, so it is
counted without its number. Contexts go by suffix, as trees of words from the last to the first, and what a block adds to the
divergence by counts of the suffix goes as one sum where that is shorter. Requests of a length take turns, each for some
contexts, if most tokens ask; answers are written to the blocks before the next length asks. A context that occurs more than
``SPLIT`` times is dealt out by next words, and its parts are summed first. No table of contexts is broadcast or sent to the
driver.

Words are known by 64-bit hashes until they are counted, then by numbers of 32 bits (more words are an error), contexts that
meet by 64 bits. Counts of contexts beyond 2^24 are held to 7 digits. Null and empty texts are the end token alone. Rows with
the same doc_id are scored one by one; rows without an id are held out. An empty table gives no rows; without training rows
every base probability is that of an empty count. Other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, fetch, fresh_path, mix, partitions, put, ranges, remove, sliced, store, texts, tidy
from .words import STEP, Words, finish

BLOCK_BYTES = 8 << 20
#: Occurrences of a context beyond which it is dealt out by next words.
SPLIT = 1 << 20
#: Hash of the end token.
END = U64(0x5EED0FE4D0FDA7A1)
ADD = 0.1
#: Next words of a context in a block that are sent with their suffixes' counts; of more, one sum is sent, in parts of 1 / FINE nats.
FEW, FINE = 4, 1 << 30


def planes(x: np.ndarray) -> tuple:
    """An array as (type, whether whole numbers stand for floats, bytes): first bytes of all numbers, then second ones, and so on.

    Of flags their number stands there, and bits.
    """
    kind = x.dtype.str
    if x.dtype == bool:
        return kind, len(x), np.packbits(x).tobytes()
    whole = kind == "<f4" and bool((x < 1 << 24).all()) and bool((x >= 0).all()) and bool((x == np.rint(x)).all())
    x = x.astype(np.uint32) if whole else np.ascontiguousarray(x).view(f"<u{x.dtype.itemsize}")
    return kind, whole, b"".join((x >> x.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(x.dtype.itemsize))


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(pickle.dumps([x if x.dtype == object else planes(x) for x in arrays], 5), 1)


def unpack(data: bytes, first: int | None = None) -> list[np.ndarray]:
    """The arrays, or the first ones."""
    import zstandard

    out = []
    for x in pickle.loads(zstandard.decompress(data))[:first]:
        if isinstance(x, tuple):
            kind, whole, raw = x
            if kind == "|b1":
                x = np.unpackbits(np.frombuffer(raw, np.uint8), count=whole).view(bool)
            else:
                size = np.dtype(kind).itemsize
                parts = np.frombuffer(raw, np.uint8).reshape(size, -1)
                x = parts[0].astype(f"<u{size}")
                for i in range(1, size):
                    if parts[i].any():
                        x |= parts[i].astype(x.dtype) << x.dtype.type(8 * i)
                x = x.astype(kind) if whole else x.view(kind)
        out.append(x)
    return out


def steps(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Ascending numbers of each group as the first and the differences."""
    out = x.copy()
    out[1:] -= x[:-1]
    first = (np.cumsum(per, dtype=np.int64) - per)[per > 0]
    out[first] = x[first]
    return out


def summed(d: np.ndarray, per: np.ndarray) -> np.ndarray:
    """What ``steps`` was given."""
    if not len(d):
        return d
    every = np.cumsum(d, dtype=np.uint32)
    some = per[per > 0]
    first = np.cumsum(some, dtype=np.int64) - some
    return every - np.repeat(every[first] - d[first], some)


def total(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, x, n)


class Block:
    """The words of some documents, one after the other, each document closed by the end token.

    ``g[k]`` has for each token the training count of the k + 1 words that end there (exact only where the next length
    asks for it), ``many[k]`` whether the k words before it have two kinds of next words, ``kinds[k]`` how many if they
    are kept as a context, else 0.
    """

    def __init__(self, folder: str, name: str, length: int):
        """With what requests about contexts of ``length`` words look at."""
        self.folder, self.name = folder, name
        self.ids, self.lens, train, word_of = unpack(fetch(folder, f"{name}-0"))
        self.count, words = unpack(fetch(folder, f"{name}-1"))
        self.words, self.word_of = words.astype(U64), word_of.astype(np.int64)
        self.pos, self.train = ranges(self.lens), np.repeat(train, self.lens)
        self.trains = train
        self.g, self.many, self.kinds = [self.count[self.word_of].astype(np.float32)], [np.ones(len(word_of), bool)], [np.zeros(len(word_of), np.float32)]
        for k in range(2, length + 1):
            self.add(*(unpack(fetch(folder, f"{name}-{k}"), 2) if k >= length - 1 else (None, None)), None)

    def add(self, g: np.ndarray | None, many: np.ndarray | None, kinds: np.ndarray | None) -> None:
        """What a length's file holds; for contexts of one word it has one value for each word of the block."""
        if len(self.g) == 1 and g is not None:
            has, word = self.pos >= 1, before(self.word_of)
            many, kinds = has & many[word], None if kinds is None else np.where(has, kinds[word], np.float32(0))
        for to, x in zip((self.g, self.many, self.kinds), (g, many, kinds)):
            to.append(x)


def hashed(under: np.ndarray | U64, far: np.ndarray) -> np.ndarray:
    """Hashes of contexts from those of their suffixes and the numbers of their first words."""
    return finish(under * STEP + far)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in ascending order, a place of each, and of each number its rank: np.unique by a sort that is not stable."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(new) - 1
    return x[new], order[new], rank


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers in the order of the columns' rows, equal where those are."""
    key, size = np.zeros(len(columns[0]), U64), 1
    for x in columns:
        top = int(x.max(initial=0)) + 1
        if size * top >> 64:
            distinct, _, key = grouped(key)
            key, size = key.astype(U64), len(distinct)
        key, size = key * U64(top) + x.astype(U64), size * top
    return key


def before(x: np.ndarray) -> np.ndarray:
    """Of each token the value of the one before it."""
    return np.concatenate([np.zeros(min(1, len(x)), x.dtype), x[:-1]])


def reach(n: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The greatest divergence, in nats, of contexts with up to n occurrences whose suffix has up to ``suffix``.

    It grows with both, so it bounds every context that has this one in it: that occurs no more often, and nor does its suffix.
    """
    suffix = np.maximum(suffix.astype(np.float64), 1)
    m = np.maximum(np.minimum(n, suffix / np.e), 1e-9)
    return m * np.log(suffix / m)


def promising(n: np.ndarray, suffix: np.ndarray, some: np.ndarray, least: int, nats: float) -> np.ndarray:
    """Whether contexts, of those that ``some`` marks, or longer ones around them can be kept."""
    out = (n >= least) & some
    at = np.flatnonzero(out)
    # sums of gains are rounded, by far less than a thousandth
    out[at] = reach(n[at], suffix[at]) >= nats - 1e-3
    return out


class Asked:
    """What a block asks about contexts of ``length`` words, in the order in which it is asked."""

    def __init__(self, b: Block, length: int, all_tokens: int, least: int, nats: float, split: int, buckets: int):
        self.b, self.buckets = b, buckets
        self.n = before(b.g[length - 1])
        self.n[b.pos < length] = 0
        above = before(b.g[length - 2]) if length > 1 else np.full(len(self.n), all_tokens, np.float32)
        self.promising = lambda n, suffix, some: promising(n, suffix, some, least, nats)
        self.active = self.promising(self.n, above, b.many[length - 1])
        #: For each active token its context's number here; for each asked one its pair's.
        self.at = at = np.flatnonzero(self.active)
        train, suffix_pair, n = b.train[at], b.g[length - 1][at], self.n[at]
        self.known = known = np.where(train, suffix_pair == 1, suffix_pair == 0)
        rank = np.empty(len(b.words), np.uint32)
        rank[np.argsort(b.words)] = np.arange(len(b.words))
        columns = [rank[b.word_of[at - 1 - j]] for j in range(length)]
        x = b.words[b.word_of[at]].astype(np.uint32)
        # a context beyond ``split`` is dealt out by its next words
        parts = np.maximum(np.ceil(n / split), 1).astype(np.int64)
        if (parts > 1).any():
            columns.append((mix(x.astype(U64)) >> U64(33)).astype(np.int64) % parts)
        _, one, of = grouped(packed(columns))
        split_at = np.flatnonzero(parts[one] > 1)
        part = columns[-1][one[split_at]].astype(U64)
        columns = [b.words[b.word_of[at[one] - 1 - j]] for j in range(length)]
        under, h = U64(0), hashed(U64(0), columns[0])
        for far in columns[1:]:
            under, h = h, hashed(h, far)
        suffix = above[at[one]].astype(np.float32)
        # contexts with one suffix share a bucket, so that it is named once; one that occurs often is dealt out by their first words
        shares = np.maximum(np.ceil(suffix / max(split // 16, 1)), 1).astype(U64)
        home = hashed(under, columns[-1] % shares)
        home[split_at] = hashed(h[split_at], part)
        bucket = (mix(home) >> U64(33)).astype(np.int64) % buckets
        bucket[split_at] += buckets
        # within a bucket contexts keep the order of their words
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 15 else bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = of = rank[of]
        self.bucket, self.keys, self.suffix = bucket[order], h[order], suffix[order]
        #: Words of contexts from the last to the first as a tree: of each depth, where nodes begin and their words.
        self.levels, fresh = [], np.diff(self.bucket, prepend=-1) > 0
        for j, words in enumerate(columns):
            words = words[order].astype(np.uint32)
            fresh = fresh | (words != before(words)) if j + 1 < length else np.ones(len(words), bool)
            start = np.flatnonzero(fresh)
            self.levels.append((start, words[start]))
        self.pairs, one, self.pair_of = grouped((of[~known].astype(U64) << U64(32)) | x[~known].astype(U64))
        self.suffix_pair = suffix_pair[~known][one]
        self.context = (self.pairs >> U64(32)).astype(np.int64)
        self.per = np.bincount(self.context, minlength=len(order)).astype(np.uint32)
        self.pair_ends = np.append(0, np.cumsum(self.per, dtype=np.int64))
        self.full, cut = np.unique(self.bucket, return_index=True)
        self.cut = np.append(cut, len(order))

    def table(self, turn: int = 0, turns: int = 1) -> pa.Table:
        """Requests to buckets of a turn; contexts that are dealt out have the first, as their parts are summed."""
        train, n = self.b.train[self.at], len(self.keys)
        single = np.bincount(self.of[self.known], train[self.known], n).astype(np.uint32)
        count = np.bincount(self.pair_of, train[~self.known], len(self.pairs)).astype(np.uint32)
        of_suffix = np.where(count > 0, self.suffix_pair, 0).astype(np.float32)
        gone = np.rint(total(self.context, lost(count, of_suffix), n) * FINE).astype(np.int64)
        rows, buckets = [], []
        for i in np.flatnonzero(np.where(self.full < self.buckets, self.full % turns, 0) == turn).tolist():
            buckets.append(self.full[i])
            c = slice(self.cut[i], self.cut[i + 1])
            p = slice(self.pair_ends[c.start], self.pair_ends[c.stop])
            tree, above = [], self.cut[i : i + 1]
            for j, (start, word) in enumerate(self.levels):
                r = slice(*np.searchsorted(start, (c.start, c.stop)))
                below = np.diff(np.searchsorted(start[r], above), append=r.stop - r.start).astype(np.uint32)
                tree += [below, steps(word[r], below)]
                suffix, above = self.suffix[above], start[r]
            per = self.per[c]
            few = per < FEW
            x, near = steps(self.pairs[p].astype(np.uint32), per), of_suffix[p][np.repeat(few, per)]
            rows.append(pack(suffix, single[c], per, x, count[p], near, gone[c][~few], *tree))
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "block": pa.array([self.b.name] * len(rows), pa.string()), "data": pa.array(rows, pa.binary())})

    def answered(self, buckets: list[int], replies: list[bytes]) -> int:
        """Write the answers to the block's file of this length; the number of tokens of which the next length asks."""
        b, n_contexts = self.b, len(self.keys)
        kinds, kept, count = np.zeros(n_contexts, np.float32), np.zeros(n_contexts, bool), np.zeros(len(self.pairs), np.float32)
        place = {int(x): i for i, x in enumerate(self.full)}
        for bucket, data in zip(buckets, replies):
            i = place[bucket]
            c = slice(self.cut[i], self.cut[i + 1])
            kinds[c], kept[c], count[self.pair_ends[c.start] : self.pair_ends[c.stop]] = unpack(data)
        g = np.where(self.n < 2, b.train, np.where(b.g[-1] > 0, self.n, 0)).astype(np.float32)
        g[self.at] = np.where(self.known, b.train[self.at], 0)
        g[self.at[~self.known]] = count[self.pair_of]
        by_word = len(b.g) == 1
        many, held = np.zeros(len(b.words) if by_word else len(g), bool), np.zeros(len(b.words) if by_word else len(g), np.float32)
        at = before(b.word_of)[self.at] if by_word else self.at
        many[at] = kinds[self.of] >= 2
        held[at] = np.where(kept, kinds, 0)[self.of]
        put(b.folder, f"{b.name}-{len(b.g) + 1}", pack(g, many, held))
        b.add(g, many, None)
        asks = b.many[-1] & (b.pos >= len(b.g))
        return int(self.promising(g, b.g[-2], np.append(asks[1:], False)).sum())


REQUEST, REPLY, TOLD = "bucket long, block string, data binary", "block string, bucket long, data binary", "block string, active long"
REPLIED = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("data", pa.binary())])
PART = pa.schema([(c, pa.int64()) for c in ("context", "n", "kinds", "gain", "bucket")])


class Merged:
    """All requests of a bucket: distinct contexts (or their parts) and their next words."""

    def __init__(self, t: pa.Table):
        self.blocks = t.column("block").to_pylist()
        rows = []
        for d in t.column("data").to_pylist():
            suffix, single, per, x, n, near, gone, *tree = unpack(d)
            under, h = None, np.zeros(1, U64)
            for below, word in zip(tree[::2], tree[1::2]):
                under, h = below, hashed(np.repeat(h, below), summed(word, below).astype(U64))
            few = per < FEW
            of = np.repeat(np.arange(len(per)), per)
            named = few[of]
            less = total(of[named], lost(n[named], near), len(per))
            less[~few] = gone / FINE
            rows.append((h, np.repeat(suffix, under), single, less, per, summed(x, per), n))
        self.sizes = [(len(r[0]), len(r[5])) for r in rows]
        keys, suffix, single, less, per, x, n = (np.concatenate(c) for c in zip(*rows))
        self.contexts, first, self.of = grouped(keys)
        self.suffix = suffix[first].astype(np.float64)
        single = total(self.of, single, len(first))
        pair = (np.repeat(self.of, per).astype(U64) << U64(32)) | x
        self.pairs, _, self.pair_of = grouped(pair)
        self.count = total(self.pair_of, n, len(self.pairs))
        of = (self.pairs >> U64(32)).astype(np.int64)
        seen = self.count > 0
        self.n = single + total(of, self.count, len(first))
        self.kinds = single + total(of, seen, len(first))
        # a single word's own share is zero: it follows its context once and the suffix once
        gain = total(of, lost(self.count, self.count), len(first)) - total(self.of, less, len(first))
        self.gain = np.round(gain * (1 << 20)).astype(np.int64)

    def replies(self, bucket: int, kinds: np.ndarray, kept: np.ndarray) -> pa.Table:
        # of a context that isn't kept only matters whether it has two kinds
        out, c, p, kinds = [], 0, 0, np.where(kept, kinds, np.minimum(kinds, 2))
        for n_contexts, n_pairs in self.sizes:
            of = self.of[c : c + n_contexts]
            out.append(pack(kinds[of].astype(np.float32), kept[of], self.count[self.pair_of[p : p + n_pairs]].astype(np.float32)))
            c, p = c + n_contexts, p + n_pairs
        return pa.table({"block": pa.array(self.blocks, pa.string()), "bucket": pa.array([bucket] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})


def lost(n: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """n ln(n of the suffix's) for n occurrences of a next word, 0 for none."""
    return n * np.log(np.maximum(suffix, 1).astype(np.float64))


def diverges(n: np.ndarray, kinds: np.ndarray, gain: np.ndarray, suffix: np.ndarray, nats: float) -> np.ndarray:
    """Whether contexts are kept; ``gain`` is the sum of n ln(n / n of the suffix's) over next words, in 2^-20 nats."""
    some = np.maximum(n, 1)
    return (n > 0) & (gain / (1 << 20) + n * (np.log(np.maximum(suffix, 1)) - np.log(some)) >= nats * kinds)


def count_words(asked: DataFrame) -> DataFrame:
    """Answers to requests about words (counts, ranks within the bucket), and for each bucket a row without a block: its tokens and its kinds."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        rows = [unpack(d) for d in t.column("data").to_pylist()]
        words, of = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        count = np.bincount(of, np.concatenate([r[1] for r in rows]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
        cuts = np.cumsum([len(r[0]) for r in rows])[:-1]
        parts = zip(np.split(count[of], cuts), np.split(rank[of], cuts))
        sums = pack(np.array([count.sum(), (count > 0).sum()]))
        return pa.table({"block": pa.array([*t.column("block").to_pylist(), None], pa.string()), "bucket": pa.array([key[0].as_py()] * (len(rows) + 1), pa.int64()), "data": pa.array([*(pack(*x) for x in parts), sums], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(merge, REPLY)


def count_contexts(asked: DataFrame, buckets: int, nats: float) -> DataFrame:
    """Answers to requests about contexts."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return pa.Table.from_pylist([], REPLIED)
        m = Merged(t)
        return m.replies(key[0].as_py(), m.kinds, diverges(m.n, m.kinds, m.gain, m.suffix, nats))

    def part(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < buckets:
            return pa.Table.from_pylist([], PART)
        m = Merged(t)
        return pa.table({"context": m.contexts.view(np.int64), "n": m.n.astype(np.int64), "kinds": m.kinds.astype(np.int64), "gain": m.gain, "bucket": np.full(len(m.n), key[0].as_py())})

    def merge_parts(key: tuple, t: pa.Table, sums: pa.Table) -> pa.Table:
        if key[0].as_py() < buckets:
            return pa.Table.from_pylist([], REPLIED)
        m = Merged(t)
        known = sums.column("context").to_numpy().view(U64)
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], m.contexts)]
        n, kinds, gain = (sums.column(c).to_numpy()[at] for c in ("n", "kinds", "gain"))
        return m.replies(key[0].as_py(), kinds, diverges(n, kinds, gain, m.suffix, nats))

    # all three read one exchange; buckets from ``buckets`` on hold the parts of contexts that are dealt out
    by_bucket = asked.groupBy("bucket")
    parts = by_bucket.applyInArrow(part, "context long, n long, kinds long, gain long, bucket long")
    sums = parts.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("n", "kinds", "gain")], F.collect_set("bucket").alias("buckets"))
    sums = sums.select("context", "n", "kinds", "gain", F.explode("buckets").alias("bucket"))
    return by_bucket.applyInArrow(merge, REPLY).union(by_bucket.cogroup(sums.groupBy("bucket")).applyInArrow(merge_parts, REPLY))


def score(docs: DataFrame, *, held_out, least: int = 2, nats: float = 4.0, depth: int = 6, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held_out`` maps an id to a flag."""
    spark = docs.sparkSession
    folder, block_bytes = fresh_path(spark, "suffix-tree"), BLOCK_BYTES
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    spread = max(partitions(spark), 1)

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write blocks of words; each attempt of a task has names of its own, and its rows name them."""
        ids, raw, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, raw, size
            w = Words(raw, fold=True)
            of = np.repeat(np.arange(len(raw)), w.lens)
            x = np.full(len(of) + len(raw), END, U64)
            x[np.arange(len(of)) + of] = w.hash
            train = np.array([i is not None and not held_out(i) for i in ids], bool)
            words, word_of, times = np.unique(x, return_inverse=True, return_counts=True)
            # frequent words have small numbers
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, word_of = words[order], rank[word_of]
            count = np.bincount(word_of, np.repeat(train, w.lens + 1), len(words)).astype(np.int64)
            name = uuid.uuid4().hex
            put(f"{folder}/blocks", f"{name}-0", pack(np.array(ids, object), w.lens + 1, train, word_of.astype(np.uint32)))
            put(f"{folder}/words", name, pack(words, count))
            ids, raw, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([len(x)], pa.int64())], names=["block", "tokens"])

        for b in sliced(batches, 500, 2 << 20):
            for i, t in zip(b.column(0).to_pylist(), texts(b)):
                ids.append(i)
                raw.append(t)
                size += len(t) + 8
                if size >= block_bytes:
                    yield close()
        if ids:
            yield close()

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # each job leaves a table and no shuffle files; the table before it goes
    with tidy(spark):
        names = held(plain.mapInArrow(open_blocks, "block string, tokens long"), "names")
        n_blocks, all_held = names.agg(F.count("*"), F.sum("tokens")).first()
        if not n_blocks:
            remove(spark, folder)
            return spark.createDataFrame([], schema)
        buckets = max(spread, n_blocks // 2)

        def dealt(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of words by bucket, the buckets that have some, and where those begin."""
            bucket = (words >> U64(33)).astype(np.int64) % buckets
            order = np.lexsort((words, bucket))
            return order, *np.unique(bucket[order], return_index=True)

        def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in b.column(0).to_pylist():
                    words, count = unpack(fetch(f"{folder}/words", name))
                    order, full, cut = dealt(words)
                    parts = np.split(order, cut[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([name] * len(full), pa.string()), pa.array([pack(words[o], count[o]) for o in parts], pa.binary())], names=["bucket", "block", "data"])

        def number_words(key: tuple, t: pa.Table) -> pa.Table:
            """Write counts and numbers of a block's words; those of frequent words are small."""
            name = key[0].as_py()
            order, full, cut = dealt(unpack(fetch(f"{folder}/words", name))[0])
            place, count, number = dict(zip(full.tolist(), np.split(order, cut[1:]))), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for bucket, d in zip(t.column("bucket").to_pylist(), t.column("data").to_pylist()):
                n, rank = unpack(d)
                count[place[bucket]], number[place[bucket]] = n, rank.astype(np.int64) * buckets + bucket
            if int(number.max()) >> 32:
                raise OverflowError("words have numbers beyond 2^32")
            put(f"{folder}/blocks", f"{name}-1", pack(count, number.astype(np.uint32)))
            return pa.table({"block": [name], "active": [len(order)]})

        replies = held(count_words(names.repartition(spread).mapInArrow(ask_words, REQUEST)), "answers-0")
        sums = replies.where("block is null").select("data").toLocalIterator()
        all_tokens, all_kinds = (int(x) for x in np.sum([unpack(r.data)[0] for r in sums], axis=0))
        told = held(replies.where("block is not null").groupBy("block").applyInArrow(number_words, TOLD), "told-0")
        remove(spark, f"{folder}/words")
        remove(spark, f"{folder}/answers-0")

        def asked(name: str, length: int) -> Asked:
            return Asked(Block(f"{folder}/blocks", name, length), length, all_tokens, least, nats, split, buckets)

        def ask(length: int, turn: int, turns: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for name in b.column(0).to_pylist():
                        yield from asked(name, length).table(turn, turns).to_batches()

            return told.where("active > 0").select("block").repartition(spread).mapInArrow(run, REQUEST)

        def answer(length: int):
            def run(key: tuple, t: pa.Table) -> pa.Table:
                active = asked(key[0].as_py(), length).answered(t.column("bucket").to_pylist(), t.column("data").to_pylist())
                return pa.table({"block": [key[0].as_py()], "active": [active]})

            return replies.groupBy("block").applyInArrow(run, TOLD)

        # requests and the answers before them are never stored together, nor requests of more than half of the tokens
        turns = 1
        for length in range(1, depth + 1):
            for turn in range(turns):
                replies = held(count_contexts(ask(length, turn, turns), buckets, nats), f"answers-{length}/turn={turn}")
            replies = spark.read.schema(replies.schema).parquet(f"{folder}/answers-{length}")
            told = held(answer(length), f"told-{length}")
            remove(spark, f"{folder}/answers-{length}")
            active = told.agg(F.sum("active")).first()[0]
            if not active:
                break
            turns = -(-2 * active // all_held)

        def finish_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    yield scored(f"{folder}/blocks", name, all_tokens, all_kinds)

        out = durable(names.repartition(spread).mapInArrow(finish_blocks, schema))
    remove(spark, folder)
    return out


def scored(folder: str, name: str, all_tokens: int, all_kinds: int) -> pa.RecordBatch:
    """Scores of a block's documents from all its files."""
    from pyarrow import fs

    b = Block(folder, name, 1)
    p = (b.count + ADD) / (all_tokens + ADD * (all_kinds + 1))
    base, p = np.log10(p)[b.word_of], p[b.word_of]
    files, root = store(folder)
    length = 2
    while files.get_file_info(f"{root}/{name}-{length}").type != fs.FileType.NotFound:
        b.add(*unpack(fetch(folder, f"{name}-{length}")))
        n, g, kinds = before(b.g[-2]), b.g[-1], b.kinds[-1].astype(np.float64)
        p = np.where(kinds > 0, (g + kinds * p) / np.maximum(n + kinds, 1), p)
        length += 1
    first = np.cumsum(b.lens) - b.lens
    sums = lambda x: pa.array(np.add.reduceat(x, first))
    cols = [pa.array(b.ids.tolist(), pa.int64()), pa.array(~b.trains), pa.array(b.lens, pa.int64()), sums((b.count[b.word_of] > 0).astype(np.int64)), pa.array([all_tokens] * len(b.lens), pa.int64()), sums(base), sums(np.log10(p))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
