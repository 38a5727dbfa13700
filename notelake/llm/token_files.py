"""Token ids of a corpus in binary files: canonical length-limited Huffman codes from global counts.

File (little-endian): magic ``NLHF``, number of symbols, of documents, of segments and of data bytes, and of the corpus's
ids before this file (5 unsigned longs); the symbols and their code lengths; the documents' ids (signed longs, with a byte each that tells a null id) and their
numbers of ids; the bit length of each segment of 128 ids, whose running sums are the bit-offset checkpoints from which
segments are decoded on their own; the bits. Every file carries the code, so each can be read by itself.

Files are numbered so that their order, and the order of documents in them, is that of ascending doc_id; a file holds a
bounded number of encoded bytes. They are written under a temporary name and renamed, so a task that runs twice leaves
the same file. The numbers of ids before a file follow from sums of the tokenised table, which has one row for each
document and is dropped at the end; so reading joins and shuffles nothing.

Null texts are empty (the end id alone). Null ids come first. Rows with the same doc_id follow each other in the order of
their ids. An empty table gives no files. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_path, partitions, put, sliced, small_batches
from .huffman import SEGMENT, Code, ranges
from .tokens import encoder

MAGIC, LIMIT = b"NLHF", 20
#: Encoded bytes at which a file is closed.
FILE_BYTES = 8 << 20


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, spaces_kept: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32- or 16-bit integers, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces_kept)
        for b in sliced(batches, 1500):
            got = [np.append(x, np.uint32(end_id)) for x, _ in enc([t or "" for t in b.column(1).to_pylist()])]
            small = [not (x >> 16).any() for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u2" if s else "<u4").tobytes() for x, s in zip(got, small)], pa.binary()), pa.array(small), pa.array([len(x) for x in got], pa.int64())], names=["doc_id", "ids", "small", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, small boolean, n long")


def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2" if s else "<u4").astype(np.uint32) for x, s in zip(b.column("ids").to_pylist(), b.column("small").to_pylist())]


def global_counts(ids: DataFrame) -> Code:
    """The code of the whole corpus; the driver sees one row for each symbol of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in sliced(batches, 1500):
            if b.num_rows:
                got = np.bincount(np.concatenate(arrays(b)))
                if len(got) > len(total):
                    total = np.append(total, np.zeros(len(got) - len(total), np.int64))
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids", "small").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    return Code.of(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), LIMIT)


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 0, spaces_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files to the folder ``path`` and return what they hold: (file, n_docs, n_ids, first_id)."""
    spark = docs.sparkSession
    n = max(partitions(spark), 1)
    held = fresh_path(spark, "ids")
    store, p = folder(spark, path)
    store.mkdirs(p)
    with small_batches(spark):
        tokenised(docs, tokenizer, end_id, spaces_kept, id_col, text_col).write.option("compression", "zstd").parquet(held)
    ids = spark.read.parquet(held)
    code = spark.sparkContext.broadcast(global_counts(ids))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [1.0], max(10_000, 10 * n))).first()[0] or []
    at = np.array(sorted(set(cuts)), np.int64)

    def parts(b: pa.RecordBatch) -> np.ndarray:
        return np.searchsorted(at, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1)
        for b in sliced(batches, 1500):
            total += np.bincount(parts(b), b.column("n").to_numpy(), len(at) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.astype(np.int64))], names=["part", "n"])

    # one number for each range of ids, of which there are as many as shuffle partitions
    summed = dict(ids.select("doc_id", "n").mapInArrow(sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect())
    first_ids = [0, *np.cumsum([summed.get(i, 0) for i in range(len(at) + 1)]).tolist()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1500):
            part = parts(b)
            n = b.column("n").to_numpy()
            data, size, segments = code.value.pack(np.concatenate(arrays(b)), n)
            flat, ends = data.tobytes(), np.cumsum(size).tolist()
            cuts = np.append(0, np.cumsum(-(-n // SEGMENT))).tolist()
            bits, marks = [flat[e - s : e] for e, s in zip(ends, size.tolist())], [segments[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            cols = [b.column("doc_id"), pa.array(part, pa.int32()), b.column("n"), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "n", "bits", "segments"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, part, seq, first = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal rows, size, seq, first
            file, n = (part << 31) + seq, sum(r[1] for r in rows)
            put(path, f"{file:019d}.nlhf", pack_file(code.value, rows, first))
            got = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (file, len(rows), n, first)], names=["file", "n_docs", "n_ids", "first_id"])
            rows, size, seq, first = [], 0, seq + 1, first + n
            return got

        for b in sliced(batches, 1500):
            for doc, p, k, bits, segments in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (p != part or size >= FILE_BYTES):
                    yield close()
                if p != part:
                    part, seq, first = p, 0, first_ids[p]
                rows.append((doc, k, bits, segments))
                size += len(bits)
        if rows:
            yield close()

    coded = ids.mapInArrow(encode, "doc_id long, part int, n long, bits binary, segments binary")
    manifest = durable(coded.repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "n", "bits").mapInArrow(save, "file long, n_docs long, n_ids long, first_id long"))
    store, p = folder(spark, held)
    store.delete(p, True)
    return manifest


def pack_file(code: Code, rows: list[tuple], first: int) -> bytes:
    ids = np.array([r[0] or 0 for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], np.uint8)
    counts = np.array([r[1] for r in rows], "<u8")
    segments, bits = b"".join(r[3] for r in rows), b"".join(r[2] for r in rows)
    head = MAGIC + struct.pack("<5Q", len(code.symbols), len(rows), len(segments) // 2, len(bits), first)
    return b"".join([head, code.symbols.astype("<u4").tobytes(), code.lengths.astype(np.uint8).tobytes(), ids.tobytes(), null.tobytes(), counts.tobytes(), segments, bits])


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Documents' ids, their numbers of ids, all ids one after the other, and the number of ids before the file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    n_symbols, n_docs, n_segments, n_bits, before = struct.unpack("<5Q", data[4:44])
    at = 44

    def take(kind, n):
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    code = Code(take("<u4", n_symbols).astype(np.int64), take(np.uint8, n_symbols).astype(np.int64))
    docs, null, counts = take("<i8", n_docs), take(np.uint8, n_docs), take("<u8", n_docs).astype(np.int64)
    lengths, bits = take("<u2", n_segments).astype(np.int64), take(np.uint8, n_bits)
    # each document opens at a whole byte; within it segments follow each other
    per_doc = -(-counts // SEGMENT)
    of = np.repeat(np.arange(n_docs), per_doc)
    doc_bits = np.bincount(of, lengths, n_docs).astype(np.int64)
    doc_start = np.cumsum(-(-doc_bits // 8) * 8) - (-(-doc_bits // 8) * 8)
    inner = np.cumsum(lengths) - lengths
    starts = doc_start[of] + inner - (np.cumsum(doc_bits) - doc_bits)[of]
    sizes = np.minimum(counts[of] - ranges(per_doc) * SEGMENT, SEGMENT)
    return [None if x else int(d) for d, x in zip(docs, null)], counts, code.unpack(bits, starts, sizes), before


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                docs, counts, ids, before = unpack_file(content.as_py())
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                for lo in range(0, len(docs), 500):
                    part = range(lo, min(lo + 500, len(docs)))
                    cols = [pa.array([docs[i] for i in part], pa.int64()), pa.array((ends - counts)[lo : lo + 500] + before, pa.int64()), pa.array(counts[lo : lo + 500], pa.int64()), pa.array([ids[ends[i] - counts[i] : ends[i]].tobytes() for i in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def folder(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
