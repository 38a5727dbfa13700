"""Tables of an index as immutable snapshots: changed parts are written first, then one new file names all parts.

A version is a file ``versions/<number>`` that lists for each table its folder, or for large tables a folder for each
bucket of files (by a hash of vault and path), so a commit writes the tables and buckets that changed and refers to the
rest. The greatest number is current. A number is claimed by a file that only one writer can create, and the version file
is complete when it gets its name, so a reader or a crash at any moment finds the old version or the new one, whole. Two
writers at once: the second fails and has changed nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 12
TABLES = {
    "files": "vault_name string, path string, hash string, mtime_ms long, model_id string, file_size long, backlink_count long, char_count long, vlm_hash string",
    "chunks": "chunk_id long, vault_name string, file_path string, chunk_index int, parent_header string, content string, tokenized_content string, tags string, frontmatter_date string, title string, emphasized_text string",
    "tasks": "vault_name string, file_path string, content string, checked boolean, line_number int",
    "names": "vault_name string, source string, name string",
    "links": "vault_name string, source string, target string",
    "vectors": "chunk_id long, embedding array<float>, vault_name string, file_path string",
    "postings": "term string, chunk_id long, tf long, positions array<int>, dl long, vault_name string, file_path string",
    "lengths": "chunk_id long, dl long, vault_name string, file_path string",
    "stats": "n_docs long, terms long",
    "usage": "ts timestamp, kind string, model_id string, texts long",
}
#: Tables that are kept by bucket, and what their files are sorted by within a bucket.
BUCKETED = {"chunks": ("vault_name", "file_path"), "tasks": ("vault_name", "file_path"), "vectors": ("vault_name", "file_path"), "postings": ("term",), "lengths": ("vault_name", "file_path")}


class Conflict(RuntimeError):
    """Another writer took the version."""


class Snapshots:
    """Snapshots under a root on any file system that Spark writes to; ``buckets`` holds for a new index."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.new_buckets = spark, root.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def version(self) -> int:
        """The current version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"schema_version": SCHEMA_VERSION, "buckets": self.new_buckets, "tables": {}}
        stream = self.fs.open(self._path(f"versions/{v:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self, manifest: dict | None = None, path: str = "file_path") -> Column:
        return F.pmod(F.xxhash64("vault_name", path), F.lit((manifest or self.manifest())["buckets"])).cast("int")

    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of one; columns that an older version lacks are null."""
        return self.read(name, self.manifest(version)["tables"].get(name), buckets)

    def read(self, name: str, held, buckets: list[int] | None = None) -> DataFrame:
        """What a manifest, or ``write``, names for a table."""
        if name in BUCKETED:
            paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted((held or {}).items()) if buckets is None or int(b) in buckets]
        else:
            paths = [f"{self.root}/data/{held}"] if held else []
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, rows: DataFrame):
        """Write rows of a table into a folder that no version names yet; returns what ``commit`` takes in their place."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows = rows.select(*[c.split()[0] for c in TABLES[name].split(", ") if c.split()[0] in rows.columns])
        if name not in BUCKETED:
            rows.write.parquet(f"{self.root}/data/{folder}")
            return folder
        rows = rows.withColumn("bucket", self.bucket())
        # even tasks in the order of the files, so that a reader of one term skips all row groups but its own
        writer = rows.repartitionByRange("bucket", *BUCKETED[name]).sortWithinPartitions("bucket", *BUCKETED[name]).write.partitionBy("bucket")
        (writer.option("parquet.block.size", 8 << 20) if name == "postings" else writer).parquet(f"{self.root}/data/{folder}")
        return {n.removeprefix("bucket="): folder for n in self._names(f"data/{folder}") if n.startswith("bucket=")}

    def commit(self, tables: dict[str, DataFrame], touched: list[int] | None = None, keep: int = 3) -> int:
        """Write tables (or take those that ``write`` wrote) and publish them with the rest of the current ones as the next version.

        Tables by bucket hold all rows of the ``touched`` buckets, or of all buckets if None. Versions before the last
        ``keep`` go, with the folders that only they name.
        """
        base = self.version()
        now = self.manifest(base)
        held = dict(now["tables"])
        for name, rows in tables.items():
            made = self.write(name, rows) if isinstance(rows, DataFrame) else rows
            held[name] = {b: f for b, f in held.get(name, {}).items() if touched is not None and int(b) not in touched} | made if name in BUCKETED else made
        return self._publish(now | {"tables": held, "schema_version": SCHEMA_VERSION}, base, keep)

    def _publish(self, manifest: dict, base: int, keep: int) -> int:
        claims = [int(n.removesuffix(".claim")) for n in self._names("versions") if n.endswith(".claim")]
        if self.version() != base:
            raise Conflict(f"version {self.version()} was written meanwhile")
        new = max([base, *claims]) + 1
        try:
            self.fs.create(self._path(f"versions/{new:012d}.claim"), False).close()
        except Exception as e:
            raise Conflict(f"version {new} is being written") from e
        temporary = self._path(f"versions/_{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(temporary, self._path(f"versions/{new:012d}")):
            raise Conflict(f"version {new} could not be published")
        all_ = self.versions()
        folders = lambda v: {f for t in self.manifest(v)["tables"].values() for f in (t.values() if isinstance(t, dict) else [t])}
        kept = set().union(*map(folders, all_[-keep:]))
        for old in all_[:-keep]:
            for folder in folders(old) - kept:
                self.fs.delete(self._path(f"data/{folder}"), True)
            self.fs.delete(self._path(f"versions/{old:012d}"), False)
            self.fs.delete(self._path(f"versions/{old:012d}.claim"), False)
        return new

    def rollback(self, version: int, keep: int = 3) -> int:
        """Make a kept version current again, as a new version."""
        if version not in self.versions():
            raise ValueError(f"version {version} is not kept")
        return self._publish(self.manifest(version), self.version(), keep)

    def compact(self) -> int:
        """Write the tables by bucket anew, each in one folder of few files."""
        return self.commit({n: self.table(n) for n in BUCKETED}, keep=1)

    def purge(self) -> int:
        """A version without rows; the number of buckets is chosen anew."""
        return self._publish({"schema_version": SCHEMA_VERSION, "buckets": self.new_buckets, "tables": {}}, self.version(), 1)

    def size(self) -> int:
        """Bytes of the kept versions."""
        return self.fs.getContentSummary(self._path("")).getLength() if self.version() else 0
