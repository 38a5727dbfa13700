"""Files of vaults as a DataFrame. The walk is the driver's; texts are read on the executors."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import glob_regex

IGNORE_FILE = ".notelakeignore"
EXTENSIONS = ("md", "markdown", "pdf")
SCHEMA = "vault_name string, path string, absolute string, mtime_ms long, file_size long"


def ignore_patterns(root: str) -> list[str]:
    """Lines of the vault's ignore file, without comments."""
    try:
        lines = Path(root, IGNORE_FILE).read_text().splitlines()
    except OSError:
        return []
    return [x for x in map(str.strip, lines) if x and not x.startswith("#")]


def walk(vaults: dict[str, str], *, extensions=EXTENSIONS, excludes=(), skip_hidden: bool = True, follow_links: bool = False):
    """(vault, path, absolute, mtime_ms, size) of each file to index. Hidden directories are pruned, hidden files stay."""
    import re

    for vault, root in sorted(vaults.items()):
        base = os.path.realpath(root)
        rules = [re.compile(g) for g in map(glob_regex, [*excludes, *ignore_patterns(root)]) if g]
        for top, dirs, names in os.walk(root, followlinks=follow_links):
            if follow_links:  # nothing outside the vault
                dirs[:] = [d for d in dirs if inside(os.path.join(top, d), base)]
            dirs[:] = sorted(d for d in dirs if not (skip_hidden and d.startswith(".")))
            for name in sorted(names):
                full = os.path.join(top, name)
                path = PurePosixPath(Path(full).relative_to(root)).as_posix()
                if name.rpartition(".")[2] not in extensions or "." not in name or any(r.match(path) for r in rules):
                    continue
                if os.path.islink(full) and not (follow_links and inside(full, base)):
                    continue
                stat = os.stat(full)
                yield vault, path, os.path.abspath(full), stat.st_mtime_ns // 1_000_000, stat.st_size


def inside(path: str, base: str) -> bool:
    return os.path.commonpath([os.path.realpath(path), base]) == base


def safe_path(root: str, relative: str) -> str:
    """A file of the vault by its relative path; absolute paths and steps out of the vault are refused."""
    if os.path.isabs(relative) or ".." in PurePosixPath(relative).parts or not inside(os.path.join(root, relative), os.path.realpath(root)):
        raise ValueError(f"not a path of this vault: {relative}")
    return os.path.join(root, relative)


def scan(spark: SparkSession, vaults: dict[str, str], **options) -> DataFrame:
    return spark.createDataFrame(list(walk(vaults, **options)), SCHEMA)


def read_texts(files: DataFrame, pdf=None, vision=None, least: int = 1) -> DataFrame:
    """``files`` with text, hash, error and vlm_hash: text that is no UTF-8, or a PDF without an extractor, is an error.

    ``pdf`` maps the bytes of a PDF to its text. Where that has fewer than ``least`` characters, ``vision``, a model that
    reads pictures of pages, maps the bytes to a text, and vlm_hash is the hash of the bytes it has read. Its failure is no
    error: the extractor's text stays. Files must be on storage that executors mount.
    """

    def run(batches):
        for b in batches:
            texts, hashes, errors, seen = [], [], [], []
            for name in b["absolute"]:
                try:
                    data = Path(name).read_bytes()
                    if name.endswith(".pdf") and pdf is None:
                        raise ValueError("no PDF extractor")
                    text, read = (pdf(data), None) if name.endswith(".pdf") else (data.decode(), None)
                    if name.endswith(".pdf") and vision is not None and len(text.strip()) < least:
                        try:
                            text, read = vision(data), hashlib.sha256(data).hexdigest()
                        except Exception:  # noqa: BLE001  the model is a hook
                            read = None
                    texts.append(text)
                    hashes.append(hashlib.sha256(text.encode()).hexdigest())
                    errors.append(None)
                    seen.append(read)
                except (OSError, ValueError) as e:
                    texts.append(None)
                    hashes.append(None)
                    errors.append(str(e))
                    seen.append(None)
            yield b.assign(text=pd.Series(texts, index=b.index, dtype=object), hash=pd.Series(hashes, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object), vlm_hash=pd.Series(seen, index=b.index, dtype=object))

    return files.mapInPandas(run, SCHEMA + ", text string, hash string, error string, vlm_hash string")
