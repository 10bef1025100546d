"""A data source of media files in a mounted folder: listed by folders, read in chunks, links skipped."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that are held at once.
CHUNK = 1 << 20
#: Bytes that tell what a file is.
HEAD = 8


class Folder(InputPartition):
    """One folder: its own files or, if ``deep``, all that lies under it."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _broken(path: str, error: OSError) -> tuple:
    return path, None, None, None, None, error.strerror or type(error).__name__


def read_file(path: str) -> tuple:
    """A row of a file; memory does not depend on its size."""
    try:
        stat = os.stat(path, follow_symlinks=False)
        digest, head = hashlib.sha256(), b""
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                head = head or chunk[:HEAD]
                digest.update(chunk)
        return path, stat.st_size, stat.st_mtime_ns, head, digest.hexdigest(), None
    except OSError as e:
        return _broken(path, e)


class MediaReader(DataSourceReader):
    def __init__(self, root: str, wanted: int, excluded: frozenset[str], pattern: str):
        self.root, self.wanted, self.excluded, self.pattern = root, wanted, excluded, pattern

    def _inside(self, folder: str) -> list[str]:
        """Folders right under one, without links and excluded ones; none if it cannot be listed, which its own task reports."""
        try:
            with os.scandir(folder) as entries:
                return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.path not in self.excluded)
        except OSError:
            return []

    def partitions(self) -> list[Folder]:
        """Level by level until there are enough folders; those of the last level are read with all that is under them."""
        level, out = [self.root] if self.root not in self.excluded else [], []
        while level and len(out) + len(level) < self.wanted:
            out += [Folder(f, False) for f in level]
            level = [g for f in level for g in self._inside(f)]
        return out + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        work = [partition.path]
        while work:
            folder = work.pop()
            try:
                with os.scandir(folder) as entries:
                    files = sorted(e.path for e in entries if e.is_file(follow_symlinks=False) and re.search(self.pattern, e.name))
            except OSError as e:
                yield _broken(folder, e)
                continue
            yield from map(read_file, files)
            if partition.deep:
                work += self._inside(folder)


class MediaFiles(DataSource):
    """``spark.read.format("media_files").load(root)``. Options: ``folders`` (partitions wanted), ``excluded`` (a JSON list of folders), ``pattern`` (of names)."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "path string, size bigint, mtime_ns bigint, head binary, sha256 string, error string"

    def reader(self, schema) -> MediaReader:
        from tallyweave.sources.inventory import EXTENSIONS

        plain = lambda p: os.path.abspath(p.removeprefix("file://"))
        excluded = frozenset(map(plain, json.loads(self.options.get("excluded", "[]"))))
        return MediaReader(plain(self.options["path"]), int(self.options.get("folders", 256)), excluded, self.options.get("pattern", EXTENSIONS))
