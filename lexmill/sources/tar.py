"""The ``tarmembers`` data source: a row per regular file of tar archives, plain or gzip, one task per archive.

Options: ``path`` (an archive or a folder), ``suffix`` (of archives in a folder, ``.tar,.tar.gz,.tgz`` by default) and ``form_types`` (comma-separated; a
member whose name doesn't hold one of these is passed over before its body is read, as predicates of a regular expression or a semi-join can't be
pushed into a source). Equality and prefix filters on ``member`` are pushed. Archives that can't be read give a row with ``error`` set, after
the members that could be read (all of them, where only the checksum at the end doesn't fit); the others go on. Paths may be local or URIs.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import tarfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

NAME = re.compile(r"^\d{8}_(.*?)_\d+_\d+\.txt$")


#: What reading a broken archive raises.
BROKEN = (tarfile.TarError, OSError, EOFError, zlib.error)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it: local, or by the URI's scheme (hdfs, s3, gs, file)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@contextmanager
def opened(path: str) -> Iterator[io.BufferedIOBase]:
    """A stream of a plain or gzip file's content; a gzip's checksum is verified where the reader comes to its end."""
    files, inside = filesystem(path)
    with files.open_input_stream(inside, compression=None) as head:
        zipped = head.read(2) == b"\x1f\x8b"
    with files.open_input_stream(inside, compression=None) as raw:
        if zipped:
            with gzip.GzipFile(fileobj=raw) as plain:
                yield plain
        else:
            yield raw


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffix", ".tar,.tar.gz,.tgz").split(","))
        listed = options.get("form_types")
        self.form_types = None if listed is None else frozenset(t.strip().replace("/", "-") for t in listed.split(","))
        self.equal: list[str] = []
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("member",):
                self.equal.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("member",):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        files, path = filesystem(self.path)
        if files.get_file_info(path).type == fs.FileType.File:
            return [Archive(self.path)]
        found = files.get_file_info(fs.FileSelector(path))
        return [Archive(f"{self.path.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(self.suffixes)]

    def _wanted(self, name: str) -> bool:
        if any(name != v for v in self.equal) or not all(name.startswith(p) for p in self.prefixes):
            return False
        if self.form_types is None:
            return True
        found = NAME.match(os.path.basename(name))
        return bool(found) and found.group(1) in self.form_types

    def read(self, partition: Archive) -> Iterator[tuple]:
        archive = os.path.basename(partition.path)
        try:
            with opened(partition.path) as plain:
                with tarfile.open(fileobj=plain, mode="r|") as tar:
                    for member in tar:
                        name = member.name.lstrip("./")
                        if member.isfile() and self._wanted(name):
                            yield archive, name, member.size, tar.extractfile(member).read(), None
                while plain.read(1 << 20):  # to the end, where the checksum stands
                    pass
        except BROKEN as error:
            yield archive, None, None, None, f"{type(error).__name__}: {error}"


class TarMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarmembers"

    def schema(self) -> str:
        return "archive string, member string, size bigint, content binary, error string"

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))


class IntegrityReader(TarReader):
    """Reads each archive to its end, in order: decompression, members, digest; the first that fails is reported."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from filters

    def read(self, partition: Archive) -> Iterator[tuple]:
        failed, digest, members = None, hashlib.sha256(), 0
        try:
            files, path = filesystem(partition.path)
            with files.open_input_stream(path, compression=None) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            failed = "gzip"
            with opened(partition.path) as f:
                while f.read(1 << 20):
                    pass
            failed = "tar"
            with opened(partition.path) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
                members = sum(1 for _ in tar)
            failed = None
        except BROKEN as error:
            failed = failed or type(error).__name__
        yield os.path.basename(partition.path), failed is None, failed, members, digest.hexdigest()


class ArchiveIntegrity(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archiveintegrity"

    def schema(self) -> str:
        return "archive string, sound boolean, failed string, members bigint, sha256 string"

    def reader(self, schema) -> IntegrityReader:
        return IntegrityReader(dict(self.options))


def register(spark) -> None:
    for source in (TarMembers, ArchiveIntegrity):
        spark.dataSource.register(source)
