"""Members of tar and zip archives as rows, with the reason why one may not be unpacked."""

from __future__ import annotations

import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, position long, member string, kind string, size long, link string, reason string"
_KINDS = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.DIRTYPE: "directory", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.CONTTYPE: "file"}
ENDINGS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".zip")


def refusal(member: str, kind: str) -> str | None:
    """absolute, traversal, link or special; null for what may be unpacked."""
    name = member.replace("\\", "/")
    if name.startswith("/") or name[1:3] == ":/":
        return "absolute"
    if posixpath.normpath(name).split("/")[0] == ".." or "\0" in name:
        return "traversal"
    return "link" if kind in ("symlink", "hardlink") else None if kind in ("file", "directory") else "special"


def members(path: str) -> Iterator[tuple]:
    """Rows of SCHEMA for one archive; one that can't be read to its end gives a last row of kind `broken`."""
    where, name = pafs.FileSystem.from_uri(path)
    at = 0
    try:
        if path.endswith(".zip"):
            with where.open_input_file(name) as raw, zipfile.ZipFile(raw) as z:
                for m in z.infolist():
                    mode = m.external_attr >> 16 & 0o170000
                    kind = "symlink" if mode == 0o120000 else "directory" if m.is_dir() else "file"
                    link = z.read(m).decode("utf-8", "replace") if kind == "symlink" else None
                    yield path, at, m.filename, kind, m.file_size, link, refusal(m.filename, kind)
                    at += 1
        else:
            # read as a stream: nothing is unpacked and nothing of a member is kept
            with where.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as t:
                for m in t:
                    kind = _KINDS.get(m.type, "special")
                    yield path, at, m.name, kind, m.size, m.linkname or None, refusal(m.name, kind)
                    at += 1
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
        yield path, at, None, "broken", None, None, f"unreadable: {type(e).__name__}"


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        where, name = pafs.FileSystem.from_uri(self.folder)
        info = where.get_file_info(name)
        found = [info] if info.is_file else where.get_file_info(pafs.FileSelector(name, recursive=True))
        head = self.folder[: len(self.folder) - len(name)] if self.folder.endswith(name) else ""
        return [_Archive(head + f.path if "://" in self.folder else f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(ENDINGS)]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        yield from members(partition.path)


class ArchiveMembers(DataSource):
    """`spark.read.format("archive_members").load(folder)`: a partition for each archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of SCHEMA for the members of all archives under `folder`, in any place that Arrow's file systems reach."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").load(folder)


def safe_archives(found: DataFrame) -> DataFrame:
    """Rows (archive, members, refused): an archive may be unpacked if none of its members is refused."""
    return found.selectExpr("archive", "reason").groupBy("archive").agg({"*": "count", "reason": "count"}).selectExpr("archive", "`count(1)` AS members", "`count(reason)` AS refused")
