"""Ranges of bytes of files in any store that pyarrow reaches, and folders that tasks fill in
two phases: each attempt writes to a place of its own, the commit moves what counts."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))
    return system, at.rstrip("/")


def found(path: str, suffix: str) -> list[str]:
    """Files with a suffix, the path itself or those of a folder and below, in order; what is
    being written is not seen."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and f"/{STAGING}" not in f.path)


class Bytes:
    """A file of which ranges are read."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file, self.taken = system.open_input_file(path), 0

    def __call__(self, begin: int, size: int) -> bytes:
        data = self.file.read_at(size, begin)
        self.taken += len(data)
        if len(data) < size:
            raise ValueError(f"the file ends after {begin + len(data)} bytes")
        return bytes(data)

    def size(self) -> int:
        return self.file.size()


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    """Takes what ``files(rows)`` of a subclass gives, (name, bytes) one at a time, to a folder."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, at = opened(self.path)
        context = TaskContext.get()
        attempt = f"{at}/{STAGING}-{self.run}/{context.taskAttemptId()}"
        out = Written()
        for name, data in self.files(iterator, context.partitionId()):
            system.create_dir(attempt, recursive=True)
            with system.open_output_stream(f"{attempt}/{name}") as f:
                f.write(data)
            out.files.append(f"{attempt}/{name}")
        return out

    def commit(self, messages: list) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        fresh = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(at)):
                if f"{STAGING}-" not in info.path:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for f in fresh:
            system.move(f, f"{at}/{posixpath.basename(f)}")
        self._clean(system, at)

    def abort(self, messages: list) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: fs.FileSystem, at: str) -> None:
        staging = f"{at}/{STAGING}-{self.run}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class WholeFiles(FolderWriter):
    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        for row in rows:
            yield row.name, bytes(row.content)


class FilesSource(DataSource):
    """A sink for rows (name, content), each a file."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return WholeFiles(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    files.sparkSession.dataSource.register(FilesSource)
    files.select("name", "content").write.format("files").mode(mode).save(path)
