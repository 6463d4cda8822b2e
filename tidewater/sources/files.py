"""Files written by tasks, and a claim that lets one writer at a time publish.

`write_files` is a Python data source: each task writes its files below a staging folder with names of its own, so tasks
that run twice do no harm; the driver moves them to their places once all tasks are done, and removes them if one failed.
A task that still runs then may leave a file in a folder whose name starts with .staging.
The files' place must be a file system that pyarrow opens by its URI (a local or mounted path, S3, GCS, HDFS with libhdfs).

A claim is a small file that Hadoop's file system creates only where there is none. Its writer touches it while it works.
A claim not touched for a while is what a killed writer left: it is taken over, and the leavings are removed.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def relative(name: str) -> str:
    """The name, if it is a path that stays in its folder; else ValueError."""
    p = PurePosixPath(str(name).replace("\\", "/"))
    if p.is_absolute() or ".." in p.parts or not p.parts or "\x00" in str(name) or ":" in p.parts[0]:
        raise ValueError(f"path leaves its folder: {name}")
    return str(p)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int]] = field(default_factory=list)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f".staging-{uuid.uuid4().hex}"

    def _at(self):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else FileSystem.from_uri(f"file://{self.path}")
        return fs, base

    def write(self, iterator: Iterator) -> Written:
        fs, base = self._at()
        own, out = f"{base}/{self.staging}/{uuid.uuid4().hex}", Written()
        for i, row in enumerate(iterator):
            if not i:
                fs.create_dir(own)
            temporary = f"{own}/{i}"
            with fs.open_output_stream(temporary) as f:
                f.write(bytes(row["content"]))
            out.files.append((temporary, relative(row["name"]), len(row["content"])))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, base = self._at()
        files = [f for m in messages if m for f in m.files]
        try:
            names = [n for _, n, _ in files]
            if len(set(names)) < len(names):
                raise ValueError("two rows name one file")
            there = [x.path for x in fs.get_file_info([f"{base}/{n}" for n in names]) if x.type != FileType.NotFound]
            if there:
                raise ValueError(f"files exist: {sorted(there)[:3]}")
            for temporary, name, _ in files:
                fs.create_dir(str(PurePosixPath(base) / PurePosixPath(name).parent))
                fs.move(temporary, f"{base}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, base = self._at()
        if fs.get_file_info(f"{base}/{self.staging}").type != FileType.NotFound:
            fs.delete_dir(f"{base}/{self.staging}")


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewater_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows need a name and a content")
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Write a file below path for each row (name, content); names are unique and none of the files exists yet."""
    spark = rows.sparkSession
    spark.dataSource.register(FilesSource)
    rows.select("name", "content").write.format("tidewater_files").mode("append").option("path", path).save()


class Busy(RuntimeError):
    """Another writer is at work."""


class Claim:
    """The right to publish at a path, for one writer: a context manager."""

    def __init__(self, spark: SparkSession, path: str, stale_after: float = 600.0):
        self.spark, self.path, self.stale_after = spark, path.rstrip("/"), stale_after
        self.jvm, self.writer = spark._jvm, uuid.uuid4().hex
        parent, _, name = self.path.rpartition("/")
        self.parent, self.file, self.base = parent, f"{parent}/.{name}.claim", name
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.over = threading.Event()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def staging(self, writer: str | None = None) -> str:
        return f"{self.parent}/.{self.base}.{writer or self.writer}"

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self._path(a), self._path(b))

    def _create(self) -> bool:
        self.fs.mkdirs(self._path(self.parent))
        text = json.dumps({"writer": self.writer}).encode()
        if self.fs.getScheme() == "file":  # Hadoop looks first and creates then; the system call does both at once
            try:
                at = os.open(self._path(self.file).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            os.write(at, text)
            os.close(at)
            return True
        try:
            out = self.fs.create(self._path(self.file), False)
        except Exception as e:  # the file system's own way to say that there is one
            if "AlreadyExists" not in str(e):
                raise
            return False
        out.write(bytearray(text))
        out.close()
        return True

    def _holder(self, file: str) -> str | None:
        try:
            stream = self.fs.open(self._path(file))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return json.loads(text)["writer"]
        except (ValueError, KeyError):  # killed before its name was written
            return None

    def _age(self) -> float:
        return time.time() - self.fs.getFileStatus(self._path(self.file)).getModificationTime() / 1000

    def _take_over(self) -> None:
        """Move a stale claim aside; only one of several writers can. Another's fresh claim is put back."""
        stale = self._holder(self.file)
        aside = f"{self.file}.{self.writer}"
        if not self.rename(self.file, aside):
            return
        if self._holder(aside) != stale:
            self.rename(aside, self.file)
            return
        if stale:
            self.delete(self.staging(stale))
        self.delete(aside)

    def __enter__(self) -> "Claim":
        if not self._create():
            try:
                if self._age() > self.stale_after:
                    self._take_over()
            except Exception as e:
                if "FileNotFound" not in str(e):
                    raise
            if not self._create():
                raise Busy(f"another writer publishes {self.path}")
        threading.Thread(target=self._touch, daemon=True).start()
        return self

    def _touch(self) -> None:
        while not self.over.wait(max(self.stale_after / 4, 0.05)):
            try:
                self.fs.setTimes(self._path(self.file), int(time.time() * 1000), -1)
            except Exception:  # taken over, or gone with the session: commit() looks again
                return

    def commit(self) -> None:
        """Move the staging folder to its place, if the claim is still this writer's."""
        if not self.exists(self.file) or self._holder(self.file) != self.writer:
            raise Busy(f"the claim on {self.path} was lost")
        if self.exists(self.path):
            self.delete(self.path)  # what a writer without claims left unfinished
        if not self.rename(self.staging(), self.path):
            raise OSError(f"cannot move the staging folder to {self.path}")

    def __exit__(self, *_) -> None:
        self.over.set()
        self.delete(self.staging())
        if self.exists(self.file) and self._holder(self.file) == self.writer:
            self.delete(self.file)
