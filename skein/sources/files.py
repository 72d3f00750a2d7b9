"""A writer of one file per row: reports, tracks and skeletons under names of their own.

``rows.write.format("file_per_row").mode("append").save(folder)`` takes (name, content). Tasks write below a hidden folder
of the job; only when all of them are done are the files moved to their places, so a failed job leaves none. Files that
are there stay as they are; with the option ``force`` they are replaced."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .answers import filesystem

FORMAT = "file_per_row"


@dataclass
class Written(WriterCommitMessage):
    task: str
    names: list[str]


def checked(name: str | None) -> str:
    """A relative path that stays below its folder; anything else is an error, as no file may be lost or written elsewhere."""
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0] == "_temporary":
        raise ValueError(f"no name of a file: {name!r}")
    return name


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, force: bool):
        self.folder, self.force, self.job = folder, force, uuid4().hex

    def _job(self, root: str) -> str:
        return posixpath.join(root, "_temporary", self.job)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = filesystem(self.folder)
        task = posixpath.join(self._job(root), uuid4().hex)  # another for each attempt
        names = []
        for row in iterator:
            name = checked(row["name"])
            if not self.force and fs.get_file_info(posixpath.join(root, name)).type != pafs.FileType.NotFound:
                continue
            to = posixpath.join(task, name)
            fs.create_dir(posixpath.dirname(to), recursive=True)
            with fs.open_output_stream(to) as out:
                out.write((row["content"] or "").encode())
            names.append(name)
        return Written(task, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.folder)
        made = [(m.task, n) for m in messages if m is not None for n in m.names]
        for folder in {posixpath.dirname(posixpath.join(root, n)) for _, n in made}:
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(posixpath.join(*x), posixpath.join(root, x[1])), made))
        self._clean(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*filesystem(self.folder))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._job(root)).type != pafs.FileType.NotFound:
            fs.delete_dir(self._job(root))
        top = posixpath.join(root, "_temporary")
        if fs.get_file_info(top).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(top)):
            fs.delete_dir(top)


class FilePerRow(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema] != ["name", "content"]:
            raise ValueError("rows of (name, content) are written")
        return FilesWriter(self.options["path"], self.options.get("force", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilePerRow)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", force: bool = False) -> None:
    """Writes a file for each distinct name; of rows that share one the least content. Null contents are empty files."""
    register(rows.sparkSession)
    one = rows.groupBy(F.col(name).cast("string").alias("name")).agg(F.min(F.coalesce(F.col(content).cast("string"), F.lit(""))).alias("content"))
    one.write.format(FORMAT).mode("append").option("force", str(force).lower()).save(folder)
