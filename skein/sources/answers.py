"""Search backends as data sources: saved answers under a folder, read with pruning, and a reader for each backend.

``spark.read.format("saved_answers").load(folder)`` gives (backend, key, body), a partition for each file. Filters on
backend and key are taken over by the source: other backends' files and other parts of the keys are never opened.
A backend is a function from answers (key, body) to search rows; more are added with :func:`register_backend`."""

from __future__ import annotations

import json
import posixpath
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from ..operators.ranking import shared_folder
from . import registries as R

FORMAT, SCHEMA = "saved_answers", "backend string, key string, body string"
ARROW = pa.schema([("backend", pa.string()), ("key", pa.string()), ("body", pa.string())])
#: Where a file lies: its backend and which part of how many of the keys.
PLACE = re.compile(r"/backend=([^/]+)/part=(\d+)-of-(\d+)/[^/_.][^/]*$")
#: Rows of a batch, and bytes after which a batch is closed.
ROWS, BYTES = 1000, 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address and the path in it."""
    if re.match(r"^(file:)?/+", path):
        return pafs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def part_of(key: str, parts: int) -> int:
    return zlib.crc32(key.encode()) % parts


@dataclass
class AnswerFile(InputPartition):
    path: str
    backend: str


class AnswersReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.backends: set[str] | None = None
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership on backend and key, and what goes with them; gives back the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in ("backend", "key") or not isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)):
                yield f
            elif not isinstance(f, IsNotNull):  # neither column is ever null
                name = "backends" if column == "backend" else "keys"
                wanted, held = set(f.value if isinstance(f, In) else [f.value]), getattr(self, name)
                setattr(self, name, wanted if held is None else held & wanted)

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.folder)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            place = PLACE.search(info.path) if info.is_file else None
            if place is None:
                continue
            backend, part, parts = place[1], int(place[2]), int(place[3])
            if self.backends is not None and backend not in self.backends:
                continue
            if self.keys is not None and not any(k is not None and part_of(k, parts) == part for k in self.keys):
                continue
            out.append(AnswerFile(info.path, backend))
        return sorted(out, key=lambda f: f.path) or [AnswerFile("", "")]  # none is an error to Spark

    def read(self, file: AnswerFile) -> Iterator[pa.RecordBatch]:
        if not file.path:
            return
        fs, _ = filesystem(self.folder)
        held, size = [], 0
        with fs.open_input_stream(file.path) as stream, pa.input_stream(stream) as lines:
            for line in _lines(lines):
                row = json.loads(line)
                if self.keys is None or row["key"] in self.keys:
                    held.append((file.backend, row["key"], row["body"]))
                    size += len(line)
                if len(held) >= ROWS or size >= BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(1 << 20):
        *whole, rest = (rest + data).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=ARROW)


class SavedAnswers(DataSource):
    """The source behind ``spark.read.format("saved_answers").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AnswersReader:
        return AnswersReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. Spark refuses sources that take filters unless the session allows them
    to, so this is set as well."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedAnswers)


def save(answers: DataFrame, folder: str, parts: int = 16) -> None:
    """Writes (backend, key, body) as JSON lines in a folder for each backend and part of the keys. Rows without a
    backend, key or body are no answers. A large part is split into several files."""
    rows = answers.select("backend", "key", "body").filter("backend is not null and key is not null and body is not null")
    part = F.concat((F.crc32(F.col("key").cast("binary")) % parts).cast("string"), F.lit(f"-of-{parts}"))
    rows.withColumn("part", part).hint("rebalance", "backend", "part").write.mode("append").partitionBy("backend", "part").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The saved answers (backend, key, body) of a folder."""
    register(spark)
    return spark.read.format(FORMAT).load(folder)


Backend = Callable[[DataFrame], DataFrame]
BACKENDS: dict[str, Backend] = {}
ROW = {"name": "''", "version": "''", "description": "''", "registry_url": "''", "stars": "0L", "downloads": "0L", "last_commit": "''", "license_name": "''", "score": "0.0D", "has_more": "false"}


def register_backend(name: str, rows: Backend) -> None:
    """Adds a backend, or replaces the one of that name."""
    BACKENDS[name] = rows


def default_backends(as_of: str, now_ms: int, versions: DataFrame) -> dict[str, Backend]:
    """The eight registries and the search of repositories. Ages count from ``as_of`` and ``now_ms``; ``versions`` (port, version) goes with vcpkg."""
    return {
        "javascript": lambda a: R.npm(a, "key", "body", as_of), "rust": lambda a: R.crates(a, "key", "body"), "java": lambda a: R.maven(a, "key", "body", now_ms), "kotlin": lambda a: R.maven(a, "key", "body", now_ms, kotlin_first=True),
        "c_cpp": lambda a: R.vcpkg(a, "key", "body", versions), "php": lambda a: R.packagist(a, "key", "body"), "go": lambda a: R.module_pages(a, "key", "body", as_of), "python": lambda a: R.snippet_pages(a, "key", "body"), "github": lambda a: R.repositories(a, "key", "body", as_of),
    }


def search_rows(spark: SparkSession, folder: str, backends: dict[str, Backend]) -> DataFrame:
    """The search rows (backend, key, position, then ``ROW``) of all backends' answers. Fields that a backend doesn't give are
    empty, 0 or false. A filter on backend leaves one branch, a filter on key reaches every branch's source.

    Each branch loads the folder for itself: Spark keeps the filters that a Python source took with the loaded table, so
    two branches over one table would both be read under the filters of the latter."""

    def one(name: str, rows: Backend) -> DataFrame:
        found = rows(read(spark, folder).filter(F.col("backend") == name).select("key", "body"))
        return found.select(F.lit(name).alias("backend"), "key", F.col("position").cast("int").alias("position"), *(F.col(c) if c in found.columns else F.expr(v).alias(c) for c, v in ROW.items()))

    return reduce(DataFrame.unionByName, [one(n, b) for n, b in {**backends, **BACKENDS}.items()])


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the shared one."""
    return posixpath.join(shared_folder(spark), f"{name}-{uuid4().hex}")
