"""An object store as a data source: listing by prefix, contents of wanted keys, and putting objects.

Objects are files below a root, their key the path from there. `objects` is a Spark data source that lists them: conditions on the path are
pushed into it, so that only folders that can hold a match are listed. They are dealt out to at most FOLDERS partitions, and listed where
these are processed. Contents are read for wanted keys alone, without a listing: a table of keys goes in, and tasks open what they have of it.

Roots are URIs that pyarrow knows (file, hdfs, s3, gs, abfs) or plain paths. Keys with a part that begins with a full stop are not
listed: that is where an object is before it is whole.
"""

from __future__ import annotations

import datetime
import posixpath
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

PUSHED = "spark.sql.python.filterPushdown.enabled"
#: Folders are opened on the driver until there are so many, and a listing has no more partitions; objects and bytes of a batch.
FOLDERS, ROWS, BYTES = 256, 4096, 4 << 20


def system(root: str):
    """(pyarrow file system, path) of a root."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/").rstrip("/")
    found, path = fs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


class Folder(NamedTuple):
    """A part of a listing: one folder, by itself or with all below it."""

    path: str
    deep: bool


class Folders(InputPartition):
    """The folders of one task."""

    def __init__(self, folders: list[Folder]):
        self.folders = folders


class ObjectReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.prefix = ""
        self.keys: list[str] | None = None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802  the interface's name
        """Prefixes and exact keys are taken; all else is left to Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                if f.value.startswith(self.prefix):
                    self.prefix = f.value
                elif not self.prefix.startswith(f.value):
                    self.keys = []
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self._only([f.value])
            elif isinstance(f, In) and f.attribute == ("path",):
                self._only(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("path",)):  # every object has a path
                yield f

    def _only(self, keys) -> None:
        keys = set(keys)
        self.keys = sorted(keys if self.keys is None else keys & set(self.keys))

    def _children(self, folder: str) -> tuple[list, list[str]]:
        """(files, names of folders) right below, that may match."""
        from pyarrow import fs

        files, path = system(self.root)
        out, below = [], []
        if files.get_file_info(f"{path}/{folder}".rstrip("/")).type != fs.FileType.Directory:
            return out, below
        for info in files.get_file_info(fs.FileSelector(f"{path}/{folder}".rstrip("/"))):
            if info.base_name.startswith("."):
                continue
            key = posixpath.join(folder, info.base_name)
            if info.type == fs.FileType.Directory:
                if (key + "/").startswith(self.prefix) or self.prefix.startswith(key + "/"):
                    below.append(key)
            elif key.startswith(self.prefix):
                out.append((key, info.size, info.mtime))
        return out, below

    def partitions(self) -> list[InputPartition]:
        if self.keys is not None:
            return [Folders([])]
        todo, done = [posixpath.dirname(self.prefix)], []
        while todo and len(todo) + len(done) < FOLDERS:
            folder = todo.pop(0)
            done.append(Folder(folder, False))
            todo += self._children(folder)[1]
        # A folder an object is usual: dealt out, since as many partitions would be a task for each object.
        found = [*done, *(Folder(f, True) for f in todo)]
        return [Folders(found[k::FOLDERS]) for k in range(min(FOLDERS, len(found)))]

    def _rows(self, folder: Folder) -> Iterator[tuple]:
        files, below = self._children(folder.path)
        yield from files
        if folder.deep:
            for name in below:
                yield from self._rows(Folder(name, True))

    def _looked_up(self) -> Iterator[tuple]:
        from pyarrow import fs

        files, path = system(self.root)
        for key in self.keys or []:
            info = files.get_file_info(f"{path}/{key}")
            if info.type == fs.FileType.File and key.startswith(self.prefix):
                yield key, info.size, info.mtime

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows = self._looked_up() if self.keys is not None else (r for f in partition.folders for r in self._rows(f))
        held = []
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield _listed(held)
                held = []
        if held:
            yield _listed(held)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    times = [t.astimezone(datetime.timezone.utc) if t else None for _, _, t in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "length", "modified"])


class ObjectSource(DataSource):
    """spark.read.format("objects").load(root): path, length, modified."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modified of every object; conditions on path decide what is listed."""
    spark.dataSource.register(ObjectSource)
    spark.conf.set(PUSHED, "true")
    return spark.read.format("objects").load(root)


def contents(wanted: DataFrame, root: str) -> DataFrame:
    """path, length and content of the objects whose keys are in wanted.path; keys without an object are left out.

    Spark takes the size of what is read for that of the keys, which are some bytes each. So the keys are dealt to as many tasks as a shuffle has,
    which adaptive execution does not put together, in turn: by path Spark would leave it at the partitions of the distinct keys. And contents are
    not to be joined as they are: they would be broadcast.
    """

    def fetch(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = system(root)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([len(c) for _, c in held], pa.int64()), pa.array([c for _, c in held], pa.binary())], names=["path", "length", "content"])

        for batch in batches:
            for key in batch.column(0).to_pylist():
                if files.get_file_info(f"{base}/{key}").type != fs.FileType.File:
                    continue
                with files.open_input_stream(f"{base}/{key}") as stream:
                    held.append((key, stream.read()))
                size += len(held[-1][1])
                if size >= BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = wanted.select("path").where("path is not null").distinct().repartition(n)
    return keys.mapInArrow(fetch, "path string, length long, content binary")


def put(objects: DataFrame, root: str) -> int:
    """Write each row's content under its path, and return how many. A put that is run again writes the same; an object appears when it is
    whole. Paths differ; a null content is an empty object."""

    def write(batches) -> Iterator[pa.RecordBatch]:
        files, base = system(root)
        made: set[str] = set()
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder, name = posixpath.split(f"{base}/{key}")
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as stream:
                    stream.write(content.as_py() or b"")
                files.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return objects.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
