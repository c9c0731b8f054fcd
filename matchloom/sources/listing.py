"""File names as a table, listed by tasks, and file contents opened by tasks.

``PathListing`` is a Spark data source of names and sizes. The driver opens directories from the top only
until there is one for every task; each task walks the trees it got and leaves skipped directories out
before it enters them. What happens to the names (side-cars, order, filters) so works on rows of a few
bytes, and ``opened`` reads the bytes of what is left at the very end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from matchloom.functions import naming as nm
from matchloom.sources.paths import as_uri, filesystem, literal, opens_in_tasks

NAMES = pa.schema([("path", pa.string()), ("length", pa.int64())])
#: Directories that the driver opens at most before the tasks go on.
DRIVER_DIRECTORIES = 200
#: Names of a batch; bytes of opened files that a task holds at once, one file at least.
BATCH_NAMES, OPEN_BYTES = 10_000, 16_000_000


def entered(name: str) -> bool:
    """Whether a directory of this name is looked into."""
    return name not in nm.SKIPPED_DIRECTORIES and not name.startswith(".")


def _children(root: str, below: str) -> Iterator[tuple[str, int | None]]:
    """Entries of a directory as paths below ``root`` with their sizes; a directory has none."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(as_uri(root))
    for entry in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{below}".rstrip("/") or "/")):
        place = f"{below}/{entry.base_name}" if below else entry.base_name
        if entry.type == fs.FileType.Directory:
            yield place, None
        else:
            yield place, entry.size


class Tree(InputPartition):
    """A directory below the root, alone or with all that is in it."""

    def __init__(self, below: str, whole: bool) -> None:
        self.below, self.whole = below, whole


class PathReader(DataSourceReader):
    def __init__(self, root: str, tasks: int, every: bool) -> None:
        self.root, self.tasks, self.every = root, tasks, every

    def _entered(self, place: str) -> bool:
        return self.every or entered(place.rpartition("/")[2])

    def partitions(self) -> list[InputPartition]:
        """The top of the tree, cut into as many directories as there are to be tasks."""
        waiting, alone = deque([""]), []
        while waiting and len(waiting) < self.tasks and len(alone) < DRIVER_DIRECTORIES:
            below = waiting.popleft()
            alone.append(Tree(below, False))
            waiting.extend(place for place, size in _children(self.root, below) if size is None and self._entered(place))
        return alone + [Tree(below, True) for below in waiting]

    def read(self, partition: Tree) -> Iterator[pa.RecordBatch]:
        root, names, sizes = self.root.rstrip("/"), [], []
        waiting = [partition.below]
        while waiting:
            for place, size in _children(self.root, waiting.pop()):
                if size is not None:
                    names.append(f"{root}/{place}")
                    sizes.append(size)
                elif partition.whole and self._entered(place):
                    waiting.append(place)
                if len(names) == BATCH_NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes)], schema=NAMES)
                    names, sizes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], schema=NAMES)


class PathListing(DataSource):
    """``spark.read.format("matchloom_paths").option("root", ...)``: path and length of the files below.

    ``tasks`` is how many directories to deal out at least, ``every`` enters skipped directories as well.
    """

    @classmethod
    def name(cls) -> str:
        return "matchloom_paths"

    def schema(self) -> str:
        return "path STRING, length BIGINT"

    def reader(self, schema: object) -> PathReader:
        tasks, every = int(self.options.get("tasks", "32")), self.options.get("every", "false") == "true"
        return PathReader(self.options["root"], tasks, every)


def _hadoop_names(spark: SparkSession, root: str) -> DataFrame:
    """Names through Spark's own listing, and one by one those below an underscore, which it leaves out."""
    system, place = filesystem(spark, root)
    prefix, found, entries = len(system.resolvePath(place).toString()), [], system.listFiles(place, True)
    while entries.hasNext():
        entry = entries.next()
        if "/_" in entry.getPath().toString()[prefix:]:
            found.append((entry.getPath().toString(), entry.getLen()))
    seen = hadoop_files(spark, [root], recursive=True).select("path", "length")
    return seen.unionByName(spark.createDataFrame(found, "path STRING, length BIGINT")) if found else seen


def hadoop_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Files with their contents through Spark's own reader."""
    reader = spark.read.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load([literal(path) for path in paths])


def names_below(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """Path and length of the files below a directory; ``every`` enters directories that inputs skip."""
    if not opens_in_tasks(root):
        return _hadoop_names(spark, root)
    spark.dataSource.register(PathListing)
    tasks = max(2, spark.sparkContext.defaultParallelism)
    reader = spark.read.format(PathListing.name()).option("root", root).option("tasks", str(tasks))
    return reader.option("every", str(every).lower()).load()


def _reader() -> Callable[[str | None], bytes | None]:
    from pyarrow import fs

    def read(path: str | None) -> bytes | None:
        if path is None:
            return None
        system, place = fs.FileSystem.from_uri(as_uri(path))
        with system.open_input_stream(place) as stream:
            return stream.read()

    return read


def opened(rows: DataFrame, contents: dict[str, str]) -> DataFrame:
    """Adds the bytes of files: ``contents`` has the new columns and the columns that name the files.

    Bytes are read where the row already is and leave the task a few files at a time; nothing is
    shuffled behind this step. A null name gives null.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader()

        def made(batch: pa.RecordBatch, start: int, stop: int, data: list[list[bytes | None]]) -> pa.RecordBatch:
            piece = batch.slice(start, stop - start)
            return pa.RecordBatch.from_arrays(
                [*piece.columns, *(pa.array(x, pa.binary()) for x in data)], [*piece.schema.names, *contents]
            )

        for batch in batches:
            paths = [batch.column(name).to_pylist() for name in contents.values()]
            start, held, data = 0, 0, [[] for _ in contents]
            for i in range(batch.num_rows):
                for values, column in zip(data, paths, strict=True):
                    values.append(read(column[i]))
                    held += len(values[-1] or b"")
                if held >= OPEN_BYTES:
                    yield made(batch, start, i + 1, data)
                    start, held, data = i + 1, 0, [[] for _ in contents]
            if start < batch.num_rows:
                yield made(batch, start, batch.num_rows, data)

    return rows.mapInArrow(read_files, ", ".join([schema, *(f"`{c}` binary" for c in contents)]))


def opened_through_hadoop(rows: DataFrame, contents: dict[str, str], files: DataFrame) -> DataFrame:
    """The same for file systems that only Spark's reader knows: ``files`` has path and content."""
    for column, path in contents.items():
        found = files.select(F.col("path").alias("_path"), F.col("content").alias(column))
        rows = rows.join(found, F.col(path) == F.col("_path"), "left").drop("_path")
    return rows
