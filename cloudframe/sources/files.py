"""Data sources over byte ranges of files, and one that puts single files together from many tasks.

``cloudframe_lines`` reads text, ``cloudframe_records`` binary records of one width. Both split files
into ranges that tasks read by themselves; line and row numbers come from the ranges' order and one
count for each range, so nothing is sorted or gathered.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.lineage import cut, new_path

#: Bytes of a range, and rows or bytes that a task holds at a time.
SPLIT, BATCH_ROWS, READ = 64 << 20, 65536, 1 << 20
#: Bytes of a range of text, whose numbers take far longer to read than binary ones.
LINES_SPLIT = 8 << 20


def filesystem(path: str):
    """The file system of a path, local or a URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)


class Range(InputPartition):
    def __init__(self, part: int, start: int, stop: int):
        self.part, self.start, self.stop = part, start, stop


class Lines(DataSource):
    """``part, line, kind, seen, text``: number of a line in its range, its first word if that is one of ``kinds``, how often each kind came before in the range."""

    @classmethod
    def name(cls) -> str:
        return "cloudframe_lines"

    def schema(self) -> str:
        return "part int, line long, kind string, seen array<bigint>, text string"

    def reader(self, schema):
        return LinesReader(self.options)


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.begin = options["path"], int(options.get("begin", 0))
        self.split = int(options.get("split", SPLIT))
        self.kinds = [k for k in options.get("kinds", "").split(",") if k]

    def partitions(self):
        with open_input(self.path) as f:
            size = f.size()
        starts = range(self.begin, max(size, self.begin + 1), self.split)
        return [Range(n, s, min(s + self.split, size)) for n, s in enumerate(starts)]

    def read(self, partition):
        """A line belongs to the range in which it begins."""
        kinds = {k: n for n, k in enumerate(self.kinds)}
        seen = np.zeros(len(kinds), np.int64)
        number, texts, found = 0, [], []

        def batch():
            """The lines held, as a batch; counts go on."""
            nonlocal number, seen
            n = len(texts)
            here = np.array(found, np.int64)
            one = (here[:, None] == np.arange(len(kinds))).astype(np.int64)
            after = seen + np.cumsum(one, 0)
            before = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(kinds), pa.array((after - one).ravel()))
            kind = pa.array([*self.kinds, None], pa.string()).take(pa.array(np.where(here < 0, len(kinds), here)))
            columns = [pa.array(np.full(n, partition.part, np.int32)), pa.array(np.arange(number, number + n)), kind, before, pa.array(texts, pa.string())]
            number, seen = number + n, after[-1]
            texts.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "line", "kind", "seen", "text"])

        with open_input(self.path) as f:
            for raw in _raw_lines(f, self.begin, partition):
                text = raw.decode("utf-8", "replace").rstrip("\r")
                first = text.split(None, 1) if kinds else None
                texts.append(text)
                found.append(kinds.get(first[0], -1) if first else -1)
                if len(texts) == BATCH_ROWS:
                    yield batch()
        if texts:
            yield batch()


def _raw_lines(f, begin: int, partition: Range):
    """The lines that begin in a range, read and split block by block."""
    at = partition.start
    f.seek(at)
    if at > begin:  # up to the end of the line that an earlier range reads
        at -= 1
        f.seek(at)
        while (cut_at := (more := f.read(READ)).find(b"\n")) < 0:
            if not more:
                return
            at += len(more)
        at += cut_at + 1
        f.seek(at)
    held: list[bytes] = []
    while at < partition.stop:
        more = f.read(READ)
        if more and b"\n" not in more:
            held.append(more)
            continue
        *lines, rest = b"".join([*held, more]).split(b"\n")
        held = [rest]
        if not more:  # the last line has no end
            lines = [rest] if rest else []
        for raw in lines:
            if at >= partition.stop:
                return
            yield raw
            at += len(raw) + 1
        if not more:
            return


class Records(DataSource):
    """Rows of fixed-width records: ``pid`` and the fields of a numpy record type, given as JSON."""

    @classmethod
    def name(cls) -> str:
        return "cloudframe_records"

    def schema(self) -> str:
        fields = json.loads(self.options["fields"])
        return "pid long, " + ", ".join(f"`{n}` {SQL_TYPES[kind[1:]]}" for n, kind, _ in fields)

    def reader(self, schema):
        return RecordsReader(self.options)


#: Spark types that hold numpy types without loss; unsigned types are widened.
SQL_TYPES = {"i1": "smallint", "u1": "smallint", "i2": "int", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


class RecordsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.begin = options["path"], int(options["begin"])
        self.count, self.stride = int(options["count"]), int(options["stride"])
        self.fields = json.loads(options["fields"])  # name, numpy type, offset
        self.rows = max(1, max(int(options.get("split", SPLIT)), self.stride) // self.stride)

    def partitions(self):
        return [Range(n, s, min(s + self.rows, self.count)) for n, s in enumerate(range(0, max(self.count, 1), self.rows))]

    def read(self, partition):
        names, kinds, offsets = zip(*self.fields, strict=True)
        dtype = np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": self.stride})
        with open_input(self.path) as f:
            f.seek(self.begin + partition.start * self.stride)
            for at in range(partition.start, partition.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.stop - at)
                data = f.read(n * self.stride)
                if len(data) < n * self.stride:
                    raise ValueError(f"{self.path} ends within record {at + len(data) // self.stride}")
                table = np.frombuffer(data, dtype)
                columns = [pa.array(np.arange(at, at + n))]
                for name, kind in zip(names, kinds, strict=True):
                    columns.append(pa.array(table[name].astype(np.dtype(kind).newbyteorder("="))).cast(_ARROW[SQL_TYPES[kind[1:]]]))
                yield pa.RecordBatch.from_arrays(columns, names=["pid", *names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Lines)
    spark.dataSource.register(Records)


def read_lines(spark: SparkSession, path: str, begin: int = 0, kinds: tuple[str, ...] = (), split: int = LINES_SPLIT) -> DataFrame:
    """Lines of a text file: ``line`` (from 0), ``kind``, ``seen`` (lines of each kind before this one) and ``text``."""
    register(spark)
    raw = spark.read.format("cloudframe_lines").options(path=path, begin=begin, kinds=",".join(kinds), split=split).load()
    counts = [F.coalesce(F.max(F.col("seen")[k] + (F.col("kind") == name).cast("long")), F.max(F.col("seen")[k])).alias(f"n{k}") for k, name in enumerate(kinds)]
    ranges = raw.groupBy("part").agg((F.max("line") + 1).alias("lines"), *counts)  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = ranges.select("part", total("lines").alias("__lines"), F.array(*[total(f"n{k}") for k in range(len(kinds))]).cast("array<bigint>").alias("__seen"))
    seen = F.zip_with("seen", "__seen", lambda a, b: a + b)
    return raw.join(starts, "part").select((F.col("line") + F.col("__lines")).alias("line"), "kind", seen.alias("seen"), "text")


def read_records(spark: SparkSession, path: str, begin: int, count: int, stride: int, fields: list[tuple[str, str, int]], split: int = SPLIT) -> DataFrame:
    """Fixed-width records: ``pid`` (from 0) and the named fields (name, numpy type with byte order, offset)."""
    register(spark)
    return spark.read.format("cloudframe_records").options(path=path, begin=begin, count=count, stride=stride, fields=json.dumps(fields), split=split).load()


def _write_part(folder: str, encode: Callable[[pa.RecordBatch], bytes]):
    def run(batches):
        context = TaskContext.get()
        name, out, size = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system, inner = filesystem(name)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(inner, compression=None)
            if batch.num_rows:
                data = encode(batch)
                size += len(data)
                out.write(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([size], pa.int64())], names=["part", "name", "size"])

    return run


def lines_of(batch: pa.RecordBatch) -> bytes:
    """The only column, one line a row."""
    return "".join(f"{t}\n" for t in batch.column(0).to_pylist()).encode("utf-8")


class Assembly(DataSource):
    """Takes ``name, begin, size`` of parts (or ``data``) and puts them into one file at those places; the file appears on commit."""

    @classmethod
    def name(cls) -> str:
        return "cloudframe_file"

    def schema(self) -> str:
        return "name string, begin long, size long, data binary"

    def writer(self, schema, overwrite):
        return AssemblyWriter(self.options)


def _take_place(system, inner: str, goal: str) -> None:
    """Move a whole file to its name; where the name is taken, only a system that replaces may do so at once."""
    if system.type_name == "local":
        os.replace(inner, goal)
        return
    if system.get_file_info(goal).type.name != "NotFound":
        system.delete_file(goal)
    system.move(inner, goal)


class AssemblyWriter(DataSourceWriter):
    """Writes beside the file under a name of its own.

    On mounted file systems each task writes its parts at their places in a file of the full length,
    and writing them again after a lost executor gives the same bytes. Other systems only append:
    there all parts come to one task, in order.
    """

    def __init__(self, options):
        self.path, self.temporary, self.size = options["path"], options["temporary"], int(options["size"])

    def write(self, iterator):
        system, inner = filesystem(self.temporary)
        if system.type_name == "local":
            with open(os.open(inner, os.O_WRONLY), "wb", buffering=0) as out:
                for row in iterator:
                    out.seek(row["begin"])
                    self._copy(row, out.write)
                os.fsync(out.fileno())
        else:
            at = 0
            with system.open_output_stream(inner, compression=None) as out:
                for row in iterator:
                    if row["begin"] != at:
                        raise ValueError(f"the parts of {self.path} are out of order")
                    at += row["size"]
                    self._copy(row, out.write)
        return WriterCommitMessage()

    @staticmethod
    def _copy(row, write) -> None:
        done = 0
        if row["name"] is None:
            sources = iter([row["data"]])
        else:
            f = open_input(row["name"])
            sources = iter(lambda: f.read(READ), b"")
        for data in sources:
            done += len(data)
            left = memoryview(data)
            while len(left):  # an unbuffered file may take less than it is given
                taken = write(left)
                left = left[len(left) if taken is None else taken :]
        if row["name"] is not None:
            f.close()
        if done != row["size"]:
            raise ValueError(f"part {row['name']} has {done} bytes instead of {row['size']}")

    def commit(self, messages) -> None:
        system, inner = filesystem(self.temporary)
        size = system.get_file_info(inner).size
        if size != self.size:
            system.delete_file(inner)
            raise ValueError(f"{self.path} would have {size} bytes instead of {self.size}")
        _take_place(system, inner, filesystem(self.path)[1])

    def abort(self, messages) -> None:
        system, inner = filesystem(self.temporary)
        if system.get_file_info(inner).type.name != "NotFound":
            system.delete_file(inner)


def write_file(path: str, pieces: list[bytes | tuple[DataFrame, list[str], Callable[[pa.RecordBatch], bytes]]]) -> None:
    """Write one file of bytes and sections ``(rows, order columns, encoder)``.

    The sections are sorted by ranges and encoded by many tasks, each into a part of its own below
    the checkpoint folder. Their sizes give each part its place, and many tasks copy the parts into
    the file (see ``AssemblyWriter``). It takes its name only when it is whole: a failed job leaves
    an earlier file of that name as it was, and nothing beside it. The order columns come last in
    the rows and are not encoded.
    """
    spark = next(p[0].sparkSession for p in pieces if not isinstance(p, bytes))
    spark.dataSource.register(Assembly)
    placed, at = None, 0
    for piece in pieces:
        if isinstance(piece, bytes):
            rows = spark.createDataFrame([(None, at, len(piece), piece)], Assembly({}).schema())
            at += len(piece)
        else:
            rows, order, encode = piece
            folder = new_path(spark, "file")
            wanted = [c for c in rows.columns if c not in order]
            ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*wanted)
            parts = cut(ordered.mapInArrow(_write_part(folder, encode), "part int, name string, size long"))  # one row for each task
            before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rows = parts.select("name", (before + at).alias("begin"), "size", F.lit(None).cast("binary").alias("data"))
            at += parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        placed = rows if placed is None else placed.unionByName(rows)

    system, inner = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if system.type_name == "local":
        with open(filesystem(temporary)[1], "wb") as out:
            out.truncate(at)
        placed = placed.repartition(max(1, min(at // SPLIT + 1, spark.sparkContext.defaultParallelism * 4)))
    else:
        placed = placed.orderBy("begin").coalesce(1)
    placed.write.format("cloudframe_file").mode("append").options(path=path, temporary=temporary, size=at).save()
