"""A growing folder of binary PLY files as a stream of points."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.geometry import COLOR, NORMAL, XYZ, color_byte
from ..sources.files import BATCH_ROWS, SPLIT, filesystem, open_input
from ..sources.ply import read_header

_KINDS = {"f4": "float", "f8": "double", "u2": "ushort"}
_SCHEMA = "file string, pid long, x float, y float, z float, nx float, ny float, nz float, red double, green double, blue double, kind string, has_normal boolean"


class Vertices(InputPartition):
    def __init__(self, entry: dict, first: int, stop: int):
        self.entry, self.first, self.stop = entry, first, stop


class Clouds(DataSource):
    """Options: ``path`` (the folder), ``log`` (where admitted rows are written down), ``chunk`` and ``batch`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "cloudframe_clouds"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema):
        return CloudsReader(self.options)


class CloudsReader(DataSourceStreamReader):
    """Offsets count the entries of the log: entry k lists the rows of files that were admitted with it.

    An entry is written, under a name of its own, before its offset is given away, so a batch that
    is run again after a restart has the same rows whatever has come into the folder since.
    """

    def __init__(self, options):
        self.path, self.log = options["path"].rstrip("/"), options["log"].rstrip("/")
        self.chunk, self.batch = int(options["chunk"]), int(options["batch"])
        self.entries: list[list[dict]] | None = None
        self.done: dict[str, tuple[int, int]] = {}  # for each file, rows that some entry has, and all its rows

    def _load(self) -> None:
        if self.entries is not None:
            return
        system, inner = filesystem(self.log)
        system.create_dir(inner, recursive=True)
        self.entries = []
        while system.get_file_info(f"{inner}/{len(self.entries):09d}.json").type.name == "File":
            self._note(self._read(len(self.entries)))

    def _read(self, k: int) -> list[dict]:
        with open_input(f"{self.log}/{k:09d}.json") as f:
            return json.loads(f.read())

    def _note(self, entry: list[dict]) -> None:
        self.entries.append(entry)
        self.done |= {e["file"]: (e["stop"], e["count"]) for e in entry}

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        self._load()
        if entry := self._admit():
            system, inner = filesystem(self.log)
            name = f"{inner}/{len(self.entries):09d}.json"
            with system.open_output_stream(name + ".new", compression=None) as out:
                out.write(json.dumps(entry).encode())
            system.move(name + ".new", name)
            self._note(entry)
        return {"entries": len(self.entries)}

    def _admit(self) -> list[dict]:
        """Rows that no entry has, in the order of file names, up to ``batch`` bytes but one row at least. Files still being written wait."""
        from pyarrow import fs

        system, inner = filesystem(self.path)
        found, left = [], self.batch
        for info in sorted(system.get_file_info(fs.FileSelector(inner, allow_not_found=True)), key=lambda i: i.base_name):
            name = info.base_name
            if info.type.name != "File" or not name.endswith(".ply") or name[0] in "._":
                continue
            path = f"{self.path}/{name}"
            first, count = self.done.get(path, (0, None))
            if first == count:
                continue
            header = read_header(path)
            v = header.elements[0]
            if header.format == "ascii" or v.name != "vertex" or v.stride is None:
                raise ValueError(f"PLY parse error in {path}: streaming needs a binary file that begins with plain vertices")
            if info.size < header.size + v.stride * v.count:
                continue
            order, at, fields = ">" if "big" in header.format else "<", 0, []
            for n, kind in v.properties:
                fields.append([dict(zip("rgb", COLOR, strict=True)).get(n, n), order + kind, at])
                at += int(kind[1])
            stop = min(v.count, first + max(left // v.stride, 0 if found else 1))
            if stop > first or not v.count:
                found.append({"file": path, "begin": header.size, "stride": v.stride, "fields": fields, "first": first, "stop": stop, "count": v.count})
            left -= (stop - first) * v.stride
            if stop < v.count:
                break
        return found

    def partitions(self, start: dict, end: dict):
        self._load()
        out = []
        for entry in self.entries[start["entries"] : end["entries"]]:
            for e in entry:
                rows = max(1, self.chunk // e["stride"])
                out += [Vertices(e, s, min(s + rows, e["stop"])) for s in range(e["first"], e["stop"], rows)]
        return out

    def read(self, partition):
        e = partition.entry
        names, kinds, offsets = zip(*e["fields"], strict=True)
        dtype = np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": e["stride"]})
        types = dict(zip(names, kinds, strict=True))
        has, colored = set(NORMAL) <= set(names), set(COLOR) <= set(names)
        with open_input(e["file"]) as f:
            f.seek(e["begin"] + partition.first * e["stride"])
            for at in range(partition.first, partition.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.stop - at)
                table = np.frombuffer(f.read(n * e["stride"]), dtype, n)
                columns = [pa.array([e["file"]] * n), pa.array(np.arange(at, at + n))]
                columns += [pa.array(table[c].astype(np.float32)) for c in XYZ]
                columns += [pa.array(table[c].astype(np.float32) if has else np.full(n, float(c == "nz"), np.float32)) for c in NORMAL]
                columns += [pa.array(table[c].astype(np.float64) if colored else np.full(n, 200.0)) for c in COLOR]
                columns += [pa.array([_KINDS.get(types["red"][1:], "int") if colored else "int"] * n), pa.array([has] * n)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "pid", *XYZ, *NORMAL, *COLOR, "kind", "has_normal"])

    def commit(self, end: dict) -> None:
        """The log stays: it tells a later start which rows are done."""


def stream_clouds(spark: SparkSession, folder: str, log: str, chunk_bytes: int = SPLIT, batch_bytes: int | None = None) -> DataFrame:
    """Points of the files ``*.ply`` in a folder, as they come: ``file``, ``pid`` within it, and the columns of ``stream_vertices``.

    ``chunk_bytes`` bounds a task, ``batch_bytes`` what a batch admits (None: all there is); a large
    file goes over several batches. With the trigger ``availableNow`` a run takes one batch. ``log``
    is a folder for one query, as its checkpoint; files are written under another name and renamed
    (as ``write_ply`` does), and not changed afterwards. Files too short for their header wait.
    """
    spark.dataSource.register(Clouds)
    raw = spark.readStream.format("cloudframe_clouds").options(path=folder, log=log, chunk=chunk_bytes, batch=2**62 if batch_bytes is None else batch_bytes).load()
    kind = F.col("kind")
    colors = {c: F.when(kind == "ushort", color_byte(F.col(c), "ushort")).when(kind == "int", color_byte(F.col(c), "int")).otherwise(color_byte(F.col(c), "float")) for c in COLOR}
    return raw.withColumns(colors).drop("kind")
