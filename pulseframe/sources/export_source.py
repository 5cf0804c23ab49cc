"""Vendor exports of any size: a data source that reads byte ranges of the files, and the plan that puts them together.

Planning reads the first bytes of each file, as far as its header; the rest is cut into ranges of `range_bytes`, each of
which is a partition: a line belongs to the range in which it starts, and a task holds some thousand lines.  Which
columns are empty, and so which blocks a file has, is known only after all ranges: each range tells its rows and
columns with values, Spark adds them up by file, and lines find their sensors by a join.  A filter on `folder` (the
subject) keeps files from being opened.

A quoted cell may hold commas, but must not span lines.  Otherwise the rows are those of exports.read_exports(), and a
file without bytes has a row with its issue, too.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from pulseframe.sources import exports, tables

LINES = "path string, folder string, file string, kind string, part int, line long, cells array<double>, header array<string>, raw_names array<string>, header_row long, names_row long, available long, issue string, n_rows long, used array<boolean>"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_())}
_FIELDS = {n: _KINDS[k] for n, k in (c.split() for c in LINES.split(", "))}
HEAD_BYTES, BATCH_LINES = 1 << 16, 4_000


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file's body, which begins at `first`; part -1 tells the head's facts."""

    path: str
    folder: str
    file: str
    part: int
    first: int = 0
    start: int = 0
    end: int = 0
    width: int = 0
    available: int = 0
    head: dict | None = None


def _filesystem(path: str):
    """(file system, path inside it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str, str, int]]:
    """(URI, folder, file, bytes) of all files that match a pattern, in order."""
    from pyarrow import fs

    system, inner = _filesystem(path)
    base = inner
    while any(c in base for c in "*?["):
        base = base.rsplit("/", 1)[0]
    info = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File] if system.get_file_info(base).type == fs.FileType.Directory else [i for i in [system.get_file_info(base)] if i.type == fs.FileType.File]
    prefix = path[: len(path) - len(inner)]
    found = sorted((i.path, i.size) for i in info if inner == base or fnmatch.fnmatchcase(i.path, inner) and i.path.count("/") == inner.count("/"))
    return [(prefix + p, *(["", *p.split("/")][-2:]), n) for p, n in found]


def _head(path: str, size: int, max_columns: int) -> tuple[int, dict]:
    """(place of the first line of the body, facts of the head); more bytes are read until the header is there."""
    system, inner = _filesystem(path)
    with system.open_input_file(inner) as f:
        want = HEAD_BYTES
        while True:
            raw = f.read_at(min(want, size), 0)
            whole = len(raw) >= size
            lines = raw.split(b"\n") if whole else raw.split(b"\n")[:-1]
            at = next((i for i, s in enumerate(lines[: exports.HEADER_LINES]) if re.search(exports._MARK, s.decode("utf-8", "replace"))), None)
            if at is not None or whole or len(lines) >= exports.HEADER_LINES:
                break
            want *= 4
    if at is None:
        return size, {"issue": "no header with time series"}
    text = "\n".join(s.decode("utf-8", "replace") for s in lines[: at + 1])
    p = exports.parse_export(text, max_columns)
    return sum(len(s) + 1 for s in lines[: at + 1]), {"header": exports.header_cells(text.split("\n")[at], max_columns), "raw_names": p["raw_names"], "header_row": at, "names_row": p["names_row"], "available": p["available"], "issue": ""}


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.most = options["path"], int(options.get("range_bytes", 64 << 20)), int(options.get("max_columns", exports.MAX_COLUMNS))
        self.folders: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("folder",) else set(f.value) if isinstance(f, In) and f.attribute == ("folder",) else None
            if wanted is None:
                yield f
            else:
                self.folders = wanted if self.folders is None else self.folders & wanted

    def partitions(self) -> list[Range]:
        out = []
        for path, folder, file, size in _files(self.path):
            if self.folders is not None and folder not in self.folders:
                continue
            first, head = _head(path, size, self.most)
            out.append(Range(path, folder, file, -1, head=head))
            if not head["issue"]:
                width = min(self.most, head["available"])
                out += [Range(path, folder, file, k, first, lo, min(lo + self.size, size), width, head["available"]) for k, lo in enumerate(range(first, size, self.size))]
        if not out and self.folders is None:
            raise FileNotFoundError(f"no files below {self.path}")
        return out

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        def batch(n: int, **cells) -> pa.RecordBatch:
            fixed = {"path": r.path, "folder": r.folder, "file": r.file, "part": r.part}
            return pa.RecordBatch.from_arrays([cells[c] if isinstance(cells.get(c), pa.Array) else pa.array([fixed.get(c, cells.get(c))] * n, k) for c, k in _FIELDS.items()], list(_FIELDS))

        if r.part < 0:
            yield batch(1, kind="head", **r.head)
            return
        rows, used = 0, np.zeros(r.width, bool)
        for lines in self._lines(r):
            x = exports._numbers(lines, r.available, r.width)
            used |= ~np.isnan(x).all(0) if len(x) else False
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * r.width, pa.int32()), pa.array(x.reshape(-1), from_pandas=True))
            yield batch(len(x), kind="line", line=pa.array(rows + np.arange(len(x))), cells=cells)
            rows += len(x)
        yield batch(1, kind="part", n_rows=rows, used=used.tolist())

    def _lines(self, r: Range) -> Iterator[list[str]]:
        """The lines that start in the range, in batches."""
        system, inner = _filesystem(r.path)
        with system.open_input_stream(inner, buffer_size=1 << 20) if r.start == 0 else system.open_input_file(inner) as f:
            at = r.start
            if r.start > r.first:  # what began before belongs to the range before
                f.seek(r.start - 1)
                at = r.start - 1
            elif r.start:
                f.seek(r.start)
            skip, rest, out = r.start > r.first, b"", []
            while at < r.end:
                piece = f.read(1 << 20)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop() if piece else b""
                for s in lines:
                    begin, at = at, at + len(s) + 1
                    if skip:
                        skip = False
                    elif begin < r.end:
                        out.append(s.decode("utf-8", "replace"))
                    else:
                        break
                    if len(out) >= BATCH_LINES:
                        yield out
                        out = []
                if not piece:
                    break
            if out:
                yield out


class ExportSource(DataSource):
    """spark.dataSource.register(ExportSource); spark.read.format('vendor_export').option('range_bytes', ...).load(pattern)"""

    @classmethod
    def name(cls) -> str:
        return "vendor_export"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


_PLAN = "path string, folder string, file string, blocks array<struct<sensor:string,kind:string,columns:array<int>>>, " + exports._COLUMNS.split("double, ", 8)[-1]


def _plans(batches) -> Iterator[pa.RecordBatch]:
    """One row a file: its blocks with their columns in the file, and its facts."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", _PLAN)]
    kinds = {"n_sensors": pa.int64(), "n_rows": pa.int64(), "n_available": pa.int64(), "n_requested": pa.int64(), "n_used": pa.int64(), "mapping_ok": pa.bool_(), "header_row": pa.int64(), "names_row": pa.int64(), "blocks": pa.list_(pa.struct([("sensor", pa.string()), ("kind", pa.string()), ("columns", pa.list_(pa.int32()))]))}
    for b in batches:
        out = []
        for r in b.to_pylist():
            row = {c: r[c] for c in ("path", "folder", "file")}
            if r["issue"]:
                out.append(row | {"mapping_ok": False, "issue": r["issue"]})
                continue
            header = r["header"]
            masks = [m for m in r["masks"] or [] if m]
            used = np.flatnonzero(np.any(masks, axis=0)) if masks else np.zeros(0, int)
            blocks = exports.find_blocks([header[i] for i in used])
            sensors, source, reason = exports.name_sensors(r["raw_names"], len(blocks))
            found = [k for k, _, _ in blocks]
            row["blocks"] = [{"sensor": n, "kind": k, "columns": [int(c) for c in used[lo:hi]]} for n, (k, lo, hi) in zip(sensors, blocks)]
            out.append(row | {"layout": exports.layout_of(found), "block_kinds": "|".join(found), "names": "|".join(sensors), "name_source": source, "n_sensors": len(sensors), "n_rows": r["rows"] or 0, "n_available": r["available"], "n_requested": len(header), "n_used": len(used), "mapping_ok": bool(found), "issue": "" if found else "no_blocks_parsed", "header_row": r["header_row"], "names_row": r["names_row"], "raw_names": "|".join(r["raw_names"]), "name_issue": reason})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds.get(n, pa.string())) for n in names], names)


def read_export_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20, max_columns: int = exports.MAX_COLUMNS, folders: list[str] | None = None) -> DataFrame:
    """The rows of exports.read_exports(), of files of any size; folders: the subjects to read."""
    spark.dataSource.register(ExportSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    lines = spark.read.format("vendor_export").option("range_bytes", range_bytes).option("max_columns", max_columns).load(path)
    lines = tables.staged(lines if folders is None else lines.where(F.col("folder").isin(folders)), "export-lines")  # parsed once
    parts = lines.where("kind = 'part'").select("path", "part", "n_rows", "used")
    before = F.sum("n_rows").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("path", "part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a range
    whole = parts.groupBy("path").agg(F.sum("n_rows").alias("rows"), F.collect_list("used").alias("masks"))
    heads = lines.where("kind = 'head'").select("path", "folder", "file", "header", "raw_names", "header_row", "names_row", "available", "issue")
    plans = heads.join(whole, "path", "left").mapInArrow(_plans, _PLAN)
    d = lines.where("kind = 'line'").select("path", "part", "line", "cells").join(offsets, ["path", "part"]).join(plans.select("path", "folder", "file", "blocks"), "path")
    d = d.select("folder", "file", (F.col("__before") + F.col("line")).alias("row"), "cells", F.explode("blocks").alias("b"))
    cell = lambda k: F.get("cells", F.get(F.col("b.columns"), k))
    emg = d.where("b.kind <> 'imu_only'").select("folder", "file", F.lit("emg").alias("kind"), F.col("b.sensor").alias("sensor"), "row", cell(F.lit(0)).alias("t"), cell(F.lit(1)).alias("emg_mv")).where("t IS NOT NULL AND emg_mv IS NOT NULL")
    first = F.when(F.col("b.kind") == "full", 2).otherwise(0)
    imu = d.where("b.kind <> 'emg_only'").select("folder", "file", F.lit("imu").alias("kind"), F.col("b.sensor").alias("sensor"), "row", cell(first).alias("t"), *[cell(first + 1 + 2 * i).alias(c) for i, c in enumerate(exports._IMU)]).where("t IS NOT NULL")
    meta = plans.drop("path", "blocks").withColumn("kind", F.lit("meta"))
    return emg.unionByName(imu, allowMissingColumns=True).unionByName(meta, allowMissingColumns=True).select(*exports._NAMES)
