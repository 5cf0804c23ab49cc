"""Vendor exports: ragged CSV files with free text above a header of repeated sensor blocks.

A file is one trial's recording; it is read as one row (so it has to stay below
2 GB) and its body goes through one CSV reader.  Columns of the header become letters (E and e: time and value of the EMG
channel, A and a: those of the first accelerometer axis), and a regular
expression over them finds the blocks.
"""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COLUMNS, HEADER_LINES, NAMES_ABOVE = 112, 2000, 50

# The eight-muscle montage and the translations of names.
MONTAGE = ["TrapDesc", "DeltMed", "BicBrachii", "TricBrachii", "ExtCarpRad", "FlexCarpRad", "IntDors", "AbdV"]
TRANSLATIONS = {
    "InterDors": "IntDors", "Trapezio discendente": "TrapDesc", "discendente": "TrapDesc", "Deltoide Medio": "DeltMed", "Medio": "DeltMed",
    "Bicipite": "BicBrachii", "Tricipite": "TricBrachii", "Estensore": "ExtCarpRad", "Flessore": "FlexCarpRad",
}
# Fixed value: a sensor's name and its serial number in brackets.
NAME = r"([A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9 _\-]*)\s*\(\d+\)"
_MARK = r"(EMG 1|ACC X|GYRO X) Time Series"
_BLOCKS = re.compile(r"(?P<full>EeA.{11})|(?P<emg_only>Ee(?!A))|(?P<imu_only>Aa.{10})|(?P<stop>[EA])|.")
_IMU = ("acc_x_g", "acc_y_g", "acc_z_g", "gyro_x_dps", "gyro_y_dps", "gyro_z_dps")


def _letter(cell: str) -> str:
    for start, letter in (("EMG 1 Time Series", "E"), ("EMG 1 (", "e"), ("ACC X Time Series", "A"), ("ACC X (", "a")):
        if cell.strip().startswith(start):
            return letter
    return "."


def find_blocks(header: list[str]) -> list[tuple[str, int, int]]:
    """(kind, first column, end) from left to right; a malformed block ends the search."""
    out = []
    for m in _BLOCKS.finditer("".join(map(_letter, header))):
        if m.lastgroup == "stop":
            break
        if m.lastgroup:
            out.append((m.lastgroup, *m.span()))
    return out


def name_sensors(raw: list[str], n: int) -> tuple[list[str], str, str]:
    """Names of n sensors, where they come from, and why the file's own are not used."""
    names = [TRANSLATIONS.get(x, x) for x in raw][:n]
    reasons = {"missing_sensor_row": not raw, "sensor_count_mismatch": len(names) != n, "duplicate_sensor_names": len(set(names)) != len(names)}
    reason = next((k for k, bad in reasons.items() if bad), "")
    if not reason:
        return names, "normalized_from_header", reason
    if n == len(MONTAGE):
        return list(MONTAGE), "canonical_fallback_8", reason
    return [f"Sensor_{i + 1:02d}" for i in range(n)], "placeholder_fallback", reason


def _numbers(lines: list[str], available: int, width: int) -> np.ndarray:
    """The first `width` columns of all rows that are not too long; what is no finite number is missing, as are ragged tails."""
    import pandas as pd

    if any('"' in s for s in lines):  # commas inside quotes count for nothing
        rows = [r for r in csv.reader(io.StringIO("\n".join(lines))) if r and len(r) <= available]
        out = pd.DataFrame([r[:width] for r in rows], columns=range(width) if rows else None, dtype=object)
    else:
        kept = [s for s in lines if s.strip("\r") and s.count(",") < available]
        if not kept:
            return np.full((0, width), np.nan)
        out = pd.read_csv(io.StringIO("\n".join(kept)), header=None, names=range(available), usecols=range(width), index_col=False, low_memory=False, float_precision="round_trip", skip_blank_lines=False)
    if not len(out):
        return np.full((0, width), np.nan)
    x = np.stack([pd.to_numeric(out[c], errors="coerce").to_numpy(float) for c in out], 1)
    return np.where(np.isfinite(x), x, np.nan)


def _numbered(lines: list[str], first: int, end: int):
    """Lines first to end by their number."""
    import pandas as pd

    return pd.Series(lines[first:end], index=range(first, max(first, end)), dtype=object)


def header_cells(line: str, most: int) -> list[str]:
    return next(csv.reader([line.rstrip("\r")]))[:most]


def layout_of(kinds: list[str]) -> str:
    return {"full": "full_emg_imu"}.get(kinds[0], kinds[0]) if len(set(kinds)) == 1 else "mixed" if kinds else "unknown"


def parse_export(text: str, max_columns: int = MAX_COLUMNS) -> dict:
    """Blocks with their numbers, and the facts about the file; ValueError without a header."""
    lines = text.split("\n")
    head = next((i for i, s in enumerate(lines[:HEADER_LINES]) if re.search(_MARK, s)), None)
    if head is None:
        raise ValueError("no header with time series")
    numbered = _numbered(lines, max(0, head - NAMES_ABOVE + 1), head)
    above = numbered[numbered.str.contains(r"\(\d+\)", regex=True)].index.max() if len(numbered) else None
    above = None if above is None or above != above else int(above)
    raw = [re.sub(r"\s+", " ", x).strip() for x in re.findall(NAME, lines[above])] if above is not None else []
    raw = list(dict.fromkeys(raw))
    available = lines[head].count(",") + 1
    width = min(max_columns, available)
    header = header_cells(lines[head], width)
    data = _numbers(lines[head + 1 :], available, width)
    used = ~np.isnan(data).all(0) if len(data) else np.zeros(width, bool)
    header, data = [h for h, u in zip(header, used) if u], data[:, used]
    blocks = find_blocks(header)
    names, source, reason = name_sensors(raw, len(blocks))
    kinds = [k for k, _, _ in blocks]
    layout = layout_of(kinds)
    return {"blocks": [(n, k, data[:, a:b]) for n, (k, a, b) in zip(names, blocks)], "names": names, "source": source, "layout": layout, "kinds": kinds, "available": available, "requested": width, "used": int(used.sum()), "rows": len(data), "header_row": head, "names_row": above, "raw_names": raw, "reason": reason}


_COLUMNS = "folder string, file string, kind string, sensor string, row long, t double, emg_mv double, " + ", ".join(f"{c} double" for c in _IMU) + ", layout string, block_kinds string, names string, name_source string, n_sensors long, n_rows long, n_available long, n_requested long, n_used long, mapping_ok boolean, issue string, header_row long, names_row long, raw_names string, name_issue string"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _batch(n: int, **cols) -> pa.RecordBatch:
    kinds = dict(c.split() for c in _COLUMNS.split(", "))
    to = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    arrays = []
    for name in _NAMES:
        v = cols.get(name)
        if isinstance(v, np.ndarray):
            arrays.append(pa.array(v, to[kinds[name]], from_pandas=True))
        else:
            arrays.append(pa.array([v] * n, to[kinds[name]]))
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def read_exports(spark: SparkSession, path: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All rows of all files below path: kinds emg, imu, and one meta row a file. A file that cannot be parsed has its issue there; without files there is an error."""
    if spark.read.format("binaryFile").load(path).drop("content").isEmpty():
        raise FileNotFoundError(f"no files below {path}")
    where = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(where, r"([^/]+)$", 1).alias("file"), "value")

    def run(batches):
        for b in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    p = parse_export(text, max_columns)
                except ValueError as e:
                    yield _batch(1, folder=folder, file=name, kind="meta", mapping_ok=False, issue=str(e))
                    continue
                for sensor, kind, x in p["blocks"]:
                    if kind != "imu_only":
                        ok = ~np.isnan(x[:, :2]).any(1)
                        yield _batch(int(ok.sum()), folder=folder, file=name, kind="emg", sensor=sensor, row=np.flatnonzero(ok), t=x[ok, 0], emg_mv=x[ok, 1])
                    if kind != "emg_only":
                        first = 2 if kind == "full" else 0
                        ok = ~np.isnan(x[:, first])
                        yield _batch(int(ok.sum()), folder=folder, file=name, kind="imu", sensor=sensor, row=np.flatnonzero(ok), t=x[ok, first], **{c: x[ok, first + 1 + 2 * i] for i, c in enumerate(_IMU)})
                yield _batch(1, folder=folder, file=name, kind="meta", layout=p["layout"], block_kinds="|".join(p["kinds"]), names="|".join(p["names"]), name_source=p["source"], n_sensors=len(p["names"]), n_rows=p["rows"], n_available=p["available"], n_requested=p["requested"], n_used=p["used"], mapping_ok=bool(p["kinds"]), issue="" if p["kinds"] else "no_blocks_parsed", header_row=p["header_row"], names_row=p["names_row"], raw_names="|".join(p["raw_names"]), name_issue=p["reason"])

    return files.mapInArrow(run, _COLUMNS)


def emg_raw(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'emg'").select("file", "sensor", "row", F.col("t").alias("t_emg"), "emg_mv")


def imu_raw(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'imu'").select("file", "sensor", "row", F.col("t").alias("t_imu"), *_IMU)


def file_facts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'meta'").select("file", *_NAMES[13:])


def anomalies(facts: DataFrame, sensors: int = 8) -> DataFrame:
    return facts.where(~F.coalesce(F.col("mapping_ok"), F.lit(False)) | (F.coalesce("n_sensors", F.lit(0)) != sensors))


def names_in(line: Column) -> Column:
    """Distinct names in front of numbers in brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(NAME), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def header_lines(lines: DataFrame, keys, number: str, line: str, marker: str, above: str, reach: int = NAMES_ABOVE) -> DataFrame:
    """header_row: the first line with the marker; names_row: the nearest of the lines above it that matches `above`."""
    head = lines.where(F.col(line).rlike(marker)).groupBy(*keys).agg(F.min(number).alias("header_row"))
    j = lines.join(head, list(keys)).where((F.col(number) < F.col("header_row")) & (F.col(number) > F.col("header_row") - reach) & F.col(line).rlike(above))
    return head.join(j.groupBy(*keys).agg(F.max(number).alias("names_row")), list(keys), "left")
