"""Exports by byte ranges equal exports read whole."""

import numpy as np
import pytest

from pulseframe.sources import exports
from pulseframe.sources.export_source import ExportSource, _Reader, read_export_ranges

from .test_command_line import export


def rows(df) -> list:
    return sorted((tuple("nan" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*exports._NAMES).collect()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("exports")
    rng = np.random.default_rng(0)
    whole = export(rng, True).split("\r\n")
    head, body = whole[:4], whole[4:700]
    quoted = [*head, *body[:300], '"1,5",2,3', *body[300:400], "", ",,,", *body[400:]]
    empty_column = [*head, *[",".join(c if k != 2 else "" for k, c in enumerate(r.split(","))) for r in body]]
    files = {"S1/lifting.csv": "\r\n".join(whole[:900]), "S1/cut.csv": "\n".join(quoted), "S2/none.csv": "nothing here\n", "S2/gap.csv": "\n".join(empty_column) + "\n", "S2/head only.csv": "\n".join(head), "S3/empty.csv": ""}
    for name, text in files.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(text.encode())
    return str(top)


@pytest.mark.parametrize("size", [3_333, 1 << 20])
def test_ranges_equal_whole_files(spark, folder, size):
    want = rows(exports.read_exports(spark, f"{folder}/*/*.csv"))
    got = rows(read_export_ranges(spark, f"{folder}/*/*.csv", size))
    empty = [r for r in got if r[1] == "empty.csv"]  # the whole-file reader has no row for a file without bytes
    assert len(want) > 5_000 and [r for r in got if r not in empty] == want and len(empty) == 1 and "no header with time series" in empty[0]


def test_folders_are_not_opened(spark, folder):
    got = read_export_ranges(spark, f"{folder}/*/*.csv", 5_000, folders=["S2"])
    assert {r["folder"] for r in got.select("folder").distinct().collect()} == {"S2"}
    assert rows(got) == rows(exports.read_exports(spark, f"{folder}/S2/*.csv"))
    r = _Reader({"path": f"{folder}/*/*.csv", "range_bytes": 5_000})
    every = r.partitions()
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert [type(f) for f in r.pushFilters([IsNotNull(("folder",)), EqualTo(("folder",), "S3")])] == [IsNotNull]
    assert {p.file for p in r.partitions()} == {"empty.csv"} and len(every) > 20 and ExportSource.name() == "vendor_export"
    with pytest.raises(Exception, match="no files"):
        read_export_ranges(spark, f"{folder}/*/*.txt").count()


def test_lines_of_ranges_are_those_of_the_file(tmp_path):
    lines = [("x" * (k % 37)) + str(k) for k in range(3_000)]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines))
    from pulseframe.sources.export_source import Range

    size = path.stat().st_size
    for step in (13, 40, 5_000, size):
        reader = _Reader({"path": str(path)})
        got = [s for lo in range(0, size, step) for part in reader._lines(Range(str(path), "", "", 0, 0, lo, min(lo + step, size))) for s in part]
        assert got == lines
