"""Vectorised text primitives shared by the Arrow-batched operators.

All functions work on one slice of texts laid out as a single UTF-8 byte
buffer with row offsets.  Words are maximal runs without the bytes 0x20 and
0x09-0x0D.  Word identity is a 64-bit hash of the bytes; a slice is bounded in
bytes, so memory does not follow the size of an Arrow batch: some tens of bytes
of arrays for each byte of the slice, which a single longer text exceeds alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import released

SLICE_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed * 2654435761 + 12345))


_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is no ASCII letter or digit and no part of a wider character.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 32


#: Masks of the lowest 0 to 8 bytes.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE = np.uint64(0x2545F4914F6CDD1D)


class Ranges:
    """Ranges [lo, hi) of a buffer as 64-bit words, with zeros after the last byte.

    size: bytes; head: the first word of each; long: the ranges of more than eight bytes, whose further words
    are more[first[k] : first[k + 1]].
    """

    def __init__(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        view = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # eight bytes from any place
        self.size = hi - lo
        self.head = view[lo] & _LOW_BYTES[np.minimum(self.size, 8)]
        self.long = np.flatnonzero(self.size > 8)
        rest = self.size[self.long] - 8
        n = (rest + 7) >> 3
        self.first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=self.first[1:])
        self.place = np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], n)
        self.more = view[np.repeat(lo[self.long] + 8, n) + 8 * self.place]
        self.more[self.first[1:] - 1] &= _LOW_BYTES[rest - 8 * (n - 1)]

    def hash(self) -> np.ndarray:
        """64 bits for each range.

        A word's part is mixed with its place by more than a factor, so no shape of text makes parts cancel out;
        ranges of one length up to eight bytes never collide.
        """
        part = mix(self.head + _PLACE)
        if len(self.long):
            place = mix(self.place.astype(np.uint64) * _ODD + _ODD)
            part[self.long] += np.add.reduceat(mix(self.more + place), self.first[:-1])
        return mix(part + self.size.astype(np.uint64) * _ODD)


def range_hash(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes [lo, hi), whatever their place in the buffer."""
    return Ranges(buf, lo, hi).hash()


class Texts:
    """Byte view of a slice: buf (uint8) and off (int64, rows + 1)."""

    def __init__(self, column) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf, self.off, self.rows = whole[off[0] : off[-1]], off - off[0], n

    def words(self, lower: bool = False, separators: np.ndarray = _IS_SEP) -> "Words":
        return Words(self, lower, separators)

    def lowered(self) -> np.ndarray:
        """The bytes with ASCII letters in lower case."""
        return self.buf | _UPPER[self.buf]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each row."""
        return count_between(flags, self.off[:-1], self.off[1:])


class Words:
    """Words of a slice: start, end (byte), first (rows + 1, word index), row, and hash if asked for."""

    def __init__(self, t: Texts, lower: bool = False, separators: np.ndarray = _IS_SEP, hashed: bool = True) -> None:
        buf, off = t.buf, t.off
        n = len(buf)
        inside = ~separators[buf]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(t.rows), self.count)
        self.inside = inside
        self.bytes = t.lowered() if lower else buf
        if hashed:
            self.hash = range_hash(self.bytes, self.start, self.end)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every n-word window that stays inside its row."""
        h, m = self.hash, len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        c = seeds(n, 31) | np.uint64(1)
        s = h[:m] * c[0]
        for k in range(1, n):
            s = s + h[k : k + m] * c[k]
        ok = self.row[:m] == self.row[n - 1 :]
        return mix(s[ok]), self.row[:m][ok]


def count_between(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Set flags in [lo, hi) for each pair of bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[hi] - total[lo]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches into record batches of at most `limit` text bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def sum_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows) if len(row) else np.zeros(rows)


def distinct_by_row(key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct keys in each row."""
    if not len(key):
        return np.zeros(rows, np.int64)
    k = np.sort(mix(key ^ (row.astype(np.uint64) * _ODD + _ODD)) << np.uint64(20) | row.astype(np.uint64)) if rows < 1 << 20 else None
    if k is None:
        pairs = np.unique(np.stack([row.astype(np.uint64), key]), axis=1)
        return np.bincount(pairs[0].astype(np.int64), minlength=rows)
    k = k[np.r_[True, k[1:] != k[:-1]]]
    return np.bincount((k & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=rows)


def map_texts(df, make, fields, text: str = "text", keep=None, limit: int = SLICE_BYTES, uses: tuple[str, ...] = ()):
    """DataFrame of `keep` columns (default: all) plus `fields` computed from whole texts.

    make() runs once per task and returns f(Texts) -> arrays in the order of
    `fields`.  A kept column whose name is among `fields` is replaced.  A null
    text counts as empty.  Slices have `limit` bytes of text; `uses` names what
    the worker keeps for later tasks of this operator.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[df[c] for c in keep], F.col(text).cast("string").alias("__text"))
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        f = make()
        for s in slices(batches, "__text", limit):
            at = s.schema.get_field_index
            got = [x if isinstance(x, pa.Array) else pa.array(x) for x in f(Texts(s.column(at("__text"))))]
            yield pa.RecordBatch.from_arrays([s.column(at(c)) for c in keep] + got, names)

    return source.mapInArrow(released(run, uses), T.StructType([source.schema[c] for c in keep] + list(fields)))
