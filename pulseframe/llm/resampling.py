"""Importance resampling towards the n-grams of a target corpus, by external sort-count.

Features of a text are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS.
One pass writes each document's buckets as a packed stream of 16-bit numbers to the shared folder.  Counts come from
the streams: each task sorts and run-length encodes them, and runs are summed by bucket.  The gains of the buckets
(one array of fixed size) then weigh the documents: in an Arrow batch of streams the offsets of the binary column are
the document offsets, so weights are gathers with np.add.reduceat.  The draw is the top of weights plus Gumbel noise
from a hash of the id; its ranks come from a range sort with one count a range.

CRC-32 is linear: the checksum of joined strings is a shift of the first one's, which four table look-ups do, plus the
second one's.  So words are read once and n-grams never built.

Edge cases: a null text has no words; a null id hashes as an empty one and sorts last among ties; rows of one id are
documents of their own (equal scores, neighbouring ranks); texts with fewer than `min_words` words are scored and never
drawn; an empty target gives every bucket the count 0; empty tables give empty results; `keep` columns that have the
name of a result are left out.  A text is one row: some tens of bytes of arrays for each byte, and its stream, two
bytes for each feature, must stay under 2 GB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_order, written
from .textops import NO_LETTER, Texts, Words, map_texts

BUCKETS = 10_000
_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), x >> np.uint32(1))
    return x


def _apply(tables: np.ndarray, x: np.ndarray, base=0) -> np.ndarray:
    """A linear map of 32 bits, given by its values at the bytes of each place; base: where the map of each x begins."""
    flat, low = tables.reshape(-1), np.uint32(255)
    return flat[base + (x & low)] ^ flat[base + 256 + (x >> np.uint32(8) & low)] ^ flat[base + 512 + (x >> np.uint32(16) & low)] ^ flat[base + 768 + (x >> np.uint32(24))]


def _twice(tables: np.ndarray) -> np.ndarray:
    return _apply(tables, tables.reshape(-1)).reshape(4, 256)


class Checksums:
    """CRC-32 of many byte strings at once, kept without the first and last inversion ("raw"), so that they are linear."""

    def __init__(self) -> None:
        byte = _byte_table()
        place = np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        one = (place >> np.uint32(8)) ^ byte[place & np.uint32(255)]  # a shift by one zero byte
        self.short = np.empty((64, 4, 256), np.uint32)  # shifts by 0 to 63 bytes
        self.short[0] = place
        for k in range(1, 64):
            self.short[k] = _apply(one, self.short[k - 1].reshape(-1)).reshape(4, 256)
        self.powers = [_twice(self.short[32])]  # by 64, 128, 256, ... bytes
        while len(self.powers) < 30:
            self.powers.append(_twice(self.powers[-1]))
        # Of eight bytes, as four pairs: what each pair adds to the checksum.
        pair = np.arange(1 << 16, dtype=np.uint32)
        end = byte[(pair >> np.uint32(8)) ^ (byte[pair & np.uint32(255)] & np.uint32(255))] ^ (byte[pair & np.uint32(255)] >> np.uint32(8))
        self.pairs = [_apply(self.short[6 - 2 * k], end) for k in range(4)]
        self.space = byte[32 : 32 + 1]
        self.zeros = self.shift(np.full(256, _ALL), np.arange(256)) ^ _ALL

    def shift(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Checksums after n more zero bytes."""
        out = _apply(self.short, raw, (n & 63) << 10)
        rest = n >> 6
        for tables in self.powers:
            at = np.flatnonzero(rest & 1)
            if len(at):
                out[at] = _apply(tables, out[at])
            rest = rest >> 1
            if not rest.any():
                break
        return out

    def finished(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """zlib's checksums of strings of n bytes."""
        out = raw ^ self.zeros[np.minimum(n, 255)]
        at = np.flatnonzero(n > 255)
        if len(at):
            out[at] = raw[at] ^ self.shift(np.full(len(at), _ALL), n[at]) ^ _ALL
        return out

    def _eight(self, x: np.ndarray) -> np.ndarray:
        part = x.view(np.uint16).reshape(-1, 4)
        return self.pairs[0][part[:, 0]] ^ self.pairs[1][part[:, 1]] ^ self.pairs[2][part[:, 2]] ^ self.pairs[3][part[:, 3]]

    def of_ranges(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Raw checksums of the non-empty ranges [lo, hi), read as eight-byte pieces that end where the range does."""
        padded = np.zeros(len(buf) + 16, np.uint8)
        padded[8 : 8 + len(buf)] = buf
        view = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))  # view[i]: the bytes before buf[i]
        n = (hi - lo + 7) >> 3
        first = hi - 8 * (n - 1)
        spare = (8 * n - (hi - lo)).astype(np.uint64) * np.uint64(8)
        out = self._eight(view[first] >> spare << spare)
        at = np.flatnonzero(n > 1)
        if len(at):
            more = n[at] - 1
            begin = np.cumsum(more) - more
            k = np.arange(int(more.sum())) - np.repeat(begin, more)
            part = self.shift(self._eight(view[np.repeat(first[at], more) + 8 * (k + 1)]), 8 * (np.repeat(more, more) - 1 - k))
            out[at] = self.shift(out[at], 8 * more) ^ np.bitwise_xor.reduceat(part, begin)
        return out


def feature_buckets(t: Texts, sums: Checksums, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16-bit buckets of all features, offsets of the rows in them, words of each row) of a slice of texts."""
    w = Words(t, True, NO_LETTER, hashed=False)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(t.rows + 1, np.int64), w.count
    size = w.end - w.start
    raw = [sums.of_ranges(w.bytes, w.start, w.end)]
    length = [size]
    after = sums.shift(np.repeat(sums.space, n), size) ^ raw[0]  # of a space and the word
    for _ in range(2):
        before = np.r_[raw[-1][:1], raw[-1][:-1]]
        raw.append(sums.shift(before, size + 1) ^ after)
        length.append(np.r_[0, length[-1][:-1]] + size + 1)
    place = np.arange(n) - np.repeat(w.first[:-1], w.count)  # of a word in its row
    own = np.minimum(place + 1, 3)
    ends = np.cumsum(own)
    stream = np.empty(int(ends[-1]), np.uint16)
    for k in range(3):
        at = np.flatnonzero(place >= k)
        stream[ends[at] - own[at] + k] = sums.finished(raw[k][at], length[k][at]) % np.uint32(buckets)
    return stream, np.r_[0, ends][w.first], w.count


def bucket_streams(docs: DataFrame, text: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """`keep` columns (default: all), n_words and stream: each text's buckets as little-endian 16-bit numbers."""

    def make():
        sums = Checksums()

        def f(t: Texts):
            stream, off, words = feature_buckets(t, sums, buckets)
            cells = pa.Array.from_buffers(pa.large_binary(), t.rows, [None, pa.py_buffer((2 * off).astype(np.int64)), pa.py_buffer(stream.astype("<u2"))])
            return words.astype(np.int64), cells.cast(pa.binary())

        return f

    return map_texts(docs, make, [T.StructField("n_words", T.LongType()), T.StructField("stream", T.BinaryType())], text, keep)


def _packed(column) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, row offsets) of a column of streams; nothing is copied but what a batch has in several pieces."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    part = whole[off[0] : off[-1]]
    return (part if part.ctypes.data % 2 == 0 else part.copy()).view("<u2"), (off - off[0]) >> 1


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the occurrences of each bucket in all streams; a task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            x = np.sort(_packed(b.column(0))[0])
            at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            total[x[at]] += np.diff(np.r_[at, len(x)])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log of how much likelier a bucket is in the target), with one added to each count."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * (s_all + buckets) / (float(source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)], np.int64)


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """The streams' other columns, n_features and weight."""
    keep = [c for c in streams.columns if c not in ("stream", "n_features", "weight")]

    def run(batches):
        for b in batches:
            x, off = _packed(b.column(0))
            weight = np.zeros(b.num_rows, np.int64)
            full = np.flatnonzero(np.diff(off))
            if len(full):
                weight[full] = np.add.reduceat(gains[x], off[:-1][full])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.diff(off)), pa.array(weight)], [*keep, "n_features", "weight"])

    fields = [streams.schema[c] for c in keep] + [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    return streams.select("stream", *keep).mapInArrow(run, T.StructType(fields))


def gumbel_noise(name: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of SHA-256 of seed:name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, keep: tuple[str, ...] = (), id_col: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (and `keep` columns) of every document; rank: 1, 2, ... of those drawn, else null."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    own = [c for c in keep if c not in ("doc_id", "n_features", "weight", "score", "rank")]
    renamed = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"), *[docs[c].alias(f"__k{i}") for i, c in enumerate(own)])
    streams = written(bucket_streams(renamed, keep=[c for c in renamed.columns if c != "text"], buckets=buckets), "resample-streams")
    counts = lambda s: {r["bucket"]: r["n"] for r in bucket_counts(s, buckets).collect()}  # noqa: E731  `buckets` rows at most
    gains = bucket_gains(counts(streams), counts(bucket_streams(target.select(target[target_text].alias("text")), keep=[], buckets=buckets)), buckets)
    scored = weigh(streams, gains).withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    scored = written(scored, "resample-scored")
    able = F.col("n_words") >= min_words
    ordered, n = in_order(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ordered = ordered.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    every = ordered.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(own)])
