"""Token ids as compressed binary files.

Documents are range-sorted by id, tokenised, given an end id, and packed into
parts of up to `PART_IDS` ids (a longer document is a part by itself).  Each part
is a file of its own, named by Spark:

    magic 'ACMX3\\0\\0\\0' | u32 shard, u32 part | u32 documents, u32 blocks, u32 ids a block, u32 largest id, u64 ids
    i64 document ids | u8 null flags | u32 ids of each document
    u32 words of each block | u32 CRC-32 of each block's ids and words | u16 words | a newline

Spark's text writer puts the bytes of one row into one file and its binary-file
reader brings them back, so files go to every store that Spark reaches.  The
order of (shard, part) is that of the ids.

Edge cases: null texts are empty (end id only); null ids come first; rows with
equal ids stay apart, ordered by their text's hash; an empty table gives an
empty result; a part that fails its checksum raises; only the id and the text
are read, so no column can clash.  A document's ids are held in one task, some
tens of bytes each; a part has to stay below the 2 GB of a cell.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rangecoder import crc32, decode_blocks, encode_blocks
from .textops import Texts, slices
from .tokens import encoder
from .workers import released

MAGIC = b"ACMX3\0\0\0"
BLOCK_IDS = 2048
PART_IDS = 4_000_000
#: Bytes of texts that are encoded at once: a task needs some tens of bytes for each.
ENCODED_BYTES = 1 << 20
_HEAD = "<8sIIIIIIQ"


def _sums(ids: np.ndarray, block_ids: int, words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC-32 of each block's ids followed by its words, so that no bit goes unseen."""
    ends = np.cumsum(count).tolist()
    return np.array([zlib.crc32(words[a:b], crc32(ids[k * block_ids : (k + 1) * block_ids])) for k, (a, b) in enumerate(zip([0, *ends], ends))], "<u4")


def pack(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS, shard: int = 0, part: int = 0) -> bytes:
    """One part of the file format."""
    words, count, most = encode_blocks(ids, block_ids) if len(ids) else (np.zeros(0, np.uint16), np.zeros(0, np.int64), 0)
    sums = _sums(ids, block_ids, words.astype("<u2"), count)
    head = struct.pack(_HEAD, MAGIC, shard, part, len(doc_ids), len(count), block_ids, most, len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u4").tobytes(), count.astype("<u4").tobytes(), sums.tobytes(), words.astype("<u2").tobytes()])


def place(data: bytes) -> tuple[int, int]:
    """Shard and part of a file."""
    return struct.unpack_from("<II", data, len(MAGIC))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, null flags, ids of each document, all ids) of a part; ValueError if it is damaged."""
    if len(data) < struct.calcsize(_HEAD) or data[:8] != MAGIC:
        raise ValueError("not a part of token ids")
    _, _, _, docs, blocks, block_ids, most, total = struct.unpack_from(_HEAD, data)
    at, found = struct.calcsize(_HEAD), []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("<u4", blocks)):
        found.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc_ids, nulls, lengths, count, sums = found
    words = np.frombuffer(data, "<u2", int(count.sum()), at)
    ids = decode_blocks(words, count.astype(np.int64), block_ids, most, total) if total else np.zeros(0, np.int32)
    wrong = np.flatnonzero(_sums(ids, block_ids, words, count.astype(np.int64)) != sums)
    if len(wrong):
        raise ValueError(f"block {wrong[0]} fails its checksum")
    return doc_ids, nulls.astype(bool), lengths.astype(np.int64), ids


def write_token_files(docs: DataFrame, vocabulary: str, directory: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", part_ids: int = PART_IDS) -> None:
    """Tokenise whole texts and write parts below `directory` in ascending order of the id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        e, shard, part = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held, n = [], 0

        def out():
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()  # its arrays are not needed beside their copies
            return pa.RecordBatch.from_arrays([pa.array([pack(doc_ids, nulls, lengths, ids, shard=shard, part=part)])], ["payload"])

        for s in slices(batches, limit=ENCODED_BYTES):
            ids, off = e.ids(Texts(s.column(1)))
            lengths = np.diff(off) + 1
            whole = np.full(len(ids) + s.num_rows, end_id, np.int32)
            own = np.ones(len(whole), bool)
            own[np.cumsum(lengths) - 1] = False
            whole[own] = ids
            held.append((s.column(0).fill_null(0).to_numpy(zero_copy_only=False), s.column(0).is_null().to_numpy(zero_copy_only=False), lengths, whole))
            n += len(whole)
            if n >= part_ids:
                yield out()
                n, part = 0, part + 1
        if held:
            yield out()

    ordered.mapInArrow(released(run, ("encoders",)), "payload binary").select(F.col("payload").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(directory)


def read_token_files(spark: SparkSession, directory: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the parts."""
    parts = spark.read.format("binaryFile").load(directory)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer()
                if not len(data):
                    continue  # what a writer without rows leaves
                (shard, part), (doc_ids, nulls, lengths, ids) = place(data), unpack(data)
                ends = np.cumsum(lengths)
                sums = np.fromiter((crc32(ids[e - n : e]) for e, n in zip(ends, lengths)), np.int64, len(lengths))
                cols = [np.full(len(ends), shard), np.full(len(ends), part), pa.array(doc_ids, mask=nulls), ends - lengths, lengths, sums]
                names = ["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    def heads(batches):
        for b in batches:
            got = [struct.unpack_from(_HEAD, x.as_buffer()) for x in b.column(0) if len(x.as_buffer())]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 7)], ["shard", "part", "n_ids"])

    schema = "shard long, part long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = parts.select("content").mapInArrow(released(run), schema)
    # Ids before each part: shards first, then the parts of a shard; a row for each of them only.
    head = parts.select(F.substring("content", 1, struct.calcsize(_HEAD)).alias("head")).mapInArrow(released(heads), "shard long, part long, n_ids long")
    sizes = head.groupBy("shard", "part").agg(F.sum("n_ids").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("before_shard", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    before = sizes.withColumn("before_part", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n").join(shards, "shard")
    start = F.col("before_shard") + F.col("before_part") + F.col("within")
    return decoded.join(before, ["shard", "part"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

