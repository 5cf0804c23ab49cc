"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pulseframe.llm import queries, resampling
from pulseframe.llm.resampling import Checksums, feature_buckets, resample
from pulseframe.llm.textops import Texts
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text) -> tuple[list[int], int]:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(w[i - k : i + 1]).encode()) % 10_000 for i in range(len(w)) for k in range(3) if i >= k], len(w)


def brute(docs: list, target: list, percent: int = 5, min_words: int = 20, seed: int = 42) -> list:
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, f, n in found:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df) -> list:
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_checksums_of_ngrams():
    r = random.Random(1)
    texts = ["", "A", "a b", None, "Hello, wörld 123 " + "x" * 300 + " " + "y" * 50_000 + " z"]
    texts += [" ".join("".join(r.choice("abcdéßXYZ09€") for _ in range(r.choice([1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 130]))) for _ in range(r.randint(1, 40))) for _ in range(80)]
    stream, off, words = feature_buckets(Texts(pa.array(texts)), Checksums())
    for i, t in enumerate(texts):
        assert (stream[off[i] : off[i + 1]].tolist(), words[i]) == features(t)


def test_shift_is_zero_bytes():
    sums = Checksums()
    for n in (0, 1, 5, 63, 64, 65, 4096, 70_001):
        assert sums.finished(np.zeros(1, np.uint32), np.array([n]))[0] == zlib.crc32(bytes(n))


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    df = queries.queries()["op13_target_resampling"](spark, SMALL)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = got(df)
    assert rows == brute(docs, target) and sum(r[4] is not None for r in rows) > 3


def test_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = spark.createDataFrame([("alpha BETA gamma",), (None,), ("",)], "text string")
    rows = got(resample(odd, target, percent=40, keep=("source", "score", "rank")))
    assert rows == brute(docs, ["alpha BETA gamma", None, ""], 40)
    assert got(resample(odd, target.limit(0), percent=100, min_words=0)) == brute(docs, [], 100, 0)
    assert resample(odd.limit(0), target).count() == 0


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("pulseframe.llm.shared.SORTED_ROWS", 50)
    docs = [(i // 3, "one two three " * (i % 4)) for i in range(900)]
    rows = got(resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("three one",)], "text string"), percent=50, min_words=3))
    assert rows == brute(docs, ["three one"], 50, 3)
    assert resampling.BUCKETS == 10_000
