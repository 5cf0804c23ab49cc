"""Counterfactually regularised toxicity classifier.

Features are words (runs of letters and digits, ASCII lower-cased) and word
beginnings of 4 to 8 bytes, present or not.  The features whose share differs
most between the classes are chosen from counts over the labelled rows; a
logistic model on them is fitted with two penalties: L2, and the squared change
of the score when an identity term is swapped for another of its group.  For a
linear score that change is w . (features of b - features of a), so all swaps of
the labelled texts fold into one quadratic form, weighed by how often each term
occurs in them plus a prior (so a term that the sample lacks is tied as well).

Edge cases: null and empty texts have no features and get the intercept's score;
repeated rows are scored each; without both labels the score is the share of
label 1 (0.5 without labels); an id labelled twice has its larger label; an empty
table gives an empty result; a column of the input called score or predicted is
replaced; a long text is one row of a slice and needs some tens of bytes a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_sample, written
from .textops import NO_LETTER, Texts, map_texts, range_hash, slices

#: Groups of identity terms; within a group any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("old", "young", "elderly"), ("disabled", "blind", "deaf"), ("american", "mexican", "chinese", "indian", "french", "german"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"), ("schwarze", "weiße"), ("schwule", "lesben", "heteros"), ("einwanderer", "flüchtlinge", "bürger"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "arabes", "asiatiques"), ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "latinos", "gitanos"), ("inmigrantes", "refugiados", "ciudadanos"),
)
_STARTS = range(4, 9)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of words and word beginnings; repeats are possible."""
    w = t.words(lower=True, separators=NO_LETTER)
    hashes, rows = [w.hash], [w.row]
    length = w.end - w.start
    for k in _STARTS:
        at = np.flatnonzero(length > k)
        hashes.append(range_hash(w.bytes, w.start[at], w.start[at] + k) ^ np.uint64(k))
        rows.append(w.row[at])
    return np.concatenate(hashes), np.concatenate(rows)


def _term_features(term: str) -> np.ndarray:
    return np.unique(features(Texts(pa.array([term])))[0])


class Toxicity:
    """Sorted feature hashes, their weights, and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs present, without repeats."""
        h, row = features(t)
        if not len(self.keys):
            return row[:0], row[:0]
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[place] == h[at]
        pair = np.unique(row[at][ok] * len(self.keys) + place[ok])
        return pair // len(self.keys), pair % len(self.keys)

    def probability(self, t: Texts) -> np.ndarray:
        row, f = self.hits(t)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weights[f], t.rows))))


def _fit(x: np.ndarray, y: np.ndarray, tie: np.ndarray, l2: float, swap: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised logistic loss; x is dense 0/1, tie the quadratic form of the swaps."""
    n, k = x.shape
    w, b = np.zeros(k), 0.0
    fixed = l2 * np.eye(k) + swap * tie
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        g = np.r_[x.T @ (p - y) + fixed @ w, (p - y).sum()]
        h = np.empty((k + 1, k + 1))
        h[:k, :k] = (x.T * s) @ x + fixed
        h[:k, k] = h[k, :k] = x.T @ s
        h[k, k] = s.sum() + 1e-6
        step = np.linalg.solve(h, g)
        w, b = w - step[:k], b - step[k]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column, max_rows: int = 12_000, max_features: int = 600, least_z: float = 6.0, l2: float = 0.3, swap: float = 50.0, groups=IDENTITY_TERMS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
    """Fit on at most `max_rows` labelled documents (those of least hash) for which `training`, a condition on the id, holds.

    A repeated id counts once, with its text of least hash.
    """
    labelled = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & training)
        .groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    )
    picked = bounded_sample(labelled, id_col, max_rows)
    rows = docs.select(id_col, F.col(text).cast("string").alias("text")).join(F.broadcast(picked), id_col)  # 12 bytes a row, max_rows at most
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # an id that repeats counts once, so max_rows bounds the rows
    rows = written(rows.groupBy(id_col).agg(F.max("__y").alias("__y"), least.alias("m")).select("__y", F.col("m.text").alias("text")), "toxicity-fit")
    totals = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 1) / (n0 + n1 + 2)
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))

    def count(batches):
        for s in slices(batches):
            h, row = features(Texts(s.column(1)))
            y = s.column(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            own = np.ones(len(h), bool)
            own[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            key, at = np.unique(h[own], return_inverse=True)
            n = np.bincount(at, minlength=len(key))
            pos = np.bincount(at, y[row[own]], len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos), pa.array(n.astype(np.int64) - pos)], ["h", "pos", "neg"])

    share = (F.col("pos") + F.col("neg") + 1) / F.lit(n0 + n1 + 2.0)
    z = (F.col("pos") / F.lit(float(n1)) - F.col("neg") / F.lit(float(n0))) / F.sqrt(share * (1 - share) * F.lit(1 / n0 + 1 / n1))
    counts = rows.mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counts.select("h", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "h").limit(max_features).collect()
    terms = {w: _term_features(w) for g in groups for w in g}
    keys = np.unique(np.r_[np.array([r["h"] for r in best], np.int64).view(np.uint64), *terms.values()])
    model = Toxicity(keys, np.zeros(len(keys)), 0.0)

    def present(batches):
        for s in slices(batches):
            row, f = model.hits(Texts(s.column(1)))
            off = np.searchsorted(row, np.arange(s.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(f.astype(np.int16)))], ["y", "f"])

    table = rows.mapInArrow(present, "y int, f array<smallint>").toArrow().combine_chunks()  # max_rows rows of a few hundred bytes
    lists = table["f"].combine_chunks() if isinstance(table["f"], pa.ChunkedArray) else table["f"]
    size = lists.value_lengths().to_numpy()
    x = np.zeros((len(size), len(keys)), np.float32)
    x[np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()] = 1
    y = table["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1][:64], x.sum(1), y))  # the order of arrival does not matter
    x, y = x[order], y[order]
    tie = np.zeros((len(keys), len(keys)))
    for group in groups:
        vector = {}
        for w in group:
            vector[w] = np.zeros(len(keys))
            vector[w][np.searchsorted(keys, terms[w])] = 1
        for a in group:
            seen = 1 + int(x[:, np.searchsorted(keys, terms[a])].all(1).sum())
            for b in group:
                if a != b:
                    d = vector[b] - vector[a]
                    tie += seen * np.outer(d, d)
    weights, bias = _fit(x, y, tie, l2, swap)
    return Toxicity(keys, weights, bias)


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", keep=None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on)."""

    def make():
        def f(t: Texts):
            p = model.probability(t)
            return [p, (p >= 0.5).astype(np.int32)]

        return f

    return map_texts(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text, keep)
