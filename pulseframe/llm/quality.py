"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted here in numpy (histogram splits, logistic loss, monotone
constraints kept by bounding child values) and flattened into node arrays, so a
batch is scored by `depth` gathers per tree.

Edge cases: a null or empty text has statistics 0 and fails the base rules;
repeated rows are scored each; an id labelled twice has its larger label; equal
documents have equal scores; without labels all probabilities are 0.5; an empty
table gives an empty result; a column of the input that has the name of an added
one is replaced.  A very long text is one row of a slice: some tens of bytes of
arrays for each of its bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_sample
from .textops import SLICE_BYTES, Texts, count_between, distinct_by_row, map_texts, mix, range_hash, sum_by_row

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Feature -> direction of its influence on quality (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "bangs_per_word": -1, "upper_share": -1, "digit_share": 0,
    "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "words_per_line": 0, "stop_share": 0, "non_ascii_share": 0,
}


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """Counts of each text that the base rules and the features are made of."""
    w, buf = t.words(), t.buf
    n = w.count
    out = {"n_words": n, "word_chars": t.per_row(w.inside & ((buf & 0xC0) != 0x80)), "n_symbols": t.per_row(_SYMBOL[buf])}

    newline = np.flatnonzero(buf == 10)
    begins = np.zeros(len(buf) + 1, bool)
    begins[newline + 1] = True
    begins[t.off] = True
    lo = np.flatnonzero(begins[:-1])
    hi = np.r_[lo[1:], len(buf)]
    hi = np.where((hi > 0) & (buf[np.maximum(hi - 1, 0)] == 10), hi - 1, hi) if len(lo) else hi[:0]
    used = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
    lo, hi = lo[used], hi[used]
    row = np.searchsorted(t.off, lo, "right") - 1
    lines = np.bincount(row, minlength=t.rows)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - distinct_by_row(range_hash(buf, lo, hi), row, t.rows)

    m = len(w.hash) - 4
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if m > 0:
        at = np.flatnonzero(w.row[:m] == w.row[4:])
        h, r = w.ngrams(5)
        key = mix(h ^ mix(r.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 5, -1)
    out["n_repeat_words"] = sum_by_row((np.cumsum(covered)[:-1] > 0).astype(float), w.row, t.rows).astype(np.int64)
    out["n_distinct"] = distinct_by_row(w.hash, w.row, t.rows)
    out["n_bangs"] = t.per_row(buf == 33)
    out["n_upper"] = t.per_row((buf >= 65) & (buf <= 90))
    out["n_letters"] = t.per_row(((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 0xC0))
    out["n_digits"] = t.per_row((buf >= 48) & (buf <= 57))
    out["n_wide"] = t.per_row(buf >= 0xC0)
    out["n_short"] = sum_by_row((w.end - w.start <= 4).astype(float), w.row, t.rows).astype(np.int64)
    return out


def feature_matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n_words"], 1).astype(float)
    letters = np.maximum(s["n_letters"], 1)
    cols = [
        np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / n, s["n_bangs"] / n, s["n_upper"] / letters,
        s["n_digits"] / np.maximum(s["word_chars"], 1), s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n,
        s["n_distinct"] / n, s["n_words"] / np.maximum(s["n_lines"], 1), s["n_short"] / n, s["n_wide"] / letters,
    ]
    return np.stack(cols, 1).astype(np.float32)


class Trees:
    """Flat node arrays of all trees: feature, threshold, left child, value; right child = left + 1."""

    def __init__(self, base: float, roots, feature, threshold, left, value, depth: int) -> None:
        self.base, self.depth = base, depth
        self.roots = np.asarray(roots, np.int32)
        self.feature, self.left = np.asarray(feature, np.int32), np.asarray(left, np.int32)
        self.threshold, self.value = np.asarray(threshold, np.float32), np.asarray(value, np.float64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):  # a leaf points to itself with an infinite threshold
                node = self.left[node] + (x[rows, self.feature[node]] > self.threshold[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 8) -> Trees:
    """Second-order boosting on the logistic loss.

    A split on a constrained feature must order its children's values as asked
    and their middle bounds every value below (so whole trees are monotone).
    """
    y = y.astype(float)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    model = {"roots": [], "feature": [], "threshold": [], "left": [], "value": []}
    if not len(y):
        return Trees(base, depth=depth, **model)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), base)

    def node(value: float) -> int:
        at = len(model["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("value", value)):
            model[k].append(v)
        return at

    def grow(at: int, rows: np.ndarray, low: float, high: float, left: int) -> None:
        gs, hs = g[rows], h[rows]
        G, H = gs.sum(), hs.sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                gl = np.cumsum(np.bincount(code[rows, j], gs, k))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], hs, k))[:-1]
                nl = np.cumsum(np.bincount(code[rows, j], minlength=k))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(G - gl) / (H - hl + l2), low, high)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((G - gl) * vr + 0.5 * (H - hl + l2) * vr**2)
                v = np.clip(-G / (H + l2), low, high)
                gain = gain + G * v + 0.5 * (H + l2) * v**2
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (j, i, float(vl[i]), float(vr[i])))
        if best[1] is None:
            return
        j, i, vl, vr = best[1]
        a, b = node(rate * vl), node(rate * vr)
        model["feature"][at], model["threshold"][at], model["left"][at] = j, cuts[j][i], a
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
        goes = code[rows, j] > i
        grow(a, rows[~goes], *bounds[0], left - 1)
        grow(b, rows[goes], *bounds[1], left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node(rate * float(-g.sum() / (h.sum() + l2)))
        model["roots"].append(root)
        grow(root, np.arange(len(y)), -4.0, 4.0, depth)
        margin += Trees(0.0, depth=depth, **(model | {"roots": [root]})).margin(x)
    return Trees(base, depth=depth, **model)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col: str = "doc_id", text: str = "text", label: str = "quality", **fit) -> Trees:
    """Fit on at most `max_rows` labelled documents (those of least hash), whose statistics alone reach the driver.

    A repeated id counts once, with its text of least hash.
    """
    labelled = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    )
    picked = bounded_sample(labelled, id_col, max_rows)
    rows = docs.select(id_col, text).join(F.broadcast(picked), id_col).where(F.col(text).isNotNull())  # 12 bytes a row, max_rows at most
    rows = rows.withColumn("__h", F.xxhash64(text))
    got = map_texts(rows, lambda: lambda t: [_lists(feature_matrix(statistics(t)))], [T.StructField("x", T.ArrayType(T.FloatType()))], text, [id_col, "__y", "__h"])
    table = got.groupBy(id_col).agg(F.max("__y").alias("__y"), F.min(F.struct("__h", "x")).alias("__m")).select("__y", F.col("__m.x").alias("x")).toArrow()
    if not table.num_rows:
        return fit_trees(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), list(FEATURES.values()), **fit)
    x, y = np.array(table["x"].to_pylist(), np.float32), table["__y"].to_numpy()
    order = np.lexsort((y, *x.T[::-1]))  # the order of arrival does not matter
    return fit_trees(x[order], y[order], list(FEATURES.values()), **fit)


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.5, text: str = "text", keep=None) -> DataFrame:
    """Adds the statistics, base_failed, quality_score and kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def f(t: Texts):
            s = statistics(t)
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            p = model.probability(feature_matrix(s))
            return [*(s[c].astype(np.int64) for c in counts), failed, ~failed & (p >= threshold), p]

        return f

    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality_score", T.DoubleType())]
    return map_texts(docs, make, fields, text, keep, limit=SLICE_BYTES // 2)
