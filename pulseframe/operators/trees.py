"""Forests as flat node tables: growth in tasks, prediction, importances and path-based Shapley values in Arrow batches."""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "tree int, node int, feature int, cut double, left int, right int, value double, cover double, gain double"


def balanced_weights(y: np.ndarray) -> np.ndarray:
    n = np.bincount(y, minlength=2).astype(float)
    return (len(y) / (2 * np.maximum(n, 1)))[y]


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, leaf: int, features: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature or -1, cut, left, right, share of class 1, weight, gain) of one tree, the root first."""
    nodes: list[list] = []
    todo = [(np.arange(len(y)), depth, None, 0)]
    while todo:
        own, level, parent, side = todo.pop()
        at, total, ones = len(nodes), w[own].sum(), (w * y)[own].sum()
        if parent is not None:
            nodes[parent][side] = at
        nodes.append([-1, 0.0, -1, -1, ones / total, total, 0.0])
        if not level or ones <= 0 or ones >= total or len(own) < 2 * leaf:
            continue
        picked = rng.choice(x.shape[1], features, replace=False)
        v = x[np.ix_(own, picked)]
        order = np.argsort(v, axis=0, kind="stable")
        v = np.take_along_axis(v, order, 0)
        weight, one = np.cumsum(w[own][order], 0), np.cumsum((w * y)[own][order], 0)
        l, a = weight[:-1], one[:-1]
        r, b = total - l, ones - a
        impurity = 2 * ones * (1 - ones / total) - 2 * a * (1 - a / l) - 2 * b * (1 - b / r)
        place = np.arange(1, len(own))[:, None]
        impurity[(place < leaf) | (len(own) - place < leaf) | (v[1:] <= v[:-1])] = -np.inf
        i, j = np.unravel_index(int(np.argmax(impurity)), impurity.shape)
        if not impurity[i, j] > 1e-12 * total:
            continue
        cut = (v[i, j] + v[i + 1, j]) / 2
        nodes[at][:2], nodes[at][6] = [int(picked[j]), cut], impurity[i, j]
        goes = x[own, picked[j]] <= cut
        todo += [(own[~goes], level - 1, at, 3), (own[goes], level - 1, at, 2)]
    return [tuple(n) for n in nodes]


class Forest:
    """Flat arrays of all trees' nodes; roots: where each tree begins."""

    def __init__(self, trees: list[list[tuple]]) -> None:
        base = np.cumsum([0, *map(len, trees)])[:-1]
        flat = np.array([n for t in trees for n in t], float).reshape(-1, 7)
        shift = np.repeat(base, [len(t) for t in trees])
        self.roots = base
        self.feature, self.cut, self.value, self.cover, self.gain = flat[:, 0].astype(int), flat[:, 1], flat[:, 4], flat[:, 5], flat[:, 6]
        self.left, self.right = (np.where(flat[:, c] >= 0, flat[:, c] + shift, -1).astype(int) for c in (2, 3))

    @classmethod
    def grown(cls, x, y, trees: int = 500, depth: int = 2, leaf: int = 3, seed: int = 42) -> "Forest":
        rng, w, m = np.random.default_rng(seed), balanced_weights(y), max(1, int(np.sqrt(x.shape[1])))
        picks = (rng.integers(0, len(y), len(y)) for _ in range(trees))
        return cls([grow_tree(x[p], y[p], w[p], depth, leaf, m, rng) for p in picks])

    @classmethod
    def of_table(cls, nodes: DataFrame) -> "Forest":
        """From a node table; it has trees x 2 ** (depth + 1) rows at most."""
        trees: dict[int, list] = {}
        for r in nodes.sort("tree", "node").collect():
            trees.setdefault(r["tree"], []).append(tuple(r[2:]))
        return cls(list(trees.values()))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at].mean(1)
            goes = np.take_along_axis(x, np.maximum(self.feature[at], 0), 1) <= self.cut[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)

    def importance(self, features: int) -> np.ndarray:
        """Mean over trees of each feature's share of the tree's gains."""
        tree = np.searchsorted(self.roots, np.arange(len(self.gain)), "right") - 1
        by = np.zeros((len(self.roots), features))
        inner = self.feature >= 0
        np.add.at(by, (tree[inner], self.feature[inner]), self.gain[inner])
        whole = by.sum(1, keepdims=True)
        mean = (by / np.where(whole > 0, whole, 1)).sum(0)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def paths(self):
        """(leaf's value, [(feature, lower bound, upper bound, share of weight that goes this way)]) of every leaf, a feature once a path."""
        todo = [(r, {}) for r in self.roots]
        while todo:
            at, path = todo.pop()
            f = int(self.feature[at])
            if f < 0:
                yield self.value[at], [(k, *v) for k, v in path.items()]
                continue
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            cut = self.cut[at]
            for child, ends in ((self.left[at], (lo, min(hi, cut))), (self.right[at], (max(lo, cut), hi))):
                todo.append((int(child), path | {f: (*ends, share * self.cover[child] / self.cover[at])}))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row, where a missing feature goes both ways by weight.

        A leaf's share in a coalition is a product over the path's features: 1 or 0 by the row for those known, the
        share of weight for the others.  Summed with the coalitions' weights, that is a polynomial's coefficients:
        for each feature, the product of (share + known t) over the path's other features.
        """
        out = np.zeros(x.shape)
        for value, path in self.paths():
            m = len(path)
            if not m:
                continue
            known = np.stack([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi, _ in path], 1).astype(float)
            share = np.array([s for *_, s in path])
            weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            for j in range(m):
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1
                for i in range(m):
                    if i != j:
                        poly[:, 1:] = poly[:, 1:] * share[i] + poly[:, :-1] * known[:, i : i + 1]
                        poly[:, 0] *= share[i]
                out[:, path[j][0]] += value * (known[:, j] - share[j]) * (poly @ weight)
        return out / len(self.roots)


def complete_rows(df: DataFrame, first: list, columns: list[str]) -> DataFrame:
    """`first` and x, the array of the columns, of rows that have them all.  (One array, as the optimiser tries all subsets of renamed columns of a filter.)"""
    d = df.select(*first, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return d.where(F.forall("x", lambda v: v.isNotNull()))


def forest_table(df: DataFrame, label: str, columns: list[str], trees: int = 500, depth: int = 2, leaf: int = 3, seed: int = 42, batch: int = 25, most_rows: int = 100_000) -> DataFrame:
    """NODES of a forest that tasks grow, `batch` trees each with a seed of its own, on a matrix of at most most_rows rows.

    Rows with gaps are left out; columns are standardised first, as in leave_one_out().  The order of rows does not matter.
    """
    d = complete_rows(df, [F.col(label).cast("int").alias("y")], columns).where("y IS NOT NULL")
    one = d.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("y", "x"))).alias("rows"))
    one = one.select(F.when(F.col("n") <= most_rows, F.col("rows")).otherwise(F.raise_error(F.lit(f"a forest takes {most_rows} rows at most")).cast(one.schema["rows"].dataType)).alias("rows"))
    runs = df.sparkSession.range(-(-trees // batch)).repartition(-(-trees // batch)).crossJoin(F.broadcast(one))  # one row

    def run(batches):
        for b in batches:
            for i, rows in zip(b.column(0).to_pylist(), b.column(1)):
                rows = rows.as_py()
                if not rows:
                    continue
                y, x = np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows], float)
                sd = x.std(0)
                x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
                rng, w, m = np.random.default_rng([seed, i]), balanced_weights(y), max(1, int(np.sqrt(x.shape[1])))
                out = []
                for tree in range(i * batch, min((i + 1) * batch, trees)):
                    pick = rng.integers(0, len(y), len(y))
                    out += [(tree, node, *n) for node, n in enumerate(grow_tree(x[pick], y[pick], w[pick], depth, leaf, m, rng))]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in NODES.split(", ")])

    return runs.mapInArrow(run, NODES)


def shapley_rows(df: DataFrame, key: str, columns: list[str], forest: Forest) -> DataFrame:
    """key and, by column, value (standardised) and shap of each row, long form; the forest travels with the tasks."""
    d = complete_rows(df, [F.col(key)], columns)
    ends = d.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # one row
    mean, sd = (np.array([ends[f"{n}{i}"] or 0.0 for i in range(len(columns))]) for n in "ms")
    sd = np.where(sd > 0, sd, 1.0)
    schema = T.StructType([df.schema[key], T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("shap", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) / sd
            phi = forest.shapley(x)
            for j, name in enumerate(columns):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(x)), pa.array(x[:, j]), pa.array(phi[:, j])], [key, "feature", "value", "shap"])

    return d.mapInArrow(run, schema)


def importance_table(shap: DataFrame, forest: Forest, columns: list[str]) -> DataFrame:
    """feature, mean_abs_shap, share, rank, direction (the sign with which value and Shapley value go together), mean_raw_shap, gini; one row a feature."""
    from pyspark.sql import Window

    gini = shap.sparkSession.createDataFrame([(c, float(g)) for c, g in zip(columns, forest.importance(len(columns)))], "feature string, gini double")
    a = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_raw_shap"), F.covar_pop("value", "shap").alias("__c"))
    every = Window.partitionBy()  # one row a feature
    a = a.withColumn("share", F.try_divide("mean_abs_shap", F.sum("mean_abs_shap").over(every))).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))
    way = F.when(F.col("__c") > 0, "up").when(F.col("__c") < 0, "down").otherwise("none")
    return a.join(F.broadcast(gini), "feature").select("feature", "mean_abs_shap", "share", "rank", way.alias("direction"), "mean_raw_shap", "gini")
