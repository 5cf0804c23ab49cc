"""Support vectors, probabilities, path Shapley values and merge trees against brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from pulseframe.operators import clustering, linkage, supervised, trees
from pulseframe.operators.margins import SupportVectors, sigmoid_fit, smo


@pytest.mark.parametrize("seed", range(4))
def test_optimality_conditions(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(60, 3))
    y = (x[:, 0] + 0.7 * r.normal(size=60) > 0.4).astype(int)
    m = SupportVectors(x, y)
    s, k, top = 2.0 * y - 1, m.kernel(x, x), m.top[y]
    alpha, bias = smo(k, s, top)
    assert (alpha >= 0).all() and (alpha <= top).all() and abs(alpha @ s) < 1e-9
    margin = s * (k @ (alpha * s) + bias)
    assert (margin[alpha < 1e-12] >= 1 - 1e-5).all() and (margin[alpha > top - 1e-12] <= 1 + 1e-5).all()
    free = (alpha > 1e-9) & (alpha < top - 1e-9)
    assert free.any() and np.abs(margin[free] - 1).max() < 1e-5
    dual = lambda a: a.sum() - (a * s) @ k @ (a * s) / 2
    for _ in range(200):  # no feasible step along a pair of multipliers does better
        i, j = r.choice(60, 2, replace=False)
        step = r.normal() * 0.05
        other = alpha.copy()
        other[i] += s[i] * step
        other[j] -= s[j] * step
        if (other >= 0).all() and (other <= top).all():
            assert dual(other) <= dual(alpha) + 1e-6
    assert (m.decide(x) == (margin * s > 0)).all()


def test_sigmoid_is_the_best_one():
    r = np.random.default_rng(1)
    f = r.normal(size=80)
    y = (f + r.normal(size=80) > 0.3).astype(int)
    a, b = sigmoid_fit(f, y)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: -(t * np.log(1 / (1 + np.exp(a * f + b))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(a * f + b)))).sum()
    grid = min((loss(u, v), u, v) for u in np.linspace(a - 0.5, a + 0.5, 41) for v in np.linspace(b - 0.5, b + 0.5, 41))
    assert loss(a, b) <= grid[0] + 1e-9 and a < 0
    a, b = sigmoid_fit(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]))  # apart, so the targets' smoothing keeps it finite
    assert -5 < a < 0 and abs(b) < 1e-6


def test_probabilities_follow_inner_folds():
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 2))
    y = (np.hypot(*x.T) < 1).astype(int)
    m = SupportVectors(x, y)
    far = np.array([[0.0, 0.0], [3.0, 3.0]])
    assert m.decide(far).tolist() == [True, False] and m(far)[0] > 0.7 > 0.3 > m(far)[1]
    assert SupportVectors(x[:4], np.array([0, 0, 0, 1]))(far).shape == (2,)
    assert SupportVectors(x[:3], np.array([1, 1, 1])).decide(far).all()


def conditional(f: trees.Forest, at: int, v, known) -> float:
    j = f.feature[at]
    if j < 0:
        return f.value[at]
    a, b = f.left[at], f.right[at]
    if j in known:
        return conditional(f, a if v[j] <= f.cut[at] else b, v, known)
    return (f.cover[a] * conditional(f, a, v, known) + f.cover[b] * conditional(f, b, v, known)) / f.cover[at]


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_shapley_values_equal_all_subsets(depth):
    r = np.random.default_rng(depth)
    x = r.normal(size=(60, 4))
    y = (x[:, 0] * x[:, 1] + 0.2 * x[:, 2] > 0).astype(int)
    f = trees.Forest.grown(x, y, 12, depth, 2)
    rows = x[:5]
    got = f.shapley(rows)
    for v, phi in zip(rows, got):
        value = {s: np.mean([conditional(f, r0, v, s) for r0 in f.roots]) for n in range(5) for s in combinations(range(4), n)}
        for j in range(4):
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (value[tuple(sorted((*s, j)))] - value[s]) for s in value if j not in s)
            assert phi[j] == pytest.approx(want, abs=1e-12)
        assert phi.sum() == pytest.approx(f(v[None])[0] - value[()])
    assert f.importance(4).sum() == pytest.approx(1)


def test_twenty_features_in_tasks(spark):
    r = np.random.default_rng(0)
    names = [f"c{k}" for k in range(20)]
    x = r.normal(size=(90, 20))
    rows = [(i, int(v[3] + 0.3 * v[7] > 0), *map(float, v)) for i, v in enumerate(x)] + [(99, 1, None, *map(float, x[0][1:]))]
    df = spark.createDataFrame(rows, "k int, y int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    table = trees.forest_table(df, "y", names, 60, 4, batch=20)
    again = trees.forest_table(df.repartition(5), "y", names, 60, 4, batch=20)
    assert sorted(table.collect()) == sorted(again.collect()) and table.select("tree").distinct().count() == 60
    f = trees.Forest.of_table(table)
    shap = trees.shapley_rows(df, "k", names, f)
    assert shap.count() == 90 * 20
    i = trees.importance_table(shap, f, names).orderBy("rank").collect()
    assert i[0]["feature"] == "c3" and i[0]["direction"] == "up" and sum(r["share"] for r in i) == pytest.approx(1) and len(i) == 20
    z = clustering.standardised(x)
    total = {r["k"]: r["s"] for r in shap.groupBy("k").agg({"shap": "sum"}).toDF("k", "s").collect()}
    base = np.mean([conditional(f, r0, None, ()) for r0 in f.roots])
    assert all(total[k] == pytest.approx(f(z[k : k + 1])[0] - base) for k in range(0, 90, 9))
    with pytest.raises(Exception, match="rows at most"):
        trees.forest_table(df, "y", names, 2, most_rows=10).collect()


def test_metrics_of_folds(spark):
    rows = [("m", k, y, p, q, y == p) for k, (y, p, q) in enumerate([(1, 1, 0.9), (1, 0, 0.4), (1, 1, 0.6), (0, 0, 0.1), (0, 1, 0.7), (0, 0, 0.2), (0, 0, 0.3)])]
    m = supervised.model_metrics(spark.createDataFrame(rows, "model string, k int, y_true int, y_pred int, y_prob double, correct boolean")).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 3)
    assert m["balanced_accuracy"] == pytest.approx((2 / 3 + 3 / 4) / 2) and m["ppv"] == pytest.approx(2 / 3) and m["npv"] == pytest.approx(3 / 4) and m["f1_macro"] == pytest.approx((2 / 3 + 3 / 4) / 2) and m["auc"] == pytest.approx(10 / 12)


def brute_heights(x: np.ndarray) -> list[float]:
    """Each merge by trying all pairs; a height is the root of twice the growth of the inner sum of squares."""
    parts, out = [[i] for i in range(len(x))], []
    inner = lambda p: ((x[p] - x[p].mean(0)) ** 2).sum()
    while len(parts) > 1:
        grow, i, j = min((inner(parts[i] + parts[j]) - inner(parts[i]) - inner(parts[j]), i, j) for i in range(len(parts)) for j in range(i))
        out.append(np.sqrt(2 * max(grow, 0)))
        parts[j] = parts[j] + parts.pop(i)
    return out


def test_merge_tree(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(18, 3))
    z = linkage.ward_linkage(x)
    assert np.allclose(z[:, 2], brute_heights(x)) and z[-1, 3] == 18 and sorted(linkage.leaf_order(z)) == list(range(18))
    for k in range(1, 19):
        assert linkage.cut_tree(z, k).tolist() == clustering.ward_labels(x, k).tolist()
    rows = [(f"s{i:02d}", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("gap", None, 1.0, 1.0)], "k string, a double, b double, c double").repartition(4)
    m = linkage.merge_table(df, "k", ["a", "b", "c"]).orderBy("merge").collect()
    assert np.allclose([q["height"] for q in m], brute_heights(clustering.standardised(x))) and sum(q["height"] ** 2 for q in m) / 2 == pytest.approx(54)
    assert all(q["x"] == (q["x_a"] + q["x_b"]) / 2 for q in m)
    cut = linkage.cut_table(df, "k", ["a", "b", "c"], [2, 3]).collect()
    assert len(cut) == 36 and [q["cluster"] for q in sorted(cut) if q["n_clusters"] == 3] == clustering.ward_labels(clustering.standardised(x), 3).tolist()
    one = spark.createDataFrame(rows[:1], "k string, a double, b double, c double")
    assert linkage.merge_table(one, "k", ["a"]).count() == 0 and linkage.cut_table(one, "k", ["a"], [3]).first()["cluster"] == 1
    assert linkage.merge_table(one.limit(0), "k", ["a"]).count() == 0
