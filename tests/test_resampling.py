"""Permutation and bootstrap draws against exact laws and plain resampling."""

import itertools
from collections import Counter
from math import comb

import numpy as np
import pytest

from pulseframe.operators.resampling import bootstrap_median_places, chi_square, middle_places, permutation_from_margins, place_law, random_tables


def test_tables_have_the_law_of_label_shuffles():
    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]
    law = Counter()
    for p in itertools.permutations(b):
        t = np.zeros((3, 2), int)
        for i, j in zip(a, p):
            t[i, j] += 1
        law[t.tobytes()] += 1 / 720
    drawn = random_tables(np.array([3, 2, 1]), np.array([2, 4]), 40_000, np.random.default_rng(0))
    assert (drawn.sum(2) == [3, 2, 1]).all() and (drawn.sum(1) == [2, 4]).all()
    got = Counter(t.astype(int).tobytes() for t in drawn)
    assert set(got) == set(law) and all(abs(got[t] / 40_000 - law[t]) < 0.01 for t in law)


def test_permutation_p(spark):
    rows = [("a", 0)] * 9 + [("a", 1)] * 3 + [("b", 0)] * 4 + [("b", 1)] * 8 + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    r = permutation_from_margins(df, "g", "y", 20_000).first()
    # Exact: hypergeometric probabilities of all tables whose statistic reaches the observed one.
    tables = {k: np.array([[[k, 12 - k], [13 - k, k - 1]]]) for k in range(1, 13)}
    law = {k: comb(13, k) * comb(11, 12 - k) / comb(24, 12) for k in tables}
    observed = chi_square(tables[9])[0]
    assert r["observed"] == pytest.approx(observed) and r["rounds"] == 20_000
    assert r["p"] == pytest.approx(sum(p for k, p in law.items() if chi_square(tables[k])[0] >= observed - 1e-9), abs=0.01)
    assert permutation_from_margins(df, "g", "y", 20_000).first() == r  # again the same
    big = df.dropna()
    assert permutation_from_margins(big.unionByName(big), "g", "y", 300).first()["p"] <= r["p"]
    assert permutation_from_margins(df.limit(0), "g", "y", 100).count() == 0
    assert permutation_from_margins(df.where("y = 1"), "g", "y", 100).first()["p"] == 1


@pytest.mark.parametrize("n", [1, 2, 7, 12])
def test_places_have_the_law_of_the_middle(n):
    one, two = middle_places(n, 50_000, np.random.default_rng(n))
    got = np.searchsorted(np.sort(one), np.arange(n + 1), "right") / 50_000
    assert np.abs(got - place_law(n)).max() < 0.01 and (two >= one).all()
    brute = np.sort(np.random.default_rng(1).integers(1, n + 1, (50_000, n)), axis=1)
    assert np.abs(np.bincount(two, minlength=n + 1) / 50_000 - np.bincount(brute[:, n // 2], minlength=n + 1) / 50_000).max() < 0.012
    assert abs((one + two).mean() - (brute[:, (n - 1) // 2] + brute[:, n // 2]).mean()) < 0.05


def test_interval_of_groups(spark):
    r = np.random.default_rng(2)
    data = {"odd": r.normal(size=201), "even": np.round(r.normal(size=120), 1), None: np.array([4.0]), "flat": np.full(50, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("none", None)], "g string, v double")
    got = {row["g"]: row for row in bootstrap_median_places(df, "v", ("g",), 4000).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        draws = np.median(x[np.random.default_rng(5).integers(0, len(x), (20_000, len(x)))], axis=1)
        lo, hi = np.quantile(draws, [0.025, 0.975])
        assert got[k]["n"] == len(x) and got[k]["median"] == pytest.approx(np.median(x))
        assert abs(got[k]["lo"] - lo) < 0.06 and abs(got[k]["hi"] - hi) < 0.06
    whole = bootstrap_median_places(df, "v", (), 500).first()
    assert whole["n"] == 372 and whole["lo"] <= whole["median"] <= whole["hi"]
    assert bootstrap_median_places(df.limit(0), "v", ()).count() == 0


@pytest.mark.parametrize("n", [7, 2500, 2501])
def test_hashed_rounds_look_up_their_middles_only(spark, n):
    """Medians of draws by hash, worked out in full here; the plan has no median of looked-up rows."""
    import hashlib

    from pulseframe.operators import statistics

    v = np.sort(np.random.default_rng(n).normal(size=n).round(2))
    d = spark.createDataFrame([(float(x), "one") for x in v] + [(None, "one"), (1.5, "two")], "x double, g string")
    rounds = 25
    want = [np.median(v[[int(hashlib.md5(f"{r}-{k}-42".encode()).hexdigest()[:15], 16) % n for k in range(n)]]) for r in range(rounds)]
    lo, hi = np.quantile(want, [0.025, 0.975])
    got = statistics.bootstrap_median(d.where("g = 'one'"), "x", rounds)
    by = statistics.bootstrap_median_by_group(d, "x", "g", rounds)
    assert "median(" not in got._jdf.queryExecution().toString() + by._jdf.queryExecution().toString()
    assert tuple(got.first()) == pytest.approx((lo, hi))
    assert {r["g"]: (r["lo"], r["hi"]) for r in by.collect()} == {"one": pytest.approx((lo, hi)), "two": (1.5, 1.5)}
