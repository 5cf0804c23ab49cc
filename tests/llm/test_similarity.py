"""Jaccard join and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SMALL = "/root/testdata/sf0.001"
from pyspark.sql import functions as F

from pulseframe.llm.decontamination import Index, find_leaks, mark_leaks, search_plan
from pulseframe.llm.jaccard_join import _overlaps, jaccard_classes, runs_needed, shingle_sets
from pulseframe.llm.textops import Texts

from .conftest import prose, words


def sets_of(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{row: (links, least id of its class)} of (id, text) rows with unique ids."""
    sets = {i: sets_of(t) for i, t in rows}
    ids = sorted(sets)
    parent, links = {i: i for i in ids}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in ids}


def edited(text, r, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "new%d" % r.randrange(10**6)
    return " ".join(w)


def close(got, want):
    """No false link, next to none lost, and the same classes."""
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.995 * sum(n for n, _ in want.values())
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_against_brute_force(spark):
    r = random.Random(0)
    shared = prose(9, 60)
    rows = [prose(i, 40 + i % 50) + " " + shared for i in range(120)]
    for k in range(6):
        base = prose(500 + k, 150)
        rows += [edited(base, r, r.randrange(0, 5)) for _ in range(10 + 30 * (k == 0))]
    rows += ["two words", "two words", "", None, "a b c d"]
    rows = list(enumerate(rows))
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close(got, brute(rows))


def test_whole_small_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in jaccard_classes(d).collect()}
    close(got, brute([tuple(x) for x in d.collect()]))


def test_large_group_in_blocks(spark, monkeypatch):
    from pulseframe.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    r, base = random.Random(4), prose(77, 400)
    rows = list(enumerate(edited(base, r, r.randrange(1, 4)) for _ in range(90)))
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close(got, brute(rows))


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """Hot paths, copies, labels and hubs take their own way from a few rows on, with the same result."""
    from pulseframe.llm import jaccard_join, shared

    r, base, shared_text = random.Random(4), prose(77, 300), prose(9, 60)
    rows = [edited(base, r, r.randrange(1, 4)) for _ in range(120)] + [prose(5, 50)] * 40 + [prose(i, 40) + " " + shared_text for i in range(60)] + ["", None] * 20
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in (("SMALL", 8), ("BLOCK", 16), ("HOT_SAMPLED", 0)):
        monkeypatch.setattr(jaccard_join, k, v)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    seen = []
    real = jaccard_join._hot_paths
    monkeypatch.setattr(jaccard_join, "_hot_paths", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in jaccard_classes(df).collect()}
    close(got, brute(rows))
    assert any(True in x.values() for x in seen) and any(False in x.values() for x in seen)
    table = shared.written(df, "salted")
    hot = shared.hot_values(table.withColumn("k", F.length("text")), "k")
    assert hot and all(n > 5 for n in [sum(len(t or "") == h for _, t in rows if t is not None) for h in hot if h is not None])


def test_join_needs_one_worker_a_task(spark, monkeypatch):
    """No stage runs one Python function on another's rows, hot paths of the first level neither: each takes a worker of its own."""
    from pulseframe.llm import jaccard_join

    r, base = random.Random(4), prose(77, 300)
    rows = list(enumerate([edited(base, r, r.randrange(1, 4)) for _ in range(120)] + [prose(i, 40) for i in range(60)]))
    for k, v in (("SMALL", 8), ("BLOCK", 16), ("HOT_SAMPLED", 0)):
        monkeypatch.setattr(jaccard_join, k, v)
    plans, hot = [], []
    real, paths = jaccard_join.written, jaccard_join._hot_paths
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df, name))
    monkeypatch.setattr(jaccard_join, "_hot_paths", lambda *a: hot.append(paths(*a)) or hot[-1])
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close(got, brute(rows))
    assert hot[0] and sum(p.count("MapInArrow") for p in plans) > 3
    for plan in plans:
        nodes = [n for line in plan.split("\n") for n in ("MapInArrow", "Exchange", "Scan", "Union") if n in line.split("(")[0].split("[")[0]]
        assert ("MapInArrow", "MapInArrow") not in set(zip(nodes, nodes[1:]))


def test_workers_forget_what_others_kept():
    from pulseframe.llm.workers import kept, released

    kept("encoders")["a"], kept("other")["b"] = 1, 2
    assert list(released(iter, ("encoders",))([3])) == [3] and kept("encoders") == {"a": 1} and not kept("other")
    assert list(released(iter)([])) == [] and not kept("encoders")


def test_runs_for_the_recall():
    assert runs_needed(0.8, 0.9999, 0.56) >= runs_needed(0.8, 0.9999) >= runs_needed(0.9, 0.9999)
    with pytest.raises(ValueError):
        runs_needed(0.8, 0.99, 0.8)  # half of the pairs at the threshold have less alike sketches


def test_odd_rows(spark, odd):
    got = jaccard_classes(odd).collect()
    assert len(got) == odd.count()
    six = [x for x in got if x["doc_id"] == 6]
    assert [(x["class_id"], x["n_links"]) for x in six] == [(6, 2), (6, 2)]
    assert [x["n_links"] for x in got if x["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert jaccard_classes(odd.limit(0)).count() == 0


def test_overlaps_and_runs():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = _overlaps(sets)
    assert all(got[i, j] == want[i][j] for i in range(12) for j in range(12) if i != j)
    assert 1 <= runs_needed(0.8, 0.99) <= runs_needed(0.8, 0.9999)
    h, off = shingle_sets(Texts(pa.array(["a b c d e f a b c d e", "x", None])))
    assert np.diff(off).tolist() == [6, 1, 0]


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 24)))) for i in range(8)]
    docs = []
    for d in range(40):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if d % 2:
            x = items[d % 8][1].split()
            for _ in range(r.randint(0, max(1, len(x) // 5))):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], ["zz"], [x[k], "yy"]))
            k = r.randint(0, len(body))
            body[k:k] = x
        docs.append((d, " ".join(body)))
    want = {}
    for d, t in docs:
        w = t.split()
        for i, s in items:
            m = s.split()
            best = min((levenshtein(m, w[a : a + len(m)]) for a in range(len(w))), default=99)
            if best <= int(0.2 * len(m) + 1e-9):
                want[d, i] = best
    rows = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in rows}
    assert all(x["recall"] >= 0.95 and 0 <= x["repeats"] <= 64 for x in rows)
    assert not set(got) - set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= expected(len(want))
    in_blocks = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=64)
    assert len(set(got) ^ {(x["doc_id"], x["item_id"]) for x in in_blocks.collect()}) <= 2  # other repetitions


def test_exact_leaks_are_all_found(spark, odd):
    item = "".join(c.upper() if c.isascii() else c for c in prose(2, 60)).replace(" ", ", ")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted(x["doc_id"] for x in find_leaks(odd, bench).collect()) == [6, 6, 7]
    marked = mark_leaks(odd, bench)
    assert marked.where("leaks").count() == 3 and marked.count() == odd.count() and set(marked.columns) == set(odd.columns)
    assert find_leaks(odd.limit(0), bench).count() == 0 and find_leaks(odd, bench.limit(0)).count() == 0


def test_search_plan(spark):
    bench = spark.createDataFrame([(i, prose(i, m)) for i, m in enumerate((3, 12, 40, 40, 80, 160, 300))], "item_id long, text string")
    plan = {r["n_words"]: r for r in search_plan(bench).collect()}
    assert set(plan) == {3, 12, 40, 80, 160, 300} and plan[3]["edits"] == 0 and plan[3]["repeats"] == 1
    assert all(r["recall"] >= 0.95 and (r["repeats"] or r["recall"] == 1) for r in plan.values())
    assert search_plan(bench.limit(0)).count() == 0


def test_recall_target():
    index = Index([1], [prose(1, 40)], 0.2, 0.95)
    assert 1 <= index.repeats <= 64
    assert F.lit(1) is not None


def expected(n: int, recall: float = 0.95) -> float:
    """Finds of n at the recall, less two standard errors."""
    return recall * n - 2 * (n * recall * (1 - recall)) ** 0.5


def test_leaks_of_long_items_at_the_most_edits():
    r, texts, items, want = random.Random(17), [], [], set()
    for k, m in enumerate((12, 20, 30, 40, 50, 58, 60, 75, 100, 150, 200, 300) * 8):
        x = ["w%d" % r.randrange(3000) for _ in range(m)]
        y = list(x)
        for j, at in enumerate(sorted(r.sample(range(m), m // 5), reverse=True)):  # as many words in as out
            y[at : at + 1] = (["new%d" % j], [], [x[at], "new%d" % j])[j % 3 if j < m // 5 // 3 * 3 else 0]
        items.append(" ".join(x))
        texts.append(" ".join(["a%d" % j for j in range(k)] + y + ["b%d" % j for j in range(k % 5)]))
        if min(levenshtein(x, texts[k].split()[k : k + m]), levenshtein(x, texts[k].split()[k - 1 : k - 1 + m])) <= m // 5:
            want.add((k, k))
    assert len(want) >= 90
    index = Index(list(range(len(items))), items, 0.2, 0.95)
    row, item, edits, first = index.leaks(Texts(pa.array(texts, pa.large_string())))
    got = set(zip(row.tolist(), item.tolist()))
    for m in (12, 20, 30, 40, 50, 58, 60, 75, 100, 150, 200, 300):
        own = {(k, i) for k, i in want if len(items[i].split()) == m}
        assert len(own & got) >= expected(len(own)) if m < 60 else own <= got, m
    short = {(k, i) for k, i in want if len(items[i].split()) < 60}
    assert len(short) >= 45 and len(short & got) >= expected(len(short))
    for k, i, e, f in zip(row.tolist(), item.tolist(), edits.tolist(), first.tolist()):
        m = items[i].split()
        assert levenshtein(m, texts[k].split()[f : f + len(m)]) == e <= len(m) // 5
