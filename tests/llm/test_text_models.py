"""Quality trees, language model, toxicity and personal data."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
SMALL = "/root/testdata/sf0.001"
from pyspark.sql import functions as F

from pulseframe.llm.language_model import CLASS_SIZE, CLASSES, GRU, HIDDEN, Vocabulary, _most_frequent, log_probabilities, score_texts, tokens, train
from pulseframe.llm.pii import find_pii, reliabilities, span_counts, span_text
from pulseframe.llm.shared import running_sums
from pulseframe.llm import quality
from pulseframe.llm.quality import FEATURES, fit_quality, fit_trees, score_quality
from pulseframe.llm.textops import Texts, range_hash
from pulseframe.llm.toxicity import IDENTITY_TERMS, _fit, fit_toxicity, score_toxicity

from .conftest import prose, words


def test_statistics_against_brute_force(spark, odd, labels):
    docs = odd.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source"), allowMissingColumns=True)
    got = score_quality(docs, fit_quality(odd, labels), keep=["text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert score_quality(odd.limit(0), fit_quality(odd, labels)).count() == 0
    assert len(fit_quality(odd, labels.limit(0)).roots) == 0


def test_trees_are_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3)).astype(np.float32)
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + 0.3 * r.normal(size=600) > 0).astype(int)
    model = fit_trees(x, y, [1, -1, 0])
    grid = np.repeat(r.normal(size=(50, 3)).astype(np.float32), 40, 0)
    for j, way in ((0, 1), (1, -1)):
        v = grid.copy()
        v[:, j] = np.tile(np.linspace(-3, 3, 40, dtype=np.float32), 50)
        assert (way * np.diff(model.margin(v).reshape(50, 40), axis=1) >= -1e-9).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.8
    assert len(FEATURES) == 12


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = fit_quality(docs, labels.where("doc_id % 3 <> 0"))
    r = score_quality(docs, model).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([x["kept"] == (x["quality"] == 1) for x in r]) > 0.95


def test_unigram_scores(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).cache()
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, words((t or "").translate(low)) + [None]) for i, t in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3)) for i, t in rows)
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in score_texts(docs, training).collect()]
    assert [x[:5] for x in sorted(got)] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) <= 2e-3 for a, b in zip(sorted(got), want))
    assert score_texts(docs.limit(0), training).count() == 0


def test_model_beats_unigrams(spark):
    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    r = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), training).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_gradient_and_carried_state():
    r = np.random.default_rng(0)
    counts = np.sort(r.integers(1, 90, CLASSES * CLASS_SIZE))[::-1]
    v = Vocabulary(r.integers(1, 1 << 62, len(counts)).astype(np.uint64), counts, int(counts.sum()) + 50, len(counts) + 20)
    m = GRU(v)
    m.class_w += r.normal(0, 0.3, m.class_w.shape).astype(np.float32)
    m.word_w += r.normal(0, 0.3, m.word_w.shape).astype(np.float32)
    ids = r.integers(-1, len(counts), 200)
    off = np.array([0, 90, 91, 200])
    whole = log_probabilities(m, ids, off)
    for a, b in zip(off[:-1], off[1:]):  # a text's score does not depend on its neighbours or on windows
        assert np.allclose(log_probabilities(m, ids[a:b], np.array([0, b - a])), whole[a:b], atol=1e-3)
    states = r.normal(size=(4, HIDDEN)).astype(np.float32)
    total = sum(np.exp(m.outputs(states, np.full(4, k))[0]) for k in range(-1, len(counts)))
    assert np.allclose(total, 1, atol=1e-3)  # a distribution over all words
    target = np.array([3, -1, 70, 900])
    g: dict = {}
    _, d = m.outputs(states, target, g)
    for i, j in ((0, 0), (1, 5), (3, 9)):
        s = states.astype(np.float64).copy()
        e = 1e-2
        up, down = s.copy(), s.copy()
        up[i, j] += e
        down[i, j] -= e
        num = -(m.outputs(up.astype(np.float32), target)[0].sum() - m.outputs(down.astype(np.float32), target)[0].sum()) / (2 * e)
        assert d[i, j] == pytest.approx(num, abs=2e-2)


def test_tokens_end_each_text():
    h, off = tokens(Texts(pa.array(["A b", None, "a B"])))
    assert off.tolist() == [0, 3, 4, 7] and h[2] == h[3] == h[6] and h[0] == h[4]


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels, ~held)
    r = score_toxicity(docs, model, keep=["doc_id"]).join(labels.where(held), "doc_id").collect()
    assert np.mean([x["predicted"] == x["toxic"] for x in r]) > 0.97
    p = model.probability(Texts(pa.array([f"the {w} are here" for g in IDENTITY_TERMS for w in g] + ["the idiot moron", ""])))
    assert p[:-2].max() < 0.5 and p[-2] > 0.5 and np.ptp(p[:-2]) < 0.05  # neutral mentions stay neutral


def test_toxicity_odd_rows(spark, odd, labels):
    model = fit_toxicity(odd, labels, F.lit(True))
    r = score_toxicity(odd, model).collect()
    assert len(r) == odd.count() and all(0 <= x["score"] <= 1 for x in r)
    none = fit_toxicity(odd, labels.limit(0), F.lit(True))
    assert score_toxicity(odd.limit(1), none).first()["score"] == pytest.approx(0.5)
    assert score_toxicity(odd.limit(0), model).count() == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_spans_against_brute_force(spark, odd):
    import random

    r = random.Random(1)
    texts = ["a@b.c_d@e.f x+y@z.co.uk. é😀 q@w.e", "1.2.3.4.5.6.7.8 001.2.3.0004 300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 12 12 " + "1 " * 3000, "+1 (017) 555-7713 +49 30 1234567890 +", "x" * 5000 + "9" * 5000, "Call me: (212) 555-1234, Dr. John Smith, 078-05-1120"]
    texts += ["".join(r.choice("0123456789 -.+@ab()_é") for _ in range(r.randint(1, 120))) for _ in range(800)]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    docs = docs.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    got = find_pii(docs, ["text"]).select("text", span_text(F.col("base")).alias("b"), span_text(F.col("spans")).alias("s"), *span_counts(F.col("base"))).collect()
    assert len(got) == docs.count()
    for x in got:
        assert x["b"] == base_spans(x["text"] or "")
        assert set(x["b"].split(",")) <= set(x["s"].split(",")) or not x["b"]
        assert x["n_email"] == x["b"].count("email:")
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
    assert find_pii(docs.limit(0), ["text"]).count() == 0


def test_other_kinds(spark):
    texts = [f"Call me: (212) 555-{1000 + i}, Dr. John Smith, ssn 078-05-{1200 + i}" for i in range(30)]
    texts += ["Sehr geehrte Frau Müller, liebe Grüße", "api_key = sk_4f9a8b7c6d5e4f3a2b1c0d", "Estimado Sr. Pérez: hola", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f6"']
    clean = ["Mr President said version 212-555-1234 of order 000-00-0000", "the token: ring of seventeen", "A Frau ohne Namen"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + clean)], "doc_id long, text string")
    got = {r["text"]: [x.split(":") for x in r["s"].split(",") if x] for r in find_pii(docs, ["text"]).select("text", span_text(F.col("spans")).alias("s")).collect()}
    found = lambda t: {(k, t[int(a) : int(b)]) for k, a, b in got[t]}
    for i in range(30):
        assert found(texts[i]) == {("local_phone", f"(212) 555-{1000 + i}"), ("name", "Dr. John Smith"), ("national_id", f"078-05-{1200 + i}")}
    assert found(texts[30]) == {("name", "Frau Müller")} and found(texts[32]) == {("name", "Sr. Pérez")}
    assert {k for k, _ in found(texts[31])} == {k for k, _ in found(texts[33])} == {"secret"}
    assert not any(found(t) for t in clean[1:]) and not any(k == "name" for k, _ in found(clean[0]))


def test_expectation_maximisation():
    """Counts drawn from known reliabilities: the posteriors tell true candidates from false ones and the likelihood never falls."""
    r = np.random.default_rng(4)
    truth = r.random(20_000) < 0.6
    votes = [np.where(r.random(20_000) < q, np.where(truth, 1, -1), np.where(r.random(20_000) < 0.5, 0, np.where(truth, -1, 1))) for q in (0.95, 0.6, 0.75)]
    counted = Counter(zip(*(v.tolist() for v in votes)))
    patterns = [("k", *v, n) for v, n in sorted(counted.items())]
    post, rate = reliabilities(patterns)
    p = np.array([post["k", *v] for v in zip(*(x.tolist() for x in votes))])
    assert ((p > 0.5) == truth).mean() > 0.95
    assert rate[0, 1][1] == pytest.approx(0.95, abs=0.03) and rate[2, 1][1] == pytest.approx(0.75, abs=0.05)

    def likelihood(rounds):
        _, rate = reliabilities(patterns, rounds)
        share = sum(n * reliabilities(patterns, rounds)[0]["k", *v] for _, *v, n in patterns) / 20_000
        return sum(n * math.log(share * math.prod(rate[j, 1][x] for j, x in enumerate(v)) + (1 - share) * math.prod(rate[j, 0][x] for j, x in enumerate(v))) for _, *v, n in patterns)

    assert likelihood(1) < likelihood(5) <= likelihood(30) + 1


def test_offsets_of_many_matches(spark):
    import itertools

    rows = [(k, [k % 7] * k) for k in (0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000)]
    for r in spark.createDataFrame(rows, "k int, a array<int>").select("a", running_sums(F.col("a")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["a"]))
    text = " ".join(f"u{i}@mail{i}.org" for i in range(100_000))
    got = find_pii(spark.createDataFrame([(text,)], "text string"), ["text"]).select(F.size("base").alias("n"), F.expr("base[99999].end").alias("end")).first()
    assert (got["n"], got["end"]) == (100_000, len(text))


def test_toxicity_against_brute_force(spark, odd):
    """Scores by plain Python; the fit is at its optimum; swapped sentences score alike."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = fit_toxicity(docs, labels, F.lit(True))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    own = lambda word: [h for h in _hashes(word)]

    def brute(text):
        keys = set()
        for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
            keys |= set(own(w))
        return 1 / (1 + math.exp(-(model.bias + sum(weight.get(k, 0.0) for k in keys))))

    some = docs.select("doc_id", "text").limit(40).unionByName(odd.select("doc_id", "text"))
    for r in score_toxicity(some, model).collect():
        assert r["score"] == pytest.approx(brute(r["text"]), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def _hashes(word):
    low = word.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    one = lambda b: int(range_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    return [one(low)] + [one(low[:k]) ^ k for k in range(4, 9) if len(low) > k]


def test_toxicity_fit_is_the_optimum():
    r = np.random.default_rng(2)
    x = (r.random((400, 6)) < 0.4).astype(np.float32)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    d = np.array([0, 0, 0, 0, 1.0, -1])
    tie = 5 * np.outer(d, d)
    w, b = _fit(x, y, tie, 0.3, 50.0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 0.3 * w + 50 * tie @ w).max() < 1e-2 and abs((p - y).sum()) < 1e-2
    assert abs(w[4] - w[5]) < 0.05  # the swap penalty ties the two


def test_toxicity_of_repeated_ids(spark):
    docs = [(0, prose(0, 30))] * 500 + [(i, prose(i, 30) + " gruzzle" * (i % 2)) for i in range(1, 80)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    a, b = (fit_toxicity(spark.createDataFrame(d, "doc_id long, text string"), marks, F.lit(True), max_rows=80, least_z=3.0) for d in (docs, docs[::-1]))
    assert np.array_equal(a.keys, b.keys) and np.allclose(a.weights, b.weights)
    assert a.probability(Texts(pa.array(["some gruzzle"])))[0] > a.probability(Texts(pa.array(["some text"])))[0]


def test_one_long_text_among_short_ones():
    """Memory of the scoring follows the tokens, not the longest text times the lanes."""
    import tracemalloc

    r = np.random.default_rng(0)
    counts = np.sort(r.integers(1, 90, 300))[::-1]
    m = GRU(Vocabulary(r.integers(1, 1 << 62, 300).astype(np.uint64), counts, int(counts.sum()), 300))
    off = np.r_[0, 60_000, 60_000 + np.cumsum(np.full(255, 3))]
    ids = r.integers(-1, 300, off[-1])
    tracemalloc.start()
    got = log_probabilities(m, ids, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # a row of places for each lane would take 120 MB
    assert np.allclose(got[off[7] : off[8]], log_probabilities(m, ids[off[7] : off[8]], np.array([0, 3])), atol=1e-3)


def test_recurrent_gradient():
    """One step of plain descent changes the loss of a window as finite differences say, through the carried state."""
    r = np.random.default_rng(1)
    counts = np.sort(r.integers(1, 90, 200))[::-1]
    v = Vocabulary(r.integers(1, 1 << 62, 200).astype(np.uint64), counts, int(counts.sum()), 200)
    words, begins = r.integers(0, 200, (6, 4)), np.zeros((6, 4), bool)
    begins[3, 1] = True
    target, h = r.integers(0, 200, (6, 4)), r.normal(0, 0.5, (4, HIDDEN)).astype(np.float32)

    def fresh():
        m = GRU(v)
        g = np.random.default_rng(9)
        m.class_w += g.normal(0, 0.3, m.class_w.shape).astype(np.float32)
        m.word_w += g.normal(0, 0.3, m.word_w.shape).astype(np.float32)
        m.gates *= 3
        m.candidate *= 3
        return m

    def loss(m):
        states, _, _ = m.window(words, begins, h)
        return -m.outputs(states.reshape(-1, HIDDEN), target.ravel())[0].sum() / target.size

    class Plain(dict):  # a memory that stays at one, so that the update is the gradient
        def setdefault(self, k, x):
            return np.full_like(x, np.float32(1e12))

    m = fresh()
    m.train_window(words, begins, target, h.copy(), Plain(), 1e6)
    start = fresh()
    for name, at in (("gates", (3, 5)), ("gates", (7, HIDDEN + 2)), ("candidate", (1, 4)), ("inputs", (int(words[2, 0]), 2 * HIDDEN + 3)), ("inputs", (int(words[0, 1]), 1)), ("class_w", (2, 0)), ("word_b", (0, 5))):
        gradient = float(getattr(start, name)[at] - getattr(m, name)[at])
        up, down = fresh(), fresh()
        getattr(up, name)[at] += 0.02
        getattr(down, name)[at] -= 0.02
        assert gradient == pytest.approx((loss(up) - loss(down)) / 0.04, abs=2e-4), name


def test_flat_vocabulary_fills_the_model(spark):
    flat = spark.range(66_000).selectExpr("id AS h", "1L AS c")
    assert [r["h"] for r in _most_frequent(flat, 65_536)] == list(range(CLASSES * CLASS_SIZE))
    mixed = flat.unionAll(spark.range(-10, 0).selectExpr("id AS h", "50L AS c"))
    assert [r["h"] for r in _most_frequent(mixed, 65_536)] == list(range(-10, CLASSES * CLASS_SIZE - 10))


def test_training_uses_the_last_tokens(spark):
    text = " ".join("w%d" % (i % 9) for i in range(63)) + " once"  # 65 tokens with the end: two lanes and one token over
    h, n = np.unique(tokens(Texts(pa.array([text], pa.large_string())))[0], return_counts=True)
    order = np.lexsort((h, -n))
    vocabulary = Vocabulary(h[order], n[order], 65, len(h))
    model = train(spark.createDataFrame([(text,)], "text string").coalesce(1), vocabulary)
    at = vocabulary.find(tokens(Texts(pa.array(["once"], pa.large_string())))[0])[0][0]
    assert at >= 0 and not np.array_equal(model.inputs[at], GRU(vocabulary).inputs[at])


def test_copies_of_an_id_crowd_out_no_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, monotone, **fit: seen.append((x, y)))
    docs = [(0, prose(i % 2, 30 + i % 2)) for i in range(400)] + [(i, prose(i, 40 + i)) for i in range(1, 8)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    for rows in (docs, docs[::-1]):
        fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), marks, max_rows=8)
    (x, y), (x2, y2) = seen
    assert len(y) == 8 and y.sum() == 4 and np.array_equal(x, x2) and np.array_equal(y, y2)


def test_few_words_are_bisected(monkeypatch):
    r = np.random.default_rng(8)
    known = np.unique(r.integers(0, 2**64, 60_000, dtype=np.uint64))
    known = r.permutation(np.unique(np.r_[known, np.arange(4, dtype=np.uint64), known[:3] + np.uint64(1)]))  # some share their first bits
    counts = r.integers(1, 99, len(known))
    asked = np.r_[known, r.integers(0, 2**64, 5000, dtype=np.uint64), np.uint64(2**64 - 1)]
    vocabulary, seen, plain = Vocabulary(known, counts, int(counts.sum()), len(known)), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: seen.append(np.size(v)) or plain(a, v, *rest, **more))
    ids, found, there = vocabulary.find(asked)
    assert sum(seen) < len(asked) // 10
    place = {int(h): k for k, h in enumerate(known)}
    for h, i, c, ok in zip(asked.tolist(), ids, found, there):
        k = place.get(h)
        assert ok == (k is not None) and c == (counts[k] if ok else 0) and i == (k if ok and k < CLASSES * CLASS_SIZE else -1)
