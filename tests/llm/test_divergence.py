"""The audit of sources against SQL and plain Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pulseframe.llm import divergence as module, queries
from pulseframe.llm.divergence import Leaves, Trie, audit_sources, share
from pulseframe.llm.textops import Texts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def terms_of(text) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs: list, least: int = 30, ranks: int = 50) -> list:
    """Rows of the audit of (text, lang, source) rows."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms_of(text))
        seen[lang].update(set(terms_of(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = lambda c, whole: 1 + 10**9 * (c + 5) // (whole + 5 * len(kept))  # noqa: E731, B023
        shares = {s: {t: p(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        whole = {t: p(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(shares[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", over, ranks)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(rows[:most])]
    return sorted(out)


def got(df) -> list:
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"HELD": 400, "BLOCK": 16, "MARK": 4, "RANGE": 100, "CELLS": 64}.items():
        monkeypatch.setattr(module, name, value)


def documents(n: int, langs: int = 2, sources: int = 5) -> list:
    r = random.Random(9)
    words = ["".join(r.choice("abcdéßжZ") for _ in range(r.choice([1, 2, 2, 3, 8, 9, 16, 25]))) for _ in range(150)]
    rows = []
    for _ in range(n):
        source = int(min(r.expovariate(0.7), sources - 1))
        rows.append((r.choice(" 1,\n").join(r.choice(words[source * 5 :]) for _ in range(r.randint(0, 40))), f"l{r.randrange(langs)}", f"s{source}"))
    return rows


def test_trie_orders_terms():
    r = random.Random(3)
    texts = ["".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 16, 17, 24, 40]))) for _ in range(2000)]
    texts += ["a" * 8, "a" * 8 + "b", "a" * 16, "a" * 16 + "b", "x" * 5000, "x" * 5000, "x" * 4999 + "y"] * 2
    whole = [t.encode() for t in texts]
    size = np.array(list(map(len, whole)))
    hi = np.cumsum(size)
    t = Trie(np.frombuffer(b"".join(whole), np.uint8), hi - size, hi)
    ordered = sorted(set(whole))
    assert len(t.one) == len(ordered) and all(ordered[t.leaf[i]] == x for i, x in enumerate(whole)) and all(whole[t.one[t.leaf[i]]] == x for i, x in enumerate(whole))


def test_merged_tries_are_the_trie_of_all():
    docs = documents(200)
    group = np.arange(200) % 7
    leaves = lambda a, b: Leaves.of_texts(Texts(pa.array([d[0] for d in docs[a:b]])), group[a:b], group[a:b] % 2)
    whole = leaves(0, 200)
    parts = Leaves.merged([Leaves.unpacked(leaves(a, a + 20).packed()) for a in range(0, 200, 20)])
    for a in Leaves.ARRAYS:
        assert (getattr(whole, a) == getattr(parts, a)).all()
    at = whole.below(whole.term(40))
    assert at == 40 and [whole.part(40, 50).term(i) for i in range(10)] == [whole.term(40 + i) for i in range(10)]


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(300):
        whole = r.randrange(1, 10 ** r.randint(1, 15))
        count = r.randrange(0, whole + 1)
        assert int(share(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * count // whole


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()["op11_source_divergence"](spark, sf)
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert got(df) == sorted(con.execute(module.ORACLE).fetchall())


def test_small_blocks_and_ranges(spark, small_blocks):
    docs = documents(800)
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert got(audit_sources(df, 10, 7)) == brute(docs, 10, 7)


def test_odd_rows(spark, odd, small_blocks):
    docs = [(r["text"], None if r["doc_id"] == 4 else "x" if r["doc_id"] == 12 else f"l{(r['doc_id'] or 0) % 2}", r["source"]) for r in odd.collect()]
    docs += [("only here", "alone", "s1"), (None, "empty", "s1"), (None, "empty", None), ("¡ÀÉ! don't x1y", "l0", "")]
    df = spark.createDataFrame([(*d, 1, "r", "p") for d in docs], "text string, lang string, source string, value int, rank string, part string")
    rows = got(audit_sources(df, 3))
    assert rows == brute(docs, 3) and ("empty", "s1", "pair", "", 0, 1) in rows
    assert got(audit_sources(df, 10_000)) == brute(docs, 10_000)
    assert audit_sources(df.limit(0)).count() == 0 and audit_sources(df.limit(0)).columns == COLUMNS
