"""Audit of how the sources of each language differ in their terms, by mergeable radix tries.

Terms are runs of letters and of characters beyond ASCII, with A-Z in lower case.  Each task puts the terms of its
texts into byte tries, whose edges hold eight bytes, with counters at the leaves: occurrences by source and documents
by language.  Tries merge like the words they are grown from; a task merges what it holds and, when that is large,
sends it on as blocks of neighbouring leaves.  Splitters from marks (the prefix of some leaf in every MARK) cut the
blocks into prefix ranges of equal weight, and a task merges the blocks of a range as they come, in UTF-8 order: what
lies before the next block's first term is complete and leaves the memory.  Complete terms in too few documents of a
language go; a traversal of the rest gives the sums for pairs of sources and the terms that each source overuses, ties
in UTF-8 order.

Shares are exact integers, 1 + floor(10**9 * (count + 5) / (N + 5 V)), by long division where 64 bits would not do.

Edge cases: null texts, languages and sources count as ''; rows are documents, so repeated ones count again; a group
without terms has all shares from the added 5; a language without kept terms has pairs of value 0 and no terms;
one with a single source has no pairs; empty tables give an empty result; other columns are not read.  What is
collected or sent to all tasks is one row a (language, source) group, fewer than the pairs of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textops import Ranges, Texts, Words, slices

_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Counters that a task holds, leaves in a block, leaves for a mark, counters that a range should have, cells of a matrix.
HELD, BLOCK, MARK, RANGE, CELLS = 1 << 20, 8192, 256, 1 << 21, 1 << 21
_TOP = np.uint64(1 << 63)


class Trie:
    """A radix trie of byte ranges without zero bytes, grown a level (eight bytes) at a time.

    leaf: for each range the place of its term in UTF-8 order; one: for each term a range that holds it.
    An edge to a node with one range stands for all that is left of it.
    """

    def __init__(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        r = Ranges(buf, lo, hi)
        words, first = np.ones(len(lo), np.int64), np.zeros(len(lo), np.int64)
        words[r.long] += np.diff(r.first)
        first[r.long] = r.first[:-1]
        levels = []  # of each: its nodes' parents, whether a term ends in a node, ranges that go no deeper and their nodes
        on, up, depth = np.arange(len(lo)), np.zeros(len(lo), np.int64), 0
        while len(on):
            edge = (r.more[first[on] + depth - 1] if depth else r.head).byteswap()
            order = np.lexsort((edge, up)) if depth else np.argsort(edge)
            edge, above = edge[order], up[order]
            new = np.ones(len(on), bool)
            new[1:] = (edge[1:] != edge[:-1]) | (above[1:] != above[:-1])
            node = np.empty(len(on), np.int64)
            node[order] = np.cumsum(new) - 1
            among = np.bincount(node)
            deeper = (words[on] > depth + 1) & (among[node] > 1)
            levels.append((above[new], among > np.bincount(node[deeper], minlength=len(among)), on[~deeper], node[~deeper]))
            on, up, depth = on[deeper], node[deeper], depth + 1
        counts = [x[1].astype(np.int64) for x in levels]  # of terms at and below each node
        for d in range(len(levels) - 1, 0, -1):
            np.add.at(counts[d - 1], levels[d][0], counts[d])
        self.leaf = np.zeros(len(lo), np.int64)
        begin = np.zeros(0, np.int64)
        for d, (above, ends, held, node) in enumerate(levels):
            sums = np.cumsum(counts[d]) - counts[d]
            if d:
                begin = begin[above] + levels[d - 1][1][above] + sums - sums[np.searchsorted(above, above)]
            else:
                begin = sums
            self.leaf[held] = begin[node]
        self.one = np.zeros(int(counts[0].sum()) if counts else 0, np.int64)
        self.one[self.leaf] = np.arange(len(lo))


def _totals(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, occurrences or sums of weights)."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if weight is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, weight = key[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.concatenate([at, [len(key)]])) if weight is None else np.add.reduceat(weight, at)


def _take(buf: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, joined."""
    end = np.cumsum(size)
    return buf[np.repeat(lo - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


class Leaves:
    """Terms in UTF-8 order (buf, off) with counters: (term, group, occurrences) and (term, language, documents)."""

    ARRAYS = ("size", "buf", "c_term", "c_group", "c_n", "d_term", "d_lang", "d_n")

    def __init__(self, size, buf, c_term, c_group, c_n, d_term, d_lang, d_n) -> None:
        self.size, self.buf = size, buf
        self.c_term, self.c_group, self.c_n, self.d_term, self.d_lang, self.d_n = c_term, c_group, c_n, d_term, d_lang, d_n
        self.off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.size)

    @property
    def counters(self) -> int:
        return len(self.c_n) + len(self.d_n)

    def term(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def prefixes(self) -> np.ndarray:
        """The first eight bytes as numbers in UTF-8 order."""
        return Ranges(self.buf, self.off[:-1], self.off[1:]).head.byteswap()

    def part(self, lo: int, hi: int) -> "Leaves":
        c, d = (slice(*np.searchsorted(x, [lo, hi])) for x in (self.c_term, self.d_term))
        return Leaves(self.size[lo:hi], self.buf[self.off[lo] : self.off[hi]], self.c_term[c] - lo, self.c_group[c], self.c_n[c], self.d_term[d] - lo, self.d_lang[d], self.d_n[d])

    def below(self, term: bytes) -> int:
        """Leaves before a term."""
        lo, hi = 0, len(self)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.term(mid) < term else (lo, mid)
        return lo

    def packed(self) -> bytes:
        narrow = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (getattr(self, a) for a in self.ARRAYS)]
        return np.array([(len(x), x.itemsize) for x in narrow], "<i8").tobytes() + b"".join(x.tobytes() for x in narrow)

    @classmethod
    def unpacked(cls, body: bytes) -> "Leaves":
        head, at, got = np.frombuffer(body, "<i8", 2 * len(cls.ARRAYS)).reshape(-1, 2), 16 * len(cls.ARRAYS), []
        for n, width in head.tolist():
            got.append(np.frombuffer(body, f"<u{width}", n, at).astype(np.int64 if len(got) != 1 else np.uint8))
            at += n * width
        return cls(*got)

    @classmethod
    def of_texts(cls, t: Texts, group: np.ndarray, lang: np.ndarray) -> "Leaves":
        """The trie of a slice of texts whose rows are of these groups and languages."""
        w = Words(t, True, _NO_TERM, hashed=False)
        trie = Trie(w.bytes, w.start, w.end)
        size = (w.end - w.start)[trie.one]
        wide_g, wide_l = int(group.max(initial=0)) + 1, int(lang.max(initial=0)) + 1
        key, n = _totals(trie.leaf * t.rows + w.row)
        term, row = key // max(t.rows, 1), key % max(t.rows, 1)
        c, c_n = _totals(term * wide_g + group[row], n)
        d, d_n = _totals(term * wide_l + lang[row])
        return cls(size, _take(w.bytes, w.start[trie.one], size), c // wide_g, c % wide_g, c_n, d // wide_l, d % wide_l, d_n)

    @classmethod
    def merged(cls, parts: list["Leaves"]) -> "Leaves":
        if len(parts) == 1:
            return parts[0]
        size, buf = np.concatenate([x.size for x in parts]), np.concatenate([x.buf for x in parts])
        lo = np.cumsum(size) - size
        trie = Trie(buf, lo, lo + size)
        base = np.cumsum([0, *map(len, parts)])

        def both(terms, codes, ns):
            code, n = np.concatenate(codes), np.concatenate(ns)
            wide = int(code.max(initial=0)) + 1
            key, n = _totals(trie.leaf[np.concatenate([x + b for x, b in zip(terms, base)])] * wide + code, n)
            return key // wide, key % wide, n

        c = both([x.c_term for x in parts], [x.c_group for x in parts], [x.c_n for x in parts])
        d = both([x.d_term for x in parts], [x.d_lang for x in parts], [x.d_n for x in parts])
        return cls(size[trie.one], _take(buf, lo[trie.one], size[trie.one]), *c, *d)


class Groups:
    """The (lang, source) groups by code: lang (code) and source of each, in order."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.rows = sorted(rows)
        self.langs, self.sources = sorted({x for x, _ in rows}), sorted({x for _, x in rows})
        at_l, at_s = ({x: i for i, x in enumerate(xs)} for xs in (self.langs, self.sources))
        self.lang = np.array([at_l[x] for x, _ in self.rows], np.int64)
        self.key = self.lang * len(self.sources) + np.array([at_s[s] for _, s in self.rows], np.int64)
        order = np.argsort(self.key)
        self.code, self.key = order, self.key[order]

    def codes(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        at = lambda x, xs: pc.index_in(x.cast(pa.string()), pa.array(xs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        return self.code[np.searchsorted(self.key, at(lang, self.langs) * len(self.sources) + at(source, self.sources))]


_BLOCKS = "first binary, leaves long, counters long, marks array<long>, body binary"


def _blocks(x: Leaves, salt: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring leaves as rows; a mark for some leaf in every MARK of the whole trie, from a place that `salt` says."""
    prefix = x.prefixes()
    for lo in range(0, len(x), BLOCK):
        p = x.part(lo, min(lo + BLOCK, len(x)))
        marks = (prefix[lo : lo + BLOCK][(salt - lo) % MARK :: MARK] ^ _TOP).view(np.int64)
        cells = [pa.array([v], t) for v, t in ((p.term(0), pa.binary()), (len(p), pa.int64()), (p.counters, pa.int64()), (marks.tolist(), pa.list_(pa.int64())), (p.packed(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(cells, ["first", "leaves", "counters", "marks", "body"])


def _count(groups: Groups):
    def run(batches):
        held, n, sent = [], 0, 0
        for s in slices(batches, "text"):
            group = groups.codes(s.column(1), s.column(2))
            held.append(Leaves.of_texts(Texts(s.column(0)), group, groups.lang[group]))
            n += held[-1].counters
            if n > HELD:
                held = [Leaves.merged(held)]
                n = held[0].counters
                if n > HELD // 2:
                    yield from _blocks(held[0], sent * 101 + n)
                    held, n, sent = [], 0, sent + 1
        if held:
            yield from _blocks(Leaves.merged(held), sent * 101 + n)

    return run


def _cut(splitters: np.ndarray):
    """Rows (range, first, body) of blocks cut at the splitters."""

    def run(batches):
        for b in batches:
            for first, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = Leaves.unpacked(body)
                at = np.searchsorted(splitters, x.prefixes(), "right")
                ends = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(x)]
                for lo, hi in zip(ends, ends[1:]):
                    own = (first, body) if hi - lo == len(x) else ((p := x.part(lo, hi)).term(0), p.packed())
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[lo])], pa.int32()), pa.array([own[0]], pa.binary()), pa.array([own[1]], pa.binary())], ["range", "first", "body"])

    return run


_KEPT = "body binary, groups array<int>, occurrences array<long>, langs array<int>, terms array<long>"


def _keep(lang_of: np.ndarray, least: int):
    """Merges blocks that come by first term; of complete terms, those in enough documents of a language."""

    def kept(x: Leaves) -> Iterator[pa.RecordBatch]:
        n_langs = int(lang_of.max(initial=0)) + 1
        d = x.d_n >= least
        stay = (x.d_term * n_langs + x.d_lang)[d]
        c = np.isin(x.c_term * n_langs + lang_of[x.c_group], stay)
        used = np.unique(x.d_term[d])
        for lo in range(0, len(used), BLOCK):
            own = used[lo : lo + BLOCK]
            dd, cc = d & np.isin(x.d_term, own), c & np.isin(x.c_term, own)
            p = Leaves(x.size[own], _take(x.buf, x.off[own], x.size[own]), np.searchsorted(own, x.c_term[cc]), x.c_group[cc], x.c_n[cc], np.searchsorted(own, x.d_term[dd]), x.d_lang[dd], x.d_n[dd])
            (g, n), (v, terms) = _totals(p.c_group, p.c_n), _totals(p.d_lang)
            cells = [pa.array([p.packed()], pa.binary()), pa.array([g.tolist()], pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([v.tolist()], pa.list_(pa.int32())), pa.array([terms.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, ["body", "groups", "occurrences", "langs", "terms"])

    def run(batches):
        held, n, most = [], 0, HELD
        for b in batches:
            for first, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n > most:
                    whole = Leaves.merged(held)
                    at = whole.below(first)
                    yield from kept(whole.part(0, at))
                    held = [whole.part(at, len(whole))]
                    n = held[0].counters
                    most = max(HELD, 2 * n)
                held.append(Leaves.unpacked(body))
                n += held[-1].counters
        if held:
            yield from kept(Leaves.merged(held))

    return run


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / whole), in three steps of long division: exact while 1000 * whole has 63 bits."""
    out, rest = np.divmod(count, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


_FOUND = "part string, code int, other int, term string, value long"


def _traverse(lang_of: np.ndarray, total: np.ndarray, terms: np.ndarray, ranks: int):
    """Sums of a task's terms for pairs of groups, and its `ranks` most overused terms of each group.

    lang_of and total: language and occurrences of each group; terms: kept terms of each language.
    """
    n_langs = len(terms)
    members = [np.flatnonzero(lang_of == v) for v in range(n_langs)]
    in_lang = [int(total[m].sum()) for m in members]

    def best(found: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        found.sort()
        out, group, n = [], None, 0
        for x in found:
            group, n = x[0], n + 1 if x[0] == group else 1
            if n <= ranks:
                out.append(x)
        return out

    def run(batches):
        sums = [np.zeros((len(m), len(m)), np.int64) for m in members]
        found, least, full = [], np.zeros(len(lang_of), np.int64), 4 * ranks * max(1, len(lang_of)) + 100_000
        for b in batches:
            for body in b.column(0).to_pylist():
                x = Leaves.unpacked(body)
                for v in np.unique(x.d_lang):
                    m = members[v]
                    own = x.d_term[x.d_lang == v]
                    step = max(1, CELLS // len(m))
                    mine = lang_of[x.c_group] == v
                    c_term, c_group, c_n = np.searchsorted(own, x.c_term[mine]), np.searchsorted(m, x.c_group[mine]), x.c_n[mine]
                    for lo in range(0, len(own), step):
                        hi = min(lo + step, len(own))
                        at = slice(*np.searchsorted(c_term, [lo, hi]))
                        counts = np.zeros((len(m), hi - lo), np.int64)
                        counts[c_group[at], c_term[at] - lo] = c_n[at]
                        p = share(counts + 5, (total[m] + 5 * terms[v])[:, None])
                        q = share(counts.sum(0) + 5, in_lang[v] + 5 * terms[v])
                        for g in range(len(m) - 1):
                            sums[v][g, g + 1 :] += np.abs(p[g + 1 :] - p[g]).sum(1)
                        over = p - q
                        g, t = np.nonzero((counts > 0) & (over > 0) & (over >= least[m][:, None]))
                        found += zip(m[g].tolist(), (-over[g, t]).tolist(), map(x.term, own[lo + t].tolist()))
                        if len(found) > full:
                            found = best(found)
                            ends = [i for i in range(len(found)) if i >= ranks - 1 and found[i][0] == found[i - ranks + 1][0]]
                            for i in ends:
                                least[found[i][0]] = -found[i][1]
        for v, m in enumerate(members):
            g, h = np.triu_indices(len(m), 1)
            n = len(g)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * n), pa.array(m[g].astype(np.int32)), pa.array(m[h].astype(np.int32)), pa.nulls(n, pa.string()), pa.array(sums[v][g, h])], ["part", "code", "other", "term", "value"])
        found = best(found)
        n = len(found)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(["term"] * n), pa.array([x[0] for x in found], pa.int32()), pa.nulls(n, pa.int32()), pa.array([x[2].decode() for x in found]), pa.array([-x[1] for x in found], pa.int64())], ["part", "code", "other", "term", "value"])

    return run


def audit_sources(docs: DataFrame, min_docs: int = 30, ranks: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of each (lang, source) group."""
    spark = docs.sparkSession
    none = F.lit("")
    given = docs.select(*[F.coalesce(docs[c].cast("string"), none).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    groups = Groups([tuple(r) for r in given.select("lang", "source").distinct().collect()])
    if not groups.rows:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    blocks = written(given.mapInArrow(_count(groups), _BLOCKS), "audit-blocks")
    held = blocks.agg(F.coalesce(F.sum("counters"), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE))
    marks = blocks.select(F.explode("marks").alias("mark"))
    cuts = marks.agg(F.percentile_approx("mark", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    splitters = np.unique(np.array(cuts or [], np.int64)).view(np.uint64) ^ _TOP
    cut = blocks.select("first", "body").mapInArrow(_cut(splitters), "range int, first binary, body binary")
    dealt = cut.repartitionById(len(splitters) + 1, "range").sortWithinPartitions("first").select("first", "body")
    kept = written(dealt.mapInArrow(_keep(groups.lang, min_docs), _KEPT), "audit-kept")

    def totals(codes: str, values: str, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        pairs = kept.select(F.explode(F.arrays_zip(codes, values)).alias("x")).select(f"x.{codes}", f"x.{values}")
        for code, value in pairs.groupBy(codes).agg(F.sum(values)).collect():  # one row a group or language
            out[code] = value
        return out

    total, terms = totals("groups", "occurrences", len(groups.rows)), totals("langs", "terms", len(groups.langs))
    found = kept.select("body").mapInArrow(_traverse(groups.lang, total, terms, ranks), _FOUND)
    named = spark.createDataFrame([(i, *x) for i, x in enumerate(groups.rows)], "code int, lang string, source string")
    other = named.select(F.col("code").alias("other"), F.col("lang").alias("__lang"), F.col("source").alias("item"))
    pairs = named.join(other, (F.col("lang") == F.col("__lang")) & (F.col("code") != F.col("other"))).drop("__lang")
    both = F.explode(F.array(F.struct("code", "other"), F.struct(F.col("other").alias("code"), F.col("code").alias("other"))))
    sums = found.where("part = 'pair'").groupBy("code", "other").agg(F.sum("value").alias("value")).select(both.alias("x"), "value").select("x.code", "x.other", "value")
    pairs = pairs.join(sums, ["code", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    over = found.where("part = 'term'").join(F.broadcast(named), "code").select("lang", "source", "part", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(over)


#: The contract's audit as one SQL statement.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM gn GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(g.n + 5 * v.v AS HUGEINT) AS p
      FROM gn g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT t.lang, t.term, 1 + (1000000000 * CAST(t.n + 5 AS HUGEINT)) // CAST(ln.n + 5 * v.v AS HUGEINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t JOIN ln ON ln.lang = t.lang JOIN v ON v.lang = t.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
