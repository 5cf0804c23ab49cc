"""Benchmark decontamination under edit distance.

Words are runs of letters and digits, ASCII lower-cased.  A document leaks an
item of m words if one of its windows of m words (cut at the document's end) is
within floor(edit_share * m) word edits of it.

Search: a CGK walk embeds a window, moving on in it or staying at each step as
one bit of a hash of (step, word) says, so that few edits change few symbols of
the walk.  Each repetition has walk bits and sampled steps of its own; the
sampled symbols are the bucket.  The number of repetitions is what the target
recall asks for, measured for each length of item with that many random edits.
Where `most` repetitions do not reach it, nothing is left to chance: all pairs of
a window and an item that share enough runs of words are taken.  Pairs are
verified by exact banded edit distance.  Before either search, windows are
dropped that no match can be: an edit spares all but one word and three word
triples, so a match holds at least m - edits words and m - 2 - 3 * edits triples
of the benchmark.

The benchmark is taken in blocks of bounded bytes (a stated query set), each
shipped with the tasks of one pass over all documents.

Edge cases: null and empty texts leak nothing; items without words are left out;
repeated documents and items are reported each; a null id stays null; of windows
of a document that are equally near an item, the first is reported; empty tables
give empty results.  find_leaks() reads the id and the text alone; a column of the
input that has the name of mark_leaks()'s flag is replaced.  A very long text is
searched whole: some tens of bytes of arrays for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import NO_LETTER, Texts, map_texts, mix, seeds, slices

_PAD = np.uint64(0x5851F42D4C957F2D)


def _triples(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next two."""
    return mix(mix(words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) + words[2:])


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q words, 1 to 3."""
    return _triples(words) if q == 3 else mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if q == 2 else words


class _Set:
    """Membership of hashes, summed along a text."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.values & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def running(self, x: np.ndarray, more: int) -> np.ndarray:
        """Members among the first i of x, for i up to len(x) + more."""
        hit = self.maybe[(x & np.uint64((1 << 18) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
            hit[at] = self.values[place] == x[at]
        total = np.zeros(len(x) + 1 + more, np.int32)
        np.cumsum(hit, out=total[1 : len(x) + 1])
        total[len(x) + 1 :] = total[len(x)]
        return total


class Index:
    """Buckets of one block of items."""

    def __init__(self, item_ids: list, texts: list, edit_share: float, recall: float, symbols: int = 4, most: int = 64) -> None:
        w = Texts(pa.array(texts, pa.large_string())).words(lower=True, separators=NO_LETTER)
        used = np.flatnonzero(w.count > 0)
        self.ids = [item_ids[i] for i in used]
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in used]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.edits = np.floor(edit_share * self.size + 1e-9).astype(np.int64)
        self.lengths, of = np.unique(self.size, return_inverse=True)
        self.length_edits = np.floor(edit_share * self.lengths + 1e-9).astype(np.int64)
        self.known = _Set(np.concatenate(self.words or [np.zeros(0, np.uint64)]))
        triples = [_triples(x) for x in self.words]
        self.known_triples = _Set(np.concatenate(triples or [np.zeros(0, np.uint64)]))
        # Which lengths of item have a triple: sorted pairs (triple, length).
        pair = np.unique(np.stack([np.searchsorted(self.known_triples.values, np.concatenate(triples)), np.repeat(of, [len(x) for x in triples])], 1), axis=0) if triples else np.zeros((0, 2), np.int64)
        self.triple_of, self.length_of = pair[:, 0], pair[:, 1]
        self.symbols = symbols
        self.length_repeats = np.zeros(0, np.int64)  # 0: all pairs that share enough are taken
        self.length_recall = np.ones(len(self.lengths))  # as measured, less two standard errors
        self.repeats = most
        if self.words:
            flat, first = np.concatenate(self.words), np.cumsum(self.size) - self.size
            self.length_repeats = self._needed(recall, most, of)
            self.repeats = int(self.length_repeats.max())
            walked = np.flatnonzero(self.length_repeats[of] > 0)
            keys = self.keys(flat, first[walked], self.size[walked], (first + self.size)[walked], of[walked], self.repeats)
            used = np.arange(self.repeats)[:, None] < self.length_repeats[of[walked]]
            self.buckets, self.bucket_item = keys[used], np.broadcast_to(walked, keys.shape)[used]
            order = np.argsort(self.buckets, kind="stable")
            self.buckets, self.bucket_item = self.buckets[order], self.bucket_item[order]
        # For lengths that are not walked: words in a run, least shared runs, sorted runs of the items, their items from `first` on.
        self.shared: dict = {}
        for k in np.flatnonzero(self.length_repeats == 0):
            m, e = int(self.lengths[k]), int(self.length_edits[k])
            q = next((q for q in (3, 2) if m - q + 1 - q * e >= 1), 1)
            own = np.flatnonzero(of == k)
            runs = [np.unique(_runs(self.words[i], q)) for i in own]
            run, item = np.concatenate(runs), np.repeat(own, [len(x) for x in runs])
            order = np.argsort(run, kind="stable")
            values, first = np.unique(run[order], return_index=True)
            self.shared[int(k)] = (q, m - q + 1 - q * e, values, np.r_[first, len(run)], item[order], own)

    def keys(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, kind: np.ndarray, r: int) -> np.ndarray:
        """(r, windows) bucket of words[start : end] as a window of `size` words; kind: its place in lengths."""
        n = len(start)
        walk = seeds(r, 71)[:, None]
        share = (seeds(r * self.symbols, 72) >> np.uint64(11)).reshape(r, self.symbols) / float(1 << 53)
        at = np.sort((share[:, :, None] * 2 * self.lengths[None, None, :]).astype(np.int64), 1)[:, :, kind]  # sampled steps: (repeats, symbols, windows)
        key = np.zeros((r, n), np.uint64) + mix(size.astype(np.uint64))[None, :] + mix(np.arange(r, dtype=np.uint64))[:, None]
        place = np.broadcast_to(start, (r, n)).copy()
        for step in range(int(at.max(initial=-1)) + 1):
            inside = place < end
            word = np.where(inside, words[np.minimum(place, len(words) - 1)], _PAD)
            sampled = at == step
            if sampled.any():
                times = sampled.sum(1).astype(np.uint64)
                key = np.where(times > 0, mix(key ^ word) + times, key)
            place += (mix(word ^ (walk + np.uint64(step))) & np.uint64(1)).astype(np.int64)
        return key

    def _needed(self, recall: float, most: int, of: np.ndarray) -> np.ndarray:
        """Repetitions for the target recall of each length's items with the largest number of edits allowed; 0 where `most` miss it."""
        rng = np.random.default_rng(11)
        out, missed = np.zeros(len(self.lengths), np.int64), 0
        for k, (m, e) in enumerate(zip(self.lengths.tolist(), self.length_edits.tolist())):
            if e == 0:
                out[k] = 1  # equal windows share all buckets
                continue
            if missed == 5:  # longer items with as large a share of edits are no easier, and to walk none is always right
                break
            own = np.flatnonzero(of == k)
            pick = own[np.unique(np.linspace(0, len(own) - 1, 32).astype(int))]
            each = -(-256 // len(pick))
            changed = []
            for x in (self.words[i] for i in np.repeat(pick, each)):
                y = list(x)
                for _ in range(e):
                    at, how = int(rng.integers(len(y))) if y else 0, int(rng.integers(3))
                    if how == 0 and y:
                        y[at] = rng.integers(1, 1 << 62, dtype=np.uint64)
                    elif how == 1:
                        y.insert(at, rng.integers(1, 1 << 62, dtype=np.uint64))
                    elif y:
                        del y[at]
                changed.append(np.array((y + [rng.integers(1, 1 << 62, dtype=np.uint64) for _ in x])[:m], np.uint64))

            def walked(texts, k=k, m=m):
                first = np.arange(len(texts)) * m
                return self.keys(np.concatenate(texts), first, np.full(len(texts), m), first + m, np.full(len(texts), k), most)

            same = np.repeat(walked([self.words[i] for i in pick]), each, 1) == walked(changed)
            found = np.maximum.accumulate(same, 0).mean(1)  # share met within the first repetitions
            sure = found - 2 * np.sqrt(found * (1 - found) / len(changed))  # two standard errors below what was met
            enough = np.flatnonzero(sure >= recall)
            if len(enough):
                self.length_recall[k] = sure[enough[0]]
            out[k] = int(enough[0]) + 1 if len(enough) else 0
            missed = 0 if len(enough) else missed + 1
        return out

    def leaks(self, t: Texts) -> tuple[np.ndarray, ...]:
        """(row, item, edits, first word) of each leak, the nearest window of each row and item."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not self.words:
            return none
        w = t.words(lower=True, separators=NO_LETTER)
        if not len(w.hash):
            return none
        longest = int(self.lengths[-1])
        words, triples = self.known.running(w.hash, longest), self.known_triples.running(_triples(w.hash), longest + 2)
        row_end = w.first[1:]
        starts, kinds = [], []
        n = len(w.hash)
        for k, (m, e) in enumerate(zip(self.lengths, self.length_edits)):
            s = np.flatnonzero((triples[max(m - 2, 0) : max(m - 2, 0) + n] - triples[:n] >= m - 2 - 3 * e) & (words[m : m + n] - words[:n] >= m - e))
            end = np.minimum(s + m, row_end[w.row[s]])  # a triple that begins at end - 2 leaves the window
            s = s[(words[end] - words[s] >= m - e) & (triples[np.maximum(end - 2, s)] - triples[s] >= m - 2 - 3 * e)]
            starts.append(s)
            kinds.append(np.full(len(s), k))
        start, kind = np.concatenate(starts), np.concatenate(kinds)
        ok = self._own_triples(w, start, kind, row_end)
        start, kind = start[ok], kind[ok]
        walked = self.length_repeats[kind] > 0
        found = []
        for k in np.unique(kind[~walked]).tolist():
            found.extend(self._sharing(w, start[kind == k], k, row_end))
        start, kind = start[walked], kind[walked]
        for lo in range(0, len(start), 4096):
            found.append(self._verified(w, start[lo : lo + 4096], kind[lo : lo + 4096], row_end))
        row, item, edits, first = (np.concatenate(x) for x in zip(*found)) if found else none
        order = np.lexsort((first, edits, item, row))
        row, item, edits, first = row[order], item[order], edits[order], first[order]
        best = np.ones(len(row), bool)
        best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[best], item[best], edits[best], first[best]

    def _own_triples(self, w, start, kind, row_end) -> np.ndarray:
        """Windows with enough triples from items of just their length."""
        if not len(start):
            return np.zeros(0, bool)
        x = _triples(w.hash)
        place = np.minimum(np.searchsorted(self.known_triples.values, x), max(len(self.known_triples.values) - 1, 0))
        at = np.flatnonzero(self.known_triples.values[place] == x) if len(self.known_triples.values) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.triple_of, place[at], "left"), np.searchsorted(self.triple_of, place[at], "right")
        n = hi - lo
        seen = np.sort(self.length_of[np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))] * (len(w.hash) + 1) + np.repeat(at, n))
        base = kind * (len(w.hash) + 1)
        end = np.maximum(np.minimum(start + self.lengths[kind], row_end[w.row[start]]) - 2, start)
        return np.searchsorted(seen, base + end) - np.searchsorted(seen, base + start) >= self.lengths[kind] - 2 - 3 * self.length_edits[kind]

    def _verified(self, w, start, kind, row_end):
        size = self.lengths[kind]
        end = np.minimum(start + size, row_end[w.row[start]])
        repeats = int(self.length_repeats[kind].max())
        keys = self.keys(w.hash, start, size, end, kind, repeats)
        lo, hi = np.searchsorted(self.buckets, keys.ravel(), "left"), np.searchsorted(self.buckets, keys.ravel(), "right")
        n = hi - lo
        window = np.repeat(np.tile(np.arange(len(start)), repeats), n)
        item = self.bucket_item[np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))]
        pair = np.unique(window * len(self.size) + item)
        window, item = pair // len(self.size), pair % len(self.size)
        ok = self.size[item] == size[window]
        window, item = window[ok], item[ok]
        return self._close(w, start[window], end[window], item)

    def _close(self, w, start, end, item):
        """(row, item, edits, first word) of the pairs within the item's edits."""
        edits = np.full(len(item), 1 << 30)
        for k in range(0, len(item), 2048):
            edits[k : k + 2048] = self.distances(w.hash, start[k : k + 2048], end[k : k + 2048], item[k : k + 2048])
        ok = edits <= self.edits[item]
        row = w.row[start[ok]]
        return row, item[ok], edits[ok], start[ok] - w.first[row]

    def _sharing(self, w, start, k, row_end, held: int = 1 << 21):
        """Leaks of all items of the k-th length in the windows at `start` (ascending), a group of rows at a time."""
        q, need, values, first, items, own = self.shared[k]
        m = int(self.lengths[k])
        if need < 1:  # as many edits as words: all pairs
            for lo in range(0, len(start), 2048):
                s, item = np.repeat(start[lo : lo + 2048], len(own)), np.tile(own, len(start[lo : lo + 2048]))
                yield self._close(w, s, np.minimum(s + m, row_end[w.row[s]]), item)
            return
        x = _runs(w.hash, q)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, np.maximum(np.minimum(start + m, row_end[w.row[start]]) - q + 1, start), -1)
        at = np.flatnonzero(np.cumsum(cover[: len(x)]) > 0)
        place = np.minimum(np.searchsorted(values, x[at]), len(values) - 1)
        hit = values[place] == x[at]
        at, place = at[hit], place[hit]
        n = first[place + 1] - first[place]
        if not len(at):
            return
        group = (np.cumsum(n) - n) // held
        group = group[np.searchsorted(w.row[at], w.row[at], "left")]  # a row is in one group
        for g in np.unique(group):
            lo, hi = np.searchsorted(group, (g, g + 1))
            of, c = place[lo:hi], n[lo:hi]
            item = items[np.repeat(first[of + 1] - np.cumsum(c), c) + np.arange(int(c.sum()))]
            wide = len(w.hash) + 1
            key = np.sort(item * wide + np.repeat(at[lo:hi], c))
            item, pos = key // wide, key % wide
            row = w.row[pos]
            # Windows that hold the shared runs i to i + need - 1, without those that hold the run before them too.
            last = np.arange(need - 1, len(key))
            i = last - need + 1
            ok = (item[i] == item[last]) & (row[i] == row[last])
            i, last = i[ok], last[ok]
            low = np.maximum(pos[last] - (m - q), w.first[row[i]])
            before = np.maximum(i - 1, 0)
            follows = (i > 0) & (item[before] == item[i]) & (row[before] == row[i])
            low = np.where(follows, np.maximum(low, pos[before] + 1), low)
            a = np.searchsorted(start, low, "left")
            c = np.maximum(np.searchsorted(start, pos[i], "right") - a, 0)
            s, item = start[np.repeat(a + c - np.cumsum(c), c) + np.arange(int(c.sum()))], np.repeat(item[i], c)
            if not len(s):
                continue
            end = np.minimum(s + m, row_end[w.row[s]])
            shares = np.searchsorted(key, item * wide + end - q, "right") - np.searchsorted(key, item * wide + s, "left")
            # The window of each row and item that shares most bounds the edits, and so what others must share to be as near.
            pair = w.row[s] * len(self.size) + item
            order = np.lexsort((s, -shares, pair))
            s, end, item, shares, pair = s[order], end[order], item[order], shares[order], pair[order]
            new = np.r_[True, pair[1:] != pair[:-1]]
            head = np.flatnonzero(new)
            edits = np.concatenate([self.distances(w.hash, *(v[head[z : z + 2048]] for v in (s, end, item))) for z in range(0, len(head), 2048)])
            bound = np.minimum(edits, self.length_edits[k])[np.cumsum(new) - 1]
            ok = shares >= m - q + 1 - q * bound
            yield self._close(w, s[ok], end[ok], item[ok])

    def distances(self, words, start, end, item) -> np.ndarray:
        """Word edit distance of each window and item, exact up to the item's edits and above them otherwise."""
        if not len(item):
            return np.zeros(0, np.int64)
        m, n = self.size[item], end - start
        band, longest = int(self.edits[item].max()), int(m.max())
        flat, first = np.concatenate(self.words), np.cumsum(self.size) - self.size
        far = 1 << 20
        offsets = np.arange(-band, band + 1)
        # cost[:, b] is the distance of the item's first i words and the window's first i + offsets[b].
        cost = np.where(offsets >= 0, offsets, far)[None, :].repeat(len(item), 0)
        out = np.full(len(item), far)
        out[m == 0] = n[m == 0]
        for i in range(1, longest + 1):
            a = flat[np.minimum(first[item] + i - 1, len(flat) - 1)]
            j = i + offsets[None, :]
            b = words[np.minimum(np.maximum(start[:, None] + j - 1, 0), len(words) - 1)]
            fits = (j >= 1) & (j <= n[:, None])
            new = np.where(fits, cost + (b != a[:, None]), far)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.where((j >= 0) & (j <= n[:, None]), new, far)
            np.copyto(new, i, where=(j == 0) & (new > i))
            new = np.minimum.accumulate(new - offsets, 1) + offsets  # words inserted
            cost = np.where((j >= 0) & (j <= n[:, None]), new, far)
            done = np.flatnonzero(m == i)
            d = (n - m)[done] + band
            ok = (d >= 0) & (d < len(offsets))
            out[done[ok]] = cost[done[ok], d[ok]]
        return out


def _blocks(items: DataFrame, id_col: str, text: str, limit: int):
    """Lists of (id, text) of at most `limit` text bytes (one item at least), one at a time on the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(id_col, text).where(F.col(text).isNotNull()).orderBy(id_col, text).toLocalIterator():
        n = len(row[1].encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if ids:
        yield ids, texts


def search_plan(benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.95, block_bytes: int = 4 << 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """n_words, edits, repeats (0: exact search), recall of each length of item in each block: what find_leaks() does, with the recall it measured."""
    rows = []
    for k, (ids, texts) in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        x = Index(ids, texts, edit_share, recall)
        rows += [(k, *map(int, v[:3]), float(v[3])) for v in zip(x.lengths, x.length_edits, x.length_repeats, x.length_recall)]
    return benchmark.sparkSession.createDataFrame(rows, "block long, n_words long, edits long, repeats long, recall double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.95, block_bytes: int = 4 << 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_word, repeats, recall: one row for each document and item that it leaks.

    repeats (0: exact search) and recall are those of the item's length, as in search_plan().
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    item_type = benchmark.schema[item_id]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", item_type.dataType), T.StructField("edits", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("repeats", T.LongType()), T.StructField("recall", T.DoubleType())])
    found = None
    for ids, texts in _blocks(benchmark, item_id, item_text, block_bytes):
        index = Index(ids, texts, edit_share, recall)

        def run(batches, index=index):
            for s in slices(batches):
                row, item, edits, first = index.leaks(Texts(s.column(1)))
                names = pa.array([index.ids[i] for i in item], None if len(item) else pa.null())
                if len(item):
                    of = np.searchsorted(index.lengths, index.size[item])
                    cols = [s.column(0).take(pa.array(row)), names, pa.array(edits), pa.array(first), pa.array(index.length_repeats[of]), pa.array(index.length_recall[of])]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def mark_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.95, block_bytes: int = 4 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", flag: str = "leaks") -> DataFrame:
    """docs with a boolean column: whether the row leaks any item."""
    out, flags = docs, []
    for k, (ids, texts) in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        index = Index(ids, texts, edit_share, recall)

        def make(index=index):
            return lambda t: [pa.array(np.isin(np.arange(t.rows), index.leaks(t)[0]))]

        flags.append(f"__leaks{k}")
        out = map_texts(out, make, [T.StructField(flags[-1], T.BooleanType())], text)
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    return out.withColumn(flag, any_flag).drop(*flags)
