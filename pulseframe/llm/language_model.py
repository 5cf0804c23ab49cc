"""Gated recurrent language model in numpy.

Tokens are words (ASCII lower-cased) and one end mark a text.  Counts of all
training tokens give the smoothed unigram scores and the model's vocabulary:
its `CLASSES * CLASS_SIZE` most frequent tokens form the classes of a factored
output softmax, and one more class stands for all other words, which share it
by their smoothed counts.  So the probabilities of all words, known or not, add
up to one.

Training: every task runs truncated backpropagation over all training texts of
its split, from the same start (output biases at the unigram model), and the
tasks' parameters are averaged by tokens, in pieces.  Scoring: texts are laid
end to end in lanes, the state is carried across windows and reset where a text
begins, so a score is that of the complete text.

Counts grow with the vocabulary, so tasks hold at most the `HOT` most frequent
ones; other words are looked up by a join on their hash.

Edge cases: a null or empty text has just its end mark; a null id counts as
training; repeated rows are scored each; without training texts all words are
unknown; an empty table gives an empty result.  A very long text is one lane, so
its memory follows its own tokens (some hundred bytes each), whatever texts stand
beside it.  Only the columns named in the results come back, so none can clash.
The averaged model, and so the score, depends on how the table is split into
tasks; with the same files and settings it is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textops import Texts, slices

CLASSES, CLASS_SIZE, HIDDEN = 32, 64, 32
HOT = 65_536
LANES, WINDOW = 256, 32
END = 0x1E35A7BD1E35A7BD
_PIECES = 64
_PLACE_BITS = 20


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end mark after each text, row offsets)."""
    w = t.words(lower=True)
    off = w.first + np.arange(t.rows + 1)
    out = np.full(len(w.hash) + t.rows, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[off[1:] - 1] = False
    out[keep] = w.hash
    return out, off


def count_tokens(docs: DataFrame, text: str = "text", held: int = 1_000_000) -> DataFrame:
    """h, c: occurrences of each token, summed in tasks before the shuffle."""

    def run(batches):
        keys, counts, waiting, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            k = np.concatenate([keys, *waiting])
            c = np.concatenate([counts, *(np.ones(len(x), np.int64) for x in waiting)])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(c, first) if len(k) else c

        for s in slices(batches):
            waiting.append(tokens(Texts(s.column(0)))[0])
            rows += len(waiting[-1])
            if rows > held:
                keys, counts = merged()
                waiting, rows = [], 0
                if len(keys) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int, least_held: int = CLASSES * CLASS_SIZE) -> list:
    """Tokens by descending count, whole steps of count of them as long as they are `most` at most.

    A step is an eighth of a doubling, so its sizes are a few hundred rows for any input.  If those steps
    hold fewer than `least_held` tokens, the next one fills them up, by count and hash.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    allowed, least = most, None
    for row in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        allowed -= row["n"]
        if allowed < 0:
            break
        least = row["s"]
    got = [] if least is None else counts.where(step >= least).collect()
    if allowed < 0 and len(got) < least_held:
        got += counts.where(step == row["s"]).orderBy(F.desc("c"), "h").limit(least_held - len(got)).collect()
    return sorted(got, key=lambda r: (-r["c"], r["h"]))


class Vocabulary:
    """Up to HOT most frequent tokens: sorted hashes with count and model id (-1: in the shared class)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        size = min(CLASSES * CLASS_SIZE, len(hashes))
        self.total, self.distinct, self.size = total, distinct, size
        self.model_counts = counts[:size]
        self.rest_total, self.rest_distinct = total - int(counts[:size].sum()), distinct - size
        ids = np.where(np.arange(len(hashes)) < size, np.arange(len(hashes)), -1)
        order = np.argsort(hashes)
        self.keys, self.counts, self.ids = hashes[order], counts[order], ids[order]
        self.place = None  # by the first bits of a hash: the place of the only key with them, -1: none, -2: several; made where it is used

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(model id or -1, count, whether the token is among these)."""
        if not len(self.keys):
            return np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if self.place is None:
            self.place = np.full(1 << _PLACE_BITS, -1, np.int32)
            first = (self.keys >> np.uint64(64 - _PLACE_BITS)).astype(np.intp)
            same = first[1:] == first[:-1]
            self.place[first] = np.arange(len(first))
            self.place[first[1:][same]] = -2
        at = self.place.take((h >> np.uint64(64 - _PLACE_BITS)).astype(np.intp))
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.keys, h[several]), len(self.keys) - 1)
        ok = self.keys.take(at, mode="wrap") == h  # -1 is the last key, which then differs
        return np.where(ok, self.ids[at], -1), np.where(ok, self.counts[at], 0), ok


class GRU:
    """Parameters: input rows (3 gates), recurrent matrices, class and word outputs."""

    NAMES = ("inputs", "gates", "candidate", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, vocabulary: Vocabulary, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        h, n = HIDDEN, CLASSES * CLASS_SIZE
        f = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        self.inputs, self.gates, self.candidate = f(n + 2, 3 * h), f(h, 2 * h), f(h, h)
        self.class_w, self.word_w = np.zeros((h, CLASSES + 1), np.float32), np.zeros((CLASSES, h, CLASS_SIZE), np.float32)
        counts = np.zeros(n)
        counts[: vocabulary.size] = vocabulary.model_counts
        grouped = counts.reshape(CLASSES, CLASS_SIZE)
        self.class_b = np.log(np.r_[grouped.sum(1) + 1e-6, vocabulary.rest_total + vocabulary.rest_distinct + 1]).astype(np.float32)
        self.word_b = np.log(np.where(grouped > 0, grouped, 1e-9)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def window(self, words: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each step's output: words and begins are (steps, lanes); h is the state before.

        With keep, also each step's (state before, gates z and r, r * state, candidate), as arrays over all steps.
        """
        steps, lanes = words.shape
        states, held = np.empty((steps, lanes, HIDDEN), np.float32), steps if keep else 1
        before, scaled, candidate = (np.empty((held, lanes, HIDDEN), np.float32) for _ in range(3))
        gates = np.empty((held, lanes, 2 * HIDDEN), np.float32)
        x, goes_on = np.empty((lanes, 3 * HIDDEN), np.float32), (~begins).astype(np.float32)[:, :, None]
        for t in range(steps):
            k = t if keep else 0
            hp, g, rh, n = before[k], gates[k], scaled[k], candidate[k]
            np.multiply(h, goes_on[t], out=hp)
            self.inputs.take(words[t], 0, out=x, mode="clip")
            np.matmul(hp, self.gates, out=g)
            g += x[:, : 2 * HIDDEN]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:, HIDDEN:], hp, out=rh)
            np.matmul(rh, self.candidate, out=n)
            n += x[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            h = states[t]
            np.subtract(hp, n, out=h)
            h *= g[:, :HIDDEN]
            h += n
        return states, h, (before, gates, scaled, candidate) if keep else None

    def outputs(self, states: np.ndarray, target: np.ndarray, gradients: dict | None = None):
        """Natural log probability of each target (-1: of the shared class as a whole) and, with gradients, the states' ones."""
        kind = np.where(target < 0, CLASSES, target // CLASS_SIZE).astype(np.int16)
        order = np.argsort(kind, kind="stable")  # rows of a class lie together from here on
        kind, word, states = kind[order], target[order] % CLASS_SIZE, states.take(order, 0)
        edge = np.searchsorted(kind, np.arange(CLASSES + 1))
        ones = {n: np.ones((n, 1), np.float32) for n in (CLASSES + 1, CLASS_SIZE)}

        def soft(x, own):
            """Log probabilities of the columns `own`; x becomes the gradients, where they are wanted."""
            np.minimum(x, 80.0, out=x)  # float32 holds e**80 times the classes
            at = np.arange(0, x.size, x.shape[1]) + own
            flat = x.reshape(-1)
            chosen = flat[at]
            np.exp(x, out=x)
            total = x @ ones[x.shape[1]]  # a product is faster than a sum over short rows
            if gradients is not None:
                x /= total
                flat[at] -= 1
            return chosen - np.log(total[:, 0])

        x = states @ self.class_w
        x += self.class_b
        got, d = soft(x, kind), None
        if gradients is not None:
            gradients["class_w"], gradients["class_b"] = states.T @ x, x.sum(0)
            gradients["word_w"], gradients["word_b"] = np.zeros_like(self.word_w), np.zeros_like(self.word_b)
            d = x @ self.class_w.T
        for c in range(CLASSES):
            a, b = edge[c], edge[c + 1]
            if a < b:
                x = states[a:b] @ self.word_w[c]
                x += self.word_b[c]
                got[a:b] += soft(x, word[a:b])
                if gradients is not None:
                    gradients["word_w"][c], gradients["word_b"][c] = states[a:b].T @ x, x.sum(0)
                    d[a:b] += x @ self.word_w[c].T
        out = np.empty_like(got)
        out[order] = got
        if d is not None:
            sorted_d, d = d, np.empty_like(d)
            d[order] = sorted_d
        return out, d

    def train_window(self, words, begins, target, h, memory: dict, rate: float, live: np.ndarray | None = None) -> np.ndarray:
        """One update of truncated backpropagation (Adagrad); returns the state after.  Steps that are not live end lanes and teach nothing."""
        states, after, (before, gates, scaled, candidate) = self.window(words, begins, h, keep=True)
        g: dict = {}
        if live is None or live.all():
            _, d = self.outputs(states.reshape(-1, HIDDEN), target.ravel(), g)
            d = d.reshape(states.shape)
        else:
            d = np.zeros_like(states)
            d[live] = self.outputs(states[live], target[live], g)[1]
        into = np.empty((*words.shape, 3 * HIDDEN), np.float32)
        later, goes_on = np.zeros_like(h), (~begins).astype(np.float32)[:, :, None]
        # What does not depend on later steps is made for all steps at once.
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        to_candidate = (1 - z) * (1 - candidate * candidate)
        to_z, to_r = (before - candidate) * z * (1 - z), scaled * (1 - r)
        for t in range(len(words) - 1, -1, -1):
            dh, step = d[t], into[t]
            dh += later
            dn = step[:, 2 * HIDDEN :]
            np.multiply(dh, to_candidate[t], out=dn)
            drh = dn @ self.candidate.T
            np.multiply(dh, to_z[t], out=step[:, :HIDDEN])
            np.multiply(drh, to_r[t], out=step[:, HIDDEN : 2 * HIDDEN])
            later = step[:, : 2 * HIDDEN] @ self.gates.T
            drh *= r[t]
            later += drh
            dh *= z[t]
            later += dh
            later *= goes_on[t]
        into = into.reshape(-1, 3 * HIDDEN)
        g["gates"] = before.reshape(-1, HIDDEN).T @ into[:, : 2 * HIDDEN]
        g["candidate"] = scaled.reshape(-1, HIDDEN).T @ into[:, 2 * HIDDEN :]
        flat = words.ravel().astype(np.int16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        used, rows = flat[first], np.add.reduceat(into.take(order, 0).view(np.complex64), first).view(np.float32)  # pairs of columns at a time
        n = len(flat) if live is None else int(live.sum())
        for k, grad, at in [("inputs", rows, used)] + [(k, g[k], slice(None)) for k in self.NAMES[1:]]:
            grad = grad / n
            m = memory.setdefault(k, np.full_like(getattr(self, k), 1e-8))
            sums = m[at] + grad * grad
            m[at] = sums
            np.sqrt(sums, out=sums)
            grad *= rate
            grad /= sums
            getattr(self, k)[at] -= grad
        return after


def _inputs(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each token as an input row, whether a text begins)."""
    n = CLASSES * CLASS_SIZE
    before = np.empty(len(ids), np.int64)
    before[1:] = np.where(ids[:-1] < 0, n, ids[:-1])
    begins = np.zeros(len(ids), bool)
    begins[off[:-1]] = True
    before[begins] = n + 1
    return before, begins


def train(docs: DataFrame, vocabulary: Vocabulary, rate: float = 0.05, text: str = "text") -> GRU:
    """Average of the models that the tasks train on all their texts."""

    def run(batches):
        model, memory, seen = GRU(vocabulary), {}, 0
        for s in slices(batches):
            hashes, off = tokens(Texts(s.column(0)))
            ids, _, _ = vocabulary.find(hashes)
            words, begins = _inputs(ids, off)
            lanes = max(1, min(LANES, len(ids) // WINDOW))
            edge = np.arange(lanes + 1) * len(ids) // lanes  # lanes differ by a token at most, so only the last step can be padding
            long = int(np.diff(edge).max(initial=0))
            place = edge[:-1] + np.arange(long)[:, None]
            live = place < edge[1:]
            place = np.where(live, place, 0)
            words, begins, target = words[place], begins[place], ids[place]
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, long, WINDOW):
                h = model.train_window(words[t : t + WINDOW], begins[t : t + WINDOW], target[t : t + WINDOW], h, memory, rate, live[t : t + WINDOW])
            seen += len(ids)
        if seen:
            for k, piece in enumerate(np.array_split(model.flat(), _PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(seen)]), pa.array([piece.tobytes()])], ["piece", "weight", "value"])

    def average(batches):
        total: dict = {}
        for b in batches:
            for k, w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(v, np.float32) * np.float64(w)
                have = total.get(k, (0.0, 0.0))
                total[k] = (have[0] + w, have[1] + x)
        for k, (w, x) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(x / w).astype(np.float32).tobytes()])], ["piece", "value"])

    trained = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "piece long, weight double, value binary")
    got = trained.repartition("piece").sortWithinPartitions("piece", "weight", "value").mapInArrow(average, "piece long, value binary").collect()  # one model
    model = GRU(vocabulary)
    if got:
        model.load(np.concatenate([np.frombuffer(r["value"], np.float32) for r in sorted(got, key=lambda r: r["piece"])]))
    return model


def _lanes(off: np.ndarray) -> list[np.ndarray]:
    """Texts of each lane: longest first to the shortest lane; lanes by descending length."""
    import heapq

    size = np.diff(off)
    heap = [(0, k) for k in range(min(LANES, len(size)))]
    lanes: list = [[] for _ in heap]
    for row in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        lanes[k].append(row)
        heapq.heappush(heap, (n + int(size[row]), k))
    return sorted((np.array(x) for x in lanes), key=lambda x: -int(size[x].sum()))


def log_probabilities(model: GRU, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log probability of each token given all before it in its text."""
    words, begins = _inputs(ids, off)
    lanes = [np.concatenate([np.arange(off[r], off[r + 1]) for r in rows]) for rows in _lanes(off)]
    length = np.array([len(x) for x in lanes], np.int64)
    order, first = np.concatenate([np.zeros(0, np.int64), *lanes]), np.cumsum(length) - length
    out = np.zeros(len(ids))
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    for t in range(0, int(length.max(initial=0)), WINDOW):
        active = int((length > t).sum())
        step = t + np.arange(WINDOW)[:, None]
        live = step < length[:active]
        at = order[np.where(live, first[:active] + step, 0)]
        states, h, _ = model.window(words[at], begins[at], h[:active])
        got, _ = model.outputs(states[live], ids[at[live]])
        out[at[live]] = got
    return out


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10, of the whole text with its end)."""
    source = docs.select(F.col(id_col).alias("doc_id"), (~training).alias("held_out"), F.col(text).cast("string").alias("text"))
    learn = source.where(~F.col("held_out"))
    counts = written(count_tokens(learn), "lm-counts")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = int(total or 0)
    top = _most_frequent(counts, HOT)
    vocabulary = Vocabulary(np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64), total, distinct)
    model = train(learn, vocabulary)
    base = float(np.log10(total + distinct + 1))
    rest = float(np.log10(vocabulary.rest_total + vocabulary.rest_distinct + 1))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for s in slices(batches, limit=8 << 20):
            hashes, off = tokens(Texts(s.column(2)))
            ids, count, hot = vocabulary.find(hashes)
            row = np.repeat(np.arange(s.num_rows), np.diff(off))
            each = np.log10(count + 1.0)
            score = log_probabilities(model, ids, off) / np.log(10) + np.where((ids < 0) & hot, each - rest, np.where(ids < 0, -rest, 0))
            n = np.diff(off)
            per = lambda x: np.bincount(row, x, s.num_rows)
            cold = np.flatnonzero(~hot)
            cuts = np.searchsorted(row[cold], np.arange(s.num_rows + 1)).astype(np.int32)
            cols = [pa.array(number + np.arange(s.num_rows)), s.column(0), s.column(1), pa.array(n), pa.array(per(hot & (count > 0)).astype(np.int64)), pa.array(per(each) - n * base), pa.array(per(score)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[cold].view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "cold"])
            number += s.num_rows

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("cold", T.ArrayType(T.LongType()))])
    scored = written(source.mapInArrow(run, schema), "lm-scored")
    words = scored.select("row", F.explode("cold").alias("h"))
    added = words.join(counts, "h").groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("cold").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
