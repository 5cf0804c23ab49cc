"""N-gram Jaccard self-join by chosen paths.

A text's set is that of its five-word windows (all its words if it has fewer).
Rows with equal sets are one node.  Each node has `COORDS` minimum hashes, kept
as bytes; equal ones mean a shared token.  A run starts from all nodes and
splits them on the values of two sampled coordinates, each part again on two
coordinates that its path picks, so similar sets stay together on some path.  A
part of at most `SMALL` nodes is searched by brute force, and so is a larger one
whose members are alike on average (splitting would only repeat it) or that has
reached `DEEPEST`, in blocks of `BLOCK` nodes; others are split further.  Runs
are repeated until the chance that a pair at the threshold meets, computed from
the splitting process, reaches the target recall.

A part's nodes without a similar enough sketch in it are dropped (a chance that
the runs make up for), and parts with the same nodes are searched once.  Pairs are verified exactly on the sets.  A
pair that meets in several parts counts in the least of them, so links are
counted without listing pairs: a part returns, for each node, the number of rows
linked, and a node of the spanning forest.  Classes are the components.

Paths that hold more than a 2000th of a level's nodes are split where their rows
lie, by a decision on a sample of their nodes, instead of in one task; joins deal
hot keys (copies of one text, members of one class, hubs) over several tasks.
Within a dense part all pairs are compared, as the number of links asks for, in
blocks: sets are sent there once for each block of the part.

Edge cases: null, empty and word-less texts are classes of their own without
links; repeated rows are copies of each other; null ids are kept; a class whose
ids are all null has a null class_id; an empty table gives an empty result; only
the id and the text are read, so no other column can clash.  A text's set is held
whole (8 bytes a word), and a part holds up to two blocks of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import HOT_SHARE, hot_values, salted_join, written
from .textops import Texts, map_texts, mix, seeds, slices
from .workers import released

SHINGLE = 5
COORDS = 64
SMALL, BLOCK = 192, 256
SLICE = 512 << 10  # bytes of text at a time: executors hold several workers
FIRST, DEEPEST = 2, 6
HOT_SAMPLED = 6  # nodes of a path among a 64th of all, below which it is small


def shingle_sets(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, row offsets) of each text's set, ascending within a row."""
    w = t.words()
    h, row = w.ngrams(k)
    extra_h, extra_row = [h], [row]
    for c in range(1, k):
        rows = np.flatnonzero(w.count == c)
        if len(rows):
            x = np.full(len(rows), c, np.uint64)
            for j in range(c):
                x = mix(x ^ w.hash[w.first[rows] + j])
            extra_h.append(x)
            extra_row.append(rows)
    h, row = np.concatenate(extra_h), np.concatenate(extra_row)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    own = np.ones(len(h), bool)
    own[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[own], row[own]
    return h, np.searchsorted(row, np.arange(t.rows + 1))


def _keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit identity of each set (0 if empty)."""
    n = np.diff(off)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)), out=total[1:])
    return np.where(n > 0, mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)


def _sketches(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, COORDS) bytes of minimum hashes; rows with empty sets have zeros."""
    out = np.zeros((len(off) - 1, COORDS), np.uint8)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        for i, a in enumerate(seeds(COORDS, 5) | np.uint64(1)):
            least = np.minimum.reduceat(h * a, off[full])
            out[full, i] = mix(least) >> np.uint64(56)
    return out


def _children(path: np.ndarray, sketch: np.ndarray, run_root: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Both child paths (2, n) of each row."""
    a = (path % np.uint64(COORDS)).astype(np.int64)
    b = ((path >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)
    b += b >= a
    at = np.arange(len(path))
    return np.stack([mix(path ^ mix((c.astype(np.uint64) << np.uint64(8)) | sketch[at, c].astype(np.uint64))) for c in (a, b)])


def runs_needed(threshold: float, recall: float, alike: float = 0.0, depth: int = DEEPEST) -> int:
    """Runs after which a pair at the threshold has met, and was not dropped for its sketches, with the target probability."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** 2
    kept = sum(math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k) for k in range(math.ceil(alike * COORDS), COORDS + 1))
    if recall >= kept:
        raise ValueError(f"sketches of {COORDS} hashes keep {kept:.6f} of the pairs at the threshold, less than the target recall")
    return max(1, math.ceil(math.log(1 - recall / kept) / math.log(max(1 - p, 1e-12))))


def _sketch_column(batch, i: int) -> np.ndarray:
    col = batch.column(i)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), COORDS)


def _groups(batches, width: int, limit: int | None = None):
    """Tables of equal first `width` columns out of batches sorted by them; with a limit, a longer group comes in pieces flagged as such."""
    held: list = []

    def rows() -> int:
        return sum(b.num_rows for b in held)

    over = False
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        edge = np.zeros(batch.num_rows + 1, bool)
        edge[-1] = True
        for c in cols:
            edge[1:-1] |= c[1:] != c[:-1]
        key = tuple(c[0] for c in cols)
        at = 0
        if key != last:
            if held:
                yield pa.Table.from_batches(held), over, True
            held, over = [], False
        for end in np.flatnonzero(edge[1:]) + 1:
            held.append(batch.slice(at, end - at))
            last = tuple(c[at] for c in cols)
            at = end
            if limit is not None and rows() > limit:
                yield pa.Table.from_batches(held), True, end < batch.num_rows
                held, over = [], end == batch.num_rows
            elif end < batch.num_rows:
                yield pa.Table.from_batches(held), over, True
                held, over = [], False
    if held:
        yield pa.Table.from_batches(held), over, True


def _split(depth: int, alike: float):
    """Over rows sorted by path: leaves (bucket, key, null) and rows of the next level (path, key, sketch)."""

    def run(batches):
        state = {"path": None, "leaf": None}
        for table, large, _ in _groups(batches, 1, 8 * SMALL):
            b = table.combine_chunks().to_batches()[0]
            path, key = b.column(0)[0].as_py(), b.column(1).to_numpy()
            if large or state["path"] == path:
                # A part too large to hold: decide on its first rows, then let the rest through.
                sketch = _sketch_column(b, 2)
                if state["path"] != path:
                    state = {"path": path, "leaf": _leaf(sketch[:256], depth, alike)}
                leaf = state["leaf"]
            elif len(key) < 2:
                continue
            elif len(key) <= SMALL:
                sketch = _sketch_column(b, 2)
                near = (sketch[:, None, :] == sketch[None, :, :]).mean(2) >= alike
                key = key[near.sum(1) > 1]
                if len(key) < 2:
                    continue
                name = mix(np.sort(key).view(np.uint64) + np.arange(len(key), dtype=np.uint64)).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), name.view(np.int64))), pa.array(key), pa.nulls(len(key), pa.binary())], ["path", "key", "sketch"])
                continue
            else:
                sketch = _sketch_column(b, 2)
                leaf = _leaf(sketch[:256], depth, alike)
            if leaf:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(len(key), pa.binary())], ["path", "key", "sketch"])
            else:
                for child in _children(b.column(0).to_numpy().view(np.uint64), sketch):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1), b.column(2)], ["path", "key", "sketch"])

    return run


def _leaf(sketch: np.ndarray, depth: int, alike: float) -> bool:
    """Whether a part's nodes (some of them) are alike on average, so that splitting would only repeat it."""
    n = len(sketch)
    same = (sketch[:, None, :] == sketch[None, :, :]).mean(2)
    return depth >= DEEPEST or bool(same.sum() - n >= alike * n * max(n - 1, 1))  # without each node and itself


def _hot_paths(some: DataFrame, depth: int, alike: float) -> dict[int, bool]:
    """Paths with more than a 2000th of a level's nodes, out of a 64th of them, and whether each is a leaf: fewer than 2000 entries."""
    n = some.count()
    counts = some.groupBy("path").count().where(F.col("count") > max(HOT_SAMPLED, n // HOT_SHARE)).select("path")
    held = [r[0] for r in counts.collect()] if n > HOT_SAMPLED else []
    if not held:
        return {}
    slots = some.where(F.col("path").isin(held)).groupBy("path", F.pmod(F.hash("key"), F.lit(256)).alias("slot")).agg(F.min("sketch").alias("sketch"))

    def decide(batches):
        for table, _, _ in _groups(batches, 1):
            b = table.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([_leaf(_sketch_column(b, 2), depth, alike)])], ["path", "leaf"])

    return {r["path"]: r["leaf"] for r in slots.repartition("path").sortWithinPartitions("path", "slot").mapInArrow(released(decide), "path long, leaf boolean").collect()}


def _divide(hot: dict[int, bool]):
    """Rows of hot paths as leaves or as rows of the next level, each by itself."""
    leaves, splits = (np.array(sorted(p for p, leaf in hot.items() if leaf == want), np.int64) for want in (True, False))

    def run(batches):
        for b in batches:
            path = b.column(0).to_numpy()
            own = b.take(pa.array(np.flatnonzero(np.isin(path, leaves))))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.nulls(own.num_rows, pa.binary())], ["path", "key", "sketch"])
            own = b.take(pa.array(np.flatnonzero(np.isin(path, splits))))
            if own.num_rows:
                for child in _children(own.column(0).to_numpy().view(np.uint64), _sketch_column(own, 2)):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), own.column(1), own.column(2)], ["path", "key", "sketch"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the vocabulary."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                place = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
                out[i, j] = out[j, i] = (sets[j][place] == sets[i]).sum()
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, col = np.unique(flat, return_inverse=True)
    often = np.bincount(col) > 1  # a token of one set only is in no intersection
    renamed = np.cumsum(often) - 1
    ok = often[col]
    row, col = row[ok], renamed[col[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(col, [lo, lo + 8192])
        x = np.zeros((n, min(8192, int(often.sum()) - lo)), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(threshold: float):
    """Over rows (bucket, i, j, block, key, copies, buckets, set) sorted by part: (key, root, links) of linked nodes."""

    def run(batches):
        for table, _, _ in _groups(batches, 3):
            b = table.combine_chunks().to_batches()[0]
            key = b.column(4).to_numpy()
            if len(key) < 2:
                continue
            bucket, i, j = (b.column(k)[0].as_py() for k in range(3))
            block, copies = b.column(3).to_numpy(), b.column(5).to_numpy()
            lists = b.column(6)
            size = lists.value_lengths().to_numpy()
            buckets = np.full((len(key), int(size.max())), np.iinfo(np.int64).max)
            buckets[np.repeat(np.arange(len(key)), size), np.concatenate([np.arange(s) for s in size])] = lists.flatten().to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in b.column(7).to_pylist()]
            n = np.array([len(s) for s in sets])
            both = _overlaps(sets)
            linked = (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9) & ~np.eye(len(key), dtype=bool)
            if i != j:
                linked &= block[:, None] != block[None, :]
            a, c = np.nonzero(np.triu(linked))
            if not len(a):
                continue
            # Count the pair here only if this is the least bucket that both are in.
            first = np.full(len(a), np.iinfo(np.int64).max)
            for k in range(buckets.shape[1]):
                x = buckets[a, k]
                shared = (buckets[c] == x[:, None]).any(1) & (x < first)
                first[shared] = x[shared]
            here = first == bucket
            links = np.bincount(a[here], copies[c[here]], len(key)) + np.bincount(c[here], copies[a[here]], len(key))
            root = np.arange(len(key))  # least position that links reach, by label propagation
            while True:
                least = np.minimum(root[a], root[c])
                new = root.copy()
                np.minimum.at(new, a, least)
                np.minimum.at(new, c, least)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(linked.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(key[root[some]]), pa.array(links[some].astype(np.int64))], ["key", "root", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """key, label (the least key of its component) from edges key - root; minimum labels with pointer jumping, each round a written table."""
    e = edges.where("key != root").select("key", "root").distinct()
    both = written(e.unionAll(e.select(F.col("root").alias("key"), F.col("key").alias("root"))), "join-edges")
    labels = written(both.groupBy("key").agg(F.least(F.min("root"), F.min("key")).alias("label")), "join-labels")
    hubs = hot_values(both, "root")
    while True:
        near = salted_join(both, labels.withColumnRenamed("key", "root"), "root", hubs).groupBy("key").agg(F.min("label").alias("l"))
        low = written(labels.join(near, "key").select("key", F.least("label", "l").alias("label"), F.col("label").alias("was")), "join-labels")
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("up"))
        new = written(salted_join(low, jump, "label", hot_values(low, "label"), "left").select("key", F.least("label", "up").alias("label"), "was"), "join-labels")
        labels = new.select("key", "label")
        if not new.where("label != was").limit(1).count():
            return labels


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least id of its class), n_links (other rows with a similarity of the threshold or more)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        def f(t: Texts):
            h, off = shingle_sets(t)
            sketch = _sketches(h, off)
            return [_keys(h, off), pa.array([x.tobytes() for x in sketch], pa.binary())]

        return f

    rows = written(map_texts(source, make, [T.StructField("key", T.LongType()), T.StructField("sketch", T.BinaryType())], keep=["doc_id"], limit=SLICE), "join-rows")
    nodes = written(rows.where("key != 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")), "join-nodes")

    alike = 0.7 * threshold
    runs = runs_needed(threshold, recall, alike)

    def start(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sketch = _sketch_column(b, 1)
            for root in seeds(runs, 17):
                level = [np.full(b.num_rows, root, np.uint64)]
                for _ in range(FIRST):
                    level = [c for p in level for c in _children(p, sketch)]
                for p in level:
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), b.column(0), b.column(1)], ["path", "key", "sketch"])

    schema = "path long, key long, sketch binary"
    first, a_64th = nodes.select("key", "sketch"), F.pmod(F.xxhash64("key"), F.lit(64)) == 0
    level, some, leaves, depth = first.mapInArrow(released(start), schema), first.where(a_64th).mapInArrow(released(start), schema), None, FIRST
    while True:
        hot = _hot_paths(some, depth, alike)
        cold = level.where(~F.col("path").isin(list(hot))) if hot else level
        out = cold.repartition("path").sortWithinPartitions("path", "key").mapInArrow(released(_split(depth, alike)), schema)
        if hot:
            divide = _divide(hot)
            if depth == FIRST:  # in the function that makes the level: a second one would take a second worker beside it for each task
                out = out.unionAll(first.mapInArrow(released(lambda batches, divide=divide: divide(start(batches))), schema))
            else:
                out = out.unionAll(level.where(F.col("path").isin(list(hot))).mapInArrow(released(divide), schema))
        out = written(out, "join-level")
        part = out.where("sketch IS NULL").select(F.col("path").alias("bucket"), "key")
        leaves = part if leaves is None else leaves.unionAll(part)
        level, depth = out.where("sketch IS NOT NULL"), depth + 1
        some = level.where(a_64th)
        if depth > DEEPEST or not level.limit(1).count():
            break
    members = written(leaves.distinct(), "join-members")
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # A bucket's members are dealt over 16 tasks: a large one may hold a good part of all.
    large = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(large, ["bucket", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    wanted = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks", "block"))).alias("at"))  # as many as a node has paths
    wanted = written(wanted.join(nodes.select("key", "copies"), "key"), "join-wanted")

    # Sets of wanted nodes only: a bitmap of fixed size spares most others the shuffle.
    bits = wanted.select(F.expr("key & 262143").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 18) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 262,144 rows at most
    bitmap = np.zeros(1 << 18, np.uint64)
    bitmap[bits["w"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)

    def sets(batches):
        seen: set = set()
        for s in slices(batches, limit=SLICE):
            h, off = shingle_sets(Texts(s.column(0)))
            key = _keys(h, off)
            u = key.view(np.uint64)
            maybe = (bitmap[(u & np.uint64(262143)).astype(np.int64)] >> ((u >> np.uint64(18)) & np.uint64(63))) & np.uint64(1)
            take = [k for k in np.flatnonzero((maybe == 1) & (key != 0)).tolist() if key[k] not in seen and not seen.add(key[k])]
            if len(seen) > 500_000:
                seen.clear()  # copies that come again are dropped below
            if take:
                yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array([h[off[k] : off[k + 1]].tobytes() for k in take], pa.binary())], ["key", "members"])

    payload = source.select("text").mapInArrow(released(sets), "key long, members binary").join(wanted, "key").dropDuplicates(["key"])
    lists = payload.select("key", "copies", F.transform("at", lambda x: x["bucket"]).alias("buckets"), "members", F.explode("at").alias("p"))
    pieces = lists.select("key", "copies", "buckets", "members", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("other"))
    parts = pieces.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "buckets", "members")
    found = parts.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key").mapInArrow(released(_verify(threshold)), "key long, root long, links long")
    found = written(found, "join-found")

    labels = components(found)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = nodes.select("key", "first_id", "copies").join(labels, "key", "left").join(links, "key", "left")
    linked = written(linked.select("key", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "key").alias("label")), "join-linked")
    class_ids = linked.groupBy("label").agg(F.min("first_id").alias("class_id"))
    node = salted_join(linked, class_ids, "label", hot_values(linked, "label")).select("key", "class_id", "n_links")
    copied = hot_values(rows, "key", counts=nodes.select("key", F.col("copies").alias("count")))
    found = salted_join(rows.where("key != 0").select("doc_id", "key"), node, "key", copied).select("doc_id", "class_id", F.col("n_links").cast("long"))
    return found.unionAll(rows.where("key = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
