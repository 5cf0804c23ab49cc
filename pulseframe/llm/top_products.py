"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers (floor of a scale times each component).  They are sorted by length in sampled ranges and
packed into blocks of similar length, longest first; neighbouring blocks are the groups that tasks search.  Each query first meets
at most SEEDS vectors, which give it a score that its k-th best reaches at least; divided by the query's length, that is
the least length of a vector that matters to it.  Queries are packed by that reach, so a pack goes to the groups
that hold long enough vectors and to no others; no table is held by one task or the driver.

In a block the query's threshold becomes a local threshold on the cosine.  Where that is high, sorted lists of single
coordinates of the unit vectors leave few candidates (an angle of at most b to a query that has the angle a to an axis
puts a vector's angle to it between a - b and a + b); elsewhere the block is cut by length.  Either way the
candidates' products are worked out exactly, as products of doubles below 2**53 and of Python integers above.

Edge cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled
with zeros, empty ones have the score 0 with all; components beyond 2**62 and scores beyond 64 bits are cut to these;
equal scores go by id, a null id last, then by place in the table; rows with one id are candidates and queries of
their own, and a query is compared with all rows but its own row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, in_order, written

SEEDS = 4096
BLOCK = 2048
#: Vectors of a group, queries of a pack, and components in a block, at most.
GROUP, PACK, BLOCK_VALUES = 65_536, 8_192, 1 << 22
#: Local cosine from which coordinates are tried, how many, and the share of a block they must leave to be used.
HIGH_COSINE, FOCUS, FEW = 0.6, 3, 0.2
_SLACK = 1e-9
_LAST = np.iinfo(np.int64).max

VECTOR = "__row long, id long, norm double, dim int, vector binary"
PACKED = "part long, hi double, id array<bigint>, __row array<bigint>, norm array<double>, theta array<bigint>, tie array<bigint>, dim int, vectors binary"


def query_rows(every: int, id_col: str = "vec_id") -> Column:
    """The rows whose id is divisible by `every`."""
    return F.coalesce(F.col(id_col) % every == 0, F.lit(False))


def _integers(scale: int) -> Callable:
    def run(batches):
        for b in batches:
            rows, ids, cells = b.columns[:3]
            cells = cells.cast(pa.large_list(pa.float64()))
            size = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = cells.flatten()  # of cells that are not null
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = cells.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.nan_to_num(np.clip(np.floor(scale * x), -(2.0**62), 2.0**62)).astype(np.int64)
            norm = np.zeros(len(size))
            full = np.flatnonzero(size)
            if len(full):
                norm[full] = np.sqrt(np.add.reduceat(v.astype(np.float64) ** 2, (end - size)[full]))
            body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], 8 * end]).astype(np.int64)), pa.py_buffer(v)]).cast(pa.binary())
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (rows, ids.cast(pa.int64()), pa.array(norm), pa.array(size.astype(np.int32)), body)], ["__row", "id", "norm", "dim", "vector"])

    return run


def _matrix(cells, dim: np.ndarray) -> np.ndarray:
    """Rows of integers of one width from a column of packed vectors."""
    cells = cells.cast(pa.large_binary())
    data = cells.buffers()[2]
    off = np.frombuffer(cells.buffers()[1], np.int64, len(cells) + 1, cells.offset * 8) // 8
    flat = (np.frombuffer(data, np.int64, off[-1]) if data is not None and data.size else np.zeros(0, np.int64))[off[0] :]
    width = int(dim.max(initial=0))
    if (dim == width).all():
        return flat.reshape(len(dim), width)
    out = np.zeros((len(dim), width), np.int64)
    out[np.repeat(np.arange(len(dim)), dim), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], dim)] = flat
    return out


def _packs() -> Callable:
    """Packs the sorted rows of each partition, which is one group, into blocks."""

    def cut(dim: np.ndarray) -> list[int]:
        if len(dim) <= BLOCK and int(dim.max(initial=0)) * len(dim) <= BLOCK_VALUES:
            return [0, len(dim)]
        at, ends = 0, [0]
        while at < len(dim):
            wide = np.maximum.accumulate(dim[at : at + BLOCK].astype(np.int64)) * np.arange(1, len(dim[at : at + BLOCK]) + 1)
            at += max(1, int((wide <= BLOCK_VALUES).sum()))
            ends.append(at)
        return ends

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            dim = col("dim").to_numpy()
            ends = cut(dim)
            for lo, hi in zip(ends, ends[1:]):
                of = lambda c: col(c).slice(lo, hi - lo)  # noqa: E731, B023
                v = _matrix(of("vector"), dim[lo:hi])
                small = v.astype(np.int32)
                body = (small if (small == v).all() else v).tobytes()
                cells = [pa.array([of("__part")[0].as_py()], pa.int64()), pa.array([float(pc.max(of("hi")).as_py())])]
                cells += [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), of(c)) for c in ("id", "__row", "norm", "theta", "tie")]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([v.shape[1]], pa.int32()), pa.array([body], pa.binary())], ["part", "hi", "id", "__row", "norm", "theta", "tie", "dim", "vectors"])

    return run


class _Block:
    """One packed row: ids (null: the last), rows, norms and vectors."""

    def __init__(self, row: pa.RecordBatch) -> None:
        def cell(c):
            return row.column(row.schema.get_field_index(c))

        def flat(c):
            return cell(c)[0].values.fill_null(_LAST).to_numpy(zero_copy_only=False)

        self.id, self.row, self.norm = flat("id"), flat("__row"), cell("norm")[0].values.to_numpy()
        self.theta, self.tie = flat("theta").copy(), flat("tie").copy()
        dim, body = cell("dim")[0].as_py(), cell("vectors")[0].as_py()
        wide = np.int32 if dim and len(body) == 4 * dim * len(self.id) else np.int64
        self.v = np.frombuffer(body, wide).reshape(len(self.id), dim).astype(np.float64 if wide is np.int32 else np.int64)


def _products(q: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows of q and p (filled with zeros to one width); most: of the lengths' products."""
    width = min(q.shape[1], p.shape[1])
    q, p = q[:, :width], p[:, :width]
    if most < 2.0**52:
        return (q.astype(np.float64, copy=False) @ p.astype(np.float64, copy=False).T).astype(np.int64)
    whole = q.astype(np.int64).astype(object) @ p.astype(np.int64).astype(object).T
    return np.clip(whole, -_LAST - 1, _LAST).astype(np.int64)


def _unit(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return v.astype(np.float64) / np.where(norm > 0, norm, 1.0)[:, None]


class _Best:
    """The k best candidates so far of a pack of queries; theta and tie: score and id that a further one must reach."""

    def __init__(self, q: _Block, k: int) -> None:
        self.q, self.k = q, k
        self.theta, self.tie = q.theta, q.tie
        self.at = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, id, row
        self.unit = _unit(q.v, q.norm)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        ok = ((score > self.theta[query]) | (score == self.theta[query]) & (ids <= self.tie[query])) & (rows != self.q.row[query])
        if not ok.any():
            return
        new = [np.concatenate([a, b[ok]]) for a, b in zip(self.at, (query, score, ids, rows))]
        order = np.lexsort((new[3], new[2], ~new[1], new[0]))  # ~score: descending without overflow
        new = [a[order] for a in new]
        first = np.flatnonzero(np.concatenate([[True], new[0][1:] != new[0][:-1]]))
        size = np.diff(np.concatenate([first, [len(new[0])]]))
        keep = np.arange(len(new[0])) - np.repeat(first, size) < self.k
        full = size >= self.k
        last = first[full] + self.k - 1
        self.theta[new[0][first[full]]], self.tie[new[0][first[full]]] = new[1][last], new[2][last]
        self.at = [a[keep] for a in new]

    def search(self, p: _Block) -> None:
        q = self.q
        top = float(p.norm[0]) if len(p.norm) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(self.theta > 0, self.theta / q.norm * (1 - _SLACK), -np.inf)  # a shorter vector cannot matter
            cosine = np.where(self.theta > 0, self.theta / (q.norm * top), -1.0)
        prefix = np.searchsorted(-p.norm, -reach, "right")  # of the vectors, longest first
        high = np.flatnonzero((cosine > HIGH_COSINE) & (prefix > 0))
        chosen = self.by_coordinates(p, high, cosine, prefix) if len(high) else high
        rest = np.setdiff1d(np.flatnonzero(prefix > 0), chosen, assume_unique=True)
        rest = rest[np.argsort(-prefix[rest], kind="stable")]
        for lo in range(0, len(rest), 1024):
            at = rest[lo : lo + 1024]
            n = int(prefix[at[0]])
            s = _products(q.v[at], p.v[:n], float(q.norm[at].max()) * top)
            i, j = np.nonzero(s >= self.theta[at][:, None])
            self.offer(at[i], s[i, j], p.id[j], p.row[j])

    def by_coordinates(self, p: _Block, high: np.ndarray, cosine: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Searches the queries whose best coordinate leaves few vectors; returns them."""
        unit, width = _unit(p.v, p.norm), min(p.v.shape[1], self.unit.shape[1])
        focus = self.focus[high]
        angle = np.arccos(np.clip(np.take_along_axis(self.unit[high], focus, 1), -1, 1))
        wide = np.arccos(np.clip(cosine[high] - _SLACK, -1, 1))[:, None]
        low, up = np.cos(np.minimum(np.pi, angle + wide)) - _SLACK, np.cos(np.maximum(0, angle - wide)) + _SLACK
        lists: dict[int, np.ndarray] = {}
        left = np.full(focus.shape, len(unit))
        begin = np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            if f < width:
                lists[int(f)] = order = np.argsort(unit[:, f], kind="stable")
                at = focus == f
                begin[at] = np.searchsorted(unit[order, f], low[at], "left")
                left[at] = np.searchsorted(unit[order, f], up[at], "right") - begin[at]
        best = np.argmin(left, axis=1) if focus.shape[1] else np.zeros(len(high), np.int64)
        few = np.flatnonzero(left[np.arange(len(high)), best] < FEW * prefix[high]) if focus.shape[1] else high[:0]
        for i in few:
            b, n = best[i], left[i, best[i]]
            at = lists[int(focus[i, b])][begin[i, b] : begin[i, b] + n]
            at = at[at < prefix[high[i]]]
            for f, lo, hi in zip(focus[i], low[i], up[i]):
                if f < width:
                    at = at[(unit[at, f] >= lo) & (unit[at, f] <= hi)]
            if len(at):
                s = _products(self.q.v[high[i] : high[i] + 1], p.v[at], float(self.q.norm[high[i]] * p.norm[0]))[0]
                self.offer(np.full(len(at), high[i]), s, p.id[at], p.row[at])
        return high[few]

    def found(self) -> pa.RecordBatch:
        query, score, ids, rows = self.at
        null = ids == _LAST
        return pa.RecordBatch.from_arrays([pa.array(self.q.row[query]), pa.array(self.q.id[query], mask=self.q.id[query] == _LAST), pa.array(ids, mask=null), pa.array(rows), pa.array(score)], ["__query", "query_id", "vec_id", "__row", "score"])


def _search(k: int) -> Callable:
    """Rows come sorted by cell, its queries first and then its blocks, longest first."""

    def run(batches):
        cell, packs = None, []
        for b in batches:
            at = b.schema.get_field_index
            cells, queries = b.column(at("cell")).to_numpy(), b.column(at("of_queries")).to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                if cells[i] != cell:
                    yield from (x.found() for x in packs)
                    cell, packs = cells[i], []
                block = _Block(b.slice(i, 1))
                if queries[i]:
                    packs.append(_Best(block, k))
                else:
                    for x in packs:
                        x.search(block)
        yield from (x.found() for x in packs)

    return run


def _seeded(seeds: tuple, k: int) -> Callable:
    """Adds to each query the score and id of its k-th best among the seeds (or none), and its reach."""

    def run(batches):
        rows, ids, norms, vectors = seeds
        top = float(norms.max(initial=0))
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            own, norm = col("__row").to_numpy(), col("norm").to_numpy()
            theta, tie = np.full(len(own), -_LAST - 1), np.full(len(own), _LAST)
            v = _matrix(col("vector"), col("dim").to_numpy())
            for lo in range(0, len(own), 512):
                s = _products(v[lo : lo + 512], vectors, float(norm[lo : lo + 512].max(initial=0)) * top)
                for i, x in enumerate(s):
                    ok = np.flatnonzero(rows != own[lo + i])
                    if len(ok) >= k:
                        x = x[ok]
                        least = np.partition(x, len(x) - k)[len(x) - k]
                        near = ok[x >= least]
                        kth = near[np.lexsort((ids[near], ~s[i][near]))[k - 1]]
                        theta[lo + i], tie[lo + i] = s[i][kth], ids[kth]
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where((theta > 0) & (norm > 0), theta / norm * (1 - _SLACK), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(theta), pa.array(tie), pa.array(-reach)], [*b.schema.names, "theta", "tie", "hi"])

    return run


def _dealt(partners: list[tuple[int, float]], cells: Callable) -> Callable:
    """Each packed row once for each partner (place, bound) that it can matter to, with the number of their cell."""

    def run(batches):
        for b in batches:
            hi, part = b.column(b.schema.get_field_index("hi")).to_numpy(), b.column(b.schema.get_field_index("part")).to_numpy()
            for place, bound in partners:
                at = np.flatnonzero(hi >= bound)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(cells(part[at], place)), *[c.take(pa.array(at)) for c in b.columns]], ["cell", *b.schema.names])

    return run


def top_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each row for which `queries` holds."""
    spark = vectors.sparkSession
    given = vectors.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # `asks` holds of the id or of other columns, so it travels as the sign of the row's number.
    signed = F.when(F.col("asks"), -F.col("__row") - 1).otherwise(F.col("__row")).alias("__row")
    rows = written(given.select(signed, "id", "vector").mapInArrow(_integers(scale), VECTOR), "top-vectors")
    sample = bounded_sample(rows, "__row", SEEDS).toArrow().combine_chunks()  # SEEDS rows at most
    dim = sample["dim"].to_numpy()
    cells = sample["vector"].combine_chunks() if sample.num_rows else pa.array([], pa.binary())
    ids = sample["id"].fill_null(_LAST).to_numpy()
    seeds = (sample["__row"].to_numpy(), ids, sample["norm"].to_numpy(), _matrix(cells, dim))

    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = min(GROUP, max(BLOCK // 2, -(-n // tasks)))

    def packed(df: DataFrame, most: int, name: str) -> DataFrame:
        """Groups of `most` neighbours in the order of `hi`, whatever the partitions of the sort."""
        placed, size = in_order(df, [F.col("hi").desc(), F.col("__row")], "__place")
        near = placed.withColumn("__part", F.expr(f"(__place - 1) div {most}").cast("int")).repartitionById(max(1, -(-size // most)), "__part")
        return written(near.sortWithinPartitions("__place").drop("__place").mapInArrow(_packs(), PACKED), name)

    nothing = F.lit(None).cast("long")
    blocks = packed(rows.withColumn("hi", F.col("norm")).withColumn("theta", nothing).withColumn("tie", nothing), group, "top-blocks")
    asking = rows.where("__row < 0")
    seeded = written(asking.mapInArrow(_seeded(seeds, k), f"{VECTOR}, theta long, tie long, hi double"), "top-queries")
    packs = packed(seeded, PACK, "top-packs")

    # One row a group or pack of thousands of vectors; a pack's `hi` is less its least reach.
    groups = [(r["part"], r["hi"]) for r in blocks.groupBy("part").agg(F.max("hi").alias("hi")).sort("part").collect()]
    wants = [(r["part"], -r["hi"]) for r in packs.groupBy("part").agg(F.max("hi").alias("hi")).sort("part").collect()]
    group_ids, want_ids, width = np.array([g for g, _ in groups], np.int64), np.array([w for w, _ in wants], np.int64), len(groups)
    to_packs = [(i, reach) for i, (_, reach) in enumerate(wants)]
    to_groups = [(i, -hi) for i, (_, hi) in enumerate(groups)]
    cell = f"cell long, {PACKED}"
    right = blocks.mapInArrow(_dealt(to_packs, lambda part, place: place * width + np.searchsorted(group_ids, part)), cell).withColumn("of_queries", F.lit(False))
    left = packs.mapInArrow(_dealt(to_groups, lambda part, place: np.searchsorted(want_ids, part) * width + place), cell).withColumn("of_queries", F.lit(True))
    parts = max(tasks, len(wants) * width // 4)
    met = left.unionByName(right).repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", F.col("of_queries").desc(), F.col("hi").desc())
    found = met.mapInArrow(_search(k), "__query long, query_id long, vec_id long, __row long, score long")
    order = Window.partitionBy("__query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "__row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


#: The contract's search as one SQL statement.
ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT r, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM e),
bad AS (SELECT DISTINCT r FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT r, vec_id, k, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c WHERE r NOT IN (SELECT r FROM bad)),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, p.r AS pr, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score
      FROM v q JOIN v p ON q.k = p.k AND q.r <> p.r WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3, 4),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, pr) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
