"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a local one, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pulseframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts.
SORTED_ROWS = 500_000


def in_order(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """(rows with their place 1, 2, ... in the order as column `name`, number of rows).

    Rows are sorted by sampled ranges, spread further where they tie, and written; each range's rows are counted
    (one number a range) and a row's place is the counts before its range plus its place there.
    """
    spark = rows.sparkSession
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SORTED_ROWS))
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    starts, before = [], 0
    for r in sorted(dealt.groupBy("__part").count().collect()):  # one row a range
        starts.append((r["__part"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "__part long, __before long"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(starts, "__part").withColumn(name, place).drop("__at", "__part", "__before"), n


_BLOCK = 32


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, levels: int = 4) -> Column:
    """Sums of the first 1, 2, ... elements of an array of integers.

    Array functions cannot grow an array in place, so sums are made in blocks, blocks of blocks and so on:
    the work is in proportion to the array's length up to tens of millions of elements.
    """

    def plain(a):
        none = F.array().cast("array<bigint>")
        return F.aggregate(a, none, lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("bigint")) + x)))

    def blocks(a):
        n = F.greatest(F.ceil(F.size(a) / _BLOCK).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))

    def sums(a, level):
        if not level:
            return plain(a)
        return _let(F.transform(blocks(a), plain), lambda inner: _let(
            sums(F.transform(inner, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0).cast("bigint"))), level - 1),
            lambda ends: F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))),
        ))

    return _let(F.transform(values, lambda x: x.cast("bigint")), lambda a: sums(a, levels - 1))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of least hash of the key; a threshold on the hash leaves few to order."""
    n = rows.count()
    if n > most:
        low = F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * (most + 4 * most**0.5) / n)
        rows = rows.where(low)
    return rows.orderBy(F.xxhash64(key), key).limit(most)


#: A key is hot if more than so many rows and more than a so-manieth part of all have it; so there are fewer than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 10_000, 2000


def hot_values(df: DataFrame, key: str, rows: int | None = None, counts: DataFrame | None = None) -> list:
    """Hot values of a column of df (of `rows` rows, counted by (key, count) in `counts` where the caller has that)."""
    n = df.count() if rows is None else rows
    if n <= HOT_ROWS:
        return []
    counts = df.groupBy(key).count() if counts is None else counts
    return [r[0] for r in counts.where(F.col("count") > max(HOT_ROWS, n // HOT_SHARE)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner", salts: int = 64) -> DataFrame:
    """left join right on a key that is unique on the right; rows of hot keys are dealt over `salts` tasks.

    A row's number decides, whatever its columns hold, so `left` has to be a written table or a row-wise function of one.
    """
    if not hot:
        return left.join(right, key, how)
    spread = F.col(key).isin(hot)
    left = left.withColumn("__salt", F.when(spread, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0))
    right = right.withColumn("__salt", F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
