"""Ward clustering of a small matrix and its stability under resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.ranks import spread


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k (by first row) after merging the pair of least increase of variance until k clusters are left."""
    n = len(x)
    centre, size, alive, of = x.astype(float).copy(), np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - k):
        ids = np.flatnonzero(alive)
        c, s = centre[ids], size[ids]
        d = ((c[:, None] - c[None]) ** 2).sum(2) * (s[:, None] * s[None] / (s[:, None] + s[None]))
        d[np.tril_indices(len(ids))] = np.inf
        i, j = np.unravel_index(np.argmin(d), d.shape)
        a, b = ids[i], ids[j]
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        of[of == b] = a
    _, first, back = np.unique(of, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back] + 1


def standardised(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1)


def ward(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """key, cluster of a small table (its rows meet in one task)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, cluster int"

    def run(p):
        p = p.sort_values(key)
        return p[[key]].assign(cluster=ward_labels(standardised(p[columns].to_numpy(float)), k).astype("int32"))

    return df.select(key, *columns).withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(run, schema)


def bootstrap_ward(df: DataFrame, key: str, columns: list[str], k: int, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """round, key, cluster: resampled rows, rescaled and clustered in every round; repeated rows count once."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    small = df.select(key, *columns)
    r = small.crossJoin(spark.range(rounds).withColumnRenamed("id", "round"))  # a stated number of copies of a small table

    def run(p):
        p = p.sort_values(key).reset_index(drop=True)
        rng = np.random.default_rng([seed, int(p["round"].iloc[0])])
        pick = np.sort(rng.integers(0, len(p), len(p)))
        labels = ward_labels(standardised(p[columns].to_numpy(float)[pick]), min(k, len(p)))
        first = np.r_[True, pick[1:] != pick[:-1]]
        return p.loc[pick[first], ["round", key]].assign(cluster=labels[first].astype("int32"))

    return spread(r, "round").groupBy("round").applyInPandas(run, f"round long, {key} {kind}, cluster int")


def co_occurrence(labels: DataFrame, key: str) -> DataFrame:
    """a < b, together, both, share: how often two rows are in one cluster of the rounds that have both."""
    x, y = labels.alias("x"), labels.alias("y")
    p = x.join(y, (F.col("x.round") == F.col("y.round")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    same = F.col("x.cluster") == F.col("y.cluster")
    return p.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(F.count_if(same).alias("together"), F.count(F.lit(1)).alias("both"), F.avg(same.cast("double")).alias("share"))


def best_jaccard(original: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """cluster, mean and population sd over the rounds of the best Jaccard match of the whole cluster with a round's; with a verdict.

    Rows that a round lacks stay in the union, and a round that meets none of the cluster counts as 0.
    """
    o = original.select(key, F.col("cluster").alias("own"))
    sizes = o.groupBy("own").agg(F.count(F.lit(1)).alias("__o"))
    rounds = labels.agg(F.count_distinct("round").alias("__r"))
    j = labels.join(o, key)
    both = j.groupBy("round", "own", "cluster").agg(F.count(F.lit(1)).alias("n"))
    both = both.withColumn("__c", F.sum("n").over(Window.partitionBy("round", "cluster"))).join(F.broadcast(sizes), "own")  # a row a cluster
    best = both.withColumn("jac", F.col("n") / (F.col("__o") + F.col("__c") - F.col("n"))).groupBy("own", "round").agg(F.max("jac").alias("jac"))
    s = sizes.join(best, "own", "left").groupBy("own").agg(F.coalesce(F.sum("jac"), F.lit(0.0)).alias("__s"), F.coalesce(F.sum(F.col("jac") * F.col("jac")), F.lit(0.0)).alias("__ss")).crossJoin(F.broadcast(rounds))
    mean = F.col("__s") / F.col("__r")
    out = s.select(F.col("own").alias("cluster"), mean.alias("mean"), F.sqrt(F.greatest(F.col("__ss") / F.col("__r") - mean * mean, F.lit(0.0))).alias("sd"))
    return out.withColumn("verdict", F.when(F.col("mean") >= 0.75, "STABLE").when(F.col("mean") >= 0.5, "MODERATE").otherwise("UNSTABLE"))


def _placed(pairs: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Each pair from both of its ends: who, own, other (clusters), share."""
    ends = pairs.select(F.col("a").alias("who"), F.col("b").alias("with"), "share").unionByName(pairs.select(F.col("b").alias("who"), F.col("a").alias("with"), "share"))
    of = lambda name, c: original.select(F.col(key).alias(name), F.col("cluster").alias(c))
    return ends.join(of("who", "own"), "who").join(of("with", "other"), "with")


def separation(pairs: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Mean co-occurrence of each cluster within itself and with all others, their difference and its class."""
    p = _placed(pairs, original, key)
    same = F.col("own") == F.col("other")
    a = p.groupBy(F.col("own").alias("cluster")).agg(F.avg(F.when(same, F.col("share"))).alias("within"), F.avg(F.when(~same, F.col("share"))).alias("between")).withColumn("separation", F.col("within") - F.col("between"))
    return a.withColumn("verdict", F.when(F.col("separation") > 0.3, "well").when(F.col("separation") > 0.1, "moderate").otherwise("poor"))


def member_stability(pairs: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Mean co-occurrence of each row with the other rows of its cluster; NULL where it has none."""
    p = _placed(pairs, original, key).where("own = other").groupBy("who").agg(F.avg("share").alias("stability"))
    return original.select(key, "cluster").join(p.withColumnRenamed("who", key), key, "left")
