"""Vectors as rows: sparse term vectors, pooling, centroids, consistency, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import dot, norm


def token_slot(token: Column, size: int = 100_000) -> Column:
    """md5 of a token modulo a size: the 128-bit number in parts of 28 bits, whose remainders are carried along."""
    digest, out = F.md5(token), F.lit(0).cast("bigint")
    for at in range(1, 33, 7):
        n = min(7, 33 - at)
        part = F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
        out = (out * F.lit(16**n % size) + part) % size
    return out


def sparse_vectors(tokens: DataFrame, key: str, token: str = "token") -> DataFrame:
    """(key, slot, weight): a token's count over the largest count of the key."""
    n = tokens.groupBy(key, token_slot(F.col(token)).alias("slot")).agg(F.count("*").alias("_n"))
    most = n.groupBy(key).agg(F.max("_n").alias("_most"))
    return n.join(most, key).select(key, "slot", (F.col("_n") / F.col("_most")).alias("weight"))


def mean_vectors(rows: DataFrame, key: str, vec: str, dimension: int) -> DataFrame:
    """(key, n, vec): the mean of a key's vectors, by dimension, so that a key of many rows is summed up where it lies."""
    own = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(F.get(vec, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dimension)))
    return own.select(key, "n", F.array(*(f"_{i}" for i in range(dimension))).alias("vec"))


def consistency(rows: DataFrame, key: str, vec: str, dimension: int, row_id: str) -> DataFrame:
    """(key, n, mean_cosine, nearest): the mean cosine of all pairs of a key's vectors (1 for a single one), and the id of the row
    most alike to their mean (ties: the smallest). The pairs' sum follows from the length of the unit vectors' sum, so that
    no pair is made; vectors of no length, another dimension or null don't count."""
    length = norm(F.col(vec))
    sound = rows.where((F.size(vec) == dimension) & (length > 0)).select(key, F.col(row_id).alias("_id"), F.transform(vec, lambda x: x.cast("double") / length).alias("_u"))
    sums = sound.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.get("_u", F.lit(i))).alias(f"_{i}") for i in range(dimension)))
    sums = sums.select(key, "n", F.array(*(f"_{i}" for i in range(dimension))).alias("_s"))
    pairs = F.when(F.col("n") > 1, (dot(F.col("_s"), F.col("_s")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    best = sound.join(sums, key).groupBy(key).agg(F.min(F.struct((-F.round(dot(F.col("_u"), F.col("_s")), 9)).alias("less"), "_id")).alias("b"))
    return sums.withColumn("mean_cosine", pairs).join(best, key).select(key, "n", "mean_cosine", F.col("b._id").alias("nearest"))


def gaussian_clusters(rows: DataFrame, vec: str, most: int, seed: int = 1) -> DataFrame:
    """With cluster: a Gaussian mixture with as many parts, up to `most`, as the Bayesian criterion prefers."""
    from math import log

    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    n, d = data.count(), data.select(F.size(vec)).first()[0]
    best = None
    for k in range(1, most + 1):
        model = GaussianMixture(featuresCol="_v", predictionCol="cluster", k=k, seed=seed, maxIter=20).fit(data)
        free = k - 1 + k * d + k * d * (d + 1) / 2
        bic = free * log(max(n, 1)) - 2 * model.summary.logLikelihood
        best = min(best or (bic, model), (bic, model), key=lambda x: x[0])
    return best[1].transform(data).drop("_v", "probability")
