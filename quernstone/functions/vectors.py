"""Vector functions over arrays of numbers, in the JVM, and exact search by blocks."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Sum of products; null if either is null, or the lengths differ and one is padded with nulls."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; null if a vector is null or has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 1_000, chunk: int = 20_000) -> DataFrame:
    """(query, id_col, cosine): for each query the k rows of greatest cosine (rounded to five places; ties by id), itself left out.

    Queries are cut into blocks and rows into chunks by hashes of their ids; a task multiplies one block with one chunk and keeps the best k of each query, so
    it holds a bounded number of vectors. Null ids and vectors, vectors of length zero, and those with null elements or another length than most have no neighbours.
    Rows of equal ids count each. An empty table gives an empty result.
    """
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    take = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & fine)
    r, q = take(rows), take(queries)
    n, m = r.count(), q.count()
    cells, parts = max(1, math.ceil(m / block)), max(1, math.ceil(n / chunk))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    r = r.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("p"), every(cells, "b"))
    q = q.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(cells)).cast("int").alias("b"), every(parts, "p"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            size = right["v"].map(len).mode()[0]
            left, right = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
            unit = lambda s: (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(np.stack(s.to_list()))
            ids, asked = left["i"].to_numpy(), right["i"].to_numpy()
            if len(ids) and len(asked):
                scores = np.round(unit(right["v"]) @ unit(left["v"]).T, 5) + 0.0
                for row, query in zip(scores, asked):
                    order = np.lexsort((ids, -row))[: k + 1]
                    order = order[ids[order] != query][:k]
                    out.append(pd.DataFrame({"query": query, "i": ids[order], "cosine": row[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series([], dtype="int64"), "i": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype="float64")})

    found = r.groupBy("b", "p").cogroup(q.groupBy("b", "p")).applyInPandas(best, "query long, i long, cosine double")
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "i"))).where(F.col("k") <= k)
    return ranked.select("query", F.col("i").alias(id_col), "cosine")
