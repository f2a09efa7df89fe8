"""Seeded random-hyperplane hashing of vectors: buckets, their statistics, candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hyperplane(table: int, bit: int, dim: int, seed: int = 1) -> list[float]:
    """Fixed weights of one plane, from a counter-based generator."""
    return np.random.Generator(np.random.Philox(key=[seed, table * 1024 + bit])).standard_normal(dim).round(6).tolist()


def bucket(vec: Column, table: int, bits: int, dim: int, seed: int = 1) -> Column:
    """Sign bits of a vector against the planes of one table, as a long."""
    word = F.lit(0).cast("long")
    for b in range(bits):
        plane = F.array(*[F.lit(x) for x in hyperplane(table, b, dim, seed)])
        dot = F.aggregate(F.zip_with(vec, plane, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        word = word.bitwiseOR(F.when(dot > 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return word


def index(vectors: DataFrame, id_col: str, vec_col: str, dim: int, tables: int = 4, bits: int = 8, seed: int = 1) -> DataFrame:
    """``id``, ``tbl``, ``bucket``: one row a vector and table; null vectors and those of another length are left out."""
    rows = vectors.where(F.size(vec_col) == dim)
    entries = F.array(*[F.struct(F.lit(t).alias("tbl"), bucket(F.col(vec_col), t, bits, dim, seed).alias("bucket")) for t in range(tables)])
    return rows.select(F.col(id_col).alias("id"), F.explode(entries).alias("e")).select("id", "e.tbl", "e.bucket")


def bucket_stats(indexed: DataFrame) -> DataFrame:
    """One row: tables, buckets, items, largest and mean bucket (zeros when empty)."""
    sizes = indexed.groupBy("tbl", "bucket").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count_distinct("tbl").alias("num_tables"), F.count("*").alias("total_buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_bucket"),
    )


def candidates(indexed: DataFrame, queries: DataFrame, limit: int | None = None, crowded: int = 20_000) -> DataFrame:
    """``query``, ``id``, ``tables``: vectors that share a bucket with a query (``queries`` is an index of the query vectors).

    Buckets of more than ``crowded`` vectors (the 1024 largest of them) are dealt into parts, and their queries go to every part.
    """
    sizes = indexed.groupBy("tbl", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    parts = F.broadcast(sizes.orderBy(F.col("n").desc(), "tbl", "bucket").limit(1024).withColumn("parts", F.ceil(F.col("n") / crowded).cast("int")).drop("n"))
    n = F.coalesce("parts", F.lit(1))
    held = indexed.join(parts, ["tbl", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int")).drop("parts")
    q = queries.select(F.col("id").alias("query"), "tbl", "bucket").join(parts, ["tbl", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
    hits = held.join(q, ["tbl", "bucket", "part"]).where("id <> query").groupBy("query", "id").agg(F.count("*").alias("tables"))
    if limit is None:
        return hits
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.col("tables").desc(), "id")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def nearest(vectors: DataFrame, id_col: str, vec_col: str, wanted: Column, k: int, **settings) -> DataFrame:
    """``query``, ``id``, ``cosine``: the ``k`` nearest, by exact cosine, among the candidates of each vector that is ``wanted`` (a condition on ``id``).

    ``settings``: of ``index``; they decide how many of the true neighbours are among the candidates.
    """
    from pyspark.sql import Window

    from lumenfold.functions import scalars as S

    x = index(vectors, id_col, vec_col, **settings)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    hits = candidates(x, x.where(wanted)).join(v, "id").join(v.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    return hits.select("query", "id", S.cosine(F.col("q"), F.col("v")).alias("cosine")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
