"""Queries pN_ of the problems held by this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import clusters, groups, history, leaks, neighbours, packing, splitting
from lumenfold.runtime import stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.image_clusters(table(spark, sf_dir, "fingerprints")).select("image_id", "cluster_key")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, most typical images and centroid of every cluster."""
    images = table(spark, sf_dir, "fingerprints")
    members, _ = stage(clusters.image_clusters(images), "p1")
    return clusters.describe(members, images)


def p1_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every cluster, and how near its most typical image is to its centroid."""
    images = table(spark, sf_dir, "fingerprints")
    found, _ = stage(p1_clusters(spark, sf_dir), "p1-clusters")
    first = images.select(F.col("id").alias("image_id"), F.col("feature_vector").cast("array<double>").alias("v")).groupBy("image_id").agg(F.first("v").alias("v"))
    rows = found.select("cluster_key", "n_images", F.element_at("images", 1).alias("image_id"), F.col("centroid").cast("array<double>").alias("c")).join(first, "image_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select("cluster_key", "n_images", F.round(F.round(dot("v", "c") / F.sqrt(dot("v", "v")), 6), 5).alias("nearest"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.surviving_records(table(spark, sf_dir, "duplicate_groups"), table(spark, sf_dir, "fingerprints"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.survivors(table(spark, sf_dir, "duplicate_groups"), table(spark, sf_dir, "fingerprints"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "fingerprints"), {"feature_vector": 52, "color_histogram": 48})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "fingerprints").select(F.col("metadata.sha256").alias("sha256"), F.col("perceptual_hashes.p_hash").alias("p_hash"))
    return history.match_batches(table(spark, sf_dir, "incoming_images"), accepted)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.consolidate(table(spark, sf_dir, "duplicate_groups"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents"))


def _piece_facts(pieces: DataFrame, documents: DataFrame, core: str, limit: int) -> DataFrame:
    """What SQL can state of the pieces of each document: the characters they cover, holes and pieces above the limit, and whether a text that must stay whole did."""
    by = pieces.groupBy("doc_id").agg(
        F.sum(F.col("char_to") - F.col(core)).alias("chars"), F.min(core).cast("long").alias("begins"), F.max("char_to").cast("long").alias("ends"), F.count_if(F.col("n_tokens") > limit).alias("above"), F.count("*").alias("pieces")
    )
    small = documents.where("text is not null").select("doc_id", (F.octet_length("text") <= limit).alias("small"))
    return by.join(small, "doc_id").select("doc_id", "chars", "begins", "ends", "above", F.when(F.col("small"), F.col("pieces")).alias("pieces_if_small"))


def p8_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed, _ = stage(packing.pack_documents(docs), "p8")
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("containers_above"))
    return _piece_facts(packed, docs, "char_from", packing.CAPACITY).crossJoin(F.broadcast(over))  # one row


def p10_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _piece_facts(splitting.split_documents(docs, texts=False), docs, "core_from", splitting.LIMIT)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit()}
