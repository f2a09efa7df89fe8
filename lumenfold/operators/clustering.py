"""Clustering over fingerprint similarity: density, medoids, average linkage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import duplicates as D
from lumenfold.runtime import drop_path, hot_join, stage


def spread_minimum(edges: DataFrame) -> DataFrame:
    """``id``, ``root``: smallest id reachable over the edges (``a``, ``b``), by pointer jumping over minima.

    Goes on until nothing moves.  Ids with very many edges and roots of very many ids are joined apart from the others.
    """
    spark = edges.sparkSession
    both, _ = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "spread")
    cur, cur_path = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "spread")
    while True:
        near = hot_join(both, cur.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        step, step_path = stage(cur.join(near, "id").select("id", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")), "spread")
        jump = hot_join(step, step.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
        seen = Observation()
        news = jump.select("id", F.least("root", F.coalesce("top", "root")).alias("root"), (F.col("moved") | F.coalesce(F.col("top") < F.col("root"), F.lit(False))).alias("moved"))
        nxt, nxt_path = stage(news.observe(seen, F.count_if("moved").alias("moved")), "spread")
        for p in (cur_path, step_path):
            drop_path(spark, p)
        cur, cur_path = nxt.select("id", "root"), nxt_path
        if not seen.get["moved"]:
            return cur


def dbscan(ids: DataFrame, pairs: DataFrame, min_points: int, copies: DataFrame | None = None) -> DataFrame:
    """``id``, ``cluster``, ``core`` of density clusters over similar pairs (``id_a``, ``id_b``).

    A record with at least ``min_points`` records in its neighbourhood, itself included, is core; core
    records that are neighbours share a cluster, named by its smallest core id; a border record joins the
    smallest cluster among its core neighbours; noise is left out.

    ``copies`` (``id``, ``copies``): how many equal records each record stands for, itself included; all of them
    count as neighbours, so that a record with copies enough is core without any pair.
    """
    near = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b"))).distinct()
    degree = near.groupBy("a").agg((F.count("*") + 1).alias("n"))
    if copies is not None:
        others = near.join(copies.select(F.col("id").alias("b"), "copies"), "b").select("a", "copies")
        degree = copies.select(F.col("id").alias("a"), "copies").unionByName(others).groupBy("a").agg(F.sum("copies").alias("n"))
    core = (degree.where(F.col("n") >= min_points).select(F.col("a").alias("id"))) if min_points > 1 else ids.select("id")
    core, _ = stage(core.distinct(), "dbscan")
    inner = near.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    roots = core.join(spread_minimum(inner), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    roots, _ = stage(roots, "dbscan")
    border = near.join(core.select(F.col("id").alias("a")), "a", "left_anti").join(roots.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    return roots.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))


def dbscan_images(fingerprints: DataFrame, threshold: float, min_points: int, weights: dict[str, float] | None = None) -> DataFrame:
    """``id``, ``cluster``, ``core`` of density clusters over all records, those with equal hashes included.

    The clusters are formed over one representative (the smallest id) of each set of equal hashes, weighted by its copies;
    equal records have equal neighbourhoods, so they share its row.
    """
    names = sorted(h for h, v in S.weights_or_default(weights).items() if v > 0)
    classes, _ = stage(D.hash_classes(fingerprints, names).select("id", "copies"), "classes")
    pairs, _ = stage(D.near_pairs(fingerprints, threshold, weights), "near")
    found, _ = stage(dbscan(classes, pairs, min_points, classes).withColumnRenamed("id", "rep"), "dbscan")
    members = D.class_members(fingerprints, weights)
    out = hot_join(members, found, "rep").select("id", "cluster", "core")
    if min_points > 1:
        return out
    alone = fingerprints.where("id is not null").select("id").join(members.select("id"), "id", "left_anti")  # without hashes: near to themselves alone
    return out.unionByName(alone.select("id", F.col("id").alias("cluster"), F.lit(True).alias("core")))


def k_medoids(rows: DataFrame, k: int, distance: Callable, max_rounds: int = 10, stop: float = 0.01) -> DataFrame:
    """``id``, ``cluster``, ``medoid``: nearest of ``k`` medoids, ties to the lowest number.

    ``rows``: ``id`` and ``v``; ``distance`` takes two columns.  Starts from the ``k`` smallest ids.
    A cluster's medoid is the member with the smallest sum of distances to the cluster; the members are met
    with the cluster in blocks, and only sums leave the join.  Stops when no medoid moves by more than ``stop``, and
    raises an error where that takes more than ``max_rounds``.
    """
    spark = rows.sparkSession
    rows, _ = stage(rows.select("id", "v").where("v is not null"), "medoids")
    medoids = [(i, r.id, r.v) for i, r in enumerate(rows.orderBy("id").limit(k).collect())]
    kind = rows.schema["v"].dataType.simpleString()

    def assign() -> DataFrame:
        m = F.broadcast(spark.createDataFrame(medoids, f"cluster int, medoid string, mv {kind}"))  # k rows
        near = rows.crossJoin(m).withColumn("d", distance(F.col("v"), F.col("mv")))
        return near.groupBy("id").agg(F.min_by(F.struct("cluster", "medoid", "v"), F.struct("d", "cluster")).alias("x")).select("id", "x.*")

    for _ in range(max_rounds):
        if not medoids:
            break
        got, path = stage(assign(), "medoids")
        left, right = D.in_blocks(got, "cluster", "id")
        pair = left.alias("a").join(right.alias("b"), (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.meet") == F.col("b.meet")))
        cost = pair.groupBy(F.col("a.cluster").alias("cluster"), F.col("a.id").alias("id")).agg(F.sum(distance(F.col("a.v"), F.col("b.v"))).alias("cost"))
        best = cost.groupBy("cluster").agg(F.min_by("id", F.struct(F.round("cost", 9), F.col("id"))).alias("id"))
        new = [(r.cluster, r.id, r.v) for r in best.join(rows, "id").collect()]  # k rows
        old = {c: v for c, _, v in medoids}
        far = spark.createDataFrame([(c, v, old[c]) for c, _, v in new], f"c int, p {kind}, q {kind}").agg(F.max(distance(F.col("p"), F.col("q"))).alias("m")).first().m
        medoids = sorted(new)
        drop_path(spark, path)
        if far is None or far <= stop:
            break
    else:
        raise RuntimeError(f"medoids did not settle in {max_rounds} rounds")
    if not medoids:
        return spark.createDataFrame([], "id string, cluster int, medoid string")
    return assign().select("id", "cluster", "medoid")


def average_linkage(sim: np.ndarray, threshold: float, copies: np.ndarray | None = None) -> np.ndarray:
    """Cluster number of each row: the closest pair of clusters by mean similarity is merged while it reaches the threshold.

    ``copies``: how many equal records each row stands for.
    """
    n = len(sim)
    label, s = np.arange(n), sim.astype(float).copy()
    size = np.ones(n) if copies is None else copies.astype(float)
    np.fill_diagonal(s, -1)
    near = np.round(s, 12)  # means that differ by rounding are equal, and the first of them counts
    while n > 1:
        at = int(near.argmax())
        i, j = divmod(at, n)
        if near[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = merged, merged
        near[i], near[:, i] = np.round(merged, 12), np.round(merged, 12)
        for m in (s, near):
            m[i, i] = -1
            m[j], m[:, j] = -1, -1
        size[i] += size[j]
        label[label == j] = i
    return label


def _linkage_rounds(rows: DataFrame, pairs: DataFrame, threshold: float, w: dict[str, float]) -> DataFrame:
    """``id``, ``cluster`` by average linkage over ``rows`` (``id``, ``copies``, hashes) and their similar pairs (``id_a``, ``id_b``).

    Every round merges all clusters that are each other's nearest, which gives the clusters of one merge at a time, as a
    merged cluster is never nearer to a third than the nearer of its parts.  Only clusters with a similar pair between them are compared;
    their sums of similarities stay until one of them merges.  No task holds a cluster.
    """
    spark = rows.sparkSession
    links, _ = stage(pairs.select("id_a", "id_b"), "linkage")
    members, path = stage(rows.withColumn("cluster", F.col("id")), "linkage")
    sums, sums_path = spark.createDataFrame([], f"lo {rows.schema['id'].dataType.simpleString()}, hi {rows.schema['id'].dataType.simpleString()}, s double, n double"), None
    sim = S.fingerprint_similarity(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"), w)
    weight = (F.col("a.copies") * F.col("b.copies")).cast("double")
    while True:
        ends = [members.select(F.col("id").alias(f"id_{x}"), F.col("cluster").alias(x)) for x in "ab"]
        linked = links.join(ends[0], "id_a").join(ends[1], "id_b").where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
        linked, linked_path = stage(linked, "linkage")
        new = linked.join(sums, ["lo", "hi"], "left_anti").join(members.alias("a"), F.col("lo") == F.col("a.cluster")).join(members.alias("b"), F.col("hi") == F.col("b.cluster"))
        new = new.groupBy("lo", "hi").agg(F.sum(sim * weight).alias("s"), F.sum(weight).alias("n"))
        known, known_path = stage(sums.join(linked, ["lo", "hi"]).unionByName(new), "linkage")
        near = known.withColumn("key", F.struct((-F.round(F.col("s") / F.col("n"), 12)).alias("far"), "lo", "hi")).where(F.col("key.far") <= -(threshold - 1e-12))
        best = near.select(F.explode(F.array("lo", "hi")).alias("me"), "key").groupBy("me").agg(F.min("key").alias("key"))
        merges, merges_path = stage(best.groupBy("key").count().where("count = 2").select("key.lo", "key.hi"), "linkage")
        done = not merges.limit(1).count()
        if not done:
            moved = members.join(merges.select(F.col("hi").alias("cluster"), "lo"), "cluster", "left").withColumn("cluster", F.coalesce("lo", "cluster")).select(*members.columns)
            moved, moved_path = stage(moved, "linkage")
            gone = merges.select(F.explode(F.array("lo", "hi")).alias("x"))
            kept = known.join(gone.withColumnRenamed("x", "lo"), "lo", "left_anti").join(gone.withColumnRenamed("x", "hi"), "hi", "left_anti").select("lo", "hi", "s", "n")
            kept, kept_path = stage(kept, "linkage")
            drop_path(spark, path)
            members, path = moved, moved_path
        for p in (linked_path, known_path, merges_path, sums_path):
            if p:
                drop_path(spark, p)
        if done:
            return members.select("id", "cluster")
        sums, sums_path = kept, kept_path


#: Records of small groups that a task clusters one group after the other.
BUNDLE_ROWS = 5000


def agglomerative(fingerprints: DataFrame, pairs: DataFrame, threshold: float, weights: dict[str, float] | None = None, most: int = 5000, copies: DataFrame | None = None) -> DataFrame:
    """``id``, ``cluster`` (smallest id of it) by average linkage within each connected group of similar pairs.

    Two clusters without a similar pair between them cannot merge, as their mean lies below the
    threshold, so groups are independent.  Groups of up to ``most`` records are clustered in one task each, larger ones in rounds.

    ``copies`` (``id``, ``copies``): how many equal records each record stands for in the means, itself included.
    """
    roots, _ = stage(spread_minimum(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), "linkage")
    names = [h for h, v in S.weights_or_default(weights).items() if v > 0]
    w = np.array([S.weights_or_default(weights)[n] for n in names])
    tables = np.array([[S.transfer_value(n, d) for d in range(65)] for n in names])
    cols = [F.coalesce(F.col(f"perceptual_hashes.{n}"), F.lit(0)).alias(n) for n in names]

    def one(ids: np.ndarray, hashes: list[np.ndarray], copies: np.ndarray) -> np.ndarray:
        total, by = 0.0, 0.0
        for i, h in enumerate(hashes):
            both = (h[:, None] != 0) & (h[None, :] != 0)
            d = np.bitwise_count((h[:, None] ^ h[None, :]).view(np.uint64))
            total, by = total + np.where(both, tables[i][d] * w[i], 0), by + both * w[i]
        return ids[average_linkage(np.where(by > 0, total / np.where(by > 0, by, 1), 0), threshold - 1e-12, copies)]

    def run(t: pa.Table) -> pa.Table:
        """The groups of one bundle, each by itself."""
        t = t.sort_by([("root", "ascending"), ("id", "ascending")])
        root, ids, copies = (np.array(t.column(c).to_pylist(), object) for c in ("root", "id", "copies"))
        hashes = [t.column(n).to_numpy() for n in names]
        begins = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        out = [one(ids[a:z], [h[a:z] for h in hashes], copies[a:z].astype(float)) for a, z in zip(begins, np.r_[begins[1:], len(ids)])]
        return pa.table({"id": t.column("id"), "cluster": pa.array(np.concatenate(out).tolist(), t.column("id").type)})

    sizes, _ = stage(roots.groupBy("root").agg(F.count("*").alias("n")), "linkage")
    sized, _ = stage(hot_join(roots, sizes, "root"), "linkage")
    # two similar records are one cluster
    two = sized.where("n = 2").select("id", F.col("root").alias("cluster"))
    rest = sized.where("n > 2").join(fingerprints.select("id", *cols), "id")
    rest = rest.withColumn("copies", F.lit(1).cast("long")) if copies is None else rest.join(copies.select("id", "copies"), "id")
    bundles = max(1, -(-sized.count() // BUNDLE_ROWS))
    small = rest.where(F.col("n") <= most).withColumn("bundle", F.pmod(F.xxhash64("root"), F.lit(bundles)))
    kind = sized.schema["id"].dataType.simpleString()
    out = two.unionByName(small.groupBy("bundle").applyInArrow(run, f"id {kind}, cluster {kind}"))
    if not sizes.where(F.col("n") > most).limit(1).count():
        return out
    large = rest.where(F.col("n") > most)
    within = large.select(F.col("id").alias("id_a"))
    return out.unionByName(_linkage_rounds(large.drop("root", "n"), pairs.join(within, "id_a"), threshold, {n: S.weights_or_default(weights)[n] for n in names}))


def agglomerative_images(fingerprints: DataFrame, threshold: float, weights: dict[str, float] | None = None, most: int = 5000) -> DataFrame:
    """``id``, ``cluster`` by average linkage of every record with a similar or an equal other one.

    Equal hashes are similar by 1 and merge before all others, so a set of them enters as one cluster of its size.
    """
    names = sorted(h for h, v in S.weights_or_default(weights).items() if v > 0)
    classes, _ = stage(D.hash_classes(fingerprints, names).select("id", "copies"), "classes")
    pairs, _ = stage(D.near_pairs(fingerprints, threshold, weights), "near")
    found, _ = stage(agglomerative(fingerprints, pairs, threshold, weights, most, classes).withColumnRenamed("id", "rep"), "linkage")
    alone = classes.where("copies > 1").select(F.col("id").alias("rep"), F.col("id").alias("cluster")).join(found, "rep", "left_anti")
    return hot_join(D.class_members(fingerprints, weights), found.unionByName(alone), "rep").select("id", "cluster")


def cluster_heads(members: DataFrame, key: str, n: int = 5) -> DataFrame:
    """``key``, ``members``: the first ``n`` ids of each cluster (a listing for people)."""
    w = Window.partitionBy(key).orderBy("id")
    return members.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("members"))
