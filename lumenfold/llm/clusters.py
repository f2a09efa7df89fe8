"""Problem 1: clusters of mutually similar vectors.

Density clustering over cells of reduced vectors: vectors (copies of one direction collapsed, with their number as weight) are
reduced to their leading directions and go to the cells of their nearest pivots, each cell is clustered on its own, and local
clusters that share a core point are merged.  The overlap replaces a full margin of the search radius, which
would hold nearly every vector of every cell; a cluster is found whole when its
local parts hang together through core points that fall into more than one cell.  As a cell may
hold only some members of a cluster, a point is core within its cell from ``LOCAL_POINTS`` points
(itself included) on; the density of ``MIN_POINTS`` images is asked of the merged cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.components import connected_components
from lumenfold.llm.vectors import CELL_ROWS, Cells, fit_cells, packed, partitions, parts, unit_rows, unpack_rows
from lumenfold.operators.duplicates import in_blocks
from lumenfold.runtime import hot_join, stage, width

SIMILARITY, MIN_POINTS, LOCAL_POINTS, OVERLAP = 0.83, 5, 2, 4


def local_clusters(u: np.ndarray, weight: np.ndarray, similarity: float, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label (-1: none), core flag, and whether all pairs of its local cluster are similar, per row.

    A breadth-first walk that computes each row's similarities once, in blocks.
    """
    n = len(u)
    x = u.astype(np.float32)
    label, core, whole = np.full(n, -1, np.int32), np.zeros(n, bool), np.ones(n, bool)
    done, k = np.zeros(n, bool), 0
    step = max(1, min(1024, 8_000_000 // max(n, 1)))

    def near(rows: np.ndarray) -> np.ndarray:
        return x[rows] @ x.T >= similarity - 1e-6

    start = 0
    while start < n:
        # seeds are looked at in blocks; rows reached from an earlier seed are done already
        block = np.arange(start, n)[~done[start:]][:step]
        if not len(block):
            break
        adj = near(block)
        start = int(block[-1]) + 1
        heavy = adj @ weight >= min_points
        for i, row in enumerate(block):
            if done[row]:
                continue
            done[row] = True
            if not heavy[i]:
                continue
            core[row], label[row] = True, k
            todo = np.flatnonzero(adj[i] & ~done)
            reached = adj[i].copy()
            common = adj[i].copy()
            while len(todo):
                done[todo] = True
                fresh = np.zeros(n, bool)
                for s in range(0, len(todo), step):
                    part = todo[s : s + step]
                    a = near(part)
                    c = a @ weight >= min_points
                    core[part], label[part] = c, k
                    if c.any():
                        hit = a[c].any(0)
                        fresh |= hit
                        common &= a[c].all(0)
                reached |= fresh
                todo = np.flatnonzero(fresh & ~done)
            # border rows seen as non-core before they were reached
            border = np.flatnonzero(reached & (label < 0))
            label[border] = k
            mine = label == k
            whole[mine] = bool(common[mine].all() and core[mine].all())
            k += 1
    return label, core, whole


def _cells(rows: DataFrame, cells: Cells, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = cells.nearest(unit_rows(unpack_rows(b.column(1).to_pylist(), cells.dim)), overlap)
            for j in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, j]), *b.columns], names=["cell", "vh", "vec", "weight"])

    return rows.select("vh", "vec", "weight").mapInArrow(run, "cell int, vh long, vec binary, weight long")


def cluster_labels(vectors: DataFrame, cells: Cells, similarity: float = SIMILARITY, local_points: int = LOCAL_POINTS, overlap: int = OVERLAP) -> DataFrame:
    """``vh``, ``label``, ``whole`` of every vector that belongs to a cluster.

    ``vectors``: vh (distinct), vec (packed), weight.  ``whole`` is false for vectors of a cluster in
    which some local part has a pair below the similarity.
    """

    def run(t: pa.Table) -> pa.Table:
        u = unit_rows(unpack_rows(t.column("vec").to_pylist(), cells.dim))
        weight, out, next_label = t.column("weight").to_numpy(), [[], [], [], []], 0
        for rows, _ in parts(u, overlap, overlap, CELL_ROWS):
            label, core, whole = local_clusters(u[rows], weight[rows], similarity, local_points)
            at = np.flatnonzero(label >= 0)
            for x, v in zip(out, (rows[at], label[at].astype(np.int64) + next_label, core[at], whole[at])):
                x.append(v)
            next_label += int(label.max()) + 1 if len(label) else 0
        at, part, core, whole = (np.concatenate(x) for x in out)
        base = int(t.column("cell")[0].as_py()) << 32
        return pa.table({"vh": t.column("vh").take(pa.array(at)), "part": pa.array(part + base), "core": pa.array(core), "whole": pa.array(whole)})

    placed = _cells(vectors, cells, overlap).repartition(partitions([cells], overlap, width(vectors.sparkSession)), "cell")
    local, _ = stage(placed.groupBy("cell").applyInArrow(run, "vh long, part long, core boolean, whole boolean"), "p1-local")
    # parts that share a core point: a vector has as many parts as it has cells
    parts_of = local.where("core").groupBy("vh").agg(F.min("part").alias("dst"), F.collect_set("part").alias("parts"))
    links = parts_of.where(F.size("parts") > 1).select("dst", F.explode("parts").alias("src")).where("src <> dst").distinct()
    merged = connected_components(links).select(F.col("node").alias("part"), "component")
    broken = local.groupBy("part").agg(F.bool_and("whole").alias("whole"))
    keyed = broken.join(merged, "part", "left").select("part", F.coalesce("component", "part").alias("label"), "whole")
    fine = keyed.groupBy("label").agg(F.bool_and("whole").alias("whole"))
    mapped = hot_join(local.select("vh", "part", "core"), keyed.select("part", "label"), "part")
    # a core point's parts all carry one label; a border point takes the smallest
    one = mapped.groupBy("vh").agg(F.coalesce(F.min(F.when(F.col("core"), F.col("label"))), F.min("label")).alias("label"))
    return hot_join(one, fine, "label")


def broken_labels(rows: DataFrame, dim: int, similarity: float = SIMILARITY, block_rows: int = 2000) -> DataFrame:
    """``label`` of the clusters (``label``, ``vh``, ``vec``) in which any two vectors are less similar.

    Parts of a cluster that share no cell are compared here.  A cluster of one block is compared in one task, a larger one block with block.
    """

    def low(left: pa.Table, right: pa.Table) -> bool:
        a, b = (unit_rows(unpack_rows(t.column("vec").to_pylist(), dim)).astype(np.float32) for t in (left, right))
        return any((a[s : s + 500] @ b.T < similarity - 1e-6).any() for s in range(0, len(a), 500))

    def answer(t: pa.Table, is_low: bool) -> pa.Table:
        return t.select(["label"]).slice(0, 1 if is_low else 0)

    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    small = hot_join(rows, sizes, "label")
    one = small.where(F.col("n") <= block_rows).select("label", "vec").groupBy("label").applyInArrow(lambda t: answer(t, low(t, t)), "label long")
    left, right = in_blocks(small.where(F.col("n") > block_rows).select("label", "vh", "vec"), "label", "vh", block_rows)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own
    many = left.groupBy("label", "meet").cogroup(right.groupBy("label", "meet")).applyInArrow(lambda a, b: answer(a, low(a, b)), "label long")
    return one.unionByName(many).distinct()


def image_clusters(images: DataFrame, id_col: str = "id", vec_col: str = "feature_vector", dim: int = 52, similarity: float = SIMILARITY, min_points: int = MIN_POINTS) -> DataFrame:
    """``image_id``, ``cluster_key``, ``vh`` (hash of its vector): one row per image in a cluster of ``min_points`` images or more.

    ``cluster_key`` is the smallest id of the cluster.  Null ids and unusable vectors are left
    out, an id written twice counts once, and an empty table gives an empty result.  Clusters
    with a pair below the similarity are no cluster of mutually similar images and give no row.
    """
    cells = fit_cells(images, id_col, vec_col, dim)
    if cells is None:
        return images.sparkSession.createDataFrame([], "image_id string, cluster_key string, vh long")
    flat, _ = stage(packed(images, id_col, {vec_col: dim}).select("id", "vh", "vec"), "p1-vectors")
    vectors, _ = stage(flat.groupBy("vh").agg(F.min("vec").alias("vec"), F.count("*").alias("weight")), "p1-directions")
    labels, _ = stage(cluster_labels(vectors, cells, similarity).where("whole").select("vh", "label"), "p1-labels")
    broken = broken_labels(labels.join(vectors, "vh").select("label", "vh", "vec"), dim, similarity)
    labels = labels.join(stage(broken, "p1-broken")[0], "label", "left_anti")
    members = hot_join(flat.select("id", "vh"), labels, "vh").select("id", "label", "vh").distinct()
    members, _ = stage(members, "p1-members")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("cluster_key")).where(F.col("n") >= min_points)
    return hot_join(members, sizes.select("label", "cluster_key"), "label").select(F.col("id").alias("image_id"), "cluster_key", "vh")


def describe(members: DataFrame, images: DataFrame, id_col: str = "id", vec_col: str = "feature_vector", dim: int = 52, typical: int = 5) -> DataFrame:
    """``cluster_key``, ``n_images``, ``images`` (the ``typical`` ids nearest the centroid, ties by id), ``centroid``.

    ``members``: image_id, cluster_key, vh.  Centroids are the mean of the members' unit vectors,
    summed within partitions first; the medoids are cut down within every partition before they
    are gathered, so a cluster of any size is never in one place.
    """
    flat = packed(images, id_col, {vec_col: dim}).select(F.col("vh"), "vec").groupBy("vh").agg(F.min("vec").alias("vec"))
    heads = members.groupBy("cluster_key", "vh").agg(F.min("image_id").alias("image_id"), F.count_distinct("image_id").alias("n"))
    rows, _ = stage(heads.join(flat, "vh").select("cluster_key", "image_id", "n", "vec"), "p1-describe")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(2).to_numpy().astype(float)
            u = unit_rows(unpack_rows(b.column(3).to_pylist(), dim)) * n[:, None]
            keys, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            total, count = np.zeros((len(keys), dim)), np.bincount(at, n, len(keys))
            np.add.at(total, at, u)
            yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.string()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count.astype(np.int64))], names=["cluster_key", "total", "n"])

    def mean(t: pa.Table) -> pa.Table:
        total = np.array(t.column("total").to_pylist()).sum(0)
        n = int(t.column("n").to_numpy().sum())
        return pa.table({"cluster_key": t.column("cluster_key").slice(0, 1), "n_images": pa.array([n]), "centroid": pa.array([(total / n).tolist()], pa.list_(pa.float32()))})

    sums = rows.mapInArrow(partial, "cluster_key string, total array<double>, n long")
    centres, _ = stage(sums.groupBy("cluster_key").applyInArrow(mean, "cluster_key string, n_images long, centroid array<float>"), "p1-centres")

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit_rows(unpack_rows(b.column(2).to_pylist(), dim))
                c = np.array(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round((u * c).sum(1), 9))], names=["cluster_key", "image_id", "near"])

    near = hot_join(rows, centres.select("cluster_key", "centroid"), "cluster_key").select("cluster_key", "image_id", "vec", "centroid")
    near = near.mapInArrow(closeness, "cluster_key string, image_id string, near double")
    w = Window.partitionBy("cluster_key").orderBy(F.col("near").desc(), "image_id")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    ids = best.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "image_id"))), lambda x: x.image_id).alias("images"))
    return centres.join(ids, "cluster_key").select("cluster_key", "n_images", "images", "centroid")
