"""Problem 5: most similar vectors for every vector, by collision-counting hashing.

Query-aware collision counting (C2LSH, QALSH): every vector is projected on ``PROJECTIONS`` random
directions, each with a sorted array of its own; a pair collides in a projection when it falls into the window of the sorted array that is
centred on the query; pairs that collide in at least ``THRESHOLD`` of the projections are verified by their exact cosine.
Windows widen by virtual rehashing (doubled reach) until a query has its ``k`` neighbours or the reach covers the radius of
the smallest similarity asked for.  Windows are found in the sorted arrays by binary search; as they hold a good part of a cell in the end,
collisions are counted by comparing ranks with the windows' ends, for many queries at once.

Sorted arrays over the whole collection would give every window a fixed share of all rows, so the
arrays are kept per cell (nearest pivots, overlapping), which bounds a window by the cell; crowded cells are
cut again.  Copies of one direction are collapsed before and expanded after the search: only each copy group's ``k + 2``
smallest ids can be among anyone's ``k`` nearest, and these travel with the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.vectors import Cells, fit_cells, packed, partitions, parts, unit_rows, unpack_rows
from lumenfold.runtime import hot_join, stage, width

PROJECTIONS, THRESHOLD = 16, 13
#: Half a window, in standard deviations of a projected pair at the radius; shares of it that are tried one after the other.
REACH_SD, REACHES = 2.0, (0.25, 0.5, 1.0)
#: Cells a vector lies in, cells it asks in, and rows aimed at in a cell.
OVERLAP, ASKS, CELL_ROWS = 3, 3, 300
#: Queries whose collisions are counted at once.
BLOCK = 128


def cell_pairs(u: np.ndarray, least: float, k: int, copies: np.ndarray, asks: np.ndarray | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine) of verified pairs in one cell; every row that asks is a query once.

    ``copies``: ids a row stands for.  A query stops widening when rows standing for ``k`` other ids are
    verified within the reach; no partner is dropped at the reach that is asked last.
    """
    n = len(u)
    radius = float(np.sqrt(2 - 2 * least))
    a = np.random.default_rng(seed).standard_normal((u.shape[1], PROJECTIONS))
    h = (u - u.mean(0)) @ a
    order = np.argsort(h[:, 0], kind="stable")  # rows in the order of the first array, so that a block of queries has its windows near each other
    h, x, weight = h[order], u[order], copies[order]
    arrays = np.sort(h, axis=0)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    rank = np.empty((PROJECTIONS, n), kind)
    for p in range(PROJECTIONS):
        rank[p, np.argsort(h[:, p], kind="stable")] = np.arange(n)
    out_q, out_o, out_s = [], [], []
    active = np.arange(n) if asks is None else np.flatnonzero(asks[order])
    for reach in REACHES:
        if not len(active):
            break
        final, half = reach == REACHES[-1], REACH_SD * radius * reach
        limit = 1 - (radius * reach) ** 2 / 2
        first = np.stack([np.searchsorted(arrays[:, p], h[active, p] - half, "left") for p in range(PROJECTIONS)]).astype(kind)
        last = np.stack([np.searchsorted(arrays[:, p], h[active, p] + half, "right") for p in range(PROJECTIONS)]).astype(kind)
        span = last - first
        # half as wide again in the first array, lest a pair be lost that misses this one window but few others
        begin = np.searchsorted(arrays[:, 0], h[active, 0] - 1.5 * half, "left")
        end = np.searchsorted(arrays[:, 0], h[active, 0] + 1.5 * half, "right")
        keep = []
        for s in range(0, len(active), BLOCK):
            q = active[s : s + BLOCK]
            lo, hi = int(begin[s]), int(end[s + len(q) - 1])
            count = np.zeros((len(q), hi - lo), np.uint8)
            apart, inside = np.empty(count.shape, kind), np.empty(count.shape, bool)
            for p in range(PROJECTIONS):
                # a rank before the window wraps round and is far behind it
                np.subtract(rank[p, None, lo:hi], first[p, s : s + BLOCK, None], out=apart)
                np.less(apart, span[p, s : s + BLOCK, None], out=inside)
                count += inside.view(np.uint8)
            qi, oi = np.nonzero(count >= THRESHOLD)
            oi = oi + lo
            other = q[qi] != oi
            qi, oi = qi[other], oi[other]
            sim = np.einsum("ij,ij->i", x[q[qi]], x[oi])
            ok = sim >= (least if final else max(least, limit))
            qi, oi, sim = qi[ok], oi[ok], sim[ok]
            if not final:
                have = np.bincount(qi, weight[oi], minlength=len(q)) + weight[q] - 1
                settled = have >= k
                keep.append(q[~settled])
                m = settled[qi]
                qi, oi, sim = qi[m], oi[m], sim[m]
            out_q.append(q[qi])
            out_o.append(oi)
            out_s.append(sim)
        active = np.concatenate(keep) if keep else np.array([], int)
    if not out_q:
        return np.array([], int), np.array([], int), np.array([])
    return order[np.concatenate(out_q)], order[np.concatenate(out_o)], np.concatenate(out_s)


def _cells(rows: DataFrame, cells: dict[int, Cells], overlap: int, asks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).to_numpy()
            for field, c in cells.items():
                at = np.flatnonzero(fields == field)
                if not len(at):
                    continue
                part = b.take(pa.array(at))
                near = c.nearest(unit_rows(unpack_rows(part.column(2).to_pylist(), c.dim)), overlap)
                for j in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, j]), pa.array(np.full(len(at), j < asks)), *part.columns], names=["cell", "asks", "field", "vh", "vec", "ids"])

    return rows.select("field", "vh", "vec", "ids").mapInArrow(run, "cell int, asks boolean, field int, vh long, vec binary, ids array<string>")


def similar_pairs(images: DataFrame, fields: dict[str, int], id_col: str = "id", least: float = 0.985, k: int = 5, overlap: int = OVERLAP) -> DataFrame:
    """``vector_field``, ``id_a``, ``id_b``: pairs with cosine >= ``least`` where one is among the other's ``k`` nearest.

    Equal cosines (to 10 digits) are ordered by id.  Null ids and unusable vectors are left out;
    an id written twice counts once; empty tables give an empty result.
    """
    names = list(fields)
    cells = {no: fit_cells(images, id_col, f, fields[f], CELL_ROWS, fields[f]) for no, f in enumerate(names)}
    cells = {no: c for no, c in cells.items() if c is not None}
    spark = images.sparkSession
    if not cells:
        return spark.createDataFrame([], "vector_field string, id_a string, id_b string")
    top = k + 2

    flat = packed(images, id_col, fields)
    # the window keeps at most top ids a vector on the map side, however many copies there are
    w = Window.partitionBy("field", "vh").orderBy("id")
    few = flat.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= top)
    vectors = few.groupBy("field", "vh").agg(F.min("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))
    dims = {no: c.dim for no, c in cells.items()}

    def search(t: pa.Table) -> pa.Table:
        field = t.column("field")[0].as_py()
        u = unit_rows(unpack_rows(t.column("vec").to_pylist(), dims[field]))
        ids = t.column("ids").to_pylist()
        copies = np.fromiter(map(len, ids), int, len(ids))
        asking = t.column("asks").to_numpy(zero_copy_only=False)
        got = [[], [], []]
        for rows, own in parts(u, overlap, ASKS, CELL_ROWS, u.shape[1]):
            a, b, c = cell_pairs(u[rows], least, k, copies[rows], own & asking[rows])
            for x, v in zip(got, (rows[a], rows[b], np.round(c, 10))):
                x.append(v)
        q, o, s = (np.concatenate(x) for x in got)
        if len(u) and len(got[0]) > 1:  # parts overlap
            _, once = np.unique(q.astype(np.int64) * len(u) + o, return_index=True)
            q, o, s = q[once], o[once], s[once]
        vh = t.column("vh").to_numpy()
        out_vh, out_id, out_sim, out_own = [], [], [], []
        by = np.argsort(q, kind="stable")
        q, o, s = q[by], o[by], s[by]
        ends = np.searchsorted(q, np.arange(len(u) + 1))
        for i in np.flatnonzero(((np.diff(ends) > 0) | (copies > 1)) & asking):
            a, z = ends[i], ends[i + 1]
            near = [(-1.0, x) for x in ids[i]]
            if copies[i] <= k:
                other = sorted((-s[j], x) for j in range(a, z) for x in ids[o[j]])
                out_own += [False] * len(other[: k + 1])
                out_id += [x for _, x in other[: k + 1]]
                out_sim += [-c for c, _ in other[: k + 1]]
                out_vh += [vh[i]] * len(other[: k + 1])
            else:
                # others of cosine 1 to ten digits (scaled copies) compete with the own copies by id
                other = sorted((-s[j], x) for j in range(a, z) if s[j] >= 1.0 for x in ids[o[j]])[: k + 1]
                out_own += [False] * len(other)
                out_id += [x for _, x in other]
                out_sim += [-c for c, _ in other]
                out_vh += [vh[i]] * len(other)
            out_own += [True] * len(near)
            out_id += [x for _, x in near]
            out_sim += [1.0] * len(near)
            out_vh += [vh[i]] * len(near)
        return pa.table(
            {"field": pa.array(np.full(len(out_vh), field, np.int32)), "vh": pa.array(out_vh, pa.int64()), "id": pa.array(out_id, pa.string()), "sim": pa.array(out_sim, pa.float64()), "own": pa.array(out_own, pa.bool_())}
        )

    n = partitions(list(cells.values()), overlap, width(spark))
    found = _cells(vectors, cells, overlap, ASKS).repartition(n, "field", "cell").groupBy("field", "cell").applyInArrow(search, "field int, vh long, id string, sim double, own boolean")
    found, _ = stage(found.distinct(), "p5-found")
    # nearest k + 1 ids of a vector, its own included: whichever member asks, k others remain
    wn = Window.partitionBy("field", "vh").orderBy(F.col("sim").desc(), "id")
    best = found.withColumn("r", F.row_number().over(wn)).where(F.col("r") <= k + 1)
    near = best.groupBy("field", "vh").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("near"))
    own = found.where("own").groupBy("field", "vh").agg(F.collect_set("id").alias("ids")).withColumn("n", F.size("ids"))
    lists = near.join(own, ["field", "vh"])
    few_copies = lists.where(F.col("n") < top).select("field", F.explode("ids").alias("me"), "near")
    many = lists.where(F.col("n") >= top).select(F.xxhash64("field", "vh").alias("key"), F.col("field").alias("f"), F.col("vh").alias("v"), "near")
    # copy groups beyond the ids that travelled: their members are read again
    codes = many.limit(1).count()
    members = few_copies
    if codes:
        again = packed(images, id_col, fields).select("field", "id", "vh", F.xxhash64("field", "vh").alias("key"))
        found_again = hot_join(again, many, "key").where((F.col("field") == F.col("f")) & (F.col("vh") == F.col("v")))
        members = members.unionByName(found_again.select("field", F.col("id").alias("me"), "near"))
    others = F.slice(F.filter("near", lambda x: x.id != F.col("me")), 1, k)
    pairs = members.select("field", "me", F.explode(others).alias("x")).select("field", F.least("me", "x.id").alias("id_a"), F.greatest("me", "x.id").alias("id_b")).distinct()
    label = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("field") + 1)
    return pairs.select(label.alias("vector_field"), "id_a", "id_b")
