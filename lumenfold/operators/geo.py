"""Points near other points or inside regions, complete for any radius.

Voronoi cells around pivots; every site (a centre with a radius, or a region's ring with the circle around it)
is copied to each cell its circle can reach.  By the triangle inequality a point within ``r`` of a site
lies in a cell whose pivot is at most ``2 r`` farther from the site than the site's own pivot, so no
match is lost.  Each cell is then searched with a vantage-point tree over its points, using the
great-circle distance.  Crowded cells are cut by pivots of their own, to which the same inequality applies; only what no pivot
parts (points of one place) is dealt by hash, with its sites copied to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the sphere in metres.
EARTH_M = 6_371_008.8
#: Most pivots, points in one part of a cell, points in a leaf of the tree.
MAX_PIVOTS, PART_ROWS, LEAF = 256, 50_000, 256
#: Most pivots within crowded cells, all cells together.
MAX_INNER = 65_536
#: Slack in metres against rounding where cells and tree branches are left out.
SLACK_M = 0.01


def to_xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1)


def great_circle_m(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance along the sphere between unit vectors (last axis), exact for near and far points."""
    half = np.sqrt(((a - b) ** 2).sum(-1)) / 2
    return 2 * EARTH_M * np.arcsin(np.minimum(half, 1.0))


class VantageTree:
    """Vantage-point tree over unit vectors; radius queries return positions."""

    def __init__(self, xyz: np.ndarray, leaf: int = LEAF):
        self.xyz, self.leaf = xyz, leaf
        self.order = np.arange(len(xyz))
        #: (start, end, vantage point or -1, inner radius, outer radius, near child, far child)
        self.nodes: list[list] = []
        if len(xyz):
            self._build()

    def _build(self) -> None:
        todo = [(0, len(self.xyz), None, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][5 + side] = me
            part = self.order[start:end]
            node = [start, end, -1, 0.0, 0.0, -1, -1]
            self.nodes.append(node)
            if end - start <= self.leaf:
                continue
            vantage = part[(end - start) // 2]
            d = great_circle_m(self.xyz[part], self.xyz[vantage])
            mid = (end - start) // 2
            split = np.argpartition(d, mid)
            inner, outer = float(d[split[:mid]].max()), float(d[split[mid:]].min())
            if float(d.max()) == 0.0:
                continue  # all points alike: one leaf, however many
            self.order[start:end] = part[split]
            node[2:5] = [int(vantage), inner, outer]
            todo.append((start, start + mid, me, 0))
            todo.append((start + mid, end, me, 1))

    def within(self, q: np.ndarray, radius_m: float) -> np.ndarray:
        """Positions of all points at most ``radius_m`` from ``q`` (a unit vector)."""
        hits, todo = [], [0] if self.nodes else []
        while todo:
            start, end, vantage, inner, outer, near, far = self.nodes[todo.pop()]
            if vantage < 0:
                part = self.order[start:end]
                hits.append(part[great_circle_m(self.xyz[part], q) <= radius_m])
                continue
            d = float(great_circle_m(self.xyz[vantage], q))
            if d - radius_m <= inner + SLACK_M:
                todo.append(near)
            if d + radius_m >= outer - SLACK_M:
                todo.append(far)
        return np.concatenate(hits) if hits else np.array([], int)


def in_ring(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points a ring encloses; ``ring`` is (n, 2) of lat, lon.

    Edges are straight in latitude and longitude and go the shorter way round.  Counted are the
    edges crossed on the way north along the point's meridian; a ring that winds around the
    earth holds the pole that is nearer to its mean latitude.
    """
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    if len(ring) < 3:
        return np.zeros(len(lat), bool)
    la1, lo1 = ring[:, 0], ring[:, 1]
    la2, step = np.roll(la1, -1), (np.roll(lo1, -1) - lo1 + 180) % 360 - 180
    west = np.where(step >= 0, lo1, lo1 + step)
    wla, ela = np.where(step >= 0, la1, la2), np.where(step >= 0, la2, la1)
    span = np.abs(step)
    rel = (lon[:, None] - west[None, :]) % 360
    crosses = rel < span
    at = wla + (ela - wla) * rel / np.where(span == 0, 1, span)
    odd = ((crosses & (at > lat[:, None])).sum(1) % 2).astype(bool)
    winds = abs(step.sum()) > 180
    return ~odd if winds and la1.mean() >= 0 else odd


def ring_circle(ring: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre (unit vector) and radius in metres of a circle around the ring's whole area."""
    lo = ring[:, 1]
    step = (np.diff(np.r_[lo, lo[0]]) + 180) % 360 - 180
    if abs(step.sum()) > 180:  # winds around a pole: the cap down to its lowest latitude
        north = ring[:, 0].mean() >= 0
        low = ring[:, 0].min() if north else -ring[:, 0].max()
        return np.array([0, 0, 1.0 if north else -1.0]), float(np.radians(90 - low) * EARTH_M) + 1
    path = lo[0] + np.r_[0, np.cumsum(step[:-1])]
    lat0, lat1, lon0, lon1 = ring[:, 0].min(), ring[:, 0].max(), path.min(), path.max()
    c = to_xyz(np.array((lat0 + lat1) / 2), np.array((lon0 + lon1) / 2))
    # the area lies in the box; on each parallel the farthest point of the box is on its side, so its sides are walked
    la = np.linspace(lat0, lat1, 65)
    side = np.concatenate([to_xyz(la, np.full(65, lon0)), to_xyz(la, np.full(65, lon1))])
    gap = np.radians((lat1 - lat0) / 64) * EARTH_M  # between two samples of a side
    return c, float(great_circle_m(side, c).max()) + gap + 1


def has_position(lat: Column, lon: Column, flag: Column) -> Column:
    ok = flag & ~F.isnan(lat) & ~F.isnan(lon) & (lat != 0) & (lon != 0)
    return F.coalesce(ok & lat.between(-90, 90) & lon.between(-180, 360), F.lit(False))


def _pivot_points(points: DataFrame, want: int) -> np.ndarray:
    """A bounded sample of point positions by hash order, as unit vectors (about 1 km apart at least)."""
    h = F.xxhash64("key", "lat", "lon")
    thin = points.select(h.alias("h"), "lat", "lon").where(F.pmod("h", F.lit(64)) == 0)
    rows = thin.orderBy("h").limit(8 * want).collect() or points.select(h.alias("h"), "lat", "lon").orderBy("h").limit(8 * want).collect()
    if not rows:
        return np.zeros((0, 3))
    xyz = to_xyz(np.array([r.lat for r in rows]), np.array([r.lon for r in rows]))
    _, first = np.unique(np.round(xyz, 4), axis=0, return_index=True)
    return xyz[np.sort(first)][:want]


def _nearest(xyz: np.ndarray, piv: np.ndarray) -> np.ndarray:
    out = np.empty(len(xyz), np.int32)
    for s in range(0, len(xyz), 4096):
        out[s : s + 4096] = (xyz[s : s + 4096] @ piv.T).argmax(1)
    return out


def _inner_pivots(placed: DataFrame, crowded: dict[int, int], part_rows: int) -> dict[int, np.ndarray]:
    """Pivots within crowded cells (cell -> points), about one for ``part_rows`` points, from a bounded sample by hash order."""
    total = sum(crowded.values())
    if not total:
        return {}
    want = {c: -(-n // part_rows) for c, n in crowded.items()}
    scale = min(1.0, MAX_INNER / sum(want.values()))
    h = F.pmod(F.xxhash64("key", "lat", "lon", F.lit(5)), F.lit(1 << 30))
    draw = 8 * sum(want.values()) * scale
    rows = placed.where(F.col("cell").isin(list(crowded))).select("cell", "lat", "lon", h.alias("h")).where(F.col("h") < int((1 << 30) * min(1.0, draw / total)) + 1)
    out: dict[int, list] = {}
    for r in rows.orderBy("h").limit(int(2 * draw) + 64).collect():
        out.setdefault(r.cell, []).append((r.lat, r.lon))
    pivots = {}
    for c, at in out.items():
        xyz = to_xyz(*np.array(at).T)
        _, first = np.unique(np.round(xyz, 9), axis=0, return_index=True)
        pivots[c] = xyz[np.sort(first)][: max(1, int(want[c] * scale))]
    # a crowded cell of which nothing was drawn is dealt by hash around one pivot
    return pivots | {c: np.array([[1.0, 0.0, 0.0]]) for c in crowded if c not in pivots}


def near_or_inside(points: DataFrame, sites: DataFrame, max_pivots: int = MAX_PIVOTS, part_rows: int = PART_ROWS) -> DataFrame:
    """``key``, ``site``: every point within a circle site's radius or enclosed by a ring site.

    ``points``: key (string), lat, lon (double, usable); ``sites``: site (long), lat, lon, radius_m, ring
    (array<struct<lat, lon>>, null for circles).  Sites with null coordinates, a null or negative
    radius, or fewer than three ring corners match nothing; longitudes 360 apart are the same;
    repeated rows count once; an empty side gives an empty result.
    """
    piv = _pivot_points(points, max_pivots)
    if not len(piv):
        return points.sparkSession.createDataFrame([], "key string, site long")

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            la, lo = b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(to_xyz(la, lo), piv)), *b.columns], names=["cell", "key", "lat", "lon"])

    placed = points.select("key", "lat", "lon").mapInArrow(to_cell, "cell int, key string, lat double, lon double")
    # at most max_pivots rows: which cells are crowded
    counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    inner = _inner_pivots(placed, {c: n for c, n in counts.items() if n > part_rows}, part_rows)

    def to_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, part = b.column(0).to_numpy(), np.zeros(b.num_rows, np.int32)
            for c in np.intersect1d(cell, list(inner)):
                at = np.flatnonzero(cell == c)
                part[at] = _nearest(to_xyz(b.column(2).to_numpy()[at], b.column(3).to_numpy()[at]), inner[c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part), *b.columns[1:]], names=["cell", "part", "key", "lat", "lon"])

    #: (cell, part) -> in how many it is dealt
    dealt: dict[tuple[int, int], int] = {}
    if inner:
        placed = placed.mapInArrow(to_part, "cell int, part int, key string, lat double, lon double")
        # at most MAX_INNER rows
        dealt = {(r.cell, r.part): -(-r["count"] // part_rows) for r in placed.where(F.col("cell").isin(list(inner))).groupBy("cell", "part").count().where(F.col("count") > 4 * part_rows).collect()}
        if dealt:
            deal = points.sparkSession.createDataFrame([(c, p, n, len(inner[c])) for (c, p), n in dealt.items()], "cell int, part int, n int, step int")
            placed = placed.join(F.broadcast(deal), ["cell", "part"], "left")  # at most MAX_INNER rows
            more = F.coalesce(F.col("step") * F.pmod(F.xxhash64("key"), F.col("n")), F.lit(0)).cast("int")
            placed = placed.select("cell", (F.col("part") + more).alias("part"), "key", "lat", "lon")
    else:
        placed = placed.withColumn("part", F.lit(0))
    full = np.array([counts.get(i, 0) for i in range(len(piv))])

    kind = "cell int, part int, site long, lat double, lon double, radius_m double, ring array<struct<lat: double, lon: double>>"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for site, lat, lon, radius, ring in zip(*(c.to_pylist() for c in b.columns)):
                if ring is not None:
                    corners = np.array([[p["lat"], p["lon"]] for p in ring if p and p["lat"] is not None and p["lon"] is not None], float).reshape(-1, 2)
                    if len(corners) < 3 or not np.isfinite(corners).all():
                        continue
                    c, radius = ring_circle(corners)
                elif lat is None or lon is None or radius is None or not radius >= 0 or not np.isfinite([lat, lon, radius]).all():
                    continue
                else:
                    c = to_xyz(np.array(lat), np.array(lon))
                d = great_circle_m(piv, c)
                for cell in np.flatnonzero((d <= d.min() + 2 * radius + SLACK_M) & (full > 0)):
                    reached = np.zeros(1, int)
                    if cell in inner:
                        near = great_circle_m(inner[cell], c)
                        reached = np.flatnonzero(near <= near.min() + 2 * radius + SLACK_M)
                    for part in (p + len(inner.get(cell, ())) * k for p in reached for k in range(dealt.get((cell, p), 1))):
                        for x, v in zip(cols, (cell, part, site, np.degrees(np.arcsin(np.clip(c[2], -1, 1))) if ring is not None else lat, np.degrees(np.arctan2(c[1], c[0])) if ring is not None else lon, radius, ring)):
                            x.append(v)
            ring_type = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), ring_type]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["cell", "part", "site", "lat", "lon", "radius_m", "ring"])

    copied = sites.select("site", "lat", "lon", "radius_m", "ring").where("site is not null").mapInArrow(reach, kind)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, found = [], []
        if left.num_rows and right.num_rows:
            la, lo = left.column("lat").to_numpy(), left.column("lon").to_numpy()
            tree = VantageTree(to_xyz(la, lo))
            names = left.column("key")
            for site, lat, lon, radius, ring in zip(*(right.column(c).to_pylist() for c in ("site", "lat", "lon", "radius_m", "ring"))):
                at = tree.within(to_xyz(np.array(lat), np.array(lon)), radius)
                if ring is not None and len(at):
                    corners = np.array([[p["lat"], p["lon"]] for p in ring if p and p["lat"] is not None and p["lon"] is not None], float)
                    at = at[in_ring(la[at], lo[at], corners)]
                if len(at):
                    keys.append(names.take(pa.array(at)).combine_chunks())
                    found.append(np.full(len(at), site, np.int64))
        if not keys:
            return pa.table({"key": pa.array([], pa.string()), "site": pa.array([], pa.int64())})
        return pa.table({"key": pa.chunked_array(keys).cast(pa.string()), "site": pa.array(np.concatenate(found))})

    joined = placed.groupBy("cell", "part").cogroup(copied.groupBy("cell", "part")).applyInArrow(search, "key string, site long")
    return joined.distinct()
