import numpy as np
import pytest

from lumenfold.llm import clusters as C
from lumenfold.llm import neighbours as N
from lumenfold.llm import vectors as V

SCHEMA = "id string, vec array<float>, field string, cell int, vh long"


def unit(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    """Tight clusters, one of them a third of all rows, copies, scaled vectors, and unusable ones."""
    rng = np.random.default_rng(4)
    rows, dim = [], 52
    sizes = [400, 60, 30, 12, 7, 5, 5, 4, 3]
    for c, size in enumerate(sizes):
        centre = unit(rng, 1, dim)[0]
        for i in range(size):
            v = centre + rng.standard_normal(dim) * 0.035
            rows.append((f"c{c}_{i:03d}", (v * rng.choice([1, 8])).astype(np.float32)))
    rows += [(f"noise{i:04d}", v.astype(np.float32)) for i, v in enumerate(unit(rng, 500, dim))]
    rows += [(f"copy{i:03d}", np.full(dim, 0.25, np.float32) * np.where(np.arange(dim) % 3, 1, -1)) for i in range(200)]
    base = rows[-200 - 500][1]
    for i in range(30):  # near pairs of one vector
        rows.append((f"near{i:02d}", (base + rng.standard_normal(dim) * np.linalg.norm(base) * 0.01 * (i + 1) / 30).astype(np.float32)))
    table = [(i, v.tolist()) for i, v in rows]
    usable = dict(rows)
    bad = [("b1", None), ("b2", []), ("b3", [1.0] * 51), ("b4", [0.0] * 52), ("b5", [float("nan")] + [1.0] * 51), ("b6", [None] + [1.0] * 51), (None, [1.0] * 52), ("b7", [float("inf")] * 52)]
    full = [(*r, "x", 1, 2) for r in table + bad + table[:20]]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache(), usable


def pairs_by_force(usable, least, k):
    ids = sorted(usable)
    m = np.array([usable[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 10)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in np.flatnonzero(s[i] >= least) if j != i)[:k]
        out |= {(min(ids[i], x), max(ids[i], x)) for _, x in near}
    return out


def test_packing_is_lossless():
    m = np.array([[0.5, -1.25, 3.0], [1 / 3, 2e-30, 1e30], [float(np.float32(0.1)), 1.0, 2.0]])
    packed = V.pack_rows(m)
    assert [len(p) // 3 for p in packed] == [2, 8, 4]
    assert (V.unpack_rows(packed, 3) == m).all()


def test_pairs_of_nearest(data):
    df, usable = data
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, {"vec": 52}).collect()}
    want = pairs_by_force(usable, 0.985, 5)
    wrong = got - want
    assert len(got & want) >= 0.98 * len(want)
    # copies rank by id; rounding of equal cosines is the only room for difference
    assert len(wrong) <= 0.02 * len(want)


def test_clusters(data):
    df, usable = data
    members = C.image_clusters(df, vec_col="vec")
    got = {r.image_id: r.cluster_key for r in members.collect()}
    ids = sorted(usable)
    m = np.array([usable[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    adj = m @ m.T >= 0.83
    want = {}
    for i in range(len(ids)):
        row = np.flatnonzero(adj[i])
        if len(row) >= 5 and all((adj[j] == adj[i]).all() for j in row):
            want[ids[i]] = ids[row[0]]
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.98 * len(want)
    assert set(got) <= set(want)
    assert got["copy000"] == "copy000" == got["copy199"]
    heads = {r.cluster_key: r for r in C.describe(members, df, vec_col="vec").collect()}
    assert set(heads) == set(got.values())
    for key, r in heads.items():
        mine = [i for i, k in got.items() if k == key]
        u = np.array([usable[i] for i in mine], float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert r.n_images == len(mine) and np.allclose(r.centroid, u.mean(0), atol=1e-5)
        assert set(r.images) <= set(mine) and len(r.images) >= 1


def test_incomplete_clique_is_no_cluster():
    """A chain of five vectors whose ends are unlike."""
    a = np.zeros((5, 52))
    for i in range(5):
        a[i, 0], a[i, 1] = np.cos(i * 0.5), np.sin(i * 0.5)
    label, core, whole = C.local_clusters(a, np.ones(5), 0.83, 2)
    assert set(label) == {0} and core.all() and not whole.any()
    label, core, whole = C.local_clusters(np.repeat(a[:1], 5, 0), np.ones(5), 0.83, 5)
    assert set(label) == {0} and core.all() and whole.all()
    label, core, whole = C.local_clusters(a[:1], np.ones(1), 0.83, 2)
    assert label.tolist() == [-1] and not core.any()


def test_empty(data, spark):
    df, _ = data
    for none in (df.limit(0), df.where("id = 'b1'")):
        assert N.similar_pairs(none, {"vec": 52}).count() == 0
        assert C.image_clusters(none, vec_col="vec").count() == 0


def test_sparse_fields_keep_their_vectors(spark):
    rng = np.random.default_rng(11)
    near = unit(rng, 1, 8)[0] + rng.standard_normal((6, 8)) * 0.001
    rows = [(f"r{i:04d}", near[i // 500].tolist() if i % 500 == 0 else [None, [0.0] * 8, [float("nan")] * 8, [1.0] * 7, [1.0, None] * 4][i % 5]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    assert len(V.fit_cells(df, "id", "vec", 8)) == 1 and V.fit_cells(df.where("id like '%1'"), "id", "vec", 8) is None
    assert N.similar_pairs(df, {"vec": 8}).count() > 0
    assert {r.image_id for r in C.image_clusters(df, vec_col="vec", dim=8).collect()} == {f"r{i:04d}" for i in range(0, 3000, 500)}


def test_cells_of_two_levels_agree_with_flat_ones(monkeypatch):
    rng = np.random.default_rng(12)
    u = unit(rng, 40, 20)[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 20)) * 0.05
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    flat = V.Cells(u, 500)
    monkeypatch.setattr(V, "FLAT_PIVOTS", 100)
    deep = V.Cells(u, 500)
    assert deep.upper is not None and len(deep) == len(flat) == 500
    a, b = flat.nearest(u, 3), deep.nearest(u, 3)
    assert (a[:, 0] == b[:, 0]).mean() > 0.97 and (a == b).mean() > 0.95 and (b >= 0).all()


def test_crowded_cells_are_cut_again():
    rng = np.random.default_rng(13)
    u = unit(rng, 30, 16)[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)) * 0.02
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = V.parts(u, 3, 2, 100, 16, 500)
    assert len(got) > 5 and max(len(r) for r, _ in got) < 3000
    asks = np.zeros(3000, int)
    for rows, own in got:
        asks[rows[own]] += 1
    assert (asks >= 1).all()
    s = u @ u.T
    i, j = np.nonzero(np.triu(s >= 0.99, 1))
    met = set()
    for rows, own in got:
        inside = np.zeros(3000, bool)
        inside[rows] = True
        met |= set(np.flatnonzero(inside[i] & inside[j]).tolist())
    assert len(met) > 0.99 * len(i)
    alike = np.repeat(u[:1], 700, 0)
    assert len(V.parts(alike, 3, 2, 100, 16, 500)) == 1


def test_directions_are_collapsed():
    rng = np.random.default_rng(14)
    m = rng.standard_normal((50, 52)).astype(np.float32)
    n = V.direction_numbers(V.unit_rows(m.astype(float)))
    assert (n == V.direction_numbers(V.unit_rows((m * np.float32(3.7)).astype(float)))).mean() > 0.9 and len(set(n.tolist())) == 50


def test_clusters_are_compared_across_their_parts(spark):
    rng = np.random.default_rng(15)
    a, b = unit(rng, 2, 8)
    rows = [(1, i, a) for i in range(7)] + [(2, 10 + i, a) for i in range(3)] + [(2, 20, b)]
    df = spark.createDataFrame([(k, h, bytearray(v.astype(np.float64).tobytes())) for k, h, v in rows], "label long, vh long, vec binary")
    for block in (100, 2):
        assert [r.label for r in C.broken_labels(df, 8, 0.83, block).collect()] == [2]
