import numpy as np

from lumenfold.operators import geo as G

RING = "array<struct<lat:double,lon:double>>"
SITES = f"site long, lat double, lon double, radius_m double, ring {RING}, key string"


def test_tree_is_complete():
    rng = np.random.default_rng(1)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 5000))), rng.uniform(-180, 180, 5000)
    lat[:500], lon[:500] = 10.0, 20.0  # many alike
    xyz = G.to_xyz(lat, lon)
    tree = G.VantageTree(xyz, leaf=32)
    for q, r in [(xyz[i], r) for i in (0, 600, 4999) for r in (0.0, 1e3, 5e5, 5e6, 2.1e7)]:
        assert set(tree.within(q, r)) == set(np.flatnonzero(G.great_circle_m(xyz, q) <= r))
    assert len(G.VantageTree(np.zeros((0, 3))).within(xyz[0], 1e9)) == 0


def test_rings():
    square = np.array([[0, 0], [0, 10], [10, 10], [10, 0]], float)
    at = lambda ring, *p: G.in_ring(np.array([x[0] for x in p], float), np.array([x[1] for x in p], float), ring).tolist()
    assert at(square, (5, 5), (5, 15), (-1, 5), (5, 365)) == [True, False, False, True]
    assert at(square[::-1], (5, 5), (5, 15)) == [True, False]
    assert at(np.vstack([square, square[:1]]), (5, 5), (5, -1)) == [True, False]
    wrap = np.array([[-5, 175], [-5, -175], [5, -175], [5, 175]], float)
    assert at(wrap, (0, 179), (0, -179), (0, 181), (0, 170), (0, 0)) == [True, True, True, False, False]
    north = np.array([[80, 0], [80, 90], [80, 180], [80, -90]], float)
    assert at(north, (85, 33), (89.9, -120), (75, 33), (-85, 33)) == [True, True, False, False]
    south = np.array([[-80, 0], [-80, -90], [-80, 180], [-80, 90]], float)
    assert at(south, (-85, 33), (-75, 33), (85, 33)) == [True, False, False]
    concave = np.array([[0, 0], [0, 10], [10, 10], [2, 5], [10, 0]], float)
    assert at(concave, (1, 5), (5, 5), (5, 1.5)) == [True, False, True]
    for ring in (square, wrap, north, south, concave):
        c, r = G.ring_circle(ring)
        assert (G.great_circle_m(G.to_xyz(ring[:, 0], ring[:, 1]), c) <= r).all()


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 3000
    lat, lon = rng.uniform(-89, 89, n).round(4), rng.uniform(-180, 360, n).round(4)
    lat[:1000], lon[:1000] = 45.0 + rng.normal(0, 0.01, 1000), 7.0 + rng.normal(0, 0.01, 1000)  # a third in one cell
    points = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    sites = [(i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180)), float(10 ** rng.uniform(3, 6.5)), None, "x") for i in range(60)]
    sites += [(100, 45.0, 7.0, 1500.0, None, "x"), (101, 89.9, 0.0, 3e5, None, "x"), (102, None, 7.0, 1e5, None, "x"), (103, 45.0, 7.0, -1.0, None, "x"), (None, 45.0, 7.0, 1e6, None, "x")]
    sites += [(200, None, None, None, [(44.99, 6.99), (44.99, 7.01), (45.01, 7.01), (45.01, 6.99)], "x"), (201, None, None, None, [(1.0, 1.0)], "x"), (202, None, None, None, [], "x"), (203, None, None, None, [(80.0, 0.0), (80.0, 120.0), (80.0, -120.0)], "x")]
    p = spark.createDataFrame(points + points[:10], "key string, lat double, lon double")
    s = spark.createDataFrame(sites, SITES)
    got = {(r.key, r.site) for r in G.near_or_inside(p, s, max_pivots=16, part_rows=200).collect()}
    xyz, want = G.to_xyz(lat, lon), set()
    for site, a, b, r, ring, _ in sites:
        if site is None:
            continue
        if ring is not None:
            m = G.in_ring(lat, lon, np.array(ring, float).reshape(-1, 2))
        elif None in (a, b) or r < 0:
            continue
        else:
            m = G.great_circle_m(xyz, G.to_xyz(np.array(a), np.array(b))) <= r
        want |= {(f"p{i}", site) for i in np.flatnonzero(m)}
    assert got == want and len(want) > 2000
    assert G.near_or_inside(p.limit(0), s).count() == 0
    assert G.near_or_inside(p, s.limit(0)).count() == 0


def test_crowded_cells_are_cut_by_pivots_of_their_own(spark):
    """A third of all points in one town, a third in one place: sites reach few parts, and nothing is lost."""
    rng = np.random.default_rng(6)
    lat, lon = rng.uniform(-80, 80, 3000), rng.uniform(-180, 180, 3000)
    lat[:1000], lon[:1000] = 45.0 + rng.normal(0, 0.5, 1000), 7.0 + rng.normal(0, 0.5, 1000)
    lat[1000:2000], lon[1000:2000] = -33.0, 151.0
    p = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "key string, lat double, lon double")
    sites = [(i, float(lat[k]), float(lon[k]), float(10 ** rng.uniform(2, 6)), None, "x") for i, k in enumerate(rng.integers(0, 3000, 50))]
    got = {(r.key, r.site) for r in G.near_or_inside(p, spark.createDataFrame(sites, SITES), 4, 100).collect()}
    xyz = G.to_xyz(lat, lon)
    want = {(f"p{i}", s[0]) for s in sites for i in np.flatnonzero(G.great_circle_m(xyz, G.to_xyz(np.array(s[1]), np.array(s[2]))) <= s[3])}
    assert got == want
