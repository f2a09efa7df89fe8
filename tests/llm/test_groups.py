import random
from datetime import datetime

import pytest

from lumenfold.llm import components as CC
from lumenfold.llm import groups as G
from lumenfold.llm import history as H
from tests.conftest import FP_SCHEMA, fp_row

GROUPS = "group_id string, scan_id string, main_image string, duplicate_ids array<string>, reason string, confidence double, member string"


def union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(8)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)],
        "chain": [(i, i + 1) for i in rng.sample(range(120), 120)],
        "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(100, 130)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(edges + [(None, 1), (2, None), (3, 3)] + edges[:5], "src long, dst long").repartition(3)
    got = CC.connected_components(df).collect()
    assert {r.node: r.component for r in got} == union(edges) and len(got) == len({r.node for r in got})


def test_star_steps_do_the_work(spark):
    """One step of each kind as defined; a chain takes several rounds, and text nodes keep their own order."""
    edges = [(5, 1), (5, 3), (7, 5), (9, 5), (4, 2)]
    df = spark.createDataFrame(edges, "hi long, lo long")
    assert sorted(map(tuple, CC.large_star(df).collect())) == [(4, 2), (5, 1), (5, 3), (7, 1), (9, 1)]
    assert sorted(map(tuple, CC.small_star(df).collect())) == [(3, 1), (4, 2), (5, 1), (7, 5), (9, 5)]
    chain = spark.createDataFrame([(i + 1, i) for i in range(64)], "hi long, lo long").repartition(2)
    stars, _, rounds = CC.rewrite(chain)
    assert rounds > 3 and sorted(map(tuple, stars.collect())) == [(i, 0) for i in range(1, 65)]
    named = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("Z", "é"), ("é", "y")]
    got = {r.node: r.component for r in CC.connected_components(spark.createDataFrame(named, "src string, dst string")).collect()}
    assert got == union(named) and got["é"] == "Z"


def test_hot_nodes_are_joined_apart(spark, monkeypatch):
    from lumenfold import runtime

    calls = []
    real = runtime.hot_keys
    monkeypatch.setattr(runtime, "hot_keys", lambda df, key, least=5000: calls.append(1) or real(df, key, 10))
    monkeypatch.setattr(CC, "HOT_EDGES", 10)
    edges = [(i, 0) for i in range(1, 60)] + [(i, i - 1) for i in range(60, 90)]
    got = {r.node: r.component for r in CC.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert calls and got == union(edges)


def test_group_keys(spark):
    rows = [
        ("g1", "s", "IMG_A", ["img_b ", None, "", "img_a"], "near", 0.9, "x"),
        ("g1", "s", "IMG_A", ["img_b ", None, "", "img_a"], "near", 0.9, "x"),
        ("g2", "s", None, ["img_b", "img_c\n"], None, None, "x"),
        ("g3", "s", "img_d", None, "exact", 1.0, "x"),
        ("g4", "s", "  ", [], "exact", 1.0, "x"),
        (None, None, "img_e", ["img_f"], None, None, None),
    ]
    got = {r.image_id: r.group_key for r in G.consolidate(spark.createDataFrame(rows, GROUPS)).collect()}
    assert got == {"img_a": "img_a", "img_b": "img_a", "img_c": "img_a", "img_e": "img_e", "img_f": "img_e"}
    assert G.consolidate(spark.createDataFrame([], GROUPS)).count() == 0


def exif(camera=None, taken=None, lat=None, lon=None, flag=False):
    return (camera, None, None, None, None, None, taken, lat, lon, flag)


def test_survivors(spark):
    t = datetime(2020, 1, 1)
    fps = [
        fp_row("a", score=80.0, w=10, h=10, exif=exif("Unknown JPEG Camera"), created=t),
        fp_row("a", score=80.0, w=10, h=10, exif=exif("Unknown JPEG Camera"), created=datetime(2021, 1, 1)),
        fp_row("b", score=80.0, w=20, h=10, exif=None),
        fp_row("c", score=float("nan"), w=100, h=100, exif=exif("Cam", t, 10.0, 20.0, True)),
        fp_row("d", score=120.0, w=0, h=None, exif=exif("", None, 0.0, 20.0, True)),
        fp_row("e", score=50.0, w=10, h=10, exif=exif("Other", t, 91.0, 20.0, True)),
        fp_row("f", score=None, w=10, h=10, size=None, mtime=t),
    ]
    zero = list(fp_row("z", w=999, h=999))
    zero[3] = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 50.0)
    df = spark.createDataFrame(fps + [tuple(zero), fp_row(None)], FP_SCHEMA).withColumn("member", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    rows = [
        ("g1", "s", "A", ["b", "c", "d", "gone", None], "near", None, "x"),
        ("g2", "s", "gone", ["e"], "near", None, "x"),
        ("g3", "s", "d", ["z", "e"], "near", None, "x"),
        ("g4", "s", "f", ["f", " F "], "near", None, "x"),
        (None, "s", "a", ["b"], "near", None, "x"),
    ]
    groups = spark.createDataFrame(rows + rows[:1], GROUPS)
    got = {(r.group_id, r.field_name): r.image_id for r in G.survivors(groups, df).collect()}
    assert got == {("g1", "main_image"): "b", ("g1", "camera_model"): "c", ("g1", "taken_at"): "c", ("g1", "gps"): "c", ("g3", "main_image"): "e", ("g3", "camera_model"): "e", ("g3", "taken_at"): "e"}
    built = {r.group_id: r for r in G.surviving_records(groups, df).collect()}
    assert built["g1"].main_image == "b" and built["g1"].camera_model == "Cam" and built["g1"].width == 20 and built["g3"].gps_lat is None
    assert G.survivors(groups.limit(0), df).count() == 0 and G.survivors(groups, df.limit(0)).count() == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_batches_against_force(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)] + [2**64 - 1]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    sha = lambda i: f"{i:064x}"
    spell = lambda s: rng.choice([s, s.upper(), f" {s}\n", f"SHA256:{s}"])
    old = [(spell(sha(i)), signed(h)) for i, h in enumerate(base)] + [(None, None), ("abc", 0)]
    new = []
    for i in range(400):
        h = flip(rng.choice(base[:40]), rng.randint(0, 6)) if rng.random() < 0.7 else rng.getrandbits(64)
        s = spell(sha(rng.randrange(200) if rng.random() < 0.5 else 1000 + i))
        new.append((i, rng.randint(1, 5), rng.choice([s, s, s, None, s[:40]]), rng.choice([signed(h)] * 6 + [0, None]), "x", "y"))
    new += [(1000 + i, 2, sha(5000), signed(base[3]), "x", "y") for i in range(150)]  # one content, very often
    new += new[:20] + [(None, 1, sha(1), 5, "x", "y"), (2000, None, sha(1), 5, "x", "y")]
    arrivals = spark.createDataFrame(new, "arrival_id long, batch_no int, sha256 string, p_hash long, sha string, key string")
    accepted = spark.createDataFrame(old, "sha256 string, p_hash long")
    clean = lambda s: (x if s and len(x := s.strip().lower().removeprefix("sha256:").strip()) == 64 else None)
    seen = [(clean(s), h, -1) for s, h in old] + [(clean(s), h, b) for i, b, s, h, *_ in new if i is not None and b is not None]
    want = set()
    for i, b, s, h, *_ in new:
        if i is None or b is None:
            continue
        if clean(s) and any(x == clean(s) and y < b for x, _, y in seen):
            want.add((i, "exact"))
        elif h and any(x and y < b and ((x ^ h) & (2**64 - 1)).bit_count() <= 3 for _, x, y in seen):
            want.add((i, "near"))
    got = H.match_batches(arrivals, accepted).collect()
    assert {(r.arrival_id, r.kind) for r in got} == want and len(got) == len(want)
    assert H.match_batches(arrivals.limit(0), accepted).count() == 0
    assert H.match_batches(arrivals, accepted.limit(0)).count() < len(want)


def test_history_by_batches_and_compaction(spark):
    """Each batch finds what came before it, by force; merged and reopened runs give the same."""
    rng = random.Random(10)
    hashes = [signed(rng.getrandbits(64)) for _ in range(40)]
    index, before = H.HashHistory(spark, crowded=3), set()
    for b in range(5):
        batch = {h ^ (1 << rng.randrange(60)) for h in rng.sample(hashes, 10)} | set(hashes[b * 8 : b * 8 + 8])
        shas = {bytes([b, i % 3]) for i in range(6)} | {b"again"}
        found = index.take(spark.createDataFrame([(bytearray(x),) for x in shas], "sha binary"), spark.createDataFrame([(h,) for h in batch], "h long")).collect()
        near = {h for h in batch if any(((h ^ x) & (2**64 - 1)).bit_count() <= 3 for x in before)}
        assert {r.h for r in found if r.h is not None} == near and {r.h for r in found if r.h is not None and r.same} == near & before
        assert [bytes(r.sha) for r in found if r.sha is not None] == [b"again"] * (b > 0)
        before |= batch
    assert all(1 <= len(runs) <= 3 and sum(r["rows"] for r in runs) == n for runs, n in ((index.runs["hash"], len(before)), (index.runs["sha"], 16)))
    probe = spark.createDataFrame([(h,) for h in sorted(batch)], "h long"), spark.createDataFrame([(bytearray(b"again"),)], "sha binary")
    index.compact()
    assert [len(r) for r in index.runs.values()] == [1, 1]
    for runs in index.runs.values():
        spark.sql(f"DROP TABLE {runs[0]['name']}")  # as a new session has it
    again = H.HashHistory(spark, index.path)
    assert again.runs == index.runs and {r.h for r in again.match(probe[1], probe[0]).collect() if r.h is not None} == batch
    with pytest.raises(ValueError):
        index.match(probe[1], probe[0], 9)
    again.drop()


def test_crowded_windows_are_parted(spark):
    """Hashes that share whole blocks stay complete when their windows are parted, twice over."""
    rng = random.Random(11)
    base = signed(rng.getrandbits(64))
    hashes = sorted({base ^ rng.getrandbits(16) for _ in range(400)})
    index = H.HashHistory(spark, crowded=40)
    index.append(None, spark.createDataFrame([(h,) for h in hashes[::2]], "h long"))
    assert index.runs["hash"][0]["parted"]
    new = hashes[1::2]
    got = {r.h for r in index.match(spark.createDataFrame([], "sha binary"), spark.createDataFrame([(h,) for h in new], "h long")).collect()}
    assert got == {h for h in new if any(((h ^ x) & (2**64 - 1)).bit_count() <= 3 for x in hashes[::2])}
    index.drop()
