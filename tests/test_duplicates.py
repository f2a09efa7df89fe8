import random
from itertools import combinations

import pytest
from tests.conftest import FP_SCHEMA, fp_row
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import cleanup as CL
from lumenfold.operators import clustering as K
from lumenfold.operators import duplicates as D
from lumenfold.operators import reports as R
from lumenfold.schema import Policy

W = S.DEFAULT_WEIGHTS


def similarity(a, b):
    total = by = 0.0
    for (name, w), x, y in zip(W.items(), a, b):
        if x and y:
            total += w * S.transfer_value(name, ((x ^ y) & (2**64 - 1)).bit_count())
            by += w
    return min(1.0, max(0.0, total / by)) if by else 0.0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    rows, base = {}, []
    for i in range(220):
        if base and rng.random() < 0.6:
            h = [x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 3, 5, 8]))) for x in rng.choice(base)]
        else:
            h = [rng.getrandbits(64) for _ in range(4)]
            base.append(h)
        h = [0 if rng.random() < 0.12 else x for x in h]
        rows[f"img_{rng.getrandbits(40):010x}"] = tuple(signed(x) for x in h)
    return rows


@pytest.fixture(scope="module")
def frame(spark, records):
    rng = random.Random(6)
    shas = [f"{i:064x}" for i in range(60)]
    data = [fp_row(i, rng.choice([*shas, None]), tuple(x if x or rng.random() < 0.5 else None for x in h), rng.choice([10.0, 55.0, 90.0, float("nan"), None]), size=rng.choice([100, 5_000_000, None])) for i, h in records.items()]
    return spark.createDataFrame(data, FP_SCHEMA).cache()


@pytest.mark.parametrize("threshold", [0.7, 0.9, 0.95])
def test_near_pairs_complete(frame, records, threshold):
    rep = {}
    for i in sorted(records):
        rep.setdefault(records[i], i)
    reps = sorted(i for h, i in rep.items() if any(h))
    want = {(a, b) for a, b in combinations(reps, 2) if similarity(records[a], records[b]) >= threshold}
    got = D.near_pairs(frame, threshold).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    for r in got[:50]:
        assert r.similarity == pytest.approx(similarity(records[r.id_a], records[r.id_b]))


def greedy(records, t):
    lead, out = [], {}
    for i in sorted(records):
        to = next((x for x in lead if similarity(records[x], records[i]) >= t), None)
        if to is None:
            lead.append(i)
        out[i] = to or i
    sizes = {}
    for x in out.values():
        sizes[x] = sizes.get(x, 0) + 1
    return {i: x for i, x in out.items() if sizes[x] > 1}


def test_leader_groups_match_the_sequential_loop(frame, records):
    want = greedy(records, 0.9)
    groups = D.near_groups(frame, 0.9)
    assert {r.id: r.leader for r in groups.collect()} == want
    conf = {r.leader: r.confidence for r in D.group_confidence(groups, frame).collect()}
    for x in set(want.values()):
        m = sorted(i for i, y in want.items() if y == x)
        assert conf[x] == pytest.approx(sum(similarity(records[a], records[b]) for a, b in combinations(m, 2)) / (len(m) * (len(m) - 1) / 2))
    last = {r.leader: r for r in D.leader_similarity(groups, frame).collect()}
    for x in set(want.values()):
        m = max(i for i, y in want.items() if y == x and i != x)
        assert last[x].confidence == pytest.approx(similarity(records[x], records[m]))


@pytest.mark.parametrize("range_edges", [200_000, 60])
def test_leaders_of_a_long_chain(spark, range_edges):
    ids = [f"{i:05d}" for i in range(451)]
    pairs = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "id_a string, id_b string")
    want = {a: ids[i - i % 2] for i, a in enumerate(ids)}
    assert {r.id: r.leader for r in D.leaders(pairs, range_edges=range_edges).collect()} == want


def test_exact_groups_and_policies(frame):
    members = {}
    rows = {r.id: r for r in frame.collect()}
    for r in rows.values():
        if r.metadata.sha256:
            members.setdefault(r.metadata.sha256, []).append(r.id)
    members = {k: sorted(v) for k, v in members.items() if len(v) > 1}
    got = {r.sha: r for r in D.exact_groups(frame).collect()}
    assert set(got) == set(members)
    good = lambda i: (s if (s := rows[i].quality.final_score) is not None and s == s else -1)
    for sha, ids in members.items():
        assert got[sha].main_image == min(ids, key=lambda i: (-good(i), i)) and got[sha].n_members == len(ids)
    assert [got[s].group_id for s in sorted(got, key=lambda s: members[s][0])] == [f"exact_{i}" for i in range(1, len(got) + 1)]
    assert D.best_of_group(D.exact_members(frame), "sha", Policy.NEWEST).count() == len(members)


def test_empty_and_degenerate(spark, frame):
    none = frame.limit(0)
    assert D.near_pairs(none, 0.9).count() == 0 and D.exact_groups(none).count() == 0 and D.near_groups(none, 0.9).count() == 0
    flat = spark.createDataFrame([fp_row("a"), fp_row("b", hashes=(None, None, None, None)), fp_row("c", hashes=(5, 0, 0, 0)), fp_row("d", hashes=(5, 0, 0, 0))], FP_SCHEMA)
    assert {(r.id, r.leader) for r in D.near_groups(flat, 0.9).collect()} == {("c", "c"), ("d", "c")}


def test_dbscan(frame, records):
    pairs = D.near_pairs(frame, 0.9)
    near = {}
    for r in pairs.collect():
        near.setdefault(r.id_a, set()).add(r.id_b)
        near.setdefault(r.id_b, set()).add(r.id_a)
    core = {i for i, x in near.items() if len(x) + 1 >= 3}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += [y for y in near[x] if y in core]
    want = dict(label)
    for i in set(near) - core:
        if c := [label[y] for y in near[i] if y in core]:
            want[i] = min(c)
    assert {r.id: r.cluster for r in K.dbscan(frame.select("id"), pairs, 3).collect()} == want
    groups = {r.id: r.cluster for r in K.agglomerative(frame, pairs, 0.9).collect()}
    assert set(groups) == set(near)


def test_dbscan_counts_and_returns_copies(spark, frame, records):
    flip = lambda h, n: (h ^ ((1 << n) - 1), 0, 0, 0)
    a, b, c = 0x0123456789ABCDEF, 0x7777000011112222, 0x0F0F5A5A3C3C6699
    rows = [(f"a{i}", (a, 0, 0, 0)) for i in range(4)] + [("b0", (b, 0, 0, 0)), ("b1", (b, 0, 0, 0)), ("b2", flip(b, 2)), ("c0", (c, 0, 0, 0)), ("c1", (c, 0, 0, 0)), ("n0", (0, 0, 0, 0))]
    df = spark.createDataFrame([fp_row(i, hashes=h) for i, h in rows], FP_SCHEMA)
    got = {r.id: (r.cluster, r.core) for r in K.dbscan_images(df, 0.9, 3).collect()}
    assert got == {**{f"a{i}": ("a0", True) for i in range(4)}, **{i: ("b0", True) for i in ("b0", "b1", "b2")}}
    # against the definition over all records
    near = {i: {j for j in records if i == j or similarity(records[i], records[j]) >= 0.9} for i in records}
    core = {i for i in near if len(near[i]) >= 3}
    label = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x] & core
    want = {i: (x, True) for i, x in label.items()} | {i: (min(label[j] for j in near[i] & core), False) for i in near if i not in core and near[i] & core}
    assert {r.id: (r.cluster, r.core) for r in K.dbscan_images(frame, 0.9, 3).collect()} == want


@pytest.mark.parametrize("most", [5000, 2])
def test_average_linkage_over_all_records(frame, records, most):
    ids = sorted(i for i, h in records.items() if any(h))
    sim = K.np.array([[1.0 if records[a] == records[b] else similarity(records[a], records[b]) for b in ids] for a in ids])
    label = K.average_linkage(sim, 0.9 - 1e-12)
    linked = {a for i, a in enumerate(ids) for j in range(len(ids)) if i != j and sim[i, j] >= 0.9}
    want = {a: ids[label[i]] for i, a in enumerate(ids) if a in linked}
    assert {r.id: r.cluster for r in K.agglomerative_images(frame, 0.9, most=most).collect()} == want


def test_medoids_that_do_not_settle_are_no_result(spark):
    df = spark.createDataFrame([(f"p{i:02d}", [float(i)]) for i in range(20)], "id string, v array<double>")
    with pytest.raises(RuntimeError):
        K.k_medoids(df, 2, S.euclidean, max_rounds=1)


def test_k_medoids(spark):
    pts = [(f"p{i:02d}", [float(i % 2 * 10 + i / 100)]) for i in range(20)]
    df = spark.createDataFrame(pts, "id string, v array<double>")
    got = {r.id: r.cluster for r in K.k_medoids(df, 2, S.euclidean).collect()}
    assert {got[f"p{i:02d}"] for i in range(0, 20, 2)} == {0} and {got[f"p{i:02d}"] for i in range(1, 20, 2)} == {1}


def test_clean_plan_and_reports(spark, frame, tmp_path):
    o = CL.CleanOptions(threshold=0.9, min_quality=50.0, output=str(tmp_path / "out"))
    plan = CL.clean_plan(frame, o)
    rows = plan.collect()
    assert len({r.id for r in rows}) == len(rows) and len({r.dst for r in rows}) == len(rows)
    scores = {r.id: r.quality.final_score for r in frame.collect()}
    assert all(r.reason == "exact" or (scores[r.id] or 0) >= 50 for r in rows)
    report = R.build(frame, D.exact_groups(frame), D.near_group_records(frame, 0.9))
    assert report["processed_images"] == 220 and report["exact_duplicate_count"] > 0 and sum(report["statistics"]["quality_distribution"].values()) == 220
    for kind in R.FORMATS:
        assert open(R.write(report, str(tmp_path / f"r_{kind}"), kind)).read()
    assert "more groups" in R.to_text(R.build(frame, D.exact_groups(frame), D.near_group_records(frame, 0.9), shown=1))
    with pytest.raises(ValueError):
        R.write(report, "x", "pdf")


def test_same_names_are_numbered(spark):
    rows = spark.createDataFrame([("a", "g", "/x/p.jpg"), ("b", "g", "/y/p.jpg"), ("c", "g", "/z/p.jpg"), ("d", "h", "/z/p.jpg")], "id string, group_id string, src string")
    got = {r.id: r.dst for r in CL.with_destinations(rows, CL.CleanOptions(output="o")).collect()}
    assert got == {"a": "o/g/p.jpg", "b": "o/g/p_1.jpg", "c": "o/g/p_2.jpg", "d": "o/h/p.jpg"}


def test_apply_plan(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.jpg").write_text(n)
    rows = [(n, str(tmp_path / f"{n}.jpg"), str(tmp_path / "out" / f"{n}.jpg"), "g", 1, "move") for n in "abz"]
    plan = spark.createDataFrame(rows, "id string, src string, dst string, group_id string, size_bytes long, action string")
    assert not any(r.done for r in CL.apply_plan(plan, dry_run=True).collect()) and not (tmp_path / "out").exists()
    result = CL.apply_plan(plan, dry_run=False).cache()
    got = {r.id: r for r in result.collect()}
    assert got["a"].done and got["b"].done and not got["z"].done and "no such file" in got["z"].error
    report = CL.clean_report(plan, result).first()
    assert (report.total_processed, report.moved_files, report.freed_space_bytes, report.errors) == (1, 2, 2, 1)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert CL.remove_empty_dirs(str(tmp_path)) == 2
    assert CL.safe_copy(str(tmp_path / "out" / "a.jpg"), str(tmp_path / "out" / "b.jpg")).endswith("b_1.jpg")


def test_byte_verification(spark):
    files = spark.createDataFrame([("p", b"x"), ("q", b"x"), ("r", b"y")], "path string, content binary")
    groups = spark.createDataFrame([("s1", "p"), ("s1", "q"), ("s2", "p"), ("s2", "r"), ("s3", "p"), ("s3", "gone")], "sha string, path string")
    assert {r.sha: r.same for r in D.byte_verified(groups, files).collect()} == {"s1": True, "s2": False, "s3": False}


def test_human_bytes(spark):
    got = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 40,)], "n long").select(S.human_bytes(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 TB"]
