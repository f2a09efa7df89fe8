import json
import math
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import api, cli, progress
from lumenfold import config as C
from lumenfold.functions import grids as G
from lumenfold.functions import pixels as P
from lumenfold.functions import scalars as S
from lumenfold.operators import lsh
from lumenfold.schema import ENGINE_FORMATS, ImageTooSmall, NotFound
from lumenfold.sources import exif as X
from lumenfold.sources import files as FS
from lumenfold.sources.store import FingerprintStore, QueryOptions, find_similar_hashes
from lumenfold.streaming.incremental import watch
from tests.conftest import FP_SCHEMA, fp_row, gradient, png


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    g = gradient(160, 120)
    png(d / "a.png", g)
    png(d / "sub" / "copy.PNG", g)
    png(d / "small.png", P.resize(g, 80, 60))
    png(d / "noisy.png", np.clip(g.astype(int) + rng.integers(-3, 4, g.shape), 0, 255))
    png(d / "check.png", np.where((np.indices((64, 64)).sum(0) // 8 % 2)[..., None], 255, 0).repeat(3, 2))
    png(d / "thumbs" / "t.png", g)
    (d / "bad.png").write_text("fake image data")
    (d / "notes.txt").write_text("text")
    return str(d)


def test_scan(spark, folder):
    names = {r.path.rsplit("/", 1)[1] for r in FS.scan_folder(spark, folder, content=False).collect()}
    assert names == {"a.png", "copy.PNG", "small.png", "noisy.png", "check.png", "t.png", "bad.png"}
    kept = FS.scan_folder(spark, folder, FS.FileFilter((".png",), (), 200, 10**9, FS.EXCLUDED_DIRS)).collect()
    assert {r.path.rsplit("/", 1)[1] for r in kept} == {"a.png", "copy.PNG", "small.png", "noisy.png", "check.png"} and {r.format for r in kept} == {"png"}
    heads = {r.path.rsplit("/", 1)[1]: (r.decoded_format, r.width, r.height) for r in FS.with_header_size(FS.scan_folder(spark, folder)).collect()}
    assert heads["a.png"] == ("png", 160, 120) and heads["bad.png"] == (None, None, None)


def test_engine_end_to_end(spark, folder, tmp_path, capsys):
    cfg = C.EngineConfig.high_performance()
    cfg.index_path = f"file://{tmp_path}/index"
    e = api.Engine(spark, cfg)
    done = e.scan(folder)
    assert done["total_files"] == 7 and done["processed_images"] == 6
    assert e.scan(folder)["processed_images"] == 6  # again: replaced, not added
    assert e.exact_duplicates().first().n_members == 3
    near = e.near_duplicates(0.9).collect()
    assert any(r.n_members >= 5 for r in near)
    row = e.store.all().where("metadata.path like '%check.png'").first()
    assert e.rate(row.id)["sharpness"] > 0.3 and len(row.feature_vector) == 52 and len(row.color_histogram) == 48
    assert math.isclose(sum(row.color_histogram), 3.0)
    assert e.stats().first().total_images == 6 and e.stats().first().index_size_bytes > 0
    for args in (["stats"], ["find-duplicates"], ["clean"], ["cluster"], ["quality", row.id], ["export", str(tmp_path / "r"), "--format", "html"], ["scan", folder]):
        assert cli.main(["--index", cfg.index_path, *args], spark) == 0
    assert "total_images" in capsys.readouterr().out and (tmp_path / "r.html").exists()
    assert api.find_duplicates_quick(spark, folder).count() >= 1
    assert api.analyze_image_quality(spark, folder + "/check.png")["contrast"] == 1.0


def test_store(spark, tmp_path):
    st = FingerprintStore(spark, f"file://{tmp_path}/s")
    assert st.all().count() == 0
    t = datetime(2020, 1, 1)
    st.save(spark.createDataFrame([fp_row("a", "x", (5, 0, 0, 0), 10.0, created=t), fp_row("b", "x", (7, 0, 0, 0), 90.0, created=t)], FP_SCHEMA))
    st.save(spark.createDataFrame([fp_row("a", "y", (4, 0, 0, 0), 20.0, created=datetime(2021, 1, 1)), fp_row("a", "old", created=t), fp_row("c", score=float("nan"), created=t)], FP_SCHEMA))
    assert {r.id: r.metadata.sha256 for r in st.all().collect()} == {"a": "y", "b": "x", "c": None}
    assert st.get("a").quality.final_score == 20.0
    with pytest.raises(NotFound):
        st.get("zz")
    assert [r.id for r in st.query(QueryOptions(sort_by="quality", descending=True, limit=2, min_quality=0)).collect()][-1] in ("a", "b")
    assert {(r.id, r.distance) for r in find_similar_hashes(st.all(), 5, 1, "a_hash").collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(ValueError):
        find_similar_hashes(st.all(), 5, 1, "x_hash")
    s = st.stats().first()
    assert s.total_images == 3 and s.average_quality == 55.0
    st.delete(["a"])
    with pytest.raises(NotFound):
        st.delete(["a"])
    st.compact()
    assert sorted(r.id for r in st.all().collect()) == ["b", "c"]


def test_watch(spark, folder, tmp_path):
    st = FingerprintStore(spark, f"file://{tmp_path}/w")
    for _ in range(2):
        watch(spark, folder, st, f"file://{tmp_path}/cp").awaitTermination(120)
        assert st.all().count() == 6


def test_config(tmp_path):
    c = C.EngineConfig.fast()
    assert c.hash_names() == ["a_hash", "d_hash"] and c.workers == 1
    C.save(c, tmp_path / "x" / "c.yaml")
    assert C.load(tmp_path / "x" / "c.yaml") == c and C.exists(tmp_path / "x" / "c.yaml") and not C.exists(tmp_path)
    assert C.from_dict({"hashing": {"compute_whash": True}, "logging": {"level": "warn"}}).extra == {"logging": {"level": "warn"}}
    assert C.EngineConfig().formats == ENGINE_FORMATS


def test_exif():
    def rational(a, b):
        return struct.pack("<II", a, b)

    data = b"II*\0" + struct.pack("<I", 8)
    entries = [(0x010F, 2, 4, b"Acm\0"), (0x0110, 2, 3, b"X1\0\0"), (0x8769, 4, 1, struct.pack("<I", 100)), (0x8825, 4, 1, struct.pack("<I", 200))]
    data += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + b"\0" * 4
    data = data.ljust(100, b"\0")
    sub = [(0x829A, 5, 1, struct.pack("<I", 160)), (0x8827, 3, 1, struct.pack("<HH", 400, 0)), (0x9003, 2, 20, struct.pack("<I", 170))]
    data += struct.pack("<H", len(sub)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in sub) + b"\0" * 4
    data = data.ljust(160, b"\0") + rational(1, 250) + b"\0\0" + b"2020:01:02 03:04:05\0"
    data = data.ljust(200, b"\0")
    gps = [(1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack("<I", 260)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", 284))]
    data += struct.pack("<H", len(gps)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in gps) + b"\0" * 4
    data = data.ljust(260, b"\0") + b"".join(rational(a, 1) for a in (10, 30, 0, 20, 0, 36))
    for content in (data, b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xda"):
        e = X.parse_exif(content)
        assert (e["camera_model"], e["exposure"], e["iso"], e["taken_at"]) == ("Acm X1", "1/250", 400, datetime(2020, 1, 2, 3, 4, 5))
        assert e["has_gps"] and e["gps_lat"] == -10.5 and math.isclose(e["gps_lon"], 20.01)
    assert X.parse_exif(b"") is None and X.parse_exif(b"II*\0\xff\xff\xff\xff") is None and X.parse_exif(data[:50]) is None


def test_data_behind_the_head(spark):
    tiff = lambda gap: b"II*\0" + struct.pack("<I", 8 + gap) + bytes(gap) + struct.pack("<HHHII", 1, X.MODEL, 2, 4, int.from_bytes(b"Cam\0", "little")) + bytes(4)
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + bytes(4)
    part = lambda kind, d: kind + struct.pack("<I", len(d)) + d
    segment = lambda marker, d: b"\xff" + marker + struct.pack(">H", len(d) + 2) + d
    sof, sos = segment(b"\xc0", struct.pack(">BHHB", 8, 30, 40, 3) + bytes(9)), b"\xff\xda" + bytes(300_000)
    body = part(b"VP8X", bytes(4) + b"\x27\0\0\x1d\0\0") + part(b"VP8 ", bytes(300_000)) + part(b"EXIF", b"Exif\0\0" + tiff(0))
    apps = segment(b"\xe2", bytes(60_000)) * 5
    files = {
        "webp": b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body,
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", bytes(300_000)) + chunk(b"eXIf", tiff(0)) + chunk(b"IEND", b""),
        "tiff": tiff(300_000),
        "jpeg": b"\xff\xd8" + apps + segment(b"\xe1", b"Exif\0\0" + tiff(0)) + sof + sos,
        "plain": b"\xff\xd8" + sof + sos,
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("none", None)], "path string, content binary")
    got = {r.path: r.exif and r.exif.camera_model for r in X.with_exif(df).collect()}
    assert got == {k: "Cam" for k in ("webp", "png", "tiff", "jpeg")} | {"plain": None, "none": None}
    assert not X.reaches_beyond(files["plain"][: 1 << 18])
    sizes = {r.path: (r.decoded_format, r.width, r.height) for r in FS.with_header_size(df.where("path in ('jpeg', 'plain', 'none')")).collect()}
    assert sizes == {"jpeg": ("jpeg", 40, 30), "plain": ("jpeg", 40, 30), "none": (None, None, None)}


def test_kernels():
    flat, g = np.full((32, 32, 3), 128, np.uint8), gradient(64, 48)
    assert P.average_hash(flat) == 0 and P.difference_hash(flat) == 0 and P.sharpness(flat) == 0.0 and P.contrast(flat) == 0.0
    assert P.exposure(np.zeros((9, 9, 3), np.uint8)) == 0.0 and P.is_blank(np.zeros((9, 9, 3), np.uint8), 0.9) and not P.is_blank(flat, 0.9)
    red = np.zeros((20, 20, 3), np.uint8)
    red[..., 0] = 255
    assert P.color_cast(red) == pytest.approx(math.sqrt(2 / 3)) and P.color_temperature(red) == ("neutral", 0.5)
    assert P.color_distribution(red)["saturation_high"] == 1.0 and P.dominant_colors(red, 3) == [(240, 0, 0)]
    with pytest.raises(ImageTooSmall):
        P.sharpness(flat[:2, :2], strict=True)
    assert P.noise(flat[:2, :2]) == 0.5 and P.compression(flat) == 0.1 and P.compression(np.zeros((120, 120, 3), np.uint8)) == 0.3
    assert P.resize(g, 0, 24).shape == (24, 32, 3) and P.resize_to_fill(g, 30, 30).shape == (30, 30, 3) and P.fit_size(64, 48, 100, 100) == (64, 48)
    for code in range(1, 9):
        assert P.orient(g, code).shape[:2] == ((64, 48) if code >= 5 else (48, 64))
    assert (P.orient(P.orient(g, 6), 8) == g).all() and (P.orient(g, 3) == P.rotate(g, 2)).all()
    assert len(P.pyramid(gradient(128, 128), 9)) == 4 and P.collage([flat, flat, flat], 2).shape == (64, 64, 3)
    assert set(P.hash_set(g)) == {"a_hash", "p_hash", "d_hash", "w_hash"} and P.hash_set(g, variant="dct")["p_hash"] >= 0
    with pytest.raises(ValueError):
        P.hash_set(g, ["x"])
    assert (P.haar(np.ones((4, 4)))[1:] == 0).all() and P.haar(np.arange(16.0).reshape(4, 4))[0, 0] == 7.5
    assert P.noise_patterns(g, flags=True)["salt_pepper"] == 0.0 and 0 <= P.compression(g, measured=True) <= 1
    assert P.blur(g, 1.0).shape == g.shape and P.sharpen(flat, 1.0).tolist() == flat.tolist() and P.adjust(flat, brightness=100).min() == 255
    assert sum(P.focus_regions(g).values()) >= 0 and P.moments(np.zeros((5, 5, 3), np.uint8))["hu1"] == 0.0


def test_grid_columns_equal_kernels(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        v = rng.integers(0, 256, (8, 8)) if i % 2 else np.clip(rng.normal(120, 3, (8, 8)), 0, 255).astype(int)
        rows.append((i, v.ravel().tolist()))
    g = F.col("g")
    df = spark.createDataFrame(rows, "i int, g array<int>").select("i", G.sharpness(g).alias("s"), G.noise(g).alias("n"), G.exposure(g).alias("e"), G.contrast(g).alias("c"), G.edges(g).alias("ed"), G.moments(g).alias("m"))
    got = {r.i: r for r in df.collect()}
    for i, v in rows:
        rgb = np.array(v, np.uint8).reshape(8, 8)[..., None].repeat(3, 2)
        assert (P.gray8(rgb).ravel() == v).all()
        r, edges, m = got[i], P.edge_stats(rgb), P.moments(rgb)
        for a, b in ((r.s, P.sharpness(rgb)), (r.n, P.noise(rgb)), (r.e, P.exposure(rgb)), (r.c, P.contrast(rgb)), (r.ed.strong, edges["strong_edges"]), (r.ed.weak, edges["weak_edges"]), (r.m.cx, m["centroid_x"]), (r.m.hu2, m["hu2"])):
            assert a == pytest.approx(b, abs=1e-9)


def test_colour_round_trip(spark):
    rows = [(0, 0, 0), (65535, 65535, 65535), (65535, 0, 0), (100, 60000, 30000), (40000, 40000, 100), (3, 2, 65535)]
    df = spark.createDataFrame(rows, "r int, g int, b int").select("*", S.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    for r in df.select("r", "g", "b", S.hsv_to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v")).alias("x")).collect():
        assert abs(r.r - r.x.r) <= 1 and abs(r.g - r.x.g) <= 1 and abs(r.b - r.x.b) <= 1


def test_vector_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    x, y = df.select(S.euclidean(a, b).alias("e"), S.cosine(a, b).alias("c"), S.histogram_similarity(a, b).alias("h"), S.chi_squared(a, b).alias("x")).collect()
    assert (x.e, x.c, x.h, x.x) == (S.FAR, 0.0, 1.0, S.FAR) and (y.c, y.x) == (0.0, 1.0)
    one = spark.createDataFrame([("/a/b/../c.tar.GZ", "x/../y"), ("/a/./b//c", "y/z")], "p string, q string")
    r = one.select(S.extension(F.col("p")).alias("e"), S.normalise_path(F.col("p")).alias("n"), S.safe_join("/base", F.col("q")).alias("j"), S.is_subpath(F.col("p"), F.lit("/a")).alias("s")).collect()
    assert (r[0].e, r[0].j) == (".gz", None) and (r[1].n, r[1].j, r[1].s) == ("/a/b/c", "/base/y/z", True)


def test_lsh_and_progress(spark):
    df = spark.createDataFrame([(i, [float(i % 3 - 1), 1.0]) for i in range(9)] + [(99, None)], "id long, v array<double>")
    x = lsh.index(df, "id", "v", 2, tables=2, bits=4)
    s = lsh.bucket_stats(x).first()
    assert s.total_items == 18 and s.num_tables == 2 and lsh.bucket_stats(x.limit(0)).first().total_items == 0
    assert {(r.query, r.id) for r in lsh.candidates(x, x.where("id = 0")).collect()} >= {(0, 3), (0, 6)}
    assert lsh.candidates(x, x.where("id = 0"), limit=1).count() == 1
    assert progress.percent(1, 0) == 0.0 and progress.eta_seconds(10, 5, 10) == 10 and progress.bar(5, 10, 4).startswith("[██░░]")
    shown = []
    t = progress.Tracker(2, shown.append, 0)
    t.update()
    t.complete()
    assert len(shown) == 2 and "100.0%" in shown[-1]
    assert progress.log_performance(progress.logger(level="odd"), "x", 10, 2.0) == 5.0


def test_transforms(spark, folder):
    from lumenfold.operators import transforms as T

    images = FS.read_images(spark, folder)
    out = T.transform_images(images, [("resize_to_fit", 40, 40), ("orient", 6)])
    got = out.withColumn("i", T.transform_info(F.col("old_width"), F.col("old_height"), F.col("width"), F.col("height"))).collect()
    a = next(r for r in got if r.path.endswith("/a.png"))
    assert len(got) == 6 and (a.width, a.height, len(a.data)) == (30, 40, 30 * 40 * 3) and a.i.old_aspect == pytest.approx(4 / 3)
    with pytest.raises(ValueError):
        T.transform_images(images, [("explode",)])
    assert set(P.hash_set(gradient(64, 64), variant="compat")) == set(S.HASH_NAMES)
    one = spark.createDataFrame([fp_row("a", "x")], FP_SCHEMA).select(T.metadata_summary(F.col("metadata")).alias("j")).first()
    assert '"sha256":"x"' in one.j and "exif" not in one.j


def test_json_export_holds_all_groups(spark, tmp_path):
    rows = [fp_row(f"i{g:03d}_{k}", f"{g:064x}", (0, 0, 0, 0) if g else (5 << 40, 0, 0, 0)) for g in range(60) for k in range(3)]
    e = api.Engine(spark, C.EngineConfig(index_path=f"file://{tmp_path}/index"))
    e.store.save(spark.createDataFrame(rows, FP_SCHEMA))
    got = json.loads(open(e.export(str(tmp_path / "all"))).read())
    want = {f"exact_{g + 1}": [f"i{g:03d}_1", f"i{g:03d}_2"] for g in range(60)} | {"near_1": ["i000_1", "i000_2"]}
    assert {g["group_id"]: g["duplicate_ids"] for g in got["duplicate_groups"]} == want
    assert [g["group_id"] for g in got["duplicate_groups"]] == list(want) and got["exact_duplicate_count"] == 60


def test_lsh_recall(spark):
    from lumenfold.plans import catalog

    d = "/root/testdata/sf0.1"
    rows = [(r[0], np.array(r[1], float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) = 64").select("vec_id", "embedding").collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    true = set()
    for i in np.flatnonzero(ids % 100 == 0):
        sim = m @ m[i]
        sim[i] = -2
        true |= {(int(ids[i]), int(x)) for x in ids[np.argsort(-sim)[:10]]}
    got = {(r.query, r.id) for r in catalog.queries()["lsh_neighbours"](spark, d).collect()}
    print("recall", len(got & true) / len(true))
    assert len(got) == len(true) == 200 and len(got & true) >= 0.9 * len(true)
