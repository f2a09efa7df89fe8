"""Queries that run whole ways: folders of real files, the store, clean-up, reports and presets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import api
from lumenfold import config as C
from lumenfold.functions import scalars as S
from lumenfold.operators import cleanup, reports
from lumenfold.operators import duplicates as D
from lumenfold.plans import pictures as PX
from lumenfold.runtime import scratch, stage, table
from lumenfold.sources import files as FS
from lumenfold.sources import png
from lumenfold.sources import store as ST
from lumenfold.streaming import incremental

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_HASHED = C.EngineConfig(hashes=dict.fromkeys(S.HASH_NAMES, True))


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def _folder(spark, d, copies: int = 1) -> str:
    """The pictures of ``cameras`` as PNG files with camera data, each ``copies`` times in folders of its own; one more lies in an excluded folder."""
    folder = scratch(spark, "pictures")
    rows = PX.pictures(spark, d).join(table(spark, d, "cameras").select(F.col("camera_id").alias("path"), "camera_model"), "path")
    n = F.substring("path", 5, 9).cast("int")
    rows = rows.withColumns({"taken": F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + n * 100_000), "yyyy:MM:dd HH:mm:ss"), "lat": n - 30.25, "lon": n * 3 - 90.5})
    places = F.explode(F.array(*[F.lit(f"c{i}/") for i in range(copies)], *([F.lit("Thumbs/")] if copies == 1 else [])))
    placed = rows.withColumn("place", places).withColumn("path", F.concat("place", "path"))
    png.write_pngs(placed, folder).count()
    return folder


_NAME = lambda c: F.regexp_extract(c, r"([^/]*)\.png$", 1)
_SCAN = replace(_HASHED, exclude_dirs=("Thumbs",))


@query(
    PX._HASHES.replace("SELECT path, a_hash, p_hash, d_hash, a_hash AS w_hash FROM ah", "SELECT * FROM (SELECT path, a_hash, p_hash, d_hash, a_hash AS w_hash FROM ah", 1)
    + """) JOIN (SELECT path, 'png' AS format, 32 AS width, 32 AS height, nullif(trim(camera_model), '') AS camera_model, (1577836800 + n * 100000)::BIGINT AS taken_at, round(n - 30.25::DOUBLE, 6) AS gps_lat, round(n * 3 - 90.5::DOUBLE, 6) AS gps_lon, true AS has_gps, true AS hashed
      FROM cam JOIN cameras ON camera_id = path) USING (path)"""
)
def folder_scan(spark, d):
    """Written, listed, decoded and hashed files, with the camera data in them; a thumbnail folder is left out."""
    fp = FS.fingerprint_folder(spark, _folder(spark, d), _SCAN)
    e = F.col("metadata.exif")
    return fp.select(
        _NAME(F.col("metadata.path")).alias("path"), "perceptual_hashes.*", "metadata.format", "metadata.width", "metadata.height", e.camera_model.alias("camera_model"), F.unix_seconds(e.taken_at).alias("taken_at"),
        F.round(e.gps_lat, 6).alias("gps_lat"), F.round(e.gps_lon, 6).alias("gps_lon"), e.has_gps.alias("has_gps"), S.valid_sha256(F.col("metadata.sha256")).alias("hashed"),
    )


@query("SELECT camera_id AS path, 2 AS files, true AS same_content FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL")
def folder_byte_verified(spark, d):
    """Files of one content hash, compared by their bytes."""
    listed = FS.scan_folder(spark, _folder(spark, d, 2)).withColumn("sha", F.sha2("content", 256))
    listed, _ = stage(listed, "listed")
    same = D.byte_verified(listed.select("sha", "path"), listed.select("path", "content"))
    return listed.groupBy("sha").agg(F.min(_NAME(F.col("path"))).alias("path"), F.count("*").cast("int").alias("files")).join(same, "sha").select("path", "files", F.col("same").alias("same_content"))


@query("SELECT camera_id AS path, true AS placeholder FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL")
def folder_scan_placeholder_exif(spark, d):
    fp = FS.fingerprint_folder(spark, _folder(spark, d), replace(_SCAN, compat_exif=True))
    return fp.select(_NAME(F.col("metadata.path")).alias("path"), (F.col("metadata.exif.camera_model") == "Unknown PNG Source").alias("placeholder"))


@query("SELECT camera_id AS path, 'png' AS format, 1 AS times FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL")
def folder_watch(spark, d):
    """Files of a folder that is watched twice: every one is in the store once."""
    folder, store = _folder(spark, d), ST.FingerprintStore(spark, scratch(spark, "watched"))
    at = scratch(spark, "watch")
    for _ in range(2):
        incremental.watch(spark, folder, store, at, _SCAN, 25).awaitTermination()
    return store.all().groupBy(_NAME(F.col("metadata.path")).alias("path"), "metadata.format").agg(F.count("*").cast("int").alias("times"))


@query("SELECT count(*)::INT AS total_files, count(*)::INT AS processed_images FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL")
def engine_scan(spark, d):
    engine = api.Engine(spark, replace(_SCAN, index_path=scratch(spark, "index")))
    got = engine.scan(_folder(spark, d))
    return spark.createDataFrame([(got["total_files"], got["processed_images"])], "total_files int, processed_images int")


@query("SELECT count(*)::INT AS groups, count(*)::INT AS moved, 0 AS errors, count(*)::INT AS kept_files, count(*)::INT AS moved_files FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL")
def folder_cleanup(spark, d):
    """Every picture lies in two folders; the second is moved away."""
    folder = _folder(spark, d, 2)
    fp, _ = stage(FS.fingerprint_folder(spark, folder, _HASHED), "scanned")
    o = cleanup.CleanOptions(output=f"{folder.removeprefix('file://')}-out")
    groups, _ = stage(D.exact_groups(fp), "exact")
    rows = D.exact_members(fp).select("id", "sha", F.col("metadata.path").alias("src"), F.col("metadata.size_bytes").alias("size_bytes")).join(groups.select("sha", "group_id", "main_image"), "sha").where("id <> main_image")
    plan, _ = stage(cleanup.with_destinations(rows.drop("sha", "main_image"), o), "plan")
    done, _ = stage(cleanup.apply_plan(plan, dry_run=False), "applied")
    report = cleanup.clean_report(plan, done).select(F.col("total_processed").cast("int").alias("groups"), F.col("moved_files").cast("int").alias("moved"), F.col("errors").cast("int").alias("errors"))
    left = [FS.scan_folder(spark, at, content=False).agg(F.count("*").cast("int").alias(name)) for at, name in ((folder, "kept_files"), (o.output, "moved_files"))]
    return report.crossJoin(left[0]).crossJoin(left[1])  # one row each


# --- store ----------------------------------------------------------------------------------------------

_LAST = "SELECT * FROM fingerprints WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1"
_COLS = "id, metadata.path AS path, metadata.sha256 AS sha, epoch_us(created_at) AS created_us"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("metadata.path").alias("path"), F.col("metadata.sha256").alias("sha"), F.unix_micros("created_at").alias("created_us"))


def _store(spark, d) -> ST.FingerprintStore:
    """First the oldest row of every id, then the newest: the second replaces the first."""
    st, fp = ST.FingerprintStore(spark, scratch(spark, "store")), table(spark, d, "fingerprints")
    st.save(ST.latest(fp, newest=False))
    st.save(fp)
    return st


@query(f"SELECT {_COLS} FROM ({_LAST})")
def store_upsert(spark, d):
    return _shown(_store(spark, d).all())


@query(f"SELECT {_COLS} FROM ({_LAST}) WHERE NOT suffix(id, '7')")
def store_delete_compact(spark, d):
    st = _store(spark, d)
    st.delete(st.all().where(F.col("id").endswith("7")).select("id"))
    st.compact()
    st.delete(spark.createDataFrame([("no such id",)], "id string"))
    return _shown(st.all())


@query(f"WITH fp AS ({_LAST}), one AS (SELECT min(id) AS id FROM fp WHERE metadata.sha256 IS NOT NULL) SELECT {_COLS} FROM fp WHERE metadata.sha256 = (SELECT metadata.sha256 FROM fp JOIN one USING (id))")
def store_get_and_find_by_sha(spark, d):
    st = _store(spark, d)
    first = st.all().where("metadata.sha256 is not null").agg(F.min("id")).first()[0]
    return _shown(st.find_by_sha256(st.get(first).metadata.sha256 if first else ""))


@query(f"SELECT count(*) AS total_images, coalesce(sum(metadata.size_bytes), 0)::BIGINT AS total_size_bytes, true AS has_bytes FROM ({_LAST})")
def store_stats(spark, d):
    return _store(spark, d).stats().select("total_images", "total_size_bytes", (F.col("index_size_bytes") > 0).alias("has_bytes"))


# --- reports, presets -----------------------------------------------------------------------------------


@query(
    """WITH fp AS (SELECT * FROM fingerprints WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1),
    ex AS (SELECT *, metadata.sha256 AS sha, count(*) OVER (PARTITION BY metadata.sha256) AS n FROM fp WHERE metadata.sha256 IS NOT NULL QUALIFY n > 1),
    best AS (SELECT sha, id AS main_image FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY CASE WHEN NOT isnan(quality.final_score) THEN quality.final_score END DESC NULLS LAST, id) = 1)
    SELECT 'exact_' || row_number() OVER (ORDER BY first) AS group_id, main_image, 'exact' AS reason, 1.0::DOUBLE AS confidence, array_to_string(list_sort([x FOR x IN ids IF x <> main_image]), ' ') AS duplicate_ids
    FROM (SELECT sha, min(id) AS first, list(id) AS ids FROM ex GROUP BY 1) JOIN best USING (sha)"""
)
def exact_group_records(spark, d):
    """Groups as reports hold them, with all duplicate ids (joined to one text here)."""
    fp = ST.latest(table(spark, d, "fingerprints"))
    groups, _ = stage(D.exact_groups(fp), "exact")
    records = D.as_records(D.exact_members(fp).select("sha", "id"), groups.select("sha", "group_id", "main_image", "reason", "confidence"), "sha")
    return records.withColumn("duplicate_ids", F.array_join("duplicate_ids", " "))


@query(
    f"""WITH fp AS ({_LAST}), ex AS (SELECT metadata.sha256 AS sha, count(*) AS n FROM fp WHERE metadata.sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT unnest(['brief', 'html', 'json', 'text']) AS form, (SELECT count(*) FROM fp)::INT AS images, (SELECT count(*) FROM ex)::INT AS exact_groups, true AS complete"""
)
def report_forms(spark, d):
    """The figures that each written form of the report holds."""
    import re

    fp, _ = stage(ST.latest(table(spark, d, "fingerprints")), "fp")
    exact, _ = stage(D.exact_groups(fp), "exact")
    report = reports.build(fp, exact, exact.limit(0))
    rows, patterns = [], {"brief": r"Images: (\d+)\nExact duplicate groups: (\d+)", "html": r"<b>(\d+)</b><span>images</span></div><div class=\"card\"><b>(\d+)</b><span>exact", "json": r'"processed_images": (\d+)[^}]*?"exact_duplicate_count": (\d+)', "text": r"Images: (\d+)[\s\S]*EXACT DUPLICATES: (\d+) groups"}
    for form, pattern in patterns.items():
        text = reports.FORMATS[form][0](report)
        m = re.search(pattern, text)
        rows.append((form, int(m[1]), int(m[2]), text.count("exact_") >= min(50, report["exact_duplicate_count"]) or form == "brief"))
    return spark.createDataFrame(rows, "form string, images int, exact_groups int, complete boolean")


@query(
    """SELECT * FROM (VALUES ('default', true, true, true, false, 4), ('high_performance', true, true, true, true, 8), ('accuracy', true, true, true, false, 2), ('fast', true, false, true, false, 1)) t(preset, a_hash, p_hash, d_hash, w_hash, workers)"""
)
def config_presets(spark, d):
    """Presets as they come back from their YAML form."""
    rows = []
    for name in ("default", "high_performance", "accuracy", "fast"):
        c = C.from_dict(C.to_dict(getattr(C.EngineConfig, name)()))
        rows.append((name, *[c.hashes[h] for h in S.HASH_NAMES], c.workers))
    return spark.createDataFrame(rows, "preset string, a_hash boolean, p_hash boolean, d_hash boolean, w_hash boolean, workers int")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
