"""Named queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import grids as G
from lumenfold.functions import scalars as S
from lumenfold.operators import cleanup, clustering, lsh, reports
from lumenfold.operators import duplicates as D
from lumenfold.plans import pictures, problems, workflows
from lumenfold.runtime import stage, table
from lumenfold.schema import METRICS, Policy
from lumenfold.sources import exif as X
from lumenfold.sources import files as FS
from lumenfold.sources import store as ST

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
NEAR = 0.9


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def images(spark: SparkSession, d: str) -> DataFrame:
    """One row an image: an id written twice counts once."""
    return ST.latest(table(spark, d, "fingerprints"))


FP = "fp AS (SELECT * FROM fingerprints WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"
_META = lambda f: F.col(f"metadata.{f}")
_SCORE = "CASE WHEN NOT isnan(quality.final_score) THEN quality.final_score END"

# --- exact duplicates --------------------------------------------------------------------------------

_EXACT = f"{FP}, ex AS (SELECT *, metadata.sha256 AS sha, count(*) OVER (PARTITION BY metadata.sha256) AS n FROM fp WHERE metadata.sha256 IS NOT NULL QUALIFY n > 1)"


@query(
    f"""WITH {_EXACT}, best AS (SELECT sha, id AS main_image FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY {_SCORE} DESC NULLS LAST, id) = 1)
    SELECT 'exact_' || row_number() OVER (ORDER BY first) AS group_id, sha, main_image, n_members, 'exact' AS reason, 1.0::DOUBLE AS confidence
    FROM (SELECT sha, count(*) AS n_members, min(id) AS first FROM ex GROUP BY 1) JOIN best USING (sha)"""
)
def exact_duplicate_groups(spark, d):
    return D.exact_groups(images(spark, d))


@query(f"WITH {_EXACT} SELECT sha, id, n FROM ex")
def exact_duplicate_members(spark, d):
    return D.exact_members(images(spark, d)).select("sha", "id", "n")


_POLICY_SQL = {
    Policy.HIGHEST_QUALITY: _SCORE, Policy.HIGHEST_RESOLUTION: "(metadata.width::BIGINT * metadata.height::BIGINT)::DOUBLE",
    Policy.BEST_EXPOSURE: "1 - abs(CASE WHEN NOT isnan(quality.exposure) THEN quality.exposure END - 0.5::DOUBLE) * 2",
    Policy.OLDEST: "-floor(epoch(metadata.modified_at))", Policy.NEWEST: "floor(epoch(metadata.modified_at))",
}


def _policy_query(policy: Policy):
    def f(spark, d):
        return D.best_of_group(D.exact_members(images(spark, d)), "sha", policy).select("sha", F.col("id").alias("image_id"))

    f.__name__ = f"exact_best_{policy.name.lower()}"
    query(f"WITH {_EXACT} SELECT sha, id AS image_id FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY {_POLICY_SQL[policy]} DESC NULLS LAST, id) = 1")(f)


for _p in Policy:
    _policy_query(_p)


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def document_exact_groups(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    """SELECT octet_length(encode(text)) AS size, sha256(encode(text)[1:64]) AS head, count(*) AS n_files FROM documents
    WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""
)
def partial_hash_candidates(spark, d):
    return D.partial_hash_candidates(table(spark, d, "documents").where("text is not null"), F.encode("text", "UTF-8"), 64)


@query(
    f"""WITH {FP} SELECT coalesce(regexp_full_match(metadata.sha256, '[0-9a-fA-F]{{64}}'), false) AS valid, count(*) AS n, count(DISTINCT metadata.sha256) AS distinct_texts
    FROM fp GROUP BY 1"""
)
def hash_validity(spark, d):
    return images(spark, d).groupBy(S.valid_sha256(_META("sha256")).alias("valid")).agg(F.count("*").alias("n"), F.count_distinct(_META("sha256")).alias("distinct_texts"))


@query("SELECT a.id, a.metadata.sha256 AS sha FROM fingerprints a JOIN (SELECT DISTINCT sha256 FROM incoming_images) s ON a.metadata.sha256 = s.sha256 GROUP BY ALL")
def sha_index_join(spark, d):
    wanted = table(spark, d, "incoming_images").select(F.col("sha256").alias("sha")).distinct()
    rows = table(spark, d, "fingerprints").select("id", _META("sha256").alias("sha")).distinct()
    return rows.join(wanted, "sha").select("id", "sha")


# --- files, metadata, paths ----------------------------------------------------------------------------

_EXT = r"lower(regexp_extract(metadata.path, '(\.[^./]*)$', 1))"
_FMT = f"CASE WHEN {_EXT} IN ('.jpg', '.jpeg') THEN 'jpeg' WHEN {_EXT} IN ('.tif', '.tiff') THEN 'tiff' ELSE substr({_EXT}, 2) END"


@query(f"WITH {FP} SELECT {_EXT} AS ext, {_FMT} AS fmt, {_EXT} IN ('.jpg', '.jpeg', '.png', '.webp', '.tiff', '.bmp', '.gif') AS supported, count(*) AS n FROM fp GROUP BY ALL")
def extension_counts(spark, d):
    p = _META("path")
    return images(spark, d).groupBy(S.extension(p).alias("ext"), S.format_of(p).alias("fmt"), S.has_extension(p, FS.SCANNER_FORMATS).alias("supported")).agg(F.count("*").alias("n"))


_PATH_PARTS = r"[x FOR x IN string_split(replace({p}, '\', '/'), '/') IF x NOT IN ('', '.')]"
_NORMAL = f"CASE WHEN starts_with(replace({{p}}, '\\', '/'), '/') THEN '/' ELSE '' END || array_to_string({_PATH_PARTS}, '/')"


@query(
    rf"""WITH {FP}, n AS (SELECT id, metadata.path AS path, {_NORMAL.format(p="metadata.path")} AS np FROM fp)
    SELECT id, regexp_extract(path, '([^/]*)/*$', 1) AS name, regexp_replace(path, '\.[^./]*$', '') || '.webp' AS changed, starts_with(regexp_extract(path, '([^/]*)/*$', 1), '.') AS hidden,
    starts_with(np, '/archive/') AS below, CASE WHEN starts_with(np, '/archive/') THEN substr(np, 10) END AS relative, 'img_' || substr(sha256(path), 1, 16) AS path_id FROM n"""
)
def path_functions(spark, d):
    p, base = _META("path"), F.lit("/archive")
    cols = [S.base_name(p).alias("name"), S.change_extension(p, "webp").alias("changed"), S.is_hidden(p).alias("hidden"), S.is_subpath(p, base).alias("below"), S.relative_path(p, base).alias("relative"), S.image_id(p).alias("path_id")]
    return images(spark, d).select("id", *cols)


_ODD = ["replace({p}, '/', '//')", "concat({p}, '/')", "concat('/archive/.', {p})", "concat('./', substr({p}, 2), '/.')", "concat('/archive/', id, '///', '././x.png')", "translate({p}, '/', '" + chr(92) * 2 + "')"]


@query(
    f"""WITH {FP}, v AS (SELECT id, unnest([{", ".join(o.replace("'" + chr(92) * 2 + "'", "'" + chr(92) + "'").format(p="metadata.path") for o in _ODD)}]) AS path FROM fp), n AS (SELECT id, path, {_NORMAL.format(p="path")} AS np FROM v)
    SELECT id, path, np AS normal, starts_with(np, '/archive/') AS below, CASE WHEN starts_with(np, '/archive/') THEN substr(np, 10) END AS relative FROM n"""
)
def path_normalisation(spark, d):
    """Paths with repeated, trailing and backward separators and with dots."""
    odd = images(spark, d).select("id", F.explode(F.array(*[F.expr(o.format(p="metadata.path")) for o in _ODD])).alias("path"))
    p, base = F.col("path"), F.lit("/archive")
    return odd.select("id", "path", S.normalise_path(p).alias("normal"), S.is_subpath(p, base).alias("below"), S.relative_path(p, base).alias("relative"))


@query(
    rf"""WITH {FP} SELECT scan_id, count(*) AS kept, sum(metadata.size_bytes)::BIGINT AS total_bytes FROM fp
    WHERE {_EXT} IN ('.jpg', '.jpeg', '.png', '.webp', '.tiff', '.bmp', '.gif', '.tif') AND metadata.size_bytes BETWEEN 1024 AND 524288000
    AND len(list_intersect([lower(x) for x in string_split(metadata.path, '/')[:-2]], ['.git', '.svn', '.hg', 'node_modules', '__pycache__', 'thumbs', 'thumbnails', '.thumbnails'])) = 0 GROUP BY 1"""
)
def image_filter_by_scan(spark, d):
    rows = images(spark, d).where(FS.image_filter().column(_META("path"), _META("size_bytes")))
    return rows.groupBy("scan_id").agg(F.count("*").alias("kept"), F.sum(_META("size_bytes")).alias("total_bytes"))


@query(
    f"""WITH {FP}, r AS (SELECT metadata.width AS w, metadata.height AS h, metadata.size_bytes AS s, metadata.format AS f FROM fp)
    SELECT CASE WHEN coalesce(w, 0) <= 0 THEN 'no width' WHEN coalesce(h, 0) <= 0 THEN 'no height' WHEN w::BIGINT * h > 100000000 THEN 'too many pixels'
      WHEN s > 524288000 THEN 'file too large' WHEN f = 'jpeg' AND (w < 16 OR h < 16) THEN 'jpeg too small' WHEN f = 'png' AND (w > 32767 OR h > 32767) THEN 'png too large'
      WHEN NOT coalesce(f IN ('jpeg', 'jpg', 'png', 'webp', 'tiff', 'bmp', 'gif'), false) THEN 'format' END AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def image_validation(spark, d):
    reason = S.invalid_image(_META("width"), _META("height"), _META("size_bytes"), _META("format"))
    return images(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {FP} SELECT CASE WHEN coalesce(metadata.path, '') = '' THEN 'path' WHEN coalesce(metadata.size_bytes, 0) <= 0 THEN 'size'
      WHEN coalesce(metadata.width, 0) <= 0 OR coalesce(metadata.height, 0) <= 0 THEN 'dimensions' WHEN coalesce(metadata.format, '') = '' THEN 'format' END AS reason, count(*) AS n FROM fp GROUP BY 1"""
)
def metadata_validation(spark, d):
    reason = S.invalid_metadata(_META("path"), _META("size_bytes"), _META("width"), _META("height"), _META("format"))
    return images(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {FP} SELECT * EXCLUDE raw_estimate, floor(raw_estimate) AS estimate FROM (SELECT id, round(CASE WHEN metadata.height = 0 THEN 0.0::DOUBLE ELSE metadata.width / metadata.height::DOUBLE END, 6) AS aspect,
    round(metadata.width::BIGINT * metadata.height::BIGINT / 1e6::DOUBLE, 6) AS megapixels, metadata.height > metadata.width AS portrait, metadata.width > metadata.height AS landscape,
    (metadata.width::BIGINT * metadata.height::BIGINT * CASE lower(metadata.format) WHEN 'jpeg' THEN 0.3::DOUBLE WHEN 'jpg' THEN 0.3::DOUBLE WHEN 'png' THEN 1.5::DOUBLE WHEN 'webp' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END) AS raw_estimate FROM fp)"""
)
def dimension_facts(spark, d):
    w, h = _META("width"), _META("height")
    cols = [F.round(S.aspect_ratio(w, h), 6).alias("aspect"), F.round(S.megapixels(w, h), 6).alias("megapixels"), (h > w).alias("portrait"), (w > h).alias("landscape"), S.estimated_bytes(w, h, _META("format")).cast("double").alias("estimate")]
    return images(spark, d).select("id", *cols)


@query(
    f"""WITH {FP}, e AS (SELECT metadata.exif AS x FROM fp) SELECT coalesce(x.camera_model <> '', false) AS has_camera,
    coalesce(x.exposure <> '', false) OR coalesce(x.aperture <> 0, false) OR coalesce(x.iso <> 0, false) AS has_exposure,
    coalesce(x.has_gps, false) AND coalesce(x.gps_lat <> 0, false) AND coalesce(x.gps_lon <> 0, false) AS has_gps, count(*) AS n FROM e GROUP BY ALL"""
)
def exif_flag_counts(spark, d):
    flags = X.exif_flags(_META("exif"))
    return images(spark, d).groupBy(*[c.alias(k) for k, c in flags.items()]).agg(F.count("*").alias("n"))


# --- store --------------------------------------------------------------------------------------------


@query(
    f"""WITH {FP} SELECT count(*) AS total_images, coalesce(sum(metadata.size_bytes), 0)::BIGINT AS total_size_bytes, 0::BIGINT AS index_size_bytes,
    round(coalesce(avg({_SCORE}), 0), 6) AS average_quality, (SELECT count(*) FROM (SELECT metadata.sha256 FROM fp WHERE metadata.sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups FROM fp"""
)
def index_stats(spark, d):
    fp = images(spark, d)
    groups = D.exact_members(fp).select("sha").distinct().count()
    return ST.stats(fp, groups).withColumn("average_quality", F.round("average_quality", 6))


@query(
    f"""WITH {FP} SELECT id, metadata.path AS path, metadata.size_bytes AS size_bytes FROM fp WHERE quality.final_score >= 40 AND metadata.width >= 800
    AND lower(metadata.format) IN ('jpeg', 'png') ORDER BY metadata.size_bytes DESC NULLS LAST, id LIMIT 50 OFFSET 20"""
)
def paged_listing(spark, d):
    o = ST.QueryOptions(limit=50, offset=20, min_quality=40, min_width=800, formats=("jpeg", "png"), sort_by="size", descending=True)
    return ST.select(images(spark, d), o).select("id", _META("path").alias("path"), _META("size_bytes").alias("size_bytes"))


@query(
    """WITH t AS (SELECT perceptual_hashes.p_hash AS h FROM fingerprints WHERE perceptual_hashes.p_hash <> 0 ORDER BY id LIMIT 1)
    SELECT DISTINCT id, bit_count(xor(perceptual_hashes.p_hash, t.h))::INT AS distance FROM fingerprints, t
    WHERE perceptual_hashes.p_hash <> 0 AND bit_count(xor(perceptual_hashes.p_hash, t.h)) <= 20"""
)
def hamming_range_search(spark, d):
    rows = table(spark, d, "fingerprints")
    target = rows.where(F.col("perceptual_hashes.p_hash") != 0).orderBy("id").select("perceptual_hashes.p_hash").first()
    return ST.find_similar_hashes(rows, target[0] if target else 1, 20, "p_hash").select("id", "distance").distinct()


# --- near duplicates ------------------------------------------------------------------------------------


def _sim(a: str, b: str, p: str = "") -> str:
    def f(name: str) -> str:
        s = f"(1 - bit_count(xor({a}.{p}{name}, {b}.{p}{name}))::DOUBLE / 64)"
        if name == "p_hash":
            return f"CASE WHEN {s} > 0.9::DOUBLE THEN {s} WHEN {s} > 0.7::DOUBLE THEN {s} * 0.9::DOUBLE ELSE {s} * 0.8::DOUBLE END"
        if name == "w_hash":
            return f"CASE WHEN {s} > 0.6::DOUBLE THEN least({s} * 1.1::DOUBLE, 1) ELSE {s} END"
        return f"greatest({s}, 0)"

    both = lambda n: f"coalesce({a}.{p}{n} <> 0 AND {b}.{p}{n} <> 0, false)"
    total = " + ".join(f"CASE WHEN {both(n)} THEN ({f(n)}) * {w}::DOUBLE ELSE 0 END" for n, w in S.DEFAULT_WEIGHTS.items())
    by = " + ".join(f"CASE WHEN {both(n)} THEN {w}::DOUBLE ELSE 0 END" for n, w in S.DEFAULT_WEIGHTS.items())
    return f"CASE WHEN ({by}) = 0 THEN 0 ELSE least(greatest(({total}) / ({by}), 0), 1) END"


_HS = ", ".join(f"coalesce(perceptual_hashes.{n}, 0) AS {n}" for n in S.HASH_NAMES)
_NEAR = f"""{FP}, hs AS (SELECT id, {_HS} FROM fp),
cls AS (SELECT min(id) AS id, count(*) AS copies, a_hash, p_hash, d_hash, w_hash FROM hs GROUP BY ALL HAVING a_hash <> 0 OR p_hash <> 0 OR d_hash <> 0 OR w_hash <> 0),
np AS (SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, {_sim("a", "b")} AS similarity FROM cls a JOIN cls b ON a.id < b.id) WHERE similarity >= {NEAR}::DOUBLE)"""
_GREEDY = f"""{_NEAR}, nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT id_a AS id FROM np UNION SELECT id_b FROM np)),
prev AS (SELECT n.id, n.k, coalesce(list(p.id_a) FILTER (p.id_a IS NOT NULL), []) AS before FROM nodes n LEFT JOIN np p ON p.id_b = n.id GROUP BY ALL),
g(k, leaders) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT prev.k, CASE WHEN list_has_any(prev.before, g.leaders) THEN g.leaders ELSE list_append(g.leaders, prev.id) END
  FROM g JOIN prev ON prev.k = g.k + 1),
heads AS (SELECT leaders FROM g ORDER BY k DESC LIMIT 1),
lead AS (SELECT id AS rep, coalesce(list_min(list_intersect(before, leaders)), id) AS leader FROM prev, heads),
named AS (SELECT hs.id, coalesce(lead.leader, cls.id) AS leader FROM hs JOIN cls USING (a_hash, p_hash, d_hash, w_hash) LEFT JOIN lead ON lead.rep = cls.id),
ng AS (SELECT id, leader FROM named WHERE leader IN (SELECT leader FROM named GROUP BY 1 HAVING count(*) > 1)),
conf AS (SELECT leader, avg(s) AS confidence FROM (SELECT x.leader, {_sim("a", "b")} AS s FROM ng x JOIN ng y ON x.leader = y.leader AND x.id < y.id JOIN hs a ON a.id = x.id JOIN hs b ON b.id = y.id) GROUP BY 1)"""


@query(f"WITH {_NEAR} SELECT id_a, id_b, round(similarity, 9) AS similarity FROM np")
def near_pairs(spark, d):
    """Pairs between representatives of equal hash sets; ``near_classes`` tells whom they stand for."""
    return D.near_pairs(images(spark, d), NEAR).select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_NEAR} SELECT hs.id, cls.id AS rep FROM hs JOIN cls USING (a_hash, p_hash, d_hash, w_hash)")
def near_classes(spark, d):
    return D.class_members(images(spark, d))


@query(f"WITH RECURSIVE {_GREEDY} SELECT id, leader FROM ng")
def near_groups(spark, d):
    return D.near_groups(images(spark, d), NEAR)


@query(
    f"""WITH RECURSIVE {_GREEDY}, best AS (SELECT leader, id AS main_image FROM ng JOIN fp USING (id) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY {_SCORE} DESC NULLS LAST, id) = 1)
    SELECT 'near_' || row_number() OVER (ORDER BY leader) AS group_id, leader, main_image, n_members, 'near' AS reason, round(confidence, 9) AS confidence
    FROM (SELECT leader, count(*) AS n_members FROM ng GROUP BY 1) JOIN best USING (leader) JOIN conf USING (leader)"""
)
def near_group_records(spark, d):
    return D.near_group_records(images(spark, d), NEAR).withColumn("confidence", F.round("confidence", 9))


@query(
    f"""WITH RECURSIVE {_GREEDY} SELECT x.leader, x.leader AS main_image, count(*) + 1 AS n_members, round(arg_max({_sim("a", "b")}, x.id), 9) AS confidence
    FROM ng x JOIN hs a ON a.id = x.leader JOIN hs b ON b.id = x.id WHERE x.id <> x.leader GROUP BY 1"""
)
def grouper_groups(spark, d):
    fp = images(spark, d)
    return D.leader_similarity(D.near_groups(fp, NEAR), fp).select("leader", "main_image", "n_members", F.round("confidence", 9).alias("confidence"))


@query(f"WITH RECURSIVE {_GREEDY} SELECT leader AS cluster, count(*) AS n, (count(*) FILTER (id <= leader)) AS up_to_leader FROM named GROUP BY 1")
def content_clusters(spark, d):
    """Leader groups of any size, singletons kept."""
    fp = images(spark, d)
    grouped = D.near_groups(fp, NEAR)
    alone = D.class_members(fp).join(grouped.select("id"), "id", "left_anti").select("id", F.col("rep").alias("leader"))
    return grouped.unionByName(alone).groupBy(F.col("leader").alias("cluster")).agg(F.count("*").alias("n"), F.count_if(F.col("id") <= F.col("leader")).alias("up_to_leader"))


@query(
    f"""WITH {FP}, hs AS (SELECT id, {_HS} FROM fp), t AS (SELECT * FROM hs WHERE p_hash <> 0 ORDER BY id LIMIT 1)
    SELECT id, round(similarity, 9) AS similarity FROM (SELECT hs.id, {_sim("t", "hs")} AS similarity FROM hs, t WHERE hs.id <> t.id) WHERE similarity >= 0.5::DOUBLE"""
)
def similar_to_target(spark, d):
    fp = images(spark, d)
    first = fp.where(F.col("perceptual_hashes.p_hash") != 0).orderBy("id").select("id").first()
    return D.similar_to(fp, first[0] if first else "", 0.5).select("id", F.round("similarity", 9).alias("similarity"))


@query(
    f"""WITH {_NEAR} SELECT round(1 - bit_count(xor(a.p_hash, b.p_hash))::DOUBLE / 64, 6) AS p_similarity, count(*) AS n FROM np JOIN cls a ON a.id = id_a JOIN cls b ON b.id = id_b
    WHERE a.p_hash <> 0 AND b.p_hash <> 0 GROUP BY 1"""
)
def plain_hash_similarity(spark, d):
    fp = images(spark, d)
    h = fp.select("id", F.col("perceptual_hashes.p_hash").alias("h")).where("h <> 0")
    pairs = D.near_pairs(fp, NEAR).join(h.select(F.col("id").alias("id_a"), F.col("h").alias("ha")), "id_a").join(h.select(F.col("id").alias("id_b"), F.col("h").alias("hb")), "id_b")
    return pairs.groupBy(F.round(S.plain_similarity(F.col("ha"), F.col("hb")), 6).alias("p_similarity")).agg(F.count("*").alias("n"))


# --- clustering -----------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {_NEAR}, e AS (SELECT id_a AS a, id_b AS b FROM np UNION ALL SELECT id_b, id_a FROM np), core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) + 1 >= 3),
    ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)), reach(id, k) AS (SELECT id, id FROM core UNION SELECT ce.b, r.k FROM reach r JOIN ce ON ce.a = r.id WHERE r.k < ce.b),
    root AS (SELECT id, min(k) AS cluster FROM reach GROUP BY 1)
    SELECT id, cluster, true AS core FROM root UNION ALL SELECT e.a, min(root.cluster), false FROM e JOIN root ON root.id = e.b WHERE e.a NOT IN (FROM core) GROUP BY 1"""
)
def dbscan_clusters(spark, d):
    fp = images(spark, d)
    pairs, _ = stage(D.near_pairs(fp, NEAR), "near")
    return clustering.dbscan(fp.select("id"), pairs, 3)


@query(
    f"""WITH RECURSIVE {_NEAR}, e AS (SELECT id_a AS a, id_b AS b FROM np UNION ALL SELECT id_b, id_a FROM np),
    core AS (SELECT id FROM (SELECT id, copies FROM cls UNION ALL SELECT e.a, cls.copies FROM e JOIN cls ON cls.id = e.b) GROUP BY 1 HAVING sum(copies) >= 3),
    ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)), reach(id, k) AS (SELECT id, id FROM core UNION SELECT ce.b, r.k FROM reach r JOIN ce ON ce.a = r.id WHERE r.k < ce.b),
    root AS (SELECT id, min(k) AS cluster FROM reach GROUP BY 1),
    found AS (SELECT id AS rep, cluster, true AS core FROM root UNION ALL SELECT e.a, min(root.cluster), false FROM e JOIN root ON root.id = e.b WHERE e.a NOT IN (FROM core) GROUP BY 1)
    SELECT hs.id, cluster, core FROM hs JOIN cls USING (a_hash, p_hash, d_hash, w_hash) JOIN found ON found.rep = cls.id"""
)
def dbscan_image_clusters(spark, d):
    """Every image counts and is put out; ``dbscan_clusters``, as its SQL, sees one representative of each set of equal hashes."""
    return clustering.dbscan_images(images(spark, d), NEAR, 3)


@query(
    f"""WITH RECURSIVE {_NEAR}, e AS (SELECT id_a AS a, id_b AS b FROM np UNION ALL SELECT id_b, id_a FROM np), reach(id, k) AS (SELECT a, a FROM e UNION SELECT e.b, r.k FROM reach r JOIN e ON e.a = r.id WHERE r.k < e.b),
    node AS MATERIALIZED (SELECT cls.*, root FROM cls JOIN (SELECT id, min(k) AS root FROM reach GROUP BY 1) USING (id)),
    sims AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_sim("a", "b")} AS s FROM node a JOIN node b ON a.root = b.root AND a.id <> b.id),
    st AS (SELECT 0 AS i, root, id, id AS cl, copies AS w FROM node
      UNION ALL SELECT i + 1, root, m.id, CASE WHEN m.cl = best.hi THEN best.lo ELSE m.cl END, m.w FROM (SELECT i, root, best, unnest(ms) AS m FROM (
        SELECT i, root, any_value(ms) AS ms, arg_min({{'lo': lo, 'hi': hi}}, (-far, lo, hi)) AS best FROM (
          SELECT i, root, any_value(ms) AS ms, p.x.cl AS lo, q.x.cl AS hi, round(sum(s * p.x.w * q.x.w) / sum(p.x.w * q.x.w), 12) AS far FROM (SELECT i, root, list({{'id': id, 'cl': cl, 'w': w}}) AS ms FROM st GROUP BY 1, 2) g, unnest(g.ms) p(x), unnest(g.ms) q(x)
            JOIN sims ON sims.a = p.x.id AND sims.b = q.x.id WHERE p.x.cl < q.x.cl GROUP BY 1, 2, 4, 5) WHERE far >= {NEAR}::DOUBLE - 1e-12 GROUP BY 1, 2))),
    done AS (SELECT id, arg_max(cl, i) AS cluster FROM st GROUP BY 1)
    SELECT hs.id, coalesce(done.cluster, cls.id) AS cluster FROM hs JOIN cls USING (a_hash, p_hash, d_hash, w_hash) LEFT JOIN done ON done.id = cls.id WHERE done.id IS NOT NULL OR cls.copies > 1"""
)
def agglomerative_clusters(spark, d):
    return clustering.agglomerative_images(images(spark, d), NEAR)


@query(
    """WITH RECURSIVE v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
    dist AS MATERIALIZED (SELECT a.id AS a, b.id AS b, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a, v b),
    st AS (SELECT 0 AS i, row_number() OVER (ORDER BY id) - 1 AS c, id AS m FROM (SELECT id FROM v ORDER BY id LIMIT 8)
      UNION ALL SELECT any_value(i) + 1, c, arg_min(id, (cost, id)) FROM (SELECT i, c, p.x AS id, round(sum(d), 9) AS cost
        FROM (SELECT i, c, list(id) AS ids FROM (SELECT i, dist.b AS id, arg_min(c, (d, c)) AS c FROM st JOIN dist ON dist.a = st.m WHERE i < 60 GROUP BY i, dist.b) GROUP BY i, c) g,
          unnest(g.ids) p(x), unnest(g.ids) q(x) JOIN dist ON dist.a = p.x AND dist.b = q.x GROUP BY i, c, p.x) GROUP BY c)
    SELECT dist.b AS id, arg_min(c, (d, c))::INT AS cluster, arg_min(m, (d, c)) AS medoid FROM st JOIN dist ON dist.a = st.m WHERE i = 60 GROUP BY 1"""
)
def k_medoid_clusters(spark, d):
    """Goes on until the medoids settle; the SQL goes on for sixty rounds, after which they stay."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return clustering.k_medoids(rows, 8, lambda a, b: 1 - S.cosine(a, b), max_rounds=100)


_LSH = dict(dim=64, tables=2, bits=6)


def _lsh_sql(tables: int = 2, bits: int = 6) -> str:
    one = lambda t: " + ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {lsh.hyperplane(t, b, 64)}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END" for b in range(bits))
    return " UNION ALL ".join(f"SELECT vec_id AS id, {t} AS tbl, ({one(t)})::BIGINT AS bucket FROM embeddings WHERE len(embedding) = 64" for t in range(tables))


@query(
    f"""SELECT count(DISTINCT tbl) AS num_tables, count(*) AS total_buckets, sum(n)::BIGINT AS total_items, max(n) AS max_bucket, round(avg(n), 6) AS avg_bucket
    FROM (SELECT tbl, bucket, count(*) AS n FROM ({_lsh_sql()}) GROUP BY 1, 2)"""
)
def lsh_bucket_stats(spark, d):
    return lsh.bucket_stats(lsh.index(table(spark, d, "embeddings"), "vec_id", "embedding", **_LSH)).withColumn("avg_bucket", F.round("avg_bucket", 6))


@query(
    f"""WITH x AS ({_lsh_sql()}) SELECT q.id AS query, x.id, count(*) AS tables FROM x JOIN x q USING (tbl, bucket) WHERE q.id % 100 = 0 AND q.id <> x.id GROUP BY 1, 2"""
)
def lsh_candidates(spark, d):
    """Every vector whose id is divisible by 100 is a query against all vectors."""
    x = lsh.index(table(spark, d, "embeddings"), "vec_id", "embedding", **_LSH)
    return lsh.candidates(x, x.where("id % 100 = 0"))


#: Chosen by recall against brute force: at sf0.1 they find 0.95 of the ten nearest of the query vectors (2 tables of 6 bits: 0.075).
_LSH_WIDE = dict(dim=64, tables=32, bits=5)


@query(
    f"""WITH x AS ({_lsh_sql(32, 5)}), hit AS (SELECT DISTINCT q.id AS query, x.id FROM x JOIN x q USING (tbl, bucket) WHERE q.id % 100 = 0 AND q.id <> x.id)
    SELECT query, id, round(s, 9) AS cosine FROM (SELECT query, hit.id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM hit JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = hit.id)
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10"""
)
def lsh_neighbours(spark, d):
    """The ten nearest of the query vectors of ``lsh_candidates``, by an index wide enough for a recall of 0.9."""
    found = lsh.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, 10, **_LSH_WIDE)
    return found.withColumn("cosine", F.round("cosine", 9))


# --- vectors ---------------------------------------------------------------------------------------------


@query(
    """WITH u AS (SELECT DISTINCT ON (id) id, color_histogram AS v FROM fingerprints
      WHERE len(color_histogram) = 48 AND NOT list_contains([isfinite(x) FOR x IN color_histogram], false) AND list_sum([abs(x) FOR x IN color_histogram]) > 0),
    f AS (SELECT v AS w FROM u ORDER BY id LIMIT 1)
    SELECT id, round(list_distance(v, w), 6) AS euclid, round(list_cosine_similarity(v, w), 6) AS cosine, round(list_sum([abs(v[i] - w[i]) FOR i IN range(1, 49)]), 6) AS manhattan,
      round(list_sum([CASE WHEN v[i] + w[i] > 0 THEN (v[i] - w[i]) * (v[i] - w[i]) / (v[i] + w[i]) ELSE 0 END FOR i IN range(1, 49)]) / 2, 6) AS chi2,
      round(1 / (1 + list_sum([CASE WHEN v[i] + w[i] > 0 THEN (v[i] - w[i]) * (v[i] - w[i]) / (v[i] + w[i]) ELSE 0 END FOR i IN range(1, 49)]) / 2), 6) AS hist_similarity FROM u, f"""
)
def histogram_distances(spark, d):
    """Distances of every usable colour histogram from the one of the smallest id."""
    h = F.col("color_histogram")
    finite = F.forall(h, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, d, "fingerprints").where((F.size(h) == 48) & finite & F.exists(h, lambda x: x != 0)).select("id", h.alias("v")).dropDuplicates(["id"])
    target = rows.orderBy("id").select("v").first()
    w = F.array(*[F.lit(float(x)) for x in (target[0] if target else [0.0])])
    v = F.col("v")
    cols = {"euclid": S.euclidean(v, w), "cosine": S.cosine(v, w), "manhattan": S.manhattan(v, w), "chi2": S.chi_squared(v, w), "hist_similarity": S.histogram_similarity(v, w)}
    return rows.select("id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


# --- grids: hashes and quality ------------------------------------------------------------------------------

_GRID = """grid AS (SELECT vec_id, [CASE WHEN list_max(embedding) = list_min(embedding) THEN 0 ELSE floor((x::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) * 255)::INT END FOR x IN embedding] AS g
  FROM embeddings WHERE len(embedding) = 64), px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, i, g[i + 1] AS v FROM grid, range(64) t(i)),
  inn AS (SELECT c.vec_id, c.x, c.y, c.v, l.v AS l, r.v AS r, u.v AS u, b.v AS b, ul.v AS ul, ur.v AS ur, bl.v AS bl, br.v AS br FROM px c
    JOIN px l ON l.vec_id = c.vec_id AND l.x = c.x - 1 AND l.y = c.y JOIN px r ON r.vec_id = c.vec_id AND r.x = c.x + 1 AND r.y = c.y
    JOIN px u ON u.vec_id = c.vec_id AND u.x = c.x AND u.y = c.y - 1 JOIN px b ON b.vec_id = c.vec_id AND b.x = c.x AND b.y = c.y + 1
    JOIN px ul ON ul.vec_id = c.vec_id AND ul.x = c.x - 1 AND ul.y = c.y - 1 JOIN px ur ON ur.vec_id = c.vec_id AND ur.x = c.x + 1 AND ur.y = c.y - 1
    JOIN px bl ON bl.vec_id = c.vec_id AND bl.x = c.x - 1 AND bl.y = c.y + 1 JOIN px br ON br.vec_id = c.vec_id AND br.x = c.x + 1 AND br.y = c.y + 1)"""
_BIT = "CASE WHEN {b} = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << {b}) END"


def _grid(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", G.to_gray(F.col("embedding")).alias("g"))


@query(
    f"""WITH {_GRID}, m AS (SELECT vec_id, sum(v) // 64 AS mean, avg(v) AS fm FROM px GROUP BY 1)
    SELECT vec_id, coalesce(sum({_BIT.format(b="i")}) FILTER (v > mean), 0)::BIGINT AS a_hash,
      (SELECT coalesce(sum({_BIT.format(b="(y * 7 + x)")}), 0)::BIGINT FROM (SELECT p.x, p.y, p.v, q.v AS n FROM px p JOIN px q ON q.vec_id = p.vec_id AND q.y = p.y AND q.x = p.x + 1 WHERE p.vec_id = px.vec_id) WHERE n > v) AS d_hash,
      coalesce(sum({_BIT.format(b="i")}) FILTER (v > fm), 0)::BIGINT AS fold_hash
    FROM px JOIN m USING (vec_id) GROUP BY vec_id"""
)
def grid_hashes(spark, d):
    g = F.col("g")
    return _grid(spark, d).select("vec_id", S.grid_average_hash(g).alias("a_hash"), S.grid_difference_hash(g).alias("d_hash"), S.grid_fold_hash(g).alias("fold_hash"))


@query(
    f"""WITH {_GRID}, a AS (SELECT vec_id, least(avg(abs(4 * v - l - r - u - b)) / 100, 1) AS sharpness,
      least(coalesce(avg(sqrt(greatest((l*l + r*r + u*u + b*b + ul*ul + ur*ur + bl*bl + br*br) / 8.0::DOUBLE - ((l + r + u + b + ul + ur + bl + br) / 8.0::DOUBLE) ** 2, 0))) FILTER (abs(v - (l + r + u + b + ul + ur + bl + br) / 8.0::DOUBLE) < 10) / 50, 0.5), 1) AS noise,
      (count(*) FILTER (mag > 50)) / 64.0::DOUBLE AS strong, (count(*) FILTER (mag > 20 AND mag <= 50)) / 64.0::DOUBLE AS medium, (count(*) FILTER (mag > 5 AND mag <= 20)) / 64.0::DOUBLE AS weak
      FROM (SELECT *, sqrt((ur + 2 * r + br - ul - 2 * l - bl) ** 2 + (bl + 2 * b + br - ul - 2 * u - ur) ** 2) AS mag FROM inn) GROUP BY 1),
    p AS (SELECT vec_id, avg(v / 255.0::DOUBLE) AS m, avg((v / 255.0::DOUBLE) ** 2) AS m2, avg((v / 255.0::DOUBLE < 0.1::DOUBLE)::INT) AS dark, avg((v / 255.0::DOUBLE > 0.9::DOUBLE)::INT) AS bright FROM px GROUP BY 1)
    SELECT vec_id, round(sharpness, 6) AS sharpness, round(noise, 6) AS noise,
      round(greatest(0, least(1, m - CASE WHEN dark > 0.3::DOUBLE THEN (dark - 0.3::DOUBLE) * 0.5::DOUBLE ELSE 0 END + CASE WHEN bright > 0.3::DOUBLE THEN (bright - 0.3::DOUBLE) * 0.5::DOUBLE ELSE 0 END)), 6) AS exposure,
      round(least(sqrt(greatest(0, m2 - m * m)) / 0.4::DOUBLE, 1), 6) AS contrast, round(strong, 6) AS strong, round(medium, 6) AS medium, round(weak, 6) AS weak FROM a JOIN p USING (vec_id)"""
)
def grid_quality(spark, d):
    g = F.col("g")
    cols = {"sharpness": G.sharpness(g), "noise": G.noise(g), "exposure": G.exposure(g), "contrast": G.contrast(g)}
    rows = _grid(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in cols.items()], G.edges(g).alias("e"))
    return rows.select("vec_id", *cols, *[F.round(f"e.{k}", 6).alias(k) for k in ("strong", "medium", "weak")])


@query(f"WITH {_GRID} SELECT vec_id, floor(v / 255.0::DOUBLE * 15)::INT AS bin, round(count(*) / 64.0::DOUBLE, 6) AS share FROM px GROUP BY 1, 2")
def luminance_histogram(spark, d):
    rows = _grid(spark, d).select("vec_id", F.posexplode(G.histogram(F.col("g"))).alias("bin", "share"))
    return rows.where("share > 0").select("vec_id", "bin", F.round("share", 6).alias("share"))


@query(
    f"""WITH {_GRID}, m AS (SELECT vec_id, sum(w) AS m00, sum(x * w) AS m10, sum(y * w) AS m01, sum(x * y * w) AS m11, sum(x * x * w) AS m20, sum(y * y * w) AS m02 FROM (SELECT *, v / 255.0::DOUBLE AS w FROM px) GROUP BY 1)
    SELECT vec_id, round(m00, 6) AS mass, round(m10 / m00, 6) AS cx, round(m01 / m00, 6) AS cy, round(m20 - m10 * m10 / m00 + m02 - m01 * m01 / m00, 4) AS hu1,
      round(((m20 - m10 * m10 / m00) - (m02 - m01 * m01 / m00)) ** 2 + 4 * (m11 - m10 * m01 / m00) ** 2, 2) AS hu2 FROM m"""
)
def grid_moments(spark, d):
    rows = _grid(spark, d).select("vec_id", G.moments(F.col("g")).alias("m"))
    return rows.select("vec_id", *[F.round(f"m.{k}", n).alias(k) for k, n in (("mass", 6), ("cx", 6), ("cy", 6), ("hu1", 4), ("hu2", 2))])


@query(
    f"""WITH {_GRID}, c AS (SELECT label, v // 16 * 16 AS level, count(*) AS n FROM px JOIN embeddings USING (vec_id) GROUP BY 1, 2)
    SELECT label, level, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, level) AS rank, count(*) OVER (PARTITION BY label) AS kinds FROM c) WHERE rank <= 5 AND n > kinds // 20"""
)
def dominant_levels(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "embeddings").where(F.size("embedding") == 64).select("label", F.explode(G.to_gray(F.col("embedding"))).alias("v"))
    c = g.groupBy("label", (F.floor(F.col("v") / 16) * 16).cast("int").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), "level")
    ranked = c.withColumn("rank", F.row_number().over(w)).withColumn("kinds", F.count("*").over(Window.partitionBy("label")))
    return ranked.where((F.col("rank") <= 5) & (F.col("n") > F.floor(F.col("kinds") / 20))).select("label", "level", "n", "rank")


# --- quality of fingerprints ---------------------------------------------------------------------------------

_Q = "quality.{}"
_SUBS = "quality.sharpness AS s, 1 - quality.noise AS n, 1 - abs(quality.exposure - 0.5::DOUBLE) * 2 AS e, quality.contrast AS c, 1 - quality.compression AS m, 1 - quality.color_cast AS k"


def _clean_quality(spark, d) -> DataFrame:
    fp = images(spark, d)
    ok = F.lit(True)
    for m in METRICS:
        q = F.col(f"quality.{m}")
        ok = ok & q.isNotNull() & ~F.isnan(q) & (F.abs(q) < 1e6)
    return fp.where(ok)


_FINITE = " AND ".join(f"isfinite(quality.{m}) AND abs(quality.{m}) < 1e6" for m in METRICS)


@query(
    f"""WITH {FP}, x AS (SELECT id, {_SUBS} FROM fp WHERE {_FINITE})
    SELECT id, round(greatest(0, least(100, (s * 0.3::DOUBLE + n * 0.25::DOUBLE + e * 0.2::DOUBLE + c * 0.15::DOUBLE + m * 0.05::DOUBLE + k * 0.05::DOUBLE) * 100)), 4) AS score,
      round(greatest(0, least(100, (s + n + e + c + m + k) / 6 * 100)), 4) AS even_score, round(s * 100, 4) AS sharpness_score, round(e * 100, 4) AS exposure_score FROM x"""
)
def final_scores(spark, d):
    q = lambda m: F.col(f"quality.{m}")
    even = S.normalised(dict.fromkeys(METRICS, 1.0))
    sub = S.subscores(q)
    return _clean_quality(spark, d).select("id", F.round(S.final_score(q), 4).alias("score"), F.round(S.final_score(q, even), 4).alias("even_score"), F.round(sub["sharpness"] * 100, 4).alias("sharpness_score"), F.round(sub["exposure"] * 100, 4).alias("exposure_score"))


_TIER = "CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 50 THEN 'average' WHEN s >= 30 THEN 'poor' ELSE 'very_poor' END"


@query(
    f"""WITH {FP}, x AS (SELECT quality.final_score AS s, quality.sharpness AS sh, quality.exposure AS ex, metadata.size_bytes AS b FROM fp WHERE {_FINITE} AND isfinite(quality.final_score))
    SELECT {_TIER} AS tier, count(*) AS n, count(*) FILTER (sh < 0.1::DOUBLE) AS blurry, count(*) FILTER (ex > 0.9::DOUBLE) AS over, count(*) FILTER (ex < 0.1::DOUBLE) AS under,
      count(*) FILTER (s < 50) AS low, sum(b)::BIGINT AS total_bytes FROM x GROUP BY 1"""
)
def quality_tiers(spark, d):
    q = lambda m: F.col(f"quality.{m}")
    s = q("final_score")
    rows = _clean_quality(spark, d).where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    return rows.groupBy(S.quality_tier(s).alias("tier")).agg(
        F.count("*").alias("n"), F.count_if(S.is_blurry(q("sharpness"))).alias("blurry"), F.count_if(S.is_overexposed(q("exposure"))).alias("over"),
        F.count_if(S.is_underexposed(q("exposure"))).alias("under"), F.count_if(S.is_low_quality(s)).alias("low"), F.sum(_META("size_bytes")).alias("total_bytes"),
    )


# --- colour ----------------------------------------------------------------------------------------------------

_RGB = f"SELECT path || ':' || (y * 32 + x) AS id, path, (r * 257)::INT AS r, (g * 257)::INT AS g, (b * 257)::INT AS b FROM (WITH {pictures._PX} SELECT * FROM px)"


def _colours(spark, d) -> DataFrame:
    """Every pixel of the pictures as 16-bit channels."""
    i = pictures.pictures(spark, d).select("path", F.posexplode(F.expr("transform(sequence(0, 1023), i -> substring(data, 3 * i + 1, 3))")).alias("at", "p"))
    c = lambda k: (F.conv(F.hex(F.substring("p", k, 1)), 16, 10).cast("int") * 257)
    return i.select(F.concat_ws(":", "path", F.col("at").cast("string")).alias("id"), "path", c(3).alias("r"), c(2).alias("g"), c(1).alias("b"))


@query(
    f"""WITH c AS ({_RGB}), n AS (SELECT *, r / 65535.0::DOUBLE AS x, g / 65535.0::DOUBLE AS y, b / 65535.0::DOUBLE AS z FROM c), m AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM n)
    SELECT id, round(CASE WHEN hi = lo THEN 0 WHEN hi = x THEN (y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END WHEN hi = y THEN (z - x) / (hi - lo) + 2 ELSE (x - y) / (hi - lo) + 4 END / 6, 6) AS h,
      round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 6) AS s, round(hi, 6) AS v FROM m"""
)
def rgb_to_hsv(spark, d):
    rows = _colours(spark, d).select("id", S.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return rows.select("id", *[F.round(f"c.{k}", 6).alias(k) for k in "hsv"])


@query(f"SELECT id, r // 257 AS r, g // 257 AS g, b // 257 AS b FROM ({_RGB})")
def hsv_round_trip(spark, d):
    """The pixels again from their hue, saturation and value, as 8-bit channels."""
    hsv = _colours(spark, d).select("id", S.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    rgb = hsv.select("id", S.hsv_to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v")).alias("c"))
    return rgb.select("id", *[F.round(F.col(f"c.{k}") / 257).cast("int").alias(k) for k in "rgb"])


_LIN = "(CASE WHEN {c} / 65535.0::DOUBLE > 0.04045::DOUBLE THEN pow(({c} / 65535.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {c} / 65535.0::DOUBLE / 12.92::DOUBLE END * 100)"
_CUBE = "(CASE WHEN {t} > 0.008856::DOUBLE THEN pow({t}, 1 / 3.0::DOUBLE) ELSE {t} * 7.787::DOUBLE + 16 / 116.0::DOUBLE END)"


@query(
    f"""WITH c AS ({_RGB}), l AS (SELECT id, {_LIN.format(c="r")} AS r, {_LIN.format(c="g")} AS g, {_LIN.format(c="b")} AS b FROM c),
    x AS (SELECT id, (r * 0.4124564::DOUBLE + g * 0.3575761::DOUBLE + b * 0.1804375::DOUBLE) / 95.047::DOUBLE AS x, (r * 0.2126729::DOUBLE + g * 0.7151522::DOUBLE + b * 0.0721750::DOUBLE) / 100 AS y,
      (r * 0.0193339::DOUBLE + g * 0.1191920::DOUBLE + b * 0.9503041::DOUBLE) / 108.883::DOUBLE AS z FROM l),
    f AS (SELECT id, {_CUBE.format(t="x")} AS x, {_CUBE.format(t="y")} AS y, {_CUBE.format(t="z")} AS z FROM x), q AS (SELECT id, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f)
    SELECT id, round(l, 4) + 0 AS l, round(a, 4) + 0 AS a, round(b, 4) + 0 AS b, round(sqrt((l - 100) ** 2 + a ** 2 + b ** 2), 4) AS from_white, sqrt((l - 100) ** 2 + a ** 2 + b ** 2) <= 60 AS light FROM q"""
)
def rgb_to_lab(spark, d):
    rows = _colours(spark, d).select("id", S.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    white = F.struct(F.lit(100.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    e = S.delta_e(F.col("c"), white)
    return rows.select("id", *[(F.round(f"c.{k}", 4) + F.lit(0.0)).alias(k) for k in "lab"], F.round(e, 4).alias("from_white"), (e <= 60).alias("light"))


@query(
    f"""WITH c AS ({_RGB}), s AS (SELECT path AS part, sum(r)::DOUBLE / sum(b) AS x, sum(b) AS b FROM c GROUP BY 1)
    SELECT part, CASE WHEN x > 1.2::DOUBLE THEN 'warm' WHEN x < 0.8::DOUBLE THEN 'cool' ELSE 'neutral' END AS kind,
      round(CASE WHEN x > 1.2::DOUBLE THEN least((x - 1.2::DOUBLE) / 0.8::DOUBLE, 1) WHEN x < 0.8::DOUBLE THEN (0.8::DOUBLE - x) / 0.8::DOUBLE ELSE 0 END, 6) AS strength FROM s WHERE b <> 0"""
)
def color_temperature(spark, d):
    s = _colours(spark, d).groupBy(F.col("path").alias("part")).agg(F.sum("r").alias("r"), F.sum("b").alias("b")).where("b <> 0")
    return s.select("part", S.temperature(F.col("r"), F.col("b")).alias("t")).select("part", "t.kind", F.round("t.strength", 6).alias("strength"))


# --- clean-up and reports -----------------------------------------------------------------------------------------

_BYTES = "CASE WHEN b < 1024 THEN b || ' B' " + " ".join(f"WHEN b < 1024::DOUBLE ** {i + 1} THEN printf('%.1f {u}B', b / 1024::DOUBLE ** {i})" for i, u in enumerate("KMGT", 1)) + " ELSE printf('%.1f PB', b / 1024::DOUBLE ** 5) END"


@query(
    rf"""WITH {_EXACT}, best AS (SELECT sha, id AS main_image FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY {_SCORE} DESC NULLS LAST, id) = 1),
    grp AS (SELECT 'exact_' || row_number() OVER (ORDER BY first) AS group_id, sha, main_image FROM (SELECT sha, min(id) AS first FROM ex GROUP BY 1) JOIN best USING (sha)),
    r AS (SELECT ex.id, group_id, metadata.path AS src, coalesce(metadata.size_bytes, 0) AS size_bytes, 'out/' || group_id || '/' || regexp_extract(metadata.path, '([^/]*)/*$', 1) AS dest FROM ex JOIN grp USING (sha) WHERE ex.id <> main_image),
    k AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY id) - 1 AS k FROM r)
    SELECT id, group_id, src, size_bytes, CASE WHEN k = 0 THEN dest ELSE regexp_replace(dest, '(\.[^./]*)$', '') || '_' || k || regexp_extract(dest, '(\.[^./]*)$', 1) END AS dst, 'move' AS action FROM k"""
)
def exact_clean_plan(spark, d):
    fp = images(spark, d)
    o = cleanup.CleanOptions(output="out")
    groups = D.exact_groups(fp)
    rows = D.exact_members(fp).select("id", "sha", _META("path").alias("src"), F.coalesce(_META("size_bytes"), F.lit(0)).alias("size_bytes"))
    rows = rows.join(groups.select("sha", "group_id", "main_image"), "sha").where("id <> main_image").drop("sha", "main_image")
    return cleanup.with_destinations(rows, o)


_REST = f"""{FP.replace("fp AS", "every AS", 1)}, ex AS (SELECT *, metadata.sha256 AS sha, count(*) OVER (PARTITION BY metadata.sha256) AS n FROM every WHERE metadata.sha256 IS NOT NULL QUALIFY n > 1),
xb AS (SELECT sha, id AS main_image FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY {_SCORE} DESC NULLS LAST, id) = 1),
xg AS (SELECT 'exact_' || row_number() OVER (ORDER BY first) AS group_id, sha, main_image FROM (SELECT sha, min(id) AS first FROM ex GROUP BY 1) JOIN xb USING (sha)),
xc AS (SELECT ex.id, group_id, 'exact' AS reason FROM ex JOIN xg USING (sha) WHERE ex.id <> main_image),
fp AS (SELECT * FROM every WHERE id NOT IN (SELECT id FROM xc))"""


@query(
    rf"""WITH RECURSIVE {_GREEDY.replace(FP, _REST, 1)}, nb AS (SELECT leader, id AS main_image FROM ng JOIN fp USING (id) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY {_SCORE} DESC NULLS LAST, id) = 1),
    nn AS (SELECT 'near_' || row_number() OVER (ORDER BY leader) AS group_id, leader, main_image FROM nb),
    pl AS (SELECT * FROM xc UNION ALL SELECT ng.id, group_id, 'near' FROM ng JOIN nn USING (leader) WHERE ng.id <> main_image),
    r AS (SELECT pl.*, metadata.path AS src, coalesce(metadata.size_bytes, 0) AS size_bytes, 'out/' || group_id || '/' || regexp_extract(metadata.path, '([^/]*)/*$', 1) AS dest FROM pl JOIN every USING (id)
      WHERE reason = 'exact' OR coalesce({_SCORE}, -1) >= 50)
    SELECT id, group_id, reason, src, size_bytes, CASE WHEN k = 0 THEN dest ELSE regexp_replace(dest, '(\.[^./]*)$', '') || '_' || k || regexp_extract(dest, '(\.[^./]*)$', 1) END AS dst, 'move' AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY id) - 1 AS k FROM r)"""
)
def clean_plan_quality_gate(spark, d):
    return cleanup.clean_plan(images(spark, d), cleanup.CleanOptions(threshold=NEAR, min_quality=50.0, output="out"))


@query(f"SELECT id, false AS done, dst, NULL::VARCHAR AS error FROM ({_SQL['exact_clean_plan']})")
def clean_dry_run(spark, d):
    """What an application would do, without touching a file."""
    return cleanup.apply_plan(exact_clean_plan(spark, d), dry_run=True)


@query(
    f"""WITH {_EXACT}, best AS (SELECT sha, id FROM ex QUALIFY row_number() OVER (PARTITION BY sha ORDER BY {_SCORE} DESC NULLS LAST, id) = 1),
    s AS (SELECT count(*) AS files, coalesce(sum(coalesce(metadata.size_bytes, 0)), 0)::BIGINT AS b FROM ex WHERE id NOT IN (SELECT id FROM best))
    SELECT files, b AS freed_bytes, {_BYTES} AS freed_text, files * 5242880 AS estimate_bytes FROM s"""
)
def freed_space(spark, d):
    return cleanup.freed_space(exact_clean_plan(spark, d))


@query(
    f"""WITH {FP}, x AS (SELECT {_SCORE} AS s, metadata.size_bytes / 1048576.0::DOUBLE AS mb, coalesce(lower(metadata.format), 'unknown') AS f FROM fp),
    y AS (SELECT 'quality' AS dimension, CASE WHEN s IS NULL THEN 'unknown' ELSE {_TIER} END AS bucket FROM x UNION ALL SELECT 'format', f FROM x
      UNION ALL SELECT 'size', CASE WHEN mb < 1 THEN 'under_1MB' WHEN mb < 5 THEN '1_to_5MB' WHEN mb < 20 THEN '5_to_20MB' WHEN mb IS NOT NULL THEN 'over_20MB' ELSE 'unknown' END FROM x)
    SELECT dimension, bucket, count(*) AS n FROM y GROUP BY 1, 2"""
)
def report_distributions(spark, d):
    return reports.distribution(images(spark, d))


def _report(spark, d) -> DataFrame:
    fp = images(spark, d)
    groups, _ = stage(D.near_groups(fp, NEAR), "near")
    return reports.scan_report(fp, D.exact_groups(fp), groups.groupBy("leader").agg(F.count("*").alias("n_members")))


_REPORT = f"""{_GREEDY}, ex AS (SELECT metadata.sha256 AS sha, count(*) AS n FROM fp WHERE metadata.sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
rep AS (SELECT (SELECT count(*) FROM fp) AS processed_images, (SELECT round(coalesce(sum(metadata.size_bytes / 1048576.0::DOUBLE), 0), 6) FROM fp) AS total_size_mb,
  (SELECT round(coalesce(avg(metadata.size_bytes / 1048576.0::DOUBLE), 0), 6) FROM fp) AS average_file_size_mb, (SELECT round(coalesce(avg({_SCORE}), 0), 6) FROM fp) AS average_quality,
  (SELECT count(*) FROM ex) AS exact_duplicate_count, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM ex) AS exact_removable,
  (SELECT count(DISTINCT leader) FROM ng) AS near_duplicate_count, (SELECT count(*) - count(DISTINCT leader) FROM ng) AS near_removable)"""


@query(f"WITH RECURSIVE {_REPORT} SELECT * REPLACE (round(total_size_mb, 3) AS total_size_mb) FROM rep")
def report_summary(spark, d):
    return _report(spark, d).withColumn("total_size_mb", F.round("total_size_mb", 3))


@query(
    f"""WITH RECURSIVE {_REPORT} SELECT 'storage_optimization' AS type, 'high' AS priority, 'Found ' || exact_duplicate_count || ' exact duplicate groups' AS description, 'Run clean command to remove exact duplicates' AS action, 'storage' AS impact, 1.0::DOUBLE AS confidence FROM rep WHERE exact_duplicate_count > 0
    UNION ALL SELECT 'organization', 'medium', 'Found ' || near_duplicate_count || ' near-duplicate groups', 'Review near-duplicates and keep best quality versions', 'organization', 0.8::DOUBLE FROM rep WHERE near_duplicate_count > 0
    UNION ALL SELECT 'quality_audit', 'low', 'Large image collection detected', 'Consider running quality analysis on all images', 'quality', 0.6::DOUBLE FROM rep WHERE processed_images > 100"""
)
def report_recommendations(spark, d):
    return reports.recommendations(_report(spark, d))


@query(f"WITH {_EXACT}, t AS (SELECT sha, id, row_number() OVER (PARTITION BY sha ORDER BY id) AS k, n FROM ex) SELECT sha, list(id ORDER BY id) FILTER (k <= 3) AS shown, greatest(any_value(n) - 3, 0) AS more FROM t GROUP BY 1")
def group_heads(spark, d):
    """The first three members of each exact group, as listings show them."""
    return reports.heads(D.exact_members(images(spark, d)).select("sha", "id"), "sha", 3)


def queries() -> dict:
    return {**_QUERIES, **pictures.queries(), **workflows.queries(), **problems.queries()}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **pictures.oracle_sql(), **workflows.oracle_sql(), **problems.oracle_sql()}
