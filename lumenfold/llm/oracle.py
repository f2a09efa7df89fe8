"""SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_IDS = r"""
ids AS (SELECT DISTINCT group_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS member
        FROM (SELECT group_id, unnest(list_concat([main_image], coalesce(duplicate_ids, []))) AS x FROM duplicate_groups)
        WHERE x IS NOT NULL AND regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''
          AND group_id IS NOT NULL)
"""

_POSITION = """coalesce(metadata.exif.has_gps AND isfinite(metadata.exif.gps_lat) AND isfinite(metadata.exif.gps_lon)
       AND metadata.exif.gps_lat <> 0 AND metadata.exif.gps_lon <> 0
       AND metadata.exif.gps_lat BETWEEN -90 AND 90 AND metadata.exif.gps_lon BETWEEN -180 AND 360, false)"""

P4 = f"""
WITH {_IDS},
facts AS (
  SELECT lower(trim(id)) AS member, arg_min(r, created_at) AS r FROM (
    SELECT id, created_at, {{
      'score': CASE WHEN quality.final_score BETWEEN 0 AND 100 AND NOT isnan(quality.final_score)
                 AND NOT (quality.final_score = 50 AND coalesce(quality.sharpness = 0, false) AND coalesce(quality.noise = 0, false)
                          AND coalesce(quality.exposure = 0, false) AND coalesce(quality.contrast = 0, false)
                          AND coalesce(quality.compression = 0, false) AND coalesce(quality.color_cast = 0, false))
                 THEN quality.final_score END,
      'area': nullif(greatest(metadata.width::BIGINT * metadata.height::BIGINT, 0), 0),
      'size': metadata.size_bytes, 'mtime': metadata.modified_at,
      'camera': coalesce(metadata.exif.camera_model NOT IN ('', 'Unknown JPEG Camera', 'Unknown PNG Source'), false),
      'taken': metadata.exif.taken_at IS NOT NULL, 'gps': {_POSITION}}} AS r FROM fingerprints)
  GROUP BY 1),
found AS (SELECT group_id, member, r FROM ids JOIN facts USING (member)),
big AS (SELECT group_id FROM found GROUP BY 1 HAVING count(*) >= 2),
fields AS (SELECT *, 'main_image' AS field_name FROM found
  UNION ALL SELECT *, 'camera_model' FROM found WHERE r.camera
  UNION ALL SELECT *, 'taken_at' FROM found WHERE r.taken
  UNION ALL SELECT *, 'gps' FROM found WHERE r.gps)
SELECT group_id, field_name, member AS image_id FROM fields WHERE group_id IN (FROM big)
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY r.score DESC NULLS LAST, r.area DESC NULLS LAST,
  r.size DESC NULLS LAST, r.mtime DESC NULLS LAST, member) = 1
"""

_SHA = r"regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^sha256:', ''), '^\s+', '')"

P6 = f"""
WITH new AS (SELECT DISTINCT arrival_id, batch_no AS b,
    CASE WHEN regexp_full_match({_SHA.format(c="sha256")}, '[0-9a-f]{{64}}') THEN {_SHA.format(c="sha256")} END AS sha, nullif(p_hash, 0) AS h
  FROM incoming_images WHERE arrival_id IS NOT NULL AND batch_no IS NOT NULL),
old AS (SELECT {_SHA.format(c="metadata.sha256")} AS sha, nullif(perceptual_hashes.p_hash, 0) AS h FROM fingerprints),
shas AS (SELECT sha, min(b) AS first FROM (SELECT sha, -1 AS b FROM old UNION ALL SELECT sha, b FROM new) WHERE sha IS NOT NULL GROUP BY 1),
hs AS (SELECT h, min(b) AS first FROM (SELECT h, -1 AS b FROM old UNION ALL SELECT h, b FROM new) WHERE h IS NOT NULL GROUP BY 1),
near AS (SELECT n.h, min(hs.first) AS first FROM (SELECT DISTINCT h FROM new WHERE h IS NOT NULL) n
  JOIN hs ON bit_count(xor(n.h, hs.h)) <= 3 GROUP BY 1)
SELECT arrival_id, CASE WHEN s.first < b THEN 'exact' ELSE 'near' END AS kind
FROM new LEFT JOIN shas s ON new.sha = s.sha LEFT JOIN near ON new.h = near.h
WHERE s.first < b OR near.first < b
"""

P7 = f"""
WITH RECURSIVE {_IDS},
links AS (SELECT DISTINCT a.member AS a, b.member AS b FROM ids a JOIN (SELECT group_id, min(member) AS member FROM ids GROUP BY 1) b USING (group_id) WHERE a.member <> b.member),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, k) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.k FROM reach r JOIN both_ways e ON e.a = r.a WHERE r.k < e.b)
SELECT a AS image_id, min(k) AS group_key FROM reach GROUP BY 1
"""


P4_RECORDS = f"""
WITH p AS ({P4}), f AS (SELECT lower(trim(id)) AS image_id, any_value(metadata) AS m FROM fingerprints GROUP BY 1), r AS (SELECT p.*, m FROM p JOIN f USING (image_id))
SELECT group_id, max(image_id) FILTER (field_name = 'main_image') AS main_image, max(m.path) FILTER (field_name = 'main_image') AS path,
  max(m.size_bytes) FILTER (field_name = 'main_image') AS size_bytes, max(m.width) FILTER (field_name = 'main_image') AS width,
  max(m.height) FILTER (field_name = 'main_image') AS height, max(m.exif.camera_model) FILTER (field_name = 'camera_model') AS camera_model,
  epoch_us(max(m.exif.taken_at) FILTER (field_name = 'taken_at')) AS taken_us, max(m.exif.gps_lat) FILTER (field_name = 'gps') AS gps_lat,
  max(m.exif.gps_lon) FILTER (field_name = 'gps') AS gps_lon FROM r GROUP BY 1
"""


def _usable(field: str, dim: int) -> str:
    return f"""SELECT id, any_value({field}::DOUBLE[]) AS v FROM fingerprints WHERE id IS NOT NULL AND len({field}) = {dim}
      AND NOT list_contains([coalesce(isfinite(x), false) FOR x IN {field}], false) AND list_sum([abs(x) FOR x IN {field}]) > 0 GROUP BY 1"""


P1 = f"""
WITH u AS ({_usable("feature_vector", 52)}),
near AS (SELECT a.id, list(b.id ORDER BY b.id) AS ids FROM u a JOIN u b ON list_cosine_similarity(a.v, b.v) >= 0.83::DOUBLE GROUP BY 1)
SELECT id AS image_id, ids[1] AS cluster_key FROM near WHERE len(ids) >= 5 AND ids IN (SELECT ids FROM near GROUP BY 1 HAVING count(*) = len(ids))
"""


def _p5(field: str, dim: int) -> str:
    return f"""SELECT '{field}' AS vector_field, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (
      SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 10) AS s FROM ({_usable(field, dim)}) x JOIN ({_usable(field, dim)}) y ON x.id <> y.id
      WHERE s >= 0.985::DOUBLE QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) GROUP BY ALL"""


P5 = _p5("feature_vector", 52) + " UNION ALL " + _p5("color_histogram", 48)


P1_TYPICAL = f"""
WITH members AS ({P1}), u AS ({_usable("feature_vector", 52)}),
dims AS (SELECT cluster_key, image_id, i, x / sqrt(norm) AS x FROM (SELECT cluster_key, image_id, unnest(range(52)) AS i, unnest(v) AS x, list_dot_product(v, v) AS norm FROM members JOIN u ON u.id = image_id)),
centre AS (SELECT cluster_key, i, avg(x)::FLOAT::DOUBLE AS c FROM dims GROUP BY 1, 2),
near AS (SELECT cluster_key, image_id, round(sum(x * c), 6) AS s FROM dims JOIN centre USING (cluster_key, i) GROUP BY 1, 2)
SELECT cluster_key, count(*) AS n_images, round(max(s), 5) AS nearest FROM near GROUP BY 1
"""


def _facts(limit: int, more: str = "") -> str:
    return f"""SELECT doc_id, length(text) AS chars, 0::BIGINT AS begins, length(text) AS ends, 0::BIGINT AS above, CASE WHEN strlen(text) <= {limit} THEN 1::BIGINT END AS pieces_if_small{more}
      FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"""


#: The capacity and the limit of the queries.
P8, P10 = _facts(8192, ", 0::BIGINT AS containers_above"), _facts(1024)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p4_found": P4, "p4_records": P4_RECORDS, "p5_found": P5, "p6_found": P6, "p7_found": P7, "p1_typical": P1_TYPICAL, "p8_facts": P8, "p10_facts": P10}
