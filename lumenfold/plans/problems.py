"""Queries p2 and p3 over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import timetext
from lumenfold.operators import geo, timeline
from lumenfold.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = "metadata.exif"
    images = table(spark, sf_dir, "fingerprints").where(geo.has_position(F.col(f"{e}.gps_lat"), F.col(f"{e}.gps_lon"), F.col(f"{e}.has_gps")))
    points = images.select(F.col("id").alias("key"), F.col(f"{e}.gps_lat").alias("lat"), F.col(f"{e}.gps_lon").alias("lon")).where("key is not null")
    places = table(spark, sf_dir, "places").select(F.col("place_id").alias("site"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"), "radius_m", "ring")
    return geo.near_or_inside(points, places).select(F.col("key").alias("image_id"), F.col("site").alias("place_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "exif_reads")
    cameras = table(spark, sf_dir, "cameras").select("camera_id", "zone_name", "date_order")  # a fixed table of 60 rows
    both = reads.join(F.broadcast(cameras), "camera_id", "left")
    texts = F.array(
        F.struct(F.lit("taken_at").alias("field"), F.col("taken_at").alias("text"), F.col("taken_offset").alias("offset")),
        F.struct(F.lit("modified_at").alias("field"), F.col("modified_at").alias("text"), F.lit(None).cast("string").alias("offset")),
    )
    values = both.select(F.col("read_id").alias("record"), F.explode(texts).alias("x"), F.col("camera_id").alias("source"), "zone_name", "date_order")
    out = timeline.resolve(values.select("record", "x.field", "x.text", "x.offset", "source", "zone_name", "date_order"))
    return out.select(F.col("record").alias("read_id"), F.col("field").alias("field_name"), "utc_us")


def queries() -> dict:
    return {"p2_found": p2_found, "p3_found": p3_found}


_RAD = "pi() / 180"
P2 = f"""
WITH pts AS (SELECT DISTINCT id, metadata.exif.gps_lat AS la, metadata.exif.gps_lon AS lo FROM fingerprints
  WHERE metadata.exif.has_gps AND isfinite(metadata.exif.gps_lat) AND isfinite(metadata.exif.gps_lon) AND metadata.exif.gps_lat <> 0
    AND metadata.exif.gps_lon <> 0 AND metadata.exif.gps_lat BETWEEN -90 AND 90 AND metadata.exif.gps_lon BETWEEN -180 AND 360),
circles AS (SELECT p.id, s.place_id FROM pts p, places s WHERE s.ring IS NULL AND
  2 * 6371008.8::DOUBLE * asin(sqrt(least(1, sin((p.la - s.center_lat) * {_RAD} / 2) ** 2
    + cos(p.la * {_RAD}) * cos(s.center_lat * {_RAD}) * sin((p.lo - s.center_lon) * {_RAD} / 2) ** 2))) <= s.radius_m),
corners AS (SELECT place_id, i, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM places, range(1, 100) t(i) WHERE ring IS NOT NULL AND i <= len(ring)),
edges AS (SELECT place_id, a.lat AS la1, a.lon AS lo1, b.lat AS la2, (b.lon - a.lon + 900) % 360 - 180 AS step FROM corners),
east AS (SELECT place_id, CASE WHEN step >= 0 THEN lo1 ELSE lo1 + step END AS west, CASE WHEN step >= 0 THEN la1 ELSE la2 END AS wla,
  CASE WHEN step >= 0 THEN la2 ELSE la1 END AS ela, abs(step) AS span FROM edges WHERE step <> 0),
hits AS (SELECT p.id, e.place_id FROM pts p, east e WHERE (p.lo - e.west + 1080) % 360 < e.span
  AND e.wla + (e.ela - e.wla) * ((p.lo - e.west + 1080) % 360) / e.span > p.la)
SELECT id AS image_id, place_id FROM circles UNION SELECT id, place_id FROM hits GROUP BY 1, 2 HAVING count(*) % 2 = 1
"""


_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_TAIL = r"\s*(?P<tail>[^\s\d].*|)$"
_SHAPES_SQL = [
    r"^(?P<Y>\d{4})(?P<p>[-:/.])(?P<m>\d{1,2})(?P<q>[-:/.])(?P<d>\d{1,2})(?:[Tt]|,?\s+)" + _CLOCK + _TAIL,
    r"^(?P<Y>\d{4})(?P<p>)(?P<m>\d{2})(?P<q>)(?P<d>\d{2})[Tt_ -]?(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>)" + _TAIL,
    r"^(?P<d>\d{1,2})(?P<p>[-/.])(?P<m>\d{1,2})(?P<q>[-/.])(?P<Y>\d{4})(?:[Tt]|,?\s+)" + _CLOCK + _TAIL,
    r"^(?P<p>)(?:[A-Za-z]{3,9}\.?,?\s+)?(?P<d>\d{1,2})[\s-]+(?P<m>[A-Za-z]{3})[a-z]*\.?(?P<q>),?[\s-]+(?P<Y>\d{4}),?\s+" + _CLOCK + _TAIL,
    r"^(?P<p>)(?:[A-Za-z]{3,9}\.?,?\s+)?(?P<m>[A-Za-z]{3})[a-z]*\.?\s+(?P<d>\d{1,2})(?P<q>),?\s+(?P<Y>\d{4}),?\s+" + _CLOCK + _TAIL,
    r"^(?P<p>)(?:[A-Za-z]{3,9}\.?,?\s+)?(?P<m>[A-Za-z]{3})[a-z]*\.?\s+(?P<d>\d{1,2})(?P<q>)\s+" + _CLOCK + r"(?:\s+(?P<tail>[^\s\d]\S*))?\s+(?P<Y>\d{4})$",
]
_PARTS = ["Y", "p", "m", "q", "d", "H", "M", "S", "f", "ap", "tail"]


def _p3_sql() -> str:
    """Readings by pattern; the zone rules of the problem by the engine's own time zones. Texts whose order nothing tells are read day first."""
    order = lambda r: re.findall(r"\(\?P<(\w+)>", r)
    plain = lambda r: re.sub(r"\?P<\w+>", "", r)
    names = lambda r: "[" + ", ".join("'" + {"M": "mi"}.get(x, x) + "'" for x in order(r)) + "]"
    pick = lambda r: "struct_pack(" + ", ".join(f"{c} := x.{c}" for c in (({"M": "mi"}.get(x, x)) for x in _PARTS)) + ")"
    shapes = " UNION ALL ".join(
        f"SELECT {no} AS shape, read_id, field_name, off, zone_name, date_order, {pick(r)} AS x FROM (SELECT *, regexp_extract(t, '{plain(r)}', {names(r)}) AS x FROM texts WHERE regexp_matches(t, '{plain(r)}')) WHERE x.p = x.q"
        for no, r in enumerate(_SHAPES_SQL)
    )
    month = "coalesce(CASE WHEN shape < 3 THEN x.m::INT ELSE (list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(x.m))) END, 0)"
    short = ", ".join(f"('{k}', {v})" for k, v in timetext.ABBREVIATIONS.items())
    shift = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?\d{2})?\s*(?:\[[^\]]*\]|\([^)]*\))?$"
    parts = f"regexp_extract(upper(trim(z)), '{shift}', ['s', 'h', 'm'])"
    return rf"""
WITH texts AS (SELECT read_id, field_name, off, zone_name, date_order, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM (
    SELECT DISTINCT read_id, 'taken_at' AS field_name, taken_at AS raw, taken_offset AS off, zone_name, date_order FROM exif_reads LEFT JOIN cameras USING (camera_id)
    UNION SELECT read_id, 'modified_at', modified_at, NULL, zone_name, date_order FROM exif_reads LEFT JOIN cameras USING (camera_id))
  WHERE raw IS NOT NULL AND read_id IS NOT NULL),
counts AS (SELECT read_id, field_name, CASE WHEN n BETWEEN 9 AND 11 THEN w * 1000000 + CASE WHEN w < 0 THEN -1 ELSE 1 END * rpad(substr(f, 1, 6), 6, '0')::BIGINT
      WHEN n BETWEEN 12 AND 13 AND f = '' THEN w * 1000 WHEN n BETWEEN 15 AND 16 AND f = '' THEN w END AS utc_us
    FROM (SELECT read_id, field_name, regexp_extract(t, '^(-?\d+)', 1)::BIGINT AS w, len(regexp_extract(t, '^-?(\d+)', 1)) AS n, regexp_extract(t, '\.(\d+)$', 1) AS f
      FROM texts WHERE regexp_matches(t, '^-?\d{{1,18}}(?:\.\d+)?$'))),
shaped AS ({shapes}),
first AS (SELECT * FROM shaped QUALIFY row_number() OVER (PARTITION BY read_id, field_name, off, zone_name ORDER BY shape) = 1),
tries AS (SELECT *, {month} AS mo, x.d::INT AS da, 'dmy' AS form FROM first UNION ALL SELECT *, x.d::INT, x.m::INT, 'mdy' FROM first WHERE shape = 2),
walls AS (SELECT * EXCLUDE x, CASE WHEN x.ap = '' OR x.H::INT BETWEEN 1 AND 12 THEN
      epoch_us(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', x.Y::INT, mo, da, CASE WHEN x.ap = '' THEN x.H::INT ELSE x.H::INT % 12 + CASE WHEN lower(x.ap) = 'p' THEN 12 ELSE 0 END END, x.mi::INT, coalesce(nullif(x.S, ''), '0')::INT) AS TIMESTAMP))
      + rpad(substr(coalesce(x.f, ''), 1, 6), 6, '0')::BIGINT END AS wall, coalesce(x.tail, '') AS tail FROM tries WHERE x.Y::INT > 0 AND mo BETWEEN 1 AND 12),
kept AS (SELECT * FROM walls WHERE wall IS NOT NULL AND (shape <> 2 OR date_order IS NULL OR date_order = form)
  QUALIFY row_number() OVER (PARTITION BY read_id, field_name, off, zone_name ORDER BY form) = 1),
zones AS (SELECT z, CASE WHEN regexp_matches(upper(trim(z)), '{shift}') THEN CASE WHEN {parts}.h::INT * 60 + coalesce(nullif({parts}.m, ''), '0')::INT <= 1080 AND coalesce(nullif({parts}.m, ''), '0')::INT <= 59
      THEN ({parts}.h::INT * 60 + coalesce(nullif({parts}.m, ''), '0')::INT) * CASE WHEN {parts}.s = '-' THEN -1 ELSE 1 END END ELSE minutes END AS minutes, name
  FROM (SELECT DISTINCT z FROM (SELECT tail AS z FROM kept UNION SELECT off FROM kept UNION SELECT zone_name FROM kept) WHERE trim(z) <> '')
  LEFT JOIN (VALUES {short}) s(short, minutes) ON short = upper(trim(z, '[]() '))
  LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names() WHERE contains(name, '/')) n ON name = trim(z, '[]() ')),
placed AS (SELECT read_id, field_name, wall, CASE WHEN tail <> '' THEN a.minutes WHEN b.minutes IS NOT NULL OR b.name IS NOT NULL THEN b.minutes ELSE c.minutes END AS minutes,
    CASE WHEN tail <> '' THEN a.name WHEN b.minutes IS NOT NULL OR b.name IS NOT NULL THEN b.name ELSE c.name END AS name
  FROM kept LEFT JOIN zones a ON a.z = tail LEFT JOIN zones b ON b.z = off LEFT JOIN zones c ON c.z = zone_name),
named AS (SELECT read_id, field_name, wall, name, epoch_us(timezone(name, make_timestamp(wall))) AS u FROM placed WHERE minutes IS NULL AND name IS NOT NULL),
before AS (SELECT *, wall - (epoch_us(timezone(name, timezone('UTC', make_timestamp(u - 14400000000)))) - (u - 14400000000)) AS v FROM named),
resolved AS (SELECT read_id, field_name, CASE WHEN epoch_us(timezone(name, timezone('UTC', make_timestamp(v)))) = wall THEN v
    WHEN epoch_us(timezone(name, timezone('UTC', make_timestamp(u)))) = wall THEN u ELSE v END AS utc_us FROM before)
SELECT read_id, field_name, utc_us FROM counts WHERE utc_us IS NOT NULL
UNION SELECT read_id, field_name, wall - minutes::BIGINT * 60000000 FROM placed WHERE minutes IS NOT NULL
UNION SELECT read_id, field_name, utc_us FROM resolved
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p3_found": _p3_sql()}
