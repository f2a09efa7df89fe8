"""Queries over real pixels: one picture of 32 x 32 for every row of ``cameras``, by a formula that SQL states as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.config import EngineConfig
from lumenfold.operators import imaging, transforms
from lumenfold.runtime import table
from lumenfold.sources import files as FS

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
SIDE = 32


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def _value(x: str, y: str, c: str) -> str:
    """Channel ``c`` (0 red, 1 green, 2 blue) at (x, y) of picture n: a gradient, noise, a chequerboard, or dark with spots. Valid in both SQL dialects."""
    return f"""CASE n % 4 WHEN 0 THEN (4 * {x} + 2 * {y} + n + 20 * {c}) % 256 WHEN 1 THEN ((n * 7 + 3) * {x} + (n * 5 + {c} * 11) * {y} + n * n * {c} + {x} * {x} * 3 + {x} * {y} * ({c} + 1)) % 256
      WHEN 2 THEN CAST(floor({x} / 8) + floor({y} / 8) AS INT) % 2 * 180 + ({c} * n + {x} * {y}) % 40
      ELSE ({x} * {y} * n) % 13 + 3 * {c} + CASE WHEN ({x} * 31 + {y} * 17 + n) % 97 = 0 THEN 200 ELSE 0 END END"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """path, width, height, channels, data (BGR, as the image source gives it); made without Python."""
    x, y, c = "((i div 3) % 32)", "(i div 96)", "(2 - i % 3)"
    rows = table(spark, d, "cameras").select("camera_id", F.substring("camera_id", 5, 9).cast("int").alias("n")).where("n is not null")
    data = F.expr(f"unhex(array_join(transform(sequence(0, {SIDE * SIDE * 3 - 1}), i -> lpad(hex({_value(x, y, c)}), 2, '0')), ''))")
    return rows.select(F.col("camera_id").alias("path"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(3).alias("channels"), data.alias("data"))


_GRAY = "((19595 * r * 257 + 38470 * g * 257 + 7471 * b * 257 + 32768)::BIGINT >> 24)::INT"
_PX = f"""cam AS (SELECT camera_id AS path, try_cast(substr(camera_id, 5, 9) AS INT) AS n FROM cameras WHERE try_cast(substr(camera_id, 5, 9) AS INT) IS NOT NULL),
pos AS (SELECT (i % {SIDE})::INT AS x, (i // {SIDE})::INT AS y FROM range({SIDE * SIDE}) t(i)),
px AS MATERIALIZED (SELECT *, {_GRAY} AS v FROM (SELECT path, x, y, {", ".join(f"({_value('x', 'y', str(i))})::BIGINT AS {c}" for i, c in enumerate("rgb"))} FROM cam, pos))"""
_NEAR = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
_LETTER = {(-1, 0): "l", (1, 0): "e", (0, -1): "u", (0, 1): "d", (-1, -1): "ul", (1, -1): "ur", (-1, 1): "dl", (1, 1): "dr"}
_INNER = "inn AS MATERIALIZED (SELECT c.path, c.x, c.y, c.v, " + ", ".join(f"{n}.v AS {n}" for n in _LETTER.values()) + " FROM px c " + " ".join(f"JOIN px {n} ON {n}.path = c.path AND {n}.x = c.x + {dx} AND {n}.y = c.y + {dy}" for (dx, dy), n in _LETTER.items()) + ")"
_SUM8 = "(l + e + u + d + ul + ur + dl + dr)"
_SQ8 = "(l*l + e*e + u*u + d*d + ul*ul + ur*ur + dl*dl + dr*dr)"
_D = "::DOUBLE"


def _long(parts: dict[str, str], source: str) -> str:
    """path, measure, value rows of the named columns of a table of one row a picture."""
    return " UNION ALL ".join(f"SELECT path, '{k}' AS measure, round(({v}){_D}, 6) AS value FROM {source}" for k, v in parts.items())


def _noise(k: int) -> str:
    s8, q8 = f"({_SUM8} * {k}.0{_D} / 8)", f"({_SQ8} * {k * k}.0{_D} / 8)"
    return f"least(coalesce(avg(sqrt(greatest({q8} - {s8} * {s8}, 0))) FILTER (abs(v * {k} - {s8}) < 10) / 50, 0.5{_D}), 1)"


_QUALITY = f"""WITH {_PX}, {_INNER},
a AS (SELECT path, least(avg(abs(4 * v - l - e - u - d)) / 100, 1) AS sharpness, {_noise(1)} AS noise, {_noise(257)} AS noise16 FROM inn GROUP BY 1),
p AS (SELECT path, avg(v / 255.0{_D}) AS m, avg((v / 255.0{_D}) ** 2) AS m2, avg((v / 255.0{_D} < 0.1{_D})::INT) AS dark, avg((v / 255.0{_D} > 0.9{_D})::INT) AS bright FROM px GROUP BY 1),
c AS (SELECT path, avg(r) AS r, avg(g) AS g, avg(b) AS b, greatest(avg(r), avg(g), avg(b)) AS hi FROM px WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY 1),
q AS (SELECT *, greatest(0, least(1, m - greatest(dark - 0.3{_D}, 0) * 0.5{_D} + greatest(bright - 0.3{_D}, 0) * 0.5{_D})) AS exposure, least(sqrt(greatest(0, m2 - m * m)) / 0.4{_D}, 1) AS contrast,
  CASE WHEN hi = 0 THEN 0 ELSE least(sqrt(((1 - r / hi) ** 2 + (1 - g / hi) ** 2 + (1 - b / hi) ** 2) / 3), 1) END AS color_cast FROM a JOIN p USING (path) JOIN c USING (path)),
z AS (SELECT *, greatest(0, least(100, 100 * (0.3{_D} * sharpness + 0.25{_D} * (1 - noise) + 0.2{_D} * (1 - 2 * abs(exposure - 0.5{_D})) + 0.15{_D} * contrast + 0.05{_D} * 0.9{_D} + 0.05{_D} * (1 - color_cast)))) AS score FROM q)
"""


def _measured(spark, d, *names) -> DataFrame:
    return imaging.measures(pictures(spark, d), names).select("path", "measure", F.round("value", 6).alias("value"))


@query(_QUALITY + _long({"quality.sharpness": "sharpness", "quality.noise": "noise", "quality.exposure": "exposure", "quality.contrast": "contrast", "quality.compression": "0.1", "quality.color_cast": "color_cast", "quality.final_score": "score", "noise_16_bit": "noise16"}, "z"))
def picture_quality(spark, d):
    return _measured(spark, d, "quality", "noise_16_bit")



_COMPRESSION = f"""WITH {_PX}, g AS MATERIALIZED (SELECT path, x, y, v * 257 AS g FROM px),
bl AS (SELECT h.path, least(count(*) FILTER (abs(h.g - l.g) > 10000 OR abs(h.g - u.g) > 10000) / 9.0{_D}, 1) AS blockiness FROM g h JOIN g l ON l.path = h.path AND l.y = h.y AND l.x = h.x - 1
  JOIN g u ON u.path = h.path AND u.x = h.x AND u.y = h.y - 1 WHERE h.x IN (8, 16) AND h.y IN (8, 16) GROUP BY 1),
st AS (SELECT path, y, x, lead(g) OVER w - g AS step FROM g WINDOW w AS (PARTITION BY path, y ORDER BY x)),
tu AS (SELECT *, CASE WHEN abs(step) > 1000 THEN sign(step) ELSE 0 END AS turn FROM st),
fl AS (SELECT *, coalesce((lead(turn) OVER w * turn < 0)::INT, 0) AS flip FROM tu WINDOW w AS (PARTITION BY path, y ORDER BY x)),
rw AS (SELECT *, greatest(abs(lag(step, 1) OVER w), abs(step)) > 15000 AS edge, lag(flip, 3) OVER w + lag(flip, 2) OVER w AS before, flip + lead(flip) OVER w AS after FROM fl WINDOW w AS (PARTITION BY path, y ORDER BY x)),
ri AS (SELECT path, least(count(*) FILTER (edge AND (before >= 2 OR after >= 2)) / 225.0{_D}, 1) AS ringing FROM rw WHERE y % 2 = 1 AND y < 31 AND x % 2 = 1 AND x > 2 AND x < 29 GROUP BY 1),
ce AS (SELECT c.path, c.x, c.y, max(abs(coalesce(o.g, 0) - c.g)) AS far, sum(CASE WHEN abs(dx) <= 1 AND abs(dy) <= 1 AND (dx <> 0 OR dy <> 0) AND abs(coalesce(o.g, 0) - c.g) > 2000 THEN 1 ELSE 0 END) / 8.0{_D} AS near
  FROM (SELECT g.*, a.i - 3 AS dx, b.i - 3 AS dy FROM g, range(7) a(i), range(7) b(i) WHERE x % 4 = 2 AND y % 4 = 2 AND x < 30 AND y < 30) c LEFT JOIN g o ON o.path = c.path AND o.x = c.x + c.dx AND o.y = c.y + c.dy GROUP BY 1, 2, 3),
cn AS (SELECT path, coalesce(avg(near) FILTER (far < 5000), 0) AS compression_noise FROM ce GROUP BY 1),
z AS (SELECT *, least((blockiness + ringing + compression_noise) / 3, 1) AS total FROM bl JOIN ri USING (path) JOIN cn USING (path))
"""


@query(_COMPRESSION + _long({"blockiness": "blockiness", "ringing": "ringing", "compression_noise": "compression_noise", "compression_measured": "total", "compression": "0.1"}, "z"))
def picture_compression(spark, d):
    return _measured(spark, d, "blockiness", "ringing", "compression_noise", "compression_measured", "compression")


_FOCUS = {"center": (8, 8, 16), "top_left": (0, 0, 8), "top_right": (24, 0, 8), "bottom_left": (0, 24, 8), "bottom_right": (24, 24, 8)}
_EDGES = f"""WITH {_PX}, {_INNER}, m AS (SELECT *, sqrt((ur + 2 * e + dr - ul - 2 * l - dl) ** 2 + (dl + 2 * d + dr - ul - 2 * u - ur) ** 2) AS mag, abs(4 * v - l - e - u - d) AS lap, abs(v - {_SUM8} / 8.0{_D}) AS off FROM inn),
wide AS (SELECT c.path, avg((abs(c.v - s.m) > 2)::INT) AS low FROM px c JOIN (SELECT c.path, c.x, c.y, avg(o.v) AS m FROM px c JOIN px o ON o.path = c.path AND abs(o.x - c.x) <= 2 AND abs(o.y - c.y) <= 2
  WHERE c.x % 2 = 0 AND c.y % 2 = 0 AND c.x BETWEEN 2 AND 29 AND c.y BETWEEN 2 AND 29 GROUP BY 1, 2, 3) s USING (path, x, y) GROUP BY 1),
z AS (SELECT path, count(*) FILTER (mag > 50) / 1024.0{_D} AS strong, count(*) FILTER (mag > 20 AND mag <= 50) / 1024.0{_D} AS medium, count(*) FILTER (mag > 5 AND mag <= 20) / 1024.0{_D} AS weak, count(*) FILTER (mag > 5) / 1024.0{_D} AS total,
  {", ".join(f"least(avg(lap) FILTER (x BETWEEN {x + 1} AND {x + s - 2} AND y BETWEEN {y + 1} AND {y + s - 2}) / 100, 1) AS {k}" for k, (x, y, s) in _FOCUS.items())},
  avg((off > 5)::INT) AS high, any_value(low) AS low, least(1, 10 * count(*) FILTER (off > 50) / 1024.0{_D}) AS salt FROM m JOIN wide USING (path) GROUP BY 1)
"""


@query(_EDGES + _long({"edges.strong_edges": "strong", "edges.medium_edges": "medium", "edges.weak_edges": "weak", "edges.total_edges": "total", **{f"focus.{k}": k for k in _FOCUS}, "noise_patterns.high_frequency": "high", "noise_patterns.low_frequency": "low", "noise_patterns.salt_pepper": "salt"}, "z"))
def picture_edges_focus_noise(spark, d):
    return _measured(spark, d, "edges", "focus", "noise_patterns")


_COLOURS = f"""WITH {_PX}, t AS (SELECT path, sum(r)::DOUBLE / sum(b) AS k FROM px WHERE x % 8 = 0 AND y % 8 = 0 GROUP BY 1),
c AS (SELECT path, avg((sat > 0.7{_D})::INT) AS sh, avg((sat < 0.3{_D})::INT) AS sl, avg((light < 0.2{_D})::INT) AS bl, avg((light > 0.8{_D})::INT) AS bh FROM (SELECT path, (r / 255.0{_D} + g / 255.0{_D} + b / 255.0{_D}) / 3 AS light,
  CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) / 255.0{_D} - least(r, g, b) / 255.0{_D}) / (greatest(r, g, b) / 255.0{_D}) ELSE 0 END AS sat FROM px WHERE x % 4 = 0 AND y % 4 = 0) GROUP BY 1),
e AS (SELECT path, (avg((v * 257 < 4096 OR v * 257 > 61440)::INT) >= 0.9{_D})::INT AS blank FROM px WHERE x % 10 = 0 AND y % 10 = 0 GROUP BY 1),
dm AS (SELECT path, k, row_number() OVER (PARTITION BY path ORDER BY n DESC, k) - 1 AS rank FROM (SELECT path, (r // 16 * 16) * 65536 + (g // 16 * 16) * 256 + b // 16 * 16 AS k, count(*) AS n FROM px WHERE x % 10 = 0 AND y % 10 = 0 GROUP BY 1, 2)),
z AS (SELECT * FROM t JOIN c USING (path) JOIN e USING (path))
"""


@query(
    _COLOURS
    + _long({"temperature.kind": "CASE WHEN k > 1.2 THEN 1 WHEN k < 0.8 THEN -1 ELSE 0 END", "temperature.strength": f"CASE WHEN k > 1.2{_D} THEN least((k - 1.2{_D}) / 0.8{_D}, 1) WHEN k < 0.8{_D} THEN (0.8{_D} - k) / 0.8{_D} ELSE 0 END", "colors.saturation_high": "sh", "colors.saturation_low": "sl", "colors.brightness_low": "bl", "colors.brightness_high": "bh", "blank": "blank"}, "z")
    + f" UNION ALL SELECT path, 'dominant.' || rank, k{_D} FROM dm WHERE rank < 5"
)
def picture_colours(spark, d):
    return _measured(spark, d, "temperature", "colors", "blank", "dominant")


def _bins(name: str, channels: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT path, '{name}.' || ({16 * i} + floor(({c}) * 15)::INT) AS measure, count(*) / 1024.0{_D} AS value FROM hsv GROUP BY 1, 2" for i, c in enumerate(channels))


_HISTOGRAMS = f"""WITH {_PX}, u AS (SELECT *, r / 255.0{_D} AS fr, g / 255.0{_D} AS fg, b / 255.0{_D} AS fb, greatest(r, g, b) / 255.0{_D} AS hi, least(r, g, b) / 255.0{_D} AS lo FROM px),
hsv AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (CASE WHEN hi = fr THEN (fg - fb) / (hi - lo) + CASE WHEN fg < fb THEN 6 ELSE 0 END WHEN hi = fg THEN (fb - fr) / (hi - lo) + 2 ELSE (fr - fg) / (hi - lo) + 4 END) / 6 END AS h,
  CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s FROM u),
k AS ({_bins("rgb_histogram", ["fr", "fg", "fb"])} UNION ALL {_bins("hsv_histogram", ["h", "s", "hi"])} UNION ALL {_bins("luminance_histogram", [f"v / 255.0{_D}"])}),
ed AS (SELECT c.path, count(*) FILTER (abs(c.v - e.v) * 257 > 10000 OR abs(c.v - d.v) * 257 > 10000) / 1024.0{_D} AS value FROM px c JOIN px e ON e.path = c.path AND e.x = c.x + 1 AND e.y = c.y
  JOIN px d ON d.path = c.path AND d.x = c.x AND d.y = c.y + 1 WHERE c.x BETWEEN 1 AND 30 AND c.y BETWEEN 1 AND 30 GROUP BY 1)
SELECT path, measure, round(value, 6) AS value FROM (SELECT * FROM k UNION ALL SELECT path, replace(measure, 'rgb_histogram', 'feature_vector'), value FROM k WHERE starts_with(measure, 'rgb')
  UNION ALL SELECT path, 'feature_vector.48', value FROM ed UNION ALL SELECT path, 'feature_vector.49', 1 FROM cam UNION ALL SELECT path, unnest(['feature_vector.50', 'feature_vector.51']), 16 FROM cam) WHERE value > 0"""


@query(_HISTOGRAMS)
def picture_histograms(spark, d):
    """The bins that are not empty, and the parts of the feature vector."""
    return _measured(spark, d, "rgb_histogram", "hsv_histogram", "luminance_histogram", "feature_vector").where("value > 0")


_MOMENTS = f"""WITH {_PX}, m AS (SELECT path, {", ".join(f"sum(x{_D} ** {p} * y{_D} ** {q} * (v / 255.0{_D})) AS m{p}{q}" for p in range(4) for q in range(4 - p))} FROM px GROUP BY 1),
c AS (SELECT *, m10 / m00 AS cx, m01 / m00 AS cy FROM m),
a AS (SELECT *, m11 - cx * m01 AS a11, m20 - cx * m10 AS a20, m02 - cy * m01 AS a02, m30 - 3 * m20 * cx + 2 * m10 * cx ** 2 AS a30, m03 - 3 * m02 * cy + 2 * m01 * cy ** 2 AS a03,
  m12 - 2 * m11 * cy - cy * m20 + 2 * m10 * cy ** 2 AS a12, m21 - 2 * m11 * cx - cx * m02 + 2 * m01 * cx ** 2 AS a21 FROM c)
SELECT path, round(cx, 6) AS cx, round(cy, 6) AS cy, round(a20 + a02, 3) AS hu1, round(((a20 - a02) ** 2 + 4 * a11 ** 2) / 1e6{_D}, 5) AS hu2, round(((a30 - 3 * a12) ** 2 + (3 * a21 - a03) ** 2) / 1e12{_D}, 6) AS hu3 FROM a"""


@query(_MOMENTS)
def picture_moments(spark, d):
    m = imaging.measures(pictures(spark, d), ["moments"]).groupBy("path").pivot("measure", [f"moments.{k}" for k in ("centroid_x", "centroid_y", "hu1", "hu2", "hu3")]).agg(F.first("value"))
    of = lambda k: F.col(f"`moments.{k}`")
    return m.select("path", F.round(of("centroid_x"), 6).alias("cx"), F.round(of("centroid_y"), 6).alias("cy"), F.round(of("hu1"), 3).alias("hu1"), F.round(of("hu2") / 1e6, 5).alias("hu2"), F.round(of("hu3") / 1e12, 6).alias("hu3"))


# --- resampling and hashes ------------------------------------------------------------------------------


def _weights(name: str, src: int, dst: int) -> str:
    """Three-lobed Lanczos weights (d, s, w) from ``src`` to ``dst`` places."""
    scale = src / dst
    sinc = lambda x: f"CASE WHEN {x} = 0 THEN 1.0{_D} ELSE sin(pi() * {x}) / (pi() * {x}) END"
    return f"""{name} AS MATERIALIZED (SELECT d, s, w / sum(w) OVER (PARTITION BY d) AS w FROM (SELECT d, s, CASE WHEN abs(t) < 3 THEN ({sinc("t")}) * ({sinc("(t / 3)")}) ELSE 0 END AS w
      FROM (SELECT d, s, (s - ((d + 0.5{_D}) * {scale!r}{_D} - 0.5{_D})) / {max(scale, 1.0)!r}{_D} AS t FROM range({dst}) a(d), range({src}) b(s))) WHERE w <> 0)"""


def _resized(name: str, w: int, h: int, source: str = "px", sw: int = SIDE, sh: int = SIDE) -> str:
    """Table ``name`` (path, x, y, r, g, b, v) of a table of pixels resampled to w x h."""
    rounded = ", ".join(f"greatest(0, least(255, round_even(sum(q.{c} * wx.w), 0)))::BIGINT AS {c}" for c in "rgb")
    return f"""{_weights(f"{name}_y", sh, h)}, {_weights(f"{name}_x", sw, w)},
{name}_q AS MATERIALIZED (SELECT path, x, wy.d AS y, {", ".join(f"sum({c} * wy.w) AS {c}" for c in "rgb")} FROM {source} JOIN {name}_y wy ON wy.s = y GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT *, {_GRAY} AS v FROM (SELECT path, wx.d AS x, q.y, {rounded} FROM {name}_q q JOIN {name}_x wx ON wx.s = q.x GROUP BY 1, 2, 3))"""


def _word(cond: str, bit: str, source: str, name: str) -> str:
    one = f"CASE WHEN {bit} = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << ({bit})::INT END"
    return f"SELECT path, coalesce(sum({one}) FILTER ({cond}), 0)::BIGINT AS {name} FROM {source} GROUP BY 1"


_HASHES = f"""WITH {_PX}, {_resized("t8", 8, 8)}, {_resized("t9", 9, 8)},
ah AS ({_word("v * 257 > m", "y * 8 + x", "(SELECT *, sum(v * 257) OVER (PARTITION BY path) // 64 AS m FROM t8)", "a_hash")}),
dh AS ({_word("n > v", "y * 8 + x", "(SELECT *, lead(v) OVER (PARTITION BY path, y ORDER BY x) AS n FROM t9)", "d_hash")}),
fh AS ({_word("hit", "k", f"(SELECT path, (y * 32 + x) % 64 AS k, bool_or(v > m) AS hit FROM (SELECT *, avg(v) OVER (PARTITION BY path) AS m FROM px) GROUP BY 1, 2)", "p_hash")})
SELECT path, a_hash, p_hash, d_hash, a_hash AS w_hash FROM ah JOIN dh USING (path) JOIN fh USING (path)"""


def _hashes(spark, d, variant: str) -> DataFrame:
    config = EngineConfig(hash_variant=variant, hashes=dict.fromkeys(("a_hash", "p_hash", "d_hash", "w_hash"), True))
    return FS.measure_images(pictures(spark, d), config).select("path", "hashes.*")


@query(_HASHES)
def picture_hashes(spark, d):
    return _hashes(spark, d, "engine")


_HAAR = lambda u, c: f"CASE WHEN {u} < s // 2 THEN CASE WHEN {c} // (64 // s) IN (2 * {u}, 2 * {u} + 1) THEN 1 ELSE 0 END ELSE CASE {c} // (64 // s) - 2 * ({u} - s // 2) WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END END"
_DCT_HASHES = f"""WITH {_PX}, {_resized("t8", 8, 8)}, {_resized("t10", 10, 8)}, {_resized("t64", 64, 64)},
ah AS ({_word("v * 257 > m", "y * 8 + x", "(SELECT *, sum(v * 257) OVER (PARTITION BY path) // 64 AS m FROM t8)", "a_hash")}),
dh AS ({_word("n > v AND y * 9 + x < 64", "least(y * 9 + x, 63)", "(SELECT *, lead(v) OVER (PARTITION BY path, y ORDER BY x) AS n FROM t10)", "d_hash")}),
dc AS (SELECT path, i.k * 8 + j.k - 1 AS k, sum(v * 257 / 65535.0{_D} * cos((2 * y + 1) * i.k * pi() / 64) * cos((2 * x + 1) * j.k * pi() / 64)) AS c FROM px, range(8) i(k), range(8) j(k) WHERE i.k + j.k > 0 GROUP BY 1, 2),
ph AS ({_word("c > m", "k", "(SELECT *, avg(c) OVER (PARTITION BY path) AS m FROM dc)", "p_hash")}),
ha AS (SELECT path, i * 8 + j - 1 AS k, abs(sum(v * 257 / 65535.0{_D} * a.f * b.f)) AS c FROM t64, (SELECT i, j, CASE WHEN greatest(i, j) >= 4 THEN 8 WHEN greatest(i, j) >= 2 THEN 4 ELSE 2 END AS s FROM range(8) p(i), range(8) q(j) WHERE i + j > 0) u,
  LATERAL (SELECT ({_HAAR("u.i", "t64.y")}) * s / 128.0{_D} AS f) a, LATERAL (SELECT ({_HAAR("u.j", "t64.x")}) * s / 128.0{_D} AS f) b GROUP BY 1, 2),
wh AS ({_word("c > m", "k", "(SELECT *, avg(c) OVER (PARTITION BY path) AS m FROM ha)", "w_hash")})
SELECT path, a_hash, p_hash, d_hash, w_hash FROM ah JOIN dh USING (path) JOIN ph USING (path) JOIN wh USING (path)"""


@query(_DCT_HASHES)
def picture_hashes_dct(spark, d):
    return _hashes(spark, d, "dct")


# --- transforms -----------------------------------------------------------------------------------------


def _sum(source: str, step: str, w: int, h: int) -> str:
    return f"SELECT path, '{step}' AS step, {w} AS width, {h} AS height, sum((3 * x + 5 * y + 1) * (r + 2 * g + 3 * b)){_D} AS checksum FROM {source} GROUP BY 1"


def _channels(f, source: str) -> str:
    return f"(SELECT path, x, y, {', '.join(f'{f(c)} AS {c}' for c in 'rgb')} FROM {source})"


_CLIP = lambda e: f"greatest(0, least(255, round_even({e}, 0)))::BIGINT"
_LIGHT = lambda c: f"(greatest(0, least(255, {c} + 255 * 10 / 100.0{_D})) - 127.5{_D}) * 1.2{_D} + 127.5{_D}"
_TAPS = [2.718281828459045 ** (-(i * i) / 2) for i in range(-3, 4)]
_BLUR = f"""taps AS (SELECT * FROM (VALUES {", ".join(f"({i}, {t / sum(_TAPS)!r}{_D})" for i, t in zip(range(-3, 4), _TAPS))}) t(o, w)),
b1 AS MATERIALIZED (SELECT c.path, c.x, c.y, {", ".join(f"sum(s.{c} * w) AS {c}" for c in "rgb")} FROM px c, taps JOIN px s ON s.path = c.path AND s.x = c.x AND s.y = greatest(0, least(31, c.y + o)) GROUP BY 1, 2, 3),
b2 AS MATERIALIZED (SELECT c.path, c.x, c.y, {", ".join(_CLIP(f"sum(s.{c} * w)") + f" AS {c}" for c in "rgb")} FROM b1 c, taps JOIN b1 s ON s.path = c.path AND s.y = c.y AND s.x = greatest(0, least(31, c.x + o)) GROUP BY 1, 2, 3)"""
_STEPS = {
    "resize": (("resize", 16, 8),), "resize_to_fit": (("resize_to_fit", 20, 10),), "resize_to_fill": (("resize_to_fill", 10, 16),), "crop": (("crop", 5, 7, 20, 10),), "crop_center": (("crop_center", 12, 9),),
    "rotate": (("rotate", 1),), "orient": (("orient", 6),), "adjust": (("adjust", 10.0, 20.0, -30.0),), "blur": (("blur", 1.0),), "sharpen": (("sharpen", 1.0),), "preprocess": (("preprocess", 16, True),),
}
_MEAN = "(greatest(r, g, b) + least(r, g, b)) / 2"
_TRANSFORMS = f"""WITH {_PX}, {_resized("s", 16, 8)}, {_resized("f", 10, 10)}, {_resized("c", 16, 16)}, {_BLUR},
ad AS (SELECT path, x, y, {", ".join(f"{_LIGHT(c)} AS {c}" for c in "rgb")} FROM px)
{_sum("s", "resize", 16, 8)} UNION ALL {_sum("f", "resize_to_fit", 10, 10)} UNION ALL {_sum("(SELECT * REPLACE (x - 3 AS x) FROM c WHERE x BETWEEN 3 AND 12)", "resize_to_fill", 10, 16)}
UNION ALL {_sum("(SELECT * REPLACE (x - 5 AS x, y - 7 AS y) FROM px WHERE x BETWEEN 5 AND 24 AND y BETWEEN 7 AND 16)", "crop", 20, 10)}
UNION ALL {_sum("(SELECT * REPLACE (x - 10 AS x, y - 11 AS y) FROM px WHERE x BETWEEN 10 AND 21 AND y BETWEEN 11 AND 19)", "crop_center", 12, 9)}
UNION ALL {_sum("(SELECT * REPLACE (y AS x, 31 - x AS y) FROM px)", "rotate", 32, 32)} UNION ALL {_sum("(SELECT * REPLACE (31 - y AS x, x AS y) FROM px)", "orient", 32, 32)}
UNION ALL {_sum(_channels(lambda c: _CLIP(f"{_MEAN} + ({c} - {_MEAN}) * 0.7{_D}"), "ad"), "adjust", 32, 32)} UNION ALL {_sum("b2", "blur", 32, 32)}
UNION ALL {_sum("(SELECT b2.path, b2.x, b2.y, " + ", ".join(f"greatest(0, least(255, 2 * px.{c} - b2.{c})) AS {c}" for c in "rgb") + " FROM b2 JOIN px USING (path, x, y))", "sharpen", 32, 32)}
UNION ALL {_sum(_channels(lambda c: "v::BIGINT", "c"), "preprocess", 16, 16)}"""


@query(_TRANSFORMS)
def picture_transforms(spark, d):
    """A checksum of the pixels after each transform."""
    images, out = pictures(spark, d), None
    for name, steps in _STEPS.items():
        done = imaging.measures(transforms.transform_images(images, steps), ["checksum"], ("path", "width", "height"))
        done = done.select("path", F.lit(name).alias("step"), "width", "height", F.col("value").alias("checksum"))
        out = done if out is None else out.unionByName(done)
    return out





@query(f"SELECT path, round(16 / 32.0{_D}, 6) AS scale_x, round(8 / 32.0{_D}, 6) AS scale_y, 1.0{_D} AS old_aspect, 2.0{_D} AS new_aspect FROM (WITH {_PX} SELECT path FROM cam)")
def picture_transform_info(spark, d):
    done = transforms.transform_images(pictures(spark, d), (("resize", 16, 8),))
    info = transforms.transform_info(F.col("old_width"), F.col("old_height"), F.col("width"), F.col("height"))
    return done.select("path", info.alias("i")).select("path", *[F.round(f"i.{k}", 6).alias(k) for k in ("scale_x", "scale_y", "old_aspect", "new_aspect")])


@query(f"WITH {_PX}, {_resized('h', 16, 16)} SELECT path, 0 AS level, 32 AS width, sum((3 * x + 5 * y + 1) * (r + 2 * g + 3 * b)){_D} AS checksum FROM px GROUP BY 1 UNION ALL SELECT path, 1, 16, sum((3 * x + 5 * y + 1) * (r + 2 * g + 3 * b)){_D} FROM h GROUP BY 1")
def picture_pyramid(spark, d):
    levels = imaging.measures(imaging.pyramid_images(pictures(spark, d), 4), ["checksum"], ("path", "level", "width"))
    return levels.select("path", "level", "width", F.col("value").alias("checksum"))


@query(
    f"""WITH {_PX}, k AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM cam), sp AS (SELECT path, i // 16 AS page, i % 16 AS i FROM k), rows AS (SELECT page, (max(i) // 4 + 1) * 32 AS height FROM sp GROUP BY 1)
    SELECT page::INT AS page, 128 AS width, height::INT AS height, sum((3 * (x + i % 4 * 32) + 5 * (y + i // 4 * 32) + 1) * (r + 2 * g + 3 * b)){_D} AS checksum FROM px JOIN sp USING (path) JOIN rows USING (page) GROUP BY 1, 2, 3"""
)
def picture_collage(spark, d):
    pages = imaging.measures(imaging.collage_images(pictures(spark, d), 4, 16), ["checksum"], ("page", "width", "height"))
    return pages.select("page", "width", "height", F.col("value").alias("checksum"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
