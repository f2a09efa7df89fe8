"""Column expressions: hashes, vectors, quality, colour, paths and metadata. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.schema import METRICS, TIERS

#: Fixed value: distance of vectors of unequal length.
FAR = 1.7976931348623157e308
HASH_NAMES = ("a_hash", "p_hash", "d_hash", "w_hash")
#: Weights of the four hashes, used when no other are given.
DEFAULT_WEIGHTS = {"a_hash": 0.2, "p_hash": 0.4, "d_hash": 0.3, "w_hash": 0.1}

# --- bits ---------------------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def plain_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(64.0)


def transfer(name: str, d: Column) -> Column:
    """What a hash of this kind adds for two values ``d`` bits apart."""
    s = 1 - d / F.lit(64.0)
    if name == "p_hash":
        return F.when(s > 0.9, s).when(s > 0.7, s * 0.9).otherwise(s * 0.8)
    if name == "w_hash":
        return F.when(s > 0.6, F.least(s * 1.1, F.lit(1.0))).otherwise(s)
    return F.greatest(s, F.lit(0.0))


def transfer_value(name: str, d: int) -> float:
    """The same for a number, for planning."""
    s = 1 - d / 64.0
    if name == "p_hash":
        return s if s > 0.9 else s * 0.9 if s > 0.7 else s * 0.8
    if name == "w_hash":
        return min(s * 1.1, 1.0) if s > 0.6 else s
    return max(s, 0.0)


def weights_or_default(weights: dict[str, float] | None) -> dict[str, float]:
    return weights if weights and any(weights.values()) else DEFAULT_WEIGHTS


def fingerprint_similarity(left, right, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the hashes that both sides have (not null, not 0); 0 where there is none.

    ``left`` and ``right`` give the column of a hash name.
    """
    total, by = F.lit(0.0), F.lit(0.0)
    for name, w in weights_or_default(weights).items():
        if w <= 0:
            continue
        a, b = left(name), right(name)
        both = F.coalesce((a != 0) & (b != 0), F.lit(False))
        total = total + F.when(both, transfer(name, hamming(a, b)) * F.lit(float(w))).otherwise(F.lit(0.0))
        by = by + F.when(both, F.lit(float(w))).otherwise(F.lit(0.0))
    return F.when(by == 0, F.lit(0.0)).otherwise(F.least(F.greatest(total / by, F.lit(0.0)), F.lit(1.0)))


def valid_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def partial_sha256(content: Column, n: int) -> Column:
    return F.sha2(F.substring(content, 1, n), 256)


def image_id(path: Column) -> Column:
    """Deterministic id of a path, so that scanning it again replaces its record."""
    return F.concat(F.lit("img_"), F.substring(F.sha2(path, 256), 1, 16))


def bits_to_long(flags: Column) -> Column:
    """Array of booleans to a 64-bit word, first element in the lowest bit."""
    ones = F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def grid_average_hash(grid: Column) -> Column:
    """Bit i is set where cell i is above the (integer) mean of the grid."""
    mean = F.floor(F.aggregate(grid, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) / F.size(grid))
    return bits_to_long(F.transform(grid, lambda x: x > mean))


def grid_difference_hash(grid: Column, width: int = 8) -> Column:
    """Bits of "right neighbour is larger", row by row."""
    rows = F.sequence(F.lit(0), F.floor(F.size(grid) / width).cast("int") - 1)
    at = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda x: r.cast("int") * width + x)))
    return bits_to_long(F.transform(at, lambda i: F.element_at(grid, (i + 2).cast("int")) > F.element_at(grid, (i + 1).cast("int"))))


def grid_fold_hash(grid: Column) -> Column:
    """Bit (i mod 64) is set where any cell with that remainder is above the mean."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(grid)
    hit = F.transform(grid, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(hit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


# --- vectors ------------------------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _pairwise(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def _same_length(a: Column, b: Column, value: Column, otherwise: float) -> Column:
    return F.when(F.size(a) != F.size(b), F.lit(otherwise)).otherwise(value)


def euclidean(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.sqrt(_sum(_pairwise(a, b, lambda x, y: (x - y) * (x - y)))), FAR)


def manhattan(a: Column, b: Column) -> Column:
    return _same_length(a, b, _sum(_pairwise(a, b, lambda x, y: F.abs(x - y))), FAR)


def cosine(a: Column, b: Column) -> Column:
    dot, aa, bb = (_sum(_pairwise(x, y, lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b)))
    value = F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(aa) * F.sqrt(bb)))
    return _same_length(a, b, value, 0.0)


def chi_squared(a: Column, b: Column) -> Column:
    one = _pairwise(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0)))
    return _same_length(a, b, _sum(one) / 2, FAR)


def histogram_similarity(a: Column, b: Column) -> Column:
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + chi_squared(a, b))))
    return _same_length(a, b, value, 1.0)


def feature_vector(histogram: Column, edge_density: Column, width: Column, height: Column) -> Column:
    """Histogram (48), edge density, aspect ratio and centre: 52 numbers."""
    return F.concat(histogram, F.array(edge_density, aspect_ratio(width, height), width / 2.0, height / 2.0)).cast("array<float>")


# --- quality ------------------------------------------------------------------------------------

#: Weights of the six measures in the final score.
SCORE_WEIGHTS = {"sharpness": 0.3, "noise": 0.25, "exposure": 0.2, "contrast": 0.15, "compression": 0.05, "color_cast": 0.05}


def subscores(q) -> dict[str, Column]:
    """Each measure turned to "larger is better", 0..1. ``q`` gives the column of a measure."""
    return {
        "sharpness": q("sharpness"), "noise": 1 - q("noise"), "exposure": 1 - F.abs(q("exposure") - 0.5) * 2,
        "contrast": q("contrast"), "compression": 1 - q("compression"), "color_cast": 1 - q("color_cast"),
    }


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else dict(weights)


def final_score(q, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the sub-scores on a scale of 0..100."""
    parts, total = subscores(q), None
    for m in METRICS:
        term = parts[m] * F.lit(float((weights or SCORE_WEIGHTS)[m]))
        total = term if total is None else total + term
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))


def quality_tier(score: Column) -> Column:
    out = None
    for least, name in TIERS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("very_poor")


def is_blurry(sharpness: Column, limit: float = 0.1) -> Column:
    return sharpness < limit


def is_overexposed(exposure: Column, limit: float = 0.9) -> Column:
    return exposure > limit


def is_underexposed(exposure: Column, limit: float = 0.1) -> Column:
    return exposure < limit


def is_low_quality(score: Column, limit: float = 50.0) -> Column:
    return score < limit


def compression_placeholder(width: Column, height: Column) -> Column:
    return F.when((width < 100) | (height < 100), F.lit(0.1)).otherwise(F.lit(0.3))


def estimated_bytes(width: Column, height: Column, fmt: Column) -> Column:
    per = F.when(F.lower(fmt).isin("jpeg", "jpg"), 0.3).when(F.lower(fmt) == "png", 1.5).when(F.lower(fmt) == "webp", 0.4).otherwise(1.0)
    return (width.cast("long") * height.cast("long") * per).cast("long")


# --- colour (16-bit channels) -----------------------------------------------------------------------


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v>, each 0..1."""
    r, g, b = (x / F.lit(65535.0) for x in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, F.lit(0.0)).when(hi == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.struct(h.alias("h"), F.when(hi == 0, F.lit(0.0)).otherwise(d / hi).alias("s"), hi.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct<r, g, b> of 16-bit channels."""
    i = F.floor(h * 6).cast("int")
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = F.pmod(i, F.lit(6))

    def pick(*six: Column) -> Column:
        out = F.when(k == 0, six[0])
        for n in range(1, 6):
            out = out.when(k == n, six[n])
        return (out * 65535).cast("int")

    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def _linear(x: Column) -> Column:
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> Column:
    """struct<x, y, z> on a scale of 100 (standard RGB primaries, daylight white)."""
    r, g, b = (_linear(c / F.lit(65535.0)) * 100 for c in (r, g, b))
    return F.struct(
        (r * 0.4124564 + g * 0.3575761 + b * 0.1804375).alias("x"), (r * 0.2126729 + g * 0.7151522 + b * 0.0721750).alias("y"), (r * 0.0193339 + g * 0.1191920 + b * 0.9503041).alias("z")
    )


def xyz_to_lab(xyz: Column) -> Column:
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)
    x, y, z = f(xyz.x / 95.047), f(xyz.y / 100.0), f(xyz.z / 108.883)
    return F.struct((y * 116 - 16).alias("l"), ((x - y) * 500).alias("a"), ((y - z) * 200).alias("b"))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    return xyz_to_lab(rgb_to_xyz(r, g, b))


def delta_e(p: Column, q: Column) -> Column:
    """Colour distance of two Lab structs."""
    return F.sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))


def temperature(red: Column, blue: Column) -> Column:
    """struct<kind, strength> from the sums of the red and blue channels."""
    x = red / blue
    kind = F.when(blue == 0, "neutral").when(x > 1.2, "warm").when(x < 0.8, "cool").otherwise("neutral")
    strength = F.when(blue == 0, F.lit(0.5)).when(x > 1.2, F.least((x - 1.2) / 0.8, F.lit(1.0))).when(x < 0.8, (0.8 - x) / 0.8).otherwise(F.lit(0.0))
    return F.struct(kind.alias("kind"), strength.alias("strength"))


# --- metadata and paths ------------------------------------------------------------------------------


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height == 0, F.lit(0.0)).otherwise(width / height)


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long") / 1e6


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def format_of(path: Column) -> Column:
    """Format name by extension: jpg is jpeg, tif is tiff, others without the dot."""
    e = extension(path)
    return F.when(e.isin(".jpg", ".jpeg"), "jpeg").when(e.isin(".tif", ".tiff"), "tiff").otherwise(F.substring(e, 2, 100))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def change_extension(path: Column, ext: str) -> Column:
    ext = ext if ext.startswith(".") or not ext else "." + ext
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ext))


def is_hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


def normalise_path(path: Column) -> Column:
    """Separators unified, repeated ones and ``.`` parts dropped, no separator at the end."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+(?:\./+)*", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"/\.$", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def is_subpath(path: Column, base: Column) -> Column:
    """Strictly below ``base``."""
    p, b = normalise_path(path), normalise_path(base)
    return F.when(b == "/", (p != "/") & p.startswith("/")).otherwise(p.startswith(F.concat(b, F.lit("/"))))


def relative_path(path: Column, base: Column) -> Column:
    """Path below ``base``; null where it does not lie there."""
    p, b = normalise_path(path), normalise_path(base)
    return F.when(p == b, ".").when(is_subpath(path, base), F.regexp_replace(F.substring(p, F.length(b) + 1, F.length(p)), "^/", ""))


def safe_join(base: str, path: Column) -> Column:
    """``base/path`` where that stays strictly below base; else null."""
    leaves = F.exists(F.split(path, "/"), lambda x: x == "..")
    joined = normalise_path(F.concat(F.lit(base.rstrip("/") + "/"), path))
    return F.when(~leaves & is_subpath(joined, F.lit(base)), joined)


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in steps of 1024."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate("KMGTPE", 1):
        value = F.format_string(f"%.1f {unit}B", n / float(1024**i))
        out = out.when(n < 1024 ** (i + 1), value) if i < 6 else out.otherwise(value)
    return out


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part * 100.0 / total)


def invalid_image(width: Column, height: Column, size: Column, fmt: Column) -> Column:
    """Why an image is rejected; null for valid ones."""
    area = width.cast("long") * height.cast("long")
    return (
        F.when(F.coalesce(width, F.lit(0)) <= 0, "no width")
        .when(F.coalesce(height, F.lit(0)) <= 0, "no height")
        .when(area > 100_000_000, "too many pixels")
        .when(size > 500 * 1024 * 1024, "file too large")
        .when((fmt == "jpeg") & ((width < 16) | (height < 16)), "jpeg too small")
        .when((fmt == "png") & ((width > 32767) | (height > 32767)), "png too large")
        .when(~F.coalesce(fmt.isin("jpeg", "jpg", "png", "webp", "tiff", "bmp", "gif"), F.lit(False)), "format")
    )


def invalid_metadata(path: Column, size: Column, width: Column, height: Column, fmt: Column) -> Column:
    """Why a metadata record is rejected; null for valid ones."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "path")
        .when(F.coalesce(size, F.lit(0)) <= 0, "size")
        .when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "dimensions")
        .when(F.coalesce(fmt, F.lit("")) == "", "format")
    )


def has_extension(path: Column, formats: Sequence[str]) -> Column:
    return extension(path).isin(*[f if f.startswith(".") else "." + f for f in formats])


def in_excluded_dir(path: Column, names: Sequence[str]) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda p: F.lower(p).isin(*[n.lower() for n in names]))
