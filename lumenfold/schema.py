"""Record types of the engine, and the enumerations that its options use."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

_f = T.StructField

EXIF = T.StructType([
    _f("camera_model", T.StringType()), _f("lens_model", T.StringType()), _f("iso", T.IntegerType()), _f("exposure", T.StringType()),
    _f("aperture", T.DoubleType()), _f("focal_length", T.DoubleType()), _f("taken_at", T.TimestampType()),
    _f("gps_lat", T.DoubleType()), _f("gps_lon", T.DoubleType()), _f("has_gps", T.BooleanType()),
])
METADATA = T.StructType([
    _f("path", T.StringType()), _f("size_bytes", T.LongType()), _f("format", T.StringType()), _f("width", T.IntegerType()),
    _f("height", T.IntegerType()), _f("modified_at", T.TimestampType()), _f("exif", EXIF), _f("sha256", T.StringType()),
])
HASHES = T.StructType([_f(h, T.LongType()) for h in ("a_hash", "p_hash", "d_hash", "w_hash")])
METRICS = ("sharpness", "noise", "exposure", "contrast", "compression", "color_cast")
QUALITY = T.StructType([_f(m, T.DoubleType()) for m in (*METRICS, "final_score")])
FINGERPRINT = T.StructType([
    _f("id", T.StringType()), _f("metadata", METADATA), _f("perceptual_hashes", HASHES), _f("quality", QUALITY),
    _f("color_histogram", T.ArrayType(T.DoubleType())), _f("feature_vector", T.ArrayType(T.FloatType())), _f("created_at", T.TimestampType()),
])
DUPLICATE_GROUP = T.StructType([
    _f("group_id", T.StringType()), _f("main_image", T.StringType()), _f("duplicate_ids", T.ArrayType(T.StringType())),
    _f("reason", T.StringType()), _f("confidence", T.DoubleType()),
])
CLUSTER = T.StructType([_f("cluster_id", T.StringType()), _f("name", T.StringType()), _f("images", T.ArrayType(T.StringType())), _f("centroid", T.ArrayType(T.FloatType()))])


class Policy(Enum):
    """Which member of a group is kept."""

    HIGHEST_QUALITY = 0
    HIGHEST_RESOLUTION = 1
    BEST_EXPOSURE = 2
    OLDEST = 3
    NEWEST = 4


class NotFound(LookupError):
    """No record has the id asked for."""


class ImageTooSmall(ValueError):
    """The image has too few pixels for the measure."""


#: Lower bounds of the quality tiers.
TIERS = ((80, "excellent"), (70, "good"), (50, "average"), (30, "poor"))
#: Supported extensions of the scanner, of the engine preset, and of the API list.
SCANNER_FORMATS = (".jpg", ".jpeg", ".png", ".webp", ".tiff", ".bmp", ".gif")
ENGINE_FORMATS = (".jpg", ".jpeg", ".png", ".webp", ".tiff", ".bmp")
API_FORMATS = (".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif", ".bmp", ".gif")
#: Directories that the image filter leaves out.
EXCLUDED_DIRS = (".git", ".svn", ".hg", "node_modules", "__pycache__", "thumbs", "thumbnails", ".thumbnails")
