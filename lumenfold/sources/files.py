"""Files as rows: folder scans, composable file predicates, header-only sizes, fingerprints of images."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.config import EngineConfig
from lumenfold.functions import scalars as S
from lumenfold.schema import EXCLUDED_DIRS, EXIF, FINGERPRINT, HASHES, METRICS, SCANNER_FORMATS


@dataclass
class FileFilter:
    """Included extensions (empty: all), excluded ones, size bounds (0: none) and excluded directories."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_size: int = 0
    max_size: int = 0
    exclude_dirs: tuple[str, ...] = field(default=())

    def column(self, path: Column, size: Column) -> Column:
        keep = F.lit(True)
        if self.include:
            keep = keep & S.has_extension(path, [e.lower() for e in self.include])
        if self.exclude:
            keep = keep & ~S.has_extension(path, [e.lower() for e in self.exclude])
        if self.min_size > 0:
            keep = keep & (size >= self.min_size)
        if self.max_size > 0:
            keep = keep & (size <= self.max_size)
        if self.exclude_dirs:
            keep = keep & ~S.in_excluded_dir(path, self.exclude_dirs)
        return F.coalesce(keep, F.lit(False))


def image_filter() -> FileFilter:
    """All supported formats, 1 KiB to 500 MiB, without version control, cache and thumbnail folders."""
    return FileFilter(SCANNER_FORMATS + (".tif",), (), 1024, 500 * 1024 * 1024, EXCLUDED_DIRS)


def glob_for(extensions) -> str:
    """Case-insensitive file-name glob, so that other files are never opened."""
    one = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".").lower())
    return "*.{" + ",".join(one(e) for e in extensions) + "}"


def escaped(path: str) -> str:
    """A path that readers take literally, not as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scan_folder(spark: SparkSession, root: str | list[str], files: FileFilter | None = None, content: bool = True) -> DataFrame:
    """``path``, ``size_bytes``, ``modified_at``, ``format`` (and ``content``) of the files below ``root`` (a folder, or a list of files).

    The size bound and the columns reach the reader; a missing or non-folder root raises.  Names
    that start with ``.`` or ``_`` are listed only where they are named themselves.  An empty folder gives no row.
    """
    files = files or FileFilter(SCANNER_FORMATS, max_size=500 * 1024 * 1024)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if files.include:
        reader = reader.option("pathGlobFilter", glob_for(files.include))
    df = reader.load(root)
    path = F.regexp_replace("path", "^file:", "")
    df = df.where(files.column(path, F.col("length")))
    cols = [path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), S.format_of(path).alias("format")]
    return df.select(*cols, *(["content"] if content else []))


_SOF = re.compile(rb"\xff[\xc0-\xc3\xc5-\xc7\xc9-\xcb\xcd-\xcf]")


def _tiff_size(data: bytes) -> tuple[str, int, int] | None:
    end = {b"II*\0": "<", b"MM\0*": ">"}[data[:4]]
    at = struct.unpack_from(end + "I", data, 4)[0]
    found = {}
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind = struct.unpack_from(end + "HH", data, at + 2 + 12 * i)
        if tag in (256, 257):  # width, height
            found[tag] = struct.unpack_from(end + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
    return ("tiff", found[256], found[257]) if len(found) == 2 else None


def _webp_size(data: bytes) -> tuple[str, int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack_from("<HH", data, 26)
        return "webp", w & 0x3FFF, h & 0x3FFF
    return None


def header_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of png, jpeg, gif, bmp, webp or tiff content."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_size(data)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                if _SOF.match(data, at):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    except (struct.error, IndexError):
        pass
    return None


def with_header_size(files: DataFrame, head_bytes: int = 1 << 18) -> DataFrame:
    """Adds nullable ``decoded_format``, ``width``, ``height``, read from the head of ``content`` without pixels.

    Where the segments of a jpeg file, or the directory of a tiff file, lie beyond the head, all of its content is read.
    """

    @F.pandas_udf("decoded_format string, width int, height int")
    def read(head):
        import pandas as pd

        got = [header_size(bytes(b)) if b is not None else None for b in head]
        return pd.DataFrame([g or (None, None, None) for g in got], columns=["decoded_format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    @F.pandas_udf("boolean")
    def beyond(head):
        import pandas as pd

        return pd.Series([b is not None and bytes(b[:2]) in (b"\xff\xd8", b"II", b"MM") and header_size(bytes(b)) is None for b in head], dtype=bool)

    head = F.substring("content", 1, head_bytes)
    whole = beyond(F.when(F.length("content") > head_bytes, head))
    return files.withColumn("_head", read(F.when(whole, F.col("content")).otherwise(head))).select("*", "_head.*").drop("_head")


def with_facts(files: DataFrame, head_bytes: int = 1 << 18) -> DataFrame:
    """Adds ``exif``, ``decoded_format``, ``width``, ``height``: what ``with_exif`` and ``with_header_size`` add, in one pass over the heads.

    All of a file's content is read only where its head does not suffice.
    """
    from lumenfold.sources.exif import parse_exif, reaches_beyond

    kind = T.StructType([*EXIF.fields, T.StructField("_exif", T.BooleanType()), T.StructField("decoded_format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("_more", T.BooleanType())])
    names = kind.names

    @F.pandas_udf(kind)
    def read(head):
        import pandas as pd

        rows = []
        for b in head:
            if b is None:
                rows.append(dict.fromkeys(names))
                continue
            b = bytes(b)
            exif, size = parse_exif(b), header_size(b)
            more = reaches_beyond(b) or (size is None and b[:2] in (b"\xff\xd8", b"II", b"MM"))
            rows.append((exif or {}) | dict(zip(("decoded_format", "width", "height"), size or (None, None, None))) | {"_exif": exif is not None, "_more": more})
        out = pd.DataFrame(rows, columns=names)
        for c, t in {"iso": "Int32", "width": "Int32", "height": "Int32", "has_gps": "boolean", "_exif": "boolean", "_more": "boolean", **dict.fromkeys(("aperture", "focal_length", "gps_lat", "gps_lon"), "Float64"), **dict.fromkeys(("camera_model", "lens_model", "exposure", "decoded_format"), object)}.items():
            out[c] = out[c].astype(t)
        out["taken_at"] = pd.to_datetime(out["taken_at"])
        return out

    first = files.withColumn("_f", read(F.substring("content", 1, head_bytes)))
    rest = F.when(F.col("_f._more") & (F.length("content") > head_bytes), F.col("content"))
    best = first.withColumn("_g", read(rest)).withColumn("_f", F.when(F.col("_g._exif").isNotNull(), F.col("_g")).otherwise(F.col("_f")))
    exif = F.when(F.col("_f._exif"), F.struct(*[F.col(f"_f.{n}").alias(n) for n in EXIF.names]))
    return best.select(*files.columns, exif.alias("exif"), "_f.decoded_format", "_f.width", "_f.height")


def read_images(spark: SparkSession, root: str | list[str], files: FileFilter | None = None) -> DataFrame:
    """Decoded pixels below ``root``; undecodable files are rows with a width of -1. The path part of the filter is applied."""
    df = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob_for((files and files.include) or SCANNER_FORMATS)).load(root)
    if files:
        df = df.where(FileFilter(files.include, files.exclude, exclude_dirs=files.exclude_dirs).column(F.col("image.origin"), F.lit(0)))
    return df.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def measure_images(images: DataFrame, config: EngineConfig | None = None, bins: int = 16) -> DataFrame:
    """``path``, ``hashes``, ``quality``, ``color_histogram``, ``feature_vector`` of decodable images.

    A hash that fails is 0; failed quality measures give zeros with a final score of 50.
    """
    from lumenfold.functions import pixels as P

    config = config or EngineConfig()
    names = config.hash_names()
    kind = f"path string, width int, height int, hashes {HASHES.simpleString()}, quality struct<{','.join(f'{m}:double' for m in (*METRICS, 'final_score'))}>, color_histogram array<double>, feature_vector array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("hashes", pa.struct([(f.name, pa.int64()) for f in HASHES])),
            ("quality", pa.struct([(m, pa.float64()) for m in (*METRICS, "final_score")])), ("color_histogram", pa.list_(pa.float64())), ("feature_vector", pa.list_(pa.float32())),
        ])
        for b in batches:
            rows = []
            for path, w, h, ch, data in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                rgb = P.from_spark(w, h, ch, data.as_buffer())
                if rgb is None:
                    continue
                hashes = {f.name: 0 for f in HASHES}
                for n in names:
                    try:
                        hashes[n] = P.HASHERS[config.hash_variant][n](rgb)
                    except (ValueError, IndexError, ZeroDivisionError):
                        pass
                try:
                    quality = P.quality_metrics(rgb)
                except (ValueError, IndexError, ZeroDivisionError):
                    quality = dict.fromkeys(METRICS, 0.0) | {"final_score": 50.0}
                rows.append({"path": path, "width": w, "height": h, "hashes": hashes, "quality": quality, "color_histogram": P.rgb_histogram(rgb, bins).tolist(), "feature_vector": P.feature_vector(rgb).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return images.select("path", "width", "height", "channels", "data").mapInArrow(run, kind)


#: Formats whose size is known from the header but whose pixels the JVM does not decode.
UNDECODED = ("webp",)


def fingerprint_folder(spark: SparkSession, root: str | list[str], config: EngineConfig | None = None, files: FileFilter | None = None) -> DataFrame:
    """The fingerprint record of every image below ``root`` (a folder, or a list of files); files that are no images are left out.

    Content is hashed in the JVM; pixels are measured in Arrow batches; both sides meet on the path.  Images of a format without a
    decoder have their size and content hash, hashes of 0 and no measures.
    """
    config = config or EngineConfig()
    files = files or config.file_filter()
    listed = with_facts(scan_folder(spark, root, files)).withColumn("sha256", F.sha2("content", 256)).drop("content")
    if config.compat_exif:
        listed = listed.withColumn("exif", placeholder_exif(F.col("path")))
    measured = measure_images(read_images(spark, root, files), config).withColumnsRenamed({"width": "w", "height": "h"})
    both = listed.join(measured, "path", "left").where(F.col("w").isNotNull() | F.col("decoded_format").isin(*UNDECODED))
    both = both.withColumns({"width": F.coalesce("w", "width"), "height": F.coalesce("h", "height")})
    meta = F.struct("path", "size_bytes", "format", "width", "height", "modified_at", "exif", "sha256")
    hashes = F.coalesce("hashes", F.struct(*[F.lit(0).cast("long").alias(f.name) for f in HASHES]))
    cols = [S.image_id(F.col("path")).alias("id"), meta.alias("metadata"), hashes.alias("perceptual_hashes"), "quality", "color_histogram", "feature_vector", F.current_timestamp().alias("created_at")]
    return both.select(*cols).to(FINGERPRINT)


def placeholder_exif(path: Column) -> Column:
    """The record that stands for unread camera data: a named placeholder by (case-sensitive) extension."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    model = F.when(ext.isin(".jpg", ".jpeg"), "Unknown JPEG Camera").when(ext == ".png", "Unknown PNG Source")
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        model.alias("camera_model"), null("string").alias("lens_model"), null("int").alias("iso"), null("string").alias("exposure"), null("double").alias("aperture"),
        null("double").alias("focal_length"), null("timestamp").alias("taken_at"), null("double").alias("gps_lat"), null("double").alias("gps_lon"), F.lit(False).alias("has_gps"),
    )
