"""Writing image rows as PNG files, with camera data where given."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import pixels as P
from lumenfold.sources.exif import DATE_TIME, GPS_DIR, MODEL


def tiff_block(model: str | None = None, taken: str | None = None, position: tuple[float, float] | None = None) -> bytes:
    """The camera's name, the time (year:month:day hour:minute:second) and the position in degrees as TIFF directories."""
    texts = [(tag, t.encode() + b"\0") for tag, t in ((MODEL, model), (DATE_TIME, taken)) if t]
    n = len(texts) + (position is not None)
    at = 8 + 2 + 12 * n + 4
    entries, rest = [], b""
    for tag, raw in texts:
        entries.append(struct.pack("<HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(rest))))
        rest += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
    if position is not None:
        here = at + len(rest)
        entries.append(struct.pack("<HHII", GPS_DIR, 4, 1, here))
        values = here + 2 + 12 * 4 + 4
        lat, lon = position
        degrees = b"".join(struct.pack("<IIIIII", 0, 1, 0, 1, round(abs(v) * 3600 * 1_000_000) & 0xFFFFFFFF, 1_000_000) if abs(v) * 3600e6 < 2**32 else struct.pack("<IIIIII", int(abs(v)), 1, 0, 1, round((abs(v) - int(abs(v))) * 3600 * 1_000_000), 1_000_000) for v in (lat, lon))
        refs = (b"S" if lat < 0 else b"N", b"W" if lon < 0 else b"E")
        rows = [struct.pack("<HHI", 1, 2, 2) + refs[0].ljust(4, b"\0"), struct.pack("<HHII", 2, 5, 3, values), struct.pack("<HHI", 3, 2, 2) + refs[1].ljust(4, b"\0"), struct.pack("<HHII", 4, 5, 3, values + 24)]
        rest += struct.pack("<H", 4) + b"".join(rows) + b"\0" * 4 + degrees
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n) + b"".join(entries) + b"\0" * 4 + rest


def encode_png(rgb, exif: bytes | None = None) -> bytes:
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    return head + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pngs(images: DataFrame, folder: str) -> DataFrame:
    """Write image rows as ``folder``/``path``.png; gives ``path`` of each file and ``bytes``, and writes when it is evaluated.

    ``images``: path, width, height, channels, data, and optionally camera_model, taken (text), lat, lon.  Files are reached through
    the workers' file system (shared storage on a cluster); one that an earlier attempt wrote is replaced.  Undecodable rows are left out.
    """
    folder = folder.removeprefix("file://").rstrip("/")
    more = [F.col(c).cast(k) if c in images.columns else F.lit(None).cast(k).alias(c) for c, k in (("camera_model", "string"), ("taken", "string"), ("lat", "double"), ("lon", "double"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = [], []
            for path, w, h, ch, data, model, taken, lat, lon in zip(*(c.to_pylist() for c in b.columns)):
                rgb = P.from_spark(w, h, ch, data)
                if rgb is None:
                    continue
                exif = tiff_block(model, taken, (lat, lon) if lat is not None and lon is not None else None) if model or taken or lat is not None else None
                out, content = f"{folder}/{path}.png", encode_png(rgb, exif)
                os.makedirs(os.path.dirname(out), exist_ok=True)
                with open(f"{out}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{out}.{os.getpid()}", out)
                paths.append(out)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return images.select("path", "width", "height", "channels", "data", *more).mapInArrow(run, "path string, bytes long")
