"""Camera data from file content: the TIFF directories of the public EXIF standard, for jpeg, png, webp and tiff."""

from __future__ import annotations

import struct
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schema import EXIF

#: Tag numbers of the EXIF standard.
MAKE, MODEL, DATE_TIME, EXIF_DIR, GPS_DIR = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825
EXPOSURE, F_NUMBER, ISO, ORIGINAL, FOCAL, LENS = 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA434
#: Bytes of each field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMS = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}


def _tiff_span(data: bytes) -> tuple[int, int]:
    """Where the TIFF directories stand; an end beyond ``data`` where more content is needed to tell, (0, 0) for none."""
    more = (len(data), len(data) + 1)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return 0, len(data) + 1  # directories stand anywhere in the file
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF or data[at + 1] == 0xDA:
                return 0, 0
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return at + 10, at + 2 + n
            at += 2 + n
        return more
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if kind in (b"eXIf", b"IEND"):
                return (at + 8, at + 8 + n) if kind == b"eXIf" else (0, 0)
            at += 12 + n
        return more
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at, end = 12, 8 + int.from_bytes(data[4:8], "little")
        while at + 8 <= len(data):
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                return at + 8, at + 8 + n
            at += 8 + n + n % 2
        return more if at < end else (0, 0)
    return 0, 0


def _tiff_block(data: bytes) -> bytes | None:
    start, end = _tiff_span(data)
    block = data[start:end]
    return (block[6:] if block[:6] == b"Exif\0\0" else block) or None


def reaches_beyond(head: bytes) -> bool:
    """Whether the head of a longer file does not hold all that ``parse_exif`` needs."""
    return _tiff_span(head)[1] > len(head)


def _directory(b: bytes, at: int, end: str) -> dict[int, list]:
    out = {}
    (count,) = struct.unpack_from(end + "H", b, at)
    for i in range(min(count, 512)):
        tag, kind, n, _ = struct.unpack_from(end + "HHII", b, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * n
        if not size or size > 65536:
            continue
        pos = at + 10 + 12 * i if size <= 4 else struct.unpack_from(end + "I", b, at + 10 + 12 * i)[0]
        raw = b[pos : pos + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = [raw.split(b"\0")[0].decode("utf-8", "replace").strip()]
        elif kind in (5, 10):
            v = struct.unpack(end + ("II" if kind == 5 else "ii") * n, raw)
            out[tag] = list(zip(v[::2], v[1::2]))
        elif kind in _FORMS:
            out[tag] = list(struct.unpack(end + _FORMS[kind] * n, raw))
    return out


def _number(v: tuple[int, int] | None) -> float | None:
    return v[0] / v[1] if v and v[1] else None


def _degrees(v: list | None, ref: list | None) -> float | None:
    parts = [_number(x) for x in v or []]
    if len(parts) != 3 or None in parts:
        return None
    d = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -d if ref and ref[0] in ("S", "W") else d


def parse_exif(data: bytes) -> dict | None:
    """The EXIF record of a file's content; None where there is none or it is broken."""
    try:
        b = _tiff_block(data)
        if not b:
            return None
        end = "<" if b[:2] == b"II" else ">"
        top = _directory(b, struct.unpack_from(end + "I", b, 4)[0], end)
        sub = _directory(b, top[EXIF_DIR][0], end) if EXIF_DIR in top else {}
        gps = _directory(b, top[GPS_DIR][0], end) if GPS_DIR in top else {}
        first = lambda d, t: (d.get(t) or [None])[0]
        out = dict.fromkeys(f.name for f in EXIF)
        out["camera_model"] = " ".join(x for x in (first(top, MAKE), first(top, MODEL)) if x) or None
        out["lens_model"], out["iso"] = first(sub, LENS), first(sub, ISO)
        e = first(sub, EXPOSURE)
        if e and e[0] and e[1]:
            out["exposure"] = f"1/{e[1] // e[0]}" if e[1] > e[0] else f"{e[0] / e[1]:g}"
        out["aperture"], out["focal_length"] = _number(first(sub, F_NUMBER)), _number(first(sub, FOCAL))
        when = first(sub, ORIGINAL) or first(top, DATE_TIME)
        try:
            out["taken_at"] = datetime.strptime(when, "%Y:%m:%d %H:%M:%S") if when else None
        except ValueError:
            pass
        out["gps_lat"], out["gps_lon"] = _degrees(gps.get(2), gps.get(1)), _degrees(gps.get(4), gps.get(3))
        out["has_gps"] = out["gps_lat"] is not None and out["gps_lon"] is not None
        return out
    except (struct.error, IndexError, TypeError, KeyError):
        return None


def with_exif(files: DataFrame, head_bytes: int = 1 << 18) -> DataFrame:
    """Adds ``exif``, read from the head of ``content``, or from all of it where the head points beyond; null where there is none."""

    @F.pandas_udf("boolean")
    def beyond(head: pd.Series) -> pd.Series:
        return pd.Series([b is not None and reaches_beyond(bytes(b)) for b in head], dtype=bool)

    @F.pandas_udf(EXIF)
    def read(head: pd.Series) -> pd.DataFrame:
        rows = [parse_exif(bytes(b)) if b is not None else None for b in head]
        empty = dict.fromkeys(f.name for f in EXIF)
        out = pd.DataFrame([r or empty for r in rows], columns=list(empty))
        out["iso"], out["taken_at"], out["has_gps"] = out["iso"].astype("Int32"), pd.to_datetime(out["taken_at"]), out["has_gps"].astype("boolean")
        return out.astype({c: "Float64" for c in ("aperture", "focal_length", "gps_lat", "gps_lon")})

    head = F.substring("content", 1, head_bytes)
    whole = beyond(F.when(F.length("content") > head_bytes, head))
    found = files.withColumn("_exif", read(F.when(whole, F.col("content")).otherwise(head)))
    return found.withColumn("exif", F.when(F.col("_exif.has_gps").isNotNull(), F.col("_exif"))).drop("_exif")


def exif_flags(exif) -> dict:
    """Conditions "has a camera", "has exposure data", "has a position" over an exif column."""
    text = lambda c: F.coalesce(c != "", F.lit(False))
    pos = lambda c: F.coalesce(c != 0, F.lit(False))
    return {
        "has_camera": text(exif["camera_model"]),
        "has_exposure": text(exif["exposure"]) | pos(exif["aperture"]) | pos(exif["iso"]),
        "has_gps": F.coalesce(exif["has_gps"], F.lit(False)) & pos(exif["gps_lat"]) & pos(exif["gps_lon"]),
    }
