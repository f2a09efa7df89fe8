"""Measures of decoded images (path, width, height, channels, data) as rows, in Arrow batches; pyramids and collages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import pixels as P

_KIND = {"warm": 1.0, "neutral": 0.0, "cool": -1.0}


def _numbered(values) -> dict[str, float]:
    return {str(i): float(v) for i, v in enumerate(values)}


def _temperature(rgb: np.ndarray) -> dict[str, float]:
    kind, strength = P.color_temperature(rgb)
    return {"kind": _KIND[kind], "strength": strength}


def checksum(rgb: np.ndarray) -> float:
    """Sum of the channels, weighted by place, for comparing images."""
    h, w = rgb.shape[:2]
    y, x = np.mgrid[:h, :w]
    return float((rgb.astype(np.int64) * (3 * x + 5 * y + 1)[..., None] * np.array([1, 2, 3])).sum())


#: Measures by name: one number, or a record of numbers (put out as name.part), of an RGB image.
MEASURES: dict[str, Callable[[np.ndarray], float | dict[str, float]]] = {
    "sharpness": P.sharpness, "noise": P.noise, "noise_16_bit": lambda a: P.noise(a, 65535), "exposure": P.exposure, "contrast": P.contrast, "color_cast": P.color_cast,
    "compression": P.compression, "compression_measured": lambda a: P.compression(a, True), "blockiness": P.blockiness, "ringing": P.ringing, "compression_noise": P.compression_noise,
    "quality": P.quality_metrics, "edges": P.edge_stats, "focus": P.focus_regions, "noise_patterns": P.noise_patterns, "temperature": _temperature,
    "colors": P.color_distribution, "blank": lambda a: float(P.is_blank(a, 0.9)), "dominant": lambda a: _numbered(65536 * r + 256 * g + b for r, g, b in P.dominant_colors(a, 5)),
    "rgb_histogram": lambda a: _numbered(P.rgb_histogram(a)), "hsv_histogram": lambda a: _numbered(P.hsv_histogram(a)), "luminance_histogram": lambda a: _numbered(P.luminance_histogram(a)),
    "feature_vector": lambda a: _numbered(P.feature_vector(a)), "moments": P.moments, "checksum": checksum, "size": lambda a: {"width": a.shape[1], "height": a.shape[0]},
}


def measures(images: DataFrame, names: Sequence[str], keep: Sequence[str] = ("path",)) -> DataFrame:
    """``keep``, ``measure``, ``value``: one row for each number of each named measure; undecodable images give none.

    A measure that an image is too small for, or that fails on it, is null.
    """
    unknown = set(names) - set(MEASURES)
    if unknown:
        raise ValueError(f"no such measure: {sorted(unknown)}")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, what, value = [], [], []
            for i, (w, h, ch, data) in enumerate(zip(*(c.to_pylist() for c in b.columns[k:]))):
                rgb = P.from_spark(w, h, ch, data)
                if rgb is None:
                    continue
                for name in names:
                    try:
                        got = MEASURES[name](rgb)
                    except (ValueError, IndexError, ZeroDivisionError):
                        got = None
                    for part, v in got.items() if isinstance(got, dict) else [("", got)]:
                        at.append(i)
                        what.append(f"{name}.{part}" if part else name)
                        value.append(None if v is None else float(v))
            kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:k]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(what, pa.string()), pa.array(value, pa.float64())], names=[*keep, "measure", "value"])

    cols = images.select(*keep, "width", "height", "channels", "data")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:k])
    return cols.mapInArrow(run, f"{kinds}, measure string, value double")


def _row(path: str, level: int, rgb: np.ndarray) -> tuple:
    return path, level, rgb.shape[1], rgb.shape[0], 3, rgb[:, :, ::-1].tobytes()


_LEVELS = "path string, level int, width int, height int, channels int, data binary"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [c.split()[0] for c in _LEVELS.split(", ")]


def pyramid_images(images: DataFrame, levels: int, least: int = 16) -> DataFrame:
    """``path``, ``level`` (0: the image itself), ``width``, ``height``, ``channels``, ``data``: each level half as large, down to sides of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, w, h, ch, data in zip(*(c.to_pylist() for c in b.columns)):
                rgb = P.from_spark(w, h, ch, data)
                if rgb is not None:
                    rows = [_row(path, i, a) for i, a in enumerate(P.pyramid(rgb, levels, least))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return images.select("path", "width", "height", "channels", "data").mapInArrow(run, _LEVELS)


def collage_images(images: DataFrame, columns: int, per_page: int = 64) -> DataFrame:
    """``page``, ``width``, ``height``, ``channels``, ``data``: the images side by side, in the order of their paths, ``per_page`` on a page.

    Pages are numbered over sorted ranges, so that no task holds more than one page; undecodable images are left out.
    """
    from lumenfold.operators.duplicates import number_groups

    rows = number_groups(images.where("width > 0 and data is not null").select("path", "width", "height", "channels", "data"), "path", "")
    paged = rows.withColumn("page", F.floor((F.substring("group_id", 2, 20).cast("long") - 1) / per_page).cast("int"))

    def lay(t: pa.Table) -> pa.Table:
        got = sorted(zip(*(t.column(c).to_pylist() for c in ("path", "width", "height", "channels", "data"))))
        a = P.collage([P.from_spark(*r[1:]) for r in got], columns)
        return pa.table({"page": t.column("page").slice(0, 1), "width": pa.array([a.shape[1]], pa.int32()), "height": pa.array([a.shape[0]], pa.int32()), "channels": pa.array([3], pa.int32()), "data": pa.array([a[:, :, ::-1].tobytes()], pa.binary())})

    return paged.groupBy("page").applyInArrow(lay, "page int, width int, height int, channels int, data binary")
