"""Pixel transforms over image rows (path, width, height, channels, data), in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import pixels as P

#: Names of the steps that may be asked for.
STEPS = ("resize", "resize_to_fit", "resize_to_cover", "resize_to_fill", "crop", "crop_center", "rotate", "orient", "adjust", "blur", "sharpen", "preprocess")
ROW = "path string, width int, height int, channels int, data binary"


def transform_images(images: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """The images after the steps, each a name and its arguments; undecodable rows are left out.

    Adds ``old_width`` and ``old_height``.  Data is BGR, as the image source gives it.
    """
    unknown = {s[0] for s in steps} - set(STEPS)
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "width", "height", "channels", "data", "old_width", "old_height"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for path, w, h, ch, data in zip(*(c.to_pylist() for c in b.columns)):
                rgb = P.from_spark(w, h, ch, data)
                if rgb is None:
                    continue
                for name, *args in steps:
                    rgb = getattr(P, name)(rgb, *args)
                for c, v in zip(cols, (path, rgb.shape[1], rgb.shape[0], 3, rgb[:, :, ::-1].tobytes(), w, h)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return images.select("path", "width", "height", "channels", "data").mapInArrow(run, ROW + ", old_width int, old_height int")


def transform_info(old_w: Column, old_h: Column, new_w: Column, new_h: Column) -> Column:
    """struct<scale_x, scale_y, old_aspect, new_aspect>; zeros where a side is 0."""
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return F.struct(share(new_w, old_w).alias("scale_x"), share(new_h, old_h).alias("scale_y"), share(old_w, old_h).alias("old_aspect"), share(new_w, new_h).alias("new_aspect"))


def metadata_summary(metadata: Column) -> Column:
    """JSON text of a metadata record without its empty fields."""
    return F.to_json(metadata)
