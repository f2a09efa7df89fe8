import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def png(path, rgb: np.ndarray) -> str:
    """A PNG file written with zlib alone."""
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return str(path)


def gradient(w: int, h: int) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return np.stack([255 * x // max(1, w - 1), 255 * y // max(1, h - 1), (x + y) * 255 // max(1, w + h - 2)], -1).astype(np.uint8)


FP_SCHEMA = (
    "id string, metadata struct<path:string,size_bytes:bigint,format:string,width:int,height:int,modified_at:timestamp,"
    "exif:struct<camera_model:string,lens_model:string,iso:int,exposure:string,aperture:double,focal_length:double,taken_at:timestamp,gps_lat:double,gps_lon:double,has_gps:boolean>,sha256:string>,"
    "perceptual_hashes struct<a_hash:bigint,p_hash:bigint,d_hash:bigint,w_hash:bigint>,"
    "quality struct<sharpness:double,noise:double,exposure:double,contrast:double,compression:double,color_cast:double,final_score:double>,"
    "color_histogram array<double>, feature_vector array<float>, created_at timestamp"
)


def fp_row(id, sha=None, hashes=(0, 0, 0, 0), score=50.0, path=None, size=1000, w=100, h=100, exif=None, vec=None, hist=None, mtime=None, created=None):
    meta = (path or f"/a/{id}.jpg", size, "jpeg", w, h, mtime, exif, sha)
    return (id, meta, hashes, (0.5, 0.1, 0.5, 0.5, 0.1, 0.1, score), hist, vec, created)


SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, run, sql: str, folder: str = SMALL) -> None:
    """The rows of a query and of its SQL over the same files, in any order."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(sql).to_arrow_table()
    got = run(spark, folder).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(tuple(repr(r[c]) for c in columns) for r in t.to_pylist())
    assert rows(got) == rows(want)
