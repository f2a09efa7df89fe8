"""Session-level helpers: shared folder, lineage cuts, table loading.

All intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that they
outlive any executor.  A private folder is set only when the session names none (tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set where the session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders of this process's applications; they go when it ends, or by ``release``.
_OWNED: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder below the shared one, which is removed when the process ends."""
    own = f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}"
    if not _OWNED:
        atexit.register(release)
    _OWNED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def release() -> None:
    """Remove all intermediate tables of this process; plans over them can no longer run."""
    gateway = SparkContext._gateway
    while _OWNED:
        path = _OWNED.pop()
        try:
            p = gateway.jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at the end of the process
            pass


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p, True)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a parquet table in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(col: Column | str) -> Column:
    """Ids trimmed of white space, lower-cased; blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def width(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffle_width(spark: SparkSession, nbytes: int, each: int = 16_000_000) -> Iterator[None]:
    """Within: shuffles of as many partitions as ``nbytes`` need at ``each`` bytes, or as the session asks for if that is more."""
    before = width(spark)
    spark.conf.set("spark.sql.shuffle.partitions", max(before, -(-nbytes // each)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


#: At most this many keys are treated as hot; a key with more than 1/HOT_KEYS of the rows is always among them.
HOT_KEYS = 128


def hot_keys(df: DataFrame, key: str, least: int = 5000) -> list:
    """The most frequent values of ``key`` with more than ``least`` rows, at most HOT_KEYS."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least)
    return [r[0] for r in counts.orderBy(F.col("count").desc(), key).limit(HOT_KEYS).collect()]


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", least: int = 5000, rows: int | None = None) -> DataFrame:
    """Equi-join on one column of equal name, where ``small`` has at most one row a key.

    Rows of hot keys are joined with a broadcast of at most HOT_KEYS rows, so they stay spread
    over their partitions, and so do rows without a key; all others go through an ordinary shuffled join.
    ``rows``: how many ``big`` has, where that is known; with no more than ``least`` no key is hot, and none is looked for.
    """
    if rows is not None and rows <= least:
        return big.join(small, key, how)
    keys = hot_keys(big, key, least)
    if not keys and how == "inner":
        return big.join(small, key, how)
    apart = F.col(key).isNull() | F.coalesce(F.col(key).isin(keys), F.lit(False))
    dense = big.where(apart).join(F.broadcast(small.where(F.col(key).isin(keys))), key, how)
    return big.where(~apart).join(small, key, how).unionByName(dense)
