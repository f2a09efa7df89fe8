"""Scanning a growing folder: new files are fingerprinted once each and upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.config import EngineConfig
from lumenfold.functions import scalars as S
from lumenfold.sources.files import glob_for
from lumenfold.sources.store import FingerprintStore

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def new_files(spark: SparkSession, root: str, config: EngineConfig | None = None, batch_files: int = 1000) -> DataFrame:
    """Stream of ``path``, ``size_bytes``, ``modified_at``, ``format``, ``sha256`` of files that appear below ``root``."""
    config = config or EngineConfig()
    src = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob_for(config.formats)).option("maxFilesPerTrigger", batch_files).load(root)
    path = F.regexp_replace("path", "^file:", "")
    src = src.where(config.file_filter().column(path, F.col("length")))
    return src.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), S.format_of(path).alias("format"), F.sha2("content", 256).alias("sha256"))


def watch(spark: SparkSession, root: str, store: FingerprintStore, checkpoint: str, config: EngineConfig | None = None, batch_files: int = 1000):
    """A query that fingerprints each batch of new files into ``store``; runs until all present files are done.

    Only the files of the batch, at most ``batch_files``, are opened and decoded.  A batch that is repeated after a failure replaces the
    same ids, so the store ends the same.
    """
    from lumenfold.sources.files import escaped, fingerprint_folder

    def sink(batch: DataFrame, _: int) -> None:
        paths = [escaped(r.path) for r in batch.select("path").collect()]  # at most batch_files names
        if paths:
            store.save(fingerprint_folder(spark, paths, config))

    files = new_files(spark, root, config, batch_files)
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def duplicate_counts(files: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Stream of (window, sha256, n): contents seen more than once within a time window, late files included up to ``late``."""
    w = files.withWatermark("modified_at", late).groupBy(F.window("modified_at", window), "sha256").agg(F.count("*").alias("n"))
    return w.where("n > 1")
