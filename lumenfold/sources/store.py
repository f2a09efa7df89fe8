"""The fingerprint store: a parquet table with one row an id."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.runtime import drop_path
from lumenfold.schema import FINGERPRINT, NotFound


@dataclass
class QueryOptions:
    """Selection, order and page of a listing; None means no bound."""

    limit: int | None = None
    offset: int = 0
    min_quality: float | None = None
    max_quality: float | None = None
    min_width: int | None = None
    min_height: int | None = None
    formats: Sequence[str] = ()
    sort_by: str = "id"
    descending: bool = False


SORT_COLUMNS = {"id": "id", "path": "metadata.path", "size": "metadata.size_bytes", "quality": "quality.final_score", "created_at": "created_at", "width": "metadata.width", "height": "metadata.height"}


def select(fingerprints: DataFrame, o: QueryOptions) -> DataFrame:
    """Rows that meet the bounds, ordered by the sort column and then by id, one page of them.

    A bounded page is taken by top-k in every partition; null sort values come last.
    """
    df = fingerprints
    for cond in (
        F.col("quality.final_score") >= o.min_quality if o.min_quality is not None else None,
        F.col("quality.final_score") <= o.max_quality if o.max_quality is not None else None,
        F.col("metadata.width") >= o.min_width if o.min_width is not None else None,
        F.col("metadata.height") >= o.min_height if o.min_height is not None else None,
        F.lower("metadata.format").isin(*[f.lower() for f in o.formats]) if o.formats else None,
    ):
        if cond is not None:
            df = df.where(cond)
    key = F.col(SORT_COLUMNS[o.sort_by])
    df = df.orderBy(key.desc_nulls_last() if o.descending else key.asc_nulls_last(), "id")
    if o.offset:
        df = df.offset(o.offset)
    return df.limit(o.limit) if o.limit is not None else df


def latest(fingerprints: DataFrame, newest: bool = True) -> DataFrame:
    """One row an id: the last (or first) written. Other columns may be null; null ids are left out."""
    at = F.col("created_at").desc_nulls_last() if newest else F.col("created_at").asc_nulls_last()
    ties = [F.xxhash64(*[c for c in fingerprints.columns if c in ("metadata", "perceptual_hashes", "quality")])]  # rows of equal time: the same one always
    w = Window.partitionBy("id").orderBy(at, *ties)
    return fingerprints.where("id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def find_by_sha256(fingerprints: DataFrame, sha: str) -> DataFrame:
    return fingerprints.where(F.col("metadata.sha256") == sha)


def find_similar_hashes(fingerprints: DataFrame, target: int, most: int, kind: str) -> DataFrame:
    """Rows whose hash of this kind is set and differs from ``target`` in at most ``most`` bits; adds ``distance``."""
    if kind not in S.HASH_NAMES:
        raise ValueError(f"no such hash: {kind}")
    h = F.col(f"perceptual_hashes.{kind}")
    df = fingerprints.withColumn("distance", S.hamming(h, F.lit(target).cast("long")))
    return df.where((h != 0) & (F.col("distance") <= most))


def stats(fingerprints: DataFrame, groups: Column | int = 0, index_bytes: int = 0) -> DataFrame:
    """One row: images, their bytes, the index's bytes, mean quality, duplicate groups; zeros when empty."""
    return fingerprints.agg(
        F.count("*").alias("total_images"),
        F.coalesce(F.sum("metadata.size_bytes"), F.lit(0)).cast("long").alias("total_size_bytes"),
        F.lit(index_bytes).cast("long").alias("index_size_bytes"),
        F.coalesce(F.avg(F.nanvl("quality.final_score", F.lit(None).cast("double"))), F.lit(0.0)).alias("average_quality"),
        F.lit(groups).cast("long").alias("duplicate_groups"),
    )


class FingerprintStore:
    """Upserts, lookups and deletes below ``path``, as a base and the changes since.

    A change writes only its own rows (or the ids it deletes) as a segment and then moves the pointer, so readers and failed jobs
    never see half a table.  Segments are sorted by id over ranges, so a lookup opens the row groups that can hold the id.
    More than ``max_segments`` segments are merged.  Folders that a merge replaced stay until the next one, so plans over them still run.
    """

    def __init__(self, spark: SparkSession, path: str, max_segments: int = 16):
        self.spark, self.path, self.max_segments = spark, path.rstrip("/"), max_segments

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        """``segments`` (name, whether its ids are deleted), oldest first, and the folders that the last merge ``replaced``."""
        p, fs = self._fs("CURRENT")
        if not fs.exists(p):
            return {"segments": [], "replaced": []}
        stream = fs.open(p)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        p, fs = self._fs("CURRENT")
        stream = fs.create(p, True)
        stream.writeUTF(json.dumps(state))
        stream.close()

    def _write(self, rows: DataFrame, files: int | None = None) -> str:
        name = f"v-{uuid.uuid4().hex[:12]}"
        ranged = rows.repartitionByRange(files, "id") if files else rows.repartitionByRange("id")
        ranged.sortWithinPartitions("id").write.parquet(f"{self.path}/{name}")
        return name

    def _add(self, rows: DataFrame, deletes: bool) -> None:
        state = self._state()
        state["segments"].append([self._write(rows), deletes])
        self._point(state)
        if len(state["segments"]) > self.max_segments:
            self.compact()

    def _read(self, image_id: str | None = None) -> DataFrame:
        segments = self._state()["segments"]
        if not segments:
            return self.spark.createDataFrame([], FINGERPRINT)
        out = None
        for no, (name, deletes) in enumerate(segments):
            df = self.spark.read.schema("id string" if deletes else FINGERPRINT).parquet(f"{self.path}/{name}")
            if image_id is not None:
                df = df.where(F.col("id") == image_id)
            if len(segments) == 1:
                return df
            df = df.withColumns({"_no": F.lit(no), "_gone": F.lit(deletes)})
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        w = Window.partitionBy("id").orderBy(F.col("_no").desc())
        return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and not _gone").select(*FINGERPRINT.names)

    def all(self) -> DataFrame:
        return self._read()

    def save(self, fingerprints: DataFrame) -> None:
        """Insert or replace by id; of rows with one id the last written counts."""
        self._add(latest(fingerprints).to(FINGERPRINT), False)

    def get(self, image_id: str):
        row = self._read(image_id).first()
        if row is None:
            raise NotFound(image_id)
        return row

    def find_by_sha256(self, sha: str) -> DataFrame:
        return find_by_sha256(self.all(), sha)

    def delete(self, ids: Sequence[str] | DataFrame) -> None:
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        if not isinstance(ids, DataFrame) and len(ids) == 1:
            self.get(ids[0])
        self._add(gone.select("id").where("id is not null").distinct(), True)

    def query(self, options: QueryOptions) -> DataFrame:
        return select(self.all(), options)

    def stats(self, groups: int = 0) -> DataFrame:
        size = 0
        for name, _ in self._state()["segments"]:
            p, fs = self._fs(name)
            size += fs.getContentSummary(p).getLength()
        return stats(self.all(), groups, size)

    def compact(self, files: int | None = None) -> None:
        """Merge all segments into one, of ``files`` files or as many as the session's shuffles have partitions."""
        state = self._state()
        if not state["segments"]:
            return
        name = self._write(self.all(), files)
        self._point({"segments": [[name, False]], "replaced": [n for n, _ in state["segments"]]})
        for old in state["replaced"]:
            drop_path(self.spark, f"{self.path}/{old}")

    def close(self) -> None:
        self.spark.catalog.clearCache()
