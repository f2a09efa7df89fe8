"""The engine as one object, and one-call helpers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.config import EngineConfig
from lumenfold.operators import cleanup, reports
from lumenfold.operators import duplicates as D
from lumenfold.runtime import hot_join, stage
from lumenfold.schema import NotFound, Policy
from lumenfold.sources.files import fingerprint_folder, scan_folder
from lumenfold.sources.store import FingerprintStore


class Engine:
    """Scans folders into a store and answers duplicate, quality and report questions over it."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = FingerprintStore(spark, self.config.index_path)

    def scan(self, *roots: str) -> dict:
        began = datetime.now(timezone.utc)
        files = 0
        for root in roots:
            files += scan_folder(self.spark, root, self.config.file_filter(), content=False).count()
            self.store.save(fingerprint_folder(self.spark, root, self.config))
        return {"total_files": files, "processed_images": self.store.all().count(), "duration_ns": int((datetime.now(timezone.utc) - began).total_seconds() * 1e9)}

    def exact_duplicates(self, policy: Policy = Policy.HIGHEST_QUALITY) -> DataFrame:
        return D.exact_groups(self.store.all(), policy)

    def near_duplicates(self, threshold: float = 0.9, policy: Policy = Policy.HIGHEST_QUALITY) -> DataFrame:
        return D.near_group_records(self.store.all(), threshold, policy, self.config.weights)

    def rate(self, image_id: str) -> dict:
        return self.store.get(image_id).quality.asDict()

    def clean(self, options: cleanup.CleanOptions) -> DataFrame:
        """Plan and apply; moved and deleted files leave the store or get their new paths."""
        plan = cleanup.clean_plan(self.store.all(), options).cache()
        result = cleanup.apply_plan(plan, options.dry_run).cache()
        report = self.spark.createDataFrame(cleanup.clean_report(plan, result).collect())  # one row
        if not options.dry_run:
            done = result.where("done").select("id", "dst")
            moved = self.store.all().join(done.where("dst is not null"), "id").withColumn("metadata", F.col("metadata").withField("path", F.col("dst"))).drop("dst")
            gone = done.where("dst is null")
            if gone.limit(1).count():
                self.store.delete(gone)
            if moved.limit(1).count():
                self.store.save(moved.select(*self.store.all().columns))
        plan.unpersist()
        result.unpersist()
        return report

    def stats(self) -> DataFrame:
        return self.store.stats(self.exact_duplicates().count())

    def _groups(self, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Exact groups, near groups, and the members of both (group_id, main_image, reason, confidence, n_members, id), each evaluated once."""
        fp = self.store.all()
        groups, _ = stage(D.near_groups(fp, threshold, self.config.weights), "near")
        near, _ = stage(D.near_group_records(fp, threshold, weights=self.config.weights, groups=groups), "near")
        exact, _ = stage(self.exact_duplicates(), "exact")
        cols = ["group_id", "main_image", "reason", "confidence", "n_members", "id"]
        same = hot_join(D.exact_members(fp).select("sha", "id"), exact, "sha").select(cols)
        alike = hot_join(groups.select("leader", "id"), near, "leader").select(cols)
        return exact, near, same.unionByName(alike)

    def report(self, threshold: float = 0.9, scan_id: str = "scan", shown: int = 50) -> dict:
        exact, near, members = self._groups(threshold)
        return reports.build(self.store.all(), exact, near, members.select("group_id", "id"), scan_id=scan_id, shown=shown)

    def export(self, path: str, kind: str = "json", threshold: float = 0.9, scan_id: str = "scan") -> str:
        """Write a report; the JSON form holds all groups with all their ids, the others list the first groups."""
        if kind != "json":
            return reports.write(self.report(threshold, scan_id), path, kind)
        exact, near, members = self._groups(threshold)
        return reports.write_json(reports.build(self.store.all(), exact, near, scan_id=scan_id), members, path)

    def close(self) -> None:
        self.store.close()


def quick_scan(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of a folder with the default options."""
    return fingerprint_folder(spark, root, EngineConfig())


def find_duplicates_quick(spark: SparkSession, root: str, threshold: float = 0.9) -> DataFrame:
    """Exact groups and then near groups of a folder, with the fast preset."""
    fp = fingerprint_folder(spark, root, EngineConfig.fast())
    cols = ["group_id", "main_image", "n_members", "reason", "confidence"]
    return D.exact_groups(fp).select(cols).unionByName(D.near_group_records(fp, threshold).select(cols))


def analyze_image_quality(spark: SparkSession, path: str) -> dict:
    """The measures of one image file."""
    row = fingerprint_folder(spark, path, EngineConfig(hashes={})).select("quality").first()
    if row is None:
        raise NotFound(path)
    return row.quality.asDict()


def advice(quality: dict) -> list[str]:
    """Remarks on weak measures."""
    out = []
    if quality["sharpness"] < 0.3:
        out.append("The image is blurry.")
    if quality["noise"] > 0.7:
        out.append("The image is noisy.")
    if abs(quality["exposure"] - 0.5) > 0.3:
        out.append("The exposure is off.")
    return out
