"""Clean-up as a plan: which file goes where and why. Nothing is touched until a plan is applied."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import duplicates as D
from lumenfold.runtime import hot_join, stage
from lumenfold.schema import Policy


@dataclass
class CleanOptions:
    threshold: float = 0.9
    policy: Policy = Policy.HIGHEST_QUALITY
    min_quality: float = 0.0
    move: bool = True
    output: str = "duplicates"
    dry_run: bool = True


def members_to_clean(fingerprints: DataFrame, o: CleanOptions) -> DataFrame:
    """``id``, ``group_id``, ``reason``: all group members but the one kept. An id in an exact group is left to it."""
    exact = D.exact_groups(fingerprints, o.policy)
    e = hot_join(D.exact_members(fingerprints).select("id", "sha"), exact.select("sha", "group_id", "main_image"), "sha").where("id <> main_image")
    e = e.select("id", "group_id", F.lit("exact").alias("reason"))
    # near groups are formed over what the exact ones leave
    e, _ = stage(e, "exact")
    rest = fingerprints.join(e.select("id"), "id", "left_anti").select(*fingerprints.columns)
    groups, _ = stage(D.near_groups(rest, o.threshold), "near")
    near = D.near_group_records(rest, o.threshold, o.policy, groups=groups)
    n = hot_join(groups, near.select("leader", "group_id", "main_image"), "leader").where("id <> main_image")
    return e.unionByName(n.select("id", "group_id", F.lit("near").alias("reason")))


def clean_plan(fingerprints: DataFrame, o: CleanOptions) -> DataFrame:
    """``id``, ``src``, ``dst``, ``group_id``, ``reason``, ``size_bytes``, ``action``.

    Near members with a score below ``min_quality`` (or none) stay; exact ones have no such gate.  Destinations of equal name are
    numbered name_1, name_2 ... in the order of their ids; deletions have no destination.
    """
    facts = fingerprints.select("id", F.col("metadata.path").alias("src"), F.coalesce("metadata.size_bytes", F.lit(0)).alias("size_bytes"), F.nanvl("quality.final_score", F.lit(None).cast("double")).alias("score"))
    rows = members_to_clean(fingerprints, o).join(facts, "id")
    rows = rows.where((F.col("reason") == "exact") | (F.coalesce("score", F.lit(-1.0)) >= o.min_quality))
    return with_destinations(rows, o).drop("score")


def with_destinations(rows: DataFrame, o: CleanOptions) -> DataFrame:
    if not o.move:
        return rows.withColumn("dst", F.lit(None).cast("string")).withColumn("action", F.lit("delete"))
    name = S.base_name(F.col("src"))
    rows = rows.withColumn("_to", F.concat_ws("/", F.lit(o.output.rstrip("/")), "group_id", name))
    w = Window.partitionBy("_to").orderBy("id")
    n = F.row_number().over(w) - 1
    stem, ext = F.regexp_replace("_to", r"(\.[^./]*)$", ""), F.regexp_extract("_to", r"(\.[^./]*)$", 1)
    dst = F.when(n == 0, F.col("_to")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))
    return rows.withColumn("dst", dst).withColumn("action", F.lit("move")).drop("_to")


def freed_space(plan: DataFrame, per_file: int = 5 * 1024 * 1024) -> DataFrame:
    """One row: files, their bytes as text too, and the flat estimate of ``per_file`` bytes each."""
    s = plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("freed_bytes"))
    return s.select("files", "freed_bytes", S.human_bytes(F.col("freed_bytes")).alias("freed_text"), (F.col("files") * per_file).alias("estimate_bytes"))


def apply_plan(plan: DataFrame, dry_run: bool = True, backup: str | None = None) -> DataFrame:
    """``id``, ``done``, ``dst``, ``error`` of each planned row; a dry run changes nothing, no folder either.

    Files are reached through the workers' file system (shared storage on a cluster).  A move that an
    earlier attempt of the same task finished counts as done.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, src, dst, action in b[["id", "src", "dst", "action"]].itertuples(index=False):
                try:
                    if dry_run:
                        rows.append((id_, False, dst, None))
                    elif action == "move":
                        rows.append((id_, True, safe_move(src, dst) if os.path.exists(src) or not os.path.exists(dst) else dst, None))
                    else:
                        safe_delete(src, backup)
                        rows.append((id_, True, None, None))
                except OSError as e:
                    rows.append((id_, False, dst, str(e)))
            yield pd.DataFrame(rows, columns=["id", "done", "dst", "error"])

    return plan.mapInPandas(run, "id string, done boolean, dst string, error string")


def clean_report(plan: DataFrame, result: DataFrame) -> DataFrame:
    """One row: groups, moved files, freed bytes, errors."""
    r = plan.select("id", "group_id", "size_bytes").join(result.select("id", "done", "error"), "id", "left")
    done = F.coalesce("done", F.lit(False))
    return r.agg(
        F.count_distinct("group_id").alias("total_processed"), F.count_if(done).alias("moved_files"),
        F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).alias("freed_space_bytes"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


# --- single files (driver or worker side) --------------------------------------------------------------


def free_name(path: str, most: int = 999) -> str:
    """The path, or name_1 ... name_999 beside it, or one with the time, whichever is free."""
    p = Path(path)
    tries = [p, *(p.with_name(f"{p.stem}_{i}{p.suffix}") for i in range(1, most + 1))]
    return str(next((t for t in tries if not t.exists()), p.with_name(f"{p.stem}_{datetime.now():%Y%m%d%H%M%S%f}{p.suffix}")))


def stamped(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}_{datetime.now():%Y%m%d%H%M%S%f}{p.suffix}"))


def _source(path: str) -> None:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such file: {path}")


def safe_copy(src: str, dst: str, overwrite: bool = False) -> str:
    """Copy with a free name, or over an existing file after that was saved under a stamped name."""
    _source(src)
    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
    if os.path.exists(dst):
        if overwrite:
            shutil.copy2(dst, stamped(dst))
        else:
            dst = free_name(dst)
    shutil.copy2(src, dst)
    if os.path.getsize(src) != os.path.getsize(dst):
        raise OSError(f"incomplete copy: {dst}")
    return dst


def safe_move(src: str, dst: str, overwrite: bool = False) -> str:
    out = safe_copy(src, dst, overwrite)
    os.remove(src)
    return out


def safe_delete(path: str, backup: str | None = None) -> None:
    _source(path)
    if backup:
        safe_copy(path, os.path.join(backup, os.path.basename(path)))
    os.remove(path)


def remove_empty_dirs(root: str) -> int:
    """Removes folders without any file below them, deepest first; the root stays."""
    gone = 0
    for folder, _, _ in os.walk(root, topdown=False):
        if os.path.abspath(folder) != os.path.abspath(root) and not os.listdir(folder):
            os.rmdir(folder)
            gone += 1
    return gone


def folder_size(files: DataFrame) -> DataFrame:
    """One row: bytes of the listed files."""
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
