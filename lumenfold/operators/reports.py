"""Reports: aggregates as DataFrames, and their JSON, text and HTML forms (rendered from bounded rows)."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S

VERSION = "1.0"


def distribution(fingerprints: DataFrame) -> DataFrame:
    """``dimension``, ``bucket``, ``n``: images by quality tier, by format and by size class, in one pass."""
    score = F.nanvl("quality.final_score", F.lit(None).cast("double"))
    mb = F.col("metadata.size_bytes") / float(1 << 20)
    size = F.when(mb < 1, "under_1MB").when(mb < 5, "1_to_5MB").when(mb < 20, "5_to_20MB").when(mb.isNotNull(), "over_20MB").otherwise("unknown")
    tier = F.when(score.isNull(), "unknown").otherwise(S.quality_tier(score))
    fmt = F.coalesce(F.lower("metadata.format"), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("bucket")) for d, c in (("quality", tier), ("format", fmt), ("size", size))])
    return fingerprints.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("n"))


def scan_report(fingerprints: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """One row of totals: images, bytes in MB, means, groups by reason, and files that clean-up could remove."""
    score = F.nanvl("quality.final_score", F.lit(None).cast("double"))
    mb = F.col("metadata.size_bytes") / float(1 << 20)
    a = fingerprints.agg(
        F.count("*").alias("processed_images"), F.round(F.coalesce(F.sum(mb), F.lit(0.0)), 6).alias("total_size_mb"),
        F.round(F.coalesce(F.avg(mb), F.lit(0.0)), 6).alias("average_file_size_mb"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("average_quality"),
    )
    e = exact.agg(F.count("*").alias("exact_duplicate_count"), F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("exact_removable"))
    n = near.agg(F.count("*").alias("near_duplicate_count"), F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("near_removable"))
    return a.join(e, how="cross").join(n, how="cross")  # one row each


def recommendations(report: DataFrame) -> DataFrame:
    """``type``, ``priority``, ``description``, ``action``, ``impact``, ``confidence``: those whose condition holds."""
    c = F.col

    def one(cond, kind, priority, text, action, impact, sure):
        fields = {"type": kind, "priority": priority, "action": action, "impact": impact}
        s = F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], text.alias("description"), F.lit(sure).alias("confidence"))
        return F.when(cond, s)

    # fixed values: kinds, priorities and texts of the recommendations
    found = F.array_compact(
        F.array(
            one(c("exact_duplicate_count") > 0, "storage_optimization", "high", F.concat(F.lit("Found "), c("exact_duplicate_count").cast("string"), F.lit(" exact duplicate groups")), "Run clean command to remove exact duplicates", "storage", 1.0),
            one(c("near_duplicate_count") > 0, "organization", "medium", F.concat(F.lit("Found "), c("near_duplicate_count").cast("string"), F.lit(" near-duplicate groups")), "Review near-duplicates and keep best quality versions", "organization", 0.8),
            one(c("processed_images") > 100, "quality_audit", "low", F.lit("Large image collection detected"), "Consider running quality analysis on all images", "quality", 0.6),
        )
    )
    return report.select(F.explode(found).alias("r")).select("r.type", "r.priority", "r.description", "r.action", "r.impact", "r.confidence")


def heads(members: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """``key``, ``shown`` (first ids), ``more`` (how many are not shown)."""
    w = Window.partitionBy(key).orderBy("id")
    top = members.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= shown).groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("shown"))
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    return top.join(n, key).select(key, "shown", (F.col("n") - F.size("shown")).alias("more"))


def build(fingerprints: DataFrame, exact: DataFrame, near: DataFrame, members: DataFrame | None = None, scan_id: str = "scan", started: datetime | None = None, total_files: int | None = None, shown: int = 50) -> dict:
    """The report record with real figures; at most ``shown`` groups of each kind are listed (a report is read by people).

    ``members``: group_id, id; gives each listed group its first ids.
    """
    now = datetime.now(timezone.utc)
    started = started or now
    totals_df = scan_report(fingerprints, exact, near)
    totals = totals_df.first().asDict()
    dist: dict[str, dict] = {"quality": {}, "format": {}, "size": {}}
    for r in distribution(fingerprints).collect():  # tiers, formats, size classes
        dist[r.dimension][r.bucket] = r.n
    groups = []
    for df in (exact, near):
        number = F.length("group_id"), F.col("group_id")  # exact_2 before exact_10
        listed = df.orderBy(*number).limit(shown)
        if members is not None:
            listed = listed.join(heads(members.join(listed.select("group_id"), "group_id", "left_semi"), "group_id", 4), "group_id", "left")
        for r in listed.orderBy(*number).collect():
            d = r.asDict()
            groups.append({k: d.get(k) for k in ("group_id", "main_image", "n_members", "reason", "confidence", "shown", "more") if d.get(k) is not None})
    files = totals["processed_images"] if total_files is None else total_files
    return {
        "version": VERSION, "scan_id": scan_id, "total_files": files, "processed_images": totals["processed_images"], "skipped_files": files - totals["processed_images"],
        "exact_duplicate_count": totals["exact_duplicate_count"], "near_duplicate_count": totals["near_duplicate_count"],
        "duplicate_groups": groups, "scan_duration": int((now - started).total_seconds() * 1e9), "started_at": started.isoformat(), "completed_at": now.isoformat(), "generated_at": now.isoformat(),
        "statistics": {k: totals[k] for k in ("total_size_mb", "average_file_size_mb", "average_quality")} | {f"{k}_distribution": v for k, v in dist.items()},
        "recommendations": [r.asDict() for r in recommendations(totals_df).collect()],  # three at most
        "potential_savings_mb": 5 * (totals["exact_removable"] + totals["near_removable"]),
    }


def summary(report: dict) -> dict:
    keys = {"scan_id": "scan_id", "total_files": "total_files", "processed_images": "processed_images", "exact_duplicates": "exact_duplicate_count", "near_duplicates": "near_duplicate_count", "started_at": "started_at", "completed_at": "completed_at"}
    return {k: report[v] for k, v in keys.items()} | {"scan_duration": f"{report['scan_duration'] / 1e9:.3f}s"}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def write_json(report: dict, members: DataFrame, path: str) -> str:
    """Write the JSON form with all groups and all their duplicate ids.

    ``members``: group_id, main_image, reason, confidence, n_members, id, one row a member.  They are sorted by Spark and
    written as they come, a partition at a time, so neither a group nor the list of groups is held as a whole.
    """
    p = Path(path if Path(path).suffix else path + ".json")
    p.parent.mkdir(parents=True, exist_ok=True)
    rest = to_json({k: v for k, v in report.items() if k != "duplicate_groups"})
    rows = members.select("group_id", "main_image", "reason", "confidence", "n_members", "id").orderBy("reason", F.length("group_id"), "group_id", "id")
    with p.open("w") as out:
        out.write(rest[: rest.rindex("}")].rstrip() + ',\n  "duplicate_groups": [')
        at, first = None, True
        for r in rows.toLocalIterator():
            if r.group_id != at:
                out.write(("" if at is None else "]},") + "\n    ")
                head = json.dumps({k: r[k] for k in ("group_id", "main_image", "reason", "confidence", "n_members")}, default=str)
                out.write(head[:-1] + ', "duplicate_ids": [')
                at, first = r.group_id, True
            if r.id != r.main_image:
                out.write(("" if first else ", ") + json.dumps(r.id))
                first = False
        out.write(("" if at is None else "]}\n  ") + "]\n}\n")
    return str(p)


def _group_line(g: dict) -> list[str]:
    out = [f"  {g['group_id']} ({g['n_members']} images, confidence {100 * g['confidence']:.1f}%)", f"    keep: {g['main_image']}"]
    out += [f"    - {x}" for x in g.get("shown", [])]
    if g.get("more"):
        out.append(f"    … and {g['more']} more")
    return out


def to_text(report: dict) -> str:
    s = report["statistics"]
    out = ["DUPLICATE IMAGE REPORT", "=" * 60, f"Scan {report['scan_id']}, generated {report['generated_at']}", "", "SUMMARY", "-" * 60]
    out += [f"Files: {report['total_files']}  Images: {report['processed_images']}  Skipped: {report['skipped_files']}", f"Size: {s['total_size_mb']:.1f} MB  Mean quality: {s['average_quality']:.1f}", ""]
    for reason in ("exact", "near"):
        listed = [g for g in report["duplicate_groups"] if g["reason"] == reason]
        out += [f"{reason.upper()} DUPLICATES: {report[f'{reason}_duplicate_count']} groups", "-" * 60]
        for g in listed:
            out += _group_line(g)
        if report[f"{reason}_duplicate_count"] > len(listed):
            out.append(f"  … and {report[f'{reason}_duplicate_count'] - len(listed)} more groups")
        out.append("")
    out += ["RECOMMENDATIONS", "-" * 60] + [f"[{r['priority']}] {r['description']}: {r['action']}" for r in report["recommendations"]]
    return "\n".join(out) + "\n"


def to_brief(report: dict) -> str:
    return "\n".join([f"Scan: {report['scan_id']}", f"Images: {report['processed_images']}", f"Exact duplicate groups: {report['exact_duplicate_count']}", f"Near duplicate groups: {report['near_duplicate_count']}", f"Possible savings: {report['potential_savings_mb']} MB"]) + "\n"


def to_html(report: dict) -> str:
    e = lambda x: html.escape(str(x))
    card = lambda k, v: f'<div class="card"><b>{e(v)}</b><span>{e(k)}</span></div>'
    cards = "".join(card(k, v) for k, v in (("images", report["processed_images"]), ("exact groups", report["exact_duplicate_count"]), ("near groups", report["near_duplicate_count"]), ("possible savings, MB", report["potential_savings_mb"])))
    groups = "".join(f"<li class={e(g['reason'])!r}><b>{e(g['group_id'])}</b> {e(g['n_members'])} images, {100 * g['confidence']:.1f}%<br>keep {e(g['main_image'])}</li>" for g in report["duplicate_groups"])
    tips = "".join(f"<li>[{e(r['priority'])}] {e(r['description'])}: {e(r['action'])}</li>" for r in report["recommendations"])
    style = "body{font-family:sans-serif;margin:2em}.card{display:inline-block;padding:1em;margin:.5em;background:#eee}.card b{display:block;font-size:2em}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Duplicate image report</title><style>{style}</style></head><body><h1>Duplicate image report</h1>{cards}<h2>Groups</h2><ul>{groups}</ul><h2>Recommendations</h2><ul>{tips}</ul></body></html>\n"


def to_console(report: dict) -> str:
    """The listing of a terminal: three members of an exact group, two of a near one, and what could be saved."""
    out = []
    for reason, shown in (("exact", 3), ("near", 2)):
        out.append(f"{reason} duplicates: {report[f'{reason}_duplicate_count']} groups")
        for g in (g for g in report["duplicate_groups"] if g["reason"] == reason):
            ids = [x for x in g.get("shown", []) if x != g["main_image"]][:shown]
            out.append(f"  {g['group_id']}: keep {g['main_image']}, {g['n_members']} images, {100 * g['confidence']:.1f}%")
            out += [f"    {x}" for x in ids]
            if g["n_members"] - 1 > len(ids):
                out.append(f"    … and {g['n_members'] - 1 - len(ids)} more")
    return "\n".join([*out, f"possible savings: {report['potential_savings_mb']} MB"]) + "\n"


FORMATS = {"console": (to_console, ".txt"), "json": (to_json, ".json"), "text": (to_text, ".txt"), "html": (to_html, ".html"), "brief": (to_brief, ".txt")}


def write(report: dict, path: str, kind: str) -> str:
    """Write one form; the extension is added where it is missing."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    render, ext = FORMATS[kind]
    p = Path(path if Path(path).suffix else path + ext)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(render(report))
    return str(p)
