"""Command line: scan, find-duplicates, clean, cluster, quality, stats, export."""

from __future__ import annotations

import argparse
import json
import signal
import sys

from pyspark.sql import SparkSession

from lumenfold import config as C
from lumenfold.api import Engine, advice
from lumenfold.functions.scalars import TIERS
from lumenfold.operators import clustering, reports
from lumenfold.operators import duplicates as D
from lumenfold.operators.cleanup import CleanOptions
from lumenfold.schema import Policy

PRESETS = {"default": C.EngineConfig.default, "high-performance": C.EngineConfig.high_performance, "accuracy": C.EngineConfig.accuracy, "fast": C.EngineConfig.fast}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    p.add_argument("--index", help="folder of the fingerprint store")
    p.add_argument("--config", help="options in YAML")
    p.add_argument("--preset", choices=PRESETS, default="default")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="fingerprint the images below folders")
    s.add_argument("folders", nargs="+")
    s = sub.add_parser("find-duplicates", help="list duplicate groups")
    s.add_argument("--threshold", type=float, default=0.9)
    s.add_argument("--exact-only", action="store_true")
    s = sub.add_parser("clean", help="move or delete duplicates")
    s.add_argument("--threshold", type=float, default=0.9)
    s.add_argument("--output", default="duplicates")
    s.add_argument("--apply", action="store_true", help="change files; without it only the plan is reckoned")
    s.add_argument("--delete", action="store_true")
    s.add_argument("--min-quality", type=float, default=50.0)
    s.add_argument("--policy", choices=[x.name.lower() for x in Policy], default="highest_quality")
    s = sub.add_parser("cluster", help="group similar images")
    s.add_argument("--threshold", type=float, default=0.9)
    s = sub.add_parser("quality", help="rate an image of the store")
    s.add_argument("image_id")
    sub.add_parser("stats", help="totals of the store")
    s = sub.add_parser("export", help="write a report")
    s.add_argument("output")
    s.add_argument("--format", choices=reports.FORMATS, default="json")
    s.add_argument("--threshold", type=float, default=0.9)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = C.load(a.config) if a.config else PRESETS[a.preset]()
    if a.index:
        cfg.index_path = a.index
    own = spark is None
    spark = spark or SparkSession.builder.appName("lumenfold").getOrCreate()
    if own:
        signal.signal(signal.SIGINT, lambda *_: (spark.sparkContext.cancelAllJobs(), sys.exit(130)))
    engine = Engine(spark, cfg)
    try:
        if a.command == "scan":
            print(json.dumps(engine.scan(*a.folders)))
        elif a.command == "find-duplicates":
            if a.exact_only:
                exact = engine.exact_duplicates()
                members = D.exact_members(engine.store.all()).select("sha", "id").join(exact.select("sha", "group_id"), "sha")
                report = reports.build(engine.store.all(), exact, exact.limit(0), members.select("group_id", "id"))
            else:
                report = engine.report(a.threshold)
            print(reports.to_console(report), end="")
        elif a.command == "clean":
            o = CleanOptions(a.threshold, Policy[a.policy.upper()], a.min_quality, not a.delete, a.output, not a.apply)
            print(json.dumps(engine.clean(o).first().asDict()))
        elif a.command == "cluster":
            groups = D.near_groups(engine.store.all(), a.threshold, cfg.weights)
            for r in clustering.cluster_heads(groups, "leader").orderBy("leader").limit(50).collect():
                print(r.leader, *r.members)
        elif a.command == "quality":
            q = engine.rate(a.image_id)
            tier = next((n for lo, n in TIERS if q["final_score"] >= lo), "very_poor")
            print(json.dumps(q | {"tier": tier, "advice": advice(q)}))
        elif a.command == "stats":
            print(json.dumps(engine.stats().first().asDict()))
        else:
            print(engine.export(a.output, a.format, a.threshold))
    finally:
        engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
