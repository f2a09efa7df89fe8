"""Problems 4 and 7 on ``duplicate_groups``: survivors per group, and group keys over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.components import connected_components
from lumenfold.operators.geo import has_position
from lumenfold.runtime import clean_id, hot_join

#: Camera texts that stand for "unknown".
NO_CAMERA = ("Unknown JPEG Camera", "Unknown PNG Source")


def group_members(groups: DataFrame) -> DataFrame:
    """One row per (group_id, member): main image and list entries, trimmed, lower case.

    Null and blank ids and null group ids are left out; null or empty lists give the main image only.
    """
    ids = F.concat(F.array("main_image"), F.coalesce("duplicate_ids", F.array().cast("array<string>")))
    return (
        groups.where("group_id is not null")
        .select("group_id", F.explode(ids).alias("raw"))
        .select("group_id", clean_id("raw").alias("member"))
        .where("member is not null")
        .distinct()
    )


def group_links(groups: DataFrame) -> DataFrame:
    """Edges (src, dst) from every id of a row to the row's smallest id; one-id rows give none."""
    ids = F.concat(F.array("main_image"), F.coalesce("duplicate_ids", F.array().cast("array<string>")))
    cleaned = F.filter(F.transform(ids, clean_id), lambda x: x.isNotNull())
    rows = groups.select(cleaned.alias("ids")).where(F.size("ids") > 1)
    return rows.select(F.array_min("ids").alias("dst"), F.explode("ids").alias("src")).where("src <> dst").distinct()


def consolidate(groups: DataFrame) -> DataFrame:
    """``image_id``, ``group_key``: the smallest id linked directly or through others."""
    cc = connected_components(group_links(groups))
    return cc.select(F.col("node").alias("image_id"), F.col("component").alias("group_key"))


def counting_score(quality: str = "quality") -> Column:
    """final_score where it counts: 0..100 and not the 50 of a failed rating; else null."""
    q = lambda f: F.col(f"{quality}.{f}")
    s = q("final_score")
    others = ["sharpness", "noise", "exposure", "contrast", "compression", "color_cast"]
    failed = s == 50
    for f in others:
        failed = failed & F.coalesce(q(f) == 0, F.lit(False))
    return F.when(s.isNotNull() & ~F.isnan(s) & s.between(0, 100) & ~failed, s)


def image_facts(fingerprints: DataFrame) -> DataFrame:
    """One row per id with the ranking columns and what fields the image can supply."""
    m = lambda f: F.col(f"metadata.{f}")
    cam = m("exif.camera_model")
    area = m("width").cast("long") * m("height").cast("long")
    facts = fingerprints.select(
        clean_id("id").alias("member"),
        counting_score().alias("score"),
        F.when(area > 0, area).alias("area"),
        m("size_bytes").alias("size_bytes"),
        m("modified_at").alias("modified_at"),
        F.coalesce(cam.isNotNull() & (cam != "") & ~cam.isin(*NO_CAMERA), F.lit(False)).alias("has_camera"),
        m("exif.taken_at").isNotNull().alias("has_taken"),
        has_position(m("exif.gps_lat"), m("exif.gps_lon"), m("exif.has_gps")).alias("has_gps"),
        "created_at",
    ).where("member is not null")
    first = F.min(F.struct(F.col("created_at"), *[F.col(c) for c in ("score", "area", "size_bytes", "modified_at", "has_camera", "has_taken", "has_gps")])).alias("x")
    return facts.groupBy("member").agg(first).select("member", "x.*").drop("created_at")


def survivors(groups: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``group_id``, ``field_name``, ``image_id``: the member that supplies each field.

    Members are the distinct ids found among the fingerprints; groups of fewer than two give no
    row.  One window orders each (group, field) and keeps its first row, so that Spark cuts
    every map partition down to one row a group before the shuffle, however large a group is.
    An id written twice counts once, by its first ``created_at``.
    """
    found = hot_join(group_members(groups), image_facts(fingerprints), "member")
    fields = F.array_compact(
        F.array(
            F.lit("main_image"),
            F.when(F.col("has_camera"), F.lit("camera_model")),
            F.when(F.col("has_taken"), F.lit("taken_at")),
            F.when(F.col("has_gps"), F.lit("gps")),
        )
    )
    big = found.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    order = [
        F.col("score").desc_nulls_last(),
        F.col("area").desc_nulls_last(),
        F.col("size_bytes").desc_nulls_last(),
        F.col("modified_at").desc_nulls_last(),
        F.col("member").asc(),
    ]
    w = Window.partitionBy("group_id", "field_name").orderBy(*order)
    best = (
        found.select("*", F.explode(fields).alias("field_name"))
        .withColumn("rn", F.row_number().over(w))
        .where("rn = 1")
        .select("group_id", "field_name", F.col("member").alias("image_id"))
    )
    return best.join(big, "group_id", "left_semi")


def surviving_records(groups: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One built record a group: ``group_id``, ``main_image``, ``path``, ``size_bytes``, ``width``, ``height``, ``camera_model``, ``taken_us`` (microseconds since 1970 UTC), ``gps_lat``, ``gps_lon``.

    File facts come from the main image, each other field from the member named by ``survivors``;
    a field that no member has is null.
    """
    picks = survivors(groups, fingerprints)
    m = lambda f: F.col(f"metadata.{f}")
    facts = fingerprints.select(
        clean_id("id").alias("image_id"), F.struct(m("path").alias("path"), m("size_bytes").alias("size_bytes"), m("width").alias("width"), m("height").alias("height"), m("exif.camera_model").alias("camera_model"), F.unix_micros(m("exif.taken_at")).alias("taken_us"), m("exif.gps_lat").alias("gps_lat"), m("exif.gps_lon").alias("gps_lon")).alias("x")
    )
    facts = facts.where("image_id is not null").groupBy("image_id").agg(F.first("x").alias("x"))
    rows = hot_join(picks, facts, "image_id")
    of = lambda field, col: F.max(F.when(F.col("field_name") == field, F.col(col)))
    return rows.groupBy("group_id").agg(
        of("main_image", "image_id").alias("main_image"),
        *[of("main_image", f"x.{c}").alias(c) for c in ("path", "size_bytes", "width", "height")],
        of("camera_model", "x.camera_model").alias("camera_model"),
        of("taken_at", "x.taken_us").alias("taken_us"),
        of("gps", "x.gps_lat").alias("gps_lat"),
        of("gps", "x.gps_lon").alias("gps_lon"),
    )
