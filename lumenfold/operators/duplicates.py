"""Exact and near duplicates over fingerprint records: grouping, theta self-join, leader groups, best of group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import blocks as B
from lumenfold.functions import scalars as S
from lumenfold.runtime import drop_path, hot_join, shuffle_width, stage
from lumenfold.schema import Policy

_EPS = 1e-9

# --- exact ---------------------------------------------------------------------------------------


def policy_score(policy: Policy, prefix: str = "") -> Column:
    """Larger is better; unknown policies count as quality."""
    c = lambda n: F.col(prefix + n)
    nan = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    if policy == Policy.HIGHEST_RESOLUTION:
        return (c("metadata.width").cast("long") * c("metadata.height").cast("long")).cast("double")
    if policy == Policy.BEST_EXPOSURE:
        return 1 - F.abs(nan(c("quality.exposure")) - 0.5) * 2
    if policy == Policy.OLDEST:
        return -F.unix_timestamp(c("metadata.modified_at")).cast("double")
    if policy == Policy.NEWEST:
        return F.unix_timestamp(c("metadata.modified_at")).cast("double")
    return nan(c("quality.final_score"))


def best_of_group(members: DataFrame, group: str, policy: Policy = Policy.HIGHEST_QUALITY) -> DataFrame:
    """First row of each group by the policy's score (null last), ties by id.

    The row limit of the window is applied within every map partition first, so a large group is never
    gathered.
    """
    w = Window.partitionBy(group).orderBy(policy_score(policy).desc_nulls_last(), F.col("id"))
    return members.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exact_members(fingerprints: DataFrame, sha: str = "metadata.sha256") -> DataFrame:
    """Adds ``sha`` and ``n``: the rows (one an id) whose content hash occurs more than once; null hashes match nothing."""
    keyed = fingerprints.where(F.col(sha).isNotNull()).withColumn("sha", F.col(sha))
    many = keyed.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")
    return hot_join(keyed, many, "sha")


def exact_groups(fingerprints: DataFrame, policy: Policy = Policy.HIGHEST_QUALITY) -> DataFrame:
    """``group_id``, ``sha``, ``main_image``, ``n_members``, ``reason``, ``confidence``; numbered by smallest id."""
    members = exact_members(fingerprints)
    main = best_of_group(members, "sha", policy).select("sha", F.col("id").alias("main_image"))
    sizes = members.groupBy("sha").agg(F.count("*").alias("n_members"), F.min("id").alias("first"))
    rows = number_groups(sizes, "first", "exact")
    return rows.join(main, "sha").select("group_id", "sha", "main_image", "n_members", F.lit("exact").alias("reason"), F.lit(1.0).alias("confidence"))


def number_groups(groups: DataFrame, by: str, prefix: str, start: int = 1) -> DataFrame:
    """Adds ``group_id`` = prefix_1, prefix_2 ... in the order of ``by`` (distinct values).

    Ranges are sorted apart and their sizes summed on the driver (one number a partition), so
    no task holds all groups.
    """
    spark = groups.sparkSession
    ranged, _ = stage(groups.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()), "groups")
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    at, offsets = start, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    if not offsets:
        return groups.withColumn("group_id", F.lit(None).cast("string"))
    base = spark.createDataFrame(offsets, "_p int, _at long")
    w = Window.partitionBy("_p").orderBy(by)
    n = F.row_number().over(w) - 1 + F.col("_at")
    return ranged.join(F.broadcast(base), "_p").withColumn("group_id", F.concat(F.lit(f"{prefix}_"), n.cast("string"))).drop("_p", "_at")


def as_records(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Group records with the array of ids other than the main one (the shape of reports; arrays as long as a group)."""
    joined = members.select(F.col(key), "id").join(groups, key).where(F.col("id") != F.col("main_image"))
    return joined.groupBy("group_id", "main_image", "reason", "confidence").agg(F.array_sort(F.collect_list("id")).alias("duplicate_ids"))


# --- near ----------------------------------------------------------------------------------------


def cover(usable: frozenset[str], weights: dict[str, float], threshold: float) -> dict[str, int] | None:
    """For pairs with these hashes on both sides: hash -> bits, so that a similar pair is within them in one hash.

    Every choice of hashes is tried with the fewest bits that make it complete; the cheapest is
    taken (fewest bits, then fewest hashes).  None if no pair can reach the threshold.
    """
    by = sum(weights[h] for h in usable)
    best: tuple | None = None
    for n in range(1, len(usable) + 1):
        for chosen in combinations(sorted(usable), n):
            for k in range(-1, 65):
                most = sum(weights[h] * (S.transfer_value(h, min(64, k + 1)) if h in chosen else 1.0) for h in usable) / by
                if most < threshold - _EPS:
                    break
            if best is None or (k, n) < best[:2]:
                best = (k, n, chosen)
    k, _, chosen = best
    return None if k < 0 else dict.fromkeys(chosen, k)


#: Work of writing and shuffling one keyed row, in candidate pairs looked at; most keys of a row under one plan.
ROW_COST, MAX_KEYS = 100, 128
#: Bytes of a keyed row, as shuffled; they decide the number of partitions.
KEYED_BYTES = 30
#: A key held by more rows than this is split by further bits.
CROWDED = 50_000


def band_plan(bits: int, asking: int, answering: int) -> tuple[int, int]:
    """(blocks, equal blocks) with the least expected work for complete search within ``bits``.

    Work: keyed rows of both sides, and candidate pairs of evenly spread hashes.  A row never has more than MAX_KEYS keys, or ``bits`` + 1.
    """
    options = []
    for equal in range(1, 5):
        blocks = bits + equal
        n = comb(blocks, equal)
        if blocks <= 64 and (equal == 1 or n <= MAX_KEYS):
            options.append((n * (ROW_COST * (asking + answering) + asking * answering / 2 ** (64 * equal / blocks)), blocks, equal))
    return min(options)[1:]


def near_pairs(fingerprints: DataFrame, threshold: float, weights: dict[str, float] | None = None, crowded: int = CROWDED) -> DataFrame:
    """``id_a`` < ``id_b``, ``similarity`` of all pairs at or above the threshold (> 0).

    Complete and without a cross join.  Which hashes both sides have decides which of them must be
    close in a similar pair; equal bit blocks of those are the join keys.  The keyed rows hold a class number and one hash, and the
    distance of that hash is the condition of the join; only the pairs within it are looked at with all their hashes.  Records with equal
    hashes meet once: they are collapsed to one representative before the join, and the pairs are put out between
    representatives (``class_members`` tells whom they stand for).

    ``fingerprints``: one row an id with ``perceptual_hashes``; rows without any hash match nothing.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    w = {h: v for h, v in S.weights_or_default(weights).items() if v > 0}
    names = sorted(w)
    spark = fingerprints.sparkSession
    reps, _ = stage(hash_classes(fingerprints, names).withColumn("c", F.monotonically_increasing_id()), "classes")
    sizes = {r.mask: r["count"] for r in reps.groupBy("mask").count().collect()}  # at most 16
    masks = sorted(sizes)
    plans: dict[tuple, list] = {}
    covers: dict[frozenset, dict | None] = {}
    for i, a in enumerate(masks):
        for b in masks[i:]:
            both = frozenset(n for j, n in enumerate(names) if a & b & (1 << j))
            if both not in covers:
                covers[both] = cover(both, w, threshold) if both else None
            for h, bits in (covers[both] or {}).items():
                plans.setdefault((h, bits), []).append((a, b))
    # the rarer mask of a pair asks and the other answers, so that common masks do not meet in plans made for rare ones
    asks, answers, most, keyed_rows = [], [], [], 0
    for no, ((h, bits), mask_pairs) in enumerate(_merged(plans).items()):
        ordered = {tuple(sorted(pair, key=lambda m: (sizes[m], m))) for pair in mask_pairs}
        sides = [sorted({pair[i] for pair in ordered}) for i in (0, 1)]
        counts = [sum(sizes[m] for m in side) for side in sides]
        plan = band_plan(bits, *counts)
        keyed_rows += comb(*plan) * sum(counts)
        tagged = B.keys(F.col(h), *plan, F.lit(no))
        most.append(bits)
        for side, out in zip(sides, (asks, answers)):
            keyed = reps.where((F.col(h) != 0) & F.col("mask").isin(side))
            out.append(keyed.select(F.explode(F.array_distinct(tagged)).alias("k"), "c", F.col("mask").cast("byte").alias("mask"), F.col(h).alias("h"), F.lit(bits).cast("byte").alias("bits")))
    if not plans:
        return spark.createDataFrame([], "id_a string, id_b string, similarity double")
    sides = []
    for parts in (asks, answers):
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        sides.append(df)
    hot = B.crowded(sides[1], crowded)
    a, b = (B.split_crowded(df, hot, max(most)).alias(n) for n, df in zip("ab", sides))
    once = (F.col("a.mask") != F.col("b.mask")) | (F.col("a.c") < F.col("b.c"))
    near = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= F.col("a.bits")
    found = a.join(b, (F.col("a.k") == F.col("b.k")) & near & once & (F.col("a.c") != F.col("b.c")))
    found = found.select(F.least("a.c", "b.c").alias("ca"), F.greatest("a.c", "b.c").alias("cb")).distinct()
    ends = [reps.select(F.col("c").alias(f"c{x}"), *[F.col(n).alias(f"{x}_{n}") for n in ("id", *names)]) for x in "ab"]
    sim = S.fingerprint_similarity(lambda n: F.col(f"a_{n}"), lambda n: F.col(f"b_{n}"), w)
    with shuffle_width(spark, keyed_rows * KEYED_BYTES):
        pairs, _ = stage(found, "candidates")
    out = hot_join(hot_join(pairs, ends[0], "ca"), ends[1], "cb")
    return out.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)


def _merged(plans: dict[tuple, list]) -> dict[tuple, list]:
    """Plans of one hash whose bits are at most one apart share the wider one."""
    out: dict[tuple, list] = {}
    for h, bits in sorted(plans, reverse=True):
        at = next((k for k in out if k[0] == h and k[1] - bits <= 1), (h, bits))
        out.setdefault(at, []).extend(plans[h, bits])
    return out


def hash_classes(fingerprints: DataFrame, names: list[str]) -> DataFrame:
    """One row for each set of equal hashes: ``id`` (smallest), the hashes (null as 0), ``mask`` of the set ones, ``copies``."""
    cols = [F.coalesce(F.col(f"perceptual_hashes.{n}"), F.lit(0)).alias(n) for n in names]
    flat = fingerprints.where("id is not null").select("id", *cols)
    mask = sum((F.when(F.col(n) != 0, 1 << j).otherwise(0) for j, n in enumerate(names)), F.lit(0))
    return flat.groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("mask", mask).where("mask > 0")


def class_members(fingerprints: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``id``, ``rep``: which representative stands for each record with a hash."""
    names = sorted(h for h, v in S.weights_or_default(weights).items() if v > 0)
    reps = hash_classes(fingerprints, names).select(F.xxhash64(*names).alias("hk"), F.col("id").alias("rep"))
    key = F.xxhash64(*[F.coalesce(F.col(f"perceptual_hashes.{n}"), F.lit(0)) for n in names])
    return hot_join(fingerprints.where("id is not null").select("id", key.alias("hk")), reps, "hk").select("id", "rep")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``leads`` of the records that a range of open edges (``hi``, ``lo``, ``leads`` of ``lo``) decides, in the order of ``hi``."""
    done: dict = {}
    hi, led, free = None, False, False
    for b in batches:
        for h, lo, leads in zip(*(c.to_pylist() for c in b.columns)):
            if h != hi:
                if led or free:
                    done[hi] = not led
                hi, led, free = h, False, True
            known = done.get(lo) if leads is None else leads
            led, free = led or known is True, free and known is False
        # the last record may go on in the next batch
    if led or free:
        done[hi] = not led
    ids = list(done)
    for s in range(0, len(ids), 10000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 10000]), pa.array([done[i] for i in ids[s : s + 10000]], pa.bool_())], names=["id", "leads"])


def leaders(pairs: DataFrame, range_edges: int = 200_000) -> DataFrame:
    """``id``, ``leader`` of greedy grouping in id order, from the pairs (``id_a`` < ``id_b``) of similar records.

    A record all of whose earlier neighbours are members leads; one with an earlier leader is a
    member of the smallest of them.  Rounds repeat until none is undecided (lexicographically
    first maximal independent set).  A round cuts the undecided records into ranges of about ``range_edges`` edges and
    goes through each in id order, so it decides at least the whole first range, however long a chain is.
    Records without a pair are not listed: they lead themselves.
    """
    spark = pairs.sparkSession
    edges, edge_path = stage(pairs.select(F.col("id_a").alias("lo"), F.col("id_b").alias("hi")).distinct(), "leaders")
    first = edges.select(F.col("lo").alias("id")).distinct().join(edges.select(F.col("hi").alias("id")).distinct(), "id", "left_anti")
    decided, path = stage(first.select("id", F.lit(True).alias("leads")), "leaders")
    kind = f"id {edges.schema['hi'].dataType.simpleString()}, leads boolean"
    while True:
        open_edges, open_path = stage(edges.join(decided.select(F.col("id").alias("hi")), "hi", "left_anti"), "leaders")
        n = open_edges.count()
        if not n:
            drop_path(spark, open_path)
            break
        state = hot_join(open_edges, decided.select(F.col("id").alias("lo"), "leads"), "lo", "left").select("hi", "lo", "leads")
        news = state.repartitionByRange(-(-n // range_edges), "hi").sortWithinPartitions("hi").mapInArrow(_decide, kind)
        nxt, nxt_path = stage(decided.unionByName(news), "leaders")
        for p in (path, open_path):
            drop_path(spark, p)
        decided, path = nxt, nxt_path
    heads = decided.where("leads").select("id", F.col("id").alias("leader"))
    led = edges.join(heads.select(F.col("id").alias("lo")), "lo").join(decided.where("not leads").select(F.col("id").alias("hi")), "hi")
    return heads.unionByName(led.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader")))


def near_groups(fingerprints: DataFrame, threshold: float, weights: dict[str, float] | None = None) -> DataFrame:
    """``id``, ``leader`` of every record in a near group of two or more, copies of equal hashes included."""
    pairs, _ = stage(near_pairs(fingerprints, threshold, weights), "near")
    lead = leaders(pairs).select(F.col("id").alias("rep"), "leader")
    members = class_members(fingerprints, weights)
    # equal hashes are similar by 1, so they share a leader: the first of all
    named = hot_join(members, lead, "rep", "left").select("id", F.coalesce("leader", "rep").alias("leader"))
    sizes = named.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
    return hot_join(named, sizes, "leader")


#: Members of a group that meet the group in one block.
BLOCK_ROWS = 2000


def in_blocks(rows: DataFrame, group: str, key: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides of a meeting of each group with itself, joined on ``group`` and ``meet``.

    A group is dealt into blocks of about ``block_rows`` rows, and every block meets every block, so that no task holds a group
    and the number of tasks follows its size.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    dealt = hot_join(rows, sizes, group).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = dealt.withColumn("_o", every).withColumn("meet", F.col("_b") * F.col("_n") + F.col("_o"))
    right = dealt.withColumn("_o", every).withColumn("meet", F.col("_o") * F.col("_n") + F.col("_b"))
    return tuple(x.drop("_n", "_b", "_o") for x in (left, right))


def group_confidence(groups: DataFrame, fingerprints: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``leader``, ``confidence``: mean similarity over all pairs of a group, those below the threshold included.

    A group's distinct hash sets, with their numbers of copies, meet in blocks; only sums leave the join.
    """
    names = sorted(h for h, v in S.weights_or_default(weights).items() if v > 0)
    cols = [F.coalesce(F.col(f"perceptual_hashes.{n}"), F.lit(0)).alias(n) for n in names]
    rows = groups.select("id", "leader").join(fingerprints.select("id", *cols), "id")
    classes, _ = stage(rows.groupBy("leader", *names).agg(F.count("*").alias("c"), F.min("id").alias("id")), "confidence")
    a, b = (x.alias(n) for x, n in zip(in_blocks(classes, "leader", "id", block_rows), "ab"))
    cond = (F.col("a.leader") == F.col("b.leader")) & (F.col("a.meet") == F.col("b.meet")) & (F.col("a.id") <= F.col("b.id"))
    sim = S.fingerprint_similarity(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"), weights)
    ca, cb = F.col("a.c"), F.col("b.c")
    n = F.when(F.col("a.id") == F.col("b.id"), ca * (ca - 1) / 2).otherwise((ca * cb).cast("double"))
    sums = a.join(b, cond).select(F.col("a.leader").alias("leader"), (sim * n).alias("s"), n.alias("n")).groupBy("leader").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("leader", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("confidence"))


def near_group_records(fingerprints: DataFrame, threshold: float, policy: Policy = Policy.HIGHEST_QUALITY, weights: dict[str, float] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``group_id``, ``leader``, ``main_image``, ``n_members``, ``reason``, ``confidence``, numbered by leader.

    ``groups``: the result of ``near_groups`` where it is at hand already.
    """
    if groups is None:
        groups, _ = stage(near_groups(fingerprints, threshold, weights), "near")
    facts = fingerprints.select("id", "metadata", "quality")
    main = best_of_group(groups.join(facts, "id"), "leader", policy).select("leader", F.col("id").alias("main_image"))
    sizes = groups.groupBy("leader").agg(F.count("*").alias("n_members"))
    rows = number_groups(sizes, "leader", "near").join(main, "leader").join(group_confidence(groups, fingerprints, weights), "leader")
    return rows.select("group_id", "leader", "main_image", "n_members", F.lit("near").alias("reason"), "confidence")


def leader_similarity(groups: DataFrame, fingerprints: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``leader``, ``main_image``, ``n_members``, ``confidence`` where the leader is kept and the last member's similarity counts."""
    h = fingerprints.select("id", "perceptual_hashes")
    m = groups.where("id <> leader").join(h.withColumnRenamed("perceptual_hashes", "mh"), "id")
    both = m.join(h.select(F.col("id").alias("leader"), F.col("perceptual_hashes").alias("lh")), "leader")
    sim = S.fingerprint_similarity(lambda n: F.col(f"lh.{n}"), lambda n: F.col(f"mh.{n}"), weights)
    return both.groupBy("leader").agg(F.max_by(sim, F.col("id")).alias("confidence"), (F.count("*") + 1).alias("n_members")).withColumn("main_image", F.col("leader"))


def similar_to(fingerprints: DataFrame, target_id: str, threshold: float, weights: dict[str, float] | None = None) -> DataFrame:
    """``id``, ``similarity`` of all other records at least this similar to one record (one row is broadcast)."""
    target = fingerprints.where(F.col("id") == target_id).select(F.col("perceptual_hashes").alias("th")).limit(1)
    sim = S.fingerprint_similarity(lambda n: F.col(f"th.{n}"), lambda n: F.col(f"perceptual_hashes.{n}"), weights)
    rows = fingerprints.where(F.col("id") != target_id).crossJoin(F.broadcast(target))
    return rows.select("id", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def byte_verified(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``sha``, ``same``: whether all files of an exact group have one content (``files``: path, content; ``groups``: sha, path)."""
    size = F.length("content")
    prints = files.select("path", size.alias("size"), F.sha2("content", 512).alias("print"))
    seen = groups.join(prints, "path", "left")
    return seen.groupBy("sha").agg(((F.min("print") == F.max("print")) & (F.min("size") == F.max("size")) & F.bool_and(F.col("print").isNotNull())).alias("same"))


def partial_hash_candidates(files: DataFrame, content: Column, n: int) -> DataFrame:
    """``size``, ``head``, ``n_files``: files of equal size and equal first ``n`` bytes, the only ones worth a full hash."""
    rows = files.select(F.length(content).alias("size"), S.partial_sha256(content, n).alias("head"))
    return rows.groupBy("size", "head").agg(F.count("*").alias("n_files")).where("n_files > 1")
