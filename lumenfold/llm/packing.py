"""Problem 8: texts into containers of a fixed token capacity, by bulk-synchronous best fit.

Items are range-sorted by size and ranked among those of equal size; gaps are kept by size too.  The sweep goes over
classes of equal size, of which there are at most capacity + 1, however many items there are: the largest class takes its successors
among the gaps (the tightest that hold it), as many items a gap as fit; conflicts are resolved by rank, the item of rank r
going to the container of its place in the run of gaps; the gaps are updated, what is left opens new containers, and the next
class follows.  This is what placing one item after another by best fit over falling sizes gives.  Only class counts reach the
driver, and only runs of ranks (a few for a class) leave it; items are sorted once and never gathered.
Texts larger than the capacity are split first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.splitting import split_documents
from lumenfold.llm.tokens import VOCABULARY
from lumenfold.runtime import stage, width

CAPACITY = 8192
#: Items aimed at in a range.
RANGE_ROWS = 100_000
#: Most size classes; with a larger capacity sizes are rounded up to its share of this, which costs less than this share of the space.
MAX_CLASSES = 1 << 16


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, first container, items a container) of every size class, and the number of containers.

    ``counts``: how many items have each size.  Items of one size and one run go, in the order of their ranks, to the
    run's containers one after the other.  Items of size 0 are spread over all containers.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of containers that have it
    order: list[int] = []  # the gaps there are, rising
    containers = 0

    def put(gap: int, first: int, end: int) -> None:
        if gap and end > first:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, end))

    for size in sorted((s for s in counts if s), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, end = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, containers
                end = containers = first + -(-left // (capacity // size))
            each = gap // size
            full = min(end - first, left // each)
            rest = left - full * each if first + full < end and left - full * each < each else 0
            used = first + full + (1 if rest else 0)
            runs.append((size, rank, first, each))
            put(gap - each * size, first, first + full)
            if rest:
                put(gap - rest * size, first + full, used)
            put(gap, used, end)
            rank, left = rank + full * each + rest, left - full * each - rest
    if counts.get(0):
        containers = max(1, containers)
        runs.append((0, 0, 0, -(-counts[0] // containers)))
    return runs, containers


def _ranked(items: DataFrame, size: str, order: Sequence[str], rows: int) -> DataFrame:
    """Items sorted over ranges, with the number of their range and their rank among its items of equal size."""
    spark = items.sparkSession

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(0).to_numpy()
            begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            k = np.arange(len(s)) - np.repeat(begins, np.diff(np.r_[begins, len(s)]))
            if s[0] == last:
                k[: begins[1] if len(begins) > 1 else len(s)] += seen
            last, seen = int(s[-1]), int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), me, np.int32)), pa.array(k), *b.columns], names=["_range", "_rank", *b.schema.names])

    n = max(1, min(width(spark), -(-rows // RANGE_ROWS)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.repartitionByRange(n, size, *order).sortWithinPartitions(size, *order).mapInArrow(rank, f"_range int, _rank long, {fields}")


def pack(items: DataFrame, capacity: int, order: Sequence[str] = ("item",), size: str = "size") -> DataFrame:
    """``items`` with ``container`` (from 0), sizes within 0..``capacity``; ``order`` names columns that tell items of equal size apart.

    No item is split, left out or put out twice.  Items of size 0 lie in any container.  Without items there is no row.
    """
    spark = items.sparkSession
    grain = -(-capacity // MAX_CLASSES)
    cols = items.columns
    sized = items.select(F.ceil(F.col(size) / grain).cast("long").alias("_size") if grain > 1 else F.col(size).cast("long").alias("_size"), *cols)
    facts = items.agg(F.count("*").alias("n"), F.count_if(F.col(size).isNull() | (F.col(size) > capacity) | (F.col(size) < 0)).alias("bad")).first()
    if facts.bad:
        raise ValueError("sizes must lie within 0..capacity")
    ranked, _ = stage(_ranked(sized, "_size", order, facts.n), "p8-ranked")
    # ranges are consecutive, so there are at most ranges + classes pairs of range and size
    found = ranked.groupBy("_range", "_size").count().collect()
    counts: dict[int, int] = {}
    offset: dict[int, dict[int, int]] = {}
    for r in sorted(found, key=lambda r: (r._range, r._size)):
        offset.setdefault(r._range, {})[r._size] = counts.get(r._size, 0)
        counts[r._size] = counts.get(r._size, 0) + r["count"]
    runs, _ = plan(counts, capacity // grain)
    by_size: dict[int, tuple] = {}
    for s, rank, first, each in runs:
        by_size.setdefault(s, ([], [], []))
        for col, v in zip(by_size[s], (rank, first, each)):
            col.append(v)
    by_size = {s: tuple(np.array(c, np.int64) for c in x) for s, x in by_size.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, rank, s = (b.column(i).to_numpy() for i in range(3))
            out = np.empty(len(s), np.int64)
            keys = np.r_[True, (s[1:] != s[:-1]) | (part[1:] != part[:-1])] if len(s) else np.zeros(0, bool)
            begins = np.flatnonzero(keys)
            for a, z in zip(begins, np.r_[begins[1:], len(s)]):
                at = rank[a:z] + offset[int(part[a])][int(s[a])]
                ranks, first, each = by_size[int(s[a])]
                k = np.searchsorted(ranks, at, "right") - 1
                out[a:z] = first[k] + (at - ranks[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(out)], names=[*cols, "container"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(assign, f"{fields}, container long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``piece_no``, ``char_from``, ``char_to``, ``n_tokens``, ``container``.

    Only texts larger than the capacity are split (``piece_no`` > 1 exists for them alone), at natural
    boundaries and without overlap.  Empty texts take no space; null ids and texts are left out.
    """
    pieces, _ = stage(split_documents(documents, capacity, 0, vocabulary, texts=False).drop("core_from"), "p8-pieces")
    return pack(pieces, capacity, ("doc_id", "piece_no"), "n_tokens")
