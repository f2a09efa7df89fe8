"""Join keys of 64-bit words: words within a few bits of each other share at least one key.

A word is cut into ``blocks`` blocks of bits; for every choice of ``equal`` of them there is a key of their values.
Words that differ in at most ``blocks - equal`` bits agree on all of some choice, whichever way the bits are dealt to the blocks, so a
crowded key can be split by the keys of another dealing without losing a pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd numbers: bit i of a word goes to place i * step of the dealing.
_STEPS = (1, 27, 45)
#: At most this many crowded keys are split.
MAX_CROWDED = 1024


def masks(blocks: int, equal: int, dealing: int = 0) -> list[int]:
    """Bit masks, as signed 64-bit numbers, of all choices of blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    place = [i * _STEPS[dealing] % 64 for i in range(64)]
    own = [sum(1 << b for b in range(64) if edges[i] <= place[b] < edges[i + 1]) for i in range(blocks)]
    every = [sum(c) for c in combinations(own, equal)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in every]


def keys(h: Column, blocks: int, equal: int, tag: Column, dealing: int = 0) -> Column:
    """Array of keys, one for each choice of blocks: a hash of the tag, the chosen bits and their values."""
    chosen = F.lit(masks(blocks, equal, dealing)).cast("array<bigint>")
    return F.transform(chosen, lambda m: F.xxhash64(tag, m, h.bitwiseAND(m)))


def crowded(keyed: DataFrame, least: int, share: int = 64) -> list[int]:
    """Values of ``k`` held by more than about ``least`` rows, the most frequent first, at most MAX_CROWDED.

    Counted over one in ``share`` of the words ``h`` (chosen by hash); what is found decides only how the work is split.
    """
    some = keyed.where(F.pmod(F.xxhash64("h", F.lit(share)), F.lit(share)) == 0)
    counts = some.groupBy("k").count().where(F.col("count") > max(1, least // share))
    return [r.k for r in counts.orderBy(F.col("count").desc(), "k").limit(MAX_CROWDED).collect()]


def split_crowded(keyed: DataFrame, hot: list[int], bits: int, dealing: int = 1) -> DataFrame:
    """The rows (``k``, ``h``, ...) with each crowded key replaced by its parts under another dealing, complete within ``bits``."""
    if not hot:
        return keyed
    parts = F.array_distinct(keys(F.col("h"), bits + 2, 2, F.col("k"), dealing))
    new = F.explode(F.when(F.col("k").isin(hot), parts).otherwise(F.array("k"))).alias("k")
    return keyed.select(new, *[c for c in keyed.columns if c != "k"])
