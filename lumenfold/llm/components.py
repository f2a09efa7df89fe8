"""Connected components by alternating large-star and small-star rewrites.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and
Beyond (SoCC 2014).  Edges are kept oriented (``hi`` > ``lo``).

* large-star: every node u sends its smallest neighbour to all larger neighbours;
* small-star: every node u sends its smallest neighbour to all smaller neighbours and itself.

With oriented edges only the smaller neighbours decide a minimum, so both steps are one
``groupBy(hi).min(lo)`` (partially aggregated) and one equi-join.  Nodes with very many edges
are joined apart (``hot_join``), so no task receives a hot node's edges.  Nodes that are not whole
numbers are numbered in their own order first, so the rewrites move 16 bytes an edge, and the smallest number
of a component is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.runtime import drop_path, hot_join, stage, width


#: A node with more edges (16 bytes each) than this is joined apart.
HOT_EDGES = 200_000


def _with_min(edges: DataFrame, on: str, rows: int | None) -> DataFrame:
    """``edges`` left-joined with the smallest neighbour ``m`` of the node in column ``on`` (null where all are larger)."""
    minima = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    return hot_join(edges, minima.select(F.col("hi").alias(on), "m"), on, "left", HOT_EDGES, rows)


def large_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(v, u) with v > u becomes (v, smallest neighbour of u or u itself). ``rows``: number of edges, where known."""
    return _with_min(edges, "lo", rows).select("hi", F.coalesce("m", "lo").alias("lo"))


def small_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, n) with n < u becomes (n, m) and (u, m), where m is the smallest neighbour of u."""
    both = F.explode(F.array(F.col("lo"), F.col("hi"))).alias("hi")
    return _with_min(edges, "hi", rows).select(both, F.col("m").alias("lo")).where("hi <> lo").distinct()


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The pairs by the rank numbers of their nodes, the nodes (``node``, ``no``), and the folders of both."""
    spark = pairs.sparkSession
    names, names_path = stage(pairs.select(F.explode(F.array("hi", "lo")).alias("node")).distinct(), "cc-names")
    ranked = names.repartitionByRange(width(spark), "node").sortWithinPartitions("node").withColumn("no", F.monotonically_increasing_id())
    nodes, nodes_path = stage(ranked, "cc-nodes")
    drop_path(spark, names_path)
    out, rows = pairs, pairs.count()
    for end in ("hi", "lo"):
        out = hot_join(out, nodes.select(F.col("node").alias(end), F.col("no").alias(f"{end}_no")), end, least=HOT_EDGES, rows=rows)
    numbered, path = stage(out.select(F.col("hi_no").alias("hi"), F.col("lo_no").alias("lo")), "cc")
    return numbered, nodes, [path, nodes_path]


def rewrite(edges: DataFrame, path: str | None = None) -> tuple[DataFrame, str | None, int]:
    """Stars of all components by alternating steps until a whole round changes nothing; also the rounds taken.

    ``edges``: distinct ``hi`` > ``lo``; ``path``: their folder, given up after the first round.
    """
    spark, rounds, before, n = edges.sparkSession, 0, None, edges.count()
    while True:
        rounds += 1
        mid, mid_path = stage(large_star(edges, n), "cc")  # as many edges as before
        seen = Observation()
        counted = small_star(mid, n).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
        nxt, nxt_path = stage(counted, "cc")
        for p in (path, mid_path):
            if p:
                drop_path(spark, p)
        edges, path, now = nxt, nxt_path, (seen.get["n"], seen.get["s"])
        n = now[0]
        if now == before or not now[0]:
            return edges, path, rounds
        before = now


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node that has an edge to another node, with the minimum node of its component.

    Input: any two columns of one orderable type; null ends, self-loops and repeated edges are
    ignored; other columns are not looked at.  Output: ``node``, ``component``; an empty input
    gives an empty result.  The loop ends when a whole round changes nothing, which it always does, as
    every change brings a node closer to its minimum.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    pairs, path = stage(pairs, "cc")
    nodes = None
    if not isinstance(pairs.schema["hi"].dataType, T.IntegralType):
        numbered, nodes, _ = _numbered(pairs)
        drop_path(spark, path)
        pairs, path = numbered, None
    stars, _, _ = rewrite(pairs, path)
    roots = stars.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
    if nodes is None:
        return out
    named = out.join(nodes.select(F.col("no").alias("node"), F.col("node").alias("name")), "node").select("name", "component")
    return hot_join(named, nodes.select(F.col("no").alias("component"), F.col("node").alias("top")), "component").select(F.col("name").alias("node"), F.col("top").alias("component"))
