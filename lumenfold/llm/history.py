"""Problem 6: duplicates of new batches against all accepted history.

Multi-key sorted neighbourhood over persisted, sorted runs of two kinds: content hashes, and perceptual hashes under several
keys.  A 64-bit hash is cut into ``BLOCKS`` bit blocks; for every choice of ``EQUAL`` of them one sorted key is made whose
leading bits are the chosen blocks.  Two hashes that differ in at most ``BLOCKS - EQUAL`` bits
agree on all of some choice, so they stand in the same window (equal leading bits) of at least
one key order: the search is complete.  A window that many hashes share is parted by further bits.  Runs are tables
bucketed and sorted by their keys, so a new batch is shuffled alone and merge-joined with every run; only windows
around new hashes are compared.

Batches come one after the other: a batch is matched with the runs and then appended as a run of its own, without what is
there already.  A run is merged with the one before it while it is at least half as large, so each hash is written again a few times in all,
and the largest run stays as it is until what came after it has grown to its size.
"""

from __future__ import annotations

import json
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import blocks as B
from lumenfold.runtime import drop_path, hot_join, scratch, stage, width

BLOCKS, EQUAL = 5, 2
MAX_BITS = BLOCKS - EQUAL
#: A window of more hashes is parted.
CROWDED = 20_000


def clean_sha(col: str) -> Column:
    """64 hex digits in lower case, without blanks around them and a ``sha256:`` prefix; else null."""
    c = F.lower(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"^sha256:", ""), r"^\s+", "")
    return F.when(c.rlike("^[0-9a-f]{64}$"), c)


def _blocks(n: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, bits) of each block of a 64-bit word."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def window_keys(h: Column) -> Column:
    """Array of leading-bit keys, one for each choice of blocks; the choice's number is in the top bits."""
    keys = []
    for no, chosen in enumerate(combinations(_blocks(), EQUAL)):
        k, used = F.lit(no).cast("long"), 0
        for shift, bits in chosen:
            part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            k = F.shiftleft(k, bits).bitwiseOR(part)
            used += bits
        keys.append(k)
    return F.array(*keys)


def _keyed(hashes: DataFrame, parted: list[list[int]]) -> DataFrame:
    """``k``, ``h``: every hash under all its keys, the crowded ones of each level parted."""
    out = hashes.select(F.explode(window_keys(F.col("h"))).alias("k"), "h")
    for level, hot in enumerate(parted, 1):
        out = B.split_crowded(out, hot, MAX_BITS, level)
    return out


_KINDS = {"sha": ("sha BINARY", ["sha"]), "hash": ("k BIGINT, h BIGINT", ["k", "h"])}


class HashHistory:
    """Persisted sorted runs of accepted content hashes and perceptual hashes below ``path``.

    The folder lists its runs, so a later session that gives the same path goes on where this one
    ended, without reading or writing the history again.  ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, crowded: int = CROWDED):
        self.spark, self.path = spark, path or scratch(spark, "history")
        self.buckets, self.crowded = buckets or width(spark), crowded
        #: kind -> runs, oldest first: name, rows, and the keys that are parted, by level
        self.runs: dict[str, list[dict]] = {kind: [] for kind in _KINDS}
        if text := self._manifest():
            kept = json.loads(text)
            self.buckets, self.runs = kept["buckets"], kept["runs"]
            for kind, runs in self.runs.items():
                columns, by = _KINDS[kind]
                for r in runs:
                    if not spark.catalog.tableExists(r["name"]):
                        spark.sql(f"CREATE TABLE {r['name']} ({columns}) USING parquet LOCATION '{self.path}/{r['name']}' CLUSTERED BY ({by[0]}) SORTED BY ({', '.join(by)}) INTO {self.buckets} BUCKETS")

    def _manifest(self, text: str | None = None) -> str | None:
        """Read (or write) the list of runs."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/RUNS")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if text is not None:
            out = fs.create(p, True)
            out.write(bytearray(text.encode()))
            out.close()
        elif fs.exists(p):
            stream = fs.open(p)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
        return text

    def _publish(self) -> None:
        self._manifest(json.dumps({"buckets": self.buckets, "runs": self.runs}))

    def _write(self, rows: DataFrame, kind: str) -> dict:
        """A run of distinct content hashes (``sha``) or perceptual hashes (``h``)."""
        name, seen, parted = f"run_{uuid.uuid4().hex[:12]}", Observation(), []
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        if kind == "hash":
            rows, path = stage(rows, "p6-run")
            for level in (1, 2):
                hot = B.crowded(_keyed(rows, parted), self.crowded) if seen.get["n"] > self.crowded else []
                if not hot:
                    break
                parted.append(hot)
            rows = _keyed(rows, parted)
        by = _KINDS[kind][1]
        rows.repartition(self.buckets, by[0]).write.format("parquet").bucketBy(self.buckets, by[0]).sortBy(*by).option("path", f"{self.path}/{name}").saveAsTable(name)
        if kind == "hash":
            drop_path(self.spark, path)
        return {"name": name, "rows": seen.get["n"], "parted": parted}

    def _drop(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        drop_path(self.spark, f"{self.path}/{run['name']}")

    def _hashes(self, run: dict) -> DataFrame:
        """The distinct hashes of a run: those of one choice of blocks where no key is parted."""
        df = self.spark.table(run["name"])
        return df.select("h").distinct() if run["parted"] else df.where(F.col("k") < (1 << 32)).where(F.col("k") == window_keys(F.col("h"))[0]).select("h")

    def _merge(self, kind: str, runs: list[dict]) -> dict:
        parts = [self.spark.table(r["name"]) if kind == "sha" else self._hashes(r) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self._write(out, kind)

    def append(self, shas: DataFrame | None, hashes: DataFrame | None) -> None:
        """Add distinct content hashes (``sha``) and perceptual hashes (``h``) that no run has, as sorted runs; merge what is due."""
        for kind, rows in (("sha", shas), ("hash", hashes)):
            if rows is None:
                continue
            runs = self.runs[kind]
            runs.append(self._write(rows, kind))
            due = 1
            while due < len(runs) and sum(r["rows"] for r in runs[-due:]) * 2 >= runs[-due - 1]["rows"]:
                due += 1
            if due > 1:
                self._compact(kind, due)
        self._publish()

    def _compact(self, kind: str, last: int) -> None:
        old = self.runs[kind][-last:]
        self.runs[kind] = [*self.runs[kind][:-last], self._merge(kind, old)]
        self._publish()
        for r in old:
            self._drop(r)

    def compact(self) -> None:
        """Merge all runs of each kind into one."""
        for kind, runs in self.runs.items():
            if len(runs) > 1:
                self._compact(kind, len(runs))

    def drop(self) -> None:
        for runs in self.runs.values():
            for r in runs:
                self._drop(r)
        drop_path(self.spark, self.path)

    def match(self, shas: DataFrame, hashes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
        """``sha``, ``h``, ``same``: the content hashes that a run has, and the hashes near one of a run (``same``: a run has the hash itself)."""
        if max_bits > MAX_BITS:
            raise ValueError(f"complete only up to {MAX_BITS} bits")
        out = self.spark.createDataFrame([], "sha binary, h long, same boolean")
        null = lambda t: F.lit(None).cast(t)
        for r in self.runs["sha"]:
            hit = shas.join(self.spark.table(r["name"]).hint("merge"), "sha", "left_semi")
            out = out.unionByName(hit.select("sha", null("long").alias("h"), F.lit(True).alias("same")))
        found = None
        for r in self.runs["hash"]:
            differ = F.bit_count(F.col("n.h").bitwiseXOR(F.col("r.h")))
            new = _keyed(hashes, r["parted"]).alias("n").join(self.spark.table(r["name"]).hint("merge").alias("r"), (F.col("n.k") == F.col("r.k")) & (differ <= max_bits))
            hit = new.select(F.col("n.h").alias("h"), (differ == 0).alias("same"))
            found = hit if found is None else found.unionByName(hit)
        if found is not None:
            out = out.unionByName(found.groupBy("h").agg(F.bool_or("same").alias("same")).select(null("binary").alias("sha"), "h", "same"))
        return out

    def take(self, shas: DataFrame, hashes: DataFrame) -> DataFrame:
        """Match a batch's distinct content and perceptual hashes, then append those that are new; gives what ``match`` gives."""
        found, _ = stage(self.match(shas, hashes), "p6-found")
        known = found.where("same")
        self.append(shas.join(known.where("sha is not null").select("sha"), "sha", "left_anti"), hashes.join(known.where("h is not null").select("h"), "h", "left_anti"))
        return found


def match_batches(arrivals: DataFrame, accepted: DataFrame, history: HashHistory | None = None) -> DataFrame:
    """``arrival_id``, ``kind`` (``exact`` or ``near``) of every arrival that repeats what came before.

    ``arrivals``: arrival_id, batch_no, sha256, p_hash; ``accepted``: sha256, p_hash (before any batch), with which a history is begun; the
    batches are taken one after the other.  Null or invalid texts and hashes of 0 or null match nothing; rows without batch_no
    or arrival_id are left out; repeated rows count once; empty inputs give an empty result.
    """
    spark = arrivals.sparkSession
    sha = lambda: F.unhex(clean_sha("sha256")).alias("sha")
    new = arrivals.select("arrival_id", F.col("batch_no").cast("int").alias("batch"), sha(), F.when(F.col("p_hash") != 0, F.col("p_hash")).alias("h"))
    new, _ = stage(new.where("arrival_id is not null and batch is not null").distinct(), "p6-arrivals")
    old, _ = stage(accepted.select(sha(), F.when(F.col("p_hash") != 0, F.col("p_hash")).alias("h")), "p6-accepted")
    only = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct()

    index = history or HashHistory(spark)
    index.append(only(old, "sha"), only(old, "h"))
    hits = None
    for r in new.select("batch").distinct().orderBy("batch").collect():  # one row a batch
        batch = new.where(F.col("batch") == r.batch)
        found = index.take(only(batch, "sha"), only(batch, "h")).withColumn("batch", F.lit(r.batch))
        hits = found if hits is None else hits.unionByName(found)
    if history is None:
        index.drop()
    if hits is None:
        return spark.createDataFrame([], "arrival_id long, kind string")
    # contents are judged once each, and their many arrivals joined apart from the others
    new = new.withColumns({"s": F.xxhash64("batch", "sha"), "n": F.xxhash64("batch", "h")})
    exact = hits.where("sha is not null").select(F.xxhash64("batch", "sha").alias("s"), F.struct("batch", "sha").alias("exact")).groupBy("s").agg(F.collect_set("exact").alias("exact"))
    near = hits.where("h is not null").select(F.xxhash64("batch", "h").alias("n"), F.struct("batch", "h").alias("near")).groupBy("n").agg(F.collect_set("near").alias("near"))
    # the key is a hash of batch and content, so the content itself is looked for among the few that share it
    joined = hot_join(hot_join(new, exact, "s", "left"), near, "n", "left")
    has = lambda c, *parts: F.coalesce(F.array_contains(c, F.struct(*parts)), F.lit(False)) & F.col(parts[1]).isNotNull()
    kind = F.when(has("exact", "batch", "sha"), "exact").when(has("near", "batch", "h"), "near")
    return joined.select("arrival_id", kind.alias("kind")).where("kind is not null").distinct()
