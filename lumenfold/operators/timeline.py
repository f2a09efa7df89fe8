"""Mixed time texts to UTC instants: all interpretations per value, chosen along each source's records.

Every text is read in all valid ways: both orders of an all-number date, both occurrences of a repeated hour, all
units of a count.  A Viterbi pass over the source's records in their order picks the readings with the least cost.
What a source is known for (``date_order``) and what is likely of itself (the first occurrence, the unit that the number of
digits suggests) weighs more than any path; among the rest, format switches and backward time jumps are penalised.

Sources are cut into chunks by range, so that a source with a third of all records is spread over many tasks.
A record with one reading parts its source: stretches of several readings between such records are settled on their own.
Only the stretches at the ends of a chunk wait for its neighbours: each chunk gives its least cost from any first to any
last reading, and the few chunk ends (two a chunk) are joined on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timetext import CONTRADICTS, placed
from lumenfold.runtime import stage, width

#: Penalties of a changed day-month order and of a step back in time, against the record before.
SWITCH, BACKWARD = 2.0, 1.0
Readings = list[tuple[int, int, int]]  # (form, utc microseconds, own cost)
_INF = float("inf")


def step_cost(a: tuple, b: tuple) -> float:
    switch = SWITCH if a[0] and b[0] and a[0] != b[0] else 0.0
    return switch + (BACKWARD if b[1] < a[1] else 0.0)


def best_path(cands: list[Readings], first: int | None = None, last: int | None = None) -> tuple[float, list[int]]:
    """Least cost and the chosen reading of each record (each has at least one); ends may be fixed.

    Ties take the earlier reading.
    """
    cost = [float(c[2]) if first is None or i == first else _INF for i, c in enumerate(cands[0])]
    back: list[list[int]] = []
    for a, b in zip(cands, cands[1:]):
        came, new = [], []
        for y in b:
            steps = [c + step_cost(x, y) for c, x in zip(cost, a)]
            k = min(range(len(steps)), key=steps.__getitem__)
            came.append(k)
            new.append(steps[k] + y[2])
        back.append(came)
        cost = new
    at = min(range(len(cost)), key=cost.__getitem__) if last is None else last
    total, path = cost[at], [at]
    for came in reversed(back):
        at = came[at]
        path.append(at)
    return total, path[::-1]


def cost_matrix(cands: list[Readings]) -> list[list[float]]:
    """Least cost from every reading of the first to every reading of the last record.

    A record of one reading in between parts the path, so only what lies before the first and after the last such record is walked (the
    constant cost between them changes no choice).
    """
    alone = [i for i, c in enumerate(cands) if len(c) == 1]
    rows, cols = range(len(cands[0])), range(len(cands[-1]))
    if len(cands) == 1:
        return [[float(cands[0][i][2]) if i == j else _INF for j in cols] for i in rows]
    if not alone:
        return [[best_path(cands, i, j)[0] for j in cols] for i in rows]
    head, tail = cands[: alone[0] + 1], cands[alone[-1] :]
    into, out = [best_path(head, i)[0] for i in rows], [best_path(tail, None, j)[0] for j in cols]
    return [[a + b for b in out] for a in into]


def settle_ends(ends: list) -> dict[tuple[int, str], tuple[int, int]]:
    """(chunk, source) -> reading of its first and its last record, for sources over several chunks."""
    by: dict[str, list] = {}
    for e in sorted(ends, key=lambda e: (e.source, e.chunk)):
        by.setdefault(e.source, []).append(e)
    fixed = {}
    for source, parts in by.items():
        if len(parts) < 2:
            continue
        best = [(min(col), min(range(len(col)), key=col.__getitem__)) for col in zip(*parts[0].matrix)]
        trail = [[(None, i) for _, i in best]]
        total = [c for c, _ in best]
        for a, b in zip(parts, parts[1:]):
            ra, rb = list(zip(a.forms2, a.utcs2)), list(zip(b.forms, b.utcs))
            came, new = [], []
            for j in range(len(b.forms2)):
                c, p, i = min((total[p] + step_cost(ra[p], rb[i]) + b.matrix[i][j], p, i) for p in range(len(ra)) for i in range(len(rb)))
                came.append((p, i))
                new.append(c)
            trail.append(came)
            total = new
        j = min(range(len(total)), key=total.__getitem__)
        for part, came in zip(reversed(parts), reversed(trail)):
            p, i = came[j]
            fixed[part.chunk, source] = (i, j)
            j = p
    return fixed


_READ = "record long, field string, source string, forms array<tinyint>, utcs array<long>, costs array<int>"
#: kind 0: a settled value; 1: the ends of a source that may go on in another chunk; 2: a value that waits for them.
_CHUNK = "kind tinyint, chunk int, source string, pos long, record long, field string, utc long, forms array<tinyint>, utcs array<long>, costs array<int>, forms2 array<tinyint>, utcs2 array<long>, matrix array<array<double>>"
_KINDS = [pa.int8(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.float64()))]
_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every reading of each text (record, field, text, offset, zone_name, date_order, source)."""
    for b in batches:
        keep, sizes, flat = [], [0], []
        for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)))):
            if found := placed(*row):
                keep.append(i)
                flat += found
                sizes.append(len(flat))
        forms, utcs, costs = zip(*flat) if flat else ((), (), ())
        at, ends = pa.array(keep, pa.int64()), pa.array(sizes, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((forms, pa.int8()), (utcs, pa.int64()), (costs, pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(6).take(at), *lists], names=["record", "field", "source", "forms", "utcs", "costs"])


class _Chunk:
    """One chunk's values in the order of (source, record), repeated rows once."""

    def __init__(self, t: pa.Table):
        t = t.take(pc.sort_indices(t, [("source", "ascending"), ("record", "ascending"), ("field", "ascending")])).combine_chunks()
        lists = [t.column(c).combine_chunks() for c in ("forms", "utcs", "costs")]
        n = lists[0].value_lengths().to_numpy()
        start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
        forms, utcs, costs = (x.flatten().to_numpy() for x in lists)
        source = t.column("source").combine_chunks().dictionary_encode().indices.to_numpy()
        record = t.column("record").to_numpy()
        same = np.r_[False, (source[1:] == source[:-1]) & (record[1:] == record[:-1]) & (n[1:] == n[:-1]) & (utcs[start[1:]] == utcs[start[:-1]]) & (utcs[start[1:] + n[1:] - 1] == utcs[start[:-1] + n[:-1] - 1])] if len(n) else np.zeros(0, bool)
        keep = np.flatnonzero(~same)
        self.t, self.n, self.start, self.source = t.take(pa.array(keep)), n[keep], start[keep], source[keep]
        self.forms, self.utcs, self.costs = forms, utcs, costs
        self.size = len(keep)

    def readings(self, i: int) -> Readings:
        a, z = self.start[i], self.start[i] + self.n[i]
        return list(zip(self.forms[a:z].tolist(), self.utcs[a:z].tolist(), self.costs[a:z].tolist()))

    def stretches(self) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, with left, with right) of the stretches of several readings, and with the single-reading neighbours of their source."""
        many = self.n > 1
        edge = np.r_[True, self.source[1:] != self.source[:-1], True]  # edge[i]: a source begins at i
        begins = np.flatnonzero(many & np.r_[True, ~many[:-1] | edge[1:-1]])
        ends = np.flatnonzero(many & np.r_[~many[1:] | edge[1:-1], True]) + 1
        for a, z in zip(begins.tolist(), ends.tolist()):
            yield a, z, a if edge[a] else a - 1, z if edge[z] else z + 1


def settle_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    me, got = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
    if not got:
        return
    c = _Chunk(pa.Table.from_batches(got))
    pick, waits = c.start.copy(), []
    for a, z, left, right in c.stretches():
        if a == 0 or z == c.size:
            waits.append((a, z, left, right))
            continue
        _, path = best_path([c.readings(i) for i in range(left, right)])
        pick[a:z] += np.array(path[a - left : len(path) - (right - z)])
    settled = np.ones(c.size, bool)
    for a, z, _, _ in waits:
        settled[a:z] = False
    at = np.flatnonzero(settled & (c.costs[pick] < CONTRADICTS)) if c.size else np.zeros(0, int)
    blank = lambda n, kinds: [pa.nulls(n, k) for k in kinds]
    rows = c.t.take(pa.array(at))
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int8)), pa.array(np.full(len(at), me, np.int32)), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64()), rows.column("record").combine_chunks(), rows.column("field").combine_chunks(), pa.array(c.utcs[pick[at]]), *blank(len(at), _KINDS[7:])], names=_NAMES)
    # the first and the last source may go on in other chunks
    out: list[list] = [[] for _ in _NAMES]
    names, records, fields = (c.t.column(x).to_pylist() if waits else c.t.column(x) for x in ("source", "record", "field"))
    spans = {int(c.source[0]): None, int(c.source[-1]): None}
    for code in spans:
        a, z = int(np.searchsorted(c.source, code, "left")), int(np.searchsorted(c.source, code, "right"))
        alone = a + np.flatnonzero(c.n[a:z] == 1)
        # between the first and the last record of one reading nothing depends on the ends
        inside = range(a, z) if not len(alone) else [*range(a, alone[0] + 1), *range(max(alone[-1], alone[0] + 1), z)]
        cands = [c.readings(i) for i in inside]
        f, l = cands[0], cands[-1]  # noqa: E741
        name = names[a] if waits else names[a].as_py()
        for col, v in zip(out, (1, me, name, a, None, None, None, [r[0] for r in f], [r[1] for r in f], [r[2] for r in f], [r[0] for r in l], [r[1] for r in l], cost_matrix(cands))):
            col.append(v)
    for a, z, left, right in waits:
        for i in range(left, right):
            r = c.readings(i)
            # a neighbour goes along to be looked at and is put out already: it has no record
            mine = a <= i < z
            for col, v in zip(out, (2, me, names[i], i, records[i] if mine else None, fields[i], None, [x[0] for x in r], [x[1] for x in r], [x[2] for x in r], None, None, None)):
                col.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, _KINDS)], names=_NAMES)


def resolve(values: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """``record``, ``field``, ``utc_us`` of every text that gives an instant.

    ``values``: record (long), field, text, offset, source, zone_name, date_order (strings).  Null, blank, unset,
    invalid and unplaceable texts give no row, nor do texts whose only readings contradict the known order.  Values without a source
    stand alone; ties prefer day before month.  Repeated rows count once; empty input gives an empty result.
    """
    spark = values.sparkSession
    own = F.concat_ws("|", F.lit("alone"), F.col("record").cast("string"), F.col("field"))
    source = F.when(F.col("source").isNull(), own).otherwise(F.concat_ws("|", "source", "field"))
    named = values.where("record is not null and text is not null").select("record", "field", "text", "offset", "zone_name", "date_order", source.alias("source"))
    found, _ = stage(named.mapInArrow(read_batches, _READ), "p3-readings")
    rows = found.count()
    n = max(1, min(width(spark), -(-rows // 2000)), -(-rows // chunk_rows))
    chunks, _ = stage(found.repartitionByRange(n, "source", "record").mapInArrow(settle_chunk, _CHUNK), "p3-chunks")
    ends = chunks.where("kind = 1").select("chunk", "source", "forms", "utcs", "forms2", "utcs2", "matrix").collect()  # at most two rows a chunk
    fixed = settle_ends(ends)

    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(x).to_pylist() for x in ("pos", "record", "field", "forms", "utcs", "costs"))), key=lambda r: r[0])
        i, j = fixed.get((t.column("chunk")[0].as_py(), t.column("source")[0].as_py()), (None, None))
        out = []
        starts = [k for k in range(len(rows)) if not k or rows[k][0] != rows[k - 1][0] + 1]  # two stretches: one at either end
        for a, z in zip(starts, starts[1:] + [len(rows)]):
            part = rows[a:z]
            cands = [list(zip(*r[3:])) for r in part]
            # an end with a record of its own in the stretch is the chunk's end; a neighbour without one is inside
            first = i if len(cands[0]) > 1 else None
            last = j if len(cands[-1]) > 1 else None
            _, path = best_path(cands, first, last)
            out += [(r[1], r[2], c[k][1]) for r, c, k in zip(part, cands, path) if r[1] is not None and c[k][2] < CONTRADICTS]
        record, field, utc = zip(*out) if out else ((), (), ())
        return pa.table({"record": pa.array(record, pa.int64()), "field": pa.array(field, pa.string()), "utc_us": pa.array(utc, pa.int64())})

    waiting = chunks.where("kind = 2").groupBy("chunk", "source").applyInArrow(choose, "record long, field string, utc_us long")
    return chunks.where("kind = 0").select("record", "field", F.col("utc").alias("utc_us")).unionByName(waiting)
