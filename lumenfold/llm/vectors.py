"""Shared by problems 1 and 5: usable vectors, their packing, and cells of reduced vectors around pivots.

Vectors travel as bytes in the narrowest of half, single and double precision that holds their
values exactly.  For the search they are turned, or reduced, to their leading directions, which a bounded sample gives; the space is cut
into the cells of pivots, which are drawn from the data by hash order and so follow its density, and a vector goes to its
nearest cells (overlapping margins).  What is similar is decided by the whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most pivots ever drawn, and rows aimed at in a cell (before overlap).
MAX_PIVOTS, CELL_ROWS = 65_536, 700
#: Directions kept, and vectors drawn to find them.
REDUCED, SAMPLE = 24, 4096
#: Pivots beyond this number are reached through pivots of their own; cells with more rows are cut again by pivots of their own.
FLAT_PIVOTS, CROWDED_ROWS = 4096, 12_000
#: Bytes of vectors aimed at in a partition of cells.
PARTITION_BYTES = 8_000_000
_BY_BYTES = {2: np.float16, 4: np.float32, 8: np.float64}


def pack_rows(m: np.ndarray) -> list[bytes]:
    """Bytes of each row of a double matrix in the narrowest lossless precision."""
    with np.errstate(over="ignore"):
        half, single = m.astype(np.float16), m.astype(np.float32)
    as_half = (half.astype(np.float64) == m).all(1)
    as_single = (single.astype(np.float64) == m).all(1)
    return [(half[i] if as_half[i] else single[i] if as_single[i] else m[i]).tobytes() for i in range(len(m))]


def unpack_rows(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    sizes = np.fromiter(map(len, packed), int, len(packed)) // dim
    for width, kind in _BY_BYTES.items():
        at = np.flatnonzero(sizes == width)
        if len(at):
            out[at] = np.frombuffer(b"".join([packed[i] for i in at]), kind).reshape(len(at), dim)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # keeps tiny and huge values within range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def usable_matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the list entries with ``dim`` finite numbers that are not all 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim))
    flat = col.take(pa.array(at)).flatten().cast(pa.float64())
    m = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return at[ok], m[ok]


def direction_numbers(u: np.ndarray) -> np.ndarray:
    """A 64-bit number of each unit row's direction, rounded to six digits: scaled copies share it."""
    rng = np.random.default_rng(17)
    x = np.rint(u * 1e6).astype(np.int64).astype(np.uint64)
    a, b = rng.integers(1, 2**63, (2, u.shape[1]), np.uint64) * np.uint64(2) + np.uint64(1)
    h, k = (x * a).sum(1, dtype=np.uint64), (x * b).sum(1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    k ^= k >> np.uint64(29)
    h = h * np.uint64(0x9E3779B97F4A7C15) ^ k * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def packed(df: DataFrame, id_col: str, fields: dict[str, int]) -> DataFrame:
    """``field`` (position in ``fields``), ``id``, ``vec``, ``vh`` (number of its direction): the usable vectors of each row.

    Null ids and unusable vectors (null, wrong length, null or non-finite entry, all zero) are left out.
    """
    names = list(fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, (_, dim) in enumerate(names):
                at, m = usable_matrix(b.column(no + 1), dim)
                if len(at):
                    cols = [pa.array(np.full(len(at), no, np.int32)), b.column(0).take(pa.array(at)), pa.array(pack_rows(m), pa.binary()), pa.array(direction_numbers(unit_rows(m)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["field", "id", "vec", "vh"])

    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *fields)
    return src.mapInArrow(run, "field int, id string, vec binary, vh long")


def usable(vec_col: str, dim: int) -> Column:
    """Condition of ``usable_matrix`` as a column."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _nearest(z: np.ndarray, piv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest pivots of each row, nearest first, and their distances (squared, less the row's own square)."""
    k = min(k, len(piv))
    out, far = np.empty((len(z), k), np.int32), np.empty((len(z), k), np.float32)
    half = (piv * piv).sum(1)
    for s in range(0, len(z), 2048):
        d = half - 2 * (z[s : s + 2048] @ piv.T)
        top = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(piv) else np.tile(np.arange(len(piv)), (len(d), 1))
        at = np.take_along_axis(d, top, 1)
        order = np.argsort(at, axis=1, kind="stable")
        out[s : s + 2048], far[s : s + 2048] = np.take_along_axis(top, order, 1), np.take_along_axis(at, order, 1)
    return out, far


class Cells:
    """Cells of reduced vectors around pivots; ``total`` is the number of rows they were made for."""

    def __init__(self, u: np.ndarray, want: int, total: int = 0, reduced: int = REDUCED):
        """``u``: sampled unit rows; directions come from the first SAMPLE of them, pivots are the first ``want`` distinct ones."""
        some = u[:SAMPLE].astype(np.float64)
        self.total, self.dim = total, u.shape[1]
        self.mean = some.mean(0) if len(some) else np.zeros(self.dim)
        _, v = np.linalg.eigh((some - self.mean).T @ (some - self.mean))
        self.basis = np.ascontiguousarray(v[:, ::-1][:, :reduced]).astype(np.float32)
        self.mean = self.mean.astype(np.float32)
        z = self.reduce(u)
        _, first = np.unique(np.round(z, 6), axis=0, return_index=True)
        self.pivots = z[np.sort(first)][:want]
        self.upper = None
        if len(self.pivots) > FLAT_PIVOTS:
            # a second level: every pivot hangs on its nearest of about a root's number of them
            n = int(2 * len(self.pivots) ** 0.5)
            self.upper = self.pivots[:n]
            owner = _nearest(self.pivots, self.upper, 1)[0][:, 0]
            order = np.argsort(owner, kind="stable")
            self.below = np.split(order, np.searchsorted(owner[order], np.arange(1, n)))

    def __len__(self) -> int:
        return len(self.pivots)

    def reduce(self, u: np.ndarray) -> np.ndarray:
        return (u.astype(np.float32) - self.mean) @ self.basis

    def nearest(self, u: np.ndarray, overlap: int) -> np.ndarray:
        """The ``overlap`` nearest cells of each unit row, nearest first; with many pivots looked for below the 8 nearest of the upper level."""
        z = self.reduce(u)
        if self.upper is None:
            return _nearest(z, self.pivots, overlap)[0]
        ups = _nearest(z, self.upper, 8)[0]
        found, far = np.full((len(z), 8 * overlap), -1, np.int32), np.full((len(z), 8 * overlap), np.inf, np.float32)
        for up in np.unique(ups):
            below = self.below[up]
            if not len(below):
                continue
            at, slot = np.nonzero(ups == up)
            near, d = _nearest(z[at], self.pivots[below], overlap)
            for j in range(near.shape[1]):
                found[at, slot * overlap + j], far[at, slot * overlap + j] = below[near[:, j]], d[:, j]
        order = np.argsort(far, axis=1, kind="stable")[:, :overlap]
        return np.take_along_axis(found, order, 1)


def fit_cells(df: DataFrame, id_col: str, vec_col: str, dim: int, cell_rows: int = CELL_ROWS, reduced: int = REDUCED, seed: int = 7) -> Cells | None:
    """Cells for about ``cell_rows`` usable vectors each; None where there is no usable vector.

    Directions and pivots come from a bounded sample, the usable vectors with the smallest id hashes (at most SAMPLE, or
    2 * MAX_PIVOTS, reach the driver); every vector is assigned afterwards.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    good = df.where(F.col(id_col).isNotNull() & usable(vec_col, dim)).select(h.alias("h"), F.col(vec_col).alias("v"))
    rows = good.count()
    if not rows:
        return None
    want = int(min(MAX_PIVOTS, max(1, round(rows / cell_rows))))
    draw = max(SAMPLE, 2 * want)
    share = min(1.0, 2 * draw / rows)  # thins the rows before they are ordered
    near = good.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    for drawn in (near, good):
        got = drawn.orderBy("h").limit(draw).select("v").toArrow()
        if got.num_rows:
            break
    _, m = usable_matrix(got.column(0), dim)
    return Cells(unit_rows(m), want, rows, reduced)


def partitions(cells: list[Cells], overlap: int, least: int) -> int:
    """Partitions of the cells' rows by their bytes (as single precision), at least ``least``."""
    return max(least, -(-sum(c.total * overlap * (4 * c.dim + 40) for c in cells) // PARTITION_BYTES))


def parts(u: np.ndarray, overlap: int, asks: int, cell_rows: int, reduced: int = REDUCED, crowded: int = CROWDED_ROWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, whether each asks) of a cell's parts: the cell itself, or cells within it where it is crowded.

    A row lies in its ``overlap`` nearest parts and asks in the ``asks`` nearest.  Rows that no pivots part stay together.
    """
    n = len(u)
    if n <= crowded:
        return [(np.arange(n), np.ones(n, bool))]
    inner = Cells(u[np.random.default_rng(n).permutation(n)[: max(SAMPLE, 2 * (n // cell_rows))]], n // cell_rows, n, reduced)
    near = inner.nearest(u, overlap)
    out = []
    for c in range(len(inner)):
        at, rank = np.nonzero(near == c)
        if len(at) == n:
            return [(np.arange(n), np.ones(n, bool))]
        if len(at):
            for rows, own in parts(u[at], overlap, asks, cell_rows, reduced, crowded):
                out.append((at[rows], own & (rank[rows] < asks)))
    return out
