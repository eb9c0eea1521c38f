"""Embedding whitening by matrix-free block Lanczos.

Entries become whole numbers, x = floor(SCALE * c) + SHIFT. Rows are packed into blocks once; every pass over them is a Spark job
whose tasks each put out one small partial sum. The first pass gives n and the sums S of each dimension. The covariance V is never
formed: a pass takes BLOCK vectors Q, and its tasks sum up X'(XQ) over their rows X, centred as (n * x - S) / n in whole numbers
before they are multiplied.

The driver holds the basis (a vector a dimension long for each Krylov direction, at most as many as there are dimensions), makes
each new block orthogonal to all of it, twice, and takes Ritz pairs of the whole basis with true residuals. Directions that vanish
(breakdown: the Krylov space is invariant) are replaced by random ones orthogonal to the basis. When the residuals of all wanted
pairs are below TOLERANCE of the greatest eigenvalue, one random block is added as a guard: only if it brings nothing new, the
pairs are final. A basis of all dimensions is exact.

The trace is the sum of squared deviations over n, of the same passes; shares are e / trace. A last pass measures the covariance
of the whitened vectors against the identity.

Cases. Rows whose vector is null or has a null or non-finite entry take no part, nor do those with an entry of over LIMIT / SCALE,
for which x is not exact. Shorter vectors count as followed by zeros. Repeated rows count each for itself; null vec_ids stay null.
Components without variance (below RANK of the greatest; all of them, if there is one row or all are equal) can't be whitened and
have no rows. Components of equal eigenvalues are any orthonormal pair, the same for all rows. A deviation beyond 64 bits is given
as the greatest long. An empty table gives an empty result. Columns beyond vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import durable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors of a Lanczos block, rows of a packed block, the greatest floor(SCALE * c) that is taken.
BLOCK, ROWS, LIMIT = 8, 2048, 1 << 50
#: Of the greatest eigenvalue: residuals that count as none, directions that count as vanished, eigenvalues that count as zero.
TOLERANCE, VANISHED, RANK = 1e-13, 1e-11, 1e-10
#: Steps without a smaller residual after which rounding is what is left.
STALLED = 3
NO_ID = LONG = (1 << 63) - 1
SAFE = 1 << 62

PACKED = "n int, width int, ids binary, x binary"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the floored entries, of the rows that take part."""
    v = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LIMIT / SCALE))
    rows = vectors.filter(F.col("embedding").isNotNull() & sound)
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED blocks of (vec_id, v), as wide as their longest vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            width = int(lengths.max())
            x = np.full((len(lengths), width), SHIFT, np.int64)
            x[np.arange(width) < lengths[:, None]] += lists.flatten().to_numpy()
            ids = part.column(0).to_numpy().astype("<i8").tobytes()
            columns = [pa.array([len(lengths)], pa.int32()), pa.array([width], pa.int32()), pa.array([ids], pa.binary()), pa.array([x.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["n", "width", "ids", "x"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and x (rows by dimensions) of each packed block."""
    for batch in batches:
        for n, width, ids, x in zip(*(batch.column(c) for c in ("n", "width", "ids", "x")), strict=True):
            yield np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "<i8").reshape(n.as_py(), width.as_py())


def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, n, s) of the task: rows that have a dimension and the sum of its x; pos -1 counts all rows."""
    n, s = [0], [0]
    for _, x in blocks_of(batches):
        own = x.sum(axis=0).tolist()  # LIMIT * ROWS fits 64 bits
        more = len(own) + 1 - len(s)
        n, s = n + [0] * more, s + [0] * more
        n[0] += len(x)
        for k, value in enumerate(own, 1):
            n[k] += len(x)
            s[k] += value
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(s) - 1), pa.int32()), pa.array(n, pa.int64()), pa.array([*map(Decimal, s)], pa.decimal128(38, 0))], ["pos", "n", "s"])


class Centre:
    """n and the exact sums of all dimensions."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where they suffice, else whole numbers of any size."""
        x = np.pad(x, ((0, 0), (0, len(self.sums) - x.shape[1])), constant_values=SHIFT)
        if 2 * self.n * max(int(np.abs(x).max(initial=1)), max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) < SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)

    @staticmethod
    def deviations(d: np.ndarray) -> np.ndarray:
        """Exact sums of squares of the differences, as longs."""
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < SAFE:
            return (d * d).sum(axis=1)
        return np.array([min(sum(int(v) ** 2 for v in row), LONG) for row in d.tolist()], np.int64)


def summed(blocks: DataFrame, task: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of task(x) over all blocks, an array of `size` doubles: a partial sum a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in blocks_of(batches):
            total += task(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["pos", "value"])

    rows = blocks.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()  # `size` rows
    out = np.zeros(size)
    for pos, value in rows:
        out[pos] = value
    return out


def orthonormal(vectors: np.ndarray, basis: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Unit vectors that span what the vectors have beyond the basis and each other; and how many of the vectors vanished."""
    out, gone = np.zeros((len(basis), 0)), 0
    for k in range(vectors.shape[1]):
        v = vectors[:, k]
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
        size = np.linalg.norm(v)
        if size <= least:
            gone += 1
            continue
        v = v / size
        v = v - basis @ (basis.T @ v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out, gone


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` greatest eigenvalues, falling, their unit eigenvectors as columns, and the passes it took; product(Q) is VQ."""
    wanted = min(wanted, dimensions)
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((dimensions, 0)), np.zeros((dimensions, 0))
    new, _ = orthonormal(rng.standard_normal((dimensions, min(block, dimensions))), basis, 0.0)
    passes, best, stalled, guarded, known = 0, np.inf, 0, False, None
    while True:
        image = product(new)
        passes += 1
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        inner = basis.T @ images
        values, ritz = np.linalg.eigh((inner + inner.T) / 2)
        values, ritz = values[::-1][:wanted], ritz[:, ::-1][:, :wanted]
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        vectors = basis @ ritz
        whole = basis.shape[1] >= dimensions
        worst = float(np.linalg.norm(images @ ritz - vectors * values, axis=0).max()) / scale
        stalled = 0 if worst < 0.9 * best else stalled + 1
        best = min(best, worst)
        small = len(values) == wanted and (worst <= TOLERANCE or (stalled >= STALLED and worst <= 1e3 * TOLERANCE))
        if whole or (small and guarded and np.abs(values - known).max() <= 10 * TOLERANCE * scale):
            return values, vectors, passes
        size = min(block, dimensions - basis.shape[1])
        guarded, known = small, values
        if small:  # the guard: another start for what this Krylov space may not hold
            new = np.zeros((dimensions, 0))
        else:
            new, _ = orthonormal(image, basis, VANISHED * scale)
            new = new[:, :size]
        while new.shape[1] < size:  # breakdown or guard: random directions take the place of vanished ones
            more, _ = orthonormal(rng.standard_normal((dimensions, size - new.shape[1])), np.column_stack([basis, new]), VANISHED)
            new = np.column_stack([new, more])


def whiten(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """WHITENED rows: each row's coordinate on each component, over the component's standard deviation."""
    spark = vectors.sparkSession
    blocks = durable(usable(vectors).mapInArrow(pack, PACKED))
    sums = {r["pos"]: (r["n"], int(r["s"])) for r in blocks.mapInArrow(column_sums, "pos int, n long, s decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # a row a dimension
    n, _ = sums.pop(-1, (0, 0))
    dimensions = len(sums)
    if not n or not dimensions:
        return spark.createDataFrame([], WHITENED)
    centre = Centre(n, [sums[k][1] + SHIFT * (n - sums[k][0]) for k in range(dimensions)])
    trace = 0.0

    def product(q: np.ndarray) -> np.ndarray:
        """VQ; and the trace, from the same rows."""
        nonlocal trace

        def task(x: np.ndarray) -> np.ndarray:
            c = centre.of(x)
            return np.append(c.T @ (c @ q), (c * c).sum())

        got = summed(blocks, task, q.size + 1) / n
        trace = float(got[-1])
        return got[:-1].reshape(q.shape)

    values, axes, _ = block_lanczos(product, dimensions, components, block)
    some = values > RANK * max(float(values[0]), 0.0)
    values, axes = values[some], axes[:, some]
    k = len(values)
    if not k:
        return spark.createDataFrame([], WHITENED)
    scaled = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.of(x) @ scaled
        return np.append(w.sum(axis=0), w.T @ w)

    got = summed(blocks, moments, k + k * k) / n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    share = values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks_of(batches):
            d = centre.differences(x)
            w = (d / n).astype(np.float64) @ scaled
            each = np.repeat(np.arange(len(ids)), k)
            columns = [ids[each], np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids)), np.full(len(each), n), centre.deviations(d)[each], w.ravel(), np.tile(share, len(ids)), np.full(len(each), error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in WHITENED.split(", ")])

    return blocks.mapInArrow(rows, WHITENED).withColumn("vec_id", F.nullif("vec_id", F.lit(NO_ID)))
