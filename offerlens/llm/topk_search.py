"""Exact top-k by integer inner product: columnar branch-and-bound.

Vectors become whole numbers, floor(SCALE * x). Candidates lie in blocks in vertical layout (a row a dimension), made of vectors
of like norm. Queries lie in groups of about QUERY_GROUP, as large as a task can hold. A task gets one query group and a slice of
the candidate blocks: the queries stay, the blocks stream past them by falling norm, and each query carries its k best scores
from block to block. So a candidate travels once for each query group, not once for each query block.

In a block, scores accumulate dimension block by dimension block; the mass that remains (the product of the norms of the
dimensions to come) bounds a candidate's score from both sides. Candidates whose upper bound is below the k-th best score so
far, or below the k-th best lower bound of the block, are compacted away; a block whose greatest norm can't reach a query's k-th
best score is skipped by it. Survivors are scored in whole numbers.

Exactness. Components are whole doubles. If the product of two norms is below 2**62 no partial sum leaves 64 bits; other pairs are
scored in whole numbers of any size, and ranked by them; a score beyond 64 bits is given as the nearest long.

Cases. Null vectors, and those with a null, NaN or infinite component (after scaling, too), take no part. Shorter vectors count
as followed by zeros. Ties go to the smaller vec_id, a null id last. A query never meets its own row; other rows that bear its
id are candidates, and repeated query rows are answered each for itself. With fewer than k other rows all are returned. An
empty table gives an empty result. Columns beyond vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import durable, partitions_for

SCALE, QUERY_STEP, K = 256, 50, 5
CANDIDATE_BLOCK, QUERY_BLOCK, DIMENSIONS = 4096, 256, 16
#: Queries that stay in a task while candidates stream, about, and candidate blocks of a slice at most, about.
QUERY_GROUP, SLICE_BLOCKS = 1 << 15, 256
#: Query blocks a task makes, about: enough that most are full, few enough that tasks grow in number with the queries.
BLOCKS_A_TASK = 64
#: Below this product of norms all sums of products fit 64 bits.
SAFE = 2.0**62
NO_ID = LONG = (1 << 63) - 1

BLOCKS = "block long, n int, width int, norm double, row_ids binary, ids binary, columns binary"
FOUND = "query_row long, query_id long, vec_id long, score long, digits string"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v (components times scale, not yet floored) and the squared norm of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & finite).withColumn("mass", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def block_maker(size: int):
    """mapInArrow function over (row, vec_id, v) to BLOCKS; a block's number is unique over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                width = int(lengths.max())
                columns = np.zeros((width, len(lengths)))
                inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                columns[inside, np.repeat(np.arange(len(lengths)), lengths)] = np.floor(lists.flatten().to_numpy())
                norm = float(norms(columns).max())
                rows, ids = (part.column(k).to_numpy().astype("<i8").tobytes() for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(lengths)], pa.int32()), pa.array([width], pa.int32()), pa.array([norm]), *(pa.array([x]) for x in (rows, ids, columns.tobytes()))], [c.split()[0] for c in BLOCKS.split(", ")])
                number += 1

    return run


def norms(columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((columns * columns).sum(axis=0))


class Block:
    """Vectors in vertical layout: rows, ids, columns (dimensions by vectors) and `rest`, the norms of the dimensions from each edge on."""

    def __init__(self, n: int, width: int, rows: bytes, ids: bytes, columns: bytes):
        self.rows, self.ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.columns = np.frombuffer(columns, "<f8").reshape(width, n)
        self.edges = [*range(0, width, DIMENSIONS), width]
        with np.errstate(over="ignore"):
            parts = np.array([(self.columns[a:b] ** 2).sum(axis=0) for a, b in zip(self.edges, self.edges[1:], strict=False)]).reshape(-1, n)
        self.rest = np.sqrt(np.vstack([np.cumsum(parts[::-1], axis=0)[::-1], np.zeros((1, n))]))

    def norms_from(self, dimension: int) -> np.ndarray:
        """Norms of the dimensions from an edge on; beyond the last there are none."""
        return self.rest[min(dimension // DIMENSIONS, len(self.rest) - 1)] if dimension < len(self.columns) else np.zeros(len(self.ids))


def exact_score(q: np.ndarray, c: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(q.tolist(), c.tolist(), strict=False))


class Best:
    """The k best so far of each query of a block, as (-score, id) in ascending order."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)  # the k-th best score

    def meet(self, c: Block) -> None:
        q, k = self.queries, self.k
        width = min(len(q.columns), len(c.columns))  # what one side lacks counts as zeros
        edges = [*range(0, width, DIMENSIONS), width]
        q_norm, c_norm = q.norms_from(0), c.norms_from(0)
        greatest = float(c_norm.max())
        opening = q.columns[: edges[1]].T @ c.columns[: edges[1]] if width else np.zeros((len(q.ids), len(c.ids)))
        rest = [(q.norms_from(e), c.norms_from(e)) for e in edges]
        for n in range(len(q.ids)):
            bound = float(q_norm[n]) * greatest
            if bound * (1 + 1e-9) + 1 < self.least[n]:
                continue
            alive = np.flatnonzero(c.rows != q.rows[n])
            if width and bound < 1e300:  # beyond, bounds in doubles say nothing
                partial = opening[n, alive]
                slack = 1e-9 * (q_norm[n] * c_norm[alive] + 1)
                for b in range(1, len(edges)):
                    mass = rest[b][0][n] * rest[b][1][alive] + slack
                    floor = self.least[n]
                    if len(alive) > k:
                        floor = max(floor, np.partition(partial - mass, len(alive) - k)[len(alive) - k])
                    stay = partial + mass >= floor
                    if not stay.all():
                        alive, partial, slack = alive[stay], partial[stay], slack[stay]
                    if not len(alive):
                        break
                    if b < len(edges) - 1:
                        partial = partial + q.columns[edges[b] : edges[b + 1], n] @ c.columns[edges[b] : edges[b + 1]][:, alive]
            if not len(alive):
                continue
            if bound < SAFE:
                score = q.columns[:width, n].astype(np.int64) @ c.columns[:width, alive].astype(np.int64)
                order = np.lexsort((c.ids[alive], -score))[:k]
                new = [(-int(score[x]), int(c.ids[alive[x]])) for x in order]
            else:
                new = [(-exact_score(q.columns[:width, n], c.columns[:width, x]), int(c.ids[x])) for x in alive.tolist()]
            own = self.found[n] = sorted(self.found[n] + new)[:k]
            if len(own) == k:
                self.least[n] = float(-own[-1][0]) if abs(own[-1][0]) < 1e300 else -np.inf

    def rows(self) -> list[tuple[int, int, int, int, str]]:
        return [(int(self.queries.rows[n]), int(self.queries.ids[n]), c, max(min(-s, LONG), -LONG - 1), digits(-s)) for n, own in enumerate(self.found) for s, c in own]


def digits(score: int) -> str:
    """The number as text that sorts as the number does."""
    text = str(abs(score))
    if score >= 0:
        return f"1{len(text):03d}{text}"
    return "0" + f"{len(text):03d}{text}".translate(str.maketrans("0123456789", "9876543210")) + "~"


def searcher(k: int):
    """mapInArrow function over (part, is_candidate, *BLOCKS), a part's queries before its candidates, to FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def put() -> pa.RecordBatch:
            rows = [r for b in held for r in b.rows()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], [c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["part"] != part:
                    if held:
                        yield put()
                    part, held = row["part"], []
                block = Block(row["n"], row["width"], row["row_ids"], row["ids"], row["columns"])
                if row["is_candidate"]:
                    for best in held:
                        best.meet(block)
                else:
                    held.append(Best(block, k))
        if held:
            yield put()

    return run


def search(vectors: DataFrame, step: int = QUERY_STEP, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best."""
    rows = durable(scaled(vectors, scale))
    blocks = durable(rows.sortWithinPartitions(F.desc("mass")).select("row", "vec_id", "v").mapInArrow(block_maker(CANDIDATE_BLOCK), BLOCKS))
    queries = rows.filter((F.col("vec_id") % step == 0) & (F.col("vec_id") != NO_ID)).select("row", "vec_id", "v")
    tasks = max(1, queries.count() // (QUERY_BLOCK * BLOCKS_A_TASK))
    asked = durable(queries.coalesce(tasks).mapInArrow(block_maker(QUERY_BLOCK), BLOCKS))
    groups = max(1, -(-asked.count() // (QUERY_GROUP // QUERY_BLOCK)))
    n = blocks.count()
    slices = max(1, min(n, max(-(-partitions_for(vectors) // groups), -(-n // SLICE_BLOCKS))))
    dealt = lambda count: F.pmod(F.xxhash64("block"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # each query group meets each slice: the stated query set against all rows, in blocks
    stay = asked.withColumn("slice", every(slices)).select((dealt(groups) * slices + F.col("slice")).cast("int").alias("part"), F.lit(False).alias("is_candidate"), *blocks.columns)
    stream = blocks.withColumn("group", every(groups)).select((F.col("group") * slices + dealt(slices)).cast("int").alias("part"), F.lit(True).alias("is_candidate"), *blocks.columns)
    met = stay.unionByName(stream).repartitionById(groups * slices, F.col("part")).sortWithinPartitions("part", "is_candidate", F.desc("norm"))
    found = met.mapInArrow(searcher(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("digits"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
