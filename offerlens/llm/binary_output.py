"""Packed token-id output: best-fit-decreasing with a segment tree over the room that is left in bins.

Documents become ids with an end id; those longer than a sequence are cut without loss (the first piece may be shorter). Each
task packs its own rows first, so that most ids never travel: it gathers pieces up to BUFFER_TOKENS, packs, puts out full bins and
carries the pieces of underfull ones on to the next buffer. What stays underfull in a task is dealt anew into even groups of about
GROUP pieces, packed again, and so on, until one group is left, the bins are as few as their tokens allow, or a round saves no
bin: how few sequences there are does not depend on the number of input partitions.

A row is one sequence: the id row of the matrix (little-endian unsigned 32-bit, padded with the end id to the full width),
cumulative segment lengths (from 0 to the tokens in use), the places where positions start again from 0, and each segment's
document and piece.

Cases. Null and empty texts are just the end id; very long texts are cut into whole sequences. Repeated rows are packed each for
itself; a null doc_id stays null. An empty table gives no sequences. Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import durable, group_of_row, portions, text_column
from offerlens.llm.packing import CAPACITY, END_ID, cut
from offerlens.llm.tokens import encoder, tokenizer_path

#: Tokens a task gathers before it packs, and pieces of a group in later rounds (48 MB of ids at most).
BUFFER_TOKENS, GROUP = 1 << 21, 6000
SEQUENCES = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"
SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


class RoomTree:
    """Segment tree over room 0..capacity: leaves hold bins with that room, nodes how many there are below."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1 - 1).bit_length()
        self.counts = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = self.width + room
        while at:
            self.counts[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) with the smallest room that is at least `least`; the bin leaves the tree."""
        counts, at = self.counts, self.width + least
        while not counts[at]:  # up until a subtree to the right has a bin
            while at > 1 and at & 1:
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.width
        while at:
            counts[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of item numbers, items taken by falling length."""
    tree, bins = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = tree.take(lengths[item])
        room, number = got if got else (capacity, len(bins))
        if not got:
            bins.append([])
        bins[number].append(item)
        tree.add(room - lengths[item], number)
    return bins


def packed_rows(pieces: list[tuple[int, int, np.ndarray]], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple]]:
    """Rows of the full bins and of the others: tokens, ids, cumulative lengths, resets, documents, pieces."""
    full, rest = [], []
    for items in pack([len(p[2]) for p in pieces], capacity):
        own = [pieces[k] for k in items]
        n = sum(len(p[2]) for p in own)
        ids = np.full(capacity, END_ID, dtype="<u4")
        ids[:n] = np.concatenate([p[2] for p in own])
        edges = np.cumsum([0, *(len(p[2]) for p in own)]).tolist()
        (full if n == capacity else rest).append((n, ids.tobytes(), edges, edges[:-1], [p[0] for p in own], [p[1] for p in own]))
    return full, rest


def as_batch(number: int, rows: list[tuple], group: int | None = None) -> pa.RecordBatch:
    columns = [range(number, number + len(rows)), *(zip(*rows, strict=True) if rows else [()] * 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
    return batch if group is None else batch.append_column("_group", pa.array(np.full(len(rows), group, np.int64)))


def first_packing(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """SEQUENCES that each task makes of its own rows; ids count down from -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, size, waiting = encoder(path), -(((TaskContext.get().partitionId() + 1) << 33) - 1), 0, []

        def put(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            number += len(rows)
            return as_batch(number - len(rows), rows)

        for batch in portions(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(own.encode(text), np.uint32(END_ID))
                waiting += [(key, k, ids[a : a + n]) for k, (a, n) in enumerate(cut(len(ids), capacity))]
                size += len(ids)
                if size >= BUFFER_TOKENS:
                    full, rest = packed_rows(waiting, capacity)
                    yield put(full)
                    size = sum(r[0] for r in rest)
                    if size > BUFFER_TOKENS // 2:  # these fill no bins here: they wait for the next round, not in memory
                        yield put(rest)
                        rest, size = [], 0
                    waiting = [p for r in rest for p in pieces_of(r)]
        full, rest = packed_rows(waiting, capacity)
        yield put(full + rest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).mapInArrow(run, SEQUENCES)


def pieces_of(row: tuple) -> list[tuple[int, int, np.ndarray]]:
    _, ids, edges, _, docs, numbers = row
    ids = np.frombuffer(ids, dtype="<u4")
    return [(d, k, ids[a:b]) for d, k, a, b in zip(docs, numbers, edges, edges[1:], strict=False)]


def packed_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_size: int = GROUP) -> DataFrame:
    """SEQUENCES of all rows."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number = [], 0
        for batch in batches:
            pieces += [(d, k, np.frombuffer(x, dtype="<u4")) for d, k, x in zip(*(batch[c].to_pylist() for c in ("doc_id", "piece", "ids")), strict=True)]
            number = batch["_group"][0].as_py() if batch.num_rows else number
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        full, rest = packed_rows(pieces, capacity)
        yield as_batch(0, full + rest, number)

    columns = [f.name for f in SCHEMA]
    packed = durable(first_packing(docs, path or tokenizer_path(), capacity))
    under = F.col("n_tokens") < capacity
    done, rest, free = [packed.filter(~under)], packed.filter(under), 0
    while True:
        sums = rest.agg(F.count("*").alias("bins"), F.sum("n_tokens").alias("tokens"), F.sum(F.size("pieces")).alias("pieces")).first()
        if sums["bins"] <= max(1, -(-(sums["tokens"] or 0) // capacity)):  # as few as can be
            break
        groups = max(1, -(-sums["pieces"] // group_size))
        parts = F.transform("pieces", lambda k, i: F.struct(F.element_at("doc_ids", i + 1).alias("doc_id"), k.alias("piece"), (4 * F.element_at("cu_seqlens", i + 1)).alias("a"), (4 * F.element_at("cu_seqlens", i + 2)).alias("b")))
        pieces = rest.select("ids", F.explode(parts).alias("p")).select("p.doc_id", "p.piece", F.substring("ids", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")).alias("ids"))
        dealt = pieces.withColumn("_group", group_of_row(groups).cast("long"))
        placed = durable(dealt.repartitionById(groups, F.col("_group").cast("int")).mapInArrow(again, SEQUENCES + ", _group long"))  # a task a group
        got = placed.agg(F.count("*").alias("bins"), (F.max("sequence_id") + 1).alias("span")).first()
        if got["bins"] >= sums["bins"]:  # nothing saved: the bins stay as they were
            break
        named = placed.withColumn("sequence_id", free + F.col("_group") * got["span"] + F.col("sequence_id")).select(*columns)
        free += groups * got["span"]
        done.append(named.filter(~under))
        rest = named.filter(under)
        if groups == 1:
            break
    every = rest
    for part in done:
        every = every.unionByName(part)
    return every


def write_packed(docs: DataFrame, out: str, path: str | None = None, capacity: int = CAPACITY) -> None:
    """Writes the sequences as Parquet, one file a task; a task that is lost is written again by Spark's committer."""
    packed_sequences(docs, path, capacity).write.parquet(out)


def read_matrix(rows: DataFrame, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(sequence_id, ids, positions) of each row, as a training loader reads them; rows stream to the caller."""
    for r in rows.toLocalIterator():
        ids = np.frombuffer(r["ids"], dtype="<u4")
        positions = np.arange(capacity)
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            positions[a:b] -= a
        yield r["sequence_id"], ids, positions
