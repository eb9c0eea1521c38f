"""Packing documents into as few sequences as possible: best fit, then a swap-based local search.

Tokens. A document is its ids followed by the end id; only documents longer than a sequence are cut, into whole sequences
with the shorter piece first. Tokenising happens once, in the scan's tasks; what travels on are a piece's length and place.

Packing. Pieces as long as a sequence fill one each and take no part. The others are dealt evenly into groups of about GROUP
pieces. A task packs its group best-fit-decreasing and then empties bins: from the emptiest underfull bin, documents move to
other underfull bins, or are exchanged one for one or two for one against smaller ones there; all underfull bins of the group are
looked at, every accepted step raises the sum of squared fills, and it goes on until bins are empty or nothing fits.

Rounds. Bins that stay underfull go back, and their pieces are dealt anew into fewer groups. That ends when one group is left,
when the underfull bins are as few as their tokens allow, when a round over all of them saves no bin (then they stay as they
were), or when it saves fewer than one in LEAST_GAIN, so that less than that share of the bins is given away for a bounded number of passes.

Cases. Null and empty texts are just the end id; a very long text is cut into whole sequences. Repeated rows are packed each for
itself. A null doc_id stays null. An empty table gives no sequences. Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import durable, group_of_row, portions, text_column
from offerlens.llm.tokens import encoder, tokenizer_path

CAPACITY, END_ID = 2048, 0
#: Pieces a task packs at once; a round that saves fewer than one underfull bin in LEAST_GAIN is the last.
GROUP, LEAST_GAIN = 6000, 10_000

#: Stands for a null doc_id until the result.
NO_ID = (1 << 63) - 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", _group long, bin long, offset long, underfull boolean"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in portions(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(own.encode(text), np.uint32(END_ID)).astype("<u4")
                out += [(key, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(key, text_column(docs)).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit-decreasing; bins as lists of item numbers."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    open_rooms = 0  # bit r is set if some bin has r left
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[item]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


class Exchanges:
    """What underfull bins may give back for a piece or two: nothing, one of their pieces, or two. Flat arrays with a row for each
    choice: `back` its tokens, `room` what is left in its bin, `bin`. A bin that changes gets new rows at the end."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
        self.rows: list[slice] = [slice(0, 0)] * len(bins)
        self.n = 0
        self.back, self.room, self.bin, self.kind = (np.zeros(64, np.int64) for _ in range(4))
        for k in range(len(bins)):
            self.put(k)

    def put(self, k: int) -> None:
        """Rows of bin k as it is now; none if it is full or empty."""
        self.room[self.rows[k]] = 0  # no piece fits what is left there: the old rows are dead
        self.rows[k] = slice(0, 0)
        if not self.bins[k] or self.fill[k] >= self.capacity:
            return
        own = self.lengths[self.bins[k]]
        kinds = np.unique(own)
        i, j = np.triu_indices(len(kinds), 1)
        twice = np.flatnonzero(np.bincount(np.searchsorted(kinds, own)) > 1)
        back = np.concatenate([[0], kinds, kinds[i] + kinds[j], 2 * kinds[twice]])
        if self.n + len(back) > len(self.back):
            alive = np.flatnonzero(self.room[: self.n] > 0)  # dead rows go first
            place = np.cumsum(np.concatenate([[0], self.room[: self.n] > 0]))
            self.rows = [slice(int(place[r.start]), int(place[r.stop])) for r in self.rows]
            room = max(64, 2 * (len(alive) + len(back)))
            self.back, self.room, self.bin, self.kind = (np.concatenate([x[alive], np.zeros(room, np.int64)]) for x in (self.back, self.room, self.bin, self.kind))
            self.n = len(alive)
        self.rows[k] = slice(self.n, self.n + len(back))
        self.n += len(back)
        self.back[self.rows[k]], self.room[self.rows[k]], self.bin[self.rows[k]] = back, self.capacity - self.fill[k], k
        self.kind[self.rows[k]] = np.repeat([0, 1, 2], [1, len(kinds), len(back) - 1 - len(kinds)])

    def best(self, source: int) -> tuple[int, int, int, int]:
        """(gain, tokens out, tokens back, target) of the exchange that moves most tokens away from source into a bin at least as full."""
        own = self.lengths[self.bins[source]]
        kinds = np.unique(own)
        i, j = np.triu_indices(len(kinds), 1)
        twice = np.flatnonzero(np.bincount(np.searchsorted(kinds, own)) > 1)
        doubles = np.unique(np.concatenate([kinds[i] + kinds[j], 2 * kinds[twice]]))
        back, room, target, kind = (x[: self.n] for x in (self.back, self.room, self.bin, self.kind))
        open_rows = (room > 0) & (self.fill[target] >= self.fill[source]) & (target != source)
        found = (0, 0, 0, -1)
        for outs, most in ((kinds, 2), (doubles, 1)):  # a move, one for one, one for two; two moves at once, two for one
            if not len(outs):
                continue
            rows = np.flatnonzero(open_rows & (kind <= most))
            out = outs[np.maximum(np.searchsorted(outs, back[rows] + room[rows], "right") - 1, 0)]
            gain = out - back[rows]
            gain[gain > room[rows]] = 0
            k = int(np.argmax(gain)) if len(gain) else -1
            if k >= 0 and gain[k] > found[0]:
                found = (int(gain[k]), int(out[k]), int(back[rows[k]]), int(target[rows[k]]))
        return found

    def take(self, k: int, tokens: int) -> list[int]:
        """One or two pieces of bin k with so many tokens together (none for 0); they leave the bin."""
        if not tokens:
            return []
        first: dict[int, int] = {}
        for x in self.bins[k]:
            n = int(self.lengths[x])
            got = [x] if n == tokens else [first[tokens - n], x] if tokens - n in first else None
            if got:
                break
            first[n] = x
        self.bins[k] = [x for x in self.bins[k] if x not in got]
        return got

    def exchange(self, source: int, target: int, out: int, back: int) -> None:
        give, get = self.take(source, out), self.take(target, back)
        self.bins[source] += get
        self.bins[target] += give
        self.fill[source] += back - out
        self.fill[target] += out - back
        self.put(source)
        self.put(target)


def empty_bins(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Swap-based local search over all underfull bins, the emptiest first, each until it is empty or nothing fits."""
    sizes = np.array(lengths, dtype=np.int64)
    fill = [int(sizes[b].sum()) for b in bins]
    full = [b for b, n in zip(bins, fill, strict=True) if n >= capacity]
    under = [b for b, n in zip(bins, fill, strict=True) if n < capacity]
    own = Exchanges(under, sizes, capacity)
    for source in np.argsort(own.fill, kind="stable").tolist():
        while under[source]:
            gain, out, back, target = own.best(source)
            if gain <= 0:
                break
            own.exchange(source, target, out, back)
    return full + [b for b in under if b]


def pack_group(group: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """bin (from 0), offset and underfull for the pieces of one group."""
    group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = group["length"].tolist()
    bins = empty_bins(best_fit(lengths, capacity), lengths, capacity)
    number, offset, under = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), bool)
    for b, items in enumerate(bins):
        at = 0
        for x in items:
            number[x], offset[x] = b, at
            at += lengths[x]
        under[items] = at < capacity
    return group.assign(bin=number, offset=offset, underfull=under)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a written table: it is read more than once."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    row = F.monotonically_increasing_id()  # over a written table: the same for each attempt of a task
    whole = pieces.filter(F.col("length") >= capacity)
    done = [whole.select(*columns, (-1 - row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]  # one each, counted down from -1
    first_free = 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches) or [pd.DataFrame()])
        if len(group):
            yield pack_group(group, capacity)

    rest, before = pieces.filter(F.col("length") < capacity), None
    n = rest.count()
    while n:
        groups = max(1, -(-n // group_size))
        dealt = rest.select(*columns, group_of_row(groups).cast("long").alias("_group"))
        placed = durable(dealt.repartitionById(groups, F.col("_group").cast("int")).mapInPandas(run, PLACED))  # a task a group
        of_bin, under = F.col("offset") == 0, F.col("underfull")
        sums = placed.agg(F.count_if(of_bin).alias("bins"), F.count_if(of_bin & under).alias("under"), F.count_if(under).alias("pieces"), F.sum(F.when(under, F.col("length"))).alias("tokens"), (F.max("bin") + 1).alias("span")).first()
        if before is not None and sums["bins"] >= before[1]:  # nothing saved: the last round's bins stay
            done.append(before[0])
            break
        little = before is not None and (before[1] - sums["bins"]) * LEAST_GAIN < before[1]
        named = placed.select(*columns, (first_free + F.col("_group") * sums["span"] + F.col("bin")).alias("sequence_id"), "offset", "underfull")
        first_free += groups * sums["span"]
        if little or groups == 1 or sums["under"] <= -(-(sums["tokens"] or 0) // capacity):  # one group, or as few bins as can be
            done.append(named.drop("underfull"))
            break
        done.append(named.filter("not underfull").drop("underfull"))
        left = named.filter("underfull").drop("underfull")
        rest, before, n = left.select(*columns), (left, sums["under"]), sums["pieces"]
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    return pack_pieces(durable(token_pieces(docs, path, capacity)), capacity)
