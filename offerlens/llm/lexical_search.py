"""Ranked lexical search: Block-Max WAND over segments of compressed posting blocks.

Terms are maximal runs of digits, ASCII letters (A to Z lower-cased) and characters beyond ASCII; they are found in the texts' UTF-8
bytes and named by a 64-bit hash of these.

Index. A task turns its documents into segments of about SEGMENT_TERMS terms, a row each: ids and lengths of the documents,
the ascending vocabulary, and for each term a posting list in blocks of POSTINGS. A block's header has its first and last
document; its body has gaps and frequencies of one, two or four bytes, whatever the list needs. When the corpus counts are known, a
second pass adds each block's maximum impact. Nothing is shuffled to build it, and no list is longer than a segment.

Search. A segment meets all items of an item block. The last documents of an item's blocks cut the segment into ranges in which
each list stands in one block; moving all pointers to a range reads headers only, and the sum of weight times maximum impact bounds
every score in it. Ranges below the threshold (the item's k-th best score so far) are left out. In the others the lists come in
falling order of their bound, as Block-Max WAND sorts them up to its pivot: while the lists to come can reach the threshold by
themselves, new documents may enter; behind that pivot a list's block is decompressed only if a document of the range, with what
it has and what the headers promise, still reaches the threshold. Every score that reaches it is complete and exact.

Items come in blocks of about ITEM_BYTES, a pass over the index each. One segment in SEED is searched first, for thresholds that
all others start with: a k-th best score of some documents never exceeds that of all.

Cases. Null and empty texts, and those without a term, count nowhere and are never found; an item without terms, or whose terms no
document has, has no rows. Very long texts are cut between terms. Repeated rows of either table count each for itself: a repeated
item_id has its ranks once for each of its rows. Null doc_ids come last among equal scores and stay null; null item_ids stay null.
Documents with a score of 0 are left out. An empty table gives an empty result. Columns beyond doc_id, item_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import U64, durable, forget, mix, portions, powers, text_column, trim

K = 20
#: Postings of a block; terms of a segment, about; bytes of text that are read at once; bytes of items that are searched at once.
POSTINGS, SEGMENT_TERMS, READ_BYTES, ITEM_BYTES = 128, 1 << 21, 1 << 21, 8 << 20
#: One segment in SEED gives the first thresholds; the share of an item's ranges, the best ones, that is searched before the others.
SEED, FIRST_SHARE = 16, 0.1
NO_ID = (1 << 63) - 1
#: What a byte of a text stands for: 0 between terms, else itself in lower case.
LETTERS = np.array([0 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 * (0x41 <= b <= 0x5A) for b in range(256)], np.uint8)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(5).integers(1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)

SEGMENT = "segment long, n_docs int, n_terms long, ids binary, lengths binary, terms binary, df binary, widths binary, first binary, last binary, gaps binary, tfs binary"
INDEX = SEGMENT + ", impacts binary"
FOUND = "item int, doc_id long, score long"


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins (with the end at the end)."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def term_hashes(data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all terms in order, and the number of the text each is in; some READ_BYTES of the texts at a time."""
    at, total = 0, int(begin[-1])
    while at < total:
        end = min(at + READ_BYTES, total)
        if end < total:
            end = cut(data, begin, at, end)
        code = LETTERS[data[at:end]]
        inside = code != 0
        edges = begin[np.searchsorted(begin, at, "right") : np.searchsorted(begin, end)] - at  # texts that begin behind `at`
        before = np.concatenate([[False], inside[:-1]])
        before[edges] = False
        behind = np.concatenate([inside[1:], [False]])
        behind[edges - 1] = False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_VALUES[code] * powers(BASE, len(code)))])
        hashes = mix((sums[stop] - sums[start]) * powers(INVERSE, len(code) + 1)[start] + (stop - start).astype(U64))
        yield hashes, np.searchsorted(begin, start + at, "right") - 1
        at = end


def cut(data: np.ndarray, begin: np.ndarray, at: int, end: int) -> int:
    """A place near `end` where no term is cut: behind a byte between terms, or where a text begins."""
    text = int(begin[np.searchsorted(begin, end, "right") - 1])
    low = max(at, text)
    between = np.flatnonzero(LETTERS[data[low:end]] == 0)
    if len(between):
        return low + int(between[-1]) + 1
    if text > at:
        return text
    stop = int(begin[np.searchsorted(begin, end)])  # a term longer than the reading: to its end
    while end < stop:
        between = np.flatnonzero(LETTERS[data[end : min(end + READ_BYTES, stop)]] == 0)
        if len(between):
            return end + int(between[0])
        end = min(end + READ_BYTES, stop)
    return stop


def narrow(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values of all lists in the least of 1, 2 or 4 bytes that a list's greatest value needs; and these widths."""
    most = np.maximum.reduceat(values, starts)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    each = np.repeat(width, sizes)
    place = np.cumsum(each) - each
    out = np.zeros(int(each.sum()), np.uint8)
    for w in (1, 2, 4):
        own = each == w
        out[place[own][:, None] + np.arange(w)] = values[own].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return out.tobytes(), width.astype(np.uint8)


class Postings:
    """Collects terms of documents and puts them out as a segment."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.n_docs = self.n_terms = 0

    def segment(self, number: int) -> pa.RecordBatch:
        ids, hashes, docs = np.concatenate(self.ids), np.concatenate(self.hashes), np.concatenate(self.docs)
        n_docs = self.n_docs
        self.clear()
        lengths = np.bincount(docs, minlength=n_docs)
        used = lengths > 0
        docs = (np.cumsum(used) - 1)[docs]  # documents with terms only
        ids, lengths = ids[used], lengths[used]
        terms, which = np.unique(hashes, return_inverse=True)
        del hashes
        key = (which << 32) | docs
        n_terms = len(key)
        key.sort()
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(begin, n_terms))
        key = key[begin]
        which, docs = key >> 32, key & 0xFFFFFFFF
        df = np.bincount(which, minlength=len(terms))
        starts = np.cumsum(df) - df
        n_blocks = -(-df // POSTINGS)
        of_block = np.repeat(np.arange(len(terms)), n_blocks)
        block = starts[of_block] + POSTINGS * (np.arange(len(of_block)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        gaps = np.diff(docs, prepend=0)
        gaps[block] = 0
        gap_bytes, gap_width = narrow(gaps, starts, df)
        tf_bytes, tf_width = narrow(tf, starts, df)
        last = np.minimum(block + POSTINGS, (starts + df)[of_block]) - 1
        binary = [ids.astype("<i8"), lengths.astype("<i8"), terms.astype("<u8"), df.astype("<u4"), np.column_stack([gap_width, tf_width]), docs[block].astype("<u4"), docs[last].astype("<u4")]
        columns = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([n_terms], pa.int64()), *(pa.array([b], pa.binary()) for b in (*(x.tobytes() for x in binary), gap_bytes, tf_bytes))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENT.split(", ")])


def make_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENT rows of (doc_id, text)."""
    number = TaskContext.get().partitionId() << 33
    held = Postings()
    for batch in portions(batches):
        data, begin = texts_of(batch.column(1))
        held.ids.append(batch.column(0).to_numpy())
        for hashes, doc in term_hashes(data, begin):
            held.hashes.append(hashes)
            held.docs.append(doc + held.n_docs)
            held.n_terms += len(hashes)
        held.n_docs += len(begin) - 1
        if held.n_terms >= SEGMENT_TERMS:
            yield held.segment(number)
            number += 1
    if held.n_terms:
        yield held.segment(number)
    trim()


class Counts:
    """Documents with terms, and their terms, of the whole corpus."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What a document's length adds to its terms' saturation."""
        return 100 - 25 + (25 * n * self.documents) // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Segment:
    """One segment of the index, its blocks decompressed on demand."""

    def __init__(self, row: dict, counts: Counts):
        self.ids, self.terms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["terms"], "<u8")
        self.m = counts.lengths(np.frombuffer(row["lengths"], "<i8"))
        self.df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        self.widths = np.frombuffer(row["widths"], np.uint8).reshape(-1, 2).astype(np.int64)
        self.first, self.last = np.frombuffer(row["first"], "<u4").astype(np.int64), np.frombuffer(row["last"], "<u4").astype(np.int64)
        n_blocks = -(-self.df // POSTINGS)
        self.blocks = np.concatenate([[0], np.cumsum(n_blocks)])
        self.places = np.concatenate([[[0, 0]], np.cumsum(self.widths * self.df[:, None], axis=0)])
        self.bodies = row["gaps"], row["tfs"]
        self.impacts = np.frombuffer(row["impacts"], "<u4").astype(np.int64) if row.get("impacts") is not None else None
        self.seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def read(self, t: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks of a list, ascending."""
        df, (gap_width, tf_width), (gap_at, tf_at) = int(self.df[t]), self.widths[t].tolist(), self.places[t].tolist()
        gaps = np.frombuffer(self.bodies[0], f"<u{gap_width}", df, gap_at)
        tfs = np.frombuffer(self.bodies[1], f"<u{tf_width}", df, tf_at)
        sizes = np.minimum(df - which * POSTINGS, POSTINGS)
        begin = np.cumsum(sizes) - sizes
        if len(which) * POSTINGS < df:
            at = np.arange(int(sizes.sum())) + np.repeat(which * POSTINGS - begin, sizes)
            gaps, tfs = gaps[at], tfs[at]
        sums = np.cumsum(gaps, dtype=np.int64)
        docs = sums + np.repeat(self.first[self.blocks[t] + which] - sums[begin], sizes)
        return docs, impact(tfs.astype(np.int64), self.m[docs])

    def postings(self, t: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `read`; a block is decompressed once for all items."""
        n = int(self.blocks[t + 1] - self.blocks[t])
        if t not in self.seen:
            self.seen[t] = np.zeros(n, bool), np.zeros(self.df[t], np.int32), np.zeros(self.df[t], np.int32)
        done, docs, impacts = self.seen[t]
        new = which[~done[which]]
        at = lambda blocks: slice(None) if len(blocks) == n else (np.arange(int((sizes := np.minimum(len(docs) - blocks * POSTINGS, POSTINGS)).sum())) + np.repeat(blocks * POSTINGS - (np.cumsum(sizes) - sizes), sizes))
        if len(new):
            where = at(new)
            docs[where], impacts[where] = self.read(t, new)
            done[new] = True
        where = at(which)
        return docs[where], impacts[where]

    def block_maxima(self) -> np.ndarray:
        """The maximum impact of every block."""
        out = np.zeros(self.blocks[-1], "<u4")
        every = np.repeat(self.df, self.df)  # by the widths of the lists, all postings of a width at once
        place = np.cumsum(self.df) - self.df
        each, list_of = np.arange(len(every)), np.repeat(np.arange(len(self.df)), self.df)
        inside = each - place[list_of]
        values = []
        for k in (0, 1):
            own = np.zeros(len(every), np.int64)
            body, width = np.frombuffer(self.bodies[k], np.uint8), self.widths[list_of, k]
            byte = self.places[list_of, k] + inside * width
            for w in (1, 2, 4):
                some = np.flatnonzero(width == w)
                for b in range(w):
                    own[some] |= body[byte[some] + b].astype(np.int64) << (8 * b)
            values.append(own)
        begin = np.flatnonzero(inside % POSTINGS == 0)
        sizes = np.diff(np.append(begin, len(every)))
        sums = np.cumsum(values[0])
        docs = sums + np.repeat(self.first - sums[begin], sizes)
        if len(begin):
            out[:] = np.maximum.reduceat(impact(values[1], self.m[docs]), begin)
        return out


def add_impacts(counts: Counts):
    """mapInArrow function from SEGMENT to INDEX rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                maxima = Segment(one.to_pylist()[0], counts).block_maxima()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([maxima.tobytes()], pa.binary())], [c.split()[0] for c in INDEX.split(", ")])
        trim()

    return run


class Best:
    """An item's k best scores so far, and the score that others must reach."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(threshold, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def search_segment(s: Segment, lists: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Adds to best the segment's documents that reach its threshold. lists, weights: of the item's terms that the segment has."""
    spans = [slice(int(s.blocks[t]), int(s.blocks[t + 1])) for t in lists]
    bound = np.array([w * int(s.impacts[x].max()) for w, x in zip(weights.tolist(), spans, strict=True)], np.int64)
    if bound.sum() < best.threshold:
        return
    order = np.argsort(-bound, kind="stable")
    lists, weights, spans = lists[order], weights[order].tolist(), [spans[k] for k in order.tolist()]
    ends = np.unique(np.concatenate([s.last[x] for x in spans]))
    starts = np.concatenate([[0], ends[:-1] + 1])
    # shallow moves: the block of each list in each range, by headers alone
    blocks = np.empty((len(spans), len(ends)), np.int64)
    promised = np.zeros((len(spans) + 1, len(ends)), np.int64)
    for k, x in enumerate(spans):
        at = np.searchsorted(s.last[x], starts)
        blocks[k] = at
        some = at < x.stop - x.start
        at = np.minimum(at, x.stop - x.start - 1)
        promised[k] = np.where(some & (s.first[x][at] <= ends), weights[k] * s.impacts[x][at], 0)
    own = promised[:-1] > 0
    promised = promised[::-1].cumsum(axis=0)[::-1]  # of a list and those behind it
    range_of = np.repeat(np.arange(len(ends)), ends - starts + 1)
    left = np.flatnonzero(promised[0] >= best.threshold)
    if len(best.scores) < best.k and best.threshold == 1:  # nothing known yet: the best ranges first
        n = max(1, int(len(left) * FIRST_SHARE))
        rounds = [left[np.argsort(-promised[0, left], kind="stable")[:n]]]
    else:
        rounds = []
    done = np.zeros(len(ends), bool)
    while True:
        now = rounds.pop() if rounds else np.flatnonzero(~done & (promised[0] >= best.threshold))
        if not len(now):
            return
        done[now] = True
        found = np.zeros(len(range_of), np.int64)
        active = np.zeros(len(ends), bool)
        active[now] = True
        for k in range(len(spans)):
            hope = promised[k]
            live = active & (hope >= best.threshold)
            if live.sum() < len(now):  # behind the pivot of some ranges
                live |= active & (np.maximum.reduceat(found, starts) + hope >= best.threshold)
            active = live
            live = live & own[k]
            if not live.any():
                if not active.any():
                    break
                continue
            which = np.unique(blocks[k, live])
            docs, impacts = s.postings(int(lists[k]), which)
            some = docs < len(range_of)
            if not some.all():
                docs, impacts = docs[some], impacts[some]
            some = live[range_of[docs]]
            found[docs[some]] += weights[k] * impacts[some].astype(np.int64)
        hit = np.flatnonzero(found >= best.threshold)
        best.add(found[hit], s.ids[hit])


class Items:
    """The items of a block: their distinct terms, and each item's terms with weights (0: no document has the term)."""

    def __init__(self, terms: np.ndarray, of_item: list[tuple[np.ndarray, np.ndarray]], thresholds: list[int]):
        self.terms, self.of_item, self.thresholds = terms, of_item, thresholds


def searcher(items, counts: Counts, k: int):
    """mapInArrow function over INDEX rows to FOUND: each item's k best documents of the task. items: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, t) for t in items.value.thresholds]
        for batch in batches:
            for one in range(batch.num_rows):
                s = Segment(batch.slice(one, 1).to_pylist()[0], counts)
                if not len(s.terms):
                    continue
                at = np.minimum(np.searchsorted(s.terms, items.value.terms), len(s.terms) - 1)
                has = s.terms[at] == items.value.terms
                for (terms, weights), b in zip(items.value.of_item, best, strict=True):
                    own = has[terms]
                    if own.any():
                        search_segment(s, at[terms[own]], weights[own], b)
        rows = [(n, b.ids, b.scores) for n, b in enumerate(best) if len(b.ids)]
        columns = [np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows]), *(np.concatenate([r[c] for r in rows]) for c in (1, 2))] if rows else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], [c.split()[0] for c in FOUND.split(", ")])
        trim()

    return run


def frequencies_of(terms):
    """mapInArrow function over (terms, df) of segments to (pos, df) of some terms, summed up over the task. terms: broadcast, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for have, df in zip(batch.column(0), batch.column(1), strict=True):
                have, df = np.frombuffer(have.as_buffer(), "<u8"), np.frombuffer(df.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(have, terms.value), len(have) - 1)
                total += np.where(have[at] == terms.value, df[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pos", "df"])

    return run


def build_segments(docs: DataFrame) -> DataFrame:
    """SEGMENT rows of docs, written."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_column(docs))
    return durable(source.mapInArrow(make_segments, SEGMENT).withColumn("seed", F.pmod(F.xxhash64("segment"), F.lit(SEED)) == 0))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    rows = durable(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), text_column(items)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // ITEM_BYTES))
    segments = build_segments(docs)
    total = segments.agg(F.sum("n_docs").cast("long"), F.sum("n_terms")).first()
    counts = Counts(total[0] or 0, total[1] or 0)
    index = {seed: durable(segments.filter(F.col("seed") == seed).drop("seed").mapInArrow(add_impacts(counts), INDEX)) for seed in (True, False)}
    found = None
    for block in range(n_blocks):
        part = _search_block(spark, rows.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block), segments, index, counts, k)
        found = part if found is None else found.unionByName(part)
    forget(segments)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(rows.select("row", "item_id"), "row")
    return best.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def _search_block(spark, rows: DataFrame, segments: DataFrame, index: dict[bool, DataFrame], counts: Counts, k: int) -> DataFrame:
    """row, doc_id and score of the best documents of each task, for some ITEM_BYTES of items."""
    own = rows.select("row", "text").orderBy("row").toArrow().combine_chunks()  # one block of items
    texts = own["text"].combine_chunks() if len(own) else pa.array([], pa.string())
    parts = [*term_hashes(*texts_of(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)))]
    hashes = np.concatenate([np.zeros(0, U64), *(p[0] for p in parts)])
    item = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    terms, which = np.unique(hashes, return_inverse=True)
    context = spark.sparkContext
    df = np.zeros(len(terms), np.int64)
    for pos, n in segments.select("terms", "df").mapInArrow(frequencies_of(context.broadcast(terms)), "pos int, df long").groupBy("pos").agg(F.sum("df")).collect():  # a row a term of the block
        df[pos] = n
    weights = np.array([counts.weight(n) if n else 0 for n in df.tolist()], np.int64)
    of_item = []
    edges = np.searchsorted(item, np.arange(len(own) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        t, times = np.unique(which[a:b], return_counts=True)
        w = times * weights[t]
        of_item.append((t[w > 0], w[w > 0]))
    make = lambda thresholds: searcher(context.broadcast(Items(terms, of_item, thresholds)), counts, k)
    first = durable(index[True].mapInArrow(make([1] * len(own)), FOUND))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    thresholds = [1] * len(own)
    for n, score in first.withColumn("rank", rank).filter(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
        thresholds[n] = score
    found = first.unionByName(index[False].mapInArrow(make(thresholds), FOUND))
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(own)), pa.int32()), "row": own["row"]})) if len(own) else spark.createDataFrame([], "item int, row long")
    return durable(found.join(F.broadcast(names), "item").select("row", "doc_id", "score"))  # one block of items


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT r, doc_id, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM o GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM o GROUP BY r),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
m AS (SELECT r, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, s),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
