"""Substring dedup by super-k-mer partitioning: windows of words that an earlier document has are removed, exactly.

A window is WINDOW consecutive words of one document. Its minimiser is the least of its runs of GRAM words, runs that are
frequent in the corpus (counted first, over all texts) ordered last. Minimisers are counted next: a window whose minimiser
occurs once in the corpus cannot repeat. Those that occur more often go into a bit table of fixed size, and only windows that
may be there go on (a full table would let all pass; it never drops a repeated one).

Consecutive windows with one minimiser travel as one packed string to the minimiser's bucket; equal strings of a task travel
once, with their least and greatest doc_id, so that hot passages shrink before the shuffle. In the bucket, sorting brings
equal windows together, each is compared word for word, and the least doc_id that has it is found. Only that summary comes
back for strings with a repeated window: it is joined by the string's 128-bit key to all places of the string, where adaptive
execution splits a hot key.

Hot minimisers. Where a passage stands in very many documents, the strings at its edges differ by document, and one minimiser may
have more of them than a bucket should hold. The windows of a minimiser with over SHARES times a bucket's mean travel one by one, each
to a bucket of its own hash, and equal ones shrink within a task, so that no bucket grows with a passage's copies.

A window is removed if a document with a smaller doc_id has the same words anywhere; each word under such a window goes.
Windows are judged on the input, not on what is left.

Cases. Null, empty and short texts (fewer words than a window) lose nothing. A null doc_id counts as larger than all others.
Rows with the same doc_id are one document: they lose nothing to each other. A very long text is read whole, in one task, and its windows
travel like all others. Repeated rows are judged each for itself. An empty table gives an empty result. Columns beyond doc_id and text
are ignored by `remove_repeats` and kept by `dedup_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import U64, Words, chunks, durable, forget, mix, partitions_for, portions, powers, range_blocks, range_sums, text_column, window_hashes

WINDOW = 13
#: A minimiser's words, and windows a packed string holds at most (a longer run of one minimiser is cut).
GRAM, LONGEST = 6, 64
#: Bits of the table of repeated minimisers, as a power of two (8 MB), and minimisers a task counts before it puts them out.
TABLE_BITS, COUNTED = 26, 1 << 21
#: Buckets of the frequency count, and the share of all runs from which a bucket counts as hot.
COUNTERS, HOT_SHARE = 1 << 16, 1000
#: Characters of packed strings a task gathers before it puts out blocks; grouped buckets, and ranges of minimisers, for each shuffle partition.
FLUSH_CHARS, BUCKETS_EACH, RANGES_EACH = 24 << 20, 8, 2
#: A minimiser is hot if it has so many times a bucket's mean of strings, and over HOT_LEAST.
SHARES, HOT_LEAST = 2, 4096
NO_ID = (1 << 63) - 1
#: Bases of a string's two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

BLOCKS = "bucket int, block binary"
SHARED = "k1 long, k2 long, until array<int>, least array<long>"
PLACES = "k1 long, k2 long, doc_id long, text_key long, first int"


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the runs that are frequent in the task, and the task's total as bucket -1."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in portions(batches):
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts):
            grams = window_hashes(Words(texts[a:b]).hashes(), GRAM)
            counts += np.bincount((grams >> U64(48)).astype(np.int64), minlength=COUNTERS)
    often = np.flatnonzero(counts * 2 * HOT_SHARE >= max(counts.sum(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1).astype(np.int32)), pa.array(np.append(counts[often], counts.sum()))], ["bucket", "n"])


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Hot counter buckets; at most HOT_SHARE, since each has that share of all runs."""
    counted = docs.select(text_column(docs)).mapInArrow(gram_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("bucket") >= 0, F.desc("n")).limit(HOT_SHARE + 1).collect()
    total = next((r["n"] for r in top if r["bucket"] < 0), 0)
    hot = np.zeros(COUNTERS, dtype=bool)
    hot[[r["bucket"] for r in top if r["bucket"] >= 0 and r["n"] * HOT_SHARE >= total]] = True
    return hot


class SuperKmers:
    """Runs of windows with one minimiser, of some texts: first word, number of windows, minimiser, text, and a 128-bit key."""

    def __init__(self, texts: list[str], hot: np.ndarray, repeated: np.ndarray | None = None, split: np.ndarray | None = None):
        self.words = w = Words(texts)
        hashes = w.hashes()
        n = len(hashes) - WINDOW + 1
        empty = np.zeros(0, dtype=np.int64)
        self.first, self.windows, self.text, self.minimiser, self.k1, self.k2, self.alone = (empty,) * 7
        if n <= 0:
            return
        grams = window_hashes(hashes, GRAM)
        order = (grams >> U64(1)) | (hot[(grams >> U64(48)).astype(np.int64)].astype(U64) << U64(63))
        span = WINDOW - GRAM + 1
        least, width = order, 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:n], least[span - width : span - width + n])
        valid = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
        if not len(valid):
            return
        new = np.concatenate([[True], (np.diff(valid) != 1) | (least[valid[1:]] != least[valid[:-1]])])
        begin = np.flatnonzero(new)
        place = np.arange(len(valid)) - np.repeat(begin, np.diff(np.append(begin, len(valid))))
        begin = np.flatnonzero(place % LONGEST == 0)
        sizes = np.diff(np.append(begin, len(valid)))
        if repeated is not None:
            some = in_table(repeated, mix(least[valid[begin]]))
            begin, sizes = begin[some], sizes[some]
            if not len(begin):
                return
        self.alone = np.zeros(len(begin), dtype=bool)
        if split is not None and len(split):  # windows of hot minimisers travel one by one
            own = mix(least[valid[begin]])
            alone = split[np.minimum(np.searchsorted(split, own), len(split) - 1)] == own
            times = np.where(alone, sizes, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begin, sizes, self.alone = np.repeat(begin, times) + step, np.repeat(np.where(alone, 1, sizes), times), np.repeat(alone, times)
        self.first = valid[begin]
        self.windows = sizes
        self.text = w.doc[self.first]
        self.minimiser = least[self.first]
        last = self.first + self.windows + WINDOW - 1
        self.k1, self.k2 = (self.key(hashes, self.first, last, base) for base in BASES)

    @staticmethod
    def key(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
        """Polynomial hash of the words [first, last), whatever place they have."""
        total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * powers(base, len(hashes)), dtype=U64)])
        inverse = pow(base, -1, 1 << 64)
        return mix((total[last] - total[first]) * powers(inverse, len(hashes) + 1)[first] + (last - first).astype(U64)).view(np.int64)

    def strings(self, which: np.ndarray) -> list[str]:
        """Words of these runs, with one space between."""
        w = self.words
        codes = np.where(w.blank, np.uint32(32), w.codes)
        keep = ~(w.blank & np.concatenate([[True], w.blank[:-1]]))
        joined = codes[keep].tobytes().decode("utf-32-le")
        at = np.concatenate([[0], np.cumsum(keep)])
        a = at[w.start[self.first[which]]].tolist()
        b = at[w.end[self.first[which] + self.windows[which] + WINDOW - 2]].tolist()
        return [joined[x:y] for x, y in zip(a, b, strict=True)]


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether both bits of these 64-bit values are set."""
    mask = U64((1 << TABLE_BITS) - 1)
    one = lambda at: table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)
    return (one(values & mask) & one(values >> U64(TABLE_BITS) & mask)).astype(bool)


def minimiser_counter(hot, ranges: int):
    """mapInArrow function over (text) to (range, block): how many strings of the task have a minimiser, packed by range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in portions(batches):
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                runs = SuperKmers(texts[a:b], hot.value)
                if len(runs.first):
                    held.append(mix(runs.minimiser))  # minimisers are small values: mixed, they spread over all ranges
                if sum(map(len, held)) >= COUNTED:
                    yield range_blocks(held, ranges)
        yield range_blocks(held, ranges)

    return run


def repeated_minimisers(docs: DataFrame, hot, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit table of minimisers that occur twice or more (2**(TABLE_BITS - 6) words of it at most come to the driver), and the hot
    ones in ascending order (buckets / SHARES at most)."""
    ranges = RANGES_EACH * partitions_for(docs)
    counted = docs.select(text_column(docs)).mapInArrow(minimiser_counter(hot, ranges), "range int, block binary").repartitionById(ranges, F.col("range"))
    repeated = durable(counted.select("block").mapInArrow(range_sums(1), "key long, n long").withColumnRenamed("key", "minimiser"))
    mask = F.lit((1 << TABLE_BITS) - 1)
    bits = repeated.select(F.explode(F.array(F.col("minimiser").bitwiseAND(mask), F.shiftrightunsigned("minimiser", TABLE_BITS).bitwiseAND(mask))).alias("bit"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    got = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(word).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=U64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    least = max(HOT_LEAST, SHARES * (repeated.agg(F.sum("n")).first()[0] or 0) // buckets)
    split = repeated.filter(F.col("n") > least).select("minimiser").toArrow()["minimiser"].to_numpy().view(U64)
    forget(repeated)
    return table, np.sort(split)


def block_maker(hot, repeated, split, buckets: int):
    """mapInArrow function over (doc_id, text) to BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        held: dict[tuple[int, int], list] = {}
        size = 0

        def put() -> pa.RecordBatch:
            nonlocal size
            by: dict[int, list] = {}
            for x in held.values():
                by.setdefault(x[0], []).append(x)
            rows = []
            for bucket, own in by.items():
                own.sort(key=lambda x: x[3])
                numbers = np.array([(x[1], x[2]) for x in own], dtype="<i8").T
                rows.append((bucket, packer.compress(np.int64(len(own)).astype("<i8").tobytes() + numbers.tobytes() + "\n".join([x[3] for x in own]).encode())))
            held.clear()
            size = 0
            columns = list(zip(*rows, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["bucket", "block"])

        for batch in portions(batches):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                runs = SuperKmers(texts[a:b], hot.value, repeated.value, split.value)
                docs = ids[a:b][runs.text] if len(runs.text) else np.zeros(0, np.int64)
                # equal strings of the chunk once, with least and greatest document
                order = np.lexsort((runs.k2, runs.k1))
                k1, k2 = runs.k1[order], runs.k2[order]
                begin = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])[: len(order)])
                if not len(begin):
                    continue
                low, high = np.minimum.reduceat(docs[order], begin), np.maximum.reduceat(docs[order], begin)
                chosen = order[begin]
                bucket = ((mix(np.where(runs.alone, runs.k1.view(U64), runs.minimiser)[chosen]) >> U64(33)) % U64(buckets)).astype(np.int64)
                for key, x, y, p, s in zip(zip(k1[begin].tolist(), k2[begin].tolist(), strict=True), low.tolist(), high.tolist(), bucket.tolist(), runs.strings(chosen), strict=True):
                    known = held.get(key)
                    if known is None:
                        held[key] = [p, x, y, s]
                        size += len(s)
                    else:
                        known[1], known[2] = min(known[1], x), max(known[2], y)
                if size >= FLUSH_CHARS:
                    yield put()
        yield put()

    return run


def read_blocks(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Least and greatest document, and the packed strings of a bucket; equal strings of different tasks still apart."""
    numbers, strings = [], []
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(raw[:8], dtype="<i8")[0])
        numbers.append(np.frombuffer(raw[8 : 8 + 16 * n], dtype="<i8").reshape(2, n))
        strings += raw[8 + 16 * n :].decode().split("\n")
    low, high = np.concatenate(numbers, axis=1)
    return low, high, strings


def bucket_windows(blocks: pa.Table) -> pa.Table:
    """SHARED of the bucket's strings that have a window of a document smaller than their greatest."""
    low, high, strings = read_blocks(blocks["block"].to_pylist())
    w = Words(strings)
    hashes = w.hashes()
    k1, k2 = (SuperKmers.key(hashes, w.first[:-1], w.first[1:], base) for base in BASES)
    order = np.lexsort((k2, k1))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]))
    head = order[begin]  # one of the equal strings stands for all
    low[head], high[head] = np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)
    stands = np.zeros(len(strings), dtype=bool)
    stands[head] = True
    windows = window_hashes(hashes, WINDOW)
    start = np.flatnonzero((w.doc[: len(windows)] == w.doc[WINDOW - 1 :]) & stands[w.doc[: len(windows)]])
    windows, owner = windows[start], w.doc[start]
    order = np.argsort(windows, kind="stable")
    new = np.concatenate([[True], windows[order][1:] != windows[order][:-1]])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    # equal hashes are equal words: compared as text; a window that differs gets a group of its own kind
    again = np.flatnonzero(~new)
    first = begin[group[again]]
    text, a, b = w.joined, w.start[start[order]], w.end[start[order] + WINDOW - 1]
    same = (text[p:q] == text[r:t] for p, q, r, t in zip(a[again].tolist(), b[again].tolist(), a[first].tolist(), b[first].tolist(), strict=True))
    odd = again[~np.fromiter(same, dtype=bool, count=len(again))].tolist()
    if odd:
        named: dict[str, int] = {}
        for k in odd:
            group[k] = len(begin) + named.setdefault(text[a[k] : b[k]], len(named))
    least = np.full(len(begin) + len(odd), NO_ID, dtype=np.int64)
    np.minimum.at(least, group, low[owner[order]])
    by_window = np.empty(len(start), dtype=np.int64)
    by_window[order] = least[group]
    # runs of windows of a string with one least document
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (by_window[1:] != by_window[:-1])]))
    first = np.searchsorted(owner, np.arange(len(strings)))
    until = np.append(edge[1:], len(start))
    shared = np.zeros(len(strings), dtype=bool)
    np.logical_or.at(shared, owner[edge], by_window[edge] < high[owner[edge]])
    some = shared[owner[edge]]
    edge, until = edge[some], until[some]
    rows, sizes = np.unique(owner[edge], return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.table({
        "k1": k1[rows], "k2": k2[rows],
        "until": pa.ListArray.from_arrays(offsets, pa.array((until - first[owner[edge]]).astype(np.int32))),
        "least": pa.ListArray.from_arrays(offsets, pa.array(by_window[edge])),
    })


def place_maker(hot, repeated, split):
    """mapInArrow function over (doc_id, text, text_key) to PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, texts, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for a, b in chunks(texts):
                runs = SuperKmers(texts[a:b], hot.value, repeated.value, split.value)
                if len(runs.first):
                    inside = runs.first - runs.words.first[runs.text]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (runs.k1, runs.k2, ids[a:b][runs.text], keys[a:b][runs.text], inside.astype(np.int32))], ["k1", "k2", "doc_id", "text_key", "first"])

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and spans (first word, one past the last word) of the removed words, for documents that lose any."""
    keyed = with_keys(docs)
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_grams(docs))
    buckets = BUCKETS_EACH * partitions_for(docs)
    repeated, split = map(spark.sparkContext.broadcast, repeated_minimisers(docs, hot, buckets))
    blocks = keyed.select("doc_id", "text").mapInArrow(block_maker(hot, repeated, split, buckets), BLOCKS)
    shared = durable(blocks.groupBy("bucket").applyInArrow(bucket_windows, SHARED))
    places = keyed.mapInArrow(place_maker(hot, repeated, split), PLACES)
    met = places.join(shared, ["k1", "k2"])
    runs = F.transform("until", lambda x, i: F.struct(F.when(i > 0, F.element_at("until", i)).otherwise(0).alias("a"), x.alias("b"), F.element_at("least", i + 1).alias("least")))
    lost = F.filter(runs, lambda r: r["least"] < F.col("doc_id"))
    spans = F.transform(lost, lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + F.lit(WINDOW - 1)).alias("b")))
    some = met.select("doc_id", "text_key", spans.alias("spans")).filter(F.size("spans") > 0)
    return some.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remover(digest: bool):
    """mapInArrow function over (doc_id, text, spans, ...) to n_words, n_removed and the kept words or their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, spans = batch.column("text").to_pylist(), batch.column("spans")
            n_words, n_removed, kept = [], [], []
            for k, text in enumerate(texts):
                words = split_words(text)
                n_words.append(len(words))
                own = spans[k].as_py()
                if own:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(gone, [x["a"] for x in own], 1)
                    np.add.at(gone, [x["b"] for x in own], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(" ".join(words))
            out = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept] if digest else kept, pa.string())
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), out], [*(c for c in batch.schema.names if c not in ("text", "spans")), "n_words", "n_removed", "kept"])

    return run


_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def split_words(text: str) -> list[str]:
    return [x for x in text.translate(_BLANKS).split(" ") if x]


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that are left with one space between, or the SHA-256 of that."""
    keyed = with_keys(docs)
    joined = keyed.join(repeated_spans(docs), ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(remover(digest), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with the text that is left and its n_chars; texts that lose nothing stay as they are."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__sub_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__sub_key")]
    spans = repeated_spans(docs).withColumnsRenamed({"doc_id": "__sub_id", "text_key": "__sub_key", "spans": "__sub_spans"})
    joined = docs.select("*", *key).join(spans, ["__sub_id", "__sub_key"], "left")
    text = F.when(F.col("__sub_spans").isNull(), F.col("text")).otherwise(_kept(F.coalesce("text", F.lit("")), F.col("__sub_spans")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__sub_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _kept(text, spans):
    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            if own is None or not len(own):
                out.append(t)
                continue
            words = split_words(t)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for x in own:
                gone[x["a"]] += 1
                gone[x["b"]] -= 1
            out.append(" ".join(words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()))
        return pd.Series(out)

    return kept(text, spans)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first_doc < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
             CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, n: NOT list_contains(ps, n)) END AS kept
      FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
