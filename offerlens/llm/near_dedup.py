"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of SHINGLE words; one with fewer words has a single shingle of all. A shingle weighs its count in
the text, damped to 1 + ln(count), times its inverse document frequency 1 + IDF_SHARE * ln(documents / frequency) / ln(documents): from
1 for what all documents have to 1 + IDF_SHARE for what one has, at any size of the corpus or of its texts. Without the constant part
a text copied in thousands with small changes would be torn from its copies by the rareness of the changes.
SAMPLES consistent weighted samples in bands of ROWS give candidate pairs; a pair is a link if the weighted Jaccard similarity of
both whole texts is THRESHOLD or more; classes are the connected components of the links. The draws of a sample are chosen by
DRAW_BITS bits of a shingle's hash: of shingles that share a draw and a weight the one with the smaller hash is taken, in every text
alike, so that in texts of over 2**DRAW_BITS shingles such shingles stand for each other; what is a link is decided without draws.

Document frequencies are exact, of every shingle and over all documents. Texts lie in segments of about SEGMENT_BYTES, a compressed row
each. A segment sends each range of the hashes one packed block of its shingles (5 bytes a distinct one); a task sums up its range's
blocks and answers each with the frequencies of just its shingles, in a byte or less, and the answers meet the segment's texts again.
Nothing is broadcast or collected but counts.

Copies and hot buckets. Equal texts are one node from the start, whatever their number. In a bucket of up to ALL_PAIRS nodes
all pairs are candidates. A larger one links each node to three leaders, and to one leader of each smaller group that shares
a second bucket too. After the components are known, what is left there are pairs of nodes in different components: the
nodes outside the bucket's main component meet all others, block by block, and a task compares those whose samples agree about
as often as the threshold asks until it has joined their components, so that no class is torn by a bucket's size. Blocks hold about
BLOCK nodes and BLOCK_BYTES of compressed texts. With exact=True every pair of a larger bucket is compared, block by block, whatever its samples
or components; classes come out the same, and `n_links`, the number of different texts that a document's text has links to, is complete:
otherwise it counts the links that the classes needed.

Cases. Null texts and texts without a word have no shingle: each is a class of its own. Null doc_ids come last in order and
stay null. Rows with one doc_id and one text get one class. A very long text is one node like any other and read whole. Columns
beyond doc_id and text pass through `dedup_documents` only, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import PORTION_BYTES, U64, Words, chunks, durable, forget, mix, packed, partitions_for, portions, trim, unpacked, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
#: What a shingle of one document weighs more than one of all documents.
IDF_SHARE = 0.5
#: Bytes of a segment's texts, about; hash ranges for each shuffle partition.
SEGMENT_BYTES, RANGES_EACH = 1 << 22, 2
#: Nodes of a bucket whose pairs are all compared at once.
ALL_PAIRS = 12
#: Samples of two texts that must agree before a pair left over in a large bucket is compared: with a similarity of THRESHOLD
#: SAMPLES * THRESHOLD = 32 agree on average, and fewer than these less often than once in 10**9; the bands themselves miss one in 200.
LEAST_AGREED = 16
#: Nodes and bytes of a block of a large bucket, about.
BLOCK, BLOCK_BYTES = 64, 1 << 19
#: Draws a hash function chooses from.
DRAW_BITS = 16
NO_ID = (1 << 63) - 1
F32 = np.float32

SEGMENT = "segment long, nodes array<binary>, copies array<int>, lengths array<int>, texts binary"
SIGNED = "node binary, band int, bucket long, sketch array<smallint>, frequencies binary"


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text and node: the digest of the text, null without words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text.cast("binary"))))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), node.alias("node"))


def shingle_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of all distinct shingles, ordered by text and hash."""
    w = Words(texts)
    hashes = w.hashes()
    grams = window_hashes(hashes, SHINGLE)
    whole = w.doc[: len(grams)] == w.doc[SHINGLE - 1 :]
    doc, grams = w.doc[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        own = np.array([window_hashes(hashes[w.first[k] : w.first[k + 1]], int(w.counts[k]))[0] for k in short], dtype=U64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, own])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])])[: len(doc)])
    return doc[begin], grams[begin], np.diff(np.append(begin, len(doc)))


def make_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENT rows of (text, node): each text of a segment once, and how many documents have it there."""
    number, held, size = TaskContext.get().partitionId() << 33, {}, 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def put() -> pa.RecordBatch:
        columns = [([*held], pa.list_(pa.binary())), ([x[1] for x in held.values()], pa.list_(pa.int32())), ([len(x[0]) for x in held.values()], pa.list_(pa.int32())), (squeeze.compress(b"".join(x[0] for x in held.values())), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], t) for c, t in columns)], [c.split()[0] for c in SEGMENT.split(", ")])

    for batch in portions(batches):
        for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node in held:
                held[node][1] += 1
                continue
            raw = text.encode("utf-8", "surrogatepass")
            if held and size + len(raw) > SEGMENT_BYTES:
                yield put()
                number, held, size = number + 1, {}, 0
            held[node] = [raw, 1]
            size += len(raw)
    if held:
        yield put()


def texts_of_segment(lengths: list[int], texts: bytes) -> list[str]:
    raw, edges = zstandard.ZstdDecompressor().decompress(texts), np.cumsum([0, *lengths]).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:], strict=False)]


def single_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text), each text compressed by itself, of (nodes, lengths, texts) of segments."""
    squeeze, stretch = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            own, lengths, texts = (batch.column(c)[k].as_py() for c in range(3))
            raw, edges = stretch.decompress(texts), np.cumsum([0, *lengths]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([squeeze.compress(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["node", "text"])


def segment_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`shingle_counts` of any number of texts, in chunks of bounded size."""
    parts = []
    for a, b in chunks(texts):
        doc, grams, count = shingle_counts(texts[a:b])
        parts.append((doc + a, grams, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))


def count_shingles(ranges: int):
    """mapInArrow function over (segment, copies, lengths, texts) to (segment, range, block): a segment's shingles by range of the hash, with the documents that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment, copies, lengths, texts = (batch.column(c)[k].as_py() for c in range(4))
                doc, grams, _ = segment_shingles(texts_of_segment(lengths, texts))
                order = np.argsort(grams, kind="stable")
                grams, n = grams[order], np.array(copies, np.int64)[doc[order]]
                begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
                keys, n = grams[begin], np.add.reduceat(n, begin) if len(begin) else n
                edges = np.searchsorted(((keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64), np.arange(ranges + 1))
                used = np.flatnonzero(np.diff(edges)).tolist()
                blocks = [packed(keys[edges[r] : edges[r + 1]], n[edges[r] : edges[r + 1]]) for r in used]
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(blocks, pa.binary())], ["segment", "range", "block"])
        trim()

    return run


def squeezed(numbers: np.ndarray) -> bytes:
    """Frequencies, mostly small, in about a byte or less each."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def stretched(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def answer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, range, frequencies) of all blocks of a range: the frequencies of each block's shingles in all blocks together."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
    if rows:
        keys, n = (np.concatenate(x) for x in zip(*(unpacked(r[2]) for r in rows), strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(n[order], begin)
        keys = keys[begin]
        del n, order
        for segment, part, block in rows:
            own = total[np.searchsorted(keys, unpacked(block)[0])]
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([part], pa.int32()), pa.array([squeezed(np.minimum(own, (1 << 32) - 1))], pa.binary())], ["segment", "range", "frequencies"])
    trim()


def document_frequencies(segments: DataFrame) -> DataFrame:
    """segment and answers: the frequencies of its distinct shingles, by range and then by hash. segments must be written."""
    ranges = RANGES_EACH * partitions_for(segments)
    blocks = segments.select("segment", "copies", "lengths", "texts").mapInArrow(count_shingles(ranges), "segment long, range int, block binary").repartitionById(ranges, F.col("range"))  # a task a range
    answers = blocks.mapInArrow(answer_blocks, "segment long, range int, frequencies binary")
    return answers.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("range", "frequencies"))).alias("answers"))  # a few bytes a shingle of one segment


def weigh(count: np.ndarray, frequency: np.ndarray, documents: int) -> np.ndarray:
    return (1 + np.log(count)) * (1 + IDF_SHARE * np.log(max(documents, 1) / frequency) / max(np.log(max(documents, 1)), 1e-9))


class Sampler:
    """Improved consistent weighted sampling: the draws of an element under hash function k are table entries chosen by its hash."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        n = 1 << DRAW_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.multiplier = rng.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * U64(2) + U64(1)

    def samples(self, doc: np.ndarray, grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that have shingles, and their samples, a column a hash function."""
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
        sizes = np.diff(np.append(begin, len(doc)))
        log_s = np.log(weights).astype(np.float32)
        out = np.zeros((len(begin), SAMPLES), dtype=U64)
        for k in range(SAMPLES):
            draw = ((grams * self.multiplier[k]) >> U64(64 - DRAW_BITS)).astype(np.int32)
            r, beta = self.r[draw], self.beta[draw]
            t = np.floor(log_s / r + beta)
            log_a = self.log_c[draw] - r * (t - beta) - r
            least = np.minimum.reduceat(log_a, begin) if len(begin) else log_a
            hit = np.flatnonzero(log_a == np.repeat(least, sizes))
            own = doc[hit]
            hit = hit[np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]]
            out[:, k] = mix(grams[hit] ^ mix(t[hit].astype(np.int64).view(U64) + U64(k)))
        return doc[begin], out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(samples), BANDS), dtype=U64)
        for band in range(BANDS):
            for k in range(ROWS):
                keys[:, band] = mix(keys[:, band] * U64(0x9E3779B97F4A7C15) + samples[:, band * ROWS + k])
        return keys.view(np.int64)


def signer(documents: int):
    """mapInArrow function over (nodes, lengths, texts, answers) of segments to SIGNED: a row a band, and one of band -1 with sketch and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, names = Sampler(), [c.split()[0] for c in SIGNED.split(", ")]
        for batch in batches:
            for row in range(batch.num_rows):
                nodes_, lengths, texts, answers = (batch.column(c)[row].as_py() for c in range(4))
                texts = texts_of_segment(lengths, texts)
                doc, grams, count = segment_shingles(texts)
                known = np.concatenate([stretched(a["frequencies"]) for a in answers])
                order = np.argsort(grams, kind="stable")
                number = np.cumsum(np.concatenate([[False], np.diff(grams[order]) != 0])[: len(grams)])
                frequency = np.empty(len(grams), np.int64)
                frequency[order] = known[number]
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                for a, b in chunks(texts):
                    own = slice(edges[a], edges[b])
                    which, samples = sampler.samples(doc[own], grams[own], weigh(count[own], frequency[own], documents))
                    n = len(which)
                    keys = pa.array([nodes_[k] for k in which.tolist()], pa.binary())
                    rows = keys.take(pa.array(np.repeat(np.arange(n), BANDS)))
                    band = np.tile(np.arange(BANDS, dtype=np.int32), n)
                    nothing = [pa.nulls(len(rows), t) for t in (pa.list_(pa.int16()), pa.binary())]
                    yield pa.RecordBatch.from_arrays([rows, pa.array(band), pa.array(sampler.bands(samples).ravel()), *nothing], names)
                    # the sketch has 16 bits of each sample
                    sketch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SAMPLES), pa.array((samples >> U64(48)).astype(np.uint16).view(np.int16).ravel()))
                    held = [squeezed(frequency[edges[k] : edges[k + 1]]) for k in which.tolist()]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64)), sketch, pa.array(held, pa.binary())], names)
        trim()

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending hashes, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = np.minimum(a[1], np.where(b[0][at] == a[0], b[1][at], 0)).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def is_link(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Similar enough; what lacks the last digits of THRESHOLD only is."""
    return weighted_jaccard(a, b) >= THRESHOLD - 1e-12


def vectors_of(texts: list[bytes], frequencies: list[bytes], documents: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and weights of the shingles of each compressed text."""
    stretch = zstandard.ZstdDecompressor()
    doc, grams, count = segment_shingles([stretch.decompress(t).decode("utf-8", "surrogatepass") for t in texts])
    known = np.concatenate([*map(stretched, frequencies)]) if frequencies else np.zeros(0, np.int64)
    weights = weigh(count, known, documents)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(grams[edges[k] : edges[k + 1]], weights[edges[k] : edges[k + 1]]) for k in range(len(texts))]


def verifier(documents: int):
    """mapInArrow function over (a, b, text_a, text_b, frequencies_a, frequencies_b) to the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 4 * PORTION_BYTES):  # a text is in several pairs of a batch
            a, b, text_a, text_b, known_a, known_b = (batch.column(c).to_pylist() for c in range(6))
            texts = dict(zip(a, zip(text_a, known_a, strict=True), strict=True)) | dict(zip(b, zip(text_b, known_b, strict=True), strict=True))
            vectors = dict(zip(texts, vectors_of([t for t, _ in texts.values()], [k for _, k in texts.values()], documents), strict=True))
            keep = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if is_link(vectors[x], vectors[y])]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"])

    return run


def joiner(documents: int, exact: bool):
    """mapInArrow function over (band, others, every), two blocks of a bucket's nodes, to links that join their components, each as seldom as can be; to all links, if exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}  # over the task: components that its links have joined

        def find(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                band, own, every = (batch.column(c)[k].as_py() for c in range(3))
                x, y = (np.array([r["sketch"] for r in side], dtype=np.int16) for side in (own, every))
                agreed = (x[:, None, :] == y[None, :, :]).sum(axis=2)
                if exact:
                    agreed += LEAST_AGREED
                elif band:  # pairs that share an earlier band's bucket have met there
                    x, y = (np.array([r["bands"][:band] for r in side], dtype=np.int64) for side in (own, every))
                    agreed[(x[:, None, :] == y[None, :, :]).any(axis=2)] = 0
                vectors = [None] * len(own), [None] * len(every)
                i, j = np.nonzero(agreed >= LEAST_AGREED)
                order = np.argsort(-agreed[i, j], kind="stable")
                for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    if own[p]["node"] == every[q]["node"] or (not exact and find(own[p]["root"]) == find(every[q]["root"])):
                        continue
                    for side, rows, r in ((0, own, p), (1, every, q)):
                        if vectors[side][r] is None:
                            vectors[side][r] = vectors_of([rows[r]["text"]], [rows[r]["frequencies"]], documents)[0]
                    if is_link(vectors[0][p], vectors[1][q]):
                        parent[find(own[p]["root"])] = find(every[q]["root"])
                        found.append((own[p]["node"], every[q]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.binary()), pa.array([max(f) for f in found], pa.binary())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """The links (a < b) among pairs. texts: node, text and frequencies, a row a node, of the nodes in pairs at least."""
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"), F.col("frequencies").alias(f"frequencies_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b", "frequencies_a", "frequencies_b")
    return durable(joined.mapInArrow(verifier(documents), "a binary, b binary"))


def ordered_pairs(x, y, frame: DataFrame) -> DataFrame:
    return frame.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of all nodes in edges (a, b); alternating large and small stars."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = durable(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u"), F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v")
        before, edges = edges, durable(small.distinct())
        forget(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return durable(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def links(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, node of all rows; the links (a < b) found; and the roots of the nodes that have links."""
    rows = nodes(docs)
    segments = durable(rows.filter("node is not null").select("text", "node").mapInArrow(make_segments, SEGMENT))
    documents = segments.agg(F.sum(F.aggregate("copies", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    answers = durable(document_frequencies(segments))
    forget()
    answered = segments.join(answers, "segment").select("nodes", "lengths", "texts", "answers")
    signed = durable(answered.mapInArrow(signer(documents), SIGNED))
    forget(answers)
    signatures = durable(signed.filter("band >= 0").select("node", "band", "bucket").distinct())
    lead = [F.min("node").alias("l1"), F.max("node").alias("l2"), F.min_by("node", F.xxhash64("node")).alias("l3")]
    buckets = durable(signatures.groupBy("band", "bucket").agg(F.count("*").alias("n"), *lead).filter("n > 1"))
    members = durable(signatures.join(buckets, ["band", "bucket"]))
    small = members.filter(F.col("n") <= ALL_PAIRS).groupBy("band", "bucket").agg(F.collect_list("node").alias("own"))
    first = small.select("own", F.explode("own").alias("x")).select("x", F.explode("own").alias("y")).filter("x < y")
    large = members.filter(F.col("n") > ALL_PAIRS)
    star = large.select("node", F.explode(F.array_distinct(F.array("l1", "l2", "l3"))).alias("lead"))
    second = large.select("node", "band", "bucket").join(signatures.withColumnsRenamed({"band": "band2", "bucket": "bucket2"}), "node").filter("band != band2")
    both = durable(second.withColumn("own", F.xxhash64("band", "bucket", "band2", "bucket2")).select("own", "node"))
    nearer = both.join(both.groupBy("own").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1"), "own")
    found = [first.select(F.col("x").alias("a"), F.col("y").alias("b")), ordered_pairs(F.col("node"), F.col("lead"), star), ordered_pairs(F.col("node"), F.col("lead"), nearer)]
    pairs = durable(found[0].unionByName(found[1]).unionByName(found[2]).distinct())
    # one copy of each node that is in a bucket with others; always by a shuffle of both sides: the wanted ones grow with the corpus
    wanted = members.select("node").distinct()
    own = signed.filter("band < 0").select("node", "sketch", "frequencies").join(wanted.hint("merge"), "node").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("frequencies").alias("frequencies"))
    read = segments.select("nodes", "lengths", "texts").mapInArrow(single_texts, "node binary, text binary").join(wanted.hint("merge"), "node").groupBy("node").agg(F.first("text").alias("text"))
    forget()
    texts = durable(own.join(read, "node"))
    forget(segments, signed)
    edges = verified(pairs, texts, documents)
    roots = components(edges)
    # what a large bucket still has between components
    open_rows = durable(large.select("band", "bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = open_rows.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    mixed = durable(sizes.groupBy("band", "bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter(F.lit(exact) | (F.col("roots") > 1)))
    if mixed.take(1):
        own_bands = signatures.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "bucket"))), lambda x: x["bucket"]).alias("bands"))
        left = durable(open_rows.join(mixed, ["band", "bucket"]).join(texts, "node").join(own_bands, "node"))
        blocks = left.groupBy("band", "bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks"))
        left = left.join(blocks, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        gathered = F.collect_list(F.struct("node", "root", "sketch", "text", "frequencies", "bands"))
        every = left.groupBy("band", "bucket", "block").agg(gathered.alias("every"))
        others = left.filter(F.lit(exact) | (F.col("root") != F.col("main"))).groupBy("band", "bucket", "blocks", F.col("block").alias("own")).agg(gathered.alias("others"))
        dealt = others.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") if exact else F.col("blocks") - 1)))
        more = durable(dealt.join(every, ["band", "bucket", "block"]).select("band", "others", "every").mapInArrow(joiner(documents, exact), "a binary, b binary").distinct())
        if more.take(1):
            edges = durable(edges.unionByName(more).distinct())
            roots = components(edges)
    return rows.select("doc_id", "node"), edges, roots


def near_classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), is_representative and n_links, a row for each row of docs."""
    out = _classes(docs, exact)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))).withColumn("class_id", F.nullif("class_id", F.lit(NO_ID))).select("doc_id", "class_id", "is_representative", "n_links")


def _classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    rows, edges, roots = links(docs, exact)
    heads = durable(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("head")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = heads.groupBy("root").agg(F.min("head").alias("class_id"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_node = durable(heads.join(least, "root").join(ends, "node", "left").select("node", "class_id", "n_links"))
    named = rows.join(of_node, "node", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return named.withColumn("is_representative", F.col("doc_id") == F.col("class_id"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the least doc_id, all columns as they are."""
    kept = _classes(docs).filter("is_representative").select(F.col("doc_id").alias("__near_id"), F.coalesce("node", F.lit(b"")).alias("__near_node"))
    kept = durable(kept.groupBy("__near_id", "__near_node").agg(F.count("*").alias("__near_rows")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text.cast("binary")))).otherwise(F.lit(b""))
    keyed = docs.withColumns({"__near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__near_node": node})
    out = keyed.join(kept.select("__near_id", "__near_node"), ["__near_id", "__near_node"], "left_semi")
    if kept.filter("__near_rows > 1").take(1):  # one document in several rows: one of them stays
        out = out.dropDuplicates(["__near_id", "__near_node"])
    return out.select(*docs.columns)
