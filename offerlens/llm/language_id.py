"""Language identification by error-correcting output codes over character n-grams.

Code. Each language has a codeword, one bit for each binary classifier: for up to EXHAUSTIVE languages all the ways to part them
in two, beyond that CODE_BITS * log2(languages) random columns, of CODES draws the one whose codewords lie farthest apart.

Classifiers. A bit is predicted by a logistic model over the frequencies of a text's n-grams of 1 to ORDERS letters, hashed
into 2**BUCKET_BITS weights. Texts are read in lower case, each run of other characters as one blank. Spark trains each bit in a
task of its own, in numpy, on windows of several lengths, so that short texts are met as well.

Decoding. Every fourth document of the sample only calibrates: how often a bit is right on windows of a language is the weight of
that bit in the distance to the language's codeword. The distance is the weighted mean of the logistic losses; the nearest codeword
is the prediction, and `score` its share among exp(-bits * distance). A text is `ambiguous` if its bits, cut to signs, differ from
the codeword in more places than the code can correct, or if score is below SURE.

Sample. Of each language at most SAMPLE documents, and SAMPLE_ALL in all if that allows LEAST each, drawn by hash of the id among
labelled rows whose crc32 of the id as text, modulo FOLDS, is not HELD_OUT; SAMPLE_CHARS characters from a hashed place of each. The
languages are the model's classes: their number bounds what the driver holds. A prediction reads the whole text, and nothing else.

Cases. Null texts and texts without a letter are `und` with score 0, not ambiguous. Without a labelled text everything is `und`; with
one language all texts with letters are of it, with score 1. A null lang is no label, an empty one is. A null doc_id is never learnt from,
is not held out and stays null. Repeated rows are judged each for itself. A text of over PIECE characters is read in pieces whose sums add
up. An empty table gives an empty result. Columns beyond doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import durable, portions, text_column, trim

FOLDS, HELD_OUT = 4, 2
#: Documents of a language and of all that are learnt from at most, the least of a language, and characters of each.
SAMPLE, SAMPLE_ALL, LEAST, SAMPLE_CHARS = 240, 4800, 24, 4000
#: Lengths of training windows in characters.
WINDOWS = (10, 40, 160, 640, 2560)
#: Grams that a text is short of full evidence by: frequencies are over the grams and PRIOR more, so that short texts say less.
PRIOR = 24
ORDERS, BUCKET_BITS, PIECE = 4, 16, 1 << 18
EXHAUSTIVE, CODE_BITS, CODES = 5, 8, 200
EPOCHS, BATCH, RATE, GAIN, DECAY = 12, 64, 0.5, 8.0, 1e-5
SURE = 0.75
UNDETERMINED = "und"
#: Sums of a chunk's grams that are held at once, about.
HELD = 1 << 22

F32, U32 = np.float32, np.uint32


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all grams and the text of each, in order; and the number of letters of each text."""
    joined = "".join(t + "\n" for t in map(str.lower, texts))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), U32)
    letter = letters()[codes]
    doc = np.zeros(len(codes), np.int32)
    ends = np.cumsum([len(t) + 1 for t in map(str.lower, texts)], dtype=np.int64)
    doc[ends[:-1]] = 1
    doc = np.cumsum(doc, dtype=np.int32)
    counts = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of what parts two runs of letters
    codes, doc = np.where(letter, codes, U32(32))[keep], doc[keep]
    out, h = [], np.zeros(len(codes), U32)
    for order in range(1, ORDERS + 1):
        n = max(len(codes) - order + 1, 0)
        h = (h[:n] * U32(0x9E3779B1)) ^ codes[order - 1 :]
        whole = doc[:n] == doc[order - 1 :]
        mixed = (h ^ (h >> U32(15))) * U32(0x85EBCA6B) + U32(order * 0x27D4EB2F & 0xFFFFFFFF)
        out.append(((mixed >> U32(32 - BUCKET_BITS))[whole], doc[:n][whole]))
    return out, counts


def codewords(languages: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each language."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        return np.array([[1, *c] for c in itertools.product((1, -1), repeat=languages - 1) if -1 in c], np.int8).T
    rng, bits, best, found = np.random.default_rng(seed), math.ceil(CODE_BITS * math.log2(languages)), None, -1
    for _ in range(CODES):
        code = np.ones((languages, bits), np.int8)
        for b in range(bits):
            code[rng.permutation(languages)[: languages // 2], b] = -1
        distance = least_distance(code)
        if distance > found:
            best, found = code, distance
    return best


def least_distance(code: np.ndarray) -> int:
    """The fewest places in which two codewords differ."""
    if len(code) < 2:
        return 0
    inner = code.astype(np.int32) @ code.astype(np.int32).T
    return int((code.shape[1] - inner[~np.eye(len(code), dtype=bool)].max()) // 2)


class Windows:
    """Training windows: sparse gram frequencies, the language of each, and whether it only calibrates."""

    def __init__(self, texts: list[str], languages: list[int], seed: int = 5):
        rng = np.random.default_rng(seed)
        cut, self.language, aside = [], [], []
        seen: dict[int, int] = {}
        for text, language in zip(texts, languages, strict=True):
            seen[language] = seen.get(language, 0) + 1
            for size in WINDOWS:
                at = int(rng.integers(0, max(len(text) - size, 0) + 1))
                cut.append(text[at : at + size])
                self.language.append(language)
                aside.append(seen[language] % 4 == 0)
                if len(text) <= size:
                    break
        self.language, self.aside = np.array(self.language, np.int64), np.array(aside, bool)
        parts, _ = gram_buckets(cut)
        bucket, window = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
        key, times = np.unique((window << BUCKET_BITS) | bucket, return_counts=True)
        self.bucket = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int64)
        window = key >> BUCKET_BITS
        self.edges = np.searchsorted(window, np.arange(len(cut) + 1))
        total = np.bincount(window, weights=times, minlength=len(cut))
        self.value = (times / (total[window] + PRIOR)).astype(F32)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window (its place in `which`), bucket and value of some windows."""
        size = self.edges[which + 1] - self.edges[which]
        each = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(each)) + np.repeat(self.edges[which] - (np.cumsum(size) - size), size)
        return each, self.bucket[at], self.value[at]


def train_bit(windows: Windows, signs: np.ndarray, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias, and of each language the share of calibrating windows that the bit gets right; signs: a language's bit."""
    rng = np.random.default_rng(seed)
    weights, squares, bias, bias_square = np.zeros(1 << BUCKET_BITS, F32), np.full(1 << BUCKET_BITS, 1e-8, F32), 0.0, 1e-8
    target = signs[windows.language].astype(F32)
    learnt = np.flatnonzero(~windows.aside)
    for _ in range(EPOCHS):
        order = rng.permutation(learnt)
        for k in range(0, len(order), BATCH):
            which = order[k : k + BATCH]
            each, bucket, value = windows.rows(which)
            margin = GAIN * np.bincount(each, weights=weights[bucket] * value, minlength=len(which)) + bias
            slope = -target[which] / (1 + np.exp(np.clip(target[which] * margin, -50, 50)))
            used, place = np.unique(bucket, return_inverse=True)
            step = (GAIN * np.bincount(place, weights=slope[each] * value) / len(which) + DECAY * weights[used]).astype(F32)
            squares[used] += step * step
            weights[used] -= F32(RATE) * step / np.sqrt(squares[used])
            own = float(slope.mean())
            bias_square += own * own
            bias -= RATE * own / math.sqrt(bias_square)
    judged = np.flatnonzero(windows.aside)
    if not len(judged):
        judged = learnt
    each, bucket, value = windows.rows(judged)
    margin = GAIN * np.bincount(each, weights=weights[bucket] * value, minlength=len(judged)) + bias
    right = (margin * target[judged] > 0).astype(float)
    own = windows.language[judged]
    share = np.bincount(own, weights=right, minlength=len(signs)) / np.maximum(np.bincount(own, minlength=len(signs)), 1)
    return weights, bias, share


class Model:
    """languages, their codewords, the classifiers' weights (a row a bucket) and biases, and each bit's weight by language."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, biases: np.ndarray, shares: np.ndarray):
        self.languages, self.code, self.weights, self.biases = languages, code, weights, biases
        total = shares.sum(axis=1, keepdims=True)
        self.trust = np.where(total > 0, shares / np.where(total > 0, total, 1), 1 / max(code.shape[1], 1))
        self.corrects = max((least_distance(code) - 1) // 2, 0)

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What each classifier says of each text, and the texts' letters."""
        bits = self.code.shape[1]
        limit = max(HELD // max(bits, 1), 1 << 12)
        sums, grams, found = np.zeros((len(texts), bits)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []

        def flush() -> None:
            if not held:
                return
            own = np.array(owner)
            parts, count = gram_buckets(held)
            np.add.at(found, own, count)
            for bucket, doc in parts:
                if len(doc):
                    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    which = own[doc[begin]]
                    np.add.at(sums, which, np.add.reduceat(self.weights[bucket], begin, axis=0, dtype=np.float64))
                    np.add.at(grams, which, np.diff(np.append(begin, len(doc))))
            held.clear()
            owner.clear()

        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                held.append(text[at : at + PIECE])
                owner.append(k)
                size += len(held[-1]) + 1
                if size > min(limit, PIECE):
                    flush()
                    size = 0
        flush()
        return GAIN * sums / (grams + PRIOR)[:, None] + self.biases, found

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str | None], np.ndarray]:
        """Language, score, ambiguity, second-nearest language and distance of each text."""
        margins, found = self.margins(texts)
        n, count = len(texts), len(self.languages)
        if not count or not n:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool), [None] * n, np.zeros(n)
        bits = self.code.shape[1]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) if bits else np.zeros((n, count, 0))
        distance = (loss * self.trust[None]).sum(axis=2)
        order = np.argsort(distance, axis=1, kind="stable")
        best = order[:, 0]
        share = np.exp(-bits * (distance - distance.min(axis=1, keepdims=True)))
        score = (share / share.sum(axis=1, keepdims=True))[np.arange(n), best]
        wrong = (np.where(margins > 0, 1, -1) != self.code[best]).sum(axis=1)
        some = found > 0
        ambiguous = some & ((wrong > self.corrects) | (score < SURE))
        second = [self.languages[order[k, 1]] if some[k] and count > 1 else None for k in range(n)]
        return [self.languages[best[k]] if some[k] else UNDETERMINED for k in range(n)], np.where(some, score, 0.0), ambiguous, second, np.where(some, distance[np.arange(n), best], 0.0)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def training_sample(docs: DataFrame) -> list:
    """Rows (lang, text), see the sample above. Ids are drawn first, so that only the drawn texts leave the scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    counts = durable(labelled.groupBy("lang").agg(F.count("*").alias("rows")))
    languages = counts.count()
    if not languages:
        return []
    most = min(SAMPLE, max(LEAST, SAMPLE_ALL // languages))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40))
    # about four times as many as wanted pass by their draw alone, so that the ranking sees a bounded number of rows
    some = labelled.select("doc_id", "lang", draw.alias("draw")).join(F.broadcast(counts), "lang").filter(F.col("draw") * F.col("rows") <= F.lit(4.0 * most * (1 << 40)))  # a row a language
    some = some.groupBy("lang", "doc_id").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = durable(some.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "doc_id"))
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    texts = labelled.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "doc_id", F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))  # SAMPLE_ALL rows, or LEAST a language
    return texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").select("lang", "text").collect()


def fit(docs: DataFrame) -> Model:
    """The model of the labelled rows of docs; each bit is trained in a task of its own."""
    spark = docs.sparkSession
    sample = training_sample(docs)
    languages = sorted({r["lang"] for r in sample})
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, biases, shares = np.zeros((1 << BUCKET_BITS, bits), F32), np.zeros(bits), np.zeros((len(languages), bits))
    if bits:
        number = {x: k for k, x in enumerate(languages)}
        data = spark.sparkContext.broadcast(([r["text"] for r in sample], [number[r["lang"]] for r in sample]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = None
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    windows = windows or Windows(*data.value)
                    w, bias, share = train_bit(windows, code[:, b], b)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([bias]), pa.array([share.tolist()])], ["bit", "weights", "bias", "shares"])
            trim()

        dealt = spark.range(bits).repartitionById(bits, F.col("id").cast("int"))
        for r in dealt.mapInArrow(run, "bit int, weights binary, bias double, shares array<double>").collect():  # a row a bit of 2**BUCKET_BITS weights
            weights[:, r["bit"]], biases[r["bit"]], shares[:, r["bit"]] = np.frombuffer(r["weights"], F32), r["bias"], r["shares"]
    return Model(languages, code, weights, biases, shares)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, second and distance of each row; without a model it is fitted to docs."""
    fitted = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))
    names = ["doc_id", "lang_pred", "score", "ambiguous", "second", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            lang, score, ambiguous, second, distance = fitted.value.decode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous), pa.array(second, pa.string()), pa.array(distance)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    judged = source.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean, second string, distance double")
    return judged.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), *names[1:])
