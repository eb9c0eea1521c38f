"""Quality rules: base rules on words and lines, and perplexity bands from a modified Kneser-Ney character model.

Model. One a language, over real code points: Spark counts the ORDER-grams of every distinct text of a language (a partial sum in each
task, then a grouped sum), so that a text's copies neither make it likelier nor move the bands, and derives from them, as joins and grouped sums over the distinct grams, the continuation counts of
the lower orders, three discounts a language and order from the counts of counts, and interpolated probabilities. Nothing is
folded, capped or sampled: the table of grams grows with the corpus and stays in Spark. Its file is sorted by the grams' 64-bit
hashes.

Copies. Rows get a number and are written once. By language and digest the least number stands for all copies; the numbers of the
others are broadcast up to BROADCAST_COPIES, beyond that the rows to count are found by a join. The plan differs, not the result.

Scoring. The HEAD_GRAMS most frequent grams at most are broadcast as sorted hash arrays (16 bytes a gram), searched from a
directory over the hashes' leading bits. A text's other grams leave the task as (hash, count) lists and meet the table in a
join on the hash, so that every gram of every text is scored by the whole model, whatever its size.

Bands. The mean log perplexity a character of every distinct text that passes the base rules goes into a histogram by language (bins of 0.005); its quartiles
give median and spread, and a text is rejected below median - LOWER * spread or above median + UPPER * spread.

Cases. Null and empty texts have no words and fail the base rules; a null language counts as ''. Very long texts are scored
whole, one at a time. Repeated rows are judged each for itself; a null doc_id stays null. An empty table gives an empty result.
Columns beyond doc_id, text and lang pass through `filter_documents` only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import BLANKS, U64, HashArray, Words, chunks, durable, forget, mix, portions, text_column, window_hashes

#: Code points of a gram, and bits of one; a gram is two longs: `lo` has its last three code points, `hi` those before.
ORDER, BITS, LOW = 5, 21, 3
#: Stands before and behind a text; no code point is so large.
EDGE = 0x110000
#: Grams that are broadcast at most, and distinct ones that a task gathers before it puts them out.
HEAD_GRAMS, GATHERED = 1 << 19, 1 << 20
SYMBOLS = "#*$%&|<>"
SYMBOL_CODES = np.array([ord(c) for c in SYMBOLS], dtype=np.uint32)
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Spreads below and above a language's median that are still kept, and the least spread.
LOWER, UPPER, LEAST_SPREAD = 4.0, 3.0, 0.03
BIN = 0.005
#: Rows a language (discounts, bands) are broadcast up to so many languages; more are joined by a shuffle. The plan differs, not the result.
BROADCAST_LANGUAGES = 10_000
#: Numbers of copied rows that are broadcast at most (8 bytes each).
BROADCAST_COPIES = 1 << 22

GRAMS = "lang string, hi long, lo long, n long"
FEATURES = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, log_p double, tail array<long>, tail_n array<int>"


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of all grams of the texts, each padded with ORDER - 1 edges before and one behind; and each text's first index."""
    pad = ORDER - 1
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths + pad + 1)])
    codes = np.frombuffer(("\0" * pad + ("\0" * (pad + 1)).join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    for k in range(pad):
        codes[begin[:-1] + k] = EDGE
    codes[begin[1:] - 1] = EDGE
    n = len(codes) - pad
    hi, lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(ORDER):
        part = hi if k < ORDER - LOW else lo
        part <<= BITS
        part |= codes[k : k + n]
    inside = np.ones(len(codes), dtype=bool)
    for k in range(pad):
        inside[begin[:-1] + k] = False
    inside = inside[pad:]
    return hi[inside], lo[inside], np.concatenate([[0], np.cumsum(lengths + 1)])


def language_seed(lang: str) -> np.uint64:
    """64 bits of the language's name."""
    return mix(window_hashes(np.frombuffer(f"{lang}\0".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64), len(lang) + 1))[0]


def gram_hashes(hi: np.ndarray, lo: np.ndarray, lang: str) -> np.ndarray:
    return mix(mix(hi.view(U64) + language_seed(lang)) ^ lo.view(U64) * U64(0x9E3779B97F4A7C15))


def by_language(texts: list[str], langs: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Numbers of the texts of each language, in chunks of bounded size."""
    where: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        where.setdefault(lang, []).append(k)
    for lang, own in where.items():
        for a, b in chunks([texts[k] for k in own]):
            yield lang, own[a:b]


class Gathered:
    """Distinct grams of one language in a task, by ascending hash, with their counts."""

    def __init__(self) -> None:
        self.keys, self.hi, self.lo, self.n = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        at = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        known = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
        self.n[at[known]] += n[known]
        new = found[~known]
        if len(new):
            at = np.minimum(np.searchsorted(new, keys), len(new) - 1)
            some = np.flatnonzero(new[at] == keys)
            first = np.empty(len(new), np.int64)
            first[at[some]] = some
            order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
            parts = ((self.keys, new), (self.hi, hi[first]), (self.lo, lo[first]), (self.n, n[~known]))
            self.keys, self.hi, self.lo, self.n = (np.concatenate(x)[order] for x in parts)


def gram_counter(copies=None):
    """mapInArrow function over (row, text, lang) to GRAMS of the task, each gram about once. copies: a broadcast ascending array of rows that don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Gathered] = {}

        def put() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(own.n), np.int64))), pa.array(own.hi), pa.array(own.lo), pa.array(own.n)], ["lang", "hi", "lo", "n"])
            held.clear()

        for batch in portions(batches):
            if copies is not None and len(copies.value):
                rows = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(copies.value, rows), len(copies.value) - 1)
                batch = batch.filter(pa.array(copies.value[at] != rows))
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lang, which in by_language(texts, langs):
                hi, lo, _ = text_grams([texts[k] for k in which])
                held.setdefault(lang, Gathered()).add(gram_hashes(hi, lo, lang), hi, lo)
            if sum(len(x.n) for x in held.values()) > GATHERED:
                yield from put()
        yield from put()

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and lang of docs, written: the numbers stay the same from here on."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    return durable(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column(docs), lang))


def copied_rows(source: DataFrame) -> DataFrame:
    """row of each copy of a text of one language but the first, written."""
    digests = source.select("row", "lang", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    firsts = digests.groupBy("lang", "digest").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1")
    return durable(digests.join(firsts, ["lang", "digest"]).filter("row != first").select("row"))


def hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n, log_p) of rows (lang, hi, lo, n, log_p)."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        number, hi, lo = langs.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        keys = np.zeros(batch.num_rows, U64)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = number == k
            keys[own] = gram_hashes(hi[own], lo[own], lang)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(3), batch.column(4)], ["hash", "n", "log_p"])


def few_languages(rows: DataFrame) -> DataFrame:
    """rows, one a language and order at most, for a join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LANGUAGES * ORDER else rows


def fit_model(source: DataFrame, copies: DataFrame, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """The ORDER-grams of all distinct texts: lang, hi, lo, n and log_p, the log probability of the last code point after the others.
    source, copies: of `numbered` and `copied_rows`."""
    rows = source.select("row", "text", "lang")
    if copies.count() <= broadcast_copies:
        known = source.sparkSession.sparkContext.broadcast(np.sort(copies.toArrow()["row"].to_numpy()))
        counted = rows.mapInArrow(gram_counter(known), GRAMS)
    else:
        counted = rows.join(copies.hint("merge"), "row", "left_anti").mapInArrow(gram_counter(), GRAMS)
    grams = {ORDER: durable(counted.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))}
    mask = lambda k: F.lit((1 << (BITS * k)) - 1)
    forget()
    for k in range(ORDER - 1, 0, -1):  # of the shorter gram that is left without the first code point: after how many code points it comes
        suffix = [F.col("hi").bitwiseAND(mask(max(k - LOW, 0))).alias("hi"), F.col("lo").bitwiseAND(mask(min(k, LOW))).alias("lo")]
        grams[k] = grams[k + 1].groupBy("lang", *suffix).agg(F.count("*").alias("n"))
        if k in (ORDER - 1, 2):  # the others are cheap to derive again
            grams[k] = durable(grams[k])
    stats = [grams[k].groupBy("lang").agg(F.lit(k).alias("k"), F.count("*").alias("kinds"), *(F.count_if(F.col("n") == c).alias(f"n{c}") for c in range(1, 5))) for k in grams]
    every = stats[0]
    for part in stats[1:]:
        every = every.unionByName(part)
    d = lambda c: F.least(F.greatest(F.when(F.col(f"n{c}") > 0, c - (c + 1) * F.col("y") * F.col(f"n{c + 1}") / F.col(f"n{c}")).otherwise(0.5), F.lit(0.1)), F.lit(float(c)))
    sound = (F.col("n1") > 0) & (F.col("n2") > 0)
    every = every.withColumn("y", F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)))
    discounts = few_languages(durable(every.select("lang", "k", "kinds", *(F.when(sound, d(c)).otherwise(0.5).alias(f"d{c}") for c in (1, 2, 3)))))
    model: DataFrame | None = None
    for k in range(1, ORDER + 1):
        one = grams[k].join(discounts.filter(F.col("k") == k).drop("k"), "lang")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", "hi", F.shiftright("lo", BITS))  # all code points but the last; groups of an alphabet's size at most
        p = one.select("lang", "hi", "lo", "n", "kinds", taken.alias("taken"), F.sum("n").over(context).alias("total"), F.sum(taken).over(context).alias("left"))
        if model is None:
            lower: Column = 1 / (F.col("kinds") + 1)
        else:
            suffix = [F.col("hi").bitwiseAND(mask(max(k - 1 - LOW, 0))).alias("s_hi"), F.col("lo").bitwiseAND(mask(min(k - 1, LOW))).alias("s_lo")]
            p = p.select("*", *suffix).join(model.select("lang", F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("p").alias("lower")), ["lang", "s_hi", "s_lo"])
            lower = F.col("lower")
        model = p.select("lang", "hi", "lo", "n", ((F.col("n") - F.col("taken") + F.col("left") * lower) / F.col("total")).alias("p"))
    return model.select("lang", "hi", "lo", "n", F.log("p").alias("log_p"))


def model_head(model: DataFrame, most: int = HEAD_GRAMS) -> HashArray:
    """The most frequent grams, `most` of them at most: from the least count on that leaves so few."""
    sizes = model.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("grams")).collect()  # 64 rows at most
    have, least = 0, 62
    for r in sorted(sizes, key=lambda r: -r["size"]):
        have += r["grams"]
        if have > most:
            break
        least = r["size"]
    got = model.filter(F.col("n") >= (1 << least)).select("hash", "log_p").toArrow()
    return HashArray(got["hash"].to_numpy().view(U64), got["log_p"].to_numpy())


def repeat_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text, its words in windows of REPEAT_WINDOW words that it holds twice or more."""
    out = np.zeros(len(first) - 1, dtype=np.int64)
    grams = window_hashes(words, REPEAT_WINDOW)
    if not len(grams):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: len(grams)] == doc[REPEAT_WINDOW - 1 :]
    tagged = (grams ^ (doc[: len(grams)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[whole]
    ranked = np.sort(tagged)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, tagged), len(twice) - 1)
    starts = np.flatnonzero(whole)[twice[at] == tagged]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(doc[covered], minlength=len(out)).astype(np.int64)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def scorer(model):
    """mapInArrow function over (row, doc_id, text, lang) to FEATURES; model: a broadcast HashArray. log_p is of the grams in it, tail has the others."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, langs = (batch.column(k).to_pylist() for k in (2, 3))
            n = len(texts)
            features, log_p, tails = np.zeros((6, n), np.int64), np.zeros(n), [([], [])] * n
            for a, b in chunks(texts):
                own = texts[a:b]
                words = Words(own)
                features[0, a:b] = words.counts
                features[1, a:b] = np.add.reduceat(np.append(~words.blank, False).astype(np.int64), words.doc_start[:-1])
                features[2, a:b] = np.add.reduceat(np.isin(words.codes, SYMBOL_CODES).astype(np.int64), words.doc_start[:-1])
                features[3, a:b] = [*map(duplicate_lines, own)]
                features[4, a:b] = repeat_words(words.hashes(), words.first)
            for lang, which in by_language(texts, langs):
                hi, lo, begin = text_grams([texts[k] for k in which])
                keys = gram_hashes(hi, lo, lang)
                value, known = model.value.get(keys)
                log_p[which] = np.add.reduceat(value, begin[:-1])
                features[5, which] = np.diff(begin)
                rest = np.flatnonzero(~known)
                for k, own in zip(*(x.tolist() for x in np.unique(np.searchsorted(begin, rest, "right") - 1, return_index=True)), strict=True):
                    own = keys[rest[own : np.searchsorted(rest, begin[k + 1])]]
                    tails[which[k]] = tuple(x.tolist() for x in np.unique(own.view(np.int64), return_counts=True))
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), *map(pa.array, features), pa.array(log_p), pa.array([t[0] for t in tails], pa.list_(pa.int64())), pa.array([t[1] for t in tails], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FEATURES.split(", ")])

    return score


def log_perplexities(source: DataFrame, model: DataFrame, most: int = HEAD_GRAMS) -> DataFrame:
    """Features and log_perplexity of source's rows (row, doc_id, text, lang); the model's table must be written."""
    head = source.sparkSession.sparkContext.broadcast(model_head(model, most))
    scored = durable(source.mapInArrow(scorer(head), FEATURES))
    tail = scored.filter(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.tail_n").alias("times"))
    rest = tail.join(model.select("hash", "log_p"), "hash").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("tail_log_p"))
    joined = scored.drop("tail", "tail_n").join(rest, "row", "left")
    return joined.withColumn("log_perplexity", -(F.col("log_p") + F.coalesce("tail_log_p", F.lit(0.0))) / F.col("n_grams")).drop("log_p", "tail_log_p", "n_grams")


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """lang, low, high from the histogram of scored texts that pass the base rules; a row a language."""
    bins = scored.filter("not base_failed").groupBy("lang", F.floor(F.col("log_perplexity") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy("lang")
    running = total.orderBy("bin")
    ranked = bins.select("lang", "bin", (F.sum("n").over(running) / F.sum("n").over(total)).alias("share"))
    at = lambda q: (F.min(F.when(F.col("share") >= q, F.col("bin"))) + 0.5) * BIN
    quartiles = ranked.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(LEAST_SPREAD))
    return quartiles.select("lang", (F.col("q2") - lower * spread).alias("low"), (F.col("q2") + upper * spread).alias("high"))


def judge_quality(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, most: int = HEAD_GRAMS, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """A row for each document: features, base_failed, log_perplexity, its language's band and kept."""
    source = numbered(docs)
    copies = copied_rows(source)
    model = durable(fit_model(source, copies, broadcast_copies).mapInArrow(hash_grams, "hash long, n long, log_p double").repartitionByRange("hash").sortWithinPartitions("hash"))
    forget()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = durable(log_perplexities(source, model, most).withColumn("base_failed", failed))
    distinct = scored.join(copies, "row", "left_anti")
    joined = scored.drop("row").join(few_languages(durable(bands(distinct, lower, upper))), "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.withColumn("kept", kept)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. A document's id stands for all rows that bear it."""
    kept = judge_quality(docs).groupBy("doc_id").agg(F.max("kept").alias("_kept")).filter("_kept").select(F.col("doc_id").alias("__kept_id"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]), "left_semi").select(*docs.columns)
