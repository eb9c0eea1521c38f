"""Language identification, lexical search and whitening against brute force, planted cases and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.llm import language_id, lexical_search, registry, whitening
from tests.conftest import SMALL, same_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, term string, score string, segment string, pos string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- ranked lexical search


def ranked(docs, items, k=20):
    """Scores by the contract's formula, one document at a time."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        terms = TERM.findall((text or "").translate(LOWER))
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_search_awkward_rows(spark):
    docs = [(1, "Red fox, red HEN"), (2, "red"), (2, "red"), (3, None), (4, ""), (5, " .,;: "), (None, "red fox"), (7, "ÄÖ red \x00 ä日本 x1"), (8, "hen " * 5000 + "Ärger"), (9, "fox"), (10, "x" * 9000 + " fox " + "y" * 9000)]
    items = [(1, "red red Fox"), (1, "red red Fox"), (2, None), (3, "nothing here"), (None, "ÄÖ 日本 hen"), (4, "?!"), (5, "ä日本 x1 " + "x" * 9000)]
    got = lexical_search.search(spark.createDataFrame([(*d, "en", "t", "0", "s", "p") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "n") for i in items], "item_id long, text string, n_blocks string"))
    assert rows_of(got) == ranked(docs, items)
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(none, spark.createDataFrame(items, asked.schema)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "a", "en", "", "", "", "")], DOCS), asked).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None, "en", "", "", "", "")], DOCS), spark.createDataFrame(items, asked.schema)).count() == 0


@pytest.mark.parametrize("postings, segment, read, seed, item_bytes", [(4, 500, 64, 2, 1 << 20), (8, 3000, 1 << 12, 1, 300), (128, 1 << 20, 7, 50, 1 << 20)])
def test_lexical_search_small_blocks(spark, monkeypatch, postings, segment, read, seed, item_bytes):
    """Many small blocks and segments, several blocks of items, readings that cut texts, ties: the rows don't change."""
    for name, value in (("POSTINGS", postings), ("SEGMENT_TERMS", segment), ("READ_BYTES", read), ("SEED", seed), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = np.random.default_rng(4)
    words = np.array([f"wé{x}" if x % 7 == 0 else f"W{x}" for x in range(120)])
    docs = [(int(i), " ".join(words[np.minimum(rng.geometric(0.04, rng.integers(1, 80)), 119)])) for i in rng.permutation(260)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]
    items = [(i, " ".join(words[rng.integers(0, 120, rng.integers(1, 15))])) for i in range(25)]
    # the functions run in the workers as they are here
    terms = [ranked_in_process(docs, items, segment)]
    assert terms[0] == ranked(docs, items)


def ranked_in_process(docs, items, segment):
    """The operator's steps in this process, so that small parameters hold in them."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs])})
    held, segments, number = lexical_search.Postings(), [], 0
    for at in range(0, batch.num_rows, 17):
        part = batch.slice(at, 17)
        data, begin = lexical_search.texts_of(part.column(1))
        held.ids.append(part.column(0).to_numpy())
        for hashes, doc in lexical_search.term_hashes(data, begin):
            held.hashes.append(hashes)
            held.docs.append(doc + held.n_docs)
            held.n_terms += len(hashes)
        held.n_docs += len(begin) - 1
        if held.n_terms >= segment:
            segments.append(held.segment(number))
            number += 1
    if held.n_terms:
        segments.append(held.segment(number))
    rows = [s.to_pylist()[0] for s in segments]
    counts = lexical_search.Counts(sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows))
    for r in rows:
        s = lexical_search.Segment(r, counts)
        r["impacts"] = s.block_maxima().tobytes()
        full = [s.read(t, np.arange(int(s.blocks[t + 1] - s.blocks[t])))[1] for t in range(len(s.terms))]
        assert [x[k : k + lexical_search.POSTINGS].max() for x in full for k in range(0, len(x), lexical_search.POSTINGS)] == np.frombuffer(r["impacts"], "<u4").tolist()
    out = []
    for item, text in items:
        data, begin = lexical_search.texts_of(pa.array([text]))
        hashes = np.concatenate([h for h, _ in lexical_search.term_hashes(data, begin)])
        terms, times = np.unique(hashes, return_counts=True)
        best = lexical_search.Best(20, 1)
        segs = [lexical_search.Segment(r, counts) for r in rows]
        df = np.array([sum(int(s.df[np.flatnonzero(s.terms == t)].sum()) for s in segs) for t in terms])
        weights = times * np.array([counts.weight(n) if n else 0 for n in df.tolist()])
        for s in segs:
            at = np.minimum(np.searchsorted(s.terms, terms), len(s.terms) - 1)
            own = (s.terms[at] == terms) & (weights > 0)
            if own.any():
                lexical_search.search_segment(s, at[own], weights[own], best)
        out += [(item, r, i, sc) for r, (i, sc) in enumerate(zip(best.ids.tolist(), best.scores.tolist(), strict=True), 1)]
    return sorted(out, key=repr)


def test_lexical_search_skips_blocks():
    """With a threshold, blocks that can't matter are not decompressed."""
    docs = [(i, "common " * (0 if i % 5 == 3 else 1 + i % 3) + ("rare " if i in (700, 1500) else "filler ")) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs])})
    held = lexical_search.Postings()
    data, begin = lexical_search.texts_of(batch.column(1))
    held.ids.append(batch.column(0).to_numpy())
    for hashes, doc in lexical_search.term_hashes(data, begin):
        held.hashes.append(hashes)
        held.docs.append(doc)
        held.n_terms += len(hashes)
    held.n_docs = len(docs)
    row = held.segment(0).to_pylist()[0]
    counts = lexical_search.Counts(row["n_docs"], row["n_terms"])
    row["impacts"] = lexical_search.Segment(row, counts).block_maxima().tobytes()
    s = lexical_search.Segment(row, counts)
    asked = np.concatenate([h for h, _ in lexical_search.term_hashes(*lexical_search.texts_of(pa.array(["rare common"])))])
    at = np.searchsorted(s.terms, asked)
    weights = np.array([counts.weight(int(s.df[t])) for t in at])
    best = lexical_search.Best(2, int(weights[0] * 100_000))
    lexical_search.search_segment(s, at, weights, best)
    assert sorted(best.ids.tolist()) == [700, 1500]
    common = s.seen[int(at[1])][0]
    assert common.sum() <= 2 < len(common)


def test_lexical_search_against_sql(spark, duck):
    same_rows(registry.queries()["op12_lexical_search"](spark, SMALL), duck.execute(registry.oracle_sql()["op12_lexical_search"]).to_arrow_table())


# --- language identification


def test_language_id_held_out(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    unseen = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(unseen) > 150 and sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.99 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in got)
    for lang in "de", "en", "es", "fr":  # no language is traded for another
        own = [r for r in unseen if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in own) >= 0.95 * len(own)


def test_language_id_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score string, bits string"
    base = [(i, ("the and of with " if i % 2 else "der und das mit ") * (1 + i % 5), "en" if i % 2 else "de", "0", "b") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, " 12 !? \n", "xx"), (None, "the and of", "en"), (None, None, None), (104, "der und " * 120_000, None), (105, "of with", None), (105, "of with", None), (106, "日本", None), (107, "A", None), (108, "1a1", None)]
    docs = spark.createDataFrame(base + [(*r, "0", "b") for r in odd], schema).repartition(3)
    got = [tuple(r) for r in language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous").collect()]
    assert len(got) == 71
    by = {r[0]: r for r in got if r[0] is not None}
    assert all(by[i][2:] == ("und", 0.0, False) for i in (100, 101, 102))
    assert by[104][2] == "de" and by[105][2] == "en" and by[106][2] in ("de", "en", "xx") and by[108][2] != "und"
    assert sorted(r[2] for r in got if r[0] is None) == ["en", "und"] and not any(r[1] for r in got if r[0] is None)
    assert got.count(by[105]) == 2
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r) for r in unlabelled.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    single = language_id.identify(docs.filter("lang = 'en'")).filter("lang_pred != 'und'").collect()
    assert single and all(r["lang_pred"] == "en" and r["score"] == 1.0 for r in single)


def test_language_id_pieces(monkeypatch):
    """Pieces of long texts and chunks don't change what is read but at their edges."""
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], language_id.codewords(3), rng.standard_normal((1 << language_id.BUCKET_BITS, 3)).astype(np.float32), np.zeros(3), np.ones((3, 3)))
    texts = ["", "one two", "É là", "word und " * 3000]
    whole, found = model.margins(texts)
    assert found.tolist() == [0, 6, 3, 21000]
    monkeypatch.setattr(language_id, "PIECE", 999)
    parts, counted = model.margins(texts)
    assert np.abs(whole - parts).max() < 0.05 and counted.tolist() == found.tolist()
    one, _ = model.margins(texts[3:])
    assert np.allclose(one[0], parts[3])


def test_codewords():
    for n in range(2, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and all(len(set(c)) == 2 for c in code.T.tolist())
        assert language_id.least_distance(code) == min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
    assert language_id.codewords(4).shape[1] == 7 and language_id.codewords(5).shape[1] == 15
    assert language_id.least_distance(language_id.codewords(30)) >= 8


def test_decoding_corrects_a_bit():
    """One wrong bit of seven leaves the nearest codeword; two are flagged."""
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.zeros((1 << language_id.BUCKET_BITS, 7), np.float32), np.zeros(7), np.ones((4, 7)))
    for flips, flagged in (1, False), (2, True):
        margins = 4.0 * code[2].astype(float)
        margins[:flips] *= -1
        model.margins = lambda texts, m=margins: (m[None], np.ones(1, np.int64))
        lang, score, ambiguous, _, _ = model.decode(["x"])
        assert ambiguous[0] == flagged and (flags := lang == ["c"] or flagged) and flags and 0 < score[0] <= 1


# --- whitening


def whitened(vectors, k=32):
    """By numpy's eigenvectors: n, deviations, coordinates (up to sign), shares."""
    x = np.floor(64 * vectors) + 1_000_000
    n = len(x)
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    d = x * n - x.sum(axis=0)
    return [sum(int(v) ** 2 for v in row) for row in d.tolist()], c @ u / np.sqrt(e), e / (c * c).sum() * n


def test_whitening_against_numpy(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    want = whitened(np.array([r["embedding"] for r in rows], float))
    got = registry.queries()["op13_whitening"](spark, SMALL).orderBy("vec_id", "component").toPandas()
    assert len(got) == 32 * len(rows) and got["component"].tolist() == [*range(1, 33)] * len(rows) and set(got["n"]) == {len(rows)}
    w = got["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((w * want[1]).sum(axis=0))
    assert np.abs(w * sign - want[1]).max() < 1e-8
    assert got["deviation"].tolist() == np.repeat(want[0], 32).tolist()
    assert np.allclose(got["explained"].to_numpy()[:32], want[2], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_awkward_rows(spark):
    rng = np.random.default_rng(3)
    plain = [(i, [float(x) for x in rng.standard_normal(5)], 0) for i in range(50)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 5, 1), (103, [float("inf")] * 5, 1), (104, [1e30] * 5, 1), (None, [1.0, 2.0], None), (7, [0.5] * 5, 2), (7, [0.5] * 5, 2), (105, [], 1)]
    df = spark.createDataFrame(plain + odd, "vec_id long, embedding array<double>, component int").repartition(3)
    got = whitening.whiten(df)
    kept = np.array([v for _, v, _ in plain] + [[1.0, 2.0, 0, 0, 0], [0.5] * 5, [0.5] * 5, [0.0] * 5])
    want = whitened(kept, 5)
    rows = got.collect()
    assert len(rows) == 5 * len(kept) and {r["n"] for r in rows} == {len(kept)}
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(want[0])
    assert sorted(round(abs(r["whitened"]), 6) for r in rows) == sorted(np.abs(want[1]).round(6).ravel().tolist())
    assert sum(r["vec_id"] is None for r in rows) == 5 and sum(r["vec_id"] == 7 for r in rows) == 15 and not any(r["vec_id"] in (100, 101, 102, 103, 104) for r in rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 7 and component = 2")).count() == 0  # all equal: nothing to whiten
    flat = whitening.whiten(df.filter("component = 0").withColumn("embedding", F.expr("transform(embedding, (x, i) -> if(i < 3, x, 0.25D))"))).collect()
    assert {r["component"] for r in flat} == {1, 2, 3} and max(r["identity_error"] for r in flat) < 1e-8


def test_whitening_large_numbers(spark):
    """Beyond 64 bits the differences are whole numbers of any size, and a deviation is cut to the greatest long."""
    rows = [(i, [float(i) * 1e12, float(i % 3) * 1e6]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * a) + 1_000_000, int(64 * b) + 1_000_000] for _, (a, b) in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: min(sum((40 * a - b) ** 2 for a, b in zip(row, s, strict=True)), (1 << 63) - 1) for i, row in enumerate(x)}
    assert all(r["deviation"] == want[r["vec_id"]] for r in got) and {r["component"] for r in got} == {1}  # the second is 1e-12 of the first
    centre = whitening.Centre(40, s)
    assert centre.differences(np.array(x)).tolist() == [[40 * a - b for a, b in zip(row, s, strict=True)] for row in x]


@pytest.mark.parametrize("values", [np.arange(60, 0, -1.0), np.r_[np.full(20, 5.0), np.full(40, 1.0)], np.r_[9.0, 9.0, np.zeros(58)], np.r_[2.0 ** -np.arange(60)]])
def test_block_lanczos(values):
    """Against known spectra: spread, with multiplicities beyond the block, of low rank (breakdown), falling fast."""
    u = np.linalg.qr(np.random.default_rng(2).standard_normal((60, 60)))[0]
    v = (u * values) @ u.T
    got, axes, passes = whitening.block_lanczos(lambda q: v @ q, 60, 24, 4)
    assert np.allclose(got, np.sort(values)[::-1][:24], atol=1e-11 * values.max()) and passes <= 15
    assert np.allclose(axes.T @ axes, np.eye(24), atol=1e-12) and np.abs(v @ axes - axes * got).max() < 1e-11 * values.max()


def test_block_lanczos_stops_early():
    values = np.r_[100.0 * 0.5 ** np.arange(12), np.full(488, 1e-3)]
    u = np.linalg.qr(np.random.default_rng(6).standard_normal((500, 500)))[0]
    v = (u * values) @ u.T
    got, axes, passes = whitening.block_lanczos(lambda q: v @ q, 500, 8, 8)
    assert np.allclose(got, values[:8], rtol=1e-10) and passes < 20
