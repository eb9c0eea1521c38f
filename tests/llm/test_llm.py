"""Corpus operators against brute force, exact round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.llm import binary_output, bpe, near_dedup, packing, quality_rules, registry, substring_dedup, token_counts, tokens, topk_search, toxicity, url_filters
from offerlens.llm.common import durable
from tests.conftest import SMALL, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, spans string, score string, bucket string"


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with names the operators use themselves."""
    base = words(400)
    near = base.copy()
    near[200] = "changed"
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), None, "a"), (3, " ".join(near), "en", None), (4, None, "en", "a"), (5, "", "en", "a"), (6, " \n\t ", None, None),
        (None, " ".join(words(60, 1)), "en", "a"), (None, None, None, None), (7, "one two", "fr", "a"), (8, "word " * 30_000, "en", "a"), (9, "x" * 20_000, "en", "a"), (10, "a b\nc d\n\na b\na b", "xx", "b"),
        (11, "é ñ 日本 🙂 <|endoftext|> #$%\r\n" * 4, "en", "a"), (12, " ".join(words(50, 2)), "en", "a"), (12, " ".join(words(50, 2)), "en", "a"), (13, " ".join(words(30, 3) + base[100:160]), "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "n", "s", "0", "b") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, none, labels):
    pages = spark.createDataFrame([], "page_id long, url string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (toxicity.score_documents(none, labels), quality_rules.judge_quality(none), packing.pack_documents(none), token_counts.count_tokens(none), bpe.digest_documents(none), near_dedup.near_classes(none),
               binary_output.packed_sequences(none), substring_dedup.remove_repeats(none), url_filters.judge_urls(pages, url_filters.rule_frame(spark)), topk_search.search(vectors)):
        assert df.count() == 0
    for df in (toxicity.filter_documents(none, labels), quality_rules.filter_documents(none), near_dedup.dedup_documents(none), substring_dedup.dedup_documents(none)):
        assert df.columns == none.columns and df.count() == 0


def brute_features(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        covered.update(range(k, k + 8) if often[g] > 1 else ())
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_features(odd):
    got = quality_rules.judge_quality(odd).collect()
    have = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    want = []
    for key, text in texts_of(odd):
        f = brute_features(text)
        want.append((str(key), *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert have == sorted(want)
    assert quality_rules.filter_documents(odd).columns == odd.columns
    assert not any(r["kept"] for r in got if r["base_failed"])


def slow_kneser_ney(texts, order=quality_rules.ORDER):
    """Probability of a gram's last sign after the others, for each gram of the texts of one language; from counts in dicts."""
    signs = lambda t: ["^"] * (order - 1) + list(t) + ["$"]
    levels = {order: Counter(tuple(s[k : k + order]) for t in texts for s in [[("e",) if x in "^$" and (n < order - 1 or n == len(t) + order - 1) else x for n, x in enumerate(signs(t))]] for k in range(len(t) + 1))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    probability = {}
    for k in range(1, order + 1):
        n = Counter(levels[k].values())
        d = {c: 0.5 for c in (1, 2, 3)}
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = {c: min(max(c - (c + 1) * y * n[c + 1] / n[c] if n[c] else 0.5, 0.1), c) for c in (1, 2, 3)}
        total, left = Counter(), Counter()
        for g, c in levels[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        lower = (lambda g: probability[g[1:]]) if k > 1 else (lambda g: 1 / (len(levels[1]) + 1))
        probability |= {g: (c - d[min(c, 3)] + left[g[:-1]] * lower(g)) / total[g[:-1]] for g, c in levels[k].items()}
    return levels[order], probability


def slow_quality(rows):
    """(doc_id, log perplexity, kept) of rows (doc_id, text, lang), with the bands read from a sorted list of bins; model and bands count copies once."""
    out, fails = [], {}
    by = {}
    for n, (_, text, lang) in enumerate(rows):
        by.setdefault(lang or "", []).append(n)
        f = brute_features(text or "")
        fails[n] = f[0] < 20 or 100 * f[4] > 30 * f[0]
    for own in by.values():
        first = {rows[n][1] or "": n for n in reversed(own)}
        _, p = slow_kneser_ney(list(first))
        value = {}
        for n in own:
            grams, _ = slow_kneser_ney([rows[n][1] or ""])
            value[n] = -sum(c * np.log(p[g]) for g, c in grams.items()) / sum(grams.values())
        bins = sorted(int(np.floor(value[n] / quality_rules.BIN)) for n in first.values() if not fails[n])
        at = lambda q: (bins[int(np.ceil(q * len(bins))) - 1] + 0.5) * quality_rules.BIN
        for n in own:
            kept = not fails[n]
            if kept:
                spread = max((at(0.75) - at(0.25)) / 1.349, quality_rules.LEAST_SPREAD)
                kept = at(0.5) - quality_rules.LOWER * spread <= value[n] <= at(0.5) + quality_rules.UPPER * spread
            out.append((rows[n][0], round(value[n], 9), kept))
    return out


@pytest.mark.parametrize("most, copies", [(quality_rules.HEAD_GRAMS, 1 << 22), (300, 0), (0, 1 << 22)])
def test_quality_against_slow_kneser_ney(spark, odd, most, copies):
    """Perplexities and verdicts with the whole model broadcast, a part of it, or nothing; copies found by a broadcast or a join."""
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect() if len(r["text"] or "") < 10_000]
    for lang, parts in (("de", ["an", "be", "cor", "ß"]), ("es", ["el", "fo", "ñi", "日本", "🙂"])):
        rows += [(int(rng.integers(100, 999)), " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(25)), lang) for _ in range(40)]
        rows += [(k, " ".join("".join(rng.choice(list("qxzjkw79"), 6)) for _ in range(30)), lang) for k in range(2)]
        rows += [(900 + k, rows[-5][1], lang) for k in range(9)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, hash string, row int")
    got = [(r["doc_id"], r["log_perplexity"], r["kept"]) for r in quality_rules.judge_quality(docs, most=most, broadcast_copies=copies).collect()]
    want = slow_quality(rows)
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1])) for x in (got, want))
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want] and {r[2] for r in want} == {True, False}
    assert max(abs(x[1] - y[1]) for x, y in zip(got, want, strict=True)) < 2e-9


def test_kneser_ney_leaves_room(spark):
    """The probabilities of the signs that come after a context make one at most: the rest is left for unseen ones."""
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "a dog", "en"), (3, "", "en"), (4, "the hat", "de")], "doc_id long, text string, lang string")
    source = quality_rules.numbered(docs)
    total = quality_rules.fit_model(source, quality_rules.copied_rows(source)).groupBy("lang", "hi", F.shiftright("lo", quality_rules.BITS).alias("context")).agg(F.sum(F.exp("log_p")).alias("p")).collect()
    assert all(0 < r["p"] <= 1 + 1e-9 for r in total) and {r["lang"] for r in total} == {"en", "de"}


def test_quality_of_copied_texts(spark):
    """A hundred copies of a kept text are all kept, and no verdict or perplexity of another changes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    before = {r["doc_id"]: (r["kept"], round(r["log_perplexity"], 9)) for r in quality_rules.judge_quality(docs).collect()}
    one = docs.join(quality_rules.judge_quality(docs).filter("kept and lang = 'en'").select("doc_id"), "doc_id").orderBy("doc_id").first()
    copies = spark.createDataFrame([(10_000 + k // 2, one["text"], "en") for k in range(100)], docs.schema)  # ids twice, too
    after = quality_rules.judge_quality(docs.unionByName(copies)).collect()
    assert sum(r["doc_id"] >= 10_000 and r["kept"] for r in after) == 100
    assert {r["doc_id"]: (r["kept"], round(r["log_perplexity"], 9)) for r in after if r["doc_id"] < 10_000} == before


def test_quality_bands_reject_junk(spark):
    rng = np.random.default_rng(5)
    clean = [" ".join("".join(rng.choice(["an", "be", "cor", "den", "el"], rng.integers(1, 4))) for _ in range(80)) for _ in range(200)]
    junk = [" ".join("".join(rng.choice(list("qxzjkw79"), 6)) for _ in range(80)) for _ in range(4)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()}
    assert not kept & set(range(200, 204)) and len(kept) >= 197


def test_toxicity_learns_beginnings(spark):
    rng = np.random.default_rng(3)
    syllables = ["an", "be", "cor", "den", "el", "fo", "gi"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(600):
        own, bad = [word() for _ in range(60)], k % 4 == 0
        if bad:
            for at in rng.integers(0, 60, 4):
                own[at] = "zuv" + word()
        rows.append((k, " ".join(own)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "w" * 5000), (None, "zuvan " * 40)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, table).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got if k is not None) and not got[None]["held_out"]
    held = [k for k in range(600) if got[k]["held_out"]]
    right = sum(got[k]["predicted"] == (k % 4 == 0) for k in held)
    assert right >= 0.93 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[None]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.filter_documents(docs, table).filter("doc_id = 0").count() == 0


def test_toxicity_learns_from_every_toxic_text(monkeypatch):
    """All toxic texts give as many windows from the first pass on: marked ones, or those with the most evidence."""
    common = [" ".join(["an", "be", "cor"] * 30)] * 40
    marked = [" ".join((["an", "be", "cor"] * 11)[:31] + ["zuvxa"] + (["an", "be", "cor"] * 11)[:31] + ["zuvxa"] + ["an"] * 31 + ["zuvxa"])] * 20
    rare = [" ".join(["ra", "mil"] * 25 + [f"jurkha{k}"] + ["que"] * 50) for k in range(3)]
    seen = []
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, windows, labels, *rest: seen.append([x for x, y in zip(windows, labels, strict=True) if y == 1]))
    toxicity.train(marked + rare + common, [1] * 23 + [0] * 40)
    for drawn in seen:
        assert len(drawn) == toxicity.DRAWN * 23
        assert sum("zuvxa" in x for x in drawn) == toxicity.DRAWN * 20 and sum("ra" in x or "que" in x for x in drawn) == toxicity.DRAWN * 3
    assert all(any(f"jurkha{k}" in x for x in seen[0]) for k in range(3))


def slow_score(net, text):
    """The highest logit over all windows from every word on, step by step for one segment at a time."""
    words, w, best = toxicity.pieces(text), net.w, -np.inf
    size = toxicity.STATE

    def states(x, u):
        h, out = np.zeros(size), []
        for row in x:
            hu = h @ u
            z, r = (1 / (1 + np.exp(-(row[k * size : (k + 1) * size] + hu[k * size : (k + 1) * size]))) for k in (0, 1))
            c = np.tanh(row[2 * size :] + r * hu[2 * size :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    covered = set()
    for a in toxicity.segment_starts(len(words)):
        own = words[a : a + toxicity.SEGMENT]
        x = np.concatenate([net.word_inputs([v]) for v in own]).astype(float)
        h = np.concatenate([states(x[:, : 3 * size], w["wfu"]), states(x[::-1, 3 * size :], w["wbu"])[::-1]], axis=1)
        for k in range(max(len(own) - toxicity.WINDOW, 0) + 1):
            part = h[k : k + toxicity.WINDOW]
            e = np.exp((np.tanh(part @ w["a"]) @ w["av"])[:, 0])
            best = max(best, float(((e[:, None] * part).sum(axis=0) / e.sum() @ w["o"] + w["ob"])[0]))
            covered.add(a + k)
    assert covered == set(range(max(len(words) - toxicity.WINDOW, 0) + 1)) if words else not covered  # a window from every word on
    return best


def test_toxicity_scores_every_window(odd):
    net = toxicity.Network(3)
    rng = np.random.default_rng(4)
    for name, v in net.w.items():
        net.w[name] = (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32)
    net.vocabulary = {"w17": 1, "one": 2}
    texts = [t[:6000] for _, t in texts_of(odd)] + [" ".join(words(n, n)) for n in (1, 31, 32, 33, 127, 128, 129, 225, 300)]
    got, where = net.score(texts)
    for t, x, a in zip(texts, got.tolist(), where.tolist(), strict=True):
        want = slow_score(net, t)
        assert (x == want == -np.inf) or abs(x - want) < 1e-3
        assert 0 <= a <= max(len(toxicity.pieces(t)) - toxicity.WINDOW, 0)


def test_toxicity_of_odd_rows(odd, labels):
    """Repeated rows are scored alike, nulls stay null, columns named as the operator's own stay as they are."""
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score_documents(odd, labels).collect()]
    assert sorted(str(r[0]) for r in got) == sorted(str(k) for k, _ in texts_of(odd))
    assert len({r for r in got if r[0] == 12}) == 1 and all(r[1] == 0 for r in got if r[0] in (4, 5, 6))
    kept = toxicity.filter_documents(odd, labels)
    gone = {r[0] for r in got if r[2]}
    assert kept.columns == odd.columns and Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in odd.collect() if r["doc_id"] not in gone)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    args = (["ab", "c", "abcd"], np.array([[0, 1, 2], [2, 0, 0]]), np.array([3, 1]), np.array([1.0, 0.0]))

    def loss():
        out = net.best_windows(net.word_inputs(args[0]), np.pad(args[1], ((0, 0), (0, 13))), args[2])[0]
        return float(np.mean(np.log1p(np.exp(out)) - args[3] * out))

    g = net.step(*args, rng)
    for name in ("o", "a", "av", "wfu", "wbu", "wf", "cfu", "cbu", "cb", "char"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        step, w = 2e-2, net.w[name]
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-2 * max(abs(g[name][at]), 0.02), name


def test_packing(odd):
    rows = packing.pack_documents(odd).collect()
    encoder, want = tokens.encoder(tokens.tokenizer_path()), Counter()
    for key, text in texts_of(odd):
        ids = np.append(encoder.slow(text), np.uint32(0)).astype("<u4")
        want.update((key, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids))))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("seed", range(3))
def test_local_search_only_empties(seed):
    lengths = np.random.default_rng(seed).integers(1, 40, 120).tolist()
    first = packing.best_fit(lengths, 60)
    bins = packing.empty_bins([list(b) for b in first], lengths, 60)
    assert sorted(x for b in bins for x in b) == list(range(120)) and len(bins) <= len(first)
    assert all(sum(lengths[x] for x in b) <= 60 for b in bins) and len(bins) <= -(-sum(lengths) // 60) + 1


@pytest.mark.parametrize(("low", "high"), [(1, 101), (26, 101), (51, 100), (60, 61)])
def test_packing_in_many_groups(spark, low, high):
    """Groups of 40 pieces and as many rounds as save bins: each piece once, without gaps, in few sequences."""
    lengths = np.random.default_rng(low).integers(low, high, 700).tolist()
    rows = [(k, 0, 0, n, 7) for k, n in enumerate(lengths)]
    pieces = durable(spark.createDataFrame(rows, packing.PIECES))
    got = packing.pack_pieces(pieces, 100, 40).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == rows
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 100
    assert len(by) <= 1.06 * len(packing.best_fit(lengths, 100))  # so small groups cost a few hundredths


@pytest.mark.parametrize("rule", ["first", "largest"])
def test_token_counts(odd, rule):
    encoder = tokens.encoder(tokens.tokenizer_path())
    want = []
    for key, text in texts_of(odd):
        owner, starts = [], token_counts.line_starts(text).tolist()
        for n, c in enumerate(text):
            owner += [sum(s <= n for s in starts[-1:]) and len(starts) - 1 if n >= starts[-1] else next(k for k in range(len(starts)) if starts[k + 1] > n)] * len(c.encode())
        counts, crossing, at, chars = Counter(), Counter(), 0, [n for n, c in enumerate(text) for _ in c.encode()]
        for t in encoder.encode(text):
            size = len(encoder.vocabulary.tokens[t])
            first, last = chars[at], chars[at + size - 1]
            of = {c: owner[chars.index(c)] for c in range(first, last + 1)} if "\n" in text and size > 1 and owner[at] != owner[at + size - 1] else {first: owner[at]}
            held = Counter(of.values())
            s = of[first] if rule == "first" else max(held, key=lambda k: (held[k], -k))
            counts[s] += 1
            crossing[s] += owner[at] != owner[at + size - 1]
            at += size
        want += [(str(key), k, a, b, counts[k], crossing[k]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True))]
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.count_tokens(odd, rule=rule).collect()) == sorted(want)


def test_bpe_equals_the_library(odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path())
    want = []
    for key, text in texts_of(odd):
        ids = own.encode(text, add_special_tokens=False).ids
        want.append((str(key), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digest_documents(odd).collect()) == sorted(want)
    assert {r["decoded"] for r in bpe.encode_documents(odd).collect()} == {t for _, t in texts_of(odd)}
    assert bpe.bpe(tokens.tokenizer_path()).decode(np.array([250, 100])) == own.decode([250, 100], skip_special_tokens=False)


def brute_topk(vectors, width):
    """(query id, rank, id, score) by whole numbers of any size; every row but the query's own."""
    sound = [(n, k, [int(np.floor(np.float64(256) * np.float64(x))) for x in v] + [0] * (width - len(v))) for n, (k, v) in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, q, x in sound:
        if q is not None and q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), 1 << 62 if k is None else k, k) for m, k, y in sound if m != n)[:5]
            want += [(q, r + 1, k, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, _, k) in enumerate(best)]
    return sorted(map(str, want))


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.standard_normal(20).astype(np.float32).tolist()) for k in range(300)]
    vectors += [(300, vectors[50][1]), (301, vectors[50][1]), (350, None), (400, [float("nan")] * 20), (450, [1.0, None]), (500, []), (551, [0.5] * 3), (None, [0.1] * 20), (600, [float("inf")] * 20)]
    vectors += [(100, vectors[100][1]), (100, vectors[7][1])]  # repeated ids: each row is a query, and a candidate of the others
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, q_block int")
    want = brute_topk(vectors, 20)
    assert sorted(map(str, map(tuple, topk_search.search(df).collect()))) == want
    for name, value in (("CANDIDATE_BLOCK", 16), ("QUERY_BLOCK", 2), ("QUERY_GROUP", 4), ("SLICE_BLOCKS", 3)):  # many groups, slices and blocks
        monkeypatch.setattr(topk_search, name, value)
    assert sorted(map(str, map(tuple, topk_search.search(df).collect()))) == want


def test_topk_of_large_components(spark):
    big = np.float32(1e17).item()
    vectors = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0]), (3, [-big, 0.0]), (50, [1.0, 1.0]), (4, [0.25, 0.5]), (100, [3e38, -3e38]), (5, [big]), (6, [2.0**40, 1.0]), (7, [2.0**40, 2.0])]
    vectors = [(k, [np.float32(x).item() for x in v]) for k, v in vectors]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(map(str, map(tuple, topk_search.search(df).collect()))) == brute_topk(vectors, 2)


@pytest.mark.parametrize("numbers", [[0, 1, -1, 9, 10, -9, -10, 99, -99, 10**30, -(10**30), 123, -123, 2**63]])
def test_digits_sort_as_numbers(numbers):
    assert sorted(numbers, key=topk_search.digits) == sorted(numbers)


def test_near_classes(odd, spark):
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(odd).collect()]
    by = dict(got)
    assert by[1] == by[2] == by[3] == 1 and got.count((12, 12)) == 2 and all(by[k] == k for k in (4, 5, 6, 7, 8, 9, 10, 11, 13))
    kept = near_dedup.dedup_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None, None])


def true_vectors(texts, of_text=None):
    """Hashes and weights of distinct texts by the true document frequencies of their shingles; of_text: how many documents have a text."""
    counted = [near_dedup.shingle_counts([t]) for t in texts]
    times = [1] * len(texts) if of_text is None else [of_text[t] for t in texts]
    keys, place = np.unique(np.concatenate([c[1] for c in counted]), return_inverse=True)
    n = np.bincount(place, weights=np.repeat(times, [len(c[1]) for c in counted])).astype(int)
    edges = np.cumsum([0, *(len(c[1]) for c in counted)])
    documents = sum(times)
    return [(c[1], (1 + np.log(c[2])) * (1 + near_dedup.IDF_SHARE * np.log(documents / n[place[a:b]]) / np.log(documents))) for c, a, b in zip(counted, edges[:-1], edges[1:], strict=True)]


def test_near_classes_of_a_drifting_group(spark, monkeypatch):
    """A large bucket whose texts are alike only step by step: classes equal those of all pairs; with exact=True so do the links' numbers."""
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 9000)
    rng, own, rows = np.random.default_rng(2), words(150, 9), []
    for k in range(60):
        rows.append((k, " ".join(own)))
        own = own.copy()
        own[rng.integers(0, 150)] = f"new{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = true_vectors([t for _, t in rows])
    root, n_links = list(range(60)), Counter()
    for i in range(60):
        for j in range(i):
            if near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8:
                n_links.update((i, j))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    quick, exact = near_dedup.near_classes(docs).collect(), near_dedup.near_classes(docs, exact=True).collect()
    assert {r["doc_id"]: r["class_id"] for r in quick} == dict(enumerate(root)) == {r["doc_id"]: r["class_id"] for r in exact}
    full = {r["doc_id"]: r["n_links"] for r in exact}
    assert all(r["n_links"] <= full[r["doc_id"]] for r in quick)
    assert all(full[k] <= n_links[k] for k in full) and sum(full.values()) >= 0.97 * n_links.total()  # a link without a common bucket is not met


@pytest.mark.parametrize("table, size, least", [("sf0.01", 1 << 22, 0.99), ("sf0.01", 9000, 0.99), ("sf0.1", 1 << 22, 0.95)])
def test_document_frequencies(spark, monkeypatch, table, size, least):
    """Exact for every shingle, whatever the segments; weights go with the logarithm of the inverse frequency at every size of the corpus."""
    monkeypatch.setattr(near_dedup, "SEGMENT_BYTES", size)
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    rows = near_dedup.nodes(docs).filter("node is not null")
    segments = durable(rows.select("text", "node").mapInArrow(near_dedup.make_segments, near_dedup.SEGMENT))
    texts = [t for _, t in texts_of(docs) if WORD.search(t)]
    keys, true = np.unique(np.concatenate([near_dedup.shingle_counts([t])[1] for t in texts]), return_counts=True)
    assert segments.agg(F.sum(F.expr("aggregate(copies, 0L, (a, x) -> a + x)"))).first()[0] == len(texts)
    seen = 0
    for r in segments.join(near_dedup.document_frequencies(segments), "segment").select("lengths", "texts", "answers").collect():
        own = np.unique(near_dedup.segment_shingles(near_dedup.texts_of_segment(r["lengths"], r["texts"]))[1])
        got = np.concatenate([near_dedup.stretched(a["frequencies"]) for a in r["answers"]])
        assert np.array_equal(got, true[np.searchsorted(keys, own)])
        seen += len(own)
    assert seen >= len(keys)
    weights = near_dedup.weigh(np.ones(len(true)), true, len(texts))
    assert weights.min() >= 1 and weights.max() <= 1 + near_dedup.IDF_SHARE and np.corrcoef(weights, np.log(len(texts) / true))[0, 1] > least


def test_long_texts_weigh_alike(spark):
    """Texts of over 10,000 characters follow the same rule."""
    docs = spark.createDataFrame([(k, " ".join([*words(40, 1), *words(2500, 50 + k)])) for k in range(30)], "doc_id long, text string")
    rows = near_dedup.nodes(docs)
    segments = durable(rows.select("text", "node").mapInArrow(near_dedup.make_segments, near_dedup.SEGMENT))
    one = segments.join(near_dedup.document_frequencies(segments), "segment").select("lengths", "answers").first()
    got = Counter(np.concatenate([near_dedup.stretched(a["frequencies"]) for a in one["answers"]]).tolist())
    assert min(one["lengths"]) > 10_000 and got[30] >= 36 and got[1] > 400


def test_near_classes_of_a_table(spark):
    """Classes of a driver table against all pairs of its distinct texts that share a shingle, by the true frequencies; exact or not."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = texts_of(table)
    of_text = Counter(t for _, t in rows)
    texts = sorted({t for _, t in rows if WORD.search(t)})
    vectors = true_vectors(texts, of_text)
    keys, owner = np.concatenate([k for k, _ in vectors]), np.repeat(np.arange(len(vectors)), [len(k) for k, _ in vectors])
    order = np.lexsort((owner, keys))
    pairs, begin = set(), np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0, [True]]))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        own = owner[order[a:b]].tolist()
        pairs.update((x, y) for n, y in enumerate(own) for x in own[:n])
    links = [(texts[x], texts[y]) for x, y in pairs if near_dedup.weighted_jaccard(vectors[x], vectors[y]) >= 0.8]
    got = near_dedup.near_classes(table).collect()
    of = {r["doc_id"]: r["class_id"] for r in got}
    exact = near_dedup.near_classes(table, exact=True).collect()
    assert {r["doc_id"]: r["class_id"] for r in exact} == of
    by_text: dict = {}
    for key, t in rows:
        by_text.setdefault(t, set()).add(of[key])
    assert all(len(by_text[t]) == 1 for t in texts)  # copies
    assert len(links) > 30 and sum(by_text[x] == by_text[y] for x, y in links) >= 0.95 * len(links)
    true_n = Counter(t for pair in links for t in pair)
    text_of = dict(rows)
    assert all(r["n_links"] <= true_n[text_of[r["doc_id"]]] for r in exact)
    assert sum(r["n_links"] == true_n[text_of[r["doc_id"]]] for r in exact) >= 0.999 * len(exact)
    root = {t: t for t in texts}
    for x, y in links:
        a, b = root[x], root[y]
        root = {t: min(a, b) if r in (a, b) else r for t, r in root.items()}
    whole: dict = {}
    for t in texts:
        whole.setdefault(next(iter(by_text[t])), set()).add(root[t])
    assert all(len(r) == 1 for r in whole.values())  # no class holds texts that no chain of links joins


@pytest.mark.parametrize("groups", [64, 96, 7])
def test_rows_are_dealt_evenly_over_groups(spark, groups):
    """Many partitions of a few rows fill all groups alike, for powers of two, too."""
    from offerlens.llm.common import group_of_row

    rows = spark.range(0, 3000, 1, 600).select(group_of_row(groups).alias("g")).groupBy("g").count().collect()
    sizes = [r["count"] for r in rows]
    assert len(rows) == groups and max(sizes) <= 1.35 * 3000 / groups and min(sizes) >= 0.65 * 3000 / groups


def test_many_groups_pack_as_one(spark):
    """Packed in many groups from many tiny partitions, the sequences are within a fiftieth of one group's."""
    rng = np.random.default_rng(8)
    pieces = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(20, 1500, 1200))]
    table = durable(spark.createDataFrame(pieces, packing.PIECES).repartition(200))
    bins = [packing.pack_pieces(table, group_size=g).select("sequence_id").distinct().count() for g in (300, 6000)]
    assert bins[0] <= 1.02 * bins[1], bins


def test_packed_sequences(odd):
    ids = {}
    for r in binary_output.packed_sequences(odd).collect():
        row, edges = np.frombuffer(r["ids"], "<u4"), r["cu_seqlens"]
        assert len(row) == 2048 and edges[0] == 0 and edges[-1] == r["n_tokens"] and r["position_resets"] == edges[:-1]
        for key, piece, a, b in zip(r["doc_ids"], r["pieces"], edges, edges[1:], strict=False):
            ids.setdefault((key, piece), []).append(row[a:b].tolist())
    encoder = tokens.encoder(tokens.tokenizer_path())
    have = Counter(tuple(sum((ids[key, p].pop() for p in range(len(packing.cut(n)))), [])) for key, n in [(k, len(encoder.encode(t)) + 1) for k, t in texts_of(odd) if k is not None])
    assert have == Counter((*encoder.encode(t).tolist(), 0) for k, t in texts_of(odd) if k is not None)


def test_sequences_are_few_whatever_the_partitions(spark):
    """Many small partitions cost no sequences: as few as best-fit-decreasing makes of all pieces in one place, or nearly."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encoder = tokens.encoder(tokens.tokenizer_path())
    lengths = [n for _, t in texts_of(docs) for _, n in packing.cut(len(encoder.encode(t)) + 1, 256)]
    best = len(binary_output.pack(lengths, 256))
    for partitions, group in ((1, 6000), (40, 6000), (40, 100)):
        got = binary_output.packed_sequences(docs.repartition(partitions), capacity=256, group_size=group)
        counted = got.agg(F.count("*"), F.count_distinct("sequence_id"), F.sum("n_tokens")).first()
        assert counted[0] == counted[1] and counted[2] == sum(lengths) and counted[0] <= 1.01 * best + 1, (partitions, group, counted, best)


def test_room_tree():
    rng = np.random.default_rng(0)
    tree, have = binary_output.RoomTree(50), []
    for k in range(500):
        if rng.random() < 0.6:
            r = int(rng.integers(0, 51))
            tree.add(r, k)
            have.append(r)
        least = int(rng.integers(0, 51))
        fits = sorted(r for r in have if r >= least)
        got = tree.take(least)
        assert (got[0] if got else None) == (fits[0] if fits else None)
        if got:
            have.remove(got[0])


@pytest.mark.parametrize("least", [substring_dedup.HOT_LEAST, 1])
def test_substring_dedup(odd, least, monkeypatch):
    """With strings as they are, and with the windows of all repeated minimisers one by one."""
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
    monkeypatch.setattr(substring_dedup, "SHARES", 2 if least > 1 else 0)
    docs = sorted(((1 << 62 if k is None else k, k, WORD.findall(t)) for k, t in texts_of(odd)), key=lambda x: x[0])
    first, want = {}, []
    for at, key, w in docs:
        gone = set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), at) < at:
                gone.update(range(k, k + 13))
        want.append((str(key), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r[0]), *r[1:]) for r in substring_dedup.remove_repeats(odd).collect()) == sorted(want)
    out = substring_dedup.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[13] == " ".join(words(30, 3))


URLS = ["http://a.example.net/en/x", "https://EXAMPLE.NET/de/", "https://b.example.com/de/1?x#y", "https://x.org/fr/", "https://x.org/frz", "https://net/", "http://fake-net/", "no url", None, "", "://", "https://example.net", "http://h?://net/", "x://a.net/\nb", "https://example.com/de"]


URLS += ["http://ads-track.example.com/x", "http://m.ADS-track.example.org/en/", "http://bads-track.a.com/", "http://x.com/ads-track.", "http://a.com/casino", "http://a.com/casino/2?history", "http://a.com/casinos/", "http://a.com/a.exe", "http://a.com/a.exe?x", "ftp://a.com/",
         "http://a.com/x-casino/", "http://a.com/?poker=1&q=bonusx", "http://adserver7.a.com/", "casino", "http://a.com/cart#x", "http://a.com/carts", "http://example.org/fr/casino/", "http://a.com/" + "y" * 5000 + "/xxx/"]


def brute_pattern(url, patterns):
    """The winning (pattern, verdict), matched sign by sign with back-tracking instead of a regular expression."""
    url = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    separator = lambda c: not (c in "_.%-" or "a" <= c <= "z" or "0" <= c <= "9")

    def fits(p, at):
        if not p:
            return True
        if p == "|":
            return at == len(url)
        if p[0] == "*":
            return any(fits(p[1:], k) for k in range(at, len(url) + 1))
        if p[0] == "^":
            return (at == len(url) and fits(p[1:], at)) or (at < len(url) and separator(url[at]) and fits(p[1:], at + 1))
        return at < len(url) and url[at] == p[0] and fits(p[1:], at + 1)

    def found(p):
        if p.startswith("||"):
            m = re.match(r"[a-z][a-z0-9+.-]*://", url)
            host = re.match(r"[^/?#]*", url[m.end() :]).group() if m else ""
            return bool(m) and any(fits(p[2:], m.end() + k) for k in range(len(host) + 1) if k == 0 or host[k - 1] == ".")
        if p.startswith("|"):
            return fits(p[1:], 0)
        return any(fits(p, k) for k in range(len(url) + 1))

    return min((r for r in patterns if found(r[0])), key=lambda r: (-len(r[0]), r[0]), default=None)


def test_url_filters(spark, monkeypatch):
    df = spark.createDataFrame([(k, u, "h", "t") for k, u in enumerate(URLS)] + [(1, URLS[1], "h", None), (None, URLS[0], "h", "t")], "page_id long, url string, host string, tokens string")
    patterns = [*url_filters.DEFAULT_PATTERNS, ("asin", "block")]  # the last one has no complete token

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filters.DEFAULT_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = min(fits, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), default=None)
        other = None if best else brute_pattern(u, patterns)
        return host, path, best and best[0] + best[1], best[2] if best else other[1] if other else "allow", other and other[0]

    want = sorted(str((r["page_id"], *brute(r["url"]))) for r in df.collect())
    judge = lambda: sorted(map(str, map(tuple, url_filters.judge_urls(df, url_filters.rule_frame(spark), url_filters.pattern_frame(spark, patterns)).collect())))
    assert judge() == want
    monkeypatch.setattr(url_filters, "LITERAL_RULES", 1)
    assert judge() == want


@pytest.mark.parametrize("name", ["op6_topk_search", "op9_substring_dedup", "op10_url_filters"])
def test_queries_against_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, SMALL), duck.execute(registry.oracle_sql()[name]).to_arrow_table())


def test_fast_ids_are_the_library_s():
    """Every text of a driver table: the fast encoder of op3, op4 and op8 gives the ids of the tokenizers library."""
    import pyarrow.parquet as pq

    encoder = tokens.encoder(tokens.tokenizer_path())
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert encoder._fast is not None and len(texts) == 1000
    assert all(np.array_equal(encoder.encode(t), encoder.slow(t)) for t in texts)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none):
    """Each stage takes nulls in any column, empty and long texts, repeated rows, no rows, and columns with names of its own."""
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = durable(stage(spark, docs, SMALL))
            assert out.count() <= docs.count() or name == "best_fit_packing"
            assert out.columns == docs.columns or name == "best_fit_packing"
            docs = out


def test_pipeline(spark):
    """Each stage against brute force on its own input; the whole is what the stages give one after the other."""
    import corpus_pipeline
    from offerlens.llm.common import table

    docs, seen = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, SMALL))
        seen.append((name, docs, out))
        docs = out
    assert [n for n, _, _ in seen] == ["quality_rules", "toxicity", "near_dedup", "substring_dedup", "best_fit_packing"]
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns
    (_, start, good), (_, _, clean), (_, _, unique), (_, _, left), (_, _, packed) = seen
    base = {k for k, t in texts_of(start) if (f := brute_features(t))[0] < 20 or 100 * f[4] > 30 * f[0]}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert not ids(good) & base and len(ids(good)) >= 0.8 * len(ids(start) - base)
    predicted = {r["doc_id"] for r in toxicity.score_documents(good, table(spark, SMALL, "labels")).filter("predicted = 1").collect()}
    assert ids(clean) == ids(good) - predicted
    assert len({t for _, t in texts_of(unique)}) == unique.count()
    assert ids(left) == ids(unique) == ids(packed)
    seen_windows = {}
    for key, t in sorted(texts_of(unique)):
        for k in range(len(w := WORD.findall(t)) - 12):
            seen_windows.setdefault(tuple(w[k : k + 13]), key)
    kept = dict(texts_of(left))
    for key, t in texts_of(unique):
        w, gone = WORD.findall(t), set()
        for k in range(len(w) - 12):
            if seen_windows[tuple(w[k : k + 13])] < key:
                gone.update(range(k, k + 13))
        assert WORD.findall(kept[key]) == [x for k, x in enumerate(w) if k not in gone]
