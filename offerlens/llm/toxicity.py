"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

Inputs. A text is its words in lower case, those of over PIECE characters cut into pieces. A word's input is a word vector (of
the up to WORDS words that are in WORD_TEXTS texts to learn from or more; zero for all others) beside the two final states of
a gated recurrent pair that reads its characters. A second pair reads the words.

Windows. All windows of WINDOW words are scored, one from every word on: the recurrent pair reads segments of SEGMENT words, which
overlap by a window less one word, and attention pools the states of each window to one logit. Attention weights and their
products with the output vector are summed up along the segment, so that a window costs two subtractions, not a reading of its
own. A text's score is its highest window's, on a scale calibrated so that 0.7 lies between the classes of the training rows.

Training. On a bounded sample of labelled rows, SAMPLE of each class at most, drawn by hash of the id among those of up to
SAMPLE_CHARS characters; held-out rows (crc32 of the id as text, modulo 3, is 1) are never among them. Labels hold for whole
texts, so that training takes windows of toxic texts with words that are significant for the label; of a toxic text without
such words the windows with the most evidence from the other toxic texts, however weak, and then the one the network itself
scores highest, too. So every toxic text is learnt from, whatever its language's share of the sample. Scores read the text alone.

Cases. Null and empty texts and texts without a word score 0; very long texts are scored whole. Without rows of both classes to
learn from all texts score 0. Repeated rows are scored each for itself; a null doc_id is not held out and stays null. An empty
table gives an empty result. Columns beyond doc_id and text are ignored by `score_documents` and kept by `filter_documents`,
whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import BLANKS, chunks, durable, portions, text_column

WINDOW, SEGMENT, PIECE = 32, 128, 24
#: Words from one training window of a text to the next.
STEP = 16
CHARS, CHAR_SIZE, CHAR_STATE = 128, 8, 8
WORDS, WORD_TEXTS, WORD_SIZE, STATE, ATTENTION = 4096, 5, 8, 10, 8
#: Labelled rows of each class to learn from, at most, and the longest text they are drawn from.
SAMPLE, SAMPLE_CHARS = 700, 12_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Windows that a toxic text without significant words is learnt from at first; windows drawn from a toxic text for a pass over all.
STRONGEST, DRAWN = 3, 4
#: Lengths of the word beginnings that tell toxic texts apart.
BEGINNINGS = (4, 5, 6, 7)
ROUNDS, EPOCHS, BATCH, RATE = 4, 2, 96, 0.015
#: Distinct words whose inputs a worker keeps; segments that are read at once, and the step of their padded lengths.
CACHE_WORDS, BLOCK, PADDED = 150_000, 512, 16

F32 = np.float32
_BLANKS = str.maketrans(dict.fromkeys(BLANKS, " "))


def pieces(text: str) -> list[str]:
    words = [w for w in text.lower().translate(_BLANKS).split(" ") if w]
    if len(text) <= PIECE or max(map(len, words), default=0) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


def window_starts(n: int) -> range:
    return range(0, max(n - WINDOW, 0) + STEP if n > WINDOW else 1, STEP) if n else range(0)


def segment_starts(n: int) -> list[int]:
    """First words of the segments of n words: together they hold every window; the last one ends with the text."""
    return [*range(0, n - SEGMENT, SEGMENT - WINDOW + 1), n - SEGMENT] if n > SEGMENT else [0] * (n > 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


class Gru:
    """One direction. Inputs come projected: z, r and candidate parts side by side."""

    @staticmethod
    def run(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool = False):
        """x: steps, rows, 3 * size; mask: steps, rows (None: all count). All states with the first zero; and what backward needs."""
        steps, rows, size = x.shape[0], x.shape[1], u.shape[0]
        states = np.zeros((steps + 1, rows, size), F32)
        saved = []
        for t in range(steps):
            h = states[t]
            hu = h @ u
            gate = x[t, :, : 2 * size] + hu[:, : 2 * size]
            gate = sigmoid(gate)
            z, r = gate[:, :size], gate[:, size:]
            c = np.tanh(x[t, :, 2 * size :] + r * hu[:, 2 * size :])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            states[t + 1] = new
            if keep:
                saved.append((z, r, c, hu[:, 2 * size :]))
        return states, saved

    @staticmethod
    def back(d_states: np.ndarray, states: np.ndarray, saved: list, mask: np.ndarray, u: np.ndarray):
        """Gradients of the projected inputs and of u, from those of all states."""
        steps, rows, size = len(saved), states.shape[1], u.shape[0]
        dx, du, dh = np.zeros((steps, rows, 3 * size), F32), np.zeros_like(u), np.zeros((rows, size), F32)
        for t in range(steps - 1, -1, -1):
            dh = dh + d_states[t + 1]
            z, r, c, hc = saved[t]
            h, m = states[t], mask[t][:, None]
            live = np.where(m, dh, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], axis=1)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = np.where(m, live * z + dhu @ u.T, dh)
        return dx, du


def backwards(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that turn the first `lengths` of each row's steps (axis 0) around."""
    t = np.arange(x)[:, None]
    return np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)


class Network:
    """Weights and their use. Words are known by number in a table of distinct pieces."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(F32)
        x = WORD_SIZE + 2 * CHAR_STATE
        self.w = {
            "char": (rng.standard_normal((CHARS, CHAR_SIZE)) * 0.5).astype(F32), "word": np.zeros((WORDS + 1, WORD_SIZE), F32),
            "cf": w(CHAR_SIZE, 3 * CHAR_STATE), "cb": w(CHAR_SIZE, 3 * CHAR_STATE), "cfu": w(CHAR_STATE, 3 * CHAR_STATE), "cbu": w(CHAR_STATE, 3 * CHAR_STATE),
            "wf": w(x, 3 * STATE), "wb": w(x, 3 * STATE), "wfu": w(STATE, 3 * STATE), "wbu": w(STATE, 3 * STATE),
            "wfb": np.zeros(3 * STATE, F32), "wbb": np.zeros(3 * STATE, F32),
            "a": w(2 * STATE, ATTENTION), "av": w(ATTENTION, 1), "o": w(2 * STATE, 1), "ob": np.zeros(1, F32),
        }
        self.scale, self.shift = 1.0, 0.0
        self.vocabulary: dict[str, int] = {}

    # -- words from characters

    @staticmethod
    def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character numbers (steps, words) and lengths."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        number = np.where(codes < 96, codes, 96 + codes.astype(np.uint64) * 40503 % 32).astype(np.int64) % CHARS
        number = np.where((codes >= 96) & (codes < 128), codes - 96, number)  # lower-case letters take the places of control characters
        out = np.zeros((int(lengths.max()), len(words)), dtype=np.int64)
        start = np.cumsum(lengths) - lengths
        out[np.arange(len(codes)) - np.repeat(start, lengths), np.repeat(np.arange(len(words)), lengths)] = number
        return out, lengths

    @staticmethod
    def bare(word: str) -> str:
        return word.strip(".,;:!?\"'()|")

    def buckets(self, words: list[str]) -> np.ndarray:
        """Rows of the word vectors; row 0 stays zero."""
        return np.fromiter((self.vocabulary.get(self.bare(w), 0) for w in words), dtype=np.int64, count=len(words))

    def word_inputs(self, words: list[str]) -> np.ndarray:
        """Projected inputs of both directions, a row a word. Words of one length are read together."""
        w = self.w
        out = np.empty((len(words), WORD_SIZE + 2 * CHAR_STATE), F32)
        out[:, :WORD_SIZE] = w["word"][self.buckets(words)]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        forward, backward = w["char"] @ w["cf"], w["char"] @ w["cb"]
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            for at in range(0, len(which), 2 * BLOCK):
                some = which[at : at + 2 * BLOCK]
                chars, _ = self.spell([words[k] for k in some.tolist()])
                out[some, WORD_SIZE : WORD_SIZE + CHAR_STATE] = Gru.run(forward[chars], None, w["cfu"])[0][-1]
                out[some, WORD_SIZE + CHAR_STATE :] = Gru.run(backward[chars[::-1]], None, w["cbu"])[0][-1]
        return np.concatenate([out @ w["wf"] + w["wfb"], out @ w["wb"] + w["wbb"]], axis=1)

    def best_windows(self, inputs: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest logit of all windows of each segment and the window's first word. rows: word numbers, padded behind the length."""
        w, best, where = self.w, np.empty(len(rows)), np.zeros(len(rows), dtype=np.int64)
        padded = -(-lengths // PADDED) * PADDED
        for steps in np.unique(padded).tolist():
            which = np.flatnonzero(padded == steps)
            for at in range(0, len(which), BLOCK):
                some = which[at : at + BLOCK]
                n, words = lengths[some], rows[some, :steps].T
                turned = backwards(steps, n)
                f = Gru.run(inputs[words, : 3 * STATE], None, w["wfu"])[0][1:]  # what stands behind a row's length is not used
                b = Gru.run(inputs[np.take_along_axis(words, turned, axis=0), 3 * STATE :], None, w["wbu"])[0][1:]
                h = np.concatenate([f, np.take_along_axis(b, turned[:, :, None], axis=0)], axis=2).reshape(-1, 2 * STATE)
                e = (np.tanh(h @ w["a"]) @ w["av"]).reshape(steps, -1).astype(float)
                e = np.where(np.arange(steps)[:, None] < n, e, -np.inf)
                e = np.exp(e - e.max(axis=0))
                zero = np.zeros((1, len(some)))
                mass = np.concatenate([zero, np.cumsum(e, axis=0)])
                value = np.concatenate([zero, np.cumsum(e * (h @ w["o"]).reshape(steps, -1), axis=0)])
                starts = max(steps - WINDOW, 0) + 1
                end = np.minimum(np.arange(starts) + WINDOW, steps)
                logits = (value[end] - value[:starts]) / np.maximum(mass[end] - mass[:starts], 1e-30)
                logits = np.where(np.arange(starts)[:, None] <= np.maximum(n - WINDOW, 0), logits, -np.inf)
                where[some] = np.argmax(logits, axis=0)
                best[some] = logits[where[some], np.arange(len(some))] + float(w["ob"][0])
        return best, where

    # -- training

    def step(self, words: list[str], windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rng) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        w, g = self.w, {}
        chars, sizes = self.spell(words)
        turned = backwards(len(chars), sizes)
        back_chars = np.take_along_axis(chars, turned, axis=0)
        cmask = np.arange(len(chars))[:, None] < sizes[None, :]
        cf, cf_saved = Gru.run(w["char"][chars] @ w["cf"], cmask, w["cfu"], True)
        cb, cb_saved = Gru.run(w["char"][back_chars] @ w["cb"], cmask, w["cbu"], True)
        bucket = self.buckets(words)
        known = (rng.random(len(words)) < 0.5).astype(F32)[:, None]  # half of the words by their characters alone
        x = np.concatenate([w["word"][bucket] * known, cf[-1], cb[-1]], axis=1)
        steps = windows.shape[1]
        mask = np.arange(steps)[:, None] < lengths[None, :]
        at = windows.T
        turned_w = backwards(steps, lengths)
        at_back = np.take_along_axis(at, turned_w, axis=0)
        pf, pb = x @ w["wf"] + w["wfb"], x @ w["wb"] + w["wbb"]
        f, f_saved = Gru.run(pf[at], mask, w["wfu"], True)
        b, b_saved = Gru.run(pb[at_back], mask, w["wbu"], True)
        b_turned = np.take_along_axis(b[1:], turned_w[:, :, None], axis=0)
        h = np.concatenate([f[1:], b_turned], axis=2)
        s = np.tanh(h @ w["a"])
        e = np.where(mask, (s @ w["av"])[:, :, 0], -1e9)
        alpha = np.exp(e - e.max(axis=0))
        alpha = (alpha / alpha.sum(axis=0)).astype(F32)
        pooled = (h * alpha[:, :, None]).sum(axis=0)
        p = sigmoid((pooled @ w["o"])[:, 0] + w["ob"])
        d = ((p - labels) / len(labels)).astype(F32)[:, None]
        g["o"], g["ob"] = pooled.T @ d, d.sum(axis=0)
        d_pooled = d @ w["o"].T
        dh = alpha[:, :, None] * d_pooled[None]
        d_alpha = (h * d_pooled[None]).sum(axis=2)
        de = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["av"] = (s * de[:, :, None]).sum(axis=(0, 1))[:, None]
        ds = de[:, :, None] * w["av"][:, 0] * (1 - s * s)
        g["a"] = h.reshape(-1, 2 * STATE).T @ ds.reshape(-1, ATTENTION)
        dh = dh + ds @ w["a"].T
        zero = np.zeros((1, dh.shape[1], STATE), F32)
        db = np.zeros_like(dh[:, :, STATE:])
        np.put_along_axis(db, turned_w[:, :, None], dh[:, :, STATE:], axis=0)
        dxf, g["wfu"] = Gru.back(np.concatenate([zero, dh[:, :, :STATE]]), f, f_saved, mask, w["wfu"])
        dxb, g["wbu"] = Gru.back(np.concatenate([zero, db]), b, b_saved, mask, w["wbu"])
        dpf, dpb = np.zeros_like(pf), np.zeros_like(pb)
        np.add.at(dpf, at.ravel(), np.where(mask[:, :, None], dxf, 0).reshape(-1, 3 * STATE))
        np.add.at(dpb, at_back.ravel(), np.where(mask[:, :, None], dxb, 0).reshape(-1, 3 * STATE))
        g["wf"], g["wfb"], g["wb"], g["wbb"] = x.T @ dpf, dpf.sum(axis=0), x.T @ dpb, dpb.sum(axis=0)
        dx = dpf @ w["wf"].T + dpb @ w["wb"].T
        g["word"] = np.zeros_like(w["word"])
        np.add.at(g["word"], bucket, dx[:, :WORD_SIZE] * known)
        g["word"][0] = 0
        g["char"] = np.zeros_like(w["char"])
        for final, saved, own, pu, px, read in ((dx[:, WORD_SIZE : WORD_SIZE + CHAR_STATE], cf_saved, cf, "cfu", "cf", chars), (dx[:, WORD_SIZE + CHAR_STATE :], cb_saved, cb, "cbu", "cb", back_chars)):
            d_states = np.zeros_like(own)
            d_states[-1] = final
            d_in, g[pu] = Gru.back(d_states, own, saved, cmask, w[pu])
            d_in = np.where(cmask[:, :, None], d_in, 0).reshape(-1, 3 * CHAR_STATE)
            flat = w["char"][read].reshape(-1, CHAR_SIZE)
            g[px] = flat.T @ d_in
            np.add.at(g["char"], read.ravel(), d_in @ w[px].T)
        return g

    def fit(self, windows: list[list[str]], labels: np.ndarray, rate: float, rng, moments: dict) -> None:
        """Adam over shuffled batches, once over all windows."""
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            number: dict[str, int] = {}
            rows = [[number.setdefault(x, len(number)) for x in windows[k]] for k in some.tolist()]
            lengths = np.array([len(r) for r in rows])
            table = np.zeros((len(rows), int(lengths.max())), dtype=np.int64)
            for k, r in enumerate(rows):
                table[k, : len(r)] = r
            g = self.step(list(number), table, lengths, labels[some], rng)
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            moments["t"] = t = moments.get("t", 0) + 1
            for name, x in g.items():
                x = x * F32(min(1.0, 1.0 / max(norm, 1e-9)))
                m, v = moments.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
                m *= F32(0.9)
                m += F32(0.1) * x
                v *= F32(0.99)
                v += F32(0.01) * x * x
                self.w[name] -= F32(rate / (1 - 0.9**t)) * m / (np.sqrt(v / F32(1 - 0.99**t)) + F32(1e-6))

    # -- scoring

    def score(self, texts: list[str], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text (-inf without words), and the first word of the window that has it."""
        cache = {} if cache is None else cache
        if len(cache.get("number", ())) > CACHE_WORDS:
            cache.clear()
        number = cache.setdefault("number", {})
        have = len(number)
        split = [[number.setdefault(x, len(number)) for x in pieces(t)] for t in texts]
        if len(number) > have:
            new = self.word_inputs(list(number)[have:])
            cache["inputs"] = np.concatenate([cache["inputs"], new]) if have else new
        owner, first, lengths = [], [], []
        for k, own in enumerate(split):
            for a in segment_starts(len(own)):
                owner.append(k)
                first.append(a)
                lengths.append(min(len(own) - a, SEGMENT))
        best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64)
        if owner:
            owner, first = np.array(owner), np.array(first)
            rows = np.zeros((len(owner), SEGMENT), dtype=np.int64)
            for k, (o, a, n) in enumerate(zip(owner.tolist(), first.tolist(), lengths, strict=True)):
                rows[k, :n] = split[o][a : a + n]
            logits, start = self.best_windows(cache["inputs"], rows, np.array(lengths))
            order = np.lexsort((-logits, owner))
            head = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            best[owner[head]], where[owner[head]] = logits[head], first[head] + start[head]
        return best, where

    def probability(self, logits: np.ndarray) -> np.ndarray:
        out = 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))
        return np.where(np.isfinite(logits), out, 0.0)


def features(words: Iterable[str]) -> set[str]:
    """Words and word beginnings (with a star)."""
    return {*words, *(w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k)}


class Evidence:
    """How far more toxic texts than chance allows hold a word or a word beginning."""

    def __init__(self, toxic: list[list[str]], clean: list[list[str]]):
        self.toxic, self.clean = (Counter(f for words in texts for f in features(words)) for texts in (toxic, clean))
        self.share = len(toxic) / (len(toxic) + len(clean))

    def bound(self, f: str, own: int = 0) -> float:
        """Chernoff bound (minus its logarithm) of a binomial's upper tail, without `own` of the toxic texts."""
        n, c = self.toxic[f] - own, self.clean[f]
        if n <= 0 or n <= self.share * (n + c):
            return 0.0
        p = n / (n + c)
        return (n + c) * (p * math.log(p / self.share) + ((1 - p) * math.log((1 - p) / (1 - self.share)) if p < 1 else 0))

    def significant(self) -> set[str]:
        """What is in more toxic texts than chance allows for any of them."""
        least = math.log(len(self.toxic) + 1) + 3
        return {f for f, n in self.toxic.items() if self.clean[f] * 10 <= n and self.bound(f) > least}

    def strongest(self, windows: list[list[str]]) -> list[list[str]]:
        """The STRONGEST windows of a toxic text with the most evidence from the other texts, however weak."""
        known: dict[str, float] = {}
        for w in {w for x in windows for w in x}:
            known[w] = max(self.bound(f, 1) for f in features([w]))
        order = np.argsort([-sum(known[w] for w in set(x)) for x in windows], kind="stable")
        return [windows[k] for k in order[:STRONGEST].tolist()]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """The network, or None without texts of both classes."""
    split = [(pieces(t), y) for t, y in zip(texts, labels, strict=True)]
    toxic, clean = [w for w, y in split if y == 1 and w], [w for w, y in split if y == 0 and w]
    if not toxic or not clean:
        return None
    rng, net, moments = np.random.default_rng(seed), Network(seed), {}
    # every fourth text of each class only calibrates, if there are enough
    aside = [x[3::4] if min(len(toxic), len(clean)) >= 24 else x for x in (toxic, clean)]
    if aside[0] is not toxic:
        toxic, clean = ([w for k, w in enumerate(x) if k % 4 != 3] for x in (toxic, clean))
    texts_with = Counter(x for words in toxic + clean for x in {net.bare(w) for w in words})
    often = sorted((-n, w) for w, n in texts_with.items() if n >= WORD_TEXTS and w)[:WORDS]
    net.vocabulary = {w: k + 1 for k, (_, w) in enumerate(often)}
    evidence = Evidence(toxic, clean)
    marks = evidence.significant()
    marked = lambda w: not marks.isdisjoint(features([w]))
    cut = lambda words: [words[a : a + WINDOW] for a in window_starts(len(words))]
    # every toxic text is learnt from, and all count alike: DRAWN windows a round of its marked ones, or else of those with the most evidence
    pools, plain = [], []
    for words in toxic:
        windows = cut(words)
        hits = [x for x in windows if any(map(marked, x))]
        pools.append(hits or evidence.strongest(windows))
        plain.append(not hits)
    negative = [x for words in clean for x in cut(words)]
    enough = max(len(pools) * DRAWN * 3, 900)
    small = max(1, round(4500 / (len(pools) * DRAWN + enough)))  # as many steps on small samples
    flat = [" ".join(w) for w in toxic + clean]
    hard: list[list[str]] = []
    for number in range(ROUNDS):
        rate = RATE * 0.6**number
        for _ in range(EPOCHS * small):
            drawn = [pool[k] for pool in pools for k in (range(len(pool)) if len(pool) <= DRAWN else rng.choice(len(pool), DRAWN, replace=False))]
            drawn += [pool[k] for pool in pools if len(pool) < DRAWN for k in rng.integers(0, len(pool), DRAWN - len(pool))]
            own = [negative[k] for k in rng.choice(len(negative), min(enough, len(negative)), replace=False)] + hard
            net.fit(drawn + own, np.array([1.0] * len(drawn) + [0.0] * len(own), F32), rate, rng, moments)
        best, where = net.score(flat)
        # the clean texts' worst windows are learnt from now on, and the highest windows of toxic texts that are unmarked
        top = [w[a : a + WINDOW] for w, a in zip(toxic + clean, where.tolist(), strict=True)]
        hard = [x for x, b in zip(top[len(toxic) :], best[len(toxic) :], strict=True) if b > -3]
        for k, pool in enumerate(pools):
            if plain[k] or (number == 0 and best[k] > 0 and not any(map(marked, top[k]))):
                pool.append(top[k])
    calibrate(net, *(net.score([" ".join(w) for w in x])[0] for x in aside))
    return net


def calibrate(net: Network, toxic: np.ndarray, clean: np.ndarray) -> None:
    """Puts THRESHOLD where few texts (a hundredth more than the fewest) lie on the wrong side, nearest to the middle of the classes."""
    toxic, clean = (np.sort(x[np.isfinite(x)]) for x in (toxic, clean))
    if len(toxic) and len(clean):
        values = np.unique(np.concatenate([toxic, clean]))
        edges = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
        wrong = np.searchsorted(toxic, edges) / len(toxic) + 1 - np.searchsorted(clean, edges) / len(clean)
        good = edges[wrong <= wrong.min() + 0.01]
        cut = float(good[np.argmin(np.abs(good - (np.median(toxic) + np.median(clean)) / 2))])
        net.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - net.scale * cut


def training_sample(docs: DataFrame, labels: DataFrame) -> list:
    """Rows (text, toxic), SAMPLE of each class at most; the ids are chosen first, among those with a text that is not too long, so that only their texts are read."""
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    known = durable(known.join(texts.select("doc_id"), "doc_id", "left_semi"))
    chosen = []
    for y in (1, 0):
        chosen += known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    if not chosen:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int"))
    # rows with one id and one text count once; ties of an id are all taken, up to the sample's size over all
    return texts.join(ids, "doc_id").distinct().orderBy(F.xxhash64("doc_id", "text")).limit(2 * SAMPLE).select("text", "toxic").collect()


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sample = training_sample(docs, labels)
    net = train([r["text"] for r in sample], [r["toxic"] for r in sample])
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            scores = np.zeros(len(texts))
            if model.value is not None:
                for a, b in chunks(texts):
                    scores[a:b] = model.value.probability(model.value.score(texts[a:b], cache)[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic, by id; all columns as they are."""
    toxic = score_documents(docs, labels).filter("predicted = 1").groupBy("doc_id").agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("__toxic_id"))
    return docs.join(toxic, docs["doc_id"].cast("long").eqNullSafe(toxic["__toxic_id"]), "left_anti").select(*docs.columns)
