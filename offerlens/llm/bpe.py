"""BPE encoding and decoding in batched numpy merge rounds.

The distinct pre-tokens of many texts lie in one flat symbol array. Each round finds every word's lowest-ranked adjacent pair
by binary search over the sorted pair keys and merges all its occurrences in all words at once; only pairs beside a merge are
looked up anew, and finished words leave the array. Words found before come from a bounded cache.

Ids equal those of the tokenizers library with add_special_tokens=False: special tokens in a text are recognised first, then
the pre-tokenizer's pattern splits. Decoding maps ids to bytes and these to text with U+FFFD for invalid parts. 

Cases. Null texts count as empty: no ids, empty text. Very long texts are encoded whole, one at a time. Repeated rows are encoded
each for itself; a null id stays null. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import chunks, portions, text_column
from offerlens.llm.tokens import PATTERN, Vocabulary, tokenizer_path

NEVER = np.int64(1) << 60
#: Distinct words a worker remembers; beyond, it forgets all and goes on.
CACHE_WORDS = 400_000

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class NumpyBpe:
    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        self.size = len(v.tokens)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*v.merges, strict=True))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.token_lengths = np.array([len(t) for t in v.tokens], dtype=np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_lengths)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(v.tokens), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(1, dtype=np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the sorted keys, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids."""
        raw = [w.encode() for w in words]
        count = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        sym = self.vocabulary.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), count)
        done_sym, done_word = [], []
        place = np.full(len(sym), -1, dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        place[inner] = self.find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(place >= 0, self.rank[place], NEVER)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            live = least < NEVER
            sizes = np.diff(np.append(starts, len(sym)))
            if not live.all():
                keep = np.repeat(live, sizes)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, place, rank, least, sizes = sym[keep], word[keep], place[keep], rank[keep], least[live], sizes[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of overlapping hits (a run of equal symbols) every second one
            run = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            sym[hit] = self.made[place[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, place = sym[stay], word[stay], place[stay]
            around = np.concatenate([moved, moved[moved > 0] - 1])
            place[around] = -1
            around = around[around + 1 < len(sym)]
            around = around[word[around] == word[around + 1]]
            place[around] = self.find(sym[around], sym[around + 1])
        sym, word = np.concatenate([*done_sym, sym[:0]]), np.concatenate([*done_word, word[:0]])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append("\0" + m[0])  # not a pre-token: no pattern joins U+0000 and what follows
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (with the end at last)."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = [self.split(t) for t in texts]
        known = self.known
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in known]
        if new:
            marks = {"\0" + s: k for s, k in self.vocabulary.special.items()}
            plain = [w for w in new if w not in marks]
            ids, count = self.merge(plain)
            for w in new:
                if w in marks:
                    plain.append(w)
                    ids, count = np.append(ids, np.uint32(marks[w])), np.append(count, 1)
            known.update(zip(plain, range(len(known), len(known) + len(plain)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        slot = np.fromiter((known[w] for ws in split for w in ws), dtype=np.int64, count=int(n.sum()))
        flat, ends = gather(self.ids, self.begin[slot], self.begin[slot + 1] - self.begin[slot])
        return flat, ends[np.concatenate([[0], np.cumsum(n)])]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each id's begin (with the end at last)."""
        return gather(self.token_bytes, self.token_start[ids], self.token_lengths[ids])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids)[0].tobytes().decode("utf-8", "replace")


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:start + length] of all ranges in a row, and where each range begins there (with the end at last)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return values[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])], ends


_bpe: dict[str, NumpyBpe] = {}


def bpe(path: str) -> NumpyBpe:
    if path not in _bpe:
        _bpe[path] = NumpyBpe(path)
    return _bpe[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded text of each row."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, flat, begin, raw, edges in _encoded(batches, path):
            spans = [slice(begin[k], begin[k + 1]) for k in range(len(keys))]
            decoded = [raw[edges[x.start] : edges[x.stop]].tobytes().decode("utf-8", "replace") for x in spans]
            ids = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """DIGEST of each row: the same encoder and decoder, with digests of ids and decoded text instead of these."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, flat, begin, raw, edges in _encoded(batches, path):
            little = flat.astype("<u4")
            rows = []
            for k in range(len(keys)):
                a, b = begin[k], begin[k + 1]
                decoded = raw[edges[a] : edges[b]].tobytes().decode("utf-8", "replace").encode()
                rows.append((hashlib.sha256(little[a:b]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            first, second = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.diff(begin)), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).mapInArrow(run, DIGEST)


def _encoded(batches: Iterator[pa.RecordBatch], path: str):
    own = bpe(path)
    for batch in portions(batches):
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in chunks(texts, 1 << 21):
            flat, begin = own.encode(texts[a:b])
            raw, edges = own.decode_bytes(flat)
            yield keys[a:b], texts[a:b], flat, begin, raw, edges
