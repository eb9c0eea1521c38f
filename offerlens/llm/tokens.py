"""Token ids of a public byte-level BPE vocabulary, as the tokenizers library gives them, at the speed of tiktoken.

The tokenizer file is a parameter. If its model is a plain byte-level BPE whose merges give ids in order, tiktoken encodes
with the same ranks; otherwise, and for a text that tiktoken refuses, the tokenizers library itself does.
"""

from __future__ import annotations

import json

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: The split of byte-level BPE with use_regex (a fixed value of that pre-tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """tokens: bytes of each id (special ones: their text). merges: pairs of ids in order. special: text to id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        of = byte_chars()
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, k in vocab.items():
            self.tokens[k] = text.encode() if text in self.special else bytes(of[c] for c in text)
        for text, k in self.special.items():
            self.tokens[k] = text.encode()
        self.merges = []
        for m in spec["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges.append((vocab[left], vocab[right], vocab[left + right]))
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in of.items():
            self.byte_ids[b] = vocab[c]
        self.in_order = all(b > a for (_, _, a), (_, _, b) in zip(self.merges, self.merges[1:], strict=False))


class Encoder:
    """encode(text) gives the ids as uint32."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.path = path
        self._slow = None
        self._fast = None
        if self.vocabulary.in_order:
            import tiktoken

            special = self.vocabulary.special
            ranks = {t: k for k, t in enumerate(self.vocabulary.tokens) if k not in special.values()}
            self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def slow(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None:
            return self.slow(text)
        try:
            return self._fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except BaseException as e:  # a panic of the native code is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
