"""Exact tokenization of whole texts, as tokenizers does it with add_special_tokens=False.

A byte-level vocabulary whose ids are its merge ranks goes to tiktoken, which gives the same ids
several times as fast; texts that its matcher refuses (about a million blanks in a row) go to
tokenizers. A tokenizer that drops white space encodes each word as it does inside the
text, so the encodings of words are kept, in a bounded cache.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

MAX_WORDS = 600_000


def _ranked(spec: dict):
    """The byte-level tokenizer's vocabulary for tiktoken, which gives the same ids several times as fast; None where its ids are not its ranks."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    if any(vocab[t] != 256 + k for k, t in enumerate(merged)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items()}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Token ids (and spans) of texts; truncation and padding are off."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.drops_space = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in pre.get("pretokenizers", []))
        self.fast = _ranked(spec) if byte_level else None
        if self.fast:
            self.sizes = np.zeros(self.fast.n_vocab, np.int64)
            for i in self.fast._mergeable_ranks.values():
                self.sizes[i] = len(self.fast.decode_single_token_bytes(i))
            for t, i in self.fast._special_tokens.items():
                self.sizes[i] = len(t.encode())
        self.names = None
        if self.tokenizer.decoder is None:  # tokens are then joined by a space
            vocab = self.tokenizer.get_vocab()
            self.names = [""] * (max(vocab.values()) + 1)
            for t, i in vocab.items():
                self.names[i] = t
        self.words: dict[str, bytes] = {}

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        return self.ids_of([text])[0]

    def _ranked_ids(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
        except ValueError:  # the stack of its matcher ended
            return self._slow(text)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [self._ranked_ids(t) for t in texts]
        if not self.drops_space:
            return [self._slow(t) for t in texts]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = list(set().union(*split).difference(self.words))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4") for words in split]

    def spans(self, text: str) -> np.ndarray:
        """(n, 2) begin and end of each token in characters; a token that holds a part of a character covers it."""
        if not self.fast:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        ends = np.cumsum(self.sizes[self.ids(text)])
        if not len(ends):
            return np.empty((0, 2), np.int64)
        character = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)  # 1 + the character of each byte
        return np.stack([character[np.concatenate([[0], ends[:-1]])] - 1, character[ends - 1]], 1)

    def decode(self, ids: np.ndarray) -> str:
        if self.names:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)
