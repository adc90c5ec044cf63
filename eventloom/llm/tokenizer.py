"""Byte-level BPE ids at corpus speed: a bounded memory of word pieces before the tokenizer.

A single space between two other characters always starts a new pre-token, so a text may be
cut there and each part encoded on its own. Parts repeat, and a bounded two-generation memory
answers most of them.
"""

from __future__ import annotations

import json
import re
from array import array

from .common import per_worker

# Fixed value: the pre-token pattern of the public byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r" (?=\S)(?<=\S )")
MEMORY = 200_000
LONGEST_KEPT = 48
# Up to here both libraries know the same letters; beyond it the tokenizers library decides.
PLAIN_LIMIT = "ɐ"


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(" " + part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    """Ids as little-endian unsigned 16-bit bytes, equal to those of the tokenizers library."""

    def __init__(self, spec: str):
        import tiktoken

        self.spec, self._exact = spec, None
        vocab = json.loads(spec)["model"]["vocab"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        special = {x["content"] for x in json.loads(spec).get("added_tokens", [])}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        self.plain = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory = _Memory(self._part)

    def exact(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.spec)
            self._exact.encode_special_tokens = True
        return self._exact.encode(text, add_special_tokens=False).ids

    def _part(self, text: str) -> bytes:
        latin = text.isascii() or max(text) < PLAIN_LIMIT
        return array("H", self.plain.encode_ordinary(text) if latin else self.exact(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        # Every space is a cut, unless white space stands beside one.
        if "" in parts or list(map(str.strip, parts)) != parts:
            parts = CUT.split(text)
        first = self._part(parts[0])
        return first + b"".join(map(self.memory.__getitem__, parts[1:])) if len(parts) > 1 else first


def load_spec(path: str) -> str:
    """The tokenizer file, read by the driver and sent along: its size does not grow with the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def worker_bpe(spec: str) -> ByteBpe:
    return per_worker(f"byte_bpe:{len(spec)}:{hash(spec)}", lambda: ByteBpe(spec))
