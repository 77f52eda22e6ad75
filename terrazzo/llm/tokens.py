"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken

#: Remembered words per worker process.
MOST_WORDS = 300_000


class Encoder:
    """Ids of a text under the vocabulary `name`.json of the tokenizers library, as little-endian bytes.

    `name`.tiktoken holds the same vocabulary as ranks, and gives the same ids at a seventh of the time.
    A text's chunks between single spaces are encoded once each and remembered: the split pattern never
    matches across the end of a non-space followed by a space and a non-space, so the chunks' ids put
    together are the text's ids. A text with any other white space beside a space is encoded as one.
    With `added`, the library's default, the JSON file's added tokens in a text become their ids; without it their
    strings are ordinary text.
    """

    def __init__(self, name: str, added: bool = False):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = added_tokens(name) if added else {}
        self.splits = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        self.dtype = np.dtype("<u2" if max(*ranks.values(), *self.added.values()) < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.base.encode_ordinary(text), self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.splits and self.splits.search(text):
            return b"".join(self.added[x].to_bytes(self.dtype.itemsize, "little") if x in self.added else self._plain(x) for x in self.splits.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        known = self.known
        out = list(map(known.get, rest))
        if None in out or head[-1:].isspace() or not head and rest:
            if not head or head[-1].isspace():
                return self._direct(text)
            for i, x in enumerate(out):
                if x is None:
                    w = rest[i]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self._direct(text)
                    x = self._direct(" " + w)
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = x
                    out[i] = x
        return self._direct(head) + b"".join(out)


def added_tokens(name: str) -> dict[str, int]:
    """Ids of the added tokens of `name`.json; none where there is no such file."""
    where = public_tokenizers.path(f"{name}.json")
    if not os.path.exists(where):
        return {}
    with open(where, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise NotImplementedError(f"{name}: added tokens that depend on what is beside them")
    return {t["content"]: t["id"] for t in tokens}


@cache
def encoder(name: str) -> Encoder:
    """One per process and vocabulary, with the library's defaults."""
    return Encoder(name, added=True)
