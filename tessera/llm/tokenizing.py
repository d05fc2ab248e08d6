"""Token ids of whole texts through bounded per-worker caches.

A byte-level BPE splits a text into pre-tokens first and merges inside them only.  A single space between two
code points that are not white space always begins a pre-token, so the stretches between such spaces can be
encoded one by one, and a cache of stretches saves most of the work.  Stretches that the cache lacks go to the
``tokenizers`` library in one call for each text: joined by their spaces, unless one holds other spaces, as then a
token that begins with a space begins a stretch and cuts the ids again.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

DEFAULT = "byte_bpe_50k.json"
#: Entries of a worker's cache, of less than 64 code points each (some 250 MB); it is emptied when full.
CACHE = 1_000_000
_odd = re.compile(r" (?:\s|(?<=\s.))")
_bound = re.compile(r"(?<!\s) (?!\s)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@cache
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@cache
def begins_with_space(name: str) -> np.ndarray:
    """For each id, whether its token begins with a space (written as the byte alphabet's ``\u0120``)."""
    vocabulary = library(name).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
    return out


class Encoder:
    """``of(text)`` gives the ids as little-endian unsigned 32-bit bytes, or their number if ``count``."""

    def __init__(self, name: str = DEFAULT, count: bool = False, limit: int = CACHE) -> None:
        self.library, self.count, self.limit, self.spaced = library(name), count, limit, begins_with_space(name)
        self.cache: dict = {}

    def encode(self, texts: list[str]) -> list:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [len(x) for x in done] if self.count else [np.array(x.ids, "<u4").tobytes() for x in done]

    def encode_words(self, words: list[str]) -> list:
        """Stretches of a space and a word each, without further spaces and beside no other white space."""
        done = self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0]
        ids = np.array(done.ids, "<u4")
        cuts = np.flatnonzero(self.spaced[ids])
        if len(cuts) != len(words):
            return self.encode([" " + w for w in words])
        if self.count:
            return np.diff(cuts, append=len(ids)).tolist()
        raw, at = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    @staticmethod
    def odd(text: str) -> bool:
        """Whether a space stands beside other white space, so that not every one begins a pre-token."""
        return _odd.search(text) is not None

    def of(self, text: str | None):
        if not text:
            return 0 if self.count else b""
        odd = self.odd(text)
        parts = _bound.split(text) if odd else text.split(" ")
        return self.parts(parts[0], parts[1:], odd)

    def parts(self, before: str, rest: list[str], odd: bool = False):
        """Of a text: what is before the first bound, and the stretches that follow a space each."""
        first = self.encode([before]) if before else []
        found = self.stretches(rest, odd)
        return sum(first) + sum(found) if self.count else b"".join(first + found)

    def stretches(self, rest: list[str], odd: bool = False) -> list:
        """Ids or numbers of each stretch, with the space before it."""
        found = list(map(self.cache.get, rest))
        if None in found:
            lost = list(dict.fromkeys(p for p, v in zip(rest, found) if v is None))
            joined = not odd and "" not in lost
            fresh = dict(zip(lost, self.encode_words(lost) if joined else self.encode([" " + p for p in lost])))
            found = [fresh[p] if v is None else v for p, v in zip(rest, found)]
            if len(self.cache) + len(fresh) > self.limit:
                self.cache = {}
            self.cache.update(fresh if max(map(len, lost)) < 64 else {p: v for p, v in fresh.items() if len(p) < 64})
        return found


_kept: dict = {}


def worker_encoder(name: str = DEFAULT, count: bool = False) -> Encoder:
    """The worker process's encoder: its cache lasts from task to task.  One at a time is kept."""
    key = (name, count)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(name, count)
    return _kept[key]
