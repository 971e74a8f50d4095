"""Words of a text: longest runs of letters and digits, lower-cased."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for null."""
    return WORD.findall(text.lower()) if text else []


class Codes:
    """64-bit codes of words, the same in every process."""

    def __init__(self, limit: int = 1 << 18) -> None:
        self._known: dict[str, int] = {}
        self._limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        missing = {t for t in tokens if t not in known}
        if missing:
            if len(known) > self._limit:
                known.clear()
                missing = set(tokens)
            from xxhash import xxh3_64_intdigest

            for t in missing:
                known[t] = xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation (the finaliser of splitmix64), applied to each member."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
