"""Word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_R, _R_INV = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    own = _powers.get(int(base))
    if own is None or len(own) < n:
        own = np.full(max(n, 1 << 16), base, "u8")
        own[0] = 1
        with np.errstate(over="ignore"):
            _powers[int(base)] = own = np.multiply.accumulate(own)
    return own[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): text i's distinct n-grams are hashes[starts[i]:starts[i + 1]], in ascending order.

    Words are runs without white space, in lower case. A text of fewer words than n has one n-gram, of all
    its words; a text without words (or null) has none.
    """
    clean = [" ".join((t or "").lower().split()).encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(c) + 1 for c in clean], "i8")
    data = np.frombuffer(b" ".join(clean) + b" ", "u1")
    n = len(data)
    prefix = np.zeros(n + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _powers_of(_R, n), out=prefix[1:])
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    full = ends > begins
    begins, ends = begins[full], ends[full]
    word = mix((prefix[ends] - prefix[begins]) * _powers_of(_R_INV, n)[begins])
    first = np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)]))  # each text's first word
    count = np.diff(first)
    gram = np.zeros(len(word), "u8")
    for k in range(words):
        gram[: len(word) - k] = mix(gram[: len(word) - k] + word[k:] + np.uint64(k + 1))
    sets = []
    for a, c in zip(first[:-1].tolist(), count.tolist()):
        if c >= words:
            sets.append(np.unique(gram[a : a + c - words + 1]))
        elif c:
            sets.append(mix(np.array([sum(int(w) * (2 * k + 3) for k, w in enumerate(word[a : a + c])) + c & (1 << 64) - 1], "u8")))
        else:
            sets.append(np.zeros(0, "u8"))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("i8")
    return np.concatenate(sets) if sets else np.zeros(0, "u8"), starts


def in_runs(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)
