"""Vectorised hashing of words and word shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Lower-case A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word rule: blank and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(m, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each of the ordered, disjoint spans data[start:end].

    Prefix sums of a polynomial give all spans of a block at once; blocks end between spans, so
    memory stays bounded unless one span alone is larger.
    """
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=U)
        np.cumsum((data[a:b].astype(U) + U(1)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents, A-Z lower-cased, and where each document's begin."""
    data = LOWER[np.frombuffer(b"\n".join(docs), dtype=np.uint8)]
    starts, ends = runs(~SPACE[data])
    sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    return span_hashes(data, starts, ends), np.searchsorted(starts, firsts)


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document.

    A document of fewer words is one shingle of its whole sequence; one without words has none.
    """
    words, at = word_hashes(docs)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=U)
    for k in range(width):
        rolled = rolled * U(0xD1342543DE82EF95) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for d in range(len(docs)):
        a, b = int(at[d]), int(at[d + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U(0xD1342543DE82EF95) + w
            out.append(mix(np.array([h ^ U(0x5851F42D4C957F2D)], dtype=U)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


def fold(values: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each row of a matrix."""
    h = np.full(len(values), U(seed), dtype=U)
    for k in range(values.shape[1]):
        h = mix(h * U(0xD1342543DE82EF95) + values[:, k])
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
