"""Word shingles of whole texts as sorted 64-bit hashes, for many texts at once inside a task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Texts are hashed together up to this many bytes; a longer text is hashed alone, whole.
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A word's hash is its bytes' polynomial modulo two primes near 2**32, at two bases. (Modulo a power of two, words of
#: Thue and Morse's kind collide whatever the base.)
_PRIMES = (4294967291, 4294967279)
_BASES = (2862933557, 3202034522)
#: Sums of a word's bytes times powers fit 64 bits below this length; where a text is longer, each term is reduced first.
_UNREDUCED = 1 << 22


@lru_cache(maxsize=4)
def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """``base ** k`` modulo ``prime`` for k below ``n``, a power of two, by doubling."""
    out, have, step = np.ones(n, _U), 1, base
    while have < n:
        out[have : 2 * have] = out[:have] * _U(step) % _U(prime)
        have, step = 2 * have, step * step % prime
    return out


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text number of each word; ``edges`` are the texts' offsets in ``data``."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.concatenate([[False], ~space, [False]])
    begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]  # texts end words too
    begin[inner] |= word[1:-1][inner]
    end[inner - 1] |= word[1:-1][inner - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size = 1 << int(max(len(data), CHUNK_BYTES)).bit_length()
    low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(_U) + _U(1)
    both = []
    for base, prime in zip(_BASES, _PRIMES):
        up, down = (_powers(size, b, prime)[: len(data)] for b in (base, pow(base, -1, prime)))
        terms = low * up
        if len(data) > _UNREDUCED:
            terms %= _U(prime)
        run = np.zeros(len(data) + 1, _U)
        np.cumsum(terms, out=run[1:])  # may go round; differences do not
        both.append((run[stop] - run[start]) % _U(prime) * down[start] % _U(prime))
    return mix(mix(both[0] << _U(32) | both[1]) + (stop - start).astype(_U)), np.searchsorted(edges, start, side="right") - 1


def _chunk(data: np.ndarray, edges: np.ndarray, n: int) -> list[np.ndarray]:
    words, of = _words(data, edges)
    many = len(edges) - 1
    count = np.bincount(of, minlength=many)
    first = np.cumsum(count) - count
    total = np.zeros(max(len(words) - n + 1, 0), _U)
    for j in range(n):
        total = total * _U(0xA24BAED4963EE407) + words[j : j + len(total)]
    every = mix(total + _U(n))
    out = []
    for a, c in zip(first.tolist(), count.tolist()):
        if c >= n:
            out.append(np.unique(every[a : a + c - n + 1]))
        elif c:
            h = _U(0)
            with np.errstate(over="ignore"):
                for w in words[a : a + c]:
                    h = h * _U(0xA24BAED4963EE407) + w
                out.append(mix(np.array([h + _U(c)])))
        else:
            out.append(np.empty(0, _U))
    return out


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text (null: empty) its distinct ``n``-word shingles, sorted.

    Words are runs of anything but blanks and the controls 9 to 13, with A-Z lower-cased. A text
    of fewer words has its whole sequence as one shingle, a text of none has no shingle.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        out += _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n)
        at = to
    return out
