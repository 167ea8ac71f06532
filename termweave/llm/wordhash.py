"""Word splitting and rolling hashes over word sequences, vectorised with numpy inside tasks."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the rolling polynomials over bytes and over words (mod 2**64).
BYTE_BASE = 0xD1342543DE82EF95
WORD_BASE = 0x9E3779B97F4A7C15
#: Bytes that end a word: fixed values, the class [\x20\x09-\x0D].
WHITE = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: bytes.split() parts at exactly these bytes."""
    return text.split() if text else []


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1024, 1 << max(0, n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for every byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407 + 2 * seed))


def word_bounds(text: bytes, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of text start and end."""
    inside = ~white[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def span_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each byte span of text; equal bytes give equal hashes in every text."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[np.frombuffer(text, np.uint8)] * _power(BYTE_BASE, n), out=sums[1:])
    inverse = _power(pow(BYTE_BASE, -1, 1 << 64), n + 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (empty when there are fewer)."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power(WORD_BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _power(pow(WORD_BASE, -1, 1 << 64), n - k + 1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values (empty when there are fewer)."""
    if len(values) < width:
        return values[:0]
    best, span = values, 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best
