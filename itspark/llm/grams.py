"""Hashes of stretches of a sequence, and the choice of anchors in it.

A sequence of 64-bit codes gets running sums of ``code[i] * B**i`` (modulo 2**64, B odd), from which the hash
of any stretch follows in a few operations. Anchors are the stretches of ``size`` codes whose mixed hash is
smallest among those inside some window: equal windows choose the same anchor at the same place, so windows
can only be equal where their anchors are.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: A code for each byte value.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITION_BITS = 24
#: Of the hash of shingles.
SEED = 42
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(full)
    return have[:n]


def running(codes: np.ndarray) -> np.ndarray:
    """Running sums, one longer than the codes."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) stretches; equal stretches have equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key among each ``width`` neighbours, by minima from block borders on both sides."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lower-cased, joined by one space; of all words if fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def anchors(codes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each anchor, and the first and last start of the windows that chose it.

    Of equal hashes in a window the leftmost is chosen. A sequence shorter than a window has no anchor.
    Longer ones than 2**24 codes are taken in pieces that overlap by a window, so that no window is lost.
    """
    n = len(codes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    piece = (1 << POSITION_BITS) - 1
    if n > piece:
        found = []
        for at in range(0, n - window + 1, piece - window + 1):
            part = anchors(codes[at : at + piece], window, size)
            found.append((part[0], *(x + at for x in part[1:])))
        return tuple(np.concatenate(x) for x in zip(*found))
    sums = running(codes)
    starts = np.arange(n - size + 1)
    hashes = stretch_hashes(sums, starts, starts + size)
    low = np.uint64((1 << POSITION_BITS) - 1)
    chosen = (window_minima((hashes & ~low) | starts.astype(np.uint64), window - size + 1) & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    last = np.append(first[1:], len(chosen)) - 1
    return hashes[chosen[first]], chosen[first], first, last
