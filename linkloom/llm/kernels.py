"""Array work on batches of texts: words, shingles and signatures."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that one round of array work takes in.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)


@functools.lru_cache(maxsize=8)
def powers(bits: int, inverse: bool = False) -> np.ndarray:
    """base**i, or its inverse, modulo 2**64 for i below 2**bits."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        np.multiply(out[: 1 << k], np.uint64(pow(base, 1 << k, 1 << 64)), out=out[1 << k : 2 << k])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (the constants of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def normal_words(text: bytes) -> bytes:
    """Lower-case A-Z, words parted by single spaces (bytes.split knows just the
    six ASCII white-space bytes)."""
    return b" ".join(text.lower().split())


def word_hashes(line: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a non-empty normal_words() line."""
    out, at = [], 0
    while at < len(line):  # very long lines in parts, cut between words
        end = len(line)
        if end - at > 4 * SLICE_BYTES:
            end = line.find(b" ", at + 2 * SLICE_BYTES)
            end = len(line) if end < 0 else end
        part = np.frombuffer(line, np.uint8, end - at, at)
        bits = max(10, int(len(part)).bit_length())
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_codes()[part] * powers(bits)[: len(part)], out=sums[1:])
        gaps = np.flatnonzero(part == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(part)]))
        out.append(mixed((sums[ends] - sums[starts]) * powers(bits, True)[starts] + (ends - starts).astype(np.uint64)))
        at = end + 1
    return out[0] if len(out) == 1 else np.concatenate(out)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        total += words[k : k + n] * np.uint64((_BASE * (2 * k + 3) ** 5 | 1) & _MASK)
    return mixed(total)


def shingle_sets(lines: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of hashed shingles of each normal_words() line: runs of
    `size` words, or the whole line as one if it has fewer; empty if none."""
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + len(lines[end]) < SLICE_BYTES):
            total += len(lines[end]) + 1
            end += 1
        full = [x for x in lines[at:end] if x]
        words = word_hashes(b" ".join(full)) if full else np.zeros(0, np.uint64)
        runs, start = windows(words, size) if len(words) >= size else None, 0
        for x in lines[at:end]:
            if not x:
                yield np.zeros(0, np.uint64)
                continue
            n = x.count(b" ") + 1
            if n >= size:
                yield np.unique(runs[start : start + n - size + 1])
            else:
                yield mixed(windows(words[start : start + n], n) + np.uint64(n))
            start += n
        at = end


def text_key(line: bytes) -> bytes:
    """128-bit key of a text's words."""
    return hashlib.blake2b(line, digest_size=16).digest()


@functools.lru_cache(maxsize=4)
def universal(count: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of universal multiply-shift hashes."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**64, count, np.uint64)


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """Minima of `count` universal hashes over a non-empty set."""
    a, b = universal(count)
    least = None
    for at in range(0, len(shingles), 8192):
        part = ((shingles[None, at : at + 8192] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint32).view(np.int32)
