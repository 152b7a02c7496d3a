"""Vectorised hashing of words and byte n-grams (numpy, 64 bit, the same on every machine)."""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOW = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_HIGH = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the 64-bit one of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece_hashes(b: np.ndarray) -> np.ndarray:
    space = SPACE[b]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.arange(len(b), dtype=np.int64)
    first = np.zeros(len(b), np.int64)
    first[starts] = starts
    at -= np.maximum.accumulate(first)
    value = _BYTE[b] * _LOW[at & 4095]
    if int(at.max()) >= 4096:
        value *= _HIGH[(at >> 12) & 4095]
    value[space] = 0
    return mix(np.add.reduceat(value, starts))


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 for each word (run of bytes other than 9-13 and 32), in order.

    Long texts go through in pieces cut at white space, so memory stays in proportion to a piece.
    """
    n = len(text)
    if n <= PIECE:
        return _piece_hashes(np.frombuffer(text, np.uint8)) if n else np.empty(0, np.uint64)
    out, at = [], 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:  # one word longer than a piece
                nexts = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, end)) >= 0]
                end = min(nexts, default=n)
                word = text[at:end].lstrip(b" \n\t\r\x0b\x0c")
                if len(word) > PIECE // 2 and len(word.split()) == 1:
                    digest = hashlib.blake2b(word, digest_size=8).digest()
                    out.append(np.frombuffer(digest, np.uint64))
                    at = end
                    continue
        out.append(_piece_hashes(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)
