"""Hashes of the words of many texts at once, with numpy; no Spark in here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes that part words, as ``bytes.split`` takes them.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SIZE = 24  # bytes of a word that three loads reach


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(a: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; ``a`` begins anywhere and ends with white space."""
    space = white[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(a) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word. The hash depends on the word's bytes alone."""
    a = np.frombuffer(raw + b" " * 26, np.uint8)
    start, end = edges(a)
    size = end - start
    eight = np.ndarray(len(a) - 7, np.dtype("<u8"), a, strides=(1,))
    h = size.astype(np.uint64)
    for i in (2, 1, 0):
        have = np.clip(size - 8 * i, 0, 8)
        part = eight[np.minimum(start + 8 * i, len(eight) - 1)]
        shift = np.uint64(64) - np.maximum(have, 1).astype(np.uint64) * np.uint64(8)
        h = mix(h + np.where(have > 0, (part << shift) >> shift, np.uint64(0)))
    for k in np.flatnonzero(size > _SIZE).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return start, end, h


def hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words one after another, and where each text's begin (with the end of the last)."""
    start, _, h = hashes(b"\n".join(raws))
    firsts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return h, np.searchsorted(start, firsts)


def in_parts(raws: list[bytes], most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``hashed`` for neighbouring texts of about ``most`` bytes together: the number of the first, hashes and bounds. A longer
    text is a part of its own and read in slices that end at white space, so only its hashes are held whole."""
    at = 0
    while at < len(raws):
        size, end = len(raws[at]), at + 1
        while end < len(raws) and size + len(raws[end]) <= most:
            size += len(raws[end])
            end += 1
        if size <= most:
            yield at, *hashed(raws[at:end])
        else:
            h = np.concatenate([x for _, _, x in slices(raws[at], most)])
            yield at, h, np.array([0, len(h)])
        at = end


def slices(raw: bytes, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hashes`` of a text, slice by slice; a slice ends at the first white space from ``most`` bytes on."""
    at = 0
    while at < len(raw):
        end = at + most
        while end < len(raw):  # look for white space a little at a time
            white = np.flatnonzero(WHITE[np.frombuffer(raw, np.uint8, min(1 << 12, len(raw) - end), end)])
            if len(white):
                end += int(white[0])
                break
            end += 1 << 12
        start, stop, h = hashes(raw[at:end])
        yield start + at, stop + at, h
        at = end


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` neighbouring words."""
    s = h[: max(len(h) - k + 1, 0)] + np.uint64(k)
    for j in range(1, k):
        s = mix(s) + h[j : j + len(s)]
    return mix(s)
