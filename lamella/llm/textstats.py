"""Measurements of one text, from its UTF-8 bytes, with numpy; no Spark in here."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, np.int64)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
SYMBOLS = b"#*$%&|<>"
_SYMBOL = list(SYMBOLS)
_UPPER = slice(65, 91)
_LOWER = slice(97, 123)
_DIGIT = slice(48, 58)

#: What ``measure`` returns, in order.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_bytes", "n_chars", "n_lines", "n_distinct", "top_count", "n_upper", "n_lower", "n_digits", "n_bang", "n_pipe",
    "n_stop", "n_comma", "n_runs", "n_upper_words", "n_long_words",
)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Each word's number by first appearance, and how many there are."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, len(seen)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three numbers no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(raw: bytes) -> list[int]:
    arr = np.frombuffer(raw, np.uint8)
    by = np.bincount(arr, minlength=256)
    chars = len(raw) - int(by[0x80:0xC0].sum())
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids, distinct = word_ids(words)
    counts = np.bincount(ids, minlength=1)
    runs = int((np.diff(ids) == 0).sum()) if n > 1 else 0
    return [
        n,
        chars - int((by * _SPACE).sum()),
        int(by[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids, distinct),
        len(raw),
        chars,
        len(lines),
        distinct,
        int(counts.max()),
        int(by[_UPPER].sum()),
        int(by[_LOWER].sum()),
        int(by[_DIGIT].sum()),
        int(by[33]),
        int(by[124]),
        int(by[46]),
        int(by[44]),
        runs,
        sum(map(bytes.isupper, words)),
        sum(len(w) > 20 for w in words),
    ]


def measure_all(raws: list[bytes]) -> dict[str, np.ndarray]:
    rows = np.array([measure(r) for r in raws], np.int64).reshape(len(raws), len(MEASURES))
    return {name: rows[:, i] for i, name in enumerate(MEASURES)}
