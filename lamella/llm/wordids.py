"""Token ids of many texts, with the ids of words remembered in arrays; no Spark in here."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: What a vocabulary must do with text before its merges for its words to be remembered.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Lower-case letters that no normaliser changes, then punctuation without the apostrophe: two units to that split.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_WORD = 23  # bytes of a word that fit a key of three 64-bit numbers, beside its length


def _byte_letters() -> dict[int, int]:
    """The letters of a byte-level vocabulary for bytes that don't print; the others stand for themselves."""
    prints = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordTable:
    """A hash table from words to token ids, probed and filled with arrays.

    A word of up to 23 bytes is its own key: three 64-bit numbers, the last with the length in its top byte. Longer
    ones have a dict. Keys are compared in full, so no two words are ever confused.
    """

    def __init__(self) -> None:
        self.bits = 16
        self.n = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((3, 1 << 15), np.uint64)
        self.first = np.zeros((1 << 15) + 1, np.int64)  # where each word's ids begin
        self.ids = np.zeros(1 << 17, np.uint32)
        self.long: dict[bytes, int] = {}

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        return _mix(keys[0] + _mix(keys[1] + _mix(keys[2])))

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            at = self.slots[slot]
            same = at >= 0
            for i in range(3):
                same &= self.keys[i, at] == keys[i, todo]
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, number: np.ndarray, h: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several for one slot the last stays
            on = self.slots[slot] != number
            number, slot = number[on], (slot[on] + 1) & (len(self.slots) - 1)

    def add(self, ids: list[bytes], keys: np.ndarray | None = None) -> int:
        """Append words (with their keys, unless they are long ones); the number of the first."""
        at, sizes = self.n, np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.n += len(ids)
        if self.n > self.keys.shape[1]:
            room = 2 * self.n
            self.keys = np.concatenate([self.keys, np.zeros((3, room - self.keys.shape[1]), np.uint64)], axis=1)
            self.first = np.concatenate([self.first, np.zeros(room + 1 - len(self.first), np.int64)])
        self.first[at + 1 : self.n + 1] = self.first[at] + np.cumsum(sizes)
        end = int(self.first[self.n])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(2 * end - len(self.ids), np.uint32)])
        self.ids[self.first[at] : end] = np.frombuffer(b"".join(ids), np.uint32)
        if keys is not None:
            self.keys[:, at : self.n] = keys
            if 2 * self.n > len(self.slots):
                while 2 * self.n > 1 << self.bits:
                    self.bits += 1
                self.bits += 1
                self.slots = np.full(1 << self.bits, -1, np.int32)
                every = np.flatnonzero(self.keys[2, : self.n])  # long words have no key
                self._place(every.astype(np.int32), self.hash(self.keys[:, every]))
            else:
                self._place(np.arange(at, self.n, dtype=np.int32), self.hash(keys))
        return at


class WordTokenizer:
    """Token ids of texts.

    A vocabulary that lower-cases, splits at white space and drops it (``by_word``) gives a text the ids of its lower-cased
    words one after another, so only words that are new to this worker reach the tokenizer; plain ones go straight to
    its merges, letters and punctuation apart. After ``limit`` words the memory starts anew. Any other vocabulary
    encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 700_000, most: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._limit, self._most = limit, most
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            (told.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and all(x["content"].startswith("<|") for x in told["added_tokens"])
        )
        self._letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        """Let go of all words met so far."""
        self._table = WordTable()
        self._letter_ids: dict[str, bytes] = {}
        self._mark_ids: dict[str, bytes] = {"": b""}

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words, by the tokenizer, as the bytes of 32-bit numbers."""
        out = [b""] * len(words)
        known, marks, model = self._letter_ids, self._mark_ids, self._tok.model
        other = []
        for i, raw in enumerate(words):
            w = raw.decode("utf-8", "replace")
            m = _PLAIN(w)
            if m is None:
                other.append((i, w))
                continue
            letters, mark = m.groups()
            ids = known.get(letters)
            if ids is None:
                mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self._letters)
                ids = known[letters] = array("I", [t.id for t in model.tokenize(mapped)]).tobytes()
            if mark and mark not in marks:
                marks[mark] = array("I", self._tok.encode(mark, add_special_tokens=False).ids).tobytes()
            out[i] = ids + marks[mark]
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for (i, _), e in zip(part, self._tok.encode_batch_fast([w for _, w in part], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        if len(known) > 100_000:  # words come again with other punctuation, mostly soon
            known.clear()
        return out

    def _numbers(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's words: first byte, number in the table."""
        table = self._table
        a = np.frombuffer(raw + b" " * 25, np.uint8)
        space = _SPACE[a]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        size = end - start
        eight = np.ndarray(len(a) - 7, np.dtype("<u8"), a, strides=(1,))
        keys = np.empty((3, len(start)), np.uint64)
        for i in range(3):
            have = np.clip(size - 8 * i, 0, 8)
            at = np.minimum(start + 8 * i, len(eight) - 1)
            mask = np.where(have > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.maximum(have, 1).astype(np.uint64) * np.uint64(8)), np.uint64(0))
            keys[i] = eight[at] & mask
        short = size <= _WORD
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        number = np.empty(len(start), np.int32)
        s = np.flatnonzero(short)
        k = keys[:, s]
        h = table.hash(k)
        got = table.find(k, h)
        while True:
            lost = np.flatnonzero(got < 0)
            if not len(lost):
                break
            _, one = np.unique(h[lost], return_index=True)  # equal hashes of unequal words come in the next round
            new = lost[one]
            table.add(self._ids_of([raw[b:e] for b, e in zip(start[s[new]].tolist(), end[s[new]].tolist(), strict=True)]), k[:, new])
            got[lost] = table.find(k[:, lost], h[lost])
        number[s] = got
        for i in np.flatnonzero(~short).tolist():
            w = raw[start[i] : end[i]]
            if w not in table.long:
                table.long[w] = table.add(self._ids_of([w]))
            number[i] = table.long[w]
        return start, number

    def _joined(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; all texts are taken together."""
        if self._table.n > self._limit:
            self.forget()
        start, number = self._numbers(b"\n".join(raws))
        table = self._table
        first = table.first[number]
        count = table.first[number.astype(np.int64) + 1] - first
        total = np.concatenate([[0], np.cumsum(count)])
        ids = table.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        ends = np.cumsum([len(r) + 1 for r in raws])
        cut = total[np.searchsorted(start, ends)].tolist()
        return [ids[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _parts(self, raw: bytes) -> Iterator[bytes]:
        """A very long text in parts that end at a space."""
        at = 0
        while len(raw) - at > self._most:
            cut = raw.find(b" ", at + self._most)
            if cut < 0:
                break
            yield raw[at:cut]
            at = cut
        yield raw[at:]

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each UTF-8 text."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self._tok.encode_batch_fast([r.decode("utf-8", "replace") for r in raws], add_special_tokens=False)]
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for r in raws:
            # special tokens are matched before lower-casing, so texts that may have one keep their case
            r = r if b"<|" in r else r.lower()
            if len(r) > self._most:
                out += self._joined(held) if held else []
                held, size = [], 0
                out.append(np.concatenate([self._joined([p])[0] for p in self._parts(r)]))
                continue
            held.append(r)
            size += len(r)
            if size >= self._most:
                out += self._joined(held)
                held, size = [], 0
        return out + (self._joined(held) if held else [])
