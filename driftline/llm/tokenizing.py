"""Encoding whole texts with a public tokenizer, one memory of units per worker.

A corpus has few distinct units against its length. Where blanks, letters, digits and signs part, a tokenizer of
kind "split, white space dropped" never lets a token or a normalisation cross; every distinct unit between such
places is encoded once by the tokenizers library and its ids are gathered for all places it stands at. Units are
cut, looked up and gathered by numpy over the bytes of many documents at once; short ones are told apart by their own
bytes in two words of 64 bits, never by a hash alone.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from .arrays import mixed, runs, utf8

#: Distinct units remembered per worker; at more, the memory starts anew (results don't depend on it).
CACHE_UNITS = 1 << 20
#: Bytes of text encoded at once.
TEXT_BYTES = 1 << 19
#: Longest unit whose bytes are its key: 15 bytes and one for the length.
KEY_BYTES = 15
#: The only normaliser and splitter for which these cuts are proven exact (fixed values).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Classes of bytes. What a piece between blanks holds of class OTHER (an apostrophe may start a unit with letters, "<" a
#: special token, other scripts may be composed anew) sends the whole piece through the library.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, 0x0A]] = BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTER  # 0xC3 leads the letters from U+00C0 to U+00FF
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = SIGN
#: How the byte-level alphabet writes the two UTF-8 bytes of those letters: bytes that aren't printable stand 0x100 up in order.
_UNPRINTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTES = {c: "".join(chr(0x100 + _UNPRINTED.index(b) if b in _UNPRINTED else b) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Pool:
    """Id lists by number, end to end in one array."""

    def __init__(self, dtype: np.dtype):
        self.ids, self.used, self.n = np.zeros(1 << 16, dtype), 0, 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The lists of the next len(sizes) numbers."""
        last, end = self.n + len(sizes), self.used + len(ids)
        while len(self.at) < last:
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[self.n : last] = sizes
        self.at[self.n : last] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : end] = ids
        self.n, self.used = last, end

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these numbers end to end, where each ends)."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        where = np.repeat(self.at[numbers] - (ends - sizes), sizes)
        where += np.arange(len(where))
        return self.ids[where], ends


class _Table:
    """Numbers of keys of two 64-bit words: open addressing, all keys of a call probed side by side."""

    def __init__(self, most: int):
        size = 1 << (2 * most - 1).bit_length()
        self.last, self.n = np.uint64(size - 1), 0
        self.low, self.high, self.number = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) & self.last).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for an unknown one."""
        slot = self._slot(low, high)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(todo):
            slot[todo] = at = (slot[todo] + 1) & int(self.last)
            out[todo] = got = self.number[at]
            todo = todo[(got >= 0) & ((self.low[at] != low[todo]) | (self.high[at] != high[todo]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, first: int) -> None:
        """Numbers first, first + 1, ... for distinct keys that aren't there."""
        slot, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            at = slot[todo]
            free = self.number[at] < 0
            self.number[at[free]] = todo[free] + first
            won = free & (self.number[at] == todo + first)  # of several for one slot the last has it
            self.low[at[won]], self.high[at[won]] = low[todo[won]], high[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & int(self.last)
        self.n += len(low)


def _units(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class, text with Latin letters in lower case) of the units of documents laid end to end."""
    kind = _CLASS[text]
    lead = np.flatnonzero(text[:-1] == 0xC3)
    lower = text | ((text - 0x41 < 26).view(np.uint8) << 5)
    if len(lead):
        second = text[lead + 1]
        sign = (second == 0x97) | (second == 0xB7)
        kind[lead + 1] = np.where(sign, OTHER, LETTER)
        kind[lead[sign]] = OTHER
        lower[lead + 1] = second | (((second < 0x9F) & ~sign).view(np.uint8) << 5)
    change = np.empty(len(text), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(text)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(text))
    kinds = kind[start]
    if (kinds == OTHER).any():
        # all units of a piece with a byte of class OTHER become one
        blank = kinds == BLANK
        fresh = np.empty(len(start), bool)
        fresh[0] = True
        fresh[1:] = blank[:-1] | blank[1:]
        fresh[np.searchsorted(start, offsets[:-1][offsets[:-1] < len(text)])] = True
        head = np.flatnonzero(fresh)
        whole = np.logical_or.reduceat(kinds == OTHER, head)
        piece = np.cumsum(fresh) - 1
        end = np.where(whole[piece], np.append(end[head[1:] - 1], len(text))[piece], end)
        kinds = np.where(whole[piece], OTHER, kinds)
        keep = (fresh | ~whole[piece]) & ~blank
    else:
        keep = kinds != BLANK
    return start[keep], end[keep], kinds[keep], lower


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_unit = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and steps[0].get("pattern") == {"Regex": _SPLIT}
            and steps[0].get("behavior") == "Removed"
            and all("<" in x["content"] and not {" ", "\n"} & {*x["content"]} for x in made.get("added_tokens", []))
        )
        self._forget()

    def _forget(self) -> None:
        self.table, self.long, self.lists = _Table(CACHE_UNITS), {}, _Pool(self.dtype)

    def _library(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def _learn(self, units: list[bytes], letters: list[bool]) -> None:
        """Ids of new units. Lower-case Latin letters are one unit of the splitter and go to the library's model at once;
        all else goes through its whole pipeline."""
        tokenize = self.model.tokenize
        lists = [[t.id for t in tokenize(x.decode() if x.isascii() else x.decode().translate(_BYTES))] if own else None for x, own in zip(units, letters, strict=True)]
        rest = iter(self._library([x.decode() for x, own in zip(units, letters, strict=True) if not own]))
        lists = [next(rest) if x is None else x for x in lists]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.lists.add(np.fromiter(chain.from_iterable(lists), self.dtype, int(n.sum())), n)

    def _numbers(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
        size = end - start
        padded = np.concatenate([lower, np.zeros(16, np.uint8)])
        for k in np.flatnonzero(kinds == OTHER):  # these go as they are
            padded[start[k] : end[k]] = text[start[k] : end[k]]
        eight = np.ndarray((len(text) + 9,), "<u8", padded.data, strides=(1,))  # the eight bytes from every place on
        low = eight[start] & _MASKS[np.minimum(size, 8)]
        high = eight[np.minimum(start + 8, len(text))] & _MASKS[np.clip(size - 8, 0, 7)]
        # the class is part of the key: the same letters in a piece of class OTHER aren't in lower case
        high |= (size | (kinds == OTHER).astype(np.int64) << 4).astype(np.uint64) << np.uint64(56)
        short = size <= KEY_BYTES
        if short.all():
            out = self.table.find(low, high)
        else:
            out = np.full(len(start), -1, np.int32)
            out[short] = self.table.find(low[short], high[short])
        new = np.flatnonzero(short & (out < 0))
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            one = order[first]
            self.table.add(low[one], high[one], self.lists.n)
            out[order] = self.lists.n + np.cumsum(first) - 1
            data = padded.tobytes()
            self._learn([data[a:z] for a, z in zip(start[one].tolist(), end[one].tolist(), strict=True)], (kinds[one] == LETTER).tolist())
        if not short.all():
            fresh: list[tuple[bytes, bool]] = []
            for k in np.flatnonzero(~short).tolist():
                key = (padded[start[k] : end[k]].tobytes(), kinds[k] == LETTER)
                if (number := self.long.get(key)) is None:
                    self.long[key] = number = self.lists.n + len(fresh)
                    fresh.append(key)
                out[k] = number
            if fresh:
                self._learn(*map(list, zip(*fresh, strict=True)))
        return out

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), as encode_batch(add_special_tokens=False) gives, of the UTF-8 bytes of
        texts laid end to end and the offsets between them."""
        n = len(offsets) - 1
        if not len(text):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        if not self.by_unit:
            data = text.tobytes()
            each = self._library([data[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.fromiter(chain.from_iterable(each), self.dtype), np.array([len(x) for x in each], np.int64)
        if self.lists.n > CACHE_UNITS - TEXT_BYTES // 2:
            self._forget()
        start, end, kinds, lower = _units(text, offsets)
        ids, ends = self.lists.take(self._numbers(text, start, end, kinds, lower))
        return ids, np.diff(np.append(0, ends)[np.searchsorted(start, offsets[1:])], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(batches, path: str, end_id: int | None):
    """For each run of rows (id, text, others ...) of record batches: the rows but for their text, then (ids, offsets) with
    end_id after each text. A text longer than a run is cut at blanks, between which no unit lies."""
    enc = encoder(path)
    for batch in batches:
        text, offsets = utf8(batch.column(1))
        rest = batch.drop_columns([batch.schema.names[1]])
        for first, last in runs(offsets, TEXT_BYTES):
            part, at = text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            if last == first + 1 and len(part) > 2 * TEXT_BYTES and enc.by_unit:
                each = [enc.encode(part[a:z], np.array([0, z - a])) for a, z in _stretches(part)]
                ids, sizes = np.concatenate([x for x, _ in each]), np.array([sum(int(n[0]) for _, n in each)])
            else:
                ids, sizes = enc.encode(part, at)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
            yield rest.slice(first, last - first), ids, np.concatenate([[0], np.cumsum(sizes)])


def _stretches(text: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of stretches of about TEXT_BYTES that end after a blank."""
    blanks = np.flatnonzero(_CLASS[text] == BLANK) + 1
    cuts = blanks[np.unique(np.searchsorted(blanks, np.arange(TEXT_BYTES, len(text), TEXT_BYTES)).clip(max=max(len(blanks) - 1, 0)))] if len(blanks) else blanks
    edges = [0, *cuts[cuts < len(text)].tolist(), len(text)]
    return list(zip(edges, edges[1:], strict=False))
