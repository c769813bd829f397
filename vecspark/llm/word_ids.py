"""Ids of whole texts, batch by batch: distinct words are encoded together, ids are put together by number.

Texts are cut into the pre-tokenizer's words, words are numbered, and those not
met before are merged all at once: each step finds every word's lowest-ranked
pair in one array and merges it. A text's ids are then taken from the words' ids
by their numbers. What a worker keeps is bounded by words and bytes; when it is
full it starts anew.

A text that holds the string of an added token, and a word too long for the
steps above, go to the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

from vecspark.llm.pieces import ALPHABET, added_tokens, tokenizer

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of these characters only, which the faster of the two pattern libraries may cut.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_COMMON = re.compile(rf"[\t\n\r\x20-\x7E{_LETTERS}]*").fullmatch
_CUT_COMMON = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_CUT = regex.compile(PATTERN)
#: Words and bytes of words a worker keeps; bytes of a word merged here.
KEEP_WORDS, KEEP_BYTES, LONGEST = 250_000, 8 << 20, 64
_NONE = np.iinfo(np.int64).max


def cutter(text: str):
    return _CUT_COMMON if _COMMON(text) else _CUT


def cut(text: str) -> list[str]:
    """The pre-tokenizer's words of a text without added tokens."""
    return cutter(text).findall(text)


class Merges:
    """A vocabulary's merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(keys))[order], made
        self.byte_ids = np.array([ids[chr(ALPHABET.get(b, b))] for b in range(256)], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per word) of words of one byte or more."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(starts, append=len(owner))
            least = np.minimum.reduceat(ranks, starts)
            going = least < _NONE
            alive = np.repeat(going, lengths)
            if not going.all():
                done_symbols.append(symbols[~alive])
                done_owner.append(owner[~alive])
                symbols, owner, ranks, least, lengths = symbols[alive], owner[alive], ranks[alive], least[going], lengths[going]
                if not len(symbols):
                    break
            # of every word the first place of its lowest rank
            hits = np.flatnonzero(ranks == np.repeat(least, lengths))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            symbols[hits] = self.made[least]
            kept = np.ones(len(symbols), bool)
            kept[hits + 1] = False
            place = hits - np.arange(len(hits))
            symbols, owner, ranks = symbols[kept], owner[kept], ranks[kept]
            for at in (place, place - 1):
                at = at[at >= 0]
                last = at + 1 >= len(symbols)
                after = np.where(last, at, at + 1)
                ranks[at] = np.where(last | (owner[at] != owner[after]), _NONE, self.rank(symbols[at], symbols[after]))
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))


class WordIds:
    """What a worker knows of words: a number each, and their ids by number."""

    def __init__(self, path: str, keep_words: int = KEEP_WORDS, keep_bytes: int = KEEP_BYTES):
        self.library, self.added, self.merges = tokenizer(path), added_tokens(path), Merges(path)
        self.keep_words, self.keep_bytes = keep_words, keep_bytes
        self._clear()

    def _clear(self):
        self.numbers, self.fresh, self.size = _Numbers(), [], 0
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _bounded(self):
        if len(self.numbers) > self.keep_words or self.size > self.keep_bytes:
            self._clear()

    def _learn(self):
        """Encodes the words numbered since the last time."""
        fresh = [w.encode() for w in self.numbers.fresh]
        short = [w for w in fresh if len(w) <= LONGEST]
        ids, n = self.merges.merge(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(short) < len(fresh):
            counts, parts, at, s = np.zeros(len(fresh), np.int64), [], 0, 0
            for i, word in enumerate(fresh):
                if len(word) <= LONGEST:
                    parts.append(ids[at:at + n[s]])
                    at, s = at + n[s], s + 1
                else:
                    parts.append(np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, np.int64))
                counts[i] = len(parts[-1])
            ids, n = np.concatenate(parts), counts
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.counts, n])
        self.size += sum(map(len, fresh))
        self.numbers.fresh = []

    def packed_words(self, words: list[str]) -> bytes:
        """The packed ids of words that have been cut already."""
        self._bounded()
        which = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.fresh:
            self._learn()
        return np.concatenate([self.ids[:0], *(self.ids[a:a + n] for a, n in zip(self.starts[which].tolist(), self.counts[which].tolist()))]).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text)."""
        self._bounded()
        whole, codes = {}, []
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                whole[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                codes.append(np.zeros(0, np.int64))
                continue
            words = cut(text)
            codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        if self.numbers.fresh:
            self._learn()
        which = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        n = self.counts[which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
        passed = np.concatenate([[0], ends])[words] if len(words) else words
        counts = np.diff(passed, prepend=0)
        if whole:
            parts = np.split(ids, passed[:-1])
            for i, found in whole.items():
                parts[i], counts[i] = found, len(found)
            ids = np.concatenate(parts)
        return ids, counts

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(texts)
        data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker."""
    return WordIds(path)
