"""Text pieces that a byte-level BPE tokenizer encodes independently of each other.

The pre-tokenizer always breaks between a character that is no white space and
a white-space character after it, before a single space between two words,
behind a single line end between two lines, and between a letter and a mark of
punctuation. So a text may be cut there, each piece encoded by the library
alone, and the ids joined; frequent pieces are encoded once per worker.
Added-token strings hold no white space; where a word may hold one, it is cut
at white space only.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed class: letters in every Unicode version, of one or two bytes.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: After what every Unicode version takes for a visible character, before what every one takes for white space.
SYNC = re.compile(r"(?<=\S)(?=[ \t\n\r])")
FINE = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=\S\n)(?=\S)|(?<={LETTER})(?=[.,;:!?)\]\"])")
PLAIN = re.compile(f" ?{LETTER}+").fullmatch
#: The vocabulary's alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def in_alphabet(piece: str) -> str:
    if piece.isascii() and piece[1:].isalpha():
        return _FIRST.get(piece[0], piece[0]) + piece[1:]
    return piece.encode().decode("latin-1").translate(ALPHABET)


#: How a space reads there, for the frequent case of a space and letters.
_FIRST = {" ": chr(ALPHABET[32])}


class _Spaced(Exception):
    """A word beside a run of white space: the text is cut by pattern instead."""


class Kept(dict):
    """Made values, kept in two generations of at most ``keep``; those in use move on to the newer one."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Pieces:
    """Values of texts, joined from the values of independent pieces.

    ``plain(piece)`` gives the value of one pre-token of letters, ``other(piece)``
    of any other text; ``join`` adds values up. ``added`` are strings that must
    not be cut.
    """

    def __init__(self, plain, other, join, added=(), keep: int = 500_000):
        self.plain, self.other, self.join = plain, other, join
        self.marks = {a[0] for a in added}
        self.words, self.parts = Kept(self._word, keep), Kept(self._part, keep // 4)

    def _part(self, piece: str):
        return self.plain(piece) if PLAIN(piece) else self.other(piece)

    def _cut(self, text: str):
        return (SYNC if any(m in text for m in self.marks) else FINE).split(text)

    def _word(self, word: str):
        """The value of a space and the word."""
        if word.isalpha() and word.isascii():
            return self.plain(" " + word)
        body, mark = word[:-1], word[-1:]
        if mark and mark in ".," and body.isalpha() and body.isascii():
            return self.join((self.words[body], self.parts[mark]))
        if PLAIN(" " + word):
            return self.plain(" " + word)
        if not word or word[0].isspace() or mark.isspace():
            raise _Spaced
        first, *rest = self._cut(" " + word)
        if not rest:
            return self._part(first)
        return self.join([self.words[first[1:]], *map(self.parts.__getitem__, rest)])

    def of(self, text: str):
        """The value of a whole text."""
        head, *rest = text.split(" ")
        try:
            found = list(map(self.words.__getitem__, rest))
        except _Spaced:
            return self.join([self.parts[p] for p in SYNC.split(text)])
        if head:
            found[:0] = [self.parts[p] for p in self._cut(head)]
        return self.join(found)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, once per worker, without truncation and padding."""
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def added_tokens(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def id_pieces(path: str) -> Pieces:
    """Pieces with their ids as little-endian unsigned 32-bit integers."""
    encode, merge = tokenizer(path).encode, tokenizer(path).model.tokenize
    single = [n.to_bytes(4, "little") for n in range(tokenizer(path).get_vocab_size())]
    return Pieces(lambda piece: b"".join([single[t.id] for t in merge(in_alphabet(piece))]),
                  lambda piece: b"".join([single[i] for i in encode(piece, add_special_tokens=False).ids]), b"".join, added_tokens(path))
