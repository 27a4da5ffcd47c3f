"""Token ids of whole texts as the tokenizers library gives them, with the library's merges kept per word.

The library is called once for each new word of a worker instead of once for each occurrence. Words
are cut only where no merge and no pattern of the tokenizer can reach across, and anything beyond
the Latin blocks, control characters and special strings go through the whole library.
"""

from __future__ import annotations

import re
import zlib
from array import array

#: Unicode White_Space.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters whose classes, normal forms and lower cases don't depend on the Unicode version.
ODD = re.compile("[^\\t-\\r -\\u012f\\u0131-\\u024f]|[\\x7f-\\xa0]")
#: Words of a generation; a worker remembers two generations of words and of pieces.
NO_WORDS = 150_000


def _latin(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if test(chr(c)))


LETTERS = _latin(str.isalpha)
#: Python's isnumeric() is category N on these blocks.
NUMBERS = _latin(lambda c: c.isnumeric())
#: The patterns of the two public tokenizers, with the classes spelt out.
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: A run of white space and the word after it: byte-level merges never cross the end of a word before white space.
SEGMENT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
SPLIT = re.compile(f"[^{WS}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memo(dict):
    """Word to what `make` makes of it. Holds what was asked for lately: a full generation becomes the old one,
    and what isn't asked for again goes with it, so a worker's memory is bounded."""

    def __init__(self, make, most: int = NO_WORDS):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class BpeIds:
    """Ids as little-endian unsigned 32-bit bytes. lower: the word-end tokenizer, that drops white space and case."""

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        #: Characters at an end that a special string cut there may reach back.
        self.guard = max((len(t.content) for t in self.whole.get_added_tokens_decoder().values()), default=0) + 1
        self.lower = lower
        self.pattern = WORD_PATTERN if lower else BYTE_PATTERN
        letters = byte_letters()
        self.table = [letters[b] for b in range(256)]
        self.plain = Memo(self._plain, 2 * NO_WORDS)
        self.words = Memo(self._word)

    def _plain(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # all but the space stand for themselves
            letters = word.replace(" ", self.table[32])
        else:
            letters = "".join([self.table[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or ODD.search(word):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        if not self.lower and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # one match of the pattern
            return self._plain(word)
        return b"".join([self.plain[w] for w in self.pattern.findall(word.lower() if self.lower else word)])

    def forget(self) -> None:
        for memo in (self.words, self.plain):
            memo.clear()
            memo.old = {}

    def ids(self, text: str) -> bytes:
        if self.lower and "<|" not in text and not ODD.search(text):
            # matches hold no white space, so they are the same in a text as in its words
            plain = self.plain
            return b"".join([plain[w] for w in self.pattern.findall(text.lower())])
        words = self.words
        return b"".join([words[w] for w in (SPLIT if self.lower else SEGMENT).findall(text)])


_LOADED: dict[tuple[str, bool], BpeIds] = {}


def load(path: str, lower: bool) -> BpeIds:
    """One tokenizer for each Python worker."""
    if (path, lower) not in _LOADED:
        _LOADED[path, lower] = BpeIds(path, lower)
    return _LOADED[path, lower]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
