"""Texts as words for tokenizers, so that each distinct word is encoded once.

A word starts at a space that follows anything but white space. No match of a byte-level splitting pattern reaches from
there into white space, and no piece of a sentence-piece vocabulary does unless it holds a space after another character
(`spaces_lead` tells), so the ids of the words, one after the other, are the ids of the text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a space follows white space, as Unicode or the C locale know it, or nothing: texts with such a place are cut by CUT.
ODD = r"(?:^|[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
CUT = re.compile(r"(?<=\S) ")
#: Bytes of texts that are taken apart at once, distinct words that a worker remembers, and their longest.
BLOCK, REMEMBERED, LONGEST = 1 << 23, 1 << 20, 64
#: Words that a function gets at once.
PART = 1 << 14


@dataclass
class Split:
    """words: distinct ones; at: for every word of every text in order, its place in words; bounds: each text's part of at."""

    words: list[str]
    at: np.ndarray
    bounds: np.ndarray


def split(texts: pa.Array) -> Split:
    """The words of each text, a null one being empty; joined by single spaces they are the text. Every text has a word."""
    texts = texts.cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    apart = [CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    flat = pa.concat_arrays([plain.flatten(), pa.array([w for t in apart for w in t], pa.string())])
    counts = np.zeros(len(texts), np.int64)
    counts[~odd], counts[odd] = plain.value_lengths().to_numpy(), [len(t) for t in apart]
    starts, n = np.zeros(len(texts), np.int64), np.concatenate([counts[~odd], counts[odd]])
    first = np.cumsum(n) - n
    starts[~odd], starts[odd] = first[: len(plain)], first[len(plain) :]
    coded, bounds = flat.dictionary_encode(), np.concatenate([[0], np.cumsum(counts)])
    return Split(coded.dictionary.to_pylist(), coded.indices.to_numpy()[spread(starts, counts)], bounds)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Remembered:
    """Results of a function over lists of words, kept by word; emptied when `most` words are known."""

    def __init__(self, function: Callable[[list[str]], list], most: int = REMEMBERED):
        self.function, self.most, self.known = function, most, {}

    def __call__(self, words: list[str]) -> list:
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if not new:
            return found
        made = [x for lo in range(0, len(new), PART) for x in self.function(new[lo : lo + PART])]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        self.known.update((w, x) for w, x in zip(new[: self.most], made) if len(w) <= LONGEST)
        rest = iter(made)
        return [next(rest) if x is None else x for x in found]


#: Marks that end a word of letters as a match of their own, and the characters below which letters are old and well known.
MARKS, LATIN = frozenset(".,;:!?"), "\u0250"


@lru_cache(maxsize=1)
def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others, in
    order, for the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class ByteLevel:
    """Words, each after `lead`, to their ids by the tokenizers library, as little-endian 32-bit numbers.

    A word of Latin letters alone is one match of the splitting pattern, and goes to the library's model as it is; one with
    a mark after it is two matches. All others go through the whole of the library.
    """

    def __init__(self, tokenizer, lead: str = " ", most: int = REMEMBERED):
        self.tokenizer, self.lead = tokenizer, lead
        self.marks = {m: self._whole([m])[0] for m in MARKS}
        self.letters = Remembered(self._letters, most)

    def __call__(self, words: list[str]) -> list[bytes]:
        plain, marked, rest = {}, {}, []
        for i, w in enumerate(words):
            if is_latin(w):
                plain[i] = w
            elif w[-1:] in MARKS and is_latin(w[:-1]):
                marked[i] = w[:-1]
            else:
                rest.append(i)
        out: list[bytes] = [b""] * len(words)
        for i, x in zip(plain, self.letters(list(plain.values()))):
            out[i] = x
        for i, x in zip(marked, self.letters(list(marked.values()))):
            out[i] = x + self.marks[words[i][-1]]
        for i, x in zip(rest, self._whole([self.lead + words[i] for i in rest])):
            out[i] = x
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        table, split_up = byte_characters(), self.tokenizer.model.tokenize
        return [array("I", [t.id for t in split_up((self.lead + w).encode().decode("latin-1").translate(table))]).tobytes() for w in words]

    def _whole(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        bounds = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(words) + 1)) * 4
        raw = np.array(coded.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def is_latin(word: str) -> bool:
    """Whether a word is of Latin letters alone."""
    return word.isalpha() and (word.isascii() or max(word) < LATIN)


def byte_level_tokenizer(raw: bytes, plain: bool):
    """The tokenizer of a file's bytes; plain takes the strings of special tokens within texts as ordinary text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(raw.decode())
    made.encode_special_tokens = plain
    return made


def spaces_lead(pieces: list[str]) -> bool:
    """Whether no piece of a sentence-piece vocabulary has its mark of a space after another character."""
    return not any("\u2581" in p.lstrip("\u2581") for p in pieces)
