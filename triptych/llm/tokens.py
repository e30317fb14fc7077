"""Encoding by a given tokenizer, one distinct word at a time.

A text is split where a word ends and ASCII white space begins. Both kinds of tokenizer
that are used here always end a token there, so that the tokens of the parts, one after
the other, are the tokens of the text. A batch encodes each distinct part once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

# Distinct parts that a task remembers before it starts anew.
CACHE_WORDS = 600_000
# Words that the tokenizer gets at a time: its encodings are large.
WORDS_PER_CALL = 8192

# A part keeps the white space before it, or is without. Letters before a stop are a part too:
# a byte-level tokenizer takes letters alone, so it has a boundary there.
WITH_BLANK = re.compile(r"[ \t\n\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,:;!?])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
WITHOUT_BLANK = re.compile(r"[^ \t\n\r]+")
# White space beyond those four may belong to the run that the next part begins with.
ODD_BLANK = re.compile(r"[^\S \t\n\r]")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(tokenizer, words: list[str]) -> Iterator:
    """The encodings of words, of which only some are held at a time."""
    for start in range(0, len(words), WORDS_PER_CALL):
        yield from tokenizer.encode_batch_fast(words[start:start + WORDS_PER_CALL], add_special_tokens=False)


class WordCounts:
    """Numbers of tokens, for a tokenizer that drops white space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = load_tokenizer(path)
        self.cache_words = cache_words
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        parts = [WITHOUT_BLANK.findall(text) for text in texts]
        if len(self.known) > self.cache_words:
            self.known.clear()
        known = self.known
        new = list({word for words in parts for word in words if word not in known})
        known.update(zip(new, map(len, _encoded(self.tokenizer, new)), strict=True))
        return [sum(map(known.__getitem__, words)) for words in parts]


class _Places(dict):
    """Words by the order in which they are first asked for; `new` has those of late."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordIds:
    """Token ids, for a byte-level tokenizer whose words begin with their blank."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = load_tokenizer(path)
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        ids = [e.ids for e in _encoded(self.tokenizer, self.places.new)]
        self.places.new.clear()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > self.cache_words:
            self._forget()
        place = self.places.__getitem__
        parts = [[text] if ODD_BLANK.search(text) else WITH_BLANK.findall(text) for text in texts]
        at = [np.fromiter(map(place, words), np.int64, len(words)) for words in parts]
        if self.places.new:
            self._learn()
        return [self._gather(words) for words in at]

    def _gather(self, at: np.ndarray) -> np.ndarray:
        lengths = self.lengths[at]
        shift = self.starts[at] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]
