"""A bounded word -> token table that lets whole texts be tokenized by lookup.

The vocabulary's normalizer and pre-tokenizer never look across white space, so a
text's tokens are its words' tokens in a row. Each new word is encoded once per
worker; everything else is a dictionary lookup and numpy gathers.
"""

from __future__ import annotations

import re

import numpy as np

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = re.compile("[\x1c-\x1f]")


def words_of(text: str | None) -> list[str]:
    """White-space separated words, as the vocabularies' \\s sees white space.

    str.split() also breaks at \\x1c-\\x1f, which are not white space there.
    """
    if not text:
        return []
    return _WORDS.findall(text) if _ODD.search(text) else text.split()


def folded(text: str | None) -> str | None:
    """A text with the same tokens in a vocabulary that lower-cases, but fewer different words.

    Latin-1 texts are lower-cased (letter by letter there, and stable under NFC). Texts
    that may hold special tokens, whose case counts, stay as they are.
    """
    if not text or "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class _Numbers(dict):
    """word -> number, in order of first sight; new words are remembered."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class WordTable:
    """encode(list of words) -> (lengths, flat values); kept for about limit words.

    The limit bounds memory only: a full table keeps its most used words, others are
    encoded again when they come back, so results never depend on it.
    """

    def __init__(self, encode, limit: int = 300_000, fold: bool = False):
        self.encode, self.limit, self.fold = encode, limit, fold
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keep words used three times or more, at most half of the limit."""
        kept = np.flatnonzero(self.uses >= 3)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.limit // 2]])
        words, lengths, starts = list(self.numbers), self.lengths[kept], self.starts[kept]
        self.numbers = _Numbers()
        self.numbers.update((words[k], n) for n, k in enumerate(kept.tolist()))
        new = np.cumsum(lengths) - lengths
        if len(self.flat):
            self.flat = self.flat[np.arange(int(lengths.sum())) + np.repeat(starts - new, lengths)]
            self.starts = new
        else:
            self.starts = starts
        self.lengths, self.uses = lengths, self.uses[kept] // 2

    def numbers_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text."""
        if len(self.numbers) > self.limit:
            self.shrink()
        get, parts, counts = self.numbers.__getitem__, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = words_of(folded(text) if self.fold else text)
            counts[k] = len(words)
            parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.uses = np.bincount(numbers, minlength=len(self.numbers)) + np.pad(self.uses, (0, len(self.numbers) - len(self.uses)))
        return numbers, counts

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        lengths, flat = self.encode(fresh)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, starts])
        self.flat = np.concatenate([self.flat, flat])

    def token_counts(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self.numbers_of(texts)
        ends = np.cumsum(np.concatenate([[0], self.lengths[numbers]]))
        at = np.concatenate([[0], np.cumsum(counts)])
        return ends[at[1:]] - ends[at[:-1]]

    def token_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row and the number of ids of each text."""
        numbers, counts = self.numbers_of(texts)
        lengths, starts = self.lengths[numbers], self.starts[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
        edge = np.concatenate([[0], ends])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids, edge[at[1:]] - edge[at[:-1]]


def slices(batch, rows: int = 512):
    """Small pieces of an Arrow batch, so that numpy intermediates stay small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
