"""Token counts by rank-synchronous array merging.

All new pre-tokens of a batch lie in one ragged numpy array. Each round looks up
the rank of every adjacent pair, takes the lowest rank of every sequence and
merges all its occurrences in all sequences at once; sequences without a mergeable
pair leave the array. The surviving symbols are the tokens. A pair's own merge
can only make pairs of higher rank, so merging all occurrences in one round equals
merging them one by one from the left; a vocabulary for which this doesn't hold is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtable import WordTable, slices

_NONE = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes take code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if not self.ascending(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), made):
            raise ValueError("a merge of the vocabulary makes a symbol that a merge of lower rank needs")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @staticmethod
    def ascending(left: np.ndarray, right: np.ndarray, made: np.ndarray) -> bool:
        """Whether every merge, in order of rank, reads only symbols that are no merge's or a lower one's result."""
        size = int(max(left.max(initial=0), right.max(initial=0), made.max(initial=0))) + 1
        first = np.full(size, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]  # the lowest rank that makes a symbol
        rank = np.arange(len(made))
        return bool((first[left] < rank).all() and (first[right] < rank).all())

    def pretokens(self, word: str) -> tuple[int, list[bytes]]:
        """Number of special tokens in the word, and the UTF-8 pre-tokens of the rest."""
        parts = self.special.split(word) if self.special and "<" in word else [word]
        found: list[bytes] = []
        for part in parts[::2]:
            text = unicodedata.normalize("NFC", part)
            # letter by letter: no final-sigma rule
            text = text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)
            found += [p.encode("utf-8", "surrogatepass") for p in self.split.findall(text)]
        return len(parts) // 2, found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Number of surviving symbols of each pre-token."""
        lengths = np.array([len(p) for p in pretokens], np.int64)
        out = lengths.copy()
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        if not len(raw):
            return out
        sym = self.inner[raw]
        ends = np.cumsum(lengths)
        last = ends[lengths > 0] - 1
        sym[last] = self.final[raw[last]]
        who = np.flatnonzero(lengths > 0)
        lengths = lengths[who]
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(sym):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            live = least < _NONE
            out[who[~live]] = lengths[~live]
            if not live.any():
                break
            if not live.all():
                keep = np.repeat(live, lengths)
                sym, rank, who, lengths, least = sym[keep], rank[keep], who[live], lengths[live], least[live]
            hit = rank == np.repeat(least, lengths)
            if (hit[1:] & hit[:-1]).any():  # a run such as aaa: from the left, each second one
                place = np.arange(len(hit))
                hit &= ((place - np.maximum.accumulate(np.where(hit, -1, place))) & 1) == 1
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # whether another symbol of the sequence follows is settled below
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            lengths = lengths - np.add.reduceat(gone, np.cumsum(lengths) - lengths, dtype=np.int64)
            keep = ~gone
            new_at = np.cumsum(keep)[at] - 1
            sym, rank = sym[keep], rank[keep]
            touched = np.unique(np.concatenate([new_at, new_at[new_at > 0] - 1]))
            touched = touched[touched < len(sym) - 1]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
            rank[np.cumsum(lengths) - 1] = _NONE
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For WordTable: token counts of words; the values themselves are not kept."""
        extra, sizes, flat = [], [], []
        for word in words:
            special, found = self.pretokens(word)
            extra.append(special)
            sizes.append(len(found))
            flat += found
        ends = np.concatenate([[0], np.cumsum(self.count(flat))]) if flat else np.zeros(1, np.int64)
        at = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        return ends[at[1:]] - ends[at[:-1]] + np.array(extra, np.int64), np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    return WordTable(RankMerger(path).encode, fold=True)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Null and empty texts have no bytes and no tokens; null and repeated ids are
    passed through, one result row per input row; other columns are ignored.
    tokenizer is the path of a vocabulary every executor has.
    """

    def run(batches):
        import pyarrow as pa

        table = _table(tokenizer)
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(table.token_counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
