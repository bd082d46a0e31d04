"""Packing token pieces into fixed windows by minimum bin slack.

A document longer than the window is cut into full windows and one remainder, so
only remainder lengths (fewer than the window) need packing. The packer works on
the histogram of lengths, which has at most `window` rows however many documents
there are: a subset-sum over an integer used as a bitset finds the multiset of
remaining lengths that fills a window closest, backtracking gives its counts, and
the pattern is repeated as often as the counts allow. The plan's patterns are then
dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .wordtable import WordTable, slices

#: A character that is a token of its own between spaces; words that hold it go apart.
SEPARATOR = "\x01"
#: How a vocabulary marks the last token of a pre-token.
WORD_END = "</w>"
#: Rows that one rank bucket of one length holds on average, at most.
BUCKET_ROWS = 250_000


def fullest(counts: dict[int, int], order: list[int], first: int, window: int) -> dict[int, int]:
    """The multiset with one `first` whose sum is closest to the window from below.

    counts: how many pieces of each length are left; order: lengths, descending.
    """
    room, reached, steps = window - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in order:
        if length > room:
            continue
        left, take = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reached >> room & 1:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & mask
            left, take = left - take, take * 2
        if reached >> room & 1:
            break
    at, found = reached.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, count)]) patterns that use up the histogram exactly.

    Every pattern is repeated until one of its lengths runs short, so their number
    depends on the window, hardly on the number of pieces.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    order, patterns = sorted(counts, reverse=True), []
    while order:
        found = fullest(counts, order, order[0], window)
        times = min(counts[length] // n for length, n in found.items())
        patterns.append((times, sorted(found.items(), reverse=True)))
        for length, n in found.items():
            counts[length] -= n * times
        order = [length for length in order if counts[length]]
    return patterns


def assign(pieces: DataFrame, window: int, tie: list[str], length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces (each 1 to window long).

    Pieces are read four times, so hand in a materialised frame. tie: columns that
    spread the pieces of one length over rank buckets and order them there; rows
    equal in all of them are interchangeable. An empty frame stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # window rows at most
    buckets = max(64, sum(histogram.values()) // BUCKET_ROWS)
    rows, sequence = [], 0
    used: dict[int, int] = {}
    for times, found in plan(histogram, window):
        offset = 0
        for size, n in found:
            start = used.get(size, 0)
            used[size] = start + n * times
            rows.append((size, start, start + n * times, n, sequence, offset))
            offset += size * n
        sequence += times
    ranges = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, p_n long, p_sequence long, p_offset long")

    bucket = F.pmod(F.xxhash64(*tie), F.lit(buckets))
    dealt = pieces.withColumn("p_bucket", bucket)
    cells = dealt.groupBy(F.col(length).alias("c_length"), F.col("p_bucket").alias("c_bucket")).agg(F.count("*").alias("c_n"))
    before = Window.partitionBy("c_length").orderBy("c_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("c_before", F.coalesce(F.sum("c_n").over(before), F.lit(0))).drop("c_n")
    within = Window.partitionBy(length, "p_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in tie])
    ranked = dealt.withColumn("p_row", F.row_number().over(within) - 1)
    ranked = ranked.join(cells, (F.col(length) == F.col("c_length")) & (F.col("p_bucket") == F.col("c_bucket"))).withColumn("p_rank", F.col("c_before") + F.col("p_row"))
    # the plan has a bounded number of rows (see plan), whatever the input
    placed = ranked.join(F.broadcast(ranges), (F.col(length) == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to")))
    nth = F.col("p_rank") - F.col("p_from")
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("p_sequence") + F.floor(nth / F.col("p_n"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + nth % F.col("p_n") * F.col(length)).cast("long").alias("offset"),
    )


def _pretokens(word: str) -> int:
    """1 for Latin-1 letters, 2 with a stop or comma after them, 0 for anything else."""
    if word[-1] in ".,":
        return 2 if word[:-1].isalpha() and max(word) < "\u0100" else 0
    return 1 if word.isalpha() and max(word) < "\u0100" else 0


@lru_cache(maxsize=2)
def _ids(path: str) -> WordTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    mark = tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
    vocabulary = tokenizer.get_vocab()
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def lines(words, between):
        texts = [between.join(words[k : k + 64]) + between for k in range(0, len(words), 64)]
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]])

    def apart(words):
        """Any words: with SEPARATOR between them, or one by one if that can't tell them apart."""
        if len(mark) != 1 or any(SEPARATOR in w for w in words):
            ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)
        flat = lines(words, f" {SEPARATOR} ")
        ends = np.flatnonzero(flat == mark[0])
        return np.diff(ends, prepend=-1) - 1, np.delete(flat, ends)

    def encode(words):
        """Latin-1 letters, at most a stop or comma after them, are one or two pre-tokens,
        whose last tokens are marked in the vocabulary; other words go apart."""
        kinds = np.array([_pretokens(w) for w in words])
        plain = np.flatnonzero(kinds)
        flat = lines([words[k] for k in plain.tolist()], " ")
        ends = np.flatnonzero(ends_word[flat])
        last = np.cumsum(kinds[plain]) - 1
        if len(ends) != (last[-1] + 1 if len(last) else 0):
            return apart(words)  # a vocabulary that marks no word ends
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = np.diff(ends[last], prepend=-1)
        others = np.flatnonzero(kinds == 0)
        if not len(others):
            return lengths, flat
        odd, more = apart([words[k] for k in others.tolist()])
        lengths[others] = odd
        out = np.zeros(len(flat) + len(more), np.uint32)
        from_plain = np.repeat(kinds > 0, lengths)
        out[from_plain], out[~from_plain] = flat, more
        return lengths, out

    return WordTable(encode, 400_000, fold=True)


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids: each text's ids, then end_id, cut at every window ids.

    ids: little-endian unsigned 32-bit ids. A null or empty text is one piece that
    holds end_id alone; repeated rows give their pieces once each.
    """

    def run(batches):
        import pyarrow as pa

        table = _ids(tokenizer)
        for batch in batches:
            for piece in slices(batch, 256):
                flat, counts = table.token_ids(piece.column(1).to_pylist())
                full = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                raw, totals = full.tobytes(), counts + 1
                cuts = (totals + window - 1) // window
                owner = np.repeat(np.arange(len(totals)), cuts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(window, totals[owner] - start)
                at = (np.cumsum(totals) - totals)[owner] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(owner)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(totals[owner], pa.int64()),
                        pa.array([raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """Token pieces of docs with their sequence_id and offset.

    Null and empty texts are one piece of end_id alone; null and repeated ids are ordinary
    rows; an empty table gives no rows; other columns are ignored. Words are encoded
    together: plain ones 64 to a line, told apart by the vocabulary's word ends, all
    others with a separator between them, or one by one where that can't tell them apart.

    keep: name -> expression over token_pieces' columns to carry instead of the ids
    themselves, such as a digest; the default carries the ids.
    """
    pieces = token_pieces(docs, tokenizer, window, end_id)
    extra = {"ids": F.col("ids")} if keep is None else keep
    pieces = cut(pieces.select("doc_id", "start", "length", *[e.alias(n) for n, e in extra.items()], "doc_tokens"))
    return assign(pieces, window, ["doc_id", "start", *[n for n in extra if n != "ids"]])
