"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i holds a mask whose bit l says
whether language l has set slot i. ANDing the masks of an n-gram's slots returns
all languages that contain it at once. A text's n-grams are counted per language,
the expected false positives are taken off, and the highest share decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordtable import slices

#: Letters per n-gram, hash places per n-gram, slots (a power of two).
N, HASHES, SLOT_BITS = 4, 2, 20
#: An n-gram belongs to a language if it makes up at least this share of the
#: language's n-grams, so a filter holds at most 1 / SHARE n-grams per language.
SHARE = 1e-5
#: Rows per language that the filters are fitted on, on average, at most.
FIT_ROWS = 4000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        values, place = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in values])[place]
    return out


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, text it is from, whether each text has a letter).

    Letters are lower-cased, everything else is a space, and each text stands
    between spaces; n-grams whose two inner places hold no letter are left out.
    """
    gap = " " * (N - 1)
    lowered = [(t or "").lower() for t in texts]
    joined = gap + gap.join(lowered) + gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _is_letter(codes)
    codes = np.where(letter, codes, np.uint64(32))
    key = np.zeros(len(codes) - N + 1, np.uint64)
    for k in range(N):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - N + 1 + k]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    sizes = np.array([len(t) + N - 1 for t in lowered], np.int64)
    owner = np.minimum(np.repeat(np.arange(len(texts)), sizes), len(texts) - 1)
    owner = np.concatenate([owner, np.full(max(0, len(key) - len(owner)), len(texts) - 1)])[: len(key)]
    keep = letter[1 : 1 + len(key)] | letter[2 : 2 + len(key)]
    has = np.bincount(owner[keep], minlength=len(texts)) > 0
    return key[keep], owner[keep], has


def places(key: np.ndarray) -> list[np.ndarray]:
    return [(key >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1) for k in range(HASHES)]


class Filters:
    """masks: slots x words of 64 languages; languages in code-point order."""

    def __init__(self, languages: list[str], keys: list[np.ndarray]):
        self.languages = languages
        self.masks = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
        for lang, key in enumerate(keys):
            for slot in places(key):
                self.masks[lang // 64, slot] |= np.uint64(1 << lang % 64)
        bits = [((self.masks[lang // 64] >> np.uint64(lang % 64)) & np.uint64(1)).mean() for lang in range(len(languages))]
        self.false = np.array(bits) ** HASHES  # chance that a foreign n-gram hits

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, corrected share of its n-grams, 0 to 1); und without a letter."""
        key, owner, has = ngrams(texts)
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        total = np.maximum(1, np.bincount(owner, minlength=len(texts)))
        slots = places(key)
        share = np.zeros((len(texts), len(self.languages)))
        for word, masks in enumerate(self.masks):
            found = masks[slots[0]]
            for slot in slots[1:]:
                found &= masks[slot]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                hit = (found >> np.uint64(bit)) & np.uint64(1)
                share[:, 64 * word + bit] = np.bincount(owner, hit, minlength=len(texts))
        share = (share / total[:, None] - self.false) / np.maximum(1e-9, 1 - self.false)
        best = share.argmax(axis=1)
        return [(self.languages[b], min(1.0, max(0.0, float(share[k, b])))) if has[k] else ("und", 0.0) for k, b in enumerate(best)]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, share: float = SHARE) -> Filters:
    """Filters from labelled rows; rows without text or language teach nothing, other columns are ignored.

    A seeded hash of the row picks about fit_rows rows per language at most. The
    driver receives the languages and, for each, at most 1 / share n-gram keys.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], [])
    ratio = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_rows / sizes[lang]))])
    draw = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(draw < F.element_at(ratio, F.col("lang"))).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                langs = np.array(piece.column(0).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    texts = [t for t, mine in zip(piece.column(1).to_pylist(), langs == lang, strict=True) if mine]
                    keys, counts = np.unique(ngrams(texts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "key", "n"])

    counted = cut(picked.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg((F.sum("n") * share).alias("least")).withColumnRenamed("lang", "t_lang")
    kept = counted.join(F.broadcast(totals), F.col("lang") == F.col("t_lang")).where("n >= least").select("lang", "key").toPandas()
    return Filters(languages, [kept.key[kept.lang == lang].to_numpy(np.int64).view(np.uint64) for lang in languages])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row: whole texts, no other column is read.

    und with score 0 if the text is null or has no letter, or nothing was learned. Of
    languages with equal shares the first in code-point order is taken. Null and repeated
    ids are ordinary rows, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # size fixed by SLOT_BITS and the number of languages

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for piece in slices(batch, 256):
                out = model.predict(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
