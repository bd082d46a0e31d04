"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are linked when few bits differ. The bits are cut into blocks;
a link within the budget leaves at least `agree` blocks equal, so fingerprints meet in
the tables keyed by every choice of `agree` blocks. Within a key a binary trie is
joined with itself: node pairs go down together, gather the bits in which they
differ and are dropped as soon as the budget is exceeded. Links come out as a tree
per key, so a group of n near copies gives n - 1 rows, not n squared.
"""

from __future__ import annotations

import re
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_keys
from .components import components
from .wordtable import slices

BITS = 64
#: Distinct fingerprints of one key that one task joins; larger keys are split exactly.
KEY_ROWS = 20_000
#: Node pairs expanded at once; the rest waits on a stack.
CHUNK = 200_000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, words: int = 4) -> list[int]:
    """XXH64 (seed 42) of each run of `words` words of the text, A-Z lower-cased, space-joined."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(line, 42)]
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-words])]
    return [xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    raw, total = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for at in range(0, len(raw), CHUNK):
        total += np.unpackbits(raw[at : at + CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = total * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                found = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in piece.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def masks(budget: int, agree: int) -> list[int]:
    """Bit masks of every choice of `agree` among budget + agree nearly equal blocks."""
    n = budget + agree
    edges = [BITS * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


class Joiner:
    """Trie join of sorted distinct fingerprints, joining what is near into components."""

    def __init__(self, values: np.ndarray, budget: int):
        self.values, self.budget = values, budget
        self.root = np.arange(len(values))

    def find(self, at: np.ndarray) -> np.ndarray:
        up = self.root[at]
        while True:
            over = self.root[up]
            if (over == up).all():
                return up
            up = over

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def halves(self, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose bit is set: values share all higher bits, so it is a split."""
        lo, hi = lo.copy(), hi.copy()
        one = np.uint64(1)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            is_set = (self.values[np.minimum(mid, len(self.values) - 1)] >> bit) & one == one
            hi = np.where(open_ & is_set, mid, hi)
            lo = np.where(open_ & ~is_set, mid + 1, lo)

    def run(self, starts: np.ndarray, ends: np.ndarray, split: np.ndarray | None = None) -> None:
        """Put what is near into components, by walk."""

        def whole(a0: int, a1: int, b0: int, b1: int) -> None:
            members = np.concatenate([np.arange(a0, a1), np.arange(b0, b1)])
            self.unite(members[1:], np.full(len(members) - 1, members[0]))

        self.walk(starts, ends, split, self.unite, whole)

    def walk(self, starts: np.ndarray, ends: np.ndarray, split: np.ndarray | None, near, whole=None) -> None:
        """Join the members [start, end) of each key with themselves; with split, only
        members before it with members from it on (both sorted).

        near(a, b) gets places of members within the budget. whole(a0, a1, b0, b1) gets
        two ranges that are linked throughout; without it near gets all their pairs.
        """
        if whole is None:

            def whole(a0: int, a1: int, b0: int, b1: int) -> None:
                for a in range(a0, a1):
                    first = a + 1 if (a0, a1) == (b0, b1) else b0
                    near(np.full(b1 - first, a), np.arange(first, b1))

        first = (starts, ends, starts, ends) if split is None else (starts, split, split, ends)
        zero = np.zeros(len(starts), np.int64)
        stack = [(*first, zero, np.full(len(starts), BITS - 1))]
        while stack:
            a0, a1, b0, b1, far, bit = stack.pop()
            if len(a0) > CHUNK:
                for k in range(0, len(a0), CHUNK):
                    stack.append(tuple(x[k : k + CHUNK] for x in (a0, a1, b0, b1, far, bit)))
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():  # two leaves: all remaining bits at once
                a, b = a0[single], b0[single]
                hit = (a != b) & (np.bitwise_count(self.values[a] ^ self.values[b]) <= self.budget)
                near(a[hit], b[hit])
            # a pair of subtrees whose remaining bits fit in the budget is linked throughout
            all_in = ~single & (far + bit + 1 <= self.budget)
            for k in np.flatnonzero(all_in):
                whole(int(a0[k]), int(a1[k]), int(b0[k]), int(b1[k]))
            go = ~single & ~all_in
            a0, a1, b0, b1, far, bit = (x[go] for x in (a0, a1, b0, b1, far, bit))
            if not len(a0):
                continue
            same = (a0 == b0) & (a1 == b1)
            shift = bit.astype(np.uint64)
            am, bm = self.halves(a0, a1, shift), self.halves(b0, b1, shift)
            made = []
            for x0, x1, y0, y1, more, only in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
                keep = (x0 < x1) & (y0 < y1) & (far + more <= self.budget) & ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
                keep = keep if only is None else keep & only
                made.append((x0[keep], x1[keep], y0[keep], y1[keep], far[keep] + more, bit[keep] - 1))
            stack.append(tuple(np.concatenate(x) for x in zip(*made, strict=True)))


def _joined(keys: np.ndarray, sides: np.ndarray, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value of its root) of the rows of each key.

    sides: 0 and 1 in split keys, where only rows of different sides are compared;
    2 where all rows of the key are compared.
    """
    order = np.lexsort((values, sides, keys))
    keys, sides, values = keys[order], sides[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    joiner = Joiner(values, budget)
    plain = (sides[starts] == 2) & (ends - starts > 1)
    if plain.any():
        joiner.run(starts[plain], ends[plain])
    mixed = (sides[starts] == 0) & (sides[ends - 1] == 1)
    if mixed.any():
        split = np.array([s + np.searchsorted(sides[s:e], 1) for s, e in zip(starts[mixed], ends[mixed], strict=True)])
        joiner.run(starts[mixed], ends[mixed], split)
    at = np.flatnonzero(joiner.root != np.arange(len(values)))
    return values[at], values[joiner.find(at)]


def deal(keyed: DataFrame, key_rows: int) -> DataFrame:
    """key, side, fp and what else keyed(key, fp, ...) has, as tasks take it.

    A key with over key_rows rows is dealt into parts and every pair of parts becomes a
    key of its own, so no task grows with a key. side: 0 and 1 where only rows of
    different sides are compared, 2 where all are.
    """
    rest = [c for c in keyed.columns if c not in ("key", "fp")]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n_key"))
    hot = cut(sizes.where(F.col("n_key") > key_rows).select(F.col("key").alias("h"), F.ceil(F.col("n_key") / key_rows).cast("int").alias("n_parts")))
    if hot.isEmpty():
        return keyed.select("key", F.lit(2).alias("side"), "fp", *rest)
    keyed = keyed.join(hot, F.col("key") == F.col("h"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n_parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("n_parts") - 1)
    task = F.transform(every, lambda p: F.struct(F.xxhash64("key", F.least(p, own), F.greatest(p, own)).alias("key"), F.when(p == own, 2).when(own < p, 0).otherwise(1).alias("side")))
    one = F.array(F.struct(F.col("key").alias("key"), F.lit(2).alias("side")))
    dealt = keyed.select("fp", *rest, F.explode(F.when(F.col("n_parts").isNull(), one).otherwise(task)).alias("x"))
    return dealt.select("x.key", "x.side", "fp", *rest)


def links(prints: DataFrame, budget: int = 4, agree: int = 2, key_rows: int = KEY_ROWS) -> DataFrame:
    """u, v: links between the distinct values fp of prints whose transitive closure is
    that of all pairs at most budget bits apart. A task holds about key_rows rows at a time."""
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), (F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).alias("k")) for k, m in enumerate(masks(budget, agree))]))
    keyed = prints.select("fp", tables.alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("key"))

    def run(batches):
        import pyarrow as pa

        for group in whole_keys(batches, 0, 10 * key_rows):
            keys, sides, values = (group.column(k).to_numpy() for k in range(3))
            u, v = _joined(keys, sides, values.view(np.uint64), budget)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return deal(keyed, key_rows).repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint, group, component_id (least doc_id reachable over links) for every row.

    Texts without words have fingerprint 0 and are linked like any others. Null ids
    are ordinary rows; a group of null ids alone has component null. Repeated rows
    come out repeated; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(prints, budget))
    marked = cut(prints.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))
    least = cut(marked.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component_id")))  # so that a large group's join can be split
    known = marked.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("k"), "group", "component_id")
    return rows.join(known, F.col("fp") == F.col("k")).select("doc_id", "text_hash", "group", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group: the least id stays, null last.

    Rows are told apart by id and text; of rows equal in both one stays. All columns
    are kept as they are.
    """
    return keep_least(docs, near_groups(docs, words, budget, id_col, text_col), id_col, text_col)


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of groups(doc_id, text_hash, group)."""
    found = cut(groups.select("doc_id", "text_hash", "group"))
    mine = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    each = cut(found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    best = cut(each.groupBy(F.col("group").alias("g")).agg(F.min(mine).alias("best")))  # so that a large group's join can be split
    judged = cut(each.join(best, F.col("group") == F.col("g")).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), (mine == F.col("best")).alias("stays"), "n"))
    match = F.col(id_col).eqNullSafe(F.col("r_id")) & (F.xxhash64(text_col) == F.col("r_hash"))
    out = docs.join(judged.where(~F.col("stays")).select("r_id", "r_hash"), match, "left_anti")
    repeated = judged.where("stays and n > 1").select("r_id", "r_hash")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, match, "left_semi").withColumn("r_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "r_hash"]).drop("r_hash")
    return out.join(repeated, match, "left_anti").unionByName(once)
