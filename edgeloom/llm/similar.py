"""SimHash near-duplicates down to a shingle similarity: every pair at or over the bound is found.

Texts are sets of word shingles with a fingerprint each. Tables of fingerprint blocks
serve a few differing bits; at a similarity of 0.8 fingerprints differ in about 10 of 64,
where such tables lose most pairs. So fingerprints meet by shingles instead: in any fixed
order of the shingles, two sets with similarity num/den share one among the first
n - ceil(n * num / den) + 1 of each (prefix filter). Shingles that a sample shows to be
common come last in the order; the sample steers cost only, never results. At each
shingle the binary trie self-join names the pairs within the error budget, and their exact
similarity is taken from the texts.

At a shingle of many sets a pair is named only where sketches of both sets, which bound their
difference from below, let it reach the similarity. There one set is named with all, and a few
forests of pairs among the rest; when these are compared, all pairs of what is still apart are
named. So n near copies of one text cost about n pairs, not n squared. Texts travel to be
compared only where a pair is named, and a hub with many pairs is dealt in parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_keys
from .components import components
from .simhash import KEY_ROWS, Joiner, deal, fingerprint, keep_least, shingle_hashes
from .suffixes import hash_keys
from .wordtable import slices

#: Similarity from which on two texts are near duplicates: 4/5.
LEAST = (4, 5)
#: Differing bits up to which the trie names a pair. At the bound about 10 are expected and
#: 24 are five standard deviations away.
BUDGET = 24
#: Texts sampled for the order of shingles, texts from which on a shingle is common there, and most common shingles.
SAMPLE, COMMON, MOST = 4_000, 4, 200_000
#: Sets of one shingle up to which the trie names all pairs at once.
FEW = 32
#: Rows of texts wanted for comparison up to which their ids are broadcast, and pairs of a hub that one task compares.
BROADCAST, STAR = 200_000, 256
#: Forests of pairs without a common pair that a shingle of many sets names first.
FORESTS = 3
#: Most bits of a set's sketch, and pairs whose sketches are compared at once.
SKETCH, SKETCHES = 4096, 20_000
#: Shingles that one range of keys stands for.
RANGE_KEYS = 4_000_000
#: What a set sends to each shingle of its prefix: the key's lower 40 bits, the set, its
#: fingerprint and size, and the shingle's place in the prefix (a lower bound for it).
CELL = np.dtype([("lo", "<u4"), ("hi", "u1"), ("set", "<i8"), ("fp", "<u8"), ("n", "<u4"), ("at", "<u2")])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The text's distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64)).view(np.int64)


def _set_id(found: np.ndarray) -> int:
    """One long per set; 0 for the empty set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), 42) - (1 << 63) if len(found) else 0


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of the set's shingles at each of four places a shingle or more, a power of two.

    Two sketches differ in at most as many bits as the sets differ in shingles. One of half
    the size is the exclusive or of both halves.
    """
    bits = min(SKETCH, max(64, 1 << (4 * len(found) - 1).bit_length()))
    odd = np.bincount((found.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of numbered sets, for comparing many pairs."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            own = np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint64).reshape(len(at), -1)
            self._put(w, at, own)
            if w > 8:
                self._put(w // 2, at, own[:, : w // 16] ^ own[:, w // 16 :])

    def _put(self, w: int, at: np.ndarray, rows: np.ndarray) -> None:
        place, held = self.rows.get(w, (np.full(len(self.width), -1), rows[:0]))
        place[at] = len(held) + np.arange(len(at))
        self.rows[w] = place, np.concatenate([held, rows])

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether sets a and b may differ in `most` shingles or fewer."""
        ok, w = np.ones(len(a), bool), np.minimum(self.width[a], self.width[b])
        for x in np.unique(w).tolist():
            place, rows = self.rows[x]
            at = np.flatnonzero((w == x) & (place[a] >= 0) & (place[b] >= 0))  # sizes too far apart are not judged
            for s in range(0, len(at), SKETCHES):
                k = at[s : s + SKETCHES]
                ok[k] = np.bitwise_count(rows[place[a[k]]] ^ rows[place[b[k]]]).sum(axis=1) <= most[k]
        return ok


def _forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs a, b that join what root holds apart, each such pair once; root follows."""
    rest, kept = np.arange(len(a)), []
    while len(rest):
        ends = []
        for x in (a[rest], b[rest]):
            up = root[x]
            while (root[up] != up).any():
                up = root[up]
            root[x] = up
            ends.append(up)
        low, high = np.minimum(*ends), np.maximum(*ends)
        rest, low, high = (x[low < high] for x in (rest, low, high))
        high, first = np.unique(high, return_index=True)
        root[high] = low[first]
        kept.append(rest[first])
    return np.concatenate(kept) if kept else rest


def _common(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """Shingles frequent in a sample of the texts, ascending."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                for text in piece.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words))], ["key"])

    share = SAMPLE / max(1, docs.count())
    some = docs.select(F.col(text_col).alias("text"))
    some = some if share >= 1 else some.sample(share, seed=1)
    found = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(MOST).select("key").collect()], np.int64))


def _rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, set, n (its size) and sketch for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                sets = [shingle_set(t, words) for t in piece.column(1).to_pylist()]
                columns = [pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), *columns], ["doc_id", "text_hash", "set", "n", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, set long, n int, sketch binary")


def _may_reach(least: tuple[int, int], n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that meet first at places at and to can reach the similarity."""
    num, den = least
    most = np.minimum(n - at, m - to)
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (most * (den + num) >= (n + m) * num)


def _pairs(cells: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, least: tuple[int, int], split: np.ndarray | None = None, pick=None):
    """(places, places) of the pairs of each key that the trie finds within the budget, that
    can reach the similarity and that are not linked yet (part). Fingerprints ascend within a key.
    Of these pick(a, b) gives the places to keep."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n, at, part = cells["n"].astype(np.int64), cells["at"].astype(np.int64), cells["part"]

    def near(a: np.ndarray, b: np.ndarray) -> None:
        ok = (part[a] != part[b]) & _may_reach(least, n[a], at[a], n[b], at[b])
        a, b = a[ok], b[ok]
        if pick is not None:
            ok = pick(a, b)
            a, b = a[ok], b[ok]
        found.append((a, b))

    Joiner(cells["fp"], BUDGET).walk(starts, ends, split, near)
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _met(docs: DataFrame, words: int, least: tuple[int, int], common: np.ndarray, ranges: int, text_col: str) -> DataFrame:
    """u, v: pairs named at shingles of few sets; for the others the members: key, u (the set),
    n, at, fp. A task holds one range of keys."""
    num, den = least

    def prefix(found: np.ndarray) -> np.ndarray:
        if len(common):
            late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
            found = np.concatenate([found[~late], found[late]])
        return found[: len(found) - (num * len(found) + den - 1) // den + 1]

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                seen, out = set(), []
                for text in piece.column(0).to_pylist():
                    found = shingle_set(text, words)
                    name = _set_id(found)
                    if not len(found) or name in seen:
                        continue
                    seen.add(name)
                    first = prefix(found)
                    key = hash_keys(first.view(np.uint64), ranges)
                    cells = np.zeros(len(first), CELL)
                    cells["lo"], cells["hi"], cells["set"], cells["n"] = key & 0xFFFFFFFF, (key >> 32) & 0xFF, name, len(found)
                    cells["fp"], cells["at"] = fingerprint(found.view(np.uint64)), np.minimum(np.arange(len(first)), 65535)
                    out.append((key >> 40, cells))
                if not out:
                    continue
                part, cells = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.argsort(part, kind="stable")
                part, cells = part[order].astype(np.int64), cells[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                raw = [cells[s:e].tobytes() for s, e in zip(cuts, np.append(cuts[1:], len(cells)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(raw, pa.binary())], ["part", "cells"])

    def meet(batches):
        import pyarrow as pa

        names = ["u", "v", "key", "n", "at", "fp"]

        def give(*columns):
            arrays = [pa.array(c, pa.int64()) if c is not None else pa.nulls(len(columns[0]), pa.int64()) for c in columns]
            yield from pa.Table.from_arrays(arrays, names).to_batches(max_chunksize=100_000)

        for group in whole_keys(batches, 0, 0):
            c = np.concatenate([np.frombuffer(x, CELL) for x in group.column(1).to_pylist()])
            key = c["lo"].astype(np.int64) | c["hi"].astype(np.int64) << 32 | group.column(0)[0].as_py() << 40
            order = np.lexsort((c["set"], c["fp"], key))
            c, key = c[order], key[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (c["set"][1:] != c["set"][:-1])])
            c, key = c[new], key[new]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            size = ends - starts
            sets, cells = c["set"], {k: np.ascontiguousarray(c[k]) for k in ("fp", "n", "at")} | {"part": c["set"]}
            few = (size > 1) & (size <= FEW)
            a, b = _pairs(cells, starts[few], ends[few], least)
            many = np.flatnonzero(size > FEW)
            if len(a):
                u, v = np.minimum(sets[a], sets[b]), np.maximum(sets[a], sets[b])
                once = np.unique(np.stack([u, v], axis=1), axis=0)
                yield from give(once[:, 0], once[:, 1], None, None, None, None)
            for k in many:
                s = slice(starts[k], ends[k])
                yield from give(sets[s], None, key[s], c["n"][s], c["at"][s], c["fp"][s].view(np.int64))

    texts = docs.select(F.col(text_col).alias("text"))
    schema = "u long, v long, key long, n long, at long, fp long"
    return texts.mapInArrow(send, "part long, cells binary").repartition("part").sortWithinPartitions("part").mapInArrow(meet, schema)


def _apart(members: DataFrame, least: tuple[int, int], key_rows: int, forest: bool = False) -> DataFrame:
    """u, v: the pairs that the trie names at shingles of many sets and whose sketches allow the
    similarity; members has key, set, part, n, at, fp, sketch. A shingle of over key_rows sets is
    dealt into pairs of parts. With forest, one set of each shingle is named with all and counts as
    linked, and of the other pairs those that grow one of FORESTS forests are named.

    Sets that meet late in both prefixes can't reach the similarity, and sets of one part
    are linked already. So early sets are joined with all, and the largest part only with the
    rest: sets that share a common passage and little else, or are copies of one text, cost
    no comparison among themselves.
    """
    num, den = least

    def joined(c: dict[str, np.ndarray], pick, left: np.ndarray, right: np.ndarray | None):
        """Pairs of the places in left with those in right, or of left among themselves."""
        at = left if right is None else np.concatenate([left, right])
        if not len(at):
            return at, at
        side = np.zeros(len(at), np.int8) if right is None else np.repeat(np.array([0, 1], np.int8), [len(left), len(right)])
        order = np.lexsort((c["fp"][at], side, c["key"][at]))
        at, side = at[order], side[order]
        mine = {k: np.ascontiguousarray(x[at]) for k, x in c.items()}
        starts = np.flatnonzero(np.concatenate([[True], mine["key"][1:] != mine["key"][:-1]]))
        ends = np.append(starts[1:], len(at))
        ok = (ends - starts > 1) if right is None else (side[starts] == 0) & (side[ends - 1] == 1)
        starts, ends = starts[ok], ends[ok]
        if not len(starts):
            return at[:0], at[:0]
        split = None
        if right is not None:
            ones = np.concatenate([[0], np.cumsum(side)])
            split = ends - (ones[ends] - ones[starts])
        a, b = _pairs(mine, starts, ends, least, split, lambda a, b: pick(at[a], at[b]))
        return at[a], at[b]

    def named(a: np.ndarray, b: np.ndarray):
        import pyarrow as pa

        once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield from pa.Table.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["u", "v"]).to_batches(max_chunksize=100_000)

    def run(batches):
        import pyarrow as pa

        for group in whole_keys(batches, 0, key_rows):
            c = {k: group.column(i).to_numpy() for i, k in enumerate(("key", "side", "fp", "set", "part", "n", "at")) if k != "side"}
            c["fp"] = c["fp"].view(np.uint64)
            # a set has one sketch, at whatever shingles it is met
            _, once, c["which"] = np.unique(c["set"], return_index=True, return_inverse=True)
            sketches = Sketches(group.column(7).take(pa.array(once)).to_pylist())

            def allowed(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, sketches=sketches) -> np.ndarray:
                both = c["n"][a] + c["n"][b]
                return sketches.within(c["which"][a], c["which"][b], both - 2 * -(-both * num // (den + num)))

            if forest:  # keys follow each other
                hub = np.flatnonzero(np.concatenate([[True], c["key"][1:] != c["key"][:-1]]))
                hub, at = np.repeat(hub, np.diff(np.append(hub, len(c["key"])))), np.arange(len(c["key"]))
                close = np.bitwise_count(c["fp"][at] ^ c["fp"][hub]) <= BUDGET
                close &= (c["set"][at] != c["set"][hub]) & _may_reach(least, c["n"][at], c["at"][at], c["n"][hub], c["at"][hub])
                hub, at = hub[close], at[close]
                ok = allowed(c, hub, at)
                hub, at = hub[ok], at[ok]
                yield from named(c["set"][hub], c["set"][at])
                c["part"] = c["part"].copy()
                c["part"][at] = c["part"][hub]
            order = np.lexsort((c["part"], c["key"]))
            c = {k: np.ascontiguousarray(x[order]) for k, x in c.items()}
            block = np.cumsum(np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["part"][1:] != c["part"][:-1])])) - 1
            size = np.bincount(block)[block]
            heads = np.flatnonzero(np.concatenate([[True], c["key"][1:] != c["key"][:-1]]))
            key = np.cumsum(np.concatenate([[True], c["key"][1:] != c["key"][:-1]])) - 1
            # of a key's largest parts the first
            first = np.full(len(heads), len(block))
            top = size == np.maximum.reduceat(size, heads)[key]
            np.minimum.at(first, key[top], block[top])
            largest = block == first[key]
            early = (c["n"] - c["at"]) * (den + num) >= 2 * c["n"] * num
            at = np.arange(len(block))
            blocks = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))[block]
            roots = [blocks.copy() for _ in range(FORESTS)]

            def pick(a: np.ndarray, b: np.ndarray, c=c, allowed=allowed, roots=roots) -> np.ndarray:
                rest = np.flatnonzero(allowed(c, a, b))
                if not forest:
                    return rest
                kept = []
                for root in roots:
                    links = _forest(root, a[rest], b[rest])
                    kept.append(rest[links])
                    rest = np.delete(rest, links)
                return np.concatenate(kept)

            for left, right in ((largest & early, ~largest), (largest & ~early, ~largest & early), (~largest & early, None), (~largest & early, ~largest & ~early)):
                a, b = joined(c, pick, at[left], None if right is None else at[right])
                yield from named(c["set"][a], c["set"][b])

    # rows of one side of a dealt key meet in other tasks too, where the pair is named again
    dealt = deal(members.select("key", "fp", "set", "part", "n", "at", "sketch"), key_rows)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """The pairs u, v whose exact similarity reaches the bound.

    Each pair's texts come together at u; a u with many pairs is dealt in parts.
    """
    num, den = least
    pairs = cut(pairs.distinct())
    hubs = pairs.groupBy(F.col("u").alias("hub")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(hubs, F.col("u") == F.col("hub")).select("hub", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("set"), F.lit(1).alias("role"))
    wanted = cut(dealt.unionByName(dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("set"), F.lit(0).alias("role"))))
    best = sets.join(wanted.select("set").distinct(), "set", "left_semi").select("set", "best")
    places = wanted.groupBy(F.col("set").alias("w_set")).agg(F.collect_list(F.struct("hub", "part", "role")).alias("places"))
    best = cut(best.join(places, F.col("set") == F.col("w_set")).select(F.col("set").alias("b_set"), F.col("best.id").alias("b_id"), F.col("best.h").alias("b_h"), "places"))
    best = F.broadcast(best) if best.count() <= BROADCAST and wanted.count() <= BROADCAST else best
    texts = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text"))
    texts = texts.join(best, (F.xxhash64("text") == F.col("b_h")) & F.col("t_id").eqNullSafe(F.col("b_id")))
    texts = texts.select(F.explode("places").alias("p"), F.col("b_set").alias("set"), "text").select("p.hub", "p.part", "p.role", "set", "text")

    def run(batches):
        import pyarrow as pa

        place, hub, last = None, None, None
        for batch in batches:
            for piece in slices(batch):
                out = []
                for h, part, role, name, text in zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True):
                    if (h, part, role, name) == last:  # a repeated row
                        continue
                    last = (h, part, role, name)
                    own = shingle_set(text, words)
                    if role == 0:
                        place, hub = (h, part), own
                    elif place == (h, part) and len(np.intersect1d(hub, own, assume_unique=True)) * (den + num) >= (len(hub) + len(own)) * num:
                        out.append((h, name))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return cut(texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "set").mapInArrow(run, "u long, v long"))


def similar_links(docs: DataFrame, rows: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """u, v: links between sets whose transitive closure is that of all pairs at or over the bound."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * (least[1] - least[0]) // least[1] // RANGE_KEYS + 1)
    # of the rows with equal shingles one stands for all
    mine = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    sets = cut(rows.groupBy("set").agg(F.min(mine).alias("best"), F.first("sketch").alias("sketch")))
    met = cut(_met(docs, words, least, _common(docs, words, text_col), ranges, text_col))
    pairs = met.where("v is not null").select("u", "v")
    wide = met.where("v is null").select("key", F.col("u").alias("set"), "n", "at", "fp")
    if wide.isEmpty():
        return _confirmed(docs, sets, pairs, words, least, id_col, text_col)
    drawn = sets.join(wide.select("set").distinct(), "set", "left_semi").select(F.col("set").alias("s"), "sketch")
    wide = cut(wide.join(drawn, F.col("set") == F.col("s")).drop("s"))
    first = _confirmed(docs, sets, pairs.unionByName(_apart(wide.withColumn("part", F.col("set")), least, key_rows, True)), words, least, id_col, text_col)

    # shingles of many sets in which sets are still apart
    placed = cut(wide.join(components(first), F.col("set") == F.col("node"), "left").select("key", "set", "n", "at", "fp", "sketch", F.coalesce("component", "set").alias("part")))
    apart = cut(placed.groupBy(F.col("key").alias("k")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("k"))
    placed = cut(placed.join(apart, F.col("key") == F.col("k"), "left_semi"))
    if placed.isEmpty():
        return first
    return first.unionByName(_confirmed(docs, sets, _apart(placed, least, key_rows), words, least, id_col, text_col))


def similar_groups(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, group for every row: groups are closed under similarity num/den or more.

    Texts without words are one group. Null ids are ordinary rows; repeated rows come out
    repeated, an empty table gives no rows; other columns are ignored. Sets of shingles are
    told apart by a 64-bit hash.
    """
    rows = cut(_rows(docs, words, id_col, text_col))
    groups = components(similar_links(docs, rows, words, least, id_col, text_col))
    return rows.join(groups, F.col("set") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "set").alias("group"))


def keep_one(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of similar texts: the least id stays, null last.

    All columns are kept as they are.
    """
    return keep_least(docs, similar_groups(docs, words, least, id_col, text_col), id_col, text_col)
