"""Exact substring deduplication by sorted suffixes, 50 bytes deep.

A byte goes if a SPAN-byte string that covers it also starts in a document with a
smaller id. Not every suffix of the corpus has to meet every other: each SPAN-byte
window is dealt to its minimizer, the K-gram in it with the least hash, so equal
windows have equal minimizers. Four passes:

1. every text sends its minimizers' hashes, packed per range of hashes; hashes seen
   in two texts are shared, and only windows at shared minimizers go on;
2. a text sends, for each shared minimizer, the bytes its windows cover;
3. the suffixes at one minimizer are sorted by deep-shallow sorting: multikey
   quicksort to SHALLOW bytes, then blind tries for what still has a common prefix.
   Equal windows lie together; all but those of the least document are flagged;
4. flagged windows go back to their text, which is cut.

Copies of a whole text are represented by one of them. What is equal within a batch is
settled there and travels on once: a hash that two texts of a batch share is known to
be shared, and of equal segments only the least document's goes on. A minimizer in very
many texts, such as one at the edge of a common line whose windows differ from text to
text, sends its windows one by one by their own hash. So no task meets all texts that
hold a passage, only one row per batch.

What decides: windows are compared byte by byte. In pass 1 a text goes by ID_BITS bits of
its hash; texts that share these bits with another one skip that pass and send all their
windows. Equal texts are told by a 128-bit hash and not compared by bytes.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, place_of, whole_keys
from .wordtable import slices

SPAN, K = 50, 16
#: K-grams in one window.
WIDTH = SPAN - K + 1
#: Depth of the multikey quicksort, in bytes; a multiple of its 8-byte symbols.
SHALLOW = 24
LAST = 2**63 - 1
#: Texts from which on a minimizer is hot: its windows are dealt one by one. So many
#: rows (about 15 MB) are no burden for one task.
HOT = 100_000
#: Hot minimizers that may be broadcast (8 bytes each); more are marked by a join.
HOT_KEYS = 200_000
#: Bits of a text's hash that stand for it in pass 1, at most 48.
ID_BITS = 48
#: Bytes of text that one range of minimizer hashes stands for, and segments that are settled at once.
RANGE_BYTES, AT_ONCE = 256 << 20, 200_000
_MARK = 1 << 62
_LOW40 = (1 << 40) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-gram, K a power of two: halves are combined, doubling each time."""
    h, step, factor = data.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while step < K:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, step * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) for each run of windows with the same minimizer.

    The minimizer of a window is its first K-gram of least hash, so it depends on the
    window's bytes alone.
    """
    g = gram_hashes(data)
    least, span = g, 1
    while span * 2 <= WIDTH:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    views = np.lib.stride_tricks.sliding_window_view(g, WIDTH)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(first):
        at = first + views[first].argmin(axis=1)
        end = np.minimum(last, at)  # beyond it the K-gram has left the window; an equal one follows
        done.append((least[first], first, end))
        more = end < last
        first, last = end[more] + 1, last[more]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def hash_keys(g: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash (by its upper bits) and its lower 40 bits, as one number."""
    return ((g >> np.uint64(40)) % np.uint64(ranges)) << np.uint64(40) | g & np.uint64(_LOW40)


class BlindTrie:
    """Orders strings with a common prefix: nodes hold only the place where children differ."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while len(node) == 3:  # blindly: any leaf below agrees where it matters
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(member)
            return
        place = next(k for k in range(len(text)) if text[k] != other[k])
        above, node = None, self.root
        while len(node) == 3 and node[0] < place:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, [member])
        if len(node) == 3 and node[0] == place:
            node[1][text[place]] = leaf
            return
        made = (place, {text[place]: leaf, other[place]: node}, None)
        if above is None:
            self.root = made
        else:
            above[1][text[above[0]]] = made

    def leaves(self):
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(group: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """The sets of two or more equal rows of windows (n x SPAN bytes) with equal group, in sorted order."""
    order = np.arange(len(group))
    part = group
    for at in range(0, SHALLOW, 8):  # one symbol of multikey quicksort for all open partitions
        symbol = windows[order, at : at + 8].copy().view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((symbol, part))
        order, part, symbol = order[by], part[by], symbol[by]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (symbol[1:] != symbol[:-1])])
        number = np.cumsum(new) - 1
        open_ = np.bincount(number)[number] > 1
        order, part = order[open_], number[open_]
        if not len(order):
            return []
    found = []
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True):
        trie, members = BlindTrie(), order[s:e]
        raw, size = windows[members, SHALLOW:].tobytes(), SPAN - SHALLOW
        for k, member in enumerate(members.tolist()):
            trie.insert(raw[k * size : (k + 1) * size], member)
        found += [np.array(m) for m in trie.leaves() if len(m) > 1]
    return found


_DICE = np.random.default_rng(42).integers(1, 2**63, 256 + 4 * SPAN, dtype=np.uint64) | np.uint64(1)


class Ragged:
    """Byte strings in one buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets.astype(np.int64)
        self.lengths = np.diff(self.offsets)

    @classmethod
    def of(cls, strings: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)]))

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of rows lie, one after another, and where each row begins among them."""
        n = self.lengths[rows]
        begin = np.cumsum(n) - n
        return np.arange(int(n.sum())) + np.repeat(self.offsets[rows] - begin, n), begin

    def hashes(self, chunk: int = 50_000) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.uint64)
        for at in range(0, len(out), chunk):
            rows = np.arange(at, min(at + chunk, len(out)))
            where, begin = self.places(rows)
            depth = np.arange(len(where)) - np.repeat(begin, self.lengths[rows])
            out[rows] = np.add.reduceat(_DICE[self.data[where]] * _DICE[256 + depth % (4 * SPAN)], begin)
        return out

    def same(self, a: np.ndarray, b: np.ndarray, chunk: int = 50_000) -> np.ndarray:
        """Whether rows a and b, equally long each, hold equal bytes."""
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), chunk):
            left, begin = self.places(a[at : at + chunk])
            right, _ = self.places(b[at : at + chunk])
            out[at : at + chunk] = np.logical_and.reduceat(self.data[left] == self.data[right], begin)
        return out


def flagged(keys: np.ndarray, firsts: np.ndarray, segments: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last window within its segment) where an equal window of the same key
    belongs to a smaller first document.

    Equal segments are brought together by hash and compared byte by byte; should
    two hashes collide, their segments are only compared window by window.
    """
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none, none
    h = segments.hashes()
    order = np.lexsort((firsts, h, segments.lengths, keys))
    before, after = order[:-1], order[1:]
    alike = (keys[before] == keys[after]) & (h[before] == h[after]) & (segments.lengths[before] == segments.lengths[after])
    at = np.flatnonzero(alike)
    alike[at] = segments.same(before[at], after[at])
    kind = np.cumsum(np.concatenate([[True], ~alike])) - 1  # by place in order
    heads = np.flatnonzero(np.concatenate([[True], ~alike]))
    least = firsts[order[heads]]  # sorted by document within a kind
    late = firsts[order] > least[kind]
    rows = order[late]
    out = [(rows, np.zeros(len(rows), np.int64), segments.lengths[rows] - SPAN)]
    # one row stands for each kind; rows of the same document share its fate
    twins = np.flatnonzero(~late)
    twin_of = kind[twins]
    head_keys = keys[order[heads]]
    new = np.concatenate([[True], head_keys[1:] != head_keys[:-1]])
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    sizes = segments.lengths[order[heads[several]]] - SPAN + 1
    step = np.flatnonzero(np.concatenate([[True], group[several][1:] != group[several][:-1]])) if len(several) else none
    ends = np.cumsum(sizes)
    start = 0
    while start < len(step):  # whole groups, about 200,000 windows at once
        base = ends[step[start] - 1] if step[start] else 0
        stop = max(start + 1, int(np.searchsorted(ends[step - 1 + (step == 0)], base + 200_000)))
        a, b = step[start], step[stop] if stop < len(step) else len(several)
        kinds = several[a:b]
        which, lo, hi = _flag_windows(group[kinds], order[heads[kinds]], firsts, segments)
        if len(which):
            chosen = kinds[which]
            left, right = np.searchsorted(twin_of, chosen), np.searchsorted(twin_of, chosen, "right")
            n = right - left
            each = np.repeat(np.arange(len(chosen)), n)
            member = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + left[each]
            out.append((order[twins[member]], lo[each], hi[each]))
        start = stop
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _flag_windows(group: np.ndarray, rows: np.ndarray, firsts: np.ndarray, segments: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in rows, first, last window) of flagged runs of windows of the rows' segments."""
    n = segments.lengths[rows] - SPAN + 1
    owner = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = segments.offsets[rows][owner] + place
    windows = np.lib.stride_tricks.sliding_window_view(segments.data, SPAN)[begin]
    hit = np.zeros(len(owner), bool)
    for equal in deep_shallow(group[owner], windows):
        mine = firsts[rows[owner[equal]]]
        hit[equal[mine > mine.min()]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (at[1:] != at[:-1] + 1)]))
    ends = np.append(new[1:], len(at)) - 1
    return owner[at[new]], place[at[new]], place[at[ends]]


def _merged_by_text(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Per text (h1, h2): its disjoint sorted [start, end) pairs, as bytes of 32-bit numbers."""
    order = np.lexsort((start, h2, h1))
    h1, h2, start, end = h1[order], h2[order], start[order], end[order]
    text = np.cumsum(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) - 1
    lift = text.astype(np.int64) << 33  # texts apart: one running maximum serves all
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]]))
    stop = reach[np.append(new[1:], len(start)) - 1] - lift[new]
    pairs = np.stack([start[new], stop], axis=1).astype("<i4")
    heads = np.flatnonzero(np.concatenate([[True], text[new][1:] != text[new][:-1]]))
    raw, edges = pairs.tobytes(), np.append(heads, len(pairs)).tolist()
    return h1[new[heads]], h2[new[heads]], [raw[8 * a : 8 * b] for a, b in zip(edges, edges[1:], strict=False)]


def merged(pairs: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) rows that cover pairs (n x 2); touching ones join."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], axis=1)


def _shared_keys(texts: DataFrame, ranges: int, hot: int, id_mask: int) -> DataFrame:
    """id48, key: the shared minimizers of each text; texts has h1 and text.

    A key in `hot` texts or more comes once more with a negative id48. A task holds one
    range of keys at a time.
    """

    def narrow(x: np.ndarray, width: int) -> np.ndarray:
        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])

    def wide(raw: bytes, width: int) -> np.ndarray:
        out = np.zeros((len(raw) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        return out.view("<u8").ravel()

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            ids, found = [], []
            for h1, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) >= SPAN:
                    key = np.unique(hash_keys(minimizers(data)[0], ranges))
                    found.append(key)
                    ids.append(np.full(len(key), h1 & id_mask, np.uint64))
            if not found:
                continue
            key, owner = np.concatenate(found), np.concatenate(ids)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner = key[once], owner[once]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(heads, len(key)))
            known = np.repeat(n > 1, n)  # shared within the batch: nothing to ask
            parts, lows, whos, sizes = [], [], [], []
            if known.any():
                spread = (owner[known] % np.uint64(ranges)).astype(np.int64)
                by = np.argsort(spread, kind="stable")
                k, o, spread = key[known][by], owner[known][by], spread[by]
                cuts = np.flatnonzero(np.concatenate([[True], spread[1:] != spread[:-1]]))
                for s, e in zip(cuts, np.append(cuts[1:], len(k)), strict=True):
                    parts.append(-1 - int(spread[s]))
                    lows.append(k[s:e].tobytes())
                    whos.append(narrow(o[s:e], 6).tobytes())
                    sizes.append(b"")
            key, owner = key[heads], owner[heads]
            part = (key >> np.uint64(40)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            low, who, size = narrow(key, 5), narrow(owner, 6), np.minimum(n, 65535).astype("<u2")
            for s, e in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                parts.append(int(part[s]))
                lows.append(low[s:e].tobytes())
                whos.append(who[s:e].tobytes())
                sizes.append(size[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *[pa.array(x, pa.binary()) for x in (lows, whos, sizes)]], ["part", "low", "who", "size"])

    def meet(batches):
        import pyarrow as pa

        def give(owner: np.ndarray, key: np.ndarray):
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(owner[at : at + 100_000].astype(np.int64)), pa.array(key[at : at + 100_000].astype(np.int64))], ["id48", "key"])

        for group in whole_keys(batches, 0):
            if group.column(0)[0].as_py() < 0:
                for low, who in zip(group.column(1).to_pylist(), group.column(2).to_pylist(), strict=True):
                    yield from give(wide(who, 6), np.frombuffer(low, np.uint64))
                continue
            keys, owners, sizes = [], [], []
            for part, low, who, size in zip(*(group.column(k).to_pylist() for k in range(4)), strict=True):
                keys.append(wide(low, 5) | np.uint64(part << 40))
                owners.append(wide(who, 6))
                sizes.append(np.frombuffer(size, "<u2"))
            key, owner, n = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes).astype(np.int64)
            order = np.lexsort((owner, key))
            key, owner, n = key[order], owner[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            total = np.add.reduceat(n, starts)
            shared = (owner[starts] != owner[ends - 1]) | (np.maximum.reduceat(n, starts) > 1)
            ask = np.repeat(shared, ends - starts) & (n == 1)
            ask &= np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])  # a text counts once
            yield from give(owner[ask], key[ask])
            many = key[starts[total >= hot]]
            yield from give(-1 - (many % np.uint64(4096)).astype(np.int64), many)

    packed = texts.select("h1", "text").mapInArrow(send, "part long, low binary, who binary, size binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "id48 long, key long")


def _marked(shared: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """shared(id48, keys) of texts, and the sorted hot keys; None where the hot keys are
    too many to broadcast and are marked in keys instead."""
    own, hot = shared.where("id48 >= 0"), shared.where("id48 < 0").select(F.explode("keys").alias("hot"))
    if hot.count() <= HOT_KEYS:
        return own, np.sort(np.array([r[0] for r in hot.collect()], np.int64))
    pairs = own.select("id48", F.explode("keys").alias("key")).join(hot, F.col("key") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.col("key") + F.lit(_MARK))
    return pairs.groupBy("id48").agg(F.collect_list(key).alias("keys")), None


def _segments(rows: DataFrame, ranges: int, hot: np.ndarray | None) -> DataFrame:
    """Segments of texts (h1, h2, first, text, keys, twin) at their shared minimizers.

    A twin's id stands for other texts too: it sends all its segments. key, h1, h2, first, at, segment: what pass 3 sorts, with all places (at) of the segment
    in the text; at hot keys each window is a segment under a key of its own. Rows
    without a segment carry, in spans, what was settled within a batch.
    """

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            for piece in slices(batch, 2048):
                h1, h2, first, texts, keys, twins = (piece.column(k) for k in range(6))
                ids = list(zip(h1.to_pylist(), h2.to_pylist(), first.to_pylist(), strict=True))
                best: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
                windows: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
                spans: dict[int, list[tuple[int, int]]] = {}
                for row, text in enumerate(texts):
                    raw = text.as_buffer().to_pybytes()
                    g, lo, hi = minimizers(np.frombuffer(raw, np.uint8))
                    key = hash_keys(g, ranges).view(np.int64)
                    mine = keys[row].values.to_numpy() if keys[row].is_valid else np.zeros(0, np.int64)
                    at = np.arange(len(key)) if twins[row].as_py() else np.flatnonzero(np.isin(key, mine & (_MARK - 1)))
                    is_hot = np.isin(key[at], hot) if hot is not None else np.isin(key[at] | _MARK, mine)
                    for k, x in zip(at.tolist(), is_hot.tolist(), strict=True):
                        into = (-1 - int(key[k])) if x else int(key[k])
                        best.setdefault((into, raw[lo[k] : hi[k] + SPAN]), []).append((row, int(lo[k])))
                out = []

                def settle(segment: bytes, where: list[tuple[int, int]]) -> dict[int, list[int]]:
                    """Flags all but the least document's; gives the places that must travel on."""
                    least, stay = min(ids[row][2] for row, _ in where), {}
                    for row, lo in where:
                        if ids[row][2] > least:
                            spans.setdefault(row, []).append((lo, lo + len(segment)))
                        else:
                            stay.setdefault(row, []).append(lo)
                    return stay

                for (key, segment), where in best.items():
                    for row, los in settle(segment, where).items():
                        if key >= 0:
                            out.append((key, *ids[row], array("i", los).tobytes(), segment))
                            continue
                        for k in range(len(segment) - SPAN + 1):
                            windows.setdefault((key, segment[k : k + SPAN]), []).extend((row, lo + k) for lo in los)
                for (key, window), where in windows.items():
                    own = xxh64_intdigest(window, key & LAST) & LAST
                    out += [(own, *ids[row], array("i", los).tobytes(), window) for row, los in settle(window, where).items()]
                done = [(ids[row], merged(np.array(x)).astype("<i4").tobytes()) for row, x in spans.items()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([o[k] for o in out] + [i[0] if k == 0 else i[k - 1] for i, _ in done], pa.int64()) for k in range(4)],
                        pa.array([o[4] for o in out] + [None] * len(done), pa.binary()),
                        pa.array([o[5] for o in out] + [None] * len(done), pa.binary()),
                        pa.array([None] * len(out) + [x for _, x in done], pa.binary()),
                    ],
                    ["key", "h1", "h2", "first", "at", "segment", "spans"],
                )

    return rows.select("h1", "h2", "first", "text", "keys", "twin").mapInArrow(run, "key long, h1 long, h2 long, first long, at binary, segment binary, spans binary")


def _settle(segments: DataFrame) -> DataFrame:
    """h1, h2, spans: removed [start, end) pairs of each text, as little-endian 32-bit numbers."""

    def run(batches):
        import pyarrow as pa

        for group in whole_keys(batches, 0, AT_ONCE):
            passed = group.filter(group.column(5).is_null())
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(1), passed.column(2), passed.column(6)], ["h1", "h2", "spans"])
            rest = group.filter(group.column(5).is_valid())
            if not rest.num_rows:
                continue
            key, h1, h2, first = (rest.column(k).to_numpy() for k in range(4))

            def ragged(k: int, rest=rest) -> Ragged:
                column = rest.column(k).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                return Ragged(np.frombuffer(column.buffers()[2], np.uint8), offsets)

            places = ragged(4)
            row, a, b = flagged(key, first, ragged(5))
            if len(row):
                raw, _ = places.places(row)
                at, n = places.data[raw].view("<i4").astype(np.int64), places.lengths[row] // 4
                row, a, b = np.repeat(row, n), np.repeat(a, n), np.repeat(b, n)
                one, two, spans = _merged_by_text(h1[row], h2[row], at + a, at + b + SPAN)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(spans, pa.binary())], ["h1", "h2", "spans"])

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "h1 long, h2 long, spans binary")


def _cut_texts(rows: DataFrame) -> DataFrame:
    """h1, h2, removed, spans, kept for texts (h1, h2, text, lists of spans)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                removed, spans, kept = [], [], []
                for text, lists in zip(piece.column(2), piece.column(3).to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    gone = merged(np.frombuffer(b"".join(lists), "<i4").reshape(-1, 2))
                    edges = [0, *gone.ravel().tolist(), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                    spans.append(len(gone))
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["h1", "h2", "n_removed", "n_spans", "kept"])

    return rows.select("h1", "h2", "text", "lists").mapInArrow(run, "h1 long, h2 long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, digest: bool = False, hot: int = HOT, id_bits: int = ID_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes left, for every row of docs.

    kept (binary) holds the remaining bytes, or kept_sha256 their digest where digest
    is set. Null texts are empty; texts shorter than SPAN lose nothing. Ids of any
    orderable type count in their order, null ids after all others; rows with equal ids
    don't count against each other. Repeated rows come out repeated, an empty table
    gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = place_of(rows, "doc_id", "place", LAST)
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")})
    whole = F.sha2("text", 256) if digest else F.col("text")
    empty = F.lit(hashlib.sha256(b"").hexdigest()) if digest else F.lit(b"")
    narrow = cut(rows.select("doc_id", "h1", "h2", "n_bytes", "place", *([whole.alias("whole")] if digest else [])))
    long = F.col("n_bytes") >= SPAN
    size = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    id_mask = (1 << id_bits) - 1
    firsts = narrow.where(long).groupBy("h1", "h2").agg(F.min("place").alias("first"))
    shared, hot_keys = _marked(cut(_shared_keys(rows.where(long), ranges, hot, id_mask).groupBy("id48").agg(F.collect_list("key").alias("keys"))))
    known = firsts.withColumn("id48", F.col("h1").bitwiseAND(id_mask)).withColumn("twin", F.count("*").over(Window.partitionBy("id48")) > 1)
    known = known.join(shared, "id48", "left").where(F.col("twin") | F.col("keys").isNotNull()).drop("id48")

    texts = rows.where(long).select("h1", "h2", "text").dropDuplicates(["h1", "h2"])  # one exchange, used twice
    spans = _settle(_segments(texts.join(known, ["h1", "h2"]), ranges, hot_keys))
    lists = spans.groupBy("h1", "h2").agg(F.collect_list("spans").alias("lists"))
    left = _cut_texts(texts.join(lists, ["h1", "h2"]))
    left = left.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "n_removed", "n_spans", (F.sha2("kept", 256) if digest else F.col("kept")).alias("kept"))

    firsts = firsts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first").join(left, (F.col("f1") == F.col("l1")) & (F.col("f2") == F.col("l2")), "left").drop("l1", "l2")
    base = narrow if digest else rows.withColumn("whole", F.col("text"))
    # a table of its own, so that the join of a text with very many copies can be split
    all_ = base.join(cut(firsts), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    copy = F.col("place") > F.col("first")
    none = F.lit(0).cast("long")
    return all_.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256" if digest else "kept"),
    )
