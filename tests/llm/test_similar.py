"""Near-duplicates by shingle similarity against brute force."""

import itertools
import random

import pytest

import corpus_pipeline
from edgeloom.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def groups_of(texts):
    """Root of each text's group: brute-force Jaccard on 5-word shingles, closed transitively."""
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def corpus(seed):
    rnd = random.Random(seed)
    line = " ".join(f"common{k}" for k in range(9))  # one very common line
    texts = [None, "", "one two", "One  two"]
    for k in range(25):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([12, 30, 90, 200]))]
        for _ in range(rnd.randint(1, 5)):  # copies with edits around the bound
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 1)] = [f"new{rnd.randint(0, 3000)}"]
            texts.append(" ".join(copy) + (f" {line}" if k % 2 else ""))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("common", "few"), [(2, 32), (10**9, 1)])
def test_near_dedup_is_brute_force(spark, monkeypatch, common, few):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "FEW", few)
    texts = corpus(5)
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(texts)))


def test_one_inserted_word(spark):
    words = [f"w{k}" for k in range(88)]
    texts = [" ".join(words), " ".join([*words[:40], "more", *words[40:]])]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_hot_shingles_are_dealt_exactly(spark, monkeypatch):
    """Shingles of many sets joined in parts give the groups of brute force."""
    monkeypatch.setattr(similar, "FEW", 2)
    texts = corpus(9)
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = similar._rows(docs, 5, "doc_id", "text").cache()
    groups = similar.components(similar.similar_links(docs, rows, key_rows=3))
    found = {r.node: r.component for r in groups.collect()}
    got = [found.get(r.set, r.set) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    want = groups_of(texts)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_budget_covers_the_bound():
    """Fingerprints of random sets at similarity 0.8 are far within the trie's budget."""
    import numpy as np

    rnd, far = np.random.default_rng(1), []
    for n in (9, 45, 90, 450):
        for _ in range(300):
            pool = rnd.integers(0, 2**63, n + n // 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = pool[:n], pool[n // 9 :]
            assert 5 * (n - n // 9) >= 4 * (n + n // 9) or n < 10
            far.append((similar.fingerprint(a) ^ similar.fingerprint(b)).bit_count())
    assert max(far) <= similar.BUDGET and 6 < np.mean(far) < 12


def test_near_copies_name_few_pairs(spark, monkeypatch):
    """Of near copies around the bound a forest of pairs and what it leaves apart are compared, not all pairs; groups are those of brute force."""
    monkeypatch.setattr(similar, "FEW", 2)
    rnd, named, confirmed = random.Random(3), [], similar._confirmed
    monkeypatch.setattr(similar, "_confirmed", lambda docs, sets, pairs, *a: named.append(pairs.distinct().count()) or confirmed(docs, sets, pairs, *a))
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(160):
        words = list(base)
        for at in rnd.sample(range(4, 146), rnd.choice((1, 2, 2))):
            words[at] = f"new{rnd.randint(0, 10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA)
    rows = similar._rows(docs, 5, "doc_id", "text").cache()
    found = {r.node: r.component for r in similar.components(similar.similar_links(docs, rows)).collect()}
    got, want = [found.get(r.set, r.set) for r in sorted(rows.collect(), key=lambda r: r.doc_id)], groups_of(texts)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True))) < 40
    assert sum(named) < 8 * len(texts)


def test_sketches_never_exceed_the_difference():
    """Sketches of sets of any sizes differ in no more bits than the sets in shingles, and tell most far sets apart."""
    import numpy as np

    rnd, sets = np.random.default_rng(2), []
    for n in (0, 1, 15, 16, 17, 40, 64, 65, 150, 1030, 3000):
        pool = rnd.integers(-(2**63), 2**63 - 1, n + n // 5 + 1)
        sets += [np.unique(pool[:n]), np.unique(pool[-n:] if n else pool[:0]), np.unique(pool)]
    sketches = similar.Sketches([similar.sketch(x) for x in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    assert sketches.within(a, b, apart).all()
    size = np.array([len(x) for x in sets])
    close = (np.minimum(size[a], size[b]) >= 40) & (np.maximum(size[a], size[b]) <= 1300) & (apart > 0) & (2 * apart < size[a] + size[b])
    assert close.sum() > 8 and not sketches.within(a, b, apart * 2 // 3)[close].any()


def test_forest_keeps_what_links():
    import numpy as np

    root = np.array([0, 0, 2, 3, 4, 4])
    a, b = np.array([1, 0, 2, 1, 3, 5]), np.array([0, 2, 1, 3, 2, 4])
    kept = similar._forest(root, a, b)
    assert len(kept) == 2 and {(int(a[k]), int(b[k])) for k in kept} <= {(0, 2), (2, 1), (1, 3), (3, 2)}
    assert not len(similar._forest(root, a, b))
