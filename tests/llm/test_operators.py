"""Brute-force checks of the training-data operators on small hard tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import langid, media, mixing, packing, pii, quality, sharding, simhash, suffixes, tokencount
from edgeloom.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with those the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h1 long, fp string, size string, place string, key string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "x", 1, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def hard_rows():
    """Nulls everywhere, empty and long texts, ties, copies, repeated rows."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    rows = [(None, "no id " + passage, None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, prose(30)), (5, prose(25)), (6, passage), (7, prose(40) + " " + passage + " " + prose(10))]
    rows += [(8 + k, prose(120)) for k in range(12)]
    base = prose(150)
    rows += [(30 + k, base if k < 4 else " ".join(w if rnd.random() > 0.02 else "zz" for w in base.split(" "))) for k in range(14)]
    rows += [(60, "é" * 80 + passage), (61, prose(5000)), (62, "a b " * 3000), (60, "é" * 80 + passage), (63, "日本語 " * 20), (64, "x" * 30000)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def counted(items):
    return collections.Counter(items)


# ---- SimHash


def brute_print(text):
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, rows, empty):
    prints = [brute_print(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(find(k), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = counted((r[0], format(prints[k], "016x"), least[find(k)]) for k, r in enumerate(rows))
    got = simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert counted(map(tuple, got)) == want
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(rows))})


def test_hot_keys_are_split_exactly(spark):
    rnd = random.Random(3)
    values = {0}
    while len(values) < 300:  # a chain of close fingerprints that share most blocks
        values.add(rnd.choice(sorted(values)) ^ (1 << rnd.randrange(12)) ^ (1 << rnd.randrange(12)))
    values |= {rnd.getrandbits(63) for _ in range(50)}
    prints = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")

    def groups(key_rows):
        from edgeloom.llm.components import components

        got = components(simhash.links(prints, key_rows=key_rows))
        return {(r.node, r.component) for r in got.collect()}

    whole = groups(10_000)
    assert groups(20) == whole and len(whole) >= 300


@pytest.mark.parametrize("spread", [8, 20, 64])
def test_trie_join_finds_every_link(spread):
    rnd = random.Random(spread)
    values = np.unique(np.array([rnd.getrandbits(spread) for _ in range(400)], np.uint64))
    joiner = simhash.Joiner(values, 4)
    joiner.run(np.array([0]), np.array([len(values)]))
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if int(values[a] ^ values[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(values))] == joiner.find(np.arange(len(values))).tolist()


def test_components_of_a_long_path(spark):
    from edgeloom.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("one", [0, 10**6])
def test_components_by_stars_and_in_one_task(spark, monkeypatch, one):
    """Long paths, hubs and repeated edges give the same components whether they are many edges or few."""
    from edgeloom.llm import components

    monkeypatch.setattr(components, "ONE", one)
    rnd = random.Random(one)
    pairs = [(k, k + 1) for k in range(60)] + [(-k, 1000) for k in range(70, 90)] + [(3, 3), (7, 6)]
    pairs += [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] * 2
    root = {x: x for pair in pairs for x in pair if pair[0] != pair[1]}
    for _ in root:
        for u, v in pairs:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    edges = spark.createDataFrame([(u * 2**40, v * 2**40) for u, v in pairs], "u long, v long").repartition(5)
    assert {r.node: r.component for r in components.components(edges).collect()} == {u * 2**40: v * 2**40 for u, v in root.items()}
    assert components.components(edges.limit(0)).count() == 0


def test_few_edges_take_few_tasks(spark):
    """A short list of edges is not sent through rounds of shuffles, each with as many files and events as there are partitions."""
    from edgeloom.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert components(edges).count() == 41
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("components") for s in status.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)
    assert 0 < tasks < 30


# ---- mixing


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert counted((r.doc_id, r.size) for r in got) == counted((r[0], size(r[1])) for r in rows)
    for r in got:
        assert r.taken == r.copies * r.size + r.part and 0 <= r.taken <= 3 * r.size
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for mine in by.values():
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert mine[0].source_size == sum(r.size for r in mine)
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(5)).collect()
    assert counted(map(tuple, again)) == counted(map(tuple, got))


def test_targets_by_water_filling(spark):
    sizes = {"a": 10, "b": 500, "c": 20, "d": 300, "e": 170}
    df = frame(spark, [(k, "w " * n, "en", s) for k, (s, n) in enumerate(sizes.items())])
    target = {r.source: r.target for r in mixing.mix(df).collect()}
    weight, cap, clamped = dict(zip(sorted(sizes), (1, 2, 3, 1, 2), strict=True)), {s: 3 * n for s, n in sizes.items()}, set()
    while True:
        left = sum(sizes.values()) - sum(cap[s] for s in clamped)
        free = sum(w for s, w in weight.items() if s not in clamped)
        over = {s for s in sizes if s not in clamped and weight[s] * left > cap[s] * free}
        if not over:
            break
        clamped |= over
    assert target == pytest.approx({s: cap[s] if s in clamped else weight[s] * left / free for s in sizes})


def test_mix_applied(spark):
    df = frame(spark, [(k, f"d{k} " + "w " * (5 + k), "en", "ab"[k % 2]) for k in range(20)])
    mixed = mixing.mix(df)
    out = mixing.apply_mix(df, mixed)
    words = lambda x: sum(len(WORDS.findall(r.text)) for r in x.collect())
    assert out.columns == df.columns and words(out) == mixed.agg(F.sum("taken")).first()[0]


def test_mix_applied_to_hard_rows(spark):
    """White space stays in partial copies; nulls, repeated rows; buckets don't change the mix."""
    rows = [(None, " one  two\n\nthree "), (1, None), (2, "a b\tc\n d"), (2, "a b\tc\n d")] + [(3 + k, f"w{k}\n" * (4 + k), "en", "t") for k in range(9)]
    df = frame(spark, rows)
    mixed = mixing.mix(df)
    texts = {r[1] for r in rows}
    out = mixing.apply_mix(df, mixed).collect()
    assert all(r.text in texts or any(t and t.startswith(r.text) and t[len(r.text)].isspace() for t in texts) for r in out)
    assert sum(len(WORDS.findall(r.text or "")) for r in out) == mixed.agg(F.sum("taken")).first()[0]
    assert mixing.apply_mix(df.limit(0), mixed.limit(0)).count() == 0


def test_bucket_number_does_not_change_the_mix(spark, docs, monkeypatch):
    once = counted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0.001)
    assert counted(map(tuple, mixing.mix(docs).collect())) == once


# ---- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def pii_texts():
    rnd = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f x@y..z a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 300.1.2.3 0255.1.1.1 1.2.3 9.9.9.9", "4111 1111 1111 1111 and 4111111111111112, 41-11", "+1 (269) 555-3296 4524132264652876 +49 30 1234567", "é😀 a@b.cd 😀 +1 (222) 333-4444.", "a" * 5000 + "@b.c", "5 " * 4000, "1" * 6000, "x@" + "a." * 3000]
    texts += ["".join(rnd.choice("ab1234567890 .-@+()é") for _ in range(rnd.randint(5, 80))) for _ in range(300)]
    return texts


def test_pii_base_spans(spark):
    texts = pii_texts()
    found = pii.find(frame(spark, list(enumerate(texts))))
    line = pii.digest_line({k: F.col(f"{k}_base") for k in pii.KINDS})
    every = pii.digest_line({k: F.col(f"{k}_spans") for k in pii.KINDS})
    for r in found.select("doc_id", line.alias("base"), every.alias("spans")).collect():
        want = [":".join(map(str, s)) for s in brute_spans(texts[r.doc_id])]
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(","))


def test_pii_adds_and_redacts(spark):
    text = "call +1 (269) 555-3296 4524132264652876 or bob (at) site (dot) com; version 1.2.3.4"
    df = pii.find(frame(spark, [(1, text), (2, None), (3, "plain words only")]))
    red = pii.redact(F.col("text"), {k: F.col(f"{k}_spans") for k in pii.KINDS})
    out = {r.doc_id: r.x for r in df.select("doc_id", red.alias("x")).collect()}
    assert out[1].startswith("call [PHONE] ") and "(at)" not in out[1] and "[EMAIL]" in out[1]
    assert out[2] == "" and out[3] == "plain words only"


# ---- suffixes


def brute_removed(rows):
    first, out = {}, []
    last = 2**63 - 1
    data = [(last if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for d, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], last), d)
    for (d, b), r in zip(data, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((r[0], len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return counted(out)


def test_suffix_dedup(docs, rows, empty):
    got = suffixes.remove_repeats(docs, digest=True)
    assert counted(map(tuple, got.collect())) == brute_removed(rows)
    whole = suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert counted(map(tuple, whole.collect())) == brute_removed(rows)
    assert suffixes.remove_repeats(empty, digest=True).count() == 0


def test_suffix_dedup_of_texts_with_equal_short_hashes(spark):
    """Texts that pass 1 cannot tell apart lose no link; ids of any type keep their order."""
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passages = [prose(30) for _ in range(8)]
    rows = [(k, f"{prose(rnd.randint(3, 30))} {passages[k % 8]} {prose(rnd.randint(0, 20))}") for k in range(40)]
    want = brute_removed(rows)
    for bits in (0, 1, 3):
        assert counted(map(tuple, suffixes.remove_repeats(frame(spark, rows).repartition(3), digest=True, id_bits=bits).collect())) == want
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    got = suffixes.remove_repeats(named, digest=True).collect()
    assert counted((int(r[0][1:]), *r[1:]) for r in got) == want


@pytest.mark.parametrize("hot", [3, 20, suffixes.HOT])
def test_suffix_dedup_with_common_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_KEYS", 0 if hot == 20 else 1000)  # 20: hot keys by join
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    line = " ".join(word() for _ in range(40))
    rows = [(k, " ".join(word() for _ in range(rnd.randint(5, 60))) + line[rnd.randint(0, 30) :] + " ".join(word() for _ in range(rnd.randint(0, 40)))) for k in range(60)]
    want = brute_removed(rows)
    df = frame(spark, rows).repartition(4)
    assert counted(map(tuple, suffixes.remove_repeats(df, digest=True, hot=hot).collect())) == want


def test_deep_shallow_sets():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"ab") for _ in range(50))
    strings = [base] * 3 + [base[:k] + b"z" + base[k + 1 :] for k in (0, 10, 23, 24, 30, 49, 49)] + [bytes(rnd.choice(b"ab") for _ in range(50)) for _ in range(50)]
    group = np.array([k % 2 for k in range(len(strings))])
    got = {frozenset(x.tolist()) for x in suffixes.deep_shallow(group, np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 50))}
    want = collections.defaultdict(set)
    for k, s in enumerate(strings):
        want[group[k], s].add(k)
    assert got == {frozenset(v) for v in want.values() if len(v) > 1}


def test_blind_trie_orders():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"abc") for _ in range(6)) for _ in range(200)]
    trie = suffixes.BlindTrie()
    for k, s in enumerate(strings):
        trie.insert(s, k)
    leaves = [[strings[k] for k in x] for x in trie.leaves()]
    assert [x[0] for x in leaves] == sorted(set(strings)) and all(len(set(x)) == 1 for x in leaves)


# ---- languages


def test_languages(spark):
    rnd = random.Random(1)
    parts = {"xx": ["lo", "ma", "ti", "ra"], "yy": ["gru", "sch", "ken", "tz"], "zz": ["ño", "que", "ción", "ía"]}
    make = lambda lang: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(60))
    train = [(k, make(lang), lang) for k, lang in enumerate(list(parts) * 30)] + [(900, None, "xx"), (901, "lolo", None)]
    filters = langid.fit(frame(spark, train))
    test = [(k, make(lang), lang) for k, lang in enumerate(list(parts) * 20)]
    special = [(500, None), (501, ""), (502, "123 !?"), (503, "schken"), (504, "lo"), (None, "ma ti ra")]
    got = langid.identify(frame(spark, test + special), filters).collect()
    right = {k: lang for k, _, lang in test}
    assert np.mean([right[r.doc_id] == r.lang_pred for r in got if r.doc_id in right]) >= 0.98
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert by[503].lang_pred == "yy" and len(got) == len(test) + len(special)
    nothing = langid.fit(frame(spark, []))
    assert {r.lang_pred for r in langid.identify(frame(spark, special), nothing).collect()} == {"und"}


def test_languages_by_brute_force():
    """Bit-sliced filters and popcounts against plain sets of slots, language by language."""
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghilmnoprstuvé") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    texts = {lang: [words(30) for _ in range(6)] for lang in ("aa", "bb", "cc")}
    keys = [np.unique(langid.ngrams(x)[0]) for x in texts.values()]
    filters = langid.Filters(list(texts), keys)
    sets = [{int(s) for place in langid.places(k) for s in place} for k in keys]
    tests = [None, "", "12 !", texts["bb"][0], texts["aa"][3][:40] + " " + texts["cc"][1], *[words(12) for _ in range(20)]]
    for text, (lang, score) in zip(tests, filters.predict(tests), strict=True):
        key, _, has = langid.ngrams([text])
        if not has[0]:
            assert (lang, score) == ("und", 0.0)
            continue
        share = []
        for mine in sets:
            false = (len(mine) / (1 << langid.SLOT_BITS)) ** langid.HASHES
            hits = sum(all(int(p[k]) in mine for p in langid.places(key)) for k in range(len(key)))
            share.append((hits / len(key) - false) / (1 - false))
        assert lang == list(texts)[int(np.argmax(share))] and score == pytest.approx(min(1.0, max(0.0, max(share))))


def test_merges_in_order():
    up = tokencount.RankMerger.ascending
    assert up(np.array([0, 3]), np.array([1, 2]), np.array([3, 4])) and not up(np.array([3, 0]), np.array([2, 1]), np.array([4, 3]))


def test_many_languages_use_several_mask_words():
    keys = [np.arange(k * 50, k * 50 + 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(70)]
    filters = langid.Filters([f"l{k:02d}" for k in range(70)], keys)
    assert filters.masks.shape[0] == 2
    assert len(filters.predict(["abc def"])) == 1


# ---- media


def test_media_round_trip(docs, rows, empty):
    got = media.inspect_media(media.store_media(docs)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert counted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.type == "audio/wav" and r.media_bytes >= r.payload_bytes + 44 for r in got)
    assert media.inspect_media(media.store_media(empty)).count() == 0


def test_sniffing_confirms_and_carves():
    import struct

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\x02\xff\xd9"
    wav = media.wav(b"text %PDF- BM PK\x03\x04 RIFF" + png + gif)
    assert [(x[0], x[2]) for x in media.sniff(png)] == [(0, "image/png")] and media.sniff(png)[0][3] == {"width": 3, "height": 2}
    assert media.sniff(gif)[0][1] == len(gif) and media.sniff(jpeg)[0][1:3] == (len(jpeg), "image/jpeg")
    found = media.sniff(wav)
    assert [x[2] for x in found] == ["audio/wav", "image/png", "image/gif"]
    assert wav[found[1][0] : found[1][0] + found[1][1]] == png
    inner = b"PK\x03\x04name" + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0, 0, 0, 8, 0)
    outer = b"PK\x03\x04 stored " + inner + b" central" + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0, 0, 8, 12 + len(inner), 0)
    assert media.sniff(outer + b"tail")[0][:3] == (0, len(outer), "application/zip")
    flac = b"fLaC" + b"\x80\0\0\x22" + b"\0" * 34
    assert [(x[0], x[1], x[2]) for x in media.sniff(b"--" + flac + b"frames" + png)] == [(2, len(flac), "audio/flac"), (2 + len(flac) + 6, len(png), "image/png")]
    pdf = b"%PDF-1.4\nxref\n0 0\nstartxref\n9\n%%EOF"
    twice = pdf + b"\nmore 1 0 obj\nstartxref\n9\n%%EOF"
    assert [x[:3] for x in media.sniff(b"  " + twice + b" x " + pdf)] == [(2, len(twice), "application/pdf"), (5 + len(twice), len(pdf), "application/pdf")]
    assert media.sniff(b"%PDF-1.4 text startxref 999 %%EOF") == []
    broken = png[:20] + b"?" + png[21:]
    assert media.sniff(broken) == [] and media.sniff(b"") == [] and media.sniff(b"BM") == []


# ---- tokens, packing


def token_lists(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows]


def token_rows():
    rnd = random.Random(6)
    texts = ["it's I'LL <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΟΔΟΣ Σ ΑΣ", "x\x1cy z w", "é É", "İIıß ǅ", "😀😀👨‍👩‍👧", "\x00﻿", "a \x01 b\x01c", "aaaa aaaaaaa" * 50]
    texts += ["".join(rnd.choice("aabbcdeehtinorsΣéÉ <|>'.,1\n\t😀ß漢") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return hard_rows() + [(1000 + k, t) for k, t in enumerate(texts)]


def test_token_counts(spark, empty):
    rows = token_rows()
    got = tokencount.count_tokens(frame(spark, rows), tokenizer_path()).collect()
    want = counted((r[0], len((r[1] or "").encode()), len(ids), len(ids) > 2048) for r, ids in zip(rows, token_lists(rows), strict=True))
    assert counted(map(tuple, got)) == want
    assert tokencount.count_tokens(empty, tokenizer_path()).count() == 0


def test_small_word_tables_give_the_same_tokens():
    from edgeloom.llm.wordtable import WordTable

    texts = [r[1] for r in token_rows()]
    ids, counts = packing._ids(tokenizer_path()), tokencount._table(tokenizer_path())
    small, few = WordTable(ids.encode, 50, fold=True), WordTable(counts.encode, 50, fold=True)
    for k in range(0, len(texts), 7):
        flat, n = ids.token_ids(texts[k : k + 7])
        again, m = small.token_ids(texts[k : k + 7])
        assert flat.tolist() == again.tolist() and n.tolist() == m.tolist() == few.token_counts(texts[k : k + 7]).tolist()


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, empty, window):
    rows = token_rows()
    lists = [ids + [2] for ids in token_lists(rows)]
    got = packing.pack(frame(spark, rows).repartition(3), tokenizer_path(), window).collect()
    want = counted((r[0], len(ids), at, np.array(ids[at : at + window], "<u4").tobytes()) for r, ids in zip(rows, lists, strict=True) for at in range(0, len(ids), window))
    assert counted((r.doc_id, r.doc_tokens, r.start, bytes(r.ids)) for r in got) == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= window
    total = sum(map(len, lists))
    assert len(windows) <= -(-total // window) + 2
    assert packing.pack(empty, tokenizer_path(), window).count() == 0


def test_minimum_bin_slack():
    rnd = random.Random(8)
    for _ in range(60):
        counts = collections.Counter(rnd.randint(3, 40) for _ in range(9))
        first = max(counts)
        found = packing.fullest(dict(counts), sorted(counts, reverse=True), first, 50)
        reach = {0}
        left = counts - collections.Counter([first])
        for n, c in left.items():
            for _ in range(c):
                reach |= {x + n for x in reach if x + n <= 50 - first}
        assert sum(k * n for k, n in found.items()) == first + max(reach)
        assert all(n <= counts[k] for k, n in found.items())
    used = collections.Counter()
    for times, found in packing.plan({5: 1000, 7: 333, 50: 3}, 50):
        assert sum(k * n for k, n in found) <= 50
        for k, n in found:
            used[k] += n * times
    assert used == {5: 1000, 7: 333, 50: 3}


# ---- quality


def brute_rules(text):
    text = text or ""
    w, seen, dup = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark, docs, rows, empty):
    extra = [(200, "a b c\nd\na b c\n \n \na b c"), (201, "# * | < > & $ %"), (202, " ".join("one two three four five six seven eight nine ten".split() * 4)), (203, "\n".join(["x y"] * 30))]
    df = docs.unionByName(frame(spark, extra))
    labels = spark.createDataFrame([(8 + k, 1) for k in range(12)] + [(None, 1), (5, None), (62, 0)], "doc_id long, quality int")
    got = quality.judge(df, quality.trusted_ids(labels)).collect()
    want = counted((r[0], *brute_rules(r[1])) for r in rows + extra)
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        assert r.kept or r.base_failed or r.doc_id not in range(8, 20)
    assert quality.judge(empty, quality.trusted_ids(labels)).count() == 0
    nobody = quality.trusted_ids(labels.limit(0))
    assert all(r.kept != r.base_failed and r.score == 0 for r in quality.judge(df, nobody).collect())


def test_quality_on_held_out_trusted_rows(spark):
    """The ratio and its threshold keep trusted rows they were not fitted on, and refuse junk."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    trusted = quality.trusted_ids(labels.where(mine))
    rows = quality.judge(docs, trusted).join(labels.where(~mine), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    got = {r.quality: (r.kept, r.n) for r in rows.collect()}
    print(got)
    assert got[1][0] > 0.95 and got[0][0] < 0.5


def test_quality_scores(spark):
    """Scores against a plain count of hashed words and pairs."""
    import math

    good = [(k, f"the cat number{k} sat on the mat and the dog ran " * 3) for k in range(6)]
    bad = [(50 + k, f"buy### now### cheap{k}### win### ||| " * 6) for k in range(6)]
    df = frame(spark, good + bad)
    trusted = spark.createDataFrame([(k,) for k in range(6)], "t_id long")
    hashed = {r.w: r.b for r in df.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(quality.BUCKETS)).alias("b")).collect()}

    def grams(text):
        ones = [hashed[w] for w in WORDS.findall(text)]
        return ones + [(a * 8191 + b * 31 + 7) % quality.BUCKETS for a, b in zip(ones, ones[1:], strict=False)]

    half = {x.t_id: x.h for x in trusted.select("t_id", quality.fold_of(F.col("t_id")).alias("h")).collect()}
    t, r = [collections.Counter(), collections.Counter()], collections.Counter()
    for k, text in good + bad:
        r.update(grams(text))
        if k < 6:
            t[half[k]].update(grams(text))
    log = lambda n, total: math.log((n + 1) / (total + quality.BUCKETS))
    one = lambda c, b: round((log(c[b], sum(c.values())) - log(r[b], sum(r.values()))) * quality.UNIT) if c else 0
    w = lambda b: (one(t[0], b) + one(t[1], b)) // 2
    got = {x.doc_id: (x.score, x.kept) for x in quality.judge(df, trusted).collect()}
    for k, text in good + bad:
        g = grams(text)
        assert got[k][0] == pytest.approx(sum(map(w, g)) / (len(g) + quality.SHRINK), abs=2)
    assert min(got[k][0] for k in range(6)) > max(got[50 + k][0] for k in range(6))


# ---- shards


def test_sharding(docs, rows, empty, spark, tmp_path):
    at = f"file://{tmp_path}/map"
    got = sharding.shard_documents(docs, at, shards=4).collect()
    want = counted((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert sharding.shard_documents(empty, f"file://{tmp_path}/none", shards=4).count() == 0


def test_stored_map_is_obeyed_and_edited(spark, tmp_path):
    """The map outlives a run; bytes that no longer fit, or another shard, move only some slots."""
    rnd = random.Random(2)
    at = f"file://{tmp_path}/map"
    rows = [(k, "x" * rnd.randint(50, 150)) for k in range(2000)]
    shard = lambda data, n: sharding.shard_documents(frame(spark, data), at, shards=n, slots=512, slack=0.05).collect()
    one, two = shard(rows, 4), shard(rows, 4)
    assert {r.map_version for r in one} == {1} and counted(map(tuple, one)) == counted(map(tuple, two))
    heavy = next(r.shard for r in one if r.doc_id == 0)
    more = rows + [(10_000 + k, "y" * 200) for k in range(300)]
    hot = [(r.doc_id, "z" * 600) for r in one if r.shard == heavy][:400]  # grown records of one shard
    before = sharding.load_map(spark, at, 1)
    three = shard(more + [(20_000 + k, t) for k, t in hot], 4)
    load = collections.Counter()
    for r in three:
        load[r.shard] += r.size
    mean = sum(load.values()) / 4
    assert sharding.versions(spark, at)[-1] in (1, 2) and max(load.values()) <= 1.06 * mean
    grown = shard(more, 5)
    last = sharding.versions(spark, at)[-1]
    assert {r.map_version for r in grown} == {last} and {r.shard for r in grown} == set(range(5))
    old, new = sharding.load_map(spark, at, last - 1), sharding.load_map(spark, at, last)
    assert all(b == 4 for a, b in zip(old, new, strict=True) if a != b)  # slots go into the new shard alone
    assert sum(a != b for a, b in zip(old, new, strict=True)) < 512 / 2 and sharding.load_map(spark, at, 1) == before
    with pytest.raises(ValueError):
        sharding.save_map(spark, new, last, at)
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, rows), at, shards=4, slots=256)


def test_interrupted_version_is_written_again(spark, tmp_path):
    at = f"file://{tmp_path}/map"
    spark.range(1).write.parquet(f"{at}/version=1")
    (tmp_path / "map" / "version=1" / "_SUCCESS").unlink()
    assert sharding.versions(spark, at) == []
    made, version = sharding.current_map(spark, at, {0: 5, 1: 5}, 2, 4)
    assert version == 1 and sharding.load_map(spark, at, 1) == made


def test_rebalancing():
    rnd = random.Random(9)
    weights = {s: rnd.randint(1, 1000) for s in range(1024)}
    old = sharding.balance(weights, 10, 1024)
    load = lambda m, n, w: [sum(w[s] for s in w if m[s] == k) for k in range(n)]
    assert max(load(old, 10, weights)) - min(load(old, 10, weights)) < 1000
    grown = sharding.rebalance(old, weights, 11)
    assert max(load(grown, 11, weights)) <= 1.02 * sum(weights.values()) / 11
    assert all(b == 10 for a, b in zip(old, grown, strict=True) if a != b)
    fewer = sharding.rebalance(old, weights, 9)
    assert all(a == 9 for a, b in zip(old, fewer, strict=True) if a != b) or max(load(fewer, 9, weights)) <= 1.05 * sum(weights.values()) / 9


def test_quality_takes_all_trusted_rows(spark, monkeypatch):
    """No trusted row is left out of the fit, and passes over pieces of them add up to one pass."""
    many = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(many.unionByName(many)).count() == 20_500
    df = frame(spark, [(k, f"the cat number{k % 7} sat on mat{k % 5} and the dog{k % 3} ran home " * 3) for k in range(60)] + [(3, None)])
    trusted = quality.trusted_ids(many.where("doc_id < 40"))
    once = counted((r.doc_id, r.score, r.kept) for r in quality.judge(df, trusted).collect())
    halves = quality.weights(df, trusted)[1]
    least = quality.threshold(df, trusted, halves)
    monkeypatch.setattr(quality, "PIECE", 9)
    assert len(quality._pieces(trusted)) == 5
    assert counted((r.doc_id, r.score, r.kept) for r in quality.judge(df, trusted).collect()) == once
    assert quality.threshold(df, trusted, halves) == least


def test_quality_percentile_is_exact(spark):
    rnd = random.Random(3)
    values = spark.createDataFrame([(rnd.randint(-60_000, 60_000),) for _ in range(400)] + [(None,), (-1,), (-1,)], "s long")
    for share in (0.0, 0.001, 0.25, 0.5, 1.0):
        assert quality._percentile(values, share) == pytest.approx(values.agg(F.percentile("s", F.lit(share))).first()[0], abs=1e-6)
    assert quality._percentile(values.where("s is null"), 0.5) is None
