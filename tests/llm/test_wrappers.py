"""The registered op queries on one small hard table, column by column against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from test_operators import WORDS, brute_print, brute_removed, brute_rules, brute_spans, counted, frame, hard_rows, pii_texts, token_lists

from edgeloom.llm import queries

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_langid": "doc_id held_out lang_pred score",
    "op6_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_tokens": "doc_id n_bytes n_tokens over_limit",
    "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.fixture(scope="module")
def rows():
    extra = [(300 + k, t, None, "zz" if k % 3 else None) for k, t in enumerate(pii_texts()[:12])]
    return [(r[0], r[1], r[2] if len(r) > 2 else "xx" if k % 2 else "yy", r[3] if len(r) > 3 else "abc"[k % 3]) for k, r in enumerate(hard_rows() + extra)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("wrapped")
    frame(spark, rows).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(8 + k, 1, 0) for k in range(12)] + [(None, 1, 0), (62, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}"


def run(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == "bigint" for c in COLUMNS[name].split() if c.startswith("n_") or c in ("size", "slot", "taken", "start", "length", "offset", "sequence_id", "ids_crc32", "text_crc32", "tail_crc32"))
    return out.collect()


def raw(text):
    return (text or "").encode()


def test_fingerprints(spark, folder, rows):
    got = run(spark, folder, "op1_simhash")
    assert counted((r.doc_id, r.fingerprint) for r in got) == counted((r[0], format(brute_print(r[1]), "016x")) for r in rows)


def test_mixing(spark, folder, rows):
    got = run(spark, folder, "op2_mixing")
    size = lambda t: len(WORDS.findall(t or ""))
    assert counted((r.doc_id, r["size"]) for r in got) == counted((r[0], size(r[1])) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(size(r[1]) for r in rows), abs=5)


def test_personal_data(spark, folder, rows):
    want = collections.Counter()
    for r in rows:
        found = brute_spans(r[1])
        line = ",".join(":".join(map(str, s)) for s in found)
        want[(r[0], *[sum(k == s[0] for s in found) for k in ("email", "ip", "card", "phone")], hashlib.sha256(line.encode()).hexdigest())] += 1
    got = run(spark, folder, "op3_pii")
    assert counted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = [(("email", "ip", "card", "phone").index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_repeats(spark, folder, rows):
    assert counted(tuple(r) for r in run(spark, folder, "op4_suffixes")) == brute_removed(rows)


def brute_language(rows):
    """Bit sets of 4-grams replaced by plain sets: the languages a text's grams occur in."""
    sets = collections.defaultdict(set)
    for r in rows:
        if r[2] is not None and r[1] and zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 != 1:
            sets[r[2]] |= {r[1][k : k + 4] for k in range(len(r[1]))}
    return sets


def test_languages(spark, folder, rows):
    got = run(spark, folder, "op5_langid")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    assert counted((r.doc_id, r.held_out) for r in got) == counted((r[0], held(r[0])) for r in rows)
    learned = set(brute_language(rows))
    letter = {r[0]: bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in learned | {"und"}
        assert letter[r.doc_id] or r.lang_pred == "und"


def test_media(spark, folder, rows):
    got = run(spark, folder, "op6_media")
    want = collections.Counter()
    for r in rows:
        text = raw(r[1])
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        want[r[0], len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert counted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = collections.defaultdict(set)
    for r in got:
        same[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_tokens(spark, folder, rows):
    want = counted((r[0], len(raw(r[1])), len(ids), len(ids) > 2048) for r, ids in zip(rows, token_lists(rows), strict=True))
    assert counted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, folder, "op7_tokens")) == want


def test_quality(spark, folder, rows):
    got = run(spark, folder, "op8_quality")
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == counted((r[0], *brute_rules(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_packing(spark, folder, rows):
    got = run(spark, folder, "op9_packing")
    lists = [ids + [2] for ids in token_lists(rows)]
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    want = collections.defaultdict(list)
    for r, ids in zip(rows, lists, strict=True):
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            want[r[0]].append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert {k: counted(v) for k, v in pieces.items()} == {k: counted(v) for k, v in want.items()}
    for x in windows.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 4096


def test_shards_obey_the_stored_map(spark, folder, rows):
    got, again = run(spark, folder, "op10_sharding"), run(spark, folder, "op10_sharding")
    assert counted((r.doc_id, r["size"], r.text_crc32) for r in got) == counted((r[0], len(raw(r[1])) + 16, zlib.crc32(raw(r[1]))) for r in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 40 for r in got)
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert counted(map(tuple, again)) == counted(map(tuple, got)) and {r.map_version for r in again} == {1}


@pytest.mark.parametrize("name", COLUMNS)
def test_empty_table(spark, tmp_path, name):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, f"file://{tmp_path}", name) == []
