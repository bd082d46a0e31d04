"""The pipeline's stages on small hard tables, against plain versions of their decisions."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join(rnd.choice("the of and to in that was for with from they have this".split()) + str(rnd.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, rows = random.Random(1), []
    for k in range(40):
        rows.append((k, prose(rnd, 80 + k), "en", "abc"[k % 3]))
    rows += [(100, rows[3][1], "en", "a"), (101, rows[3][1], "en", None), (101, rows[3][1], "en", None), (102, None, None, None), (103, "", "en", "a"), (None, prose(rnd, 50), "en", "b")]
    rows += [(104, prose(rnd, 60) + " mail bob.smith@example.com now", "en", "c"), (105, "win### " * 50, "en", "c"), (106, prose(rnd, 6000), "fr", "b")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(105, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(40)) <= set(ids) and not {102, 103, 105} & set(ids) and ids.count(101) == 2

    one = corpus_pipeline.near_dedup(spark, kept, folder)
    assert one.columns == columns
    groups = collections.defaultdict(list)
    for r in simhash.near_groups(kept).collect():
        groups[r.group].append(r.doc_id)
    assert sorted(map(str, (min(v, key=lambda x: (x is None, x)) for v in groups.values()))) == sorted(str(r.doc_id) for r in one.collect())

    clean = corpus_pipeline.redact_pii(spark, one, folder)
    assert clean.columns == columns
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert "[EMAIL]" in text[104][0] and "@" not in text[104][0] and text[104][1] == len(text[104][0])
    assert {k: v[0] for k, v in text.items() if k != 104} == {r.doc_id: r.text for r in one.collect() if r.doc_id != 104}

    mixed = corpus_pipeline.mix_sources(spark, clean, folder)
    assert mixed.columns == columns
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    before, after = size(clean), size(mixed)
    assert sum(after.values()) == pytest.approx(sum(before.values()), abs=4)
    assert all(after[s] <= 3 * before[s] + 1 for s in after)

    packed = corpus_pipeline.pack_windows(spark, mixed, folder)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert fill[0] <= 4096 and fill[1] <= -(-fill[2] // 4096) + 1


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, f"file://{tmp_path}")
        assert out.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op2_mixing", "op10_sharding"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == n
