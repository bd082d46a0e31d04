"""Mixing sources to target weights by capped water-filling.

Targets share all words by weight. A source whose share exceeds `epochs` times its
size is clamped there and its excess is reshared among the others by weight, round
after round, until none is above. Each document is then taken whole as often as its
source's ratio says; the fraction left goes to whole documents in a seeded order
and ends inside one of them, so that a source's words meet its target exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, let, ranked, word_count

#: Rows of the table for each bucket that its sources are split into, by leading hex
#: digits of the seeded order. The order, and so the result, is the same for any number.
BUCKET_ROWS = 50_000


def fill_levels(sources: DataFrame, epochs: int) -> DataFrame:
    """sources(source_size, weight) plus target: water-filling, one aggregate a round.

    Only sums reach the driver. A round clamps every source above its cap, so the
    rounds end when no source is above.
    """
    cap = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight = total, sources.agg(F.sum("weight")).first()[0] or 0
    clamped = F.lit(False)
    while weight:
        # share above cap, in whole numbers: weight * left > cap * free weight
        clamped = F.col("weight") * F.lit(left).cast("decimal(38,0)") > cap * F.lit(weight).cast("decimal(38,0)")
        row = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        now = (total - (row[0] or 0), row[1] or 0)
        if now == (left, weight):
            break
        left, weight = now
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies, part, taken per row of docs.

    copies: times the whole document is taken; part: words of it taken once more;
    taken = copies * size + part. Sources by code point, null last, weigh `weights`
    in turn. Null texts have size 0 and take 0; a source without words has target 0;
    null and repeated ids are ordinary rows; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")).alias("place"),
    )
    rows = cut(rows)
    n, bucket_digits = rows.count(), 2
    while 16**bucket_digits * BUCKET_ROWS < n:
        bucket_digits += 1
    rows = rows.withColumn("bucket", F.substring("place", 1, bucket_digits))
    cells = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size")))
    sources = cut(_number(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights))
    known = fill_levels(sources, epochs)
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    known = known.select(F.col("source").alias("k_source"), "source_size", "target", whole.cast("int").alias("copies"), (goal - whole * F.col("source_size")).cast("long").alias("extra"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    cells = cells.join(known, F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source", "cell_size")
    cells = cells.withColumnsRenamed({"source": "c_source", "bucket": "c_bucket"})
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("cell_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - start))
    rows = rows.withColumn("part", part.cast("long"))
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    return rows.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        (F.col("copies") + full.cast("int")).alias("copies"), F.when(full, F.lit(0)).otherwise(F.col("part")).cast("long").alias("part"),
        (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


def _number(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """weight by the source's place in code-point order, null last."""
    turn = F.element_at(F.lit(list(weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    return ranked(sources, "source", "turn").withColumn("weight", turn.cast("long")).drop("turn")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    piece = lambda g, w: F.transform(F.slice(F.arrays_zip(g.alias("g"), w.alias("w")), F.lit(1), n), lambda x: F.concat(x["g"], x["w"]))
    return let(gaps, lambda g: F.array_join(let(words, lambda w: piece(g, w)), ""))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row as often as mixed says; rows are told apart by id and text.

    A part becomes one more row that holds the document up to the end of its `part`-th
    word. Rows equal in id and text share their copies: together they come as often as
    mixed says. Null ids are ordinary rows; null texts have no words and go.
    """
    share = mixed.groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.sum("copies").alias("copies"), F.sum("part").alias("part"), F.count("*").alias("rows"))
    share = share.where("copies > 0 or part > 0")
    rows = docs.join(share, F.col(id_col).eqNullSafe(F.col("m_id")) & (F.xxhash64(text_col) == F.col("m_hash")))
    repeated = share.where("rows > 1").limit(1).count() > 0
    if repeated:
        rows = rows.dropDuplicates([id_col, "m_hash"])
    times = F.when(F.col("part") > 0, F.col("copies") + 1).otherwise(F.col("copies")).cast("int")
    rows = rows.withColumn("m_turn", F.explode(F.sequence(F.lit(1), times)))
    head = first_words(F.col(text_col), F.col("part").cast("int"))
    text = F.when(F.col("m_turn") > F.col("copies"), head).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
