"""Edge tables: source, target, label, pubmed, experiment_type and an order.

Row order matters where references are merged (the first seen comes first), so a
frame may carry ORDER, any orderable column; without one, rows order by their cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .iterate import cut

COLUMNS = ["source", "target", "label", "pubmed", "experiment_type"]
ORDER = "_ord"


def canonical(source: Column, target: Column) -> tuple[Column, Column]:
    """An undirected edge's ends in string order; a missing end sorts as 'None' and is null again."""
    a, b = F.coalesce(source, F.lit("None")), F.coalesce(target, F.lit("None"))
    return T.null_of(F.least(a, b)), T.null_of(F.greatest(a, b))


def edge_frame(df: DataFrame, source: str = "source", target: str = "target", label: str | None = "label", pubmed: str | None = None, experiment_type: str | None = None) -> DataFrame:
    """Canonical ends, formatted labels, null tokens as null; keeps ORDER."""
    cell = lambda n: T.null_of(F.col(n)) if n else F.lit(None).cast("string")
    a, b = canonical(F.col(source), F.col(target))
    labels = T.format_labels(F.col(label)) if label else F.lit(None).cast("string")
    rest = [F.col(ORDER)] if ORDER in df.columns else []
    return df.select(a.alias("source"), b.alias("target"), labels.alias("label"), cell(pubmed).alias("pubmed"), cell(experiment_type).alias("experiment_type"), *rest)


def remove_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without a missing cell in subset (ends and label by default); rows stay as they are."""
    missing = [T.is_missing(F.col(c)) for c in (["source", "target", "label"] if subset is None else subset)]
    return df.where(~reduce(lambda a, b: a | b, missing)) if missing else df


def remove_self_edges(df: DataFrame) -> DataFrame:
    """Two missing ends are equal."""
    return df.where(~F.col("source").eqNullSafe(F.col("target")))


def remove_labels(df: DataFrame, labels: list[str | None]) -> DataFrame:
    """Drops rows whose whole label cell is listed; null only if None is."""
    named = [x for x in labels if x is not None]
    hit = F.coalesce(F.col("label").isin(*named), F.lit(False)) if named else F.lit(False)
    return df.where(~(hit | F.col("label").isNull() if None in labels else hit))


def remove_rare_labels(df: DataFrame, least: int) -> DataFrame:
    """Rows whose label cell occurs at least `least` times; null counts as a label.

    A count per label and a join back: a frequent label is not gathered in one task.
    """
    counts = df.groupBy("label").count().where(F.col("count") >= least).select(F.col("label").alias("l_label"))
    return df.join(counts, F.col("label").eqNullSafe(F.col("l_label")), "left_semi")


#: What open rows hold: an edge's ends, its label cell, one publication, one method, and
#: where they were first seen. References stay apart until an edge table is written.
OPEN = ["source", "target", "label", "pmid", "psimi"]


def _order(df: DataFrame, pos: Column) -> Column:
    """Where a reference was first seen: the row's order, then the place in its cell.

    Whole-number orders become one number, which aggregates without sorting.
    """
    if dict(df.dtypes)[ORDER] == "bigint":
        return F.col(ORDER).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)") + pos
    return F.struct(F.col(ORDER).alias("row"), pos.alias("pos"))


def _open(df: DataFrame) -> DataFrame:
    """OPEN and o: one row per edge row, publication and method, equal ones united."""
    rows = df if ORDER in df.columns else df.withColumn(ORDER, F.struct("source", "target", "label", "pubmed", "experiment_type"))
    a, b = canonical(F.col("source"), F.col("target"))
    rows = rows.withColumns({"source": a, "target": b, "label": T.format_labels(F.col("label"))})
    refs = rows.select("source", "target", "label", ORDER, F.posexplode_outer(T.references(F.col("pubmed"), F.col("experiment_type"))).alias("pos", "ref"))
    each = refs.select("source", "target", "label", F.col("ref.pmid").alias("pmid"), F.explode_outer("ref.psimis").alias("psimi"), _order(rows, F.coalesce("pos", F.lit(0))).alias("o"))
    return each.groupBy(*OPEN).agg(F.min("o").alias("o"))


def _merge_open(rows: DataFrame) -> DataFrame:
    """Open rows with one label cell per edge: the union of its labels.

    References follow the cells they came from, in the order these were first seen.
    """
    cells = cut(rows.groupBy("source", "target", "label").agg(F.min("o").alias("first")))
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.split_cell(F.col("label"))))))
    named = cells.groupBy(F.col("source").alias("n_source"), F.col("target").alias("n_target")).agg(T.join_or_null(union).alias("cell"))
    same = F.col("source").eqNullSafe(F.col("n_source")) & F.col("target").eqNullSafe(F.col("n_target"))
    place = cells.join(named, same).select(F.col("source").alias("c_source"), F.col("target").alias("c_target"), F.col("label").alias("c_label"), "first", "cell")
    match = F.col("source").eqNullSafe(F.col("c_source")) & F.col("target").eqNullSafe(F.col("c_target")) & F.col("label").eqNullSafe(F.col("c_label"))
    moved = rows.join(place, match).select("source", "target", F.col("cell").alias("label"), "pmid", "psimi", F.struct("first", "o").alias("o"))
    return moved.groupBy(*OPEN).agg(F.min("o").alias("o"))


def _dedupe_open(rows: DataFrame) -> DataFrame:
    """Open rows by single label; if any cell has several, edges are merged again."""
    rows = cut(rows)  # read more than once, whatever follows
    if rows.where(F.contains("label", F.lit(","))).isEmpty():
        return rows
    apart = rows.withColumn("label", F.explode_outer(F.split("label", ",")))
    return cut(_merge_open(cut(apart.groupBy(*OPEN).agg(F.min("o").alias("o")))))


def _close(rows: DataFrame) -> DataFrame:
    """An edge table of open rows: one row per label cell, references in first-seen order."""
    each = rows.groupBy("source", "target", "label", "pmid").agg(F.min("o").alias("o"), F.array_sort(F.collect_set("psimi")).alias("psimis"))
    ref = F.struct("o", "pmid", F.coalesce(T.join_or_null(F.col("psimis"), "|"), F.lit("None")).alias("group"))
    edges = each.groupBy("source", "target", "label").agg(F.min("o").alias(ORDER), F.array_sort(F.collect_list(F.when(F.col("pmid").isNotNull(), ref))).alias("refs"))
    return edges.select(
        "source", "target", "label",
        T.join_or_null(F.transform("refs", lambda r: r["pmid"])).alias("pubmed"),
        T.join_or_null(F.transform("refs", lambda r: r["group"])).alias("experiment_type"), ORDER,
    )


def merge_labels(df: DataFrame) -> DataFrame:
    """One row per edge: the union of its labels and of its references."""
    rows = cut(_open(df.withColumn("label", F.lit(None).cast("string"))))
    labels = df.select(*[c.alias(n) for c, n in zip(canonical(F.col("source"), F.col("target")), ("l_source", "l_target"), strict=True)], F.explode_outer(T.label_list(F.col("label"))).alias("l"))
    named = labels.groupBy("l_source", "l_target").agg(T.join_or_null(F.array_sort(F.collect_set("l"))).alias("cell"))
    out = _close(rows)
    match = F.col("source").eqNullSafe(F.col("l_source")) & F.col("target").eqNullSafe(F.col("l_target"))
    return out.join(named, match).select("source", "target", F.col("cell").alias("label"), "pubmed", "experiment_type", ORDER)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row per edge and label, references united.

    If any row has several labels, labels are taken apart, deduplicated and merged
    again, so that edges come out once.
    """
    return _close(_dedupe_open(_open(df)))


def process(df: DataFrame, drop_nulls="default", allow_self_edges: bool = False, allow_duplicates: bool = False, exclude_labels: list[str] | None = None, min_counts: int | None = None, merge: bool = False) -> DataFrame:
    """Nulls, null rows, self edges, duplicates, excluded labels, rare labels, merging, in this order.

    drop_nulls: "default" for ends and label, a list of columns, True for any column,
    None or False to keep rows with nulls.
    """
    if isinstance(drop_nulls, str) and drop_nulls != "default" or not isinstance(drop_nulls, (str, list, tuple, bool, type(None))):
        raise TypeError("drop_nulls must be 'default', a list of columns, a boolean or None")
    out = T.normalise_nulls(df, COLUMNS)
    if drop_nulls == "default":
        out = remove_nulls(out)
    elif drop_nulls is True:
        out = remove_nulls(out, [c for c in COLUMNS if c in out.columns])
    elif drop_nulls:
        out = remove_nulls(out, list(drop_nulls))
    if not allow_self_edges:
        out = remove_self_edges(out)
    if allow_duplicates:
        if exclude_labels:
            out = remove_labels(out, exclude_labels)
        if min_counts:
            out = remove_rare_labels(cut(out), min_counts)  # read twice
        return merge_labels(out) if merge else out
    rows = _dedupe_open(_open(out))
    if exclude_labels:
        rows = remove_labels(rows, exclude_labels)
    if min_counts:
        cells = rows.select("source", "target", "label").distinct()
        known = cells.groupBy("label").count().where(F.col("count") >= min_counts).select(F.col("label").alias("l_label"))
        rows = rows.join(known, F.col("label").eqNullSafe(F.col("l_label")), "left_semi")
    return _close(_merge_open(rows) if merge else rows)


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; in the result's order the frames follow each other.

    Orders are numbers or arrays of numbers, or of one type throughout; otherwise
    the result has none.
    """
    kinds = {dict(f.dtypes).get(ORDER) for f in frames}
    if kinds <= {"bigint", "array<bigint>"}:
        place = lambda f, k: F.concat(F.array(F.lit(k).cast("long")), F.col(ORDER) if dict(f.dtypes)[ORDER] != "bigint" else F.array(ORDER))
    elif len(kinds) == 1 and None not in kinds:
        place = lambda f, k: F.struct(F.lit(k).alias("frame"), F.col(ORDER).alias("row"))
    else:
        return reduce(DataFrame.unionByName, [f.drop(ORDER) for f in frames])
    return reduce(DataFrame.unionByName, [f.withColumn(ORDER, place(f, k)) for k, f in enumerate(frames)])


def remove_common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a alone, of b alone, and the common edges' rows of both."""
    ends = ["source", "target"]
    mine, other = a.select(*ends).distinct(), b.select(*ends).distinct()
    common = concat([a.join(other, ends, "left_semi"), b.join(mine, ends, "left_semi")])
    return a.join(other, ends, "left_anti"), b.join(mine, ends, "left_anti"), common


def pairs_and_labels(df: DataFrame) -> DataFrame:
    """pair, labels: what a learner reads of an edge table."""
    return df.select(F.array("source", "target").alias("pair"), T.split_cell(F.col("label")).alias("labels"))
