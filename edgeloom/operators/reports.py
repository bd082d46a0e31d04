"""Summaries of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def label_vocabulary(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels."""
    return df.select(F.explode(T.split_cell(F.col(label))).alias("label")).distinct().orderBy("label")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n; rows without labels are skipped."""
    return df.select(F.explode(T.split_cell(F.col(label))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def probability_columns(df: DataFrame, suffix: str = "-pr") -> list[str]:
    """Columns of label probabilities, without the sums and maxima made from them."""
    return [c for c in df.columns if c.endswith(suffix) and c not in (f"sum{suffix}", f"max{suffix}")]


def summarise_probabilities(df: DataFrame, labels: list[str], at: float = 0.5, suffix: str = "-pr") -> DataFrame:
    """sum-pr, max-pr, classification (labels at or above `at`, null if none) and classification_at_max."""
    pr = {x: F.col(f"`{x}{suffix}`") for x in labels}
    best = F.greatest(*pr.values()) if len(pr) > 1 else next(iter(pr.values()))
    total = F.lit(0.0)
    first: Column | None = None
    for p in pr.values():
        total = total + p
    for x, p in pr.items():
        first = F.when(p == best, x) if first is None else first.when(p == best, x)
    chosen = F.array_compact(F.array(*[F.when(p >= at, F.lit(x)) for x, p in pr.items()]))
    return df.withColumns({f"sum{suffix}": total, f"max{suffix}": best, "classification": T.join_or_null(chosen), "classification_at_max": first})


def threshold_curve(df: DataFrame, column: str, steps: int = 20) -> DataFrame:
    """threshold (0 to 1), share of rows at or above it; one pass, no join."""
    cuts = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(column) >= k / steps).alias(f"c{k}") for k in range(steps + 1)])
    pairs = F.arrays_zip(cuts.alias("t"), F.array(*[F.col(f"c{k}") for k in range(steps + 1)]).alias("c"))
    each = counts.select("n", F.explode(pairs).alias("x"))
    return each.select(F.col("x.t").alias("threshold"), F.when(F.col("n") > 0, F.col("x.c") / F.col("n")).alias("share"))


def dataset_statistics(df: DataFrame, seen: str, max_pr: str, usability: str, at: float = 0.5) -> DataFrame:
    """Rows, rows seen in training or holdout, rows classified, usable rows, and their shares."""
    n = F.count("*")
    part = {"seen": F.count_if(F.col(seen)), "classified": F.count_if(F.col(max_pr) >= at), "usable": F.count_if(F.col(usability) >= at)}
    return df.agg(n.alias("n"), *[c.alias(f"n_{k}") for k, c in part.items()], *[F.when(n > 0, c / n).alias(f"share_{k}") for k, c in part.items()])


def label_features(df: DataFrame, label: str, term: str) -> DataFrame:
    """Distinct (label, term) of positives."""
    return df.select(F.col(label).alias("label"), F.col(term).alias("term")).where("label is not null and term is not null").distinct()


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_a, label_b, jaccard, dice of the term sets of every pair of labels.

    Term sets meet by their terms; pairs without a common term have similarity 0. Labels
    are a small vocabulary, so b's fit the driver.
    """
    na = a.groupBy("label").agg(F.count("*").alias("size_a")).withColumnRenamed("label", "label_a")
    sizes = sorted((r[0], r[1]) for r in b.groupBy("label").count().collect())
    both = a.withColumnRenamed("label", "label_a").join(b.withColumnRenamed("label", "label_b"), "term").groupBy("label_a", "label_b").agg(F.count("*").alias("common"))
    both = both.select(F.col("label_a").alias("c_a"), F.col("label_b").alias("c_b"), F.col("common").alias("c_n"))
    cells = F.array(*[F.struct(F.lit(x).alias("label_b"), F.lit(n).alias("size_b")) for x, n in sizes]).cast("array<struct<label_b:string,size_b:bigint>>")
    every = na.select("label_a", "size_a", F.inline(cells)).join(both, (F.col("label_a") == F.col("c_a")) & (F.col("label_b") == F.col("c_b")), "left")
    out = every.withColumn("common", F.coalesce("c_n", F.lit(0)))
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return out.select("label_a", "label_b", (F.col("common") / union).alias("jaccard"), (2 * F.col("common") / (F.col("size_a") + F.col("size_b"))).alias("dice"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho for all pairs of 0/1 columns; null for constant columns.

    Ranks of a two-valued column are a linear map of it, so the product moment of the
    values is the rank correlation: one aggregate instead of a sort per column.
    """
    names = sorted(columns)
    sums = df.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in names], *[F.sum((F.col(a) * F.col(b)).cast("double")).alias(f"p_{a}_{b}") for a in names for b in names])

    def rho(a: str, b: str) -> Column:
        n, sa, sb, sab = F.col("n"), F.col(f"s_{a}"), F.col(f"s_{b}"), F.col(f"p_{a}_{b}")
        under = F.sqrt((n * sa - sa * sa) * (n * sb - sb * sb))
        return F.when(under > 0, (n * sab - sa * sb) / under)

    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(a, b).alias("rho")) for a in names for b in names])
    return sums.select(F.explode(cells).alias("x")).select("x.*")


def fold_summary(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean over folds and population deviation over the square root of their number."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("error"))


def bootstrap_summary(scores: DataFrame, by: list[str], bootstrap: str = "bootstrap", value: str = "value") -> DataFrame:
    """Folds averaged within each bootstrap; then mean and sample deviation over the square root of their number."""
    inner = scores.groupBy(*by, bootstrap).agg(F.avg(value).alias("v"))
    return inner.groupBy(*by).agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("error"))
