"""Bootstrapped cross-validation and label similarity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..ml import folds, metrics, models
from ..operators import reports
from ..plans.build import TEST_LABELS
from ..sources import files


def bootstraps(rows: DataFrame, labels: list[str], make=None, n_iter: int = 3, n_splits: int = 5, seed: int = 0, search: int = 30, holdout: DataFrame | None = None, chosen: list | None = None) -> DataFrame:
    """condition, bootstrap, fold, label, metric, value over seeded stratified folds.

    Each fold's model is fitted on its complement: make() where given, else the published
    ensemble with `search` draws of its parameters over three inner folds. It is scored on the
    fold (validation) and on holdout's rows (holdout). chosen collects (bootstrap, fold, label,
    score, parameters) of the searches.
    """
    keyed, out = rows.withColumn("edge", F.concat_ws("|", "source", "target")), None
    for k in range(n_iter):
        dealt = folds.stratified_folds(keyed, "labels", "edge", n_splits, seed + k)
        for fold in range(n_splits):
            train, test = dealt.where(F.col("fold") != fold).drop("fold"), dealt.where(F.col("fold") == fold)
            if make:
                vectors = models.both_vectors(train, "text")
                fitted = models.Classifier(vectors, make().fit(vectors.transform(train)), [])
            else:
                fitted, picks = models.searched(train, labels, [], n_iter=search, seed=seed + k)
                if chosen is not None:
                    chosen += [(k, fold, *pick) for pick in picks]
            for condition, df in (("validation", test), ("holdout", holdout)):
                if df is not None:
                    guess = fitted.predict_proba(df).withColumns({f"p_{x}": (F.col(f"`{x}-pr`") >= 0.5).cast("int") for x in labels})
                    scores = metrics.score_labels(guess, labels).withColumns({"condition": F.lit(condition), "bootstrap": F.lit(k), "fold": F.lit(fold)})
                    out = scores if out is None else out.unionByName(scores)
    return out


def summary(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(binary statistics per condition, label and metric, macro statistics per condition and metric)."""
    macro = scores.groupBy("condition", "metric", "bootstrap", "fold").agg(F.avg("value").alias("value"))
    return reports.bootstrap_summary(scores, ["condition", "label", "metric"]), reports.bootstrap_summary(macro, ["condition", "metric"])


def similarities(training: DataFrame, holdout: DataFrame, labels: list[str]) -> dict[str, DataFrame]:
    """Train x train and holdout x train label similarities and label rank correlations."""

    def sets(df: DataFrame) -> DataFrame:
        each = df.select(F.explode("labels").alias("label"), T.split_cell(F.col("text")).alias("terms"))
        return reports.label_features(each.select("label", F.explode("terms").alias("term")), "label", "term")

    train = sets(training)
    return {"train": reports.similarity(train, train), "holdout": reports.similarity(sets(holdout), train), "spearman": reports.spearman(training, [f"y_{x}" for x in labels])}


def write_reports(training: DataFrame, holdout: DataFrame, labels: list[str], scores: DataFrame, chosen: list, path: str) -> None:
    """All validation reports below path: statistics, label order, similarity matrices in long
    form, F1 by label, what the searches chose, class distributions."""
    spark = training.sparkSession
    scores = scores.persist()
    binary, multi = summary(scores)
    files.write_report(binary, f"{path}/binary_stats.csv", "csv")
    files.write_report(multi, f"{path}/multilabel_stats.csv", "csv")
    order = spark.createDataFrame([(k, x) for k, x in enumerate(sorted(labels))], "place int, label string")
    files.write_report(order.coalesce(1), f"{path}/label_order.csv", "csv")
    for name, df in similarities(training, holdout, labels).items():
        files.write_report(df, f"{path}/similarity_{name}.csv", "csv")
    f1 = binary.where("metric = 'f1' and condition = 'validation'").select("label", "mean", "error")
    held = binary.where((F.col("metric") == "f1") & (F.col("condition") == "holdout") & F.col("label").isin(*TEST_LABELS)).select(F.concat("label", F.lit(" (holdout)")).alias("label"), "mean", "error")
    macro = multi.where("condition = 'validation'").select(F.concat(F.lit("macro "), "metric").alias("label"), "mean", "error")
    files.write_report(f1.unionByName(held).unionByName(macro).coalesce(1).sortWithinPartitions("label"), f"{path}/results_f1_ml.tsv")
    lines = [(k, f"bootstrap {b} fold {f} label {x}: {score} {params}") for k, (b, f, x, score, params) in enumerate(chosen)]
    spark.createDataFrame(lines, "place int, value string").coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(f"{path}/stability.txt")
    for name, df in (("training", training), ("testing", holdout)):
        counts = df.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).unionByName(df.agg(F.lit("n_samples").alias("label"), F.count("*").alias("n")))
        files.write_report(counts, f"{path}/{name}_distribution.json", "json")
    scores.unpersist()
