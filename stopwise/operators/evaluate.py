"""Scores of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.numbering import running_sums


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("baseline"))


def accuracy_lift(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, majority baseline of a 0/1 label, and the difference in percent."""
    share = F.avg(F.col(label).cast("int"))
    row = rows.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"), F.greatest(share, 1 - share).alias("baseline"))
    return row.withColumn("lift_percent", (F.col("accuracy") - F.col("baseline")) * 100)


def confusion_matrix(rows: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    counts = rows.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1)))
    return counts.fillna(0, subset=[str(c) for c in classes]).withColumnsRenamed({str(c): f"predicted_{c}" for c in classes})


def multilabel_counts(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """tn, fp, fn, tp and both class accuracies for several 0/1 labels, from one pass."""
    measures = []
    for name, (label, prediction) in pairs.items():
        y, p = F.col(label) == 1, F.col(prediction) == 1
        count = lambda c: F.count(F.when(c, 1))
        measures.append(F.struct(F.lit(name).alias("label"), count(~y & ~p).alias("tn"), count(~y & p).alias("fp"),
                                 count(y & ~p).alias("fn"), count(y & p).alias("tp")).alias(f"_{name}"))
    rows = rows.agg(*measures).select(F.inline(F.array(*[F.col(f"_{n}") for n in pairs])))
    zero = F.lit(0)
    return rows.withColumns({"acc1": F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), zero),
                             "acc2": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero)})


def classification_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    both = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_true"), F.lit(0).alias("is_predicted")),
                   F.struct(F.col(prediction).alias("class"), F.lit(0).alias("is_true"), F.lit(1).alias("is_predicted")))
    counts = rows.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.select("n", (F.col(label) == F.col(prediction)).alias("hit"), F.inline(both))
    sums = cells.groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("is_true")).otherwise(0)).alias("_tp"),
        F.sum(F.col("n") * F.col("is_true")).alias("support"), F.sum(F.col("n") * F.col("is_predicted")).alias("_predicted"))
    zero = F.lit(0)
    scored = sums.withColumns({"precision": F.col("_tp") / F.nullif("_predicted", zero), "recall": F.col("_tp") / F.nullif("support", zero)})
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return scored.select("class", "precision", "recall", f1.alias("f1"), "support")


def roc_points(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Cumulative false and true positive rates by falling score; equal scores make one point.

    ``area`` is the part of the area under the curve gained at this point.
    """
    positive = F.sum(F.col(label).cast("bigint"))
    per_score = rows.groupBy(score).agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))
    summed = running_sums(per_score, [F.col(score).desc()], {"_tp": F.col("pos"), "_fp": F.col("neg")})
    total = per_score.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    tpr, fpr = F.col("_tp") / total["p"], F.col("_fp") / total["n"]
    area = F.col("neg") / total["n"] * (2 * F.col("_tp") - F.col("pos")) / total["p"] / 2
    return summed.select(F.col(score), fpr.alias("fpr"), tpr.alias("tpr"), area.alias("area"))


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    return roc_points(rows, score, label).agg(F.sum("area").alias("auc"))


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line through (x, y)."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def score_vs_actual(rows: DataFrame, score: str, planned: str, real: str, minutes: int = 5, limit: int = 60) -> DataFrame:
    """Trend of the real transfer time over the score, for transfers planned with ``minutes``."""
    chosen = rows.filter((F.col(planned) == minutes) & (F.col(real) < limit) & (F.col(real) > -limit))
    return trend(chosen, score, real)
