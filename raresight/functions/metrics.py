"""Confusion counts and every rate derived from them, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import safe_divide

COUNTS = ("true_positives", "false_positives", "false_negatives", "true_negatives")


def confusion_aggregates(actual: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Five aggregate Columns; ``weight`` lets pre-counted rows take part."""

    def count(cond: Column, name: str) -> Column:
        agg = F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))
        return agg.cast("bigint").alias(name)

    total = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return [
        count((actual == 1) & (predicted == 1), "true_positives"),
        count((actual == 0) & (predicted == 1), "false_positives"),
        count((actual == 1) & (predicted == 0), "false_negatives"),
        count((actual == 0) & (predicted == 0), "true_negatives"),
        total.cast("bigint").alias("total_predictions"),
    ]


def confusion_counts(df: DataFrame, by=(), actual="actual", predicted="predicted") -> DataFrame:
    return df.groupBy(*by).agg(*confusion_aggregates(F.col(actual), F.col(predicted)))


def fbeta(tp, fp, fn, beta: float) -> Column:
    b2 = float(beta * beta)
    return safe_divide(tp * (1 + b2), tp * (1 + b2) + fn * b2 + fp)


def fp_fn_clipped(tp, fp, fn, tn, fp_weight: float = 1.0, fn_weight: float = 1.0, eps: float = 1e-8) -> Column:
    """Search score: inverse of the weighted error rates, both floored at eps."""
    fpr = F.greatest(safe_divide(fp, fp + tn), F.lit(eps)) * F.lit(fp_weight)
    fnr = F.greatest(safe_divide(fn, tp + fn), F.lit(eps)) * F.lit(fn_weight)
    return F.lit(1.0) / (fpr + fnr)


def rates(tp="true_positives", fp="false_positives", fn="false_negatives", tn="true_negatives") -> dict[str, Column]:
    """All report metrics over count columns; a zero divisor gives 0."""
    tp, fp, fn, tn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn, tn))
    pos, neg = tp + fn, tn + fp
    fnr, fpr = safe_divide(fn, pos), safe_divide(fp, neg)
    return {
        "f1": safe_divide(tp * 2, tp * 2 + fp + fn),
        "fnr": fnr,
        "fpr": fpr,
        "fp_fn": safe_divide(F.lit(1.0), fpr + fnr, 100.0),
        "tpr": safe_divide(tp, pos),
        "tnr": safe_divide(tn, neg),
        "accuracy": safe_divide(tp + tn, pos + neg),
        "sensitivity": safe_divide(tp, pos),
        "specificity": safe_divide(tn, neg),
        "ppv": safe_divide(tp, tp + fp),
        "npv": safe_divide(tn, tn + fn),
        "actual_positives": pos,
        "actual_negatives": neg,
    }


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rates())


def scorers(tp="true_positives", fp="false_positives", fn="false_negatives", tn="true_negatives") -> dict[str, Column]:
    """Named search scorers."""
    tp, fp, fn, tn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn, tn))
    f1_pos, f1_neg = fbeta(tp, fp, fn, 1), fbeta(tn, fn, fp, 1)
    return {
        "fp_fn": fp_fn_clipped(tp, fp, fn, tn),
        "recall_score": safe_divide(tp, tp + fn),
        "f1_score_pos": f1_pos,
        "f2_score_pos": fbeta(tp, fp, fn, 2),
        "f4_score_pos": fbeta(tp, fp, fn, 4),
        "f10_score_pos": fbeta(tp, fp, fn, 10),
        "f1_score_neg": f1_neg,
        "f1_score_macro": (f1_pos + f1_neg) / F.lit(2.0),
        "accuracy": safe_divide(tp + tn, tp + fp + fn + tn),
    }


def classification_metrics(df: DataFrame, by) -> DataFrame:
    return with_rates(confusion_counts(df, by))
