"""String helpers for labels and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def title_case(c: Column) -> Column:
    """``false_neg`` -> ``False Neg``; TSH, FPR and FNR stay upper case."""
    out = F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))
    for word in ("Tsh", "tsh", "Fpr", "Fnr"):
        out = F.replace(out, F.lit(word), F.lit(word.upper()))
    return out


def prefix_match(c: Column, pattern: str) -> Column:
    """Match anchored at the start of the text only."""
    return c.rlike(f"^(?:{pattern})")


def outcome_label(predicted: Column, actual: Column) -> Column:
    return (
        F.when((predicted == 1) & (actual == 1), F.lit("True Positive"))
        .when((predicted == 1) & (actual == 0), F.lit("False Positive"))
        .when((predicted == 0) & (actual == 1), F.lit("False Negative"))
        .when((predicted == 0) & (actual == 0), F.lit("True Negative"))
    )


def combination_display_name(*cols: Column) -> Column:
    return F.concat_ws("\n", *cols)


def splitter_name(kind: str | None, n_splits: int = 5, n_repeats: int = 1) -> str:
    """Stored name of a fold assignment."""
    if kind is None:
        return "none"
    if kind == "RepeatedStratifiedKFold":
        return f"{kind}_{n_repeats}x{n_splits}"
    return f"{kind}_{n_splits}"
