"""Raw table to model-ready table as one chain of DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean
from ..operators.joins import left_outcomes


def combine(screening: DataFrame, outcomes: DataFrame, key: str = "Episode", label: str = "Definitive Diagnosis") -> DataFrame:
    return clean.fill_label_default(left_outcomes(screening, outcomes, key), label)


def prepare(raw: DataFrame, narrow: bool = True, corrected_sex: bool = False) -> DataFrame:
    """Rename, clean, drop, derive, encode; only the narrowing runs a job."""
    out = (
        raw.transform(clean.map_names)
        .transform(clean.clean_values)
        .transform(clean.drop_inconsistent_labels)
        .transform(clean.drop_incomplete)
        .transform(clean.derive_columns)
        .transform(lambda d: clean.one_hot(d, corrected=corrected_sex))
    )
    return clean.narrow_integers(out) if narrow else out
