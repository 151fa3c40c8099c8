"""Readiness report: chosen metrics of one table as one tidy table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import ref
from .operators import (
    anonymity,
    association,
    fairness,
    imbalance,
    metadata,
    noise,
    profile,
    quality,
    reidentification,
    relevance,
)
from .plans.sizing import settled

DECIMALS = 2


def _noise(df: DataFrame, columns, **options) -> DataFrame:
    """Statistics of one draw of noise; the noisy rows are written once, then measured."""
    return noise.noise_statistics(settled(noise.add_laplace_noise(df, columns, **options)), columns)


# metric name -> dimension, function, columns that name the subject of a row
METRICS: dict[str, tuple[str, Callable[..., DataFrame], tuple[str, ...]]] = {
    "summary_statistics": ("profile", profile.summary_statistics, ("column",)),
    "class_candidates": ("profile", profile.class_candidates, ("column",)),
    "density": ("profile", profile.density, ("column", "point")),
    "completeness": ("quality", quality.completeness_by_column, ("column",)),
    "overall_completeness": ("quality", quality.overall_completeness, ()),
    "duplicity": ("quality", quality.duplicity, ()),
    "outliers": ("quality", quality.outlier_rates, ("column",)),
    "overall_outliers": ("quality", quality.outlier_score, ()),
    "correlations": ("impact", association.correlations, ("col_a", "col_b")),
    "feature_relevance": ("impact", relevance.feature_relevance, ("feature",)),
    "independence": ("impact", relevance.chi_square_independence, ("feature",)),
    "class_distribution": ("fairness", imbalance.class_distribution, ("class",)),
    "imbalance_degree": ("fairness", imbalance.imbalance_degree, ("column", "metric")),
    "representation_rates": (
        "fairness", fairness.representation_rates, ("column", "value_a", "value_b"),
    ),
    "statistical_rates": ("fairness", fairness.statistical_rates, ("group", "class")),
    "rate_deviation": ("fairness", fairness.rate_deviation, ("class",)),
    "demographic_disparity": ("fairness", fairness.demographic_disparity, ("group",)),
    "k_anonymity": ("privacy", anonymity.k_anonymity, ()),
    "l_diversity": ("privacy", anonymity.l_diversity, ()),
    "t_closeness": ("privacy", anonymity.t_closeness, ()),
    "entropy_risk": ("privacy", anonymity.entropy_risk, ()),
    "attribute_risk": ("privacy", reidentification.attribute_risk_statistics, ("qi",)),
    "combination_risk": ("privacy", reidentification.combination_risk_statistics, ()),
    "noise": ("privacy", _noise, ("column",)),
    "fair_dcat": ("metadata", metadata.dcat_scores, ("doc_id", "principle")),
    "fair_datacite": ("metadata", metadata.datacite_scores, ("doc_id", "principle")),
}


def readiness_report(df: DataFrame, metrics: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``(dimension, metric, subject, key, value, text)``, numbers to two decimals.

    ``metrics`` names the metrics to run and their arguments, for example
    ``{"duplicity": {}, "k_anonymity": {"quasi_identifiers": ["age", "sex"]}}``.
    Each metric reads ``df`` on its own: persist it first if it is expensive. The FAIR metrics
    score a table of documents ``(doc_id, doc)``, each of which is a subject.
    """
    if not metrics:
        raise ValueError("no metric chosen")
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metric {', '.join(unknown)}; known are {', '.join(METRICS)}")
    report = None
    for name, arguments in metrics.items():
        dimension, compute, subject = METRICS[name]
        part = tidy(compute(df, **arguments), dimension, name, subject)
        report = part if report is None else report.unionByName(part)
    return report


def tidy(
    frame: DataFrame, dimension: str, metric: str, subject: tuple[str, ...] = ()
) -> DataFrame:
    """A metric table in long form: one row per subject and measured column.

    Numbers and truth values (as 1 and 0) go to ``value``, the rest to ``text``.
    """
    measured = []
    for field in frame.schema.fields:
        if field.name in subject:
            continue
        is_number = isinstance(field.dataType, (T.NumericType, T.BooleanType))
        number = ref(field.name).cast("double") if is_number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_number else ref(field.name).cast("string")
        measured.append(
            F.struct(
                F.lit(field.name).alias("key"),
                F.round(number, DECIMALS).alias("value"),
                text.alias("text"),
            )
        )
    name = F.concat_ws(" | ", *[ref(c).cast("string") for c in subject]) if subject else F.lit("")
    return frame.select(
        F.lit(dimension).alias("dimension"),
        F.lit(metric).alias("metric"),
        name.alias("subject"),
        F.inline(F.array(*measured)),
    )
