"""Classification metrics, each in one pass with constant-size results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyweft.config import ABLATION_SCENARIOS, ClusterConfig, Scenario
from skyweft.functions.photometry import membership_criterion


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _or_zero(F.lit(2.0) * precision * recall, precision + recall)


def confusion_counts(labelled: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row ``tn, fp, fn, tp``; a class that does not occur counts zero."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return labelled.agg(
        *[F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(n) for n, (t, p) in cells.items()]
    )


def headline_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; an empty denominator gives zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _or_zero(tp, tp + fp), _or_zero(tp, tp + fn)
    return confusion.select(
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        _or_zero(tp + tn, tn + fp + fn + tp).alias("accuracy"),
    )


def class_report(confusion: DataFrame, negative: str = "non-member", positive: str = "member") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(hit: Column, false_alarm: Column, missed: Column) -> list[Column]:
        precision, recall = _or_zero(hit, hit + false_alarm), _or_zero(hit, hit + missed)
        return [precision, recall, _f1(precision, recall), hit + missed]

    first, second = line(tn, fn, fp), line(tp, fp, fn)
    total = first[3] + second[3]
    macro = [(a + b) / F.lit(2.0) for a, b in zip(first[:3], second[:3])]
    weighted = [_or_zero(a * first[3] + b * second[3], total) for a, b in zip(first[:3], second[:3])]
    names = ("precision", "recall", "f1", "support")
    rows = [
        F.struct(F.lit(label).alias("label"), *[c.alias(n) for n, c in zip(names, values)])
        for label, values in (
            (negative, first), (positive, second), ("macro avg", [*macro, total]), ("weighted avg", [*weighted, total])
        )
    ]
    return confusion.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ablation_grid(
    labelled: DataFrame,
    *,
    parallax: str = "gaia_parallax",
    pmra: str = "gaia_pmra",
    pmdec: str = "gaia_pmdec",
    truth: str = "y_true",
    scenarios: Sequence[Scenario] = ABLATION_SCENARIOS,
    cluster: ClusterConfig = ClusterConfig(),
    digits: int | None = 3,
) -> DataFrame:
    """Precision, recall, F1 and predicted members of every scenario.

    All scenarios are counted side by side in a single pass over the rows; only
    the one-row result is turned into one row per scenario.
    """
    is_true = F.col(truth) == 1
    counts = [F.count_if(is_true).alias("positives")]
    for i, scenario in enumerate(scenarios):
        chosen = membership_criterion(F.col(parallax), F.col(pmra), F.col(pmdec), scenario, cluster)
        counts += [F.count_if(chosen).alias(f"n_{i}"), F.count_if(chosen & is_true).alias(f"hit_{i}")]
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(s.name).alias("criterion"),
            F.col(f"n_{i}").alias("n_pred"), F.col(f"hit_{i}").alias("hits"),
        )
        for i, s in enumerate(scenarios)
    ]
    grid = labelled.agg(*counts).select("positives", F.explode(F.array(*rows)).alias("r")).select("positives", "r.*")
    precision, recall = _or_zero(F.col("hits"), F.col("n_pred")), _or_zero(F.col("hits"), F.col("positives"))
    metrics = {"precision": precision, "recall": recall, "f1": _f1(precision, recall)}
    return grid.select(
        "ordinal",
        "criterion",
        *[(c if digits is None else F.bround(c, digits)).alias(name) for name, c in metrics.items()],
        "n_pred",
    )


def best_scenario(grid: DataFrame) -> DataFrame:
    """First scenario with the largest F1."""
    return grid.orderBy(F.col("f1").desc(), F.col("ordinal")).limit(1).select("criterion", "f1")
