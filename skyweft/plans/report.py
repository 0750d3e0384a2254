"""Markdown validation report from a handful of collected one-row results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skyweft.config import FieldConfig
from skyweft.functions.photometry import discrimination_band
from skyweft.operators import metrics, ranked
from skyweft.operators.members import match_members
from skyweft.plans.validation import labelled_matches, match_rate
from skyweft.session import cut_lineage


@dataclass(frozen=True)
class ValidationResults:
    """The numbers a report shows; every one is a single value or a short table."""

    date: str
    rate: Mapping
    confusion: Mapping
    headline: Mapping
    auc: float | None
    band: str
    ablation: Sequence[Mapping]


def collect_results(matches: DataFrame, members: DataFrame) -> ValidationResults:
    """Run the validation queries; at most eight rows per query come to the driver."""
    ours = cut_lineage(matches)
    labelled = cut_lineage(labelled_matches(ours, members))
    confusion = metrics.confusion_counts(labelled)
    auc = ranked.roc_auc(labelled, "membership_score", "y_true")
    auc_row = auc.select(
        "roc_auc", discrimination_band(F.col("roc_auc")).alias("band"),
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("date"),
    ).first()
    return ValidationResults(
        date=auc_row["date"],
        rate=match_rate(match_members(members, ours)).first().asDict(),
        confusion=confusion.first().asDict(),
        headline=metrics.headline_metrics(confusion).first().asDict(),
        auc=auc_row["roc_auc"],
        band=auc_row["band"],
        ablation=[r.asDict() for r in metrics.ablation_grid(labelled).orderBy("ordinal").collect()],
    )


def _table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    lines = [header, ["---"] * len(header), *rows]
    return ["| " + " | ".join(str(cell) for cell in line) + " |" for line in lines]


def _share(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.3f}"


def render_report(results: ValidationResults, field: FieldConfig, field_name: str, list_name: str) -> str:
    """The report as markdown text."""
    c, h, rate = results.confusion, results.headline, results.rate
    universe = c["tn"] + c["fp"] + c["fn"] + c["tp"]
    percent = rate["matched_percent"]
    lines = [
        "# Cross-match validation",
        "",
        f"- Date: {results.date}",
        f"- Field: {field_name} (RA {field.ra} deg, Dec {field.dec} deg, radius {field.radius} deg)",
        f"- Member list: {list_name}",
        f"- Sources compared: {universe}, present in both catalogs",
        "",
        "## Metrics",
        "",
        *_table(
            ("metric", "value"),
            [(n, _share(h[n])) for n in ("precision", "recall", "f1", "accuracy")]
            + [("ROC-AUC", f"{_share(results.auc)} ({results.band})")],
        ),
        "",
        "## Confusion matrix",
        "",
        *_table(
            ("", "predicted non-member", "predicted member"),
            [("true non-member", f"{c['tn']} (TN)", f"{c['fp']} (FP)"), ("true member", f"{c['fn']} (FN)", f"{c['tp']} (TP)")],
        ),
        "",
        "## Ablation",
        "",
        *_table(
            ("criterion", "precision", "recall", "F1", "predicted members"),
            [(r["criterion"], _share(r["precision"]), _share(r["recall"]), _share(r["f1"]), r["n_pred"]) for r in results.ablation],
        ),
        "",
        "## Coverage",
        "",
        f"{rate['n_matched']} of {rate['n_members']} listed members"
        f" ({'n/a' if percent is None else f'{percent:.1f}%'}) have a counterpart among the matches.",
        "",
    ]
    return "\n".join(lines)
