"""Exact global order statistics without sorting everything in one task.

A running sum over one global order would put the whole table into a single
window. Here equal values are first merged (map side) and written once, the merged
values are dealt into ranges of a fixed size, each range has its own window, and
a table of range totals supplies the offsets. The number of ranges grows with the
data, their size does not; where the cuts fall only affects balance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.session import cut_lineage

BUCKET_ROWS = 500_000


def _bucketed(df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str], bucket_rows: int) -> DataFrame:
    """Merge equal values and deal them into ranges of about ``bucket_rows`` distinct values.

    The dealt table is written out too, because a range partitioning that is
    computed twice may cut at different values.
    """
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    merged = cut_lineage(present.groupBy(*by, value).agg(*[c.alias(name) for name, c in sums.items()]))
    buckets = -(-merged.count() // bucket_rows)
    if buckets <= 1:
        return merged.withColumn("_bucket", F.lit(0))
    return cut_lineage(merged.repartitionByRange(buckets, *by, value).withColumn("_bucket", F.spark_partition_id()))


def _offsets(bucketed: DataFrame, sums: Sequence[str], value: str, by: Sequence[str], descending: bool) -> DataFrame:
    """Per bucket: sums before it, sums over the whole group, and the next bucket's first row."""
    first = F.max_by if descending else F.min_by
    totals = bucketed.groupBy(*by, "_bucket").agg(
        *[F.sum(s).alias(s) for s in sums], first(F.struct(*sums), F.col(value)).alias("_head")
    )
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = window.orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.col(s).alias(f"_within_{s}") for s in sums],
        *[F.sum(s).over(window).alias(f"{s}_total") for s in sums],
        F.lead("_head").over(ordered).alias("_next_head"),
    )


def cumulative(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per distinct value with running sums in value order.

    ``sums`` names aggregate columns. For each name ``s`` the result has ``s``
    (sum at this value), ``s_upto`` (running, inclusive), ``s_total`` and
    ``s_next`` (sum at the following value, NULL at the end).
    """
    names = list(sums)
    bucketed = _bucketed(df, value, sums, by, bucket_rows)
    offsets = _offsets(bucketed, names, value, by, descending)
    joined = bucketed.join(offsets, [*by, "_bucket"])
    order = F.col(value).desc() if descending else F.col(value).asc()
    ordered = Window.partitionBy(*by, "_bucket").orderBy(order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *by,
        value,
        *names,
        *[(F.col(f"_before_{s}") + F.sum(s).over(running)).alias(f"{s}_upto") for s in names],
        *[F.col(f"{s}_total") for s in names],
        *[F.coalesce(F.lead(s).over(ordered), F.col("_next_head").getField(s)).alias(f"{s}_next") for s in names],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], *, by: Sequence[str] = (),
    count_as: str | None = None, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group; missing values are left out.

    With ``count_as`` the number of present values comes as a column of that name.
    Only the buckets that hold a wanted rank are ordered at all.
    """
    bucketed = _bucketed(df, value, {"_n": F.count(F.lit(1))}, by, bucket_rows)
    offsets = _offsets(bucketed, ["_n"], value, by, False)
    start, end = F.col("_before__n"), F.col("_before__n") + F.col("_within__n")

    def position(p: float) -> Column:
        return (F.col("_n_total") - 1) * F.lit(float(p))

    def holds(rank: Column, low: Column, high: Column) -> Column:
        return (rank >= low) & (rank < high)

    wanted = F.lit(False)
    for p in probabilities.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | holds(rank, start, end)
    needed = offsets.filter(wanted)
    running = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = bucketed.join(needed, [*by, "_bucket"]).withColumn("_upto", start + F.sum("_n").over(running))
    below = F.col("_upto") - F.col("_n")
    at = {}
    for name, p in probabilities.items():
        at[f"_low_{name}"] = F.max(F.when(holds(F.floor(position(p)), below, F.col("_upto")), F.col(value)))
        at[f"_high_{name}"] = F.max(F.when(holds(F.ceil(position(p)), below, F.col("_upto")), F.col(value)))
    picked = ranked.groupBy(*by).agg(
        F.max("_n_total").alias("_n_total"), *[c.alias(name) for name, c in at.items()]
    )
    interpolated = []
    for name, p in probabilities.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        fraction = position(p) - F.floor(position(p))
        interpolated.append((low + (high - low) * fraction).alias(name))
    counted = [F.col("_n_total").alias(count_as)] if count_as else []
    return picked.select(*by, *interpolated, *counted)


def describe(df: DataFrame, value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles and maximum in one row."""
    quantiles = exact_quantiles(df, value, probabilities).select(F.struct(*probabilities)).scalar()
    present = df.select(F.when(~F.isnan(value), F.col(value)).alias(value))
    basic = present.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basic.select(
        "count", "mean", "std", "min", *[quantiles.getField(p).alias(p) for p in probabilities], "max"
    )


def _label_sums(label: str) -> dict[str, Column]:
    positive = F.col(label) == 1
    return {"pos": F.count_if(positive), "neg": F.count_if(~positive)}


def roc_curve(df: DataFrame, score: str, label: str, *, drop_collinear: bool = True) -> DataFrame:
    """ROC points from (0, 0) on, by descending score threshold.

    With ``drop_collinear`` points on a straight line between their neighbours
    are left out; the curve is the same.
    """
    points = cumulative(df, score, _label_sums(label), descending=True)
    if drop_collinear:
        is_first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
        bends = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
        points = points.filter(is_first | F.coalesce(bends, F.lit(True)))
    curve = points.select(
        F.col(score).alias("threshold"),
        F.try_divide("neg_upto", "neg_total").alias("fpr"),
        F.try_divide("pos_upto", "pos_total").alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve: pairs ordered rightly, ties counting one half."""
    points = cumulative(df, score, _label_sums(label), descending=True)
    lower = F.col("neg_total") - F.col("neg_upto") + F.col("neg") / F.lit(2.0)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return points.agg(F.try_divide(F.sum(F.col("pos") * lower), pairs).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall per distinct threshold, ending at recall 0, precision 1."""
    points = cumulative(df, score, _label_sums(label), descending=True).select(
        F.col(score).alias("threshold"),
        (F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("precision"),
        F.try_divide("pos_upto", "pos_total").alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)
