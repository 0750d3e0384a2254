"""Light-curve normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyweft.operators.ranked import exact_quantiles
from skyweft.operators.skew import salted_join, split_keys
from skyweft.session import cut_lineage

HOT_ROWS = 500_000


def relative_flux(
    lightcurve: DataFrame, *, target: str = "target_id", time: str = "time", flux: str = "flux"
) -> DataFrame:
    """Flux of each target divided by its median, without missing values.

    A target with a very long light curve is split over several tasks. The table
    is read twice: for medians and lengths, and for the division.
    """
    medians = cut_lineage(exact_quantiles(lightcurve, flux, {"_median": 0.5}, by=[target], count_as="_length"))
    hot = split_keys(medians, [target], "_length", HOT_ROWS)
    present = lightcurve.filter(F.col(flux).isNotNull() & ~F.isnan(flux))
    joined = salted_join(present, medians.drop("_length"), [target], time, hot=hot)
    relative = F.try_divide(F.col(flux), F.col("_median"))
    return joined.withColumn(flux, relative).filter(F.col(flux).isNotNull()).select(*lightcurve.columns)
