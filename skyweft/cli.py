"""Command line: the quick cross-match of one field over landed catalogs."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from skyweft.config import FieldConfig
from skyweft.operators.histogram import color_magnitude, histogram
from skyweft.plans import crossmatch
from skyweft.session import build_session, cut_lineage, own_tables
from skyweft.sources import catalogs, sinks


@own_tables
def run_field(
    spark: SparkSession, field: FieldConfig, gaia_path: str, wise_path: str, simbad_path: str, out: str,
    plot_data: str | None = None,
) -> dict[str, int]:
    """Match one field, write matches and plot data, return the summary counts."""
    cone = (field.ra, field.dec, field.radius)
    gaia = catalogs.scan_gaia_quick(spark.read.parquet(gaia_path), cone, field.gaia_limit)
    wise = catalogs.scan_allwise(spark.read.parquet(wise_path), cone)
    simbad = catalogs.scan_simbad(spark.read.parquet(simbad_path))
    matches = cut_lineage(crossmatch.match_field(gaia, wise, simbad, field))
    sinks.write_csv(matches, out)
    if plot_data:
        sinks.write_csv(color_magnitude(matches), f"{plot_data}/color_magnitude")
        sinks.write_small_csv(histogram(matches, "distance_arcsec"), f"{plot_data}/separation_histogram")
    raw = crossmatch.quick_match_raw(gaia, wise, field)
    return crossmatch.quick_summary(gaia, wise, raw, matches).first().asDict()


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skyweft", description=__doc__)
    for name in ("ra", "dec", "radius"):
        parser.add_argument(f"--{name}", type=float, required=True)
    for name in ("gaia", "wise", "simbad"):
        parser.add_argument(f"--{name}", required=True, help=f"parquet path of the {name} catalog")
    parser.add_argument("--out", default="data/processed/matches")
    parser.add_argument("--plot-data", default=None)
    parser.add_argument("--threshold-arcsec", type=float, default=2.0)
    parser.add_argument("--gaia-limit", type=int, default=None)
    parser.add_argument("--simbad-limit", type=int, default=None)
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    field = FieldConfig(
        args.ra, args.dec, args.radius, gaia_limit=args.gaia_limit,
        match_threshold_arcsec=args.threshold_arcsec, known_object_limit=args.simbad_limit,
    )
    summary = run_field(build_session(), field, args.gaia, args.wise, args.simbad, args.out, args.plot_data)
    labels = {
        "total_gaia": "Gaia sources", "total_wise": "WISE sources", "matches_raw": "Matches without proper motion",
        "matches_pm": "Matches with proper motion", "checked": "Looked up in SIMBAD", "known": "Known in SIMBAD",
    }
    for name, label in labels.items():
        print(f"{label}: {summary[name]}")
    print(f"Written to {args.out}")


if __name__ == "__main__":
    main()
