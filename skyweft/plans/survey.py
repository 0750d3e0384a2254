"""Sky catalogs derived from the given star-schema tables.

Every catalog column is an arithmetic expression over a table's own keys, valid
as it stands in Spark SQL and in any ANSI SQL engine (double literals carry an
exponent), so a check engine can derive the very same catalogs. Sources are laid
out in fields of 15,000 orders each, so the sky grows with the tables while the
density stays the same. Once the 68,000 places for fields are taken (10^9 orders),
further fields share them, and density grows instead of the area.

==========  =========================================================
gaia        one source per order, and a close companion per part
wise        the orders whose status is not ``P``, seen at epoch 2010.5
tic         the orders not of low priority, and a second entry per supplier
simbad      one known object per customer
members     gaia sources near the cluster; bright ones are listed twice
clusters    one cluster per supplier: a disc with boxes of parallax and motion
lightcurve  one flux per event
alerts      one place and time per event, near the known object of its user's number
==========  =========================================================
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyweft.functions.nulls import nan_to_null
from skyweft.functions.sphere import cone_solid_angle

FIELD_RADIUS_DEG = 0.3
FIELD_CONE = (119.5, -60.83, FIELD_RADIUS_DEG)
FIELDS_PER_ROW, FIELD_ROWS = 340, 200
CLUSTER_NAMES = ("NGC_2516", "NGC2516")

_FIELD = "CAST(floor(k / 15000e0) AS BIGINT)"
_RA = f"(119.2e0 + ({_FIELD} % {FIELDS_PER_ROW}) * 0.7e0 + ((k * 7919) % 20011) / 20011e0 * 0.6e0)"
_DEC = (
    f"(-61.13e0 + (CAST(floor(k / {15000 * FIELDS_PER_ROW}e0) AS BIGINT) % {FIELD_ROWS}) * 0.7e0"
    f" + ((k * 104729) % 30011) / 30011e0 * 0.6e0)"
)
_FAST = "(CASE WHEN k % 10 = 0 THEN 100e0 ELSE 1e0 END)"
_PMRA = f"(CASE WHEN k % 17 = 0 THEN NULL ELSE (-8.7e0 + ((k * 31) % 8001) / 1000e0) * {_FAST} END)"
_PMDEC = f"(CASE WHEN k % 17 = 0 THEN NULL ELSE (7.2e0 + ((k * 61) % 8001) / 1000e0) * {_FAST} END)"
_G = "(8e0 + ((k * 43) % 11500) / 1000e0)"
_RA_WISE = f"({_RA} + coalesce({_PMRA}, 0e0) / 3.6e6 * -5.5e0 / cos(radians({_DEC})))"
_DEC_WISE = f"({_DEC} + coalesce({_PMDEC}, 0e0) / 3.6e6 * -5.5e0)"
_SOURCE_ID = "(5290000000000000000 + 2 * k)"
_NAN = "CAST('NaN' AS DOUBLE)"

_SEEDS = {
    "gaia_seed": (
        "SELECT o_orderkey AS k, 0 AS b FROM {orders} UNION ALL SELECT p_partkey * 7 AS k, 1 AS b FROM {part}"
    ),
    "wise_seed": "SELECT o_orderkey AS k FROM {orders} WHERE o_orderstatus <> 'P'",
    "tic_seed": (
        "SELECT o_orderkey AS k, 1000000 + o_orderkey AS tic FROM {orders} WHERE o_orderpriority <> '5-LOW'"
        " UNION ALL SELECT s_suppkey * 10 AS k, 9000000000 + s_suppkey AS tic FROM {supplier}"
    ),
    "alert_seed": "SELECT user_id * 10 AS k, event_id, ts FROM {events}",
    "cluster_seed": "SELECT s_suppkey * 10 AS k FROM {supplier}",
    "simbad_seed": "SELECT c_custkey * 10 AS k, c_custkey AS c, c_mktsegment FROM {customer}",
}

_CATALOGS: dict[str, tuple[str, dict[str, str]]] = {
    "gaia": (
        "gaia_seed",
        {
            "source_id": f"{_SOURCE_ID} + b",
            "ra": f"{_RA} + b * 0.0006e0",
            "dec": f"{_DEC} + b * 0.0003e0",
            "ra_error": "CASE WHEN k % 19 = 0 THEN NULL ELSE ((k * 41) % 200) / 100e0 END",
            "dec_error": "((k * 67) % 200) / 100e0",
            "parallax": "CASE WHEN k % 41 = 0 THEN NULL ELSE 0.4e0 + ((k * 37) % 4001) / 1000e0 + b * 0.1e0 END",
            "parallax_error": "0.02e0 + ((k * 29) % 300) / 1000e0",
            "pmra": _PMRA,
            "pmra_error": "0.01e0 + ((k * 23) % 200) / 1000e0",
            "pmdec": _PMDEC,
            "pmdec_error": "0.01e0 + ((k * 21) % 200) / 1000e0",
            "phot_g_mean_mag": f"{_G} + b * 0.5e0",
            "phot_bp_mean_mag": f"{_G} + ((k * 47) % 4000) / 2000e0",
            "phot_rp_mean_mag": f"{_G} - ((k * 47) % 4000) / 2000e0 + 0.5e0",
            "bp_rp": f"CASE WHEN k % 43 = 0 THEN {_NAN} ELSE ((k * 47) % 4000) / 1000e0 - 0.5e0 END",
            "ruwe": "CASE WHEN k % 23 = 0 THEN NULL ELSE 0.8e0 + ((k * 53) % 1500) / 1000e0 END",
            "astrometric_excess_noise": "((k * 57) % 900) / 1000e0",
        },
    ),
    "wise": (
        "wise_seed",
        {
            "designation": "concat('W', CAST(k AS VARCHAR(20)))",
            "ra": f"{_RA_WISE} + ((k * 59) % 601 - 300) / 300e0 * 2e0 / 3600e0",
            "dec": f"{_DEC_WISE} + ((k * 71) % 601 - 300) / 300e0 * 2e0 / 3600e0",
            "sigra": "CASE WHEN k % 13 = 0 THEN NULL ELSE 0.05e0 + ((k * 73) % 400) / 1000e0 END",
            "sigdec": "0.05e0 + ((k * 79) % 400) / 1000e0",
            "w1mpro": f"{_G} - 2e0",
            "w1sigmpro": "CASE WHEN k % 31 = 0 THEN NULL ELSE ((k * 103) % 300) / 1000e0 END",
            "w2mpro": f"{_G} - 2e0 - ((k * 101) % 800 - 200) / 1000e0",
            "w2sigmpro": f"CASE WHEN k % 37 = 0 THEN {_NAN} ELSE ((k * 107) % 300) / 1000e0 END",
            "w3mpro": f"{_G} - 3e0",
            "w3sigmpro": "((k * 109) % 500) / 1000e0",
            "w4mpro": f"{_G} - 4e0",
            "w4sigmpro": "((k * 113) % 900) / 1000e0",
            "cc_flags": "CASE WHEN k % 5 = 0 THEN 'dd00' ELSE '0000' END",
            "ph_qual": "CASE WHEN k % 3 = 0 THEN 'AABU' ELSE 'AAAA' END",
        },
    ),
    "tic": (
        "tic_seed",
        {
            "ID": "tic",
            "ra": _RA,
            "dec": _DEC,
            "Tmag": f"{_G} - 0.4e0",
            "GAIA": f"CASE WHEN k % 29 = 0 THEN NULL ELSE CAST({_SOURCE_ID} AS VARCHAR(20)) END",
        },
    ),
    "simbad": (
        "simbad_seed",
        {
            "ra": f"{_RA} + ((k * 109) % 241 - 120) / 120e0 * 6e0 / 3600e0",
            "dec": f"{_DEC} + ((k * 127) % 241 - 120) / 120e0 * 6e0 / 3600e0",
            "main_id": "concat('OBJ ', CAST(c AS VARCHAR(20)))",
            "otype": "c_mktsegment",
        },
    ),
}

_CATALOGS["alerts"] = (
    "alert_seed",
    {
        "alert_id": "event_id",
        "time": "ts",
        "ra": f"{_RA} + ((event_id * 59) % 401 - 200) / 200e0 * 4e0 / 3600e0",
        "dec": f"{_DEC} + ((event_id * 71) % 401 - 200) / 200e0 * 4e0 / 3600e0",
    },
)
_CATALOGS["clusters"] = (
    "cluster_seed",
    {
        "name": "concat('C', CAST(k AS VARCHAR(20)))",
        "ra": _RA,
        "dec": _DEC,
        "radius_deg": "0.05e0 + ((k * 17) % 11) / 100e0",
        "parallax": "0.6e0 + ((k * 37) % 3501) / 1000e0",
        "parallax_width": "0.4e0 + ((k * 7) % 5) / 10e0",
        "pmra": "-7.7e0 + ((k * 31) % 6001) / 1000e0",
        "pmra_width": "1.2e0 + ((k * 3) % 9) / 10e0",
        "pmdec": "8.2e0 + ((k * 61) % 6001) / 1000e0",
        "pmdec_width": "1.2e0 + ((k * 13) % 9) / 10e0",
    },
)

_NEAR_CLUSTER = (
    "parallax > 1.9e0 AND parallax < 2.9e0 AND (pmra IS NULL OR"
    " (abs(pmra + 4.7e0) < 2.5e0 AND abs(pmdec - 11.2e0) < 2.5e0))"
)
_NUMBER = "(source_id - 5290000000000000000)"


def _listed_members(ordinal: str, proba: str, where: str) -> str:
    """One listing of the gaia sources near the cluster, with positions at epoch 2015.5."""
    columns = {
        "Source": "source_id",
        "ordinal": ordinal,
        "RA_ICRS": (
            "ra - coalesce(pmra, 0e0) / 3.6e6 * 0.5e0 / cos(radians(dec))"
            f" + (({_NUMBER} * 89) % 201 - 100) / 100e0 * 0.9e0 / 3600e0"
        ),
        "DE_ICRS": (
            "dec - coalesce(pmdec, 0e0) / 3.6e6 * 0.5e0"
            f" + (({_NUMBER} * 97) % 201 - 100) / 100e0 * 0.9e0 / 3600e0"
        ),
        "pmRA": "pmra",
        "pmDE": "pmdec",
        "Plx": "parallax",
        "Gmag": "phot_g_mean_mag",
        "proba": proba,
        "Cluster": "CASE WHEN phot_g_mean_mag < 12e0 THEN 'NGC2516' ELSE 'NGC_2516' END",
    }
    return f"SELECT {_select_list(columns)} FROM {{gaia}} WHERE {_NEAR_CLUSTER}{where}"


def _select_list(columns: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in columns.items())


_DERIVED = {
    "members": (
        _listed_members(_NUMBER, f"(({_NUMBER} * 83) % 100) / 100e0", "")
        + " UNION ALL "
        + _listed_members(
            f"({_NUMBER} + 4000000000000)", f"(({_NUMBER} * 47) % 100) / 100e0", " AND phot_g_mean_mag < 9.5e0"
        )
    ),
    "lightcurve": (
        "SELECT CAST(1000000 + user_id AS VARCHAR(20)) AS target_id, event_id, ts AS time,"
        " CASE WHEN event_id % 37 = 0 THEN NULL ELSE value END AS flux FROM {events}"
    ),
}

_TEMPLATES = {
    **_SEEDS,
    **{name: f"SELECT {_select_list(columns)} FROM {{{seed}}}" for name, (seed, columns) in _CATALOGS.items()},
    **_DERIVED,
}


def _inputs(template: str) -> list[str]:
    return sorted({name for _, name, _, _ in Formatter().parse(template) if name})


def catalog_sql() -> dict[str, str]:
    """SELECT text of every derived relation, in dependency order, for a check engine."""
    return {name: text.format(**{i: i for i in _inputs(text)}) for name, text in _TEMPLATES.items()}


class Survey:
    """The derived catalogs over one directory of parquet tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, table_dir: str):
        self.spark = spark
        self._dir = table_dir.rstrip("/")
        self._plans: dict[str, DataFrame] = {}

    def relation(self, name: str) -> DataFrame:
        """A derived catalog by name, or else one of the given tables (the plan, not the rows)."""
        if name not in self._plans:
            self._plans[name] = self._plan(name)
        return self._plans[name]

    def _plan(self, name: str) -> DataFrame:
        if name not in _TEMPLATES:
            return self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        template = _TEMPLATES[name].replace('"', "`")
        return self.spark.sql(template, **{i: self.relation(i) for i in _inputs(template)})

    def area_sr(self) -> Column:
        """Solid angle of all places that fields take: one cone each, as a single value of its own small plan."""
        last = self.relation("orders").agg(F.max(F.floor(F.col("o_orderkey") / F.lit(15000.0)))).scalar()
        places = F.least(last + F.lit(1), F.lit(FIELDS_PER_ROW * FIELD_ROWS))
        return places.cast("double") * F.lit(cone_solid_angle(FIELD_RADIUS_DEG))

    gaia = property(lambda self: nan_to_null(self.relation("gaia"), ["bp_rp"]), doc="Optical sources, epoch 2016.0.")
    wise = property(lambda self: nan_to_null(self.relation("wise"), ["w2sigmpro"]), doc="Infrared sources, epoch 2010.5.")
    tic = property(lambda self: self.relation("tic"), doc="Input catalog with optical identifiers.")
    simbad = property(lambda self: self.relation("simbad"), doc="Known objects.")
    members = property(lambda self: self.relation("members"), doc="Published member list, epoch 2015.5.")
    clusters = property(lambda self: self.relation("clusters"), doc="Clusters with discs and boxes.")
    alerts = property(lambda self: self.relation("alerts"), doc="Places and times of events.")
    lightcurve = property(lambda self: self.relation("lightcurve"), doc="Flux per target and time.")
