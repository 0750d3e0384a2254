"""Check SQL: every registered query written as plain SQL over the given tables.

The relations below build on each other; a query's text pulls in just the ones
it names. Nearest neighbours are a declination band join with a ranking, which
is simple rather than fast: it is the yardstick, not the implementation.
"""

from __future__ import annotations

import re

from skyweft.config import ABLATION_SCENARIOS
from skyweft.operators.isolation import EULER_GAMMA, FACTOR, PRIME
from skyweft.plans.survey import CLUSTER_NAMES, FIELD_CONE, catalog_sql

RA0, DEC0, R0 = FIELD_CONE
QUICK = ("source_id ra dec parallax parallax_error pmra pmra_error pmdec pmdec_error "
         "phot_g_mean_mag phot_bp_mean_mag phot_rp_mean_mag bp_rp ruwe").split()
FULL = [*QUICK, "ra_error", "dec_error", "astrometric_excess_noise"]
WISE = ("designation ra dec sigra sigdec w1mpro w1sigmpro w2mpro w2sigmpro "
        "w3mpro w3sigmpro w4mpro w4sigmpro cc_flags ph_qual").split()
WISE_TEXT = {"designation", "cc_flags", "ph_qual"}


def _sep(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    dl, a, b = f"radians({ra2} - {ra1})", f"radians({dec1})", f"radians({dec2})"
    return (
        f"degrees(atan2(sqrt(pow(cos({b})*sin({dl}),2) + pow(cos({a})*sin({b}) - sin({a})*cos({b})*cos({dl}),2)),"
        f" sin({a})*sin({b}) + cos({a})*cos({b})*cos({dl}))) * 3600e0"
    )


def _cone(ra0: float, dec0: float, radius: float) -> str:
    return f"{_sep('ra', 'dec', f'({ra0}::DOUBLE)', f'({dec0}::DOUBLE)')} <= {radius * 3600.0}::DOUBLE"


def _nearest(left: str, lkey: str, lra: str, ldec: str, right: str, rkey: str, rra: str, rdec: str, radius: float) -> str:
    """Rows ``lk, rk, sep``: nearest right row of each left row below the radius."""
    band = f"{radius / 3600.0 * 1.000001!r}::DOUBLE"
    return (
        f"SELECT lk, rk, sep FROM (SELECT lk, rk, sep, row_number() OVER (PARTITION BY lk ORDER BY sep, rk) AS place FROM ("
        f"SELECT l.{lkey} AS lk, r.{rkey} AS rk, {_sep(f'l.{lra}', f'l.{ldec}', f'r.{rra}', f'r.{rdec}')} AS sep"
        f" FROM {left} l JOIN {right} r ON r.{rdec} BETWEEN l.{ldec} - {band} AND l.{ldec} + {band})"
        f" WHERE sep < {radius}::DOUBLE) WHERE place = 1"
    )


def _within(left: str, lkey: str, lra: str, ldec: str, right: str, rkey: str, rra: str, rdec: str, radius: float) -> str:
    """Rows ``lk, rk, sep``: all pairs below the radius."""
    band = f"{radius / 3600.0 * 1.000001!r}::DOUBLE"
    return (
        f"SELECT lk, rk, sep FROM (SELECT l.{lkey} AS lk, r.{rkey} AS rk, {_sep(f'l.{lra}', f'l.{ldec}', f'r.{rra}', f'r.{rdec}')} AS sep"
        f" FROM {left} l JOIN {right} r ON r.{rdec} BETWEEN l.{ldec} - {band} AND l.{ldec} + {band})"
        f" WHERE sep < {radius}::DOUBLE"
    )


def _r(columns: str, digits: int = 6) -> str:
    """``a, b AS c`` with every expression rounded."""
    out = []
    for item in columns.split(";"):
        text, _, name = item.strip().partition(" AS ")
        out.append(f"round({text}, {digits}) AS {name or text}")
    return ", ".join(out)


def _plain(names: list[str], text: set[str] = frozenset()) -> str:
    return ", ".join(n if n in text else f"round({n}, 6) AS {n}" for n in names)


def _moved(years: float) -> str:
    return (
        f"ra + coalesce(pmra, 0e0) / 3.6e6 * {years}::DOUBLE / cos(radians(dec)) AS ra_epoch,"
        f" dec + coalesce(pmdec, 0e0) / 3.6e6 * {years}::DOUBLE AS dec_epoch"
    )


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2e0 * {p} * {r} / ({p} + {r}) ELSE 0e0 END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END"


def _number(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{value}::DOUBLE"


def _scenario_values() -> str:
    rows = []
    for i, s in enumerate(ABLATION_SCENARIOS):
        low, high = s.parallax_window or (None, None)
        rows.append(f"({i}, '{s.name}', {_number(low)}, {_number(high)}, {_number(s.pm_tolerance)})")
    return ", ".join(rows)


TREES, SAMPLES, SEED = 100, 256, 42


def _average_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0"
        f" ELSE 2e0*(ln({n} - 1e0) + {EULER_GAMMA}::DOUBLE) - 2e0*({n} - 1e0)/{n} END"
    )


def _forest(name: str, source: str) -> dict[str, str]:
    """Relations that grow and walk an isolation forest level by level over rows (fkey, bp_rp, w1_w2, m_g, quality).

    All rows go down all trees; the drawn ones decide where nodes split.
    """
    own = f"((tree + 1) * {FACTOR}) % {PRIME}"
    number = "CAST(('0x' || substr({0}, {1}, {2})) AS BIGINT)"
    digest = f"md5('{SEED}:' || fkey)"
    out = {
        f"{name}_keys": (
            f"SELECT fkey, bp_rp AS x, w1_w2 AS y, m_g AS z, {number.format(digest, 1, 8)} % {PRIME} AS h,"
            f" {number.format(digest, 9, 8)} % {PRIME} AS k FROM {source}"
            " WHERE quality AND bp_rp IS NOT NULL AND w1_w2 IS NOT NULL AND m_g IS NOT NULL"
        ),
        f"{name}_level_a": (
            "SELECT tree, 1 AS node, fkey, x, y, z, row_number() OVER (PARTITION BY tree ORDER BY draw, fkey)"
            f" <= {SAMPLES} AS taken FROM (SELECT *, (h * own + k) % {PRIME} * {PRIME + 1} + (k * own + h) % {PRIME} AS draw"
            f" FROM (SELECT *, {own} AS own FROM {name}_keys, range({TREES}) AS t(tree)))"
        ),
        f"{name}_depth": (
            f"SELECT greatest(1, ceil(log2(greatest(least(count(*), {SAMPLES}), 2)))) AS depth,"
            f" {_average_path(f'least(count(*), {SAMPLES})')} AS usual FROM {name}_keys"
        ),
    }
    letters = "abcdefghi"
    for depth, (here, below) in enumerate(zip(letters, [*letters[1:], None])):
        d = number.format(f"md5('{SEED}:' || tree || ':' || node)", "{}", 7)
        out[f"{name}_nodes_{here}"] = (
            f"SELECT tree, node, {depth} + {_average_path('n')} AS path, feature,"
            f" CASE feature WHEN 0 THEN lx + u*(hx - lx) WHEN 1 THEN ly + u*(hy - ly) WHEN 2 THEN lz + u*(hz - lz) END AS cut"
            f" FROM (SELECT *, CASE WHEN n <= 1 OR wide = 0 OR {depth} >= depth THEN -1 WHEN hx > lx AND pick % wide = 0 THEN 0"
            " WHEN hy > ly AND pick % wide = CAST(hx > lx AS INTEGER) THEN 1 ELSE 2 END AS feature FROM ("
            f"SELECT *, CAST(hx > lx AS INTEGER) + CAST(hy > ly AS INTEGER) + CAST(hz > lz AS INTEGER) AS wide,"
            f" {d.format(1)} AS pick, {d.format(8)} / 268435456e0 AS u FROM (SELECT tree, node, count(*) AS n,"
            " min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz"
            f" FROM {name}_level_{here} WHERE taken GROUP BY tree, node)) JOIN {name}_depth ON true)"
        )
        if below:
            out[f"{name}_level_{below}"] = (
                "SELECT s.tree, 2*s.node + CASE WHEN CASE feature WHEN 0 THEN x WHEN 1 THEN y ELSE z END <= cut THEN 0 ELSE 1 END"
                f" AS node, fkey, x, y, z, taken FROM {name}_level_{here} s JOIN {name}_nodes_{here} n"
                " ON s.tree = n.tree AND s.node = n.node WHERE feature >= 0"
            )
    ends = " UNION ALL ".join(
        f"SELECT fkey, path FROM {name}_level_{i} s JOIN {name}_nodes_{i} n ON s.tree = n.tree AND s.node = n.node"
        " WHERE feature < 0" for i in letters)
    out[f"{name}_scores"] = (
        f"SELECT fkey, pow(2e0, -(sum(path) / {TREES}e0) / greatest(max(usual), 1e-12)) AS anomaly_score"
        f" FROM ({ends}) JOIN {name}_depth ON true GROUP BY fkey"
    )
    return out


_NOT_NAN = {"bp_rp"}
STEP = 0.1


def _band_steps(band: str) -> str:
    low, high = f"({band} * {STEP}::DOUBLE - 90e0)", f"(({band} + 1) * {STEP}::DOUBLE - 90e0)"
    around = f"CASE WHEN {low} < 0 AND {high} > 0 THEN 1e0 ELSE cos(radians(least(abs({low}), abs({high})))) END"
    return f"greatest(1, CAST(floor({360.0 / STEP}::DOUBLE * ({around})) AS BIGINT))"


def _band_area(band: str) -> str:
    low, high = f"({band} * {STEP}::DOUBLE - 90e0)", f"least(({band} + 1) * {STEP}::DOUBLE - 90e0, 90e0)"
    return f"2e0*pi()*(sin(radians({high})) - sin(radians({low}))) / {_band_steps(band)}"


def _sky_cell(ra: str, dec: str) -> str:
    """band, place of a direction."""
    band = f"least(CAST(floor(({dec} + 90e0) / {STEP}::DOUBLE) AS BIGINT), {round(180 / STEP) - 1})"
    steps = _band_steps(band)
    return f"{band} AS band, least(CAST(floor({ra} / 360e0 * {steps}) AS BIGINT), {steps} - 1) AS place"


def _densities(name: str, source: str) -> dict[str, str]:
    """Counts of cells, the halo of every cell around an occupied one, and the density over it."""
    halo = (
        "SELECT band, place, {n}, band2, (place2 % k2 + k2) % k2 AS place2 FROM (SELECT *, unnest(range(first, behind + 1)) AS place2 FROM ("
        "SELECT *, least(far, first + k2 - 1) AS behind FROM (SELECT *, CASE WHEN band2 = band THEN place - 1"
        " ELSE CAST(floor(place * k2 / k1 - 1e-9) AS BIGINT) END AS first,"
        " CASE WHEN band2 = band THEN place + 1 ELSE CAST(floor((place + 1) * k2 / k1 + 1e-9) AS BIGINT) END AS far"
        f" FROM (SELECT *, {_band_steps('band')} AS k1, {_band_steps('band2')} AS k2 FROM (SELECT *,"
        f" unnest(range(greatest(band - 1, 0), least(band + 1, {round(180 / STEP) - 1}) + 1)) AS band2 FROM {{source}})))))"
    )
    return {
        f"{name}_cells": f"SELECT band, place, count(*) AS n FROM (SELECT {_sky_cell('ra', 'dec')} FROM {source}) GROUP BY band, place",
        f"{name}_told": (
            "SELECT band2 AS band, place2 AS place, sum(n) AS around, coalesce(sum(n) FILTER (band2 = band AND place2 = place), 0) AS n"
            f" FROM ({halo.format(n='n', source=f'{name}_cells')}) GROUP BY band2, place2"
        ),
        f"{name}_areas": (
            f"SELECT band, place, sum({_band_area('band2')}) AS area FROM ({halo.format(n='around', source=f'{name}_told')})"
            " GROUP BY band, place"
        ),
        f"{name}_density": (
            f"SELECT t.band, t.place, CAST(t.n AS BIGINT) AS n, t.around / a.area AS density FROM {name}_told t"
            f" JOIN {name}_areas a ON t.band = a.band AND t.place = a.place"
        ),
    }


DEPTH, SHARE = 7, 256


def _quadtree(name: str, source: str, x: str, y: str) -> dict[str, str]:
    """Bins that are no longer split and whose enclosing bin was."""
    def at(v: str) -> str:
        return f"CASE WHEN {v}1 > {v}0 THEN least(CAST(floor(({v} - {v}0) / (({v}1 - {v}0) / {1 << DEPTH}e0)) AS BIGINT), {(1 << DEPTH) - 1}) ELSE 0 END"

    def edge(v: str, place: str) -> str:
        return f"round({v}0 + {place} * (({v}1 - {v}0) / pow(2e0, n.level)), 10)"

    return {
        f"{name}_points": (
            f"SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}"
            f" WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})"
        ),
        f"{name}_range": f"SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS total FROM {name}_points",
        f"{name}_finest": f"SELECT {at('x')} AS i, {at('y')} AS j FROM {name}_points, {name}_range",
        f"{name}_nodes": (
            f"SELECT level, i >> ({DEPTH} - level) AS i, j >> ({DEPTH} - level) AS j, count(*) AS n FROM {name}_finest,"
            f" (SELECT CAST(unnest(range({DEPTH + 1})) AS INTEGER) AS level) GROUP BY ALL"
        ),
        f"{name}_cut": f"SELECT level, i, j FROM {name}_nodes, {name}_range WHERE n * {SHARE} > total AND level < {DEPTH}",
        f"{name}_bins": (
            f"SELECT n.level, n.i, n.j, {edge('x', 'n.i')} AS x_low, {edge('x', '(n.i + 1)')} AS x_high,"
            f" {edge('y', 'n.j')} AS y_low, {edge('y', '(n.j + 1)')} AS y_high, n.n"
            f" FROM {name}_nodes n, {name}_range WHERE (n.level, n.i, n.j) NOT IN (SELECT (level, i, j) FROM {name}_cut)"
            f" AND (n.level = 0 OR (n.level - 1, n.i >> 1, n.j >> 1) IN (SELECT (level, i, j) FROM {name}_cut))"
        ),
    }


_RELATIONS: dict[str, str] = {
    **catalog_sql(),
    "g": "SELECT * REPLACE (CASE WHEN isnan(bp_rp) THEN NULL ELSE bp_rp END AS bp_rp) FROM gaia",
    "w": "SELECT * REPLACE (CASE WHEN isnan(w2sigmpro) THEN NULL ELSE w2sigmpro END AS w2sigmpro) FROM wise",
    "g_moved": f"SELECT *, {_moved(-5.5)} FROM g",
    "g_scan": "SELECT * FROM g_moved WHERE phot_g_mean_mag < 19e0 AND parallax IS NOT NULL",
    "m_std": (
        'SELECT CAST("Source" AS VARCHAR) AS member_id, ordinal, proba, "Gmag" AS g_mag, "RA_ICRS" AS ra,'
        ' "DE_ICRS" AS dec, "pmRA" AS pmra, "pmDE" AS pmdec, "Plx" AS parallax FROM members'
    ),
    "m_moved": f"SELECT *, {_moved(0.5)} FROM m_std",
    "nn_raw": _nearest("g", "source_id", "ra", "dec", "w", "designation", "ra", "dec", 2.0),
    "nn_pm": _nearest("g_moved", "source_id", "ra_epoch", "dec_epoch", "w", "designation", "ra", "dec", 2.0),
    "nn_five": _nearest("g_moved", "source_id", "ra_epoch", "dec_epoch", "w", "designation", "ra", "dec", 5.0),
    "nn_alerts": _nearest("alerts", "alert_id", "ra", "dec", "simbad", "main_id", "ra", "dec", 5.0),
    "nn_scan": _nearest("g_scan", "source_id", "ra_epoch", "dec_epoch", "w", "designation", "ra", "dec", 5.0),
    "sigma_g": (
        "SELECT source_id, least(1e0, greatest(0.001e0, sqrt(pow(coalesce(ra_error, 1e0)/1000e0, 2)"
        " + pow(coalesce(dec_error, 1e0)/1000e0, 2)) / sqrt(2e0))) AS sigma FROM g"
    ),
    "sigma_w": (
        "SELECT designation, least(2e0, greatest(0.05e0, sqrt(pow(coalesce(sigra, 0.5e0), 2)"
        " + pow(coalesce(sigdec, 0.5e0), 2)) / sqrt(2e0))) AS sigma FROM w"
    ),
    "pairs": (
        "SELECT lk AS source_id, rk AS designation, sep AS psi, a.sigma AS sg, b.sigma AS sw,"
        " ln(2e0) - ln((a.sigma*a.sigma + b.sigma*b.sigma) * pow(pi()/648000e0, 2))"
        " - sep*sep / (2e0*(a.sigma*a.sigma + b.sigma*b.sigma)) AS ln_b"
        " FROM nn_scan JOIN sigma_g a ON lk = a.source_id JOIN sigma_w b ON rk = b.designation"
    ),
    "area": "SELECT least(max(floor(o_orderkey / 15000e0)) + 1, 68000) * 2e0*pi()*(1e0 - cos(radians(0.3e0))) AS area_sr FROM orders",
    "sizes": (
        "SELECT (SELECT count(*) FROM g_scan) AS n_gaia, (SELECT count(*) FROM w) AS n_wise,"
        " (SELECT area_sr FROM area) AS area_sr"
    ),
    "odds": (
        "SELECT n_gaia, n_wise, 0.7e0 * least(n_gaia, n_wise)"
        " / ((n_gaia/area_sr) * (n_wise/area_sr) * area_sr) AS prior_odds FROM sizes"
    ),
    "scored": (
        "SELECT p.*, 1e0 / (1e0 + exp(-least(700e0, greatest(-700e0, ln_b + ln(o.prior_odds))))) AS posterior"
        " FROM pairs p, odds o"
    ),
    "near_twenty": _within("g_moved", "source_id", "ra_epoch", "dec_epoch", "w", "designation", "ra", "dec", 20.0),
    "near_three": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY sep, rk) AS place FROM near_twenty) WHERE place <= 3"
    ),
    "near_scan": _within("g_scan", "source_id", "ra_epoch", "dec_epoch", "w", "designation", "ra", "dec", 5.0),
    "all_pairs": (
        "SELECT lk AS source_id, rk AS designation, sep AS psi,"
        " ln(2e0) - ln((a.sigma*a.sigma + b.sigma*b.sigma) * pow(pi()/648000e0, 2))"
        " - sep*sep / (2e0*(a.sigma*a.sigma + b.sigma*b.sigma)) AS ln_b"
        " FROM near_scan JOIN sigma_g a ON lk = a.source_id JOIN sigma_w b ON rk = b.designation"
    ),
    "edges": (
        "SELECT * FROM (SELECT p.*, 1e0 / (1e0 + exp(-least(700e0, greatest(-700e0, ln_b + ln(o.prior_odds))))) AS posterior"
        " FROM all_pairs p, odds o) WHERE posterior > 0.01e0"
    ),
    "in_clusters": (
        "SELECT g.source_id, c.name AS cluster, sqrt(pow((g.parallax - c.parallax) / c.parallax_width, 2)"
        " + pow((g.pmra - c.pmra) / c.pmra_width, 2) + pow((g.pmdec - c.pmdec) / c.pmdec_width, 2)) AS cluster_distance"
        " FROM g JOIN clusters c ON abs(g.dec - c.dec) <= c.radius_deg AND abs(g.parallax - c.parallax) < c.parallax_width"
        " AND abs(g.pmra - c.pmra) < c.pmra_width AND abs(g.pmdec - c.pmdec) < c.pmdec_width"
        f" WHERE {_sep('g.ra', 'g.dec', 'c.ra', 'c.dec')} < c.radius_deg * 3600e0"
    ),
    "best_clusters": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY cluster_distance, cluster) AS place,"
        " count(*) OVER (PARTITION BY source_id) AS n_clusters FROM in_clusters) WHERE place = 1"
    ),
    "cmd_rows": "SELECT bp_rp, phot_g_mean_mag FROM nn_pm JOIN g ON lk = source_id",
    **_quadtree("cmd", "cmd_rows", "bp_rp", "phot_g_mean_mag"),
    **_quadtree("all", "g", "bp_rp", "phot_g_mean_mag"),
    **_densities("g_all", "g"),
    **_densities("g_some", "g_scan"),
    **_densities("w_all", "w"),
    "local_odds": (
        "SELECT p.source_id, p.designation, p.ln_b, 0.7e0 / greatest(a.density, b.density) AS odds FROM"
        f" (SELECT pairs.*, {_sky_cell('ra', 'dec')} FROM pairs JOIN g ON pairs.source_id = g.source_id) p"
        " LEFT JOIN g_some_density a ON p.band = a.band AND p.place = a.place"
        " LEFT JOIN w_all_density b ON p.band = b.band AND p.place = b.place"
    ),
    # Optical sources that compete, directly or through others, and their places among each other.
    "rivals": "SELECT DISTINCT x.source_id AS a, y.source_id AS b FROM edges x JOIN edges y ON x.designation = y.designation",
    "linked": (
        "WITH RECURSIVE reach AS (SELECT a, b FROM rivals UNION SELECT reach.a, rivals.b FROM reach JOIN rivals ON reach.b = rivals.a)"
        " SELECT a AS source_id, min(b) AS family FROM reach GROUP BY a"
    ),
    "turns": "SELECT source_id, family, row_number() OVER (PARTITION BY family ORDER BY source_id) AS turn FROM linked",
    "moves": (
        "SELECT t.family, t.turn, e.designation, -e.ln_b AS cost FROM turns t JOIN edges e ON t.source_id = e.source_id"
        " UNION ALL SELECT family, turn, NULL, 0e0 FROM turns"
    ),
    # Every way in which each family may be matched, source by source.
    "endings": (
        "WITH RECURSIVE plays AS (SELECT DISTINCT family, 0::BIGINT AS turn, []::VARCHAR[] AS used, 0 AS n, 0e0 AS cost FROM turns"
        " UNION ALL SELECT p.family, p.turn + 1, list_append(p.used, m.designation), p.n + CAST(m.designation IS NOT NULL AS INTEGER),"
        " p.cost + m.cost FROM plays p JOIN moves m ON m.family = p.family AND m.turn = p.turn + 1"
        " WHERE m.designation IS NULL OR NOT list_contains(p.used, m.designation))"
        " SELECT p.family, p.used, row_number() OVER (PARTITION BY p.family ORDER BY p.n DESC, p.cost, p.used) AS place FROM plays p"
        " JOIN (SELECT family, max(turn) AS last FROM turns GROUP BY family) f ON p.family = f.family AND p.turn = f.last"
    ),
    "chosen": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY designation ORDER BY ln_b DESC, source_id) AS place"
        " FROM scored WHERE posterior > 0.01e0) WHERE place = 1"
    ),
    "matches": (
        "SELECT c.source_id, c.designation, c.psi, c.ln_b, c.posterior, g.ra, g.dec, g.parallax, g.pmra, g.pmdec,"
        " g.phot_g_mean_mag, g.bp_rp, g.ruwe, w.ra AS wise_ra, w.dec AS wise_dec, w1mpro, w2mpro, w3mpro, w4mpro,"
        " w1sigmpro, w2sigmpro, w1mpro - w2mpro AS w1_w2,"
        " coalesce(g.parallax > 2e0 AND g.parallax < 2.8e0 AND abs(g.pmra + 4.7e0) < 2e0"
        " AND abs(g.pmdec - 11.2e0) < 2e0, false) AS cluster_member"
        " FROM chosen c JOIN g ON c.source_id = g.source_id JOIN w ON c.designation = w.designation"
    ),
    "nn_known": _nearest("matches", "source_id", "ra", "dec", "simbad", "main_id", "ra", "dec", 5.0),
    "known": (
        "SELECT m.source_id, CASE WHEN n.rk IS NULL THEN 0 ELSE 1 END AS known_in_simbad,"
        " coalesce(s.otype, '') AS simbad_otype, coalesce(s.main_id, '') AS simbad_main_id"
        " FROM matches m LEFT JOIN nn_known n ON m.source_id = n.lk LEFT JOIN simbad s ON n.rk = s.main_id"
    ),
    "lookup": 'SELECT CAST("ID" AS VARCHAR) AS tic_id, "Tmag" AS tic_Tmag, "GAIA" AS gid FROM tic WHERE "GAIA" IS NOT NULL',
    "with_tic": (
        "SELECT m.*, t.tic_id, t.tic_Tmag FROM matches m LEFT JOIN lookup t ON CAST(m.source_id AS VARCHAR) = t.gid"
    ),
    "enriched": (
        "SELECT m.*, k.known_in_simbad, k.simbad_otype, k.simbad_main_id"
        " FROM with_tic m JOIN known k ON m.source_id = k.source_id"
    ),
    "featured": (
        "SELECT *, phot_g_mean_mag + 5e0*log10(greatest(parallax, 0.1e0)/1000e0) + 5e0 AS m_g,"
        " coalesce(coalesce(w1sigmpro, 99e0) < 0.2e0 AND coalesce(w2sigmpro, 99e0) < 0.2e0"
        " AND phot_g_mean_mag < 17.5e0, false) AS quality FROM enriched"
    ),
    "own_features": (
        "SELECT *, CAST(source_id AS VARCHAR) AS fkey, phot_g_mean_mag + 5e0*log10(greatest(parallax, 0.1e0)/1000e0) + 5e0 AS m_g,"
        " coalesce(coalesce(w1sigmpro, 99e0) < 0.2e0 AND coalesce(w2sigmpro, 99e0) < 0.2e0"
        " AND phot_g_mean_mag < 17.5e0, false) AS quality FROM matches"
    ),
    **_forest("own", "own_features"),
    "all_features": "SELECT *, concat_ws(':', CAST(source_id AS VARCHAR), tic_id) AS fkey FROM featured",
    **_forest("all", "all_features"),
    "anomalous": "SELECT f.*, s.anomaly_score FROM all_features f LEFT JOIN all_scores s ON f.fkey = s.fkey",
    "novel": (
        "SELECT *, CASE WHEN quality THEN 1e0 ELSE 0e0 END + CASE WHEN known_in_simbad = 0 THEN 1e0 ELSE 0e0 END"
        " + CASE WHEN posterior > 0.95e0 THEN 0.5e0 ELSE 0e0 END"
        " + CASE WHEN coalesce(anomaly_score, 0e0) > 0.6e0 THEN 1.5e0 ELSE 0e0 END"
        " + CASE WHEN coalesce(ruwe, 99e0) < 1.4e0 THEN 0.3e0 ELSE 0e0 END AS novelty_score FROM anomalous"
    ),
    "top": "SELECT * FROM novel WHERE quality ORDER BY round(novelty_score, 6) DESC, source_id, tic_id NULLS FIRST LIMIT 15",
    "nn_members": _nearest("m_moved", "ordinal", "ra_epoch", "dec_epoch", "matches", "source_id", "ra", "dec", 1.0),
    "listed": (
        "SELECT source_id, proba AS list_proba FROM (SELECT n.rk AS source_id, m.proba,"
        " row_number() OVER (PARTITION BY n.rk ORDER BY m.ordinal DESC) AS place"
        " FROM nn_members n JOIN m_std m ON n.lk = m.ordinal) WHERE place = 1"
    ),
    "labelled": (
        "SELECT m.*, l.list_proba, CASE WHEN l.list_proba > 0.5e0 THEN 1 ELSE 0 END AS y_true,"
        " CASE WHEN cluster_member THEN 1 ELSE 0 END AS y_pred,"
        " CASE WHEN coalesce(l.list_proba > 0.5e0, false) THEN CASE WHEN cluster_member THEN 'TP' ELSE 'FN' END"
        " ELSE CASE WHEN cluster_member THEN 'FP' ELSE 'TN' END END AS category,"
        " sqrt(pow((parallax - 2.4e0)/0.2e0, 2) + pow(pmra + 4.7e0, 2) + pow(pmdec - 11.2e0, 2)) AS mahalanobis"
        " FROM matches m JOIN listed l ON m.source_id = l.source_id"
    ),
    "rated": "SELECT *, exp(-0.5e0*mahalanobis*mahalanobis) AS score FROM labelled",
    "confusion": (
        "SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,"
        " count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM labelled"
    ),
    "per_class": (
        "SELECT 'non-member' AS label, tn AS hit, fn AS alarm, fp AS missed FROM confusion"
        " UNION ALL SELECT 'member', tp, fp, fn FROM confusion"
    ),
    "class_lines": (
        f"SELECT label, hit + missed AS support, {_ratio('hit', '(hit + alarm)')} AS p, {_ratio('hit', '(hit + missed)')} AS r FROM per_class"
    ),
    "class_scores": f"SELECT *, {_f1('p', 'r')} AS f FROM class_lines",
    "scenarios": f"SELECT * FROM (VALUES {_scenario_values()}) AS v(ordinal, criterion, low, high, tol)",
    "predicted": (
        "SELECT s.ordinal, s.criterion, l.y_true, coalesce((s.low IS NULL OR (l.parallax > s.low AND l.parallax < s.high))"
        " AND (s.tol IS NULL OR (abs(l.pmra + 4.7e0) < s.tol AND abs(l.pmdec - 11.2e0) < s.tol)), false) AS chosen"
        " FROM labelled l, scenarios s"
    ),
    "grid_counts": (
        "SELECT ordinal, criterion, count(*) FILTER (chosen) AS n_pred, count(*) FILTER (chosen AND y_true = 1) AS hits,"
        " count(*) FILTER (y_true = 1) AS positives FROM predicted GROUP BY ordinal, criterion"
    ),
    "grid": (
        f"SELECT ordinal, criterion, n_pred, {_ratio('hits', 'n_pred')} AS p, {_ratio('hits', 'positives')} AS r FROM grid_counts"
    ),
    "thresholds": (
        "SELECT score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM rated"
        " WHERE score IS NOT NULL GROUP BY score"
    ),
    "sweep": (
        "SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,"
        " sum(pos) OVER () AS p, sum(neg) OVER () AS n, lead(pos) OVER (ORDER BY score DESC) AS next_pos,"
        " lead(neg) OVER (ORDER BY score DESC) AS next_neg, row_number() OVER (ORDER BY score DESC) AS place FROM thresholds"
    ),
    "ranks": "SELECT y_true, rank() OVER (ORDER BY score) AS low, count(*) OVER (PARTITION BY score) AS ties FROM rated WHERE score IS NOT NULL",
    "auc": (
        "SELECT (sum(low + (ties - 1) / 2e0) FILTER (y_true = 1) - count(*) FILTER (y_true = 1)"
        " * (count(*) FILTER (y_true = 1) + 1) / 2e0) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)) AS roc_auc"
        " FROM ranks"
    ),
    "quick": (
        "SELECT lk, rk, sep, 2e0/0.26e0 * exp(-(sep*sep)/(2e0*0.26e0)) AS b FROM nn_pm"
    ),
    "nn_quick_known": _nearest("g", "source_id", "ra", "dec", "simbad", "main_id", "ra", "dec", 2.0),
    "raw_first": "SELECT lk FROM nn_raw ORDER BY lk LIMIT 100",
    "g_smoke": f"SELECT * FROM g WHERE {_cone(119.5, -60.83, 0.05)}",
    "w_smoke": f"SELECT * FROM w WHERE {_cone(119.5, -60.83, 0.05)}",
    "nn_smoke": _nearest("g_smoke", "source_id", "ra", "dec", "w_smoke", "designation", "ra", "dec", 2.0),
}


def _checked(base: str, first: str | None, columns: str) -> str:
    """Known-object flags of the first rows of a match table: 1, 0 or NULL."""
    checked = "true" if first is None else f"b.lk IN (SELECT lk FROM {first})"
    return (
        f"SELECT {columns}, CASE WHEN {checked} THEN CASE WHEN n.rk IS NULL THEN 0 ELSE 1 END END AS known_in_simbad,"
        f" CASE WHEN {checked} THEN s.main_id END AS simbad_main_id, CASE WHEN {checked} THEN s.otype END AS simbad_type"
        f" FROM {base} b LEFT JOIN nn_quick_known n ON b.lk = n.lk LEFT JOIN simbad s ON n.rk = s.main_id"
    )


def _shift(east: str) -> str:
    shift = f"sqrt(pow({east}, 2) + pow(coalesce(pmdec, 0e0), 2)) * 5.5e0/1000e0"
    return (
        f"SELECT round(quantile_cont(v, 0.5), 6) AS median_shift, round(quantile_cont(v, 0.9), 6) AS p90_shift,"
        f" round(max(v), 6) AS max_shift, count(*) FILTER (v > 1e0) AS n_above_1 FROM (SELECT {shift} AS v FROM g)"
    )


def _histogram(source: str, value: str, where: str = "true", extra: str = "") -> str:
    """Bins as intervals between edges: closed below, open above, the last closed on both sides."""
    values = f"SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {where}"
    edges = (
        "SELECT CAST(i AS INTEGER) AS bin, i * ((hi - lo)/30e0) + lo AS low, (i + 1) * ((hi - lo)/30e0) + lo AS high"
        f" FROM (SELECT min(v) AS lo, max(v) AS hi FROM ({values})), range(30) AS t(i)"
    )
    return (
        f"SELECT {extra}bin, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM ({values})"
        f" WHERE (v >= low OR bin = 0) AND (v < high OR bin = 29)) AS n FROM ({edges})"
    )


def _gridded(digits: int) -> str:
    rounded = {6: "round", 3: "round"}[digits]
    return (
        f"SELECT ordinal, criterion, {rounded}(p, {digits}) AS precision, {rounded}(r, {digits}) AS recall,"
        f" {rounded}({_f1('p', 'r')}, {digits}) AS f1, n_pred FROM grid"
    )


_CURVE = "SELECT CAST(NULL AS DOUBLE) AS threshold, 0e0 AS fpr, 0e0 AS tpr UNION ALL SELECT round(score, 9), round(fp/n, 6), round(tp/p, 6) FROM sweep"
_LISTED = (
        'SELECT "Source", ordinal, round("RA_ICRS", 6) AS "RA_ICRS", round("DE_ICRS", 6) AS "DE_ICRS", round("pmRA", 6) AS "pmRA",'
        ' round("pmDE", 6) AS "pmDE", round("Plx", 6) AS "Plx", round("Gmag", 6) AS "Gmag", round(proba, 6) AS proba, "Cluster"'
)
_NAMES = ", ".join(f"'{n}'" for n in CLUSTER_NAMES)

_QUERIES: dict[str, str] = {
    "scan_cone": f"SELECT {_plain(QUICK, {'source_id'})} FROM g WHERE {_cone(RA0, DEC0, R0)}",
    "landed_cone_scan": f"SELECT {_plain(QUICK, {'source_id'})} FROM g WHERE {_cone(RA0, DEC0, R0)}",
    "scan_cone_top": f"SELECT {_plain(QUICK, {'source_id'})} FROM g WHERE {_cone(RA0, DEC0, R0)} ORDER BY source_id LIMIT 1500",
    "scan_gaia_filtered": (
        f"SELECT {_plain(FULL, {'source_id'})} FROM g WHERE {_cone(RA0, DEC0, R0)} AND phot_g_mean_mag < 19e0 AND parallax IS NOT NULL"
    ),
    "scan_wise_cone": f"SELECT {_plain(WISE, WISE_TEXT)} FROM w WHERE {_cone(RA0, DEC0, R0)}",
    "scan_conform_projection": (
        f"SELECT {_plain([c for c in WISE if not c.startswith('w4')], WISE_TEXT)},"
        " CAST(NULL AS DOUBLE) AS w4mpro, CAST(NULL AS DOUBLE) AS w4sigmpro FROM w"
    ),
    "scan_tic": 'SELECT CAST("ID" AS VARCHAR) AS "ID", round(ra, 6) AS ra, round(dec, 6) AS dec, round("Tmag", 6) AS "Tmag", "GAIA" FROM tic',
    "scan_simbad_field": f"SELECT round(ra, 6) AS ra, round(dec, 6) AS dec, main_id, otype FROM simbad WHERE {_cone(RA0, DEC0, R0)}",
    "scan_members_cascade": (
        _LISTED +
        f" FROM members WHERE \"Cluster\" = (SELECT CASE WHEN count(*) FILTER (\"Cluster\" = '{CLUSTER_NAMES[0]}') > 0"
        f" THEN '{CLUSTER_NAMES[0]}' ELSE '{CLUSTER_NAMES[1]}' END FROM members)"
    ),
    "members_cascade_second": f"{_LISTED} FROM members WHERE \"Cluster\" = '{CLUSTER_NAMES[1]}'",
    "members_cascade_cone": (
        f"{_LISTED} FROM members WHERE {_sep('\"RA_ICRS\"', '\"DE_ICRS\"', f'({RA0}::DOUBLE)', f'({DEC0}::DOUBLE)')}"
        f" <= {R0 * 3600.0}::DOUBLE"
    ),
    "members_standard_columns": (
        f"SELECT member_id, ordinal, {_r('proba; g_mag; ra; dec; pmra; pmdec; parallax')} FROM m_std"
    ),
    "prefix_columns": (
        "SELECT round(ra, 6) AS simbad_ra, round(dec, 6) AS simbad_dec, main_id AS simbad_main_id, otype AS simbad_otype FROM simbad"
    ),
    "propagate_epoch": f"SELECT source_id, {_r('ra_epoch; dec_epoch')} FROM g_moved",
    "propagate_members": f"SELECT ordinal, {_r('ra_epoch; dec_epoch')} FROM m_moved",
    "pm_shift_stats": _shift("coalesce(pmra, 0e0)"),
    "pm_shift_stats_compat": _shift("coalesce(pmra, 0e0) * cos(radians(dec))"),
    "sep_vincenty": f"SELECT source_id, round({_sep('ra', 'dec', f'({RA0}::DOUBLE)', f'({DEC0}::DOUBLE)')}, 6) AS separation FROM g",
    "sigma_effective": (
        "SELECT 'gaia' AS catalog, CAST(source_id AS VARCHAR) AS key, round(sigma, 6) AS sigma FROM sigma_g"
        " UNION ALL SELECT 'wise', designation, round(sigma, 6) FROM sigma_w"
    ),
    "xmatch_nearest_raw": (
        "SELECT lk AS gaia_source_id, round(g.ra, 6) AS gaia_ra, round(g.dec, 6) AS gaia_dec, rk AS wise_designation,"
        " round(w.ra, 6) AS wise_ra, round(w.dec, 6) AS wise_dec, round(sep, 6) AS distance_arcsec"
        " FROM nn_raw JOIN g ON lk = g.source_id JOIN w ON rk = w.designation"
    ),
    "xmatch_nearest_pm": (
        "SELECT lk AS gaia_source_id, round(ra_epoch, 6) AS gaia_ra_epoch, round(dec_epoch, 6) AS gaia_dec_epoch,"
        " round(phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag, rk AS wise_designation, round(w.ra, 6) AS wise_ra,"
        " round(w.dec, 6) AS wise_dec, round(w.w1mpro, 6) AS wise_w1mpro, round(sep, 6) AS distance_arcsec"
        " FROM nn_pm JOIN g_moved g ON lk = g.source_id JOIN w ON rk = w.designation"
    ),
    "xmatch_nearest_crowded": (
        "SELECT lk AS gaia_source_id, rk AS wise_designation, round(sep, 6) AS distance_arcsec FROM nn_five"
    ),
    **dict.fromkeys(
        ("xmatch_k_nearest", "xmatch_k_nearest_crowded"),
        "SELECT lk AS gaia_source_id, rk AS wise_designation, CAST(place AS INTEGER) AS rank, round(sep, 6) AS distance_arcsec FROM near_three"),
    "xmatch_pairs_within": "SELECT lk AS gaia_source_id, rk AS wise_designation, round(sep, 6) AS distance_arcsec FROM near_twenty",
    **dict.fromkeys(
        ("xmatch_of_landed", "xmatch_in_landed", "xmatch_incremental"),
        "SELECT lk AS gaia_source_id, rk AS wise_designation, round(sep, 6) AS distance_arcsec FROM nn_pm"),
    "stream_alert_matches": "SELECT lk AS alert_id, rk AS main_id, round(sep, 6) AS distance_arcsec FROM nn_alerts",
    "xmatch_coarse_filter": (
        "SELECT lk AS gaia_source_id, rk AS wise_designation, round(sep, 6) AS distance_arcsec"
        " FROM nn_pm JOIN g ON lk = source_id WHERE phot_g_mean_mag < 8.3e0"
    ),
    "xmatch_gain": (
        "SELECT (SELECT count(*) FROM nn_raw) AS n_raw, (SELECT count(*) FROM nn_pm) AS n_pm,"
        " (SELECT count(*) FROM nn_pm) - (SELECT count(*) FROM nn_raw) AS gain"
    ),
    "threshold_sweep": (
        "SELECT count(*) FILTER (sep < 1e0) AS within_1, count(*) FILTER (sep < 2e0) AS within_2,"
        " count(*) FILTER (sep < 5e0) AS within_5 FROM nn_five"
    ),
    "bf_arcsec_posterior": (
        "SELECT lk AS gaia_source_id, rk AS wise_designation, round(sep, 6) AS distance_arcsec,"
        " round(b, 6) AS bayes_factor_pos, round(b/(1e0 + b), 6) AS posterior_match FROM quick"
    ),
    "quick_run": (
        "SELECT k.*, round(g.bp_rp, 6) AS gaia_bp_rp, round(g.phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag FROM ("
        + _checked("quick", None,
                   "b.lk AS gaia_source_id, b.rk AS wise_designation, round(sep, 6) AS distance_arcsec,"
                   " round(b.b/(1e0 + b.b), 6) AS posterior_match".replace("round(sep", "round(b.sep"))
        + ") k JOIN g ON k.gaia_source_id = g.source_id"
    ),
    "quick_run_summary": (
        "SELECT (SELECT count(*) FROM g) AS total_gaia, (SELECT count(*) FROM w) AS total_wise,"
        " (SELECT count(*) FROM nn_raw) AS matches_raw, count(*) AS matches_pm, count(known_in_simbad) AS checked,"
        " CAST(coalesce(sum(known_in_simbad), 0) AS BIGINT) AS known FROM (" + _checked("quick", None, "b.lk") + ")"
    ),
    "smoke_crossmatch": (
        "SELECT k.*, round(g.ra, 6) AS gaia_ra, round(g.dec, 6) AS gaia_dec, round(w.ra, 6) AS wise_ra, round(w.dec, 6) AS wise_dec FROM ("
        + _checked("nn_smoke", None,
                   "b.lk AS gaia_source_id, b.rk AS wise_designation, round(b.sep, 6) AS distance_arcsec")
        + ") k JOIN g ON k.gaia_source_id = g.source_id JOIN w ON k.wise_designation = w.designation"
    ),
    "candidates_5as": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(psi, 6) AS psi_arcsec,"
        " round(sg, 6) AS sigma_gaia, round(sw, 6) AS sigma_wise FROM pairs"
    ),
    "bf_radian_ln": "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(ln_b, 4) AS ln_b FROM pairs",
    "edge_cost": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(-ln_b, 4) AS cost FROM scored WHERE posterior > 0.01e0"
    ),
    "prior_odds_density": "SELECT n_gaia, n_wise, round(ln(prior_odds), 6) AS ln_prior_odds FROM odds",
    "solid_angle_density": (
        "SELECT round(area_sr, 6) AS area_sr, round(n_gaia/area_sr * pow(pi()/180e0, 2) / 3600e0, 6) AS gaia_per_sq_arcmin,"
        " round(n_wise/area_sr * pow(pi()/180e0, 2) / 3600e0, 6) AS wise_per_sq_arcmin FROM sizes"
    ),
    "posterior_density": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(posterior, 6) AS posterior FROM scored"
    ),
    "posterior_describe": (
        "SELECT count(*) AS n, round(avg(posterior), 6) AS mean, round(stddev_samp(posterior), 6) AS std,"
        " round(min(posterior), 6) AS smallest, round(quantile_cont(posterior, 0.5), 6) AS p50,"
        " round(quantile_cont(posterior, 0.9), 6) AS p90, round(quantile_cont(posterior, 0.95), 6) AS p95,"
        " round(quantile_cont(posterior, 0.99), 6) AS p99, round(max(posterior), 6) AS largest FROM scored"
    ),
    "assign_one_to_one": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(psi, 6) AS psi_arcsec,"
        " round(posterior, 6) AS posterior FROM chosen"
    ),
    "local_density_cells": (
        "SELECT band, place, n, round(density / pow(180e0 / pi() * 60e0, 2), 6) AS density FROM g_all_density"
    ),
    "posterior_local": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(ln(odds), 6) AS ln_odds,"
        " round(1e0 / (1e0 + exp(-least(700e0, greatest(-700e0, ln_b + ln(odds))))), 6) AS posterior FROM local_odds"
    ),
    "clusters_best": (
        "SELECT g.source_id, b.cluster, round(b.cluster_distance, 6) AS cluster_distance, coalesce(b.n_clusters, 0) AS n_clusters"
        " FROM g LEFT JOIN best_clusters b ON g.source_id = b.source_id"
    ),
    "clusters_all": "SELECT source_id, cluster, round(cluster_distance, 6) AS cluster_distance FROM in_clusters",
    "clusters_counts": (
        "SELECT c.name, count(b.source_id) AS n_members, round(avg(b.cluster_distance), 6) AS mean_distance"
        " FROM clusters c LEFT JOIN best_clusters b ON c.name = b.cluster GROUP BY c.name"
    ),
    "candidates_all_5as": (
        "SELECT source_id AS gaia_source_id, designation AS wise_designation, round(psi, 6) AS psi_arcsec, round(ln_b, 4) AS ln_b FROM all_pairs"
    ),
    "assign_general": (
        "SELECT e.source_id AS gaia_source_id, e.designation AS wise_designation, round(e.psi, 6) AS psi_arcsec, round(e.ln_b, 4) AS ln_b,"
        " round(e.posterior, 6) AS posterior FROM endings d JOIN turns t ON t.family = d.family AND d.place = 1"
        " JOIN edges e ON e.source_id = t.source_id AND e.designation = d.used[t.turn]"
    ),
    "pair_metrics_rejoin": (
        "SELECT c.source_id AS gaia_source_id, c.designation AS wise_designation, round(s.psi, 6) AS psi_arcsec,"
        " round(s.ln_b, 4) AS ln_b, round(s.posterior, 6) AS posterior FROM chosen c"
        " LEFT JOIN scored s ON c.source_id = s.source_id AND c.designation = s.designation"
    ),
    "match_confidence_counts": (
        "SELECT count(*) AS n_matches, count(*) FILTER (posterior > 0.5e0) AS above_50,"
        " count(*) FILTER (posterior > 0.9e0) AS above_90, count(*) FILTER (posterior > 0.99e0) AS above_99 FROM matches"
    ),
    "distinct_keys": "SELECT DISTINCT designation AS wise_designation FROM scored WHERE posterior > 0.01e0 ORDER BY 1",
    "enrich_gather": (
        "SELECT source_id AS gaia_source_id, "
        + _r("; ".join(f"{c} AS gaia_{c}" for c in ("ra", "dec", "parallax", "pmra", "pmdec", "phot_g_mean_mag", "bp_rp", "ruwe")))
        + ", " + _r("wise_ra; wise_dec") + ", "
        + _r("; ".join(f"{c} AS wise_{c}" for c in ("w1mpro", "w2mpro", "w3mpro", "w4mpro", "w1sigmpro", "w2sigmpro")))
        + " FROM matches"
    ),
    "color_index": "SELECT source_id AS gaia_source_id, round(w1_w2, 6) AS w1_w2 FROM matches",
    "cluster_members": (
        "SELECT source_id AS gaia_source_id, round(parallax, 6) AS gaia_parallax, round(pmra, 6) AS gaia_pmra,"
        " round(pmdec, 6) AS gaia_pmdec, cluster_member FROM matches"
    ),
    "crossmatch_flagship": (
        "SELECT source_id AS gaia_source_id, round(ra, 6) AS gaia_ra, round(dec, 6) AS gaia_dec, designation AS wise_designation,"
        " round(psi, 6) AS psi_arcsec, round(posterior, 6) AS posterior, round(w1_w2, 6) AS w1_w2, cluster_member,"
        " known_in_simbad, simbad_otype, simbad_main_id, tic_id, round(tic_Tmag, 6) AS tic_Tmag FROM enriched"
    ),
    "tic_left_join": "SELECT source_id AS gaia_source_id, tic_id, round(tic_Tmag, 6) AS tic_Tmag FROM with_tic",
    "tic_join_hot": "SELECT source_id AS gaia_source_id, tic_id, round(tic_Tmag, 6) AS tic_Tmag FROM with_tic",
    "tic_join_dedupe": (
        "SELECT source_id AS gaia_source_id, tic_id, round(tic_Tmag, 6) AS tic_Tmag FROM (SELECT *,"
        " row_number() OVER (PARTITION BY source_id ORDER BY tic_id) AS place FROM with_tic) WHERE place = 1"
    ),
    "tic_match_rate": (
        "SELECT count(*) AS n_rows, count(tic_id) AS n_tic, round(100e0*count(tic_id)/count(*), 6) AS tic_percent FROM with_tic"
    ),
    "simbad_enrich_nearest": "SELECT source_id AS gaia_source_id, known_in_simbad, simbad_otype, simbad_main_id FROM known",
    "simbad_lookup_limit": _checked("nn_raw", "raw_first", "b.lk AS gaia_source_id"),
    "simbad_lookup_all": _checked("nn_raw", None, "b.lk AS gaia_source_id"),
    "simbad_type_counts": (
        "SELECT simbad_otype, count(*) AS n FROM known WHERE known_in_simbad = 1 GROUP BY 1 ORDER BY n DESC, simbad_otype LIMIT 15"
    ),
    "quality_gate": (
        "SELECT source_id AS gaia_source_id, quality, quality AND bp_rp IS NOT NULL AND w1_w2 IS NOT NULL"
        " AND phot_g_mean_mag IS NOT NULL AND parallax IS NOT NULL AS valid_features FROM (SELECT *,"
        " coalesce(coalesce(w1sigmpro, 99e0) < 0.2e0 AND coalesce(w2sigmpro, 99e0) < 0.2e0"
        " AND phot_g_mean_mag < 17.5e0, false) AS quality FROM matches)"
    ),
    "abs_mag": (
        "SELECT source_id, round(CASE WHEN parallax IS NOT NULL THEN phot_g_mean_mag"
        " + 5e0*log10(greatest(parallax, 0.1e0)/1000e0) + 5e0 END, 6) AS m_g_approx FROM g"
    ),
    "novelty_scores": (
        "SELECT source_id AS gaia_source_id, tic_id, round(anomaly_score, 6) AS anomaly_score, round(novelty_score, 6) AS novelty_score FROM novel"
    ),
    "novelty_topk": (
        "SELECT source_id AS gaia_source_id, round(phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag, round(bp_rp, 6) AS gaia_bp_rp,"
        " round(w1_w2, 6) AS w1_w2, round(parallax, 6) AS gaia_parallax, round(ruwe, 6) AS gaia_ruwe, round(posterior, 6) AS posterior,"
        " known_in_simbad, simbad_otype, round(anomaly_score, 6) AS anomaly_score, round(novelty_score, 6) AS novelty_score, tic_id FROM top"
    ),
    "first_candidate_with_tic": (
        "SELECT source_id AS gaia_source_id, tic_id, round(novelty_score, 6) AS novelty_score FROM top WHERE tic_id IS NOT NULL"
        " ORDER BY round(novelty_score, 6) DESC, source_id, tic_id LIMIT 1"
    ),
    "isolation_forest_score": (
        "SELECT source_id AS gaia_source_id, s.fkey IS NOT NULL AS valid_features, round(anomaly_score, 6) AS anomaly_score"
        " FROM own_features f LEFT JOIN own_scores s ON f.fkey = s.fkey"
    ),
    "novelty_with_forest": (
        "SELECT source_id AS gaia_source_id, round(anomaly_score, 6) AS anomaly_score,"
        " round(novelty_score, 6) AS novelty_score, tic_id FROM top"
    ),
    "top_candidate_lightcurve": (
        "SELECT target_id, event_id, round(flux / median(flux) OVER (PARTITION BY target_id), 6) AS flux FROM lightcurve"
        " WHERE flux IS NOT NULL AND target_id IN (SELECT tic_id FROM top WHERE tic_id IS NOT NULL"
        " ORDER BY round(novelty_score, 6) DESC, source_id, tic_id LIMIT 1)"
    ),
    "lightcurve_normalize": (
        "SELECT target_id, event_id, round(flux / median(flux) OVER (PARTITION BY target_id), 6) AS flux FROM lightcurve WHERE flux IS NOT NULL"
    ),
    "run_summary": (
        "SELECT (SELECT count(*) FROM g_scan) AS n_gaia, (SELECT count(*) FROM w) AS n_wise, (SELECT count(*) FROM pairs) AS n_candidates,"
        " (SELECT count(*) FROM matches) AS n_matches, (SELECT CAST(sum(known_in_simbad) AS BIGINT) FROM known) AS n_known,"
        " (SELECT count(*) FILTER (cluster_member) FROM matches) AS n_members"
    ),
    "ref_match_1as": "SELECT lk AS ordinal, rk AS source_key, round(sep, 6) AS separation_arcsec FROM nn_members",
    "ref_match_rate": (
        "SELECT (SELECT count(*) FROM m_std) AS n_members, count(*) AS n_matched, (SELECT count(*) FROM m_std) - count(*) AS n_unmatched,"
        " round(100e0*count(*)/(SELECT count(*) FROM m_std), 6) AS matched_percent, round(median(sep), 6) AS median_separation,"
        " round(max(sep), 6) AS max_separation FROM nn_members"
    ),
    "ref_unmatched": "SELECT ordinal, member_id FROM m_std WHERE ordinal NOT IN (SELECT lk FROM nn_members)",
    "ref_scatter_last": (
        "SELECT m.source_id AS gaia_source_id, l.source_id IS NOT NULL AS in_list, round(l.list_proba, 6) AS list_proba"
        " FROM matches m LEFT JOIN listed l ON m.source_id = l.source_id"
    ),
    "ours_only_counts": (
        "SELECT count(*) FILTER (l.source_id IS NOT NULL) AS in_list, count(*) FILTER (l.source_id IS NULL) AS only_ours"
        " FROM matches m LEFT JOIN listed l ON m.source_id = l.source_id"
    ),
    "proba_cut_counts": (
        "SELECT count(*) FILTER (proba > 0.5e0) AS above_50, count(*) FILTER (proba > 0.7e0) AS above_70,"
        " count(*) FILTER (proba > 0.9e0) AS above_90 FROM members"
    ),
    "labels_confusion": "SELECT tn, fp, fn, tp FROM confusion",
    "prf_metrics": (
        f"SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({_f1('p', 'r')}, 6) AS f1, round(a, 6) AS accuracy FROM (SELECT"
        f" {_ratio('tp', '(tp + fp)')} AS p, {_ratio('tp', '(tp + fn)')} AS r, {_ratio('(tp + tn)', '(tn + fp + fn + tp)')} AS a FROM confusion)"
    ),
    "validation_summary": (
        "SELECT tn, fp, fn, tp, round(p, 6) AS precision, round(r, 6) AS recall,"
        f" round({_f1('p', 'r')}, 6) AS f1, round(a, 6) AS accuracy, round(roc_auc, 6) AS roc_auc,"
        " round(100e0 * (SELECT count(*) FROM nn_members) / (SELECT count(*) FROM m_std), 6) AS coverage_percent"
        f" FROM (SELECT *, {_ratio('tp', '(tp + fp)')} AS p, {_ratio('tp', '(tp + fn)')} AS r,"
        f" {_ratio('(tp + tn)', '(tn + fp + fn + tp)')} AS a FROM confusion) JOIN auc ON true"
    ),
    "class_report": (
        "SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM class_scores"
        " UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM class_scores"
        " UNION ALL SELECT 'weighted avg', round(sum(p*support)/sum(support), 6), round(sum(r*support)/sum(support), 6),"
        " round(sum(f*support)/sum(support), 6), CAST(sum(support) AS BIGINT) FROM class_scores"
    ),
    "error_categories": "SELECT source_id AS gaia_source_id, y_true, y_pred, category FROM labelled",
    "ablation_grid": _gridded(6),
    "ablation_rounded": _gridded(3),
    "ablation_best": f"SELECT criterion, f1 FROM (SELECT ordinal, criterion, round({_f1('p', 'r')}, 3) AS f1 FROM grid) ORDER BY f1 DESC, ordinal LIMIT 1",
    "mahalanobis_score": (
        "SELECT source_id AS gaia_source_id, round(mahalanobis, 6) AS mahalanobis, round(score, 6) AS membership_score FROM rated"
    ),
    "roc_curve": _CURVE + " WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg",
    "roc_curve_all_points": _CURVE,
    "roc_auc": "SELECT round(roc_auc, 6) AS roc_auc FROM auc",
    "auc_band": (
        "SELECT CASE WHEN roc_auc > 0.95e0 THEN 'excellent' WHEN roc_auc > 0.85e0 THEN 'good'"
        " WHEN roc_auc > 0.7e0 THEN 'moderate' ELSE 'low' END AS band FROM auc"
    ),
    "pr_curve": (
        "SELECT round(score, 9) AS threshold, round(tp/(tp + fp), 6) AS precision, round(tp/p, 6) AS recall FROM sweep"
        " UNION ALL SELECT NULL, 1e0, 0e0"
    ),
    "fp_fn_brightest5": (
        "SELECT category, source_id AS gaia_source_id, round(phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag, round(parallax, 6) AS gaia_parallax,"
        " round(pmra, 6) AS gaia_pmra, round(pmdec, 6) AS gaia_pmdec, round(list_proba, 6) AS list_proba, CAST(place AS INTEGER) AS place"
        " FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY phot_g_mean_mag, source_id) AS place FROM labelled"
        " WHERE category IN ('FP', 'FN')) WHERE place <= 5"
    ),
    "fp_fn_summary": (
        "SELECT category, count(*) AS n, round(min(list_proba), 6) AS min_proba, round(max(list_proba), 6) AS max_proba,"
        " round(median(list_proba), 6) AS median_proba, round(median(parallax), 6) AS median_parallax, round(median(pmra), 6) AS median_pmra,"
        " round(median(pmdec), 6) AS median_pmdec FROM labelled GROUP BY category"
    ),
    "hist_separation_30": _histogram("nn_raw", "sep"),
    "hist_member_list": " UNION ALL ".join(
        _histogram("m_std", c, extra=f"'{c}' AS \"column\", ") for c in ("proba", "g_mag", "parallax")
    ),
    "hist_parallax_by_category": " UNION ALL ".join(
        _histogram("labelled", "parallax", f"category = '{c}'", f"'{c}' AS category, ") for c in ("TP", "FP", "FN")
    ),
    "cmd_plot_data": (
        "SELECT round(bp_rp, 6) AS gaia_bp_rp, round(phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag"
        " FROM nn_pm JOIN g ON lk = source_id WHERE bp_rp IS NOT NULL AND phot_g_mean_mag IS NOT NULL"
    ),
    "cmd_adaptive_bins": "SELECT * FROM cmd_bins",
    "cmd_adaptive_bins_all": "SELECT * FROM all_bins",
    "cmd_member_panels": (
        "SELECT source_id AS gaia_source_id, round(bp_rp, 6) AS gaia_bp_rp, round(w1_w2, 6) AS w1_w2,"
        " round(phot_g_mean_mag, 6) AS gaia_phot_g_mean_mag, cluster_member FROM matches"
    ),
    "validation_panels": (
        "SELECT source_id AS gaia_source_id, category, "
        + _r("; ".join(f"{c} AS gaia_{c}" for c in ("bp_rp", "phot_g_mean_mag", "ra", "dec", "pmra", "pmdec", "parallax")))
        + " FROM labelled"
    ),
}


def _needed(text: str) -> list[str]:
    """Relations a text refers to, directly or through others, in dependency order."""
    order: list[str] = []

    def visit(body: str) -> None:
        words = set(re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_]+)\b", body))
        for name in _RELATIONS:
            if name in words and name not in order:
                visit(_RELATIONS[name])
                order.append(name)

    visit(text)
    return order


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, text in _QUERIES.items():
        relations = ", ".join(
            f"{r} AS {'MATERIALIZED ' if '_level_' in r or '_nodes_' in r else ''}({_RELATIONS[r]})" for r in _needed(text))
        out[name] = f"WITH {relations} {text}" if relations else text
    return out
