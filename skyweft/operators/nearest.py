"""Nearest neighbour on the sphere, as an equi-join on grid cells.

Directions become unit vectors, which need no special case at the poles or at
0/360 degrees. A cubic grid with an edge of a few search radii is laid over
them. Every right row is copied to the cells its search ball touches, so a left
row finds all its candidates in its own cell alone:

* both sides are joined on the cell with the distance as residual (one shuffle a side),
  and each left row, which lies in one cell, keeps its nearest where the join put it;
* for the ``k`` nearest, whose candidates are many, both sides of a cell are brought
  to one task (one shuffle a side) that compares them in blocks of an array.

No second shuffle per left row is needed, and both sides keep their columns.
Bounding the search loses nothing: a nearest neighbour below the threshold
exists exactly where some pair is below it.

Before planning, one aggregation counts the right rows of wider cells, each in its own
cell alone; the fullest, or where that does not tell the fullest block of neighbouring ones,
bounds what the cells inside hold, copies included. Where the sky is so thin that cells of
``thin_factor`` radii stay below ``max_candidates``, these are taken for the single nearest: fewer
copies of right rows are made. Other cells are counted only where the bound does not tell:

* A cell with too many *left* rows streams past its few right rows in one task; ``salt_left``
  splits it by salting, counts the left rows first and groups right rows into one array
  per cell. Cells that are compared in blocks are always counted and salted.
* More than ``max_broadcast_rows`` right rows are shuffled, whatever Spark makes of the size
  of their files, which says little about rows that are computed and copied.
* Many right rows that few tasks read, as from small files, are dealt to all tasks before
  they are copied to cells.
* With ``coarse_filter``, for a left side that covers little of the sky, its rows first
  mark the coarse cells around them in a bitmap of fixed size, and right rows outside
  are dropped before any copy of them is made. This reads the left side once more.
* A cell with more than ``max_candidates`` right rows is not joined but compared in
  blocks, where left rows are streamed past its right rows.
* A cell with more than ``block_rows`` right rows fits no block. Its left rows descend a
  tree of ever smaller boxes instead, and keep a box only while it can still hold
  the nearest neighbour. Copies of a position count once, so boxes always get
  smaller and the descent ends with short arrays. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skyweft.functions.once import with_columns_once
from skyweft.functions.sphere import chord_length, unit_vector
from skyweft.operators.skew import PARTS, SALT, hot_keys, salted_join
from skyweft.session import cut_lineage, ship_code

CELL = ("_cx", "_cy", "_cz")
AXES = ("_x", "_y", "_z")
PLACE = ("_ra", "_dec")
SLACK = 1e-13  # chord length; far above rounding, far below any useful radius
#: Smallest edge of a coarse cell (some 7 arcmin), and the bitmap's length: 2 ** 14 words of 64 bits.
COARSE_EDGE, BITMAP_BITS = 1.0 / 512.0, 20
#: Far above what rounding adds to the square of a chord that comes from sines and cosines.
CHORD_SLACK = 1e-14
#: Right rows a task may read before they are dealt to more tasks, where most would have none.
ROWS_PER_TASK = 100_000
#: Pairs that a task compares at once.
PAIRS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class NearestOptions:
    """Sizes that steer the plan; none of them changes the result."""

    cell_factor: float = 4.0
    thin_factor: float = 8.0
    max_candidates: int = 256
    block_rows: int = 4096
    leaf_rows: int = 32
    max_left_rows: int = 500_000
    max_broadcast_rows: int = 50_000
    split_per_axis: int = 4
    salt_left: bool = False
    coarse_filter: bool = False


def _reach(threshold: float) -> float:
    """Chord of the threshold angle, widened far beyond rounding."""
    return chord_length(threshold) * (1.0 + 1e-9) + SLACK


def _has_place(ra: str, dec: str) -> Column:
    """Both coordinates present and finite, as one comparison (NaN sorts above infinity)."""
    return F.col(f"`{ra}`") + F.col(f"`{dec}`") < F.lit(float("inf"))


def _with_geometry(df: DataFrame, ra: str, dec: str, complete: bool) -> DataFrame:
    """Add coordinates, the sine and cosine of declination and the unit vector.

    ``complete`` says that rows without coordinates are gone; otherwise theirs are NULL.
    """
    places = {"_ra": F.col(f"`{ra}`").cast("double"), "_dec": F.col(f"`{dec}`").cast("double")}
    if not complete:
        places = {name: F.when(_has_place(ra, dec), value) for name, value in places.items()}
    df = df.withColumns(places)
    x, y, z = unit_vector(F.col("_ra"), F.col("_dec"))
    return df.withColumns(
        {"_sin": F.sin(F.radians("_dec")), "_cos": F.cos(F.radians("_dec")), "_x": x, "_y": y, "_z": z}
    )


def _separation(ra1: Column, sin1: Column, cos1: Column, ra2: Column, sin2: Column, cos2: Column) -> Column:
    """Separation in arcsec from stored sines and cosines of declination."""
    dlon = F.radians(ra2 - ra1)
    east = cos2 * F.sin(dlon)
    north = cos1 * sin2 - sin1 * cos2 * F.cos(dlon)
    along = sin1 * sin2 + cos1 * cos2 * F.cos(dlon)
    return F.degrees(F.atan2(F.sqrt(east * east + north * north), along)) * F.lit(3600.0)


def _own_cell(df: DataFrame, edge: float, key: str) -> DataFrame:
    """Cell of each left row; rows without coordinates are spread over unused cells."""
    nowhere = F.lit(-(2**40)) - F.pmod(F.xxhash64(key), F.lit(65536))
    cells = {c: F.floor(F.col(a) / F.lit(edge)) for c, a in zip(CELL, AXES)}
    return df.withColumns(
        {CELL[0]: F.coalesce(cells[CELL[0]], nowhere), **{c: F.coalesce(cells[c], F.lit(0)) for c in CELL[1:]}}
    )


def _touched_cells(df: DataFrame, edge: float, reach: float) -> DataFrame:
    """One row per cell that a ball of ``reach`` touches and that may meet the sphere, by its centre's distance.

    An exact test on the corners drops few cells more, and its formulas keep the JVM from compiling the loop for long.
    """
    for cell, axis in zip(CELL, AXES):
        low = F.floor((F.col(axis) - F.lit(reach)) / F.lit(edge))
        high = F.floor((F.col(axis) + F.lit(reach)) / F.lit(edge))
        df = df.withColumn(cell, F.explode(F.sequence(low, high)))
    x, y, z = [F.col(cell) + F.lit(0.5) for cell in CELL]
    half = 0.5 * 3**0.5 * edge * (1.0 + 1e-9) + 1e-9
    low, high = (max(0.0, 1.0 - half) / edge) ** 2, ((1.0 + half) / edge) ** 2
    return df.filter((x * x + y * y + z * z).between(low, high))


def near_occupied(rights: DataFrame, lefts: DataFrame, reach: float) -> DataFrame:
    """Right rows whose coarse cell some left row's search ball touches, and a few by chance; both sides placed.

    Cells are hashed to the bits of a bitmap, of which no more than its fixed
    number of words is broadcast, however many rows there are.
    """
    edge = max(COARSE_EDGE, 2.0 * reach)
    bit = F.pmod(F.xxhash64(*CELL), F.lit(1 << BITMAP_BITS))
    word, flag = F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    marked = _touched_cells(lefts.select(*AXES), edge, reach).select(bit.alias("_bit"))
    bitmap = F.broadcast(marked.groupBy(word).agg(F.bit_or(flag).alias("_bits")))
    own = {c: F.floor(F.col(a) / F.lit(edge)) for c, a in zip(CELL, AXES)}
    placed = rights.withColumns(own).withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    kept = placed.join(bitmap, "_word").filter(F.col("_bits").bitwiseAND(flag) != 0)
    return kept.drop("_word", "_bits", "_bit", *CELL)


def _closest(candidates: str, threshold: float, k: int = 1) -> Column:
    """Array with the ``k`` smallest (separation, key, columns) below the threshold, or as many as there are.

    A cheap bound on one axis comes first: no chord is shorter than its part
    along the polar axis. Exploding the array drops rows without a match and
    computes separations only once.
    """
    reach = _reach(threshold)

    def measure(r: Column) -> Column:
        distance = _separation(F.col("_ra"), F.col("_sin"), F.col("_cos"), r["ra"], r["sin"], r["cos"])
        return F.struct(distance.alias("separation"), r["key"].alias("key"), r["row"].alias("row"))

    level = F.filter(candidates, lambda r: F.abs(r["sin"] - F.col("_sin")) <= F.lit(reach))
    near = F.filter(F.transform(level, measure), lambda m: m["separation"] < F.lit(threshold))
    return F.slice(F.array_sort(near), 1, k)


def _right_body(key: str, columns: list[str]) -> Column:
    return F.struct(
        F.col("_ra").alias("ra"),
        F.col("_sin").alias("sin"),
        F.col("_cos").alias("cos"),
        F.col(f"`{key}`").alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
    )


def crossmatch_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str = "source_id",
    right_key: str = "designation",
    left_ra: str = "ra",
    left_dec: str = "dec",
    right_ra: str = "ra",
    right_dec: str = "dec",
    threshold_arcsec: float = 2.0,
    left_prefix: str = "gaia_",
    right_prefix: str = "wise_",
    separation: str = "distance_arcsec",
    how: str = "inner",
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """For each left row the nearest right row strictly below the threshold.

    ``how`` is ``inner`` or ``left``. The smaller ``right_key`` wins among
    equally near right rows; ``left_key`` need not be unique, it only spreads
    rows that would share a task. Rows without coordinates match nothing.
    Output: prefixed left columns, prefixed right columns and the separation in
    arcsec.
    """
    return _crossmatch(
        left, right, left_key, right_key, (left_ra, left_dec), (right_ra, right_dec), float(threshold_arcsec), 1, how, options,
    ).select(*_named(left, right, left_prefix, right_prefix, separation))


def crossmatch_k_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    k: int,
    left_key: str = "source_id",
    right_key: str = "designation",
    left_ra: str = "ra",
    left_dec: str = "dec",
    right_ra: str = "ra",
    right_dec: str = "dec",
    threshold_arcsec: float = 2.0,
    left_prefix: str = "gaia_",
    right_prefix: str = "wise_",
    separation: str = "distance_arcsec",
    rank: str = "rank",
    how: str = "inner",
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """For each left row its ``k`` nearest right rows strictly below the threshold, ranked from 1.

    The plan is that of ``crossmatch_nearest``; a left row never holds more than
    ``k`` candidates of a leaf. Among equally near right rows the smaller ``right_key``
    ranks first; copies of a right row with one key all count, up to ``k``. A left row
    with none comes once with ``how="left"``, with a NULL rank.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    matched = _crossmatch(
        left, right, left_key, right_key, (left_ra, left_dec), (right_ra, right_dec), float(threshold_arcsec), k, how, options)
    return matched.select(*_named(left, right, left_prefix, right_prefix, separation), (F.col("_at") + 1).alias(rank))


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str = "source_id",
    left_ra: str = "ra",
    left_dec: str = "dec",
    right_ra: str = "ra",
    right_dec: str = "dec",
    radius_arcsec: float = 2.0,
    left_prefix: str = "gaia_",
    right_prefix: str = "wise_",
    separation: str = "distance_arcsec",
    options: NearestOptions = NearestOptions(cell_factor=1.0),
) -> DataFrame:
    """All pairs of a left and a right row strictly closer than the radius.

    An equi-join on cells with the distance as its residual: a left row lies in
    one cell, a right row is copied to those that its ball touches, so each pair
    meets once. Cells are as wide as the radius, which keeps the pairs looked at
    in proportion to those found, however crowded the sky; cells are no arrays
    here, so adaptive execution splits a crowded one on both sides, and ``salt_left``
    does so by salting. Equal rows pair as often as they occur.
    """
    radius = float(radius_arcsec)
    reach = _reach(radius)
    edge = max(reach * options.cell_factor, 1e-9)
    lefts = _own_cell(_with_geometry(left.filter(_has_place(left_ra, left_dec)), left_ra, left_dec, True), edge, left_key)
    rights = _with_geometry(right.filter(_has_place(right_ra, right_dec)), right_ra, right_dec, True)
    packed = F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("row")
    near = F.struct(F.col("_ra").alias("ra"), F.col("_sin").alias("sin"), F.col("_cos").alias("cos"), packed).alias("_near")
    rights = _touched_cells(rights, edge, reach).select(*CELL, near)
    if options.salt_left:
        joined = salted_join(lefts, rights, CELL, left_key, "inner", options.max_left_rows)
    else:
        joined = lefts.join(rights, list(CELL))
    level = F.abs(F.col("_near.sin") - F.col("_sin")) <= F.lit(reach)
    apart = _separation(
        F.col("_ra"), F.col("_sin"), F.col("_cos"), F.col("_near.ra"), F.col("_near.sin"), F.col("_near.cos"))
    found = joined.filter(level).withColumn("_apart", apart).filter(F.col("_apart") < F.lit(radius))
    return found.select(
        *[F.col(f"`{c}`").alias(left_prefix + c) for c in left.columns],
        *[F.col("_near.row").getField(c).alias(right_prefix + c) for c in right.columns],
        F.col("_apart").alias(separation),
    )


def _named(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str, separation: str) -> list[Column]:
    return [
        *[F.col(f"`{c}`").alias(left_prefix + c) for c in left.columns],
        *[F.col("_best.row").getField(c).alias(right_prefix + c) for c in right.columns],
        F.col("_best.separation").alias(separation),
    ]


def _crossmatch(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_place: tuple[str, str],
    right_place: tuple[str, str], threshold: float, k: int, how: str, options: NearestOptions,
) -> DataFrame:
    """Left columns, ``_at`` (place among the nearest, from 0) and ``_best`` (separation, key, right columns)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    reach = _reach(threshold)
    edge = max(reach * options.cell_factor, 1e-9)
    left_columns, right_columns = left.columns, right.columns

    inner = how == "inner"
    lefts = _with_geometry(left.filter(_has_place(*left_place)) if inner else left, *left_place, inner)

    def place(rows: DataFrame) -> DataFrame:
        rows = with_columns_once(rows, {name: F.col(f"`{c}`").cast("double") for name, c in zip(PLACE, right_place)})
        rows = _with_geometry(rows.filter(_has_place(*PLACE)), *PLACE, True)
        if not options.coarse_filter:
            return rows
        return near_occupied(rows, lefts if inner else lefts.filter(_has_place(*left_place)), reach)

    rows_below = options.block_rows if k > 1 else min(options.max_candidates, options.block_rows)
    thin = max(edge, reach * options.thin_factor) if k == 1 else edge
    densest, n_rights, n_tasks = _bound_of_cells(place(right), thin, reach, rows_below)
    if densest <= rows_below:
        edge = thin
    lefts = _own_cell(lefts, edge, left_key)
    cores = right.sparkSession.sparkContext.defaultParallelism
    if n_rights > ROWS_PER_TASK * n_tasks and 2 * n_tasks <= cores:
        right = right.repartition(cores)
    packed = with_columns_once(place(right), {"_packed": _right_body(right_key, right_columns)})
    rights = _touched_cells(packed, edge, reach)

    tally = _count_cells(rights)
    if densest > rows_below:
        densest, n_rights = _most_and_all(tally)
    explode = F.posexplode if inner else F.posexplode_outer
    kept = [F.col(f"`{c}`") for c in left_columns]
    matched = []
    if densest > options.block_rows:
        lefts, rights, vast = _set_apart(lefts, rights, tally, options.block_rows, options)
        if vast is not None:
            found = _descend(*vast, right_key, right_columns, threshold, reach, k, options)
            descended = salted_join(vast[0], found, PLACE, left_key, how, options.max_left_rows)
            matched.append(descended.select(*kept, explode("_found").alias("_at", "_best")))
    blocks = (lefts, rights) if k > 1 else None
    if k == 1 and min(densest, options.block_rows) > options.max_candidates:
        lefts, rights, blocks = _set_apart(lefts, rights, tally, options.max_candidates, options)
    if blocks is not None:
        compared = _compare_blocks(*blocks, left_columns, left_key, right_key, right_columns, reach, k, options)
        matched.append(compared.select(
            *[F.col("_own").getField(c).alias(c) for c in left_columns],
            explode(_closest("_near", threshold, k)).alias("_at", "_best")))
    if k == 1 and options.salt_left:
        arrays = rights.groupBy(*CELL).agg(F.collect_list("_packed").alias("_near"))
        joined = salted_join(lefts, arrays, CELL, left_key, how, options.max_left_rows)
        matched.append(joined.select(*kept, explode(_closest("_near", threshold, k)).alias("_at", "_best")))
    elif k == 1:
        lean = F.struct(*[F.col("_packed").getField(c).alias(c) for c in ("sin", "cos", "row")])
        bodies = rights.select(*CELL, lean.alias("_near"))
        if n_rights > options.max_broadcast_rows:
            bodies = bodies.hint("merge")
        matched.append(_join_nearest(lefts, bodies, right_place[0], right_key, threshold, how).select(*kept, "_at", "_best"))
    out = matched[0]
    for more in matched[1:]:
        out = out.unionByName(more)
    return out


def _count_cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_rows"))


def _most_and_all(tally: DataFrame) -> tuple[int, int]:
    most, total = tally.agg(F.max("_rows"), F.sum("_rows")).first()
    return most or 0, total or 0


def _bound_of_cells(placed: DataFrame, edge: float, reach: float, enough: int) -> tuple[int, int, int]:
    """No less than the most right rows of a cell, copies included; all right rows; and the tasks that read them.

    Whatever touches a cell lies within a cube as wide as a wider cell, so in two of these
    along each axis at most. Right rows are counted in their own wider cell; where eight times
    the fullest is more than ``enough``, the counts are added up over all blocks of two by two by two.
    """
    wide = 1.01 * (edge + 2.0 * reach)
    own = placed.select(*[F.floor(F.col(a) / F.lit(wide)).alias(c) for c, a in zip(CELL, AXES)], F.spark_partition_id().alias("_task"))
    counted = own.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_rows"), F.max("_task").alias("_task"))
    most, total, last = counted.agg(F.max("_rows"), F.sum("_rows"), F.max("_task")).first()
    bound = 8 * (most or 0)
    if bound > enough >= (most or 0):
        blocks = counted.select("_rows", *CELL)
        for c in CELL:
            blocks = blocks.withColumn(c, F.explode(F.array(F.col(c), F.col(c) - 1)))
        bound, _ = _most_and_all(blocks.groupBy(*CELL).agg(F.sum("_rows").alias("_rows")))
    return bound, total or 0, (last or 0) + 1


def _join_nearest(
    lefts: DataFrame, bodies: DataFrame, right_ra: str, right_key: str, threshold: float, how: str
) -> DataFrame:
    """Left rows with ``_best``, their nearest of the right rows (``CELL``, ``_near``) of their cell, and ``_at``, 0 if there is one.

    Cells meet by their hash, which sorts as one number; where two share one, the distance tells.
    The join's own residual is the square of the chord within its rounding, a short formula; the separation
    is computed once, of the few pairs that are left, and settles which of them are near enough.
    Pairs are ranked under the hash and a number given to each left row, so they stay where the join put them.
    """
    cell = F.xxhash64(*CELL)
    there, key = F.col("_near.row").getField(right_ra).cast("double"), F.col("_near.row").getField(right_key)
    sin, cos, reach = F.col("_near.sin"), F.col("_near.cos"), _reach(threshold)
    rise, wider = sin - F.col("_sin"), cos - F.col("_cos")
    chord = rise * rise + wider * wider + F.lit(2.0) * cos * F.col("_cos") * (F.lit(1.0) - F.cos(F.radians(there - F.col("_ra"))))
    near = (F.col("_cell") == F.col("_near_cell")) & (F.abs(rise) <= F.lit(reach)) & (chord <= F.lit(reach * reach + CHORD_SLACK))
    numbered = lefts.withColumns({"_cell": cell, "_number": F.monotonically_increasing_id()}).drop(*CELL)
    pairs = numbered.join(bodies.select(cell.alias("_near_cell"), "_near"), near, how)
    apart = _separation(F.col("_ra"), F.col("_sin"), F.col("_cos"), there, sin, cos)
    measured = pairs.withColumn("_apart", F.when(apart < F.lit(threshold), apart))
    nearest_first = Window.partitionBy("_cell", "_number").orderBy(F.col("_apart").asc_nulls_last(), key, "_near.row")
    found = F.col("_apart").isNotNull()
    first = measured.withColumn("_nth", F.row_number().over(nearest_first)).filter(F.col("_nth") == 1)
    if how == "inner":
        first = first.filter(found)
    best = F.struct(F.col("_apart").alias("separation"), key.alias("key"), F.col("_near.row").alias("row"))
    return first.withColumns({"_at": F.when(found, F.lit(0)), "_best": F.when(found, best)})


def _compare_blocks(
    lefts: DataFrame, rights: DataFrame, left_columns: list[str], left_key: str, right_key: str, right_columns: list[str],
    reach: float, k: int, options: NearestOptions,
) -> DataFrame:
    """Each left row (``_own``, ``_ra``, ``_sin``, ``_cos``) with an array ``_near`` of right rows that holds its ``k`` nearest.

    A task gets whole cells, right rows first, and keeps those of one cell only; left
    rows stream past them. The array holds whatever may be among the ``k`` nearest within
    rounding, at most ``k`` copies of a position; it is ranked by the caller.
    """
    ship_code(lefts.sparkSession)
    cell = list(CELL)
    hot = cut_lineage(hot_keys(lefts, cell, options.max_left_rows))
    salts = [F.lit(0), F.lit(0)]
    if not hot.isEmpty():
        lefts, rights = lefts.join(hot, cell, "left"), rights.join(hot, cell, "left")
        parts = F.coalesce(F.col(PARTS), F.lit(1))
        salts = [F.pmod(F.xxhash64(left_key), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))]
    own = F.struct(*[F.col(f"`{c}`") for c in left_columns])
    body = F.struct(F.col(f"`{right_key}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in right_columns]).alias("row"))
    types = {"_own": lefts.select(own.alias("o")).schema["o"].dataType, "_body": rights.select(body.alias("b")).schema["b"].dataType}
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in types.items()}
    both = rights.select(*cell, salts[1].alias(SALT), F.lit(0).alias("_side"), *PLACE, body.alias("_body"), none["_own"]).unionByName(
        lefts.select(*cell, salts[0].alias(SALT), F.lit(1).alias("_side"), *PLACE, none["_body"], own.alias("_own")))
    dealt = both.repartition(*cell, SALT).sortWithinPartitions(*cell, SALT, "_side", *PLACE, "_body")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return nearest_in_blocks(batches, reach, k)

    near = T.StructType([T.StructField("ra", T.DoubleType()), T.StructField("dec", T.DoubleType()),
                         *types["_body"].fields])
    schema = T.StructType([T.StructField("_own", types["_own"]), *[T.StructField(c, T.DoubleType()) for c in PLACE],
                           T.StructField("_found", T.ArrayType(near))])
    compared = dealt.mapInArrow(compare, schema)
    latitude = F.radians("_dec")
    whole = lambda r: F.struct(
        r["ra"].alias("ra"), F.sin(F.radians(r["dec"])).alias("sin"), F.cos(F.radians(r["dec"])).alias("cos"),
        r["key"].alias("key"), r["row"].alias("row"))
    return compared.select(
        "_own", "_ra", F.sin(latitude).alias("_sin"), F.cos(latitude).alias("_cos"), F.transform("_found", whole).alias("_near"))


def nearest_in_blocks(batches: Iterator[pa.RecordBatch], reach: float, k: int) -> Iterator[pa.RecordBatch]:
    """Left rows of batches sorted by cell, salt and side, each with the right rows of its cell that may be its ``k`` nearest."""
    held: pa.StructArray | None = None  # right rows of the cell that the last batch ended in
    last: np.ndarray | None = None
    repeats = 0  # how many rows at the end of the held ones stand at one position
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = batch.schema.names
        column = dict(zip(names, batch.columns, strict=True))
        cells = np.column_stack([column[c].to_numpy(zero_copy_only=False) for c in (*CELL, SALT)])
        ra, dec = (column[c].to_numpy(zero_copy_only=False) for c in PLACE)
        side = column["_side"].to_numpy(zero_copy_only=False)
        key, row = column["_body"].flatten()
        rights = pa.StructArray.from_arrays([column["_ra"], column["_dec"], key, row], ["ra", "dec", "key", "row"])
        goes_on = last is not None and bool((cells[0] == last).all())
        starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(cells)]

        # Of right rows at one position, which stand side by side in the order of their keys, k count.
        at = np.flatnonzero(side == 0)
        new = np.ones(len(at), dtype=bool)
        if len(at) > 1:
            new[1:] = (ra[at][1:] != ra[at][:-1]) | (dec[at][1:] != dec[at][:-1]) | (cells[at][1:] != cells[at][:-1]).any(axis=1)
        before = 0
        if goes_on and held is not None and len(held) and len(at) and at[0] == 0:
            if tuple(held.field(c)[len(held) - 1].as_py() for c in ("ra", "dec")) == (ra[0], dec[0]):
                before = repeats
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        nth = np.arange(len(at)) - run + np.where(run == 0, before, 0)
        at, nth = at[nth < k], nth[nth < k]
        base = held if goes_on and held is not None else rights.slice(0, 0)
        pool = pa.concat_arrays([base, rights.take(pa.array(at))])
        px, py = (pool.field(c).to_numpy(zero_copy_only=False) for c in ("ra", "dec"))
        there, here = _vectors(px, py), _vectors(ra, dec)

        counts, chosen, rows = [], [], []
        for start, end in zip(starts, ends, strict=True):
            low, high = np.searchsorted(at, (start, end)) + len(base)
            if start == 0 and goes_on:
                low = 0
            lefts = start + np.searchsorted(side[start:end], 1)
            block = there[low:high]
            step = max(1, PAIRS_AT_ONCE // max(1, len(block)))
            for first in range(lefts, end, step):
                points = here[first:min(first + step, end)]
                rows.append(np.arange(first, first + len(points)))
                if not len(block):
                    counts.append(np.zeros(len(points), dtype=np.int64))
                    continue
                apart = np.zeros((len(points), len(block)))
                for axis in range(3):
                    apart += (points[:, axis, None] - block[None, :, axis]) ** 2
                apart = np.sqrt(apart)
                bound = np.full(len(points), reach)
                if len(block) > k:
                    bound = np.minimum(bound, np.partition(apart, k - 1, axis=1)[:, k - 1])
                inside = apart <= bound[:, None] + 2 * SLACK
                counts.append(inside.sum(axis=1))
                chosen.append(np.nonzero(inside)[1] + low)
        if rows:
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
            taken = pool.take(pa.array(np.concatenate([*chosen, np.zeros(0, dtype=np.int64)])))
            picked = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [column["_own"].take(picked), *[column[c].take(picked) for c in PLACE],
                 pa.ListArray.from_arrays(pa.array(offsets), taken)], ["_own", *PLACE, "_found"])

        start = int(starts[-1])
        low = 0 if start == 0 and goes_on else int(np.searchsorted(at, start)) + len(base)
        if len(at) and at[-1] >= start:
            repeats = int(nth[-1]) + 1
        held, last = pool.slice(low), cells[-1]


def _vectors(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(ra), np.radians(dec)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _set_apart(lefts: DataFrame, rights: DataFrame, tally: DataFrame, most: int, options: NearestOptions) -> tuple:
    """Both sides of ordinary cells, and both sides of cells with more than ``most`` right rows.

    The latter is None if no left row lies in such a cell; their right rows can
    then match nothing.
    """
    on = list(CELL)

    def marks(cells: DataFrame) -> DataFrame:
        return F.broadcast(cells) if cells.count() <= options.max_broadcast_rows else cells

    crowded = marks(cut_lineage(tally.filter(F.col("_rows") > most).select(*CELL)))
    in_use = cut_lineage(lefts.select(*CELL).join(crowded, on, "left_semi").distinct())
    apart = None
    if not in_use.isEmpty():
        used = marks(in_use)
        apart = (lefts.join(used, on, "left_semi"), rights.join(used, on, "left_semi"))
        lefts = lefts.join(used, on, "left_anti")
    return lefts, rights.join(crowded, on, "left_anti"), apart


def _box_distances(box: Column) -> tuple[Column, Column]:
    """Smallest and largest chord from a left row to a box of right rows."""
    nearest, farthest = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        low, high = box[f"low{axis}"] - F.col(axis), box[f"high{axis}"] - F.col(axis)
        gap = F.greatest(low, -high, F.lit(0.0))
        span = F.greatest(F.abs(low), F.abs(high))
        nearest, farthest = nearest + gap * gap, farthest + span * span
    return F.sqrt(nearest), F.sqrt(farthest)


def _bounds() -> list[Column]:
    return [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]


def _descend(
    lefts: DataFrame,
    rights: DataFrame,
    right_key: str,
    right_columns: list[str],
    threshold: float,
    reach: float,
    k: int,
    options: NearestOptions,
) -> DataFrame:
    """The ``k`` nearest neighbours of every place in crowded cells: coordinates and the array ``_found``.

    Left copies of a place count once, right ones ``k`` times at most.
    """
    node = F.concat_ws(":", *CELL).alias("_node")
    body = _right_body(right_key, right_columns)
    points = rights.select(node, *PLACE, *AXES, body.alias("_body"), F.col(f"`{right_key}`").alias("_key"))
    if k == 1:
        points = points.groupBy("_node", *PLACE, *AXES).agg(F.min_by("_body", "_key").alias("_body"))
    else:
        first = F.row_number().over(Window.partitionBy("_node", *PLACE, *AXES).orderBy("_key"))
        points = points.withColumn("_first", first).filter(F.col("_first") <= k).drop("_first", "_key")
    points = cut_lineage(points)
    frontier = (
        lefts.select(*PLACE, "_sin", "_cos", *AXES, node)
        .distinct()
        .withColumns({"_bound": F.lit(reach), "_gap": F.lit(0.0)})
    )

    while True:
        extent = F.greatest(*[F.col(f"high{a}") - F.col(f"low{a}") for a in AXES])
        boxes = points.groupBy("_node").agg(F.count(F.lit(1)).alias("_rows"), *_bounds())
        large = cut_lineage(boxes.filter((F.col("_rows") > options.leaf_rows) & (extent > 0)))
        n_large = large.count()
        if n_large == 0:
            break
        points = cut_lineage(_split_points(points, large, n_large, options))
        frontier = cut_lineage(_follow(frontier, points, n_large, k, options))
        points = points.drop("_parent")

    leaves = points.groupBy("_node").agg(F.collect_list("_body").alias("_near"))
    reached = salted_join(frontier, leaves, ["_node"], "_x", "inner", options.max_left_rows)
    best = reached.withColumn("_best", F.explode(_closest("_near", threshold, k)))
    if k == 1:
        return best.groupBy(*PLACE).agg(F.array(F.min("_best")).alias("_found"))
    place = F.row_number().over(Window.partitionBy(*PLACE).orderBy("_best"))
    best = best.withColumn("_nth", place).filter(F.col("_nth") <= k)
    return best.groupBy(*PLACE).agg(F.array_sort(F.collect_list("_best")).alias("_found"))


def _split_points(points: DataFrame, large: DataFrame, n_large: int, options: NearestOptions) -> DataFrame:
    """Move the points of large boxes to the child boxes they fall into."""
    n = options.split_per_axis
    if n_large <= options.max_broadcast_rows:
        joined = points.join(F.broadcast(large), "_node", "left")
    else:
        joined = salted_join(points, large, ["_node"], "_x", "left", options.max_left_rows)
    steps = []
    for axis in AXES:
        width = F.col(f"high{axis}") - F.col(f"low{axis}")
        position = F.try_divide(F.col(axis) - F.col(f"low{axis}"), width) * F.lit(float(n))
        steps.append(F.coalesce(F.least(F.floor(position), F.lit(n - 1)), F.lit(0)).cast("string"))
    is_split = F.col("_rows").isNotNull()
    child = F.concat(F.col("_node"), F.lit("/"), F.concat_ws(".", *steps))
    return joined.select(
        F.when(is_split, F.col("_node")).alias("_parent"),
        F.when(is_split, child).otherwise(F.col("_node")).alias("_node"),
        *AXES,
        "_body",
    )


def _reached(options: Column, k: int) -> Column:
    """Distance within which boxes (far, rows, ...) hold ``k`` rows for certain, or NULL where they do not."""
    if k == 1:
        return F.array_min(F.transform(options, lambda o: o["far"]))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("double").alias("far"))

    def add(held: Column, o: Column) -> Column:
        far = F.when(held["rows"] >= k, held["far"]).otherwise(o["far"])
        return F.struct((held["rows"] + o["rows"]).alias("rows"), far.alias("far"))

    return F.aggregate(F.array_sort(options), start, add, lambda held: F.when(held["rows"] >= k, held["far"]))


def _follow(frontier: DataFrame, points: DataFrame, n_large: int, k: int, options: NearestOptions) -> DataFrame:
    """Replace split boxes on the frontier by the children that may hold one of the ``k`` nearest neighbours."""
    rows = F.count(F.lit(1)).alias("rows")
    boxes = points.filter(F.col("_parent").isNotNull()).groupBy("_parent", "_node").agg(*_bounds(), rows)
    box = F.struct(F.col("_node").alias("node"), *[f"{n}{a}" for a in AXES for n in ("low", "high")], "rows")
    children = boxes.groupBy(F.col("_parent").alias("_node")).agg(F.collect_list(box).alias("_children"))
    if n_large * options.split_per_axis**3 <= options.max_broadcast_rows:
        joined = frontier.join(F.broadcast(children), "_node", "left")
    else:
        joined = salted_join(frontier, children, ["_node"], "_x", "left", options.max_left_rows)

    def measure(child: Column) -> Column:
        near, far = _box_distances(child)
        return F.struct(far.alias("far"), child["rows"].alias("rows"), near.alias("near"), child["node"].alias("node"))

    unsplit = F.array(F.struct(
        F.col("_bound").alias("far"), F.lit(k).cast("long").alias("rows"), F.col("_gap").alias("near"),
        F.col("_node").alias("node")))
    measured = joined.withColumn("_options", F.coalesce(F.transform("_children", measure), unsplit))
    bounded = measured.withColumn("_bound", F.least(F.col("_bound"), _reached(F.col("_options"), k) + F.lit(SLACK)))
    kept = F.filter("_options", lambda o: o["near"] <= F.col("_bound") + F.lit(SLACK))
    exploded = bounded.withColumn("_option", F.explode(kept))
    tight = F.min("_bound").over(Window.partitionBy(*PLACE))
    return (
        exploded.withColumn("_bound", tight)
        .filter(F.col("_option.near") <= F.col("_bound") + F.lit(SLACK))
        .select(
            *PLACE,
            "_sin",
            "_cos",
            *AXES,
            "_bound",
            F.col("_option.near").alias("_gap"),
            F.col("_option.node").alias("_node"),
        )
    )
