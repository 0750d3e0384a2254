"""Shards of nearly equal bytes by histogram sort.

Every row has a key: 31 bits of the hash of its text, then bits of the hashes of
its doc_id and of its place in the input. Equal texts so stand together, yet even a
third of all rows with one text and one doc_id can be cut. Keys and sizes are written
once. Then rounds of counting find the cuts between shards: probes are laid evenly
over the key space, one aggregation counts the exact bytes and rows between
neighbouring probes over all partitions, and the next round lays new probes inside
those intervals alone that need them:

* an interval that holds a cut whose target is further than ``TOLERANCE`` of a shard
  from the bytes below either of its ends;
* an interval with more rows or bytes than one task should order, as a text that is
  copied a million times makes.

An interval of a single key is not refined; a cut in it goes to its nearer end. What
the driver sees of a round is bounded by the numbers of shards and parts, not by rows.

Then rows are exchanged once, to parts: runs of neighbouring intervals within a shard.
The histogram says how many rows of the shard come before each part, so a row's slot
is known from its part alone, and no task orders a whole shard.

Defined cases: a null text counts as empty, with 0 bytes, and stays null; a null doc_id
is a doc_id like others; repeated rows are placed each for itself; an empty table gives
no rows; other columns are carried along, whatever their names. With fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.llm.common import land

SHARDS = 24
#: Bytes of every row beside its text.
ROW_BYTES = 8
#: Deviation of a cut from its target, as a share of a shard.
TOLERANCE = 1e-4
#: Rows and bytes that a part should hold, and the number of parts above which it holds more.
PART_ROWS, PART_BYTES, PARTS = 250_000, 16 << 20, 1024
#: Key bits, those that the first round tells apart, and those of each later one.
KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 12, 8


def _table(values: list[int], kind: str = "int") -> Column:
    """A constant array, written as text because a column for each element would be slow to build."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass
class Level:
    """Intervals of one round. ``opened`` names the next round's node of an interval, -1 for those that stay whole."""

    bits: int
    shift: int
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)
    opened: list[int] = field(default_factory=list)

    def child(self) -> Column:
        return F.shiftright(F.col("_key"), self.shift).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


@dataclass
class Histogram:
    """Bytes and rows between probes, finer where cuts and crowds are."""

    levels: list[Level]

    def leaves(self, depth: int = 0, node: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(level, interval, bytes, rows) of every interval that was not refined, by key."""
        level = self.levels[depth]
        for child in range(1 << level.bits):
            at = (node << level.bits) + child
            if level.opened[at] >= 0:
                yield from self.leaves(depth + 1, level.opened[at])
            else:
                yield depth, at, *level.counts.get(at, (0, 0))


def _interval(levels: list[Level]) -> Column:
    """Interval of the last level that ``_key`` lies in; negative or null where an earlier level holds it whole."""
    at = levels[0].child()
    for above, level in zip(levels, levels[1:], strict=False):
        node = F.get(_table(above.opened), at)  # -1 where it stays whole, null below 0
        at = F.shiftleft(node, level.bits) + level.child()
    return at


def count_histogram(keyed: DataFrame, shards: int, tolerance: float, part_rows: int, parts: int = PARTS) -> Histogram:
    """Histogram of a table (_key from 0 to 2**63 - 1, _size) that is fine enough for its cuts and parts."""
    levels: list[Level] = []
    bytes_before: dict[int, int] = {0: 0}  # of every node of the round
    while True:
        bits = min(FIRST_BITS if not levels else NEXT_BITS, levels[-1].shift if levels else KEY_BITS)
        level = Level(bits, (levels[-1].shift if levels else KEY_BITS) - bits)
        levels.append(level)
        counted = keyed.select(_interval(levels).alias("_at"), "_size").filter("_at >= 0")
        rows = counted.groupBy("_at").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        level.counts = {r["_at"]: (r["size"], r["n"]) for r in rows}
        if len(levels) == 1:
            total, n_rows = (sum(c[i] for c in level.counts.values()) for i in (0, 1))
            targets, allowed = [total * (i + 1) / shards for i in range(shards - 1)], tolerance * total / shards
            crowd, heavy = max(part_rows, -(-n_rows // parts)), max(PART_BYTES, -(-total // parts))
        level.opened = [-1] * (len(bytes_before) << bits)
        below, inside = bytes_before, {}
        for node, before in below.items():
            for child in range(1 << bits):
                at = (node << bits) + child
                size, n = level.counts.get(at, (0, 0))
                cut = any(before < t < before + size and min(t - before, before + size - t) > allowed for t in targets)
                if level.shift and n > 1 and (cut or n > crowd or size > heavy):
                    level.opened[at] = len(inside)
                    inside[len(inside)] = before
                before += size
        if not inside:
            return Histogram(levels)
        bytes_before = inside


@dataclass
class Plan:
    """Where every interval goes: its part, and each part's shard and rows before it in that shard."""

    part_of: list[list[int]]
    shard_of: list[int]
    before: list[int]


def plan_parts(histogram: Histogram, shards: int, part_rows: int, parts: int = PARTS) -> Plan:
    """Cuts at the ends of intervals that are nearest to the targets, and parts of a bounded number of rows."""
    leaves = list(histogram.leaves())
    total, n_rows = sum(leaf[2] for leaf in leaves), sum(leaf[3] for leaf in leaves)
    full, heavy = max(part_rows, -(-n_rows // parts)), max(PART_BYTES, -(-total // parts))
    plan = Plan([[-1] * len(level.opened) for level in histogram.levels], [], [])
    shard, below, in_shard, in_part, part_start = 0, 0, 0, 0, 0
    for depth, at, size, n in leaves:
        # A cut stands before this interval if its target is nearer to the bytes below it than to those with it.
        while shard + 1 < shards and 2 * total * (shard + 1) <= shards * (2 * below + size):
            shard += 1
            in_shard = 0
        if not plan.shard_of or plan.shard_of[-1] != shard or in_part + n > full or below + size - part_start > heavy:
            plan.shard_of.append(shard)
            plan.before.append(in_shard)
            in_part, part_start = 0, below
        plan.part_of[depth][at] = len(plan.shard_of) - 1
        below, in_shard, in_part = below + size, in_shard + n, in_part + n
    return plan


def key_of(row: Column) -> Column:
    """Key of a document from its text, doc_id and number ``row``."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))
    doc = F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 20) - 1))
    salt = F.xxhash64(row, F.lit(2)).bitwiseAND(F.lit((1 << 12) - 1))
    return F.shiftleft(text, 32).bitwiseOR(F.shiftleft(doc, 12)).bitwiseOR(salt)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``size``, ``shard`` and ``slot``, its place there by key."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(row_bytes)
    keyed = land(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        key_of(F.monotonically_increasing_id()).alias("_key"), size.alias("_size")))
    return shard_by_key(keyed, shards, tolerance, part_rows).withColumnRenamed("_size", "size")


def shard_by_key(
    keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS
) -> DataFrame:
    """``keyed`` without its _key, with ``shard`` and ``slot``; it is read several times, so it should be landed."""
    histogram = count_histogram(keyed, shards, tolerance, part_rows)
    plan = plan_parts(histogram, shards, part_rows)
    levels = histogram.levels
    parts = [F.get(_table(own), _interval(levels[: depth + 1])) for depth, own in enumerate(plan.part_of)]
    part = F.greatest(*parts, F.lit(-1))  # one level alone gives a part
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    placed = keyed.withColumn("_part", part).withColumn("_place", place)
    slot = F.get(_table(plan.before, "long"), F.col("_part")) + F.col("_place") - 1
    carried = [c for c in keyed.columns if c != "_key"]
    return placed.select(*carried, F.get(_table(plan.shard_of), F.col("_part")).alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, ``_shard=N``; rows carry their ``_slot``."""
    rows = sharded.select("row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    rows.write.partitionBy("_shard").parquet(path)
