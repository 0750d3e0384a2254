"""Best-fit packing by minimum bin slack.

Lengths are whole numbers up to the capacity, so a table of how many pieces
have each length, at most ``capacity`` rows however large the corpus is, says all
there is to know for packing. On it, bin after bin is filled with the fullest
combination that a bitset subset-sum finds; the same combination is taken as
often as the counts allow. Pieces then take the places of their length in
parallel, by their rank among the pieces of that length.

Defined cases: a null text is an empty document and still has its end token;
repeated rows are packed each for itself, and rows that share one doc_id, null
included, are ranked in parallel like others; no documents give no rows; other columns
of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyweft.llm.common import land, map_slices, prepare, spread
from skyweft.llm.tokens import PIECE_SCHEMA, pieces_of

CAPACITY = 2048
RANKED_TOGETHER = 256


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    return map_slices(
        docs.select("doc_id", "text"), lambda batch: pieces_of(batch, tokenizer_path, capacity, end_id), PIECE_SCHEMA
    )


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, each used at most as often as ``counts`` has it, whose sum is the largest that fits in ``room``.

    Bit s of ``reached`` says that sum s can be made. Longer lengths come first,
    and the search ends as soon as the room can be filled to the last place.
    """
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            new = (reached << length) & mask & ~reached
            if not new:
                break
            steps.append((length, new))
            reached |= new
        if reached >> room:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, new in reversed(steps):
        if new >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(how many bins, copies of each length in such a bin). Each bin has the longest length left."""
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(capacity - longest, left)]
        left[longest] += 1
        used = {length: chosen.count(length) for length in chosen}
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
        yield times, used


def _places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted by length and rank."""
    rows, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for times, used in minimum_slack(counts, capacity):
        offset = 0
        for length, n in used.items():
            rows.append((length, ranks[length], sequence, n, offset))
            ranks[length] += times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(batch: pa.RecordBatch, places: np.ndarray) -> pa.RecordBatch:
    length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
    rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
    key = lambda lengths, ranks: lengths * (1 << 44) + ranks
    found = places[np.searchsorted(key(places[:, 0], places[:, 1]), key(length, rank), side="right") - 1]
    turn, copy = np.divmod(rank - found[:, 1], found[:, 3])
    kept = [name for name in batch.schema.names if name != "_rank"]
    columns = [batch.column(batch.schema.get_field_index(name)) for name in kept]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(found[:, 2] + turn), pa.array(found[:, 4] + copy * length)],
        names=[*kept, "sequence_id", "offset"],
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, number: str = "_number") -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (length, ``number`` and what else it carries).

    ``number`` tells the rows apart and goes. A length that very many pieces share is
    dealt by it over parts of about ``RANKED_TOGETHER`` pieces, so ranking never
    gathers a length in one task, nor the pieces of one doc_id.
    """
    spark = pieces.sparkSession
    prepare(spark)
    counts = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(counts, capacity))  # bounded by the combinations of lengths
    parts = spark.createDataFrame(
        [(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()], "length long, _parts long"
    )
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_part", spread([number], F.col("_parts")))
    before = (
        dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(
            Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .drop("_n")
    )
    order = Window.partitionBy("length", "_part").orderBy(number)
    ranked = (
        dealt.withColumn("_within", F.row_number().over(order) - 1)
        .join(before, ["length", "_part"])
        .select(*[f"`{c}`" for c in pieces.columns if c != number], (F.col("_before") + F.col("_within")).alias("_rank"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema.fields)
    return map_slices(
        ranked, lambda batch: _placed(batch, places.value), f"{schema}, sequence_id bigint, offset bigint", rows=10_000
    )


def packed_ids(packed: DataFrame) -> DataFrame:
    """Sequences with their ids in place: sequence_id, length, ids. ``packed`` has the pieces' ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(F.col("_parts"), F.lit(b"").cast("binary"), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.expr("aggregate(_parts, 0L, (n, x) -> n + x.length)").alias("length"), joined.alias("ids")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * with_ids,
        F.monotonically_increasing_id().alias("_number"),
    )
    return pack_pieces(land(pieces), capacity)
