"""Substring dedup by line hashing.

A text falls into units: lines, and in them sentences. The normalised form of each
line and sentence, lower case with single spaces, has a 128-bit digest. Digests are
grouped globally; the earliest occurrence, by doc_id and then place, is kept. Every
other one is a repeat. A line that stood as a line before is removed whatever its length.
A run of repeated sentences in a row is removed when it has at least ``LEAST_WORDS``
words, so chance equals of a few words stay; in scripts without blanks between words,
characters are counted instead. A text that is nothing but repeats of fewer words than
that stays: it is a short document, not a line of one. Removed runs are given as
character ranges of the original text.

Defined cases: a null text stays null and an empty one empty; units without words
are never repeats and belong to the run around them; rows with a null doc_id rank
last; rows with the same doc_id, null included, rank alike, so neither loses what both
have first, and each is cut by what its own text repeats, as rows are told apart by
doc_id and text; no documents give no rows. Columns to carry along may have any other
name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from skyweft.llm.common import map_slices, land, prepare

LEAST_WORDS = 20
#: Between two units: line feeds, or blanks after the end of a sentence, which full-width marks end without a blank
#: and Thai, Lao, Burmese and Khmer letters with one.
_between = re.compile(
    r"\s*\n\s*|(?<=[.!?\u0964\u06d4\u061f\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff])[ \t]+"
    r"|(?<=[\u3002\uff01\uff1f\uff61])(?![\s\u3002\uff01\uff1f\uff61\u300d\u300f\uff09\u201d])|(?<=[\u3002\uff01\uff1f\uff61])[ \t\u3000]+")
_ideographs = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_unspaced = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: Characters that count as a word.
IDEOGRAPHS_A_WORD, UNSPACED_A_WORD = 2, 4
_LAST = (1 << 63) - 1


def units_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end of the unit, end with what follows it) of every unit, in character places."""
    cuts, at = [], 0
    for gap in _between.finditer(text):
        cuts.append((at, gap.start(), gap.end()))
        at = gap.end()
    if at < len(text):
        cuts.append((at, len(text), len(text)))
    return cuts


def digest_of(unit: str) -> tuple[bytes, int]:
    """(digest, number of words) of a unit's normalised form."""
    words = unit.lower().split()
    counted = len(words)
    if not unit.isascii():
        counted = max(counted, len(_ideographs.findall(unit)) // IDEOGRAPHS_A_WORD
                      + len(_unspaced.findall(unit)) // UNSPACED_A_WORD)
    return xxhash.xxh3_128_digest(" ".join(words).encode()), counted


def lines_of(text: str, units: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, behind the last) unit of every line."""
    ends = [n + 1 for n, (_, end, follows) in enumerate(units) if "\n" in text[end:follows] or n + 1 == len(units)]
    return list(zip([0, *ends], ends, strict=False))


def _first_units(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(rank, text's hash, place, line, hi, lo) of each different sentence and line with words, at its first place.

    A line that is one sentence is given once, as a line; one of several sentences has a row beside theirs.
    """
    ranks, keys, places, lines, digests = [], [], [], [], []
    for rank, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        units, seen = units_of(text or ""), set()
        for first, behind in lines_of(text or "", units):
            spans = [(first, units[first][0], units[behind - 1][1], True)]
            if behind - first > 1:
                spans += [(n, units[n][0], units[n][1], False) for n in range(first, behind)]
            for place, start, end, line in spans:
                digest, words = digest_of(text[start:end])
                if words and (digest, line) not in seen:
                    seen.add((digest, line))
                    ranks.append(rank)
                    keys.append(key)
                    places.append(place)
                    lines.append(line)
                    digests.append(digest)
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(ranks, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(lines, pa.bool_()),
         pa.array(both[:, 0]), pa.array(both[:, 1])],
        names=["_rank", "_key", "_place", "_line", "_hi", "_lo"])


def cleaned(
    text: str, repeats: list[int], least_words: int, line_repeats: list[int] | None = None
) -> tuple[str, int, list[tuple[int, int]]]:
    """(text without removed runs, number of units, removed character ranges).

    ``repeats``: places of units, each the first of its kind in this text, that an
    earlier document has. ``line_repeats``: first units of lines that it has as lines.
    """
    units = units_of(text)
    digests = [digest_of(text[start:end]) for start, end, _ in units]
    lines = lines_of(text, units)
    whole = {first: digest_of(text[units[first][0] : units[behind - 1][1]])[0] for first, behind in lines}
    elsewhere = {digests[place][0] for place in repeats}
    lines_elsewhere = {whole[first] for first in line_repeats or []}
    seen: set[bytes] = set()
    lines_seen: set[bytes] = set()
    # Of every unit: whether it is repeated, and whether its whole line is.
    repeated, in_line = [False] * len(units), [False] * len(units)
    for first, behind in lines:
        again = whole[first] in lines_elsewhere or whole[first] in lines_seen
        lines_seen.add(whole[first])
        for n in range(first, behind):
            digest, words = digests[n]
            in_line[n] = again and words > 0
            repeated[n] = words > 0 and (again or digest in elsewhere or digest in seen)
            seen.add(digest)
    words_of = [words for _, words in digests]
    if all(repeated[n] or not words_of[n] for n in range(len(units))) and sum(words_of) < least_words:
        return text, len(units), []
    removed: list[tuple[int, int]] = []
    run: list[int] = []

    def close() -> None:
        """Take the whole run if it has enough words, or else its repeated lines."""
        taken = run if sum(words_of[n] for n in run) >= least_words else [n for n in run if in_line[n]]
        for n in taken:
            if removed and all(not words_of[k] for k in range(place_of[removed[-1][1]], n)):
                removed[-1] = (removed[-1][0], units[n][2])
            else:
                removed.append((units[n][0], units[n][2]))
        if taken and run and taken[-1] == run[-1]:
            behind = run[-1] + 1
            while behind < len(units) and not words_of[behind]:
                behind += 1
            removed[-1] = (removed[-1][0], units[behind - 1][2])

    place_of = {follows: n + 1 for n, (_, _, follows) in enumerate(units)}
    for n in range(len(units)):
        if repeated[n]:
            run.append(n)
        elif words_of[n]:
            close()
            run.clear()
    close()
    kept, at = [], 0
    for start, end in removed:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return "".join(kept) if removed else text, len(units), removed


def dedup_lines(
    docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, report: bool = True
) -> DataFrame:
    """The columns ``carry`` with the cleaned text, where they name it or else after them.

    With ``report`` come _n_units and _removed, an array of (start, end), as well.
    """
    prepare(docs.sparkSession)
    # Rows of one doc_id and text have the same units, so they may share what is said about them.
    row = [F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("_rank"), F.xxhash64("text").alias("_key")]
    units = land(map_slices(
        docs.select(*row, "text"), _first_units, "_rank long, _key long, _place int, _line boolean, _hi long, _lo long"))
    # A sentence repeats what any earlier text holds, a line what one holds as a line.
    first = units.groupBy("_hi", "_lo").agg(
        F.min("_rank").alias("_first"), F.min(F.when(F.col("_line"), F.col("_rank"))).alias("_first_line"),
        F.max("_rank").alias("_other"))
    first = first.filter(F.col("_first") != F.col("_other")).select("_hi", "_lo", "_first", "_first_line")
    repeats = units.join(first, ["_hi", "_lo"]).filter(F.col("_rank") > F.col("_first"))
    as_line = F.col("_line") & (F.col("_rank") > F.col("_first_line"))
    repeats = repeats.groupBy("_rank", "_key").agg(
        F.collect_set("_place").alias("_repeats"), F.collect_set(F.when(as_line, F.col("_place"))).alias("_lines"))
    others = F.struct(*[F.col(f"`{c}`") for c in carry if c != "text"], F.lit(0).alias("_")).alias("_others")
    rows = docs.select(*row, others, "text").join(repeats, ["_rank", "_key"], "left").select("_others", "text", "_repeats", "_lines")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, repeated, lines = (batch.column(n).to_pylist() for n in (1, 2, 3))
        done = [cleaned(t, r or [], least_words, n or []) if t else (t, 0, [])
                for t, r, n in zip(texts, repeated, lines, strict=True)]
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()),
             pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], ranges)],
            names=["_others", "text", "_n_units", "_removed"])

    kept = T.StructType([
        rows.schema["_others"], T.StructField("text", T.StringType()), T.StructField("_n_units", T.IntegerType())])
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.fields)
    done = map_slices(rows, clean, f"{columns}, _removed array<struct<start: int, end: int>>")
    named = [F.col("text") if c == "text" else F.col("_others")[c].alias(c) for c in carry]
    return done.select(*named, *["text"] * ("text" not in carry), *["_n_units", "_removed"] * report)
