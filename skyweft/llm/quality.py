"""Quality rules with adaptive thresholds.

Fixed base rules come first. Beyond them a document is judged against its own
language and source: for every measure a mergeable quantile sketch is kept per
language and source, and a document outside the far fences, quartiles plus or
minus ``FENCE`` times the distance between them, is dropped.

The sketch counts values in steps that grow with the value by ``GROWTH``, so a
quantile is right to that relative error; it is a plain table of counts, merged
by adding, exact in any order. Groups with fewer than ``LEAST_ROWS`` documents use
the merged sketch of their language, and small languages that of all documents.
Everything is built from DataFrame functions.

Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources are groups like any other; repeated rows count each for
itself and get equal verdicts; no documents give no rows; a table in which no
document passes the base rules has no sketch and nothing more to judge. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.llm.common import land

GROWTH = 1.02
FENCE = 4.0
LEAST_ROWS = 50
#: Measures and the least width of their fences, in steps of the measure itself.
MEASURES = {"word_length": 1.0, "symbol_share": 0.1, "dup_line_share": 0.3, "repeat_share": 0.2}
SEPARATORS = r"[\x20\x09-\x0D]+"


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    All inside one row: windows of three words are compared by a 64-bit hash,
    sorted with their places, so equal ones are neighbours.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", "lang", "source", text.alias("_text"))
    step = step.select(
        "doc_id", "lang", "source",
        F.filter(F.split("_text", SEPARATORS), lambda w: w != "").alias("_words"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    step = step.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _sorted_windows(F.col("_words")).alias("_windows"),
    )
    return step.select(*[c for c in step.columns if c != "_windows"], _places(F.col("_windows")).alias("_places")).select(
        *[c for c in step.columns if c != "_windows"], _covered(F.col("_places")).alias("n_repeat_words")
    )


def _sorted_windows(words: Column) -> Column:
    """(hash, place) of every window of three words, sorted."""
    hashes = F.zip_with(
        F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(words, 3, F.greatest(F.size(words), F.lit(1))),
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
    )
    whole = F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(F.transform(whole, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _places(windows: Column) -> Column:
    """Sorted places of the windows that are found twice or more."""
    repeated = F.filter(
        windows,
        lambda w, i: (F.get(windows, i - 1)["h"] == w["h"]).eqNullSafe(True) | (F.get(windows, i + 1)["h"] == w["h"]).eqNullSafe(True),
    )
    return F.sort_array(F.transform(repeated, lambda w: w["i"]))


def _covered(places: Column) -> Column:
    """How many words lie in windows at the given sorted places."""
    return F.aggregate(
        F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(places, i + 1) - p), F.lit(3))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )


def _step(value: Column) -> Column:
    """Number of the sketch's step that holds a value >= 0; 0 itself is step -1000."""
    return F.when(value <= 0, F.lit(-1000)).otherwise(
        F.floor(F.round(F.log(value) / F.log(F.lit(GROWTH)), 6))).cast("int")


def _value(step: Column) -> Column:
    """Middle of a step."""
    return F.when(step == -1000, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), step + F.lit(0.5)))


def with_measures(measured: DataFrame) -> DataFrame:
    """Add base_failed and the shares that the fences look at."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return measured.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "word_length": per_word("word_chars"),
        "symbol_share": per_word("n_symbols"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": per_word("n_repeat_words"),
    })


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, step, n): the counts of every group's values."""
    values = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), _step(F.col(m)).alias("step")) for m in MEASURES
    ])).alias("_v")
    return (
        measured.filter(~F.col("base_failed")).select("lang", "source", values)
        .groupBy("lang", "source", "_v.measure", "_v.step").agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, by: list[str], mark: str) -> DataFrame:
    """Low and high fence of every measure by group, in columns; groups that are too small are left out."""
    keys = [*by, "measure"]
    merged = sketch.groupBy(*keys, "step").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({
        "upto": F.sum("n").over(up_to), "total": F.sum("n").over(Window.partitionBy(*keys))})
    quartile = lambda q: _value(F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("step"))))
    quartiles = ranked.groupBy(*keys).agg(
        quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("total").alias("total")
    ).filter(F.col("total") >= (LEAST_ROWS if by else 1))
    cells = []
    for m, width in MEASURES.items():
        reach = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(width))
        own = F.col("measure") == m
        cells += [F.max(F.when(own, F.col("q1") - reach)).alias(f"{mark}_low_{m}"),
                  F.max(F.when(own, F.col("q3") + reach)).alias(f"{mark}_high_{m}")]
    return quartiles.groupBy(*by).agg(*cells)


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join in which nulls are equal."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, same, "left").drop(*[f"_r_{c}" for c in by])


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the four base counts, base_failed, kept, and the shares judged."""
    measured = land(with_measures(text_measures(docs)))
    sketch = land(sketches(measured))
    judged = _joined(measured, _fences(sketch, ["lang", "source"], "s"), ["lang", "source"])
    judged = _joined(judged, _fences(sketch, ["lang"], "l"), ["lang"])
    judged = judged.join(F.broadcast(_fences(sketch, [], "a")), how="left")  # one row
    inside = ~F.col("base_failed")
    for m in MEASURES:
        pick = lambda side, m=m: F.coalesce(*[F.col(f"{mark}_{side}_{m}") for mark in "sla"])
        inside &= F.coalesce(F.col(m).between(pick("low"), pick("high")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", inside.alias("kept"), *MEASURES,
    )
