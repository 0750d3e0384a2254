"""Language identification with word-first backoff.

Words are runs of letters, lower-cased. A word that the model knows scores its
log frequency in each language; an unseen one falls back to the longest of its
character n-grams (4, 3, 2, 1) that the model knows, at least one, and scores
their mean. A text takes the language with the highest sum.

The model is fitted on a bounded sample of labelled rows and itself bounded: of each
language the ``SAMPLE_ROWS`` rows with the smallest hashes of doc_id and text, or all
rows where there are fewer, and per language about the ``MODEL_WORDS`` most frequent words
and ``MODEL_GRAMS`` most frequent n-grams of each length; of the last that are equally
frequent, a hash tells which. A row that is repeated with the
same doc_id, text and language teaches once, so the bound holds whatever repeats.
Every text is judged whole.

Defined cases: null texts and texts without letters give ``und`` with score 0, as
does everything when there is no labelled row; equal sums go to the smaller
language by code point; rows with a null doc_id or a null language teach nothing;
repeated rows are judged each for itself; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.llm.common import land, map_slices, prepare

#: Rows of each language.
SAMPLE_ROWS = 20_000
#: So much more than the sample is drawn by share, before the smallest hashes are told apart.
DRAWN = 1.5
MODEL_WORDS = 20_000
MODEL_GRAMS = 5_000
GRAMS = (4, 3, 2, 1)
#: Words whose scores a task remembers, and their length.
REMEMBERED, LONGEST_KNOWN = 400_000, 64
#: Words of a text whose scores are looked up together.
AT_ONCE = 50_000
#: Different units that a task sums up before it hands them on.
HELD_UNITS = 300_000
UNKNOWN = "und"
#: A posterior over more words than this says no more than one over so many.
WEIGHED_WORDS = 30

_all_letters = regex.compile(r"\p{L}+").findall
#: In Latin text without superscripts and fractions these are the same runs, found faster.
_latin_letters = re.compile(r"[^\W\d_]+").findall
_beyond_latin = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


def letters(text: str) -> list[str]:
    """Runs of letters of a lower-cased text."""
    return _all_letters(text) if _beyond_latin(text) else _latin_letters(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that is never learned from."""
    key = F.col(doc_id).cast("string").cast("binary")
    return F.coalesce(F.crc32(key) % 4 == 2, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def _handed_on(counts: Counter) -> pa.RecordBatch:
    """Rows (lang, size, unit, n) of what a task has counted so far, which it then forgets."""
    langs, sizes, units = zip(*counts, strict=True) if counts else ((), (), ())
    columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(units, pa.string()),
               pa.array(counts.values(), pa.int64())]
    counts.clear()
    return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "unit", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words (size 0) of labelled texts, summed up within a task as far as it can hold them."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update(zip(itertools.repeat(lang), itertools.repeat(0), letters(text.lower()), strict=False))
            if len(counts) > HELD_UNITS:
                yield _handed_on(counts)
    yield _handed_on(counts)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams from counted words."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for size in GRAMS:
                for gram in grams_of(word, size):
                    counts[lang, size, gram] += n
            if len(counts) > HELD_UNITS:
                yield _handed_on(counts)
    yield _handed_on(counts)


class LanguageModel:
    """Log frequencies of words and n-grams: a row of ``scores`` with one number per language for each."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({row[0] for row in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.units: dict[tuple[int, str], int] = {}
        for _, size, unit, _ in rows:
            self.units.setdefault((size, unit), len(self.units))
        kinds = Counter(size for size, _ in self.units)
        whole = {
            size: np.log([totals.get((lang, size), 0) + 0.5 * kinds[size] for lang in self.langs]) for size in kinds
        }
        counts = np.zeros((len(self.units), len(self.langs)))
        for lang, size, unit, n in rows:
            counts[self.units[size, unit], place[lang]] = n
        self.scores = np.log(counts + 0.5)
        for (size, _), at in self.units.items():
            self.scores[at] -= whole[size]

    def known_units(self, word: str) -> list[int]:
        """The word itself, or else its longest n-grams that are known; their mean is the word's score."""
        get = self.units.get
        known = get((0, word))
        if known is not None:
            return [known]
        for size in GRAMS:
            found = [at for g in grams_of(word, size) if (at := get((size, g))) is not None]
            if found:
                return found
        return []

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words, one row each; none where not even a letter is known."""
        known = [self.known_units(word) for word in words]
        sizes = np.array([len(units) for units in known])
        out = np.zeros((len(words), len(self.langs)))
        if sizes.any():
            starts = np.cumsum(sizes) - sizes
            flat = np.fromiter(itertools.chain.from_iterable(known), np.int64, int(sizes.sum()))
            some = sizes > 0
            out[some] = np.add.reduceat(self.scores[flat], starts[some], axis=0) / sizes[some, None]
        return out


class Judge:
    """Applies a model; remembers the scores of words seen."""

    def __init__(self, model: LanguageModel):
        self.model, self.places = model, {}
        self.scores = np.zeros((REMEMBERED, len(model.langs)))

    def _sum(self, words: list[str]) -> np.ndarray:
        """Sum of the scores of no more words than are remembered."""
        places = self.places
        new = [w for w in dict.fromkeys(words) if w not in places]
        if new:
            if len(places) + len(new) > REMEMBERED:
                places.clear()
                new = list(dict.fromkeys(words))
            long = [w for w in new if len(w) > LONGEST_KNOWN]
            if long:  # scored, but not remembered
                kept = [w for w in words if len(w) <= LONGEST_KNOWN]
                extra = self.model.words([w for w in words if len(w) > LONGEST_KNOWN]).sum(axis=0)
                return extra + self._sum(kept) if kept else extra
            self.scores[len(places) : len(places) + len(new)] = self.model.words(new)
            places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
        return self.scores.take(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), axis=0).sum(axis=0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letters(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        step = min(AT_ONCE, REMEMBERED)
        total = sum(self._sum(words[start : start + step]) for start in range(0, len(words), step))
        best = int(np.argmax(total))
        weighed = (total - total[best]) * min(1.0, WEIGHED_WORDS / len(words))
        return self.model.langs[best], 1.0 / float(np.exp(weighed).sum())


def _sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, text) of each language's ``sample_rows`` different rows with the smallest hashes, or of all it has."""
    space = 1 << 62
    keyed = labelled.withColumn("_key", F.pmod(F.xxhash64("doc_id", "text"), F.lit(space)))
    keys = land(keyed.select("lang", "_key"))
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("_key", 0.02).alias("_rows"))
    # All rows of a language that has hardly more than the share would draw, which 2 % of error cannot hide.
    below = F.when(F.col("_rows") <= DRAWN * sample_rows, F.lit(space)).otherwise(
        F.floor(F.lit(DRAWN * sample_rows * space) / F.col("_rows"))).cast("long")
    drawn = keys.join(sizes.select("lang", below.alias("_below")), "lang").filter(F.col("_key") < F.col("_below"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_key"))
    least = drawn.select("lang", "_key").distinct().withColumn("_at", place).filter(F.col("_at") <= sample_rows)
    last = land(least.groupBy("lang").agg(F.max("_key").alias("_last")))
    taken = keyed.join(last, "lang").filter(F.col("_key") <= F.col("_last")).select("lang", "_key", "text")
    # Only texts of rows that are repeated have to meet.
    again = keys.join(last, "lang").filter(F.col("_key") <= F.col("_last")).groupBy("lang", "_key").count()
    again = land(again.filter(F.col("count") > 1).select("lang", "_key"))
    if again.isEmpty():
        return taken.select("lang", "text")
    once = taken.join(again, ["lang", "_key"], "left_semi").groupBy("lang", "_key").agg(F.min("text").alias("text"))
    return taken.join(again, ["lang", "_key"], "left_anti").select("lang", "text").union(once.select("lang", "text"))


def _most_frequent(units: DataFrame) -> DataFrame:
    """Of each language and size the units of the counts that fit its bound, and by hash as many of the next as still do.

    What is ordered are the different counts of a language and size, not its units.
    """
    bound = F.when(F.col("size") == 0, MODEL_WORDS).otherwise(MODEL_GRAMS)
    sizes = units.groupBy("lang", "size", "n").agg(F.count(F.lit(1)).alias("_same"))
    down = Window.partitionBy("lang", "size").orderBy(F.desc("n"))
    above = F.coalesce(F.sum("_same").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = (bound - above) / F.col("_same")
    kept = sizes.withColumn("_share", share).filter(F.col("_share") > 0).select("lang", "size", "n", "_share")
    chance = F.pmod(F.xxhash64("unit"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return units.join(kept, ["lang", "size", "n"]).filter(chance < F.col("_share")).select("lang", "size", "unit", "n")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Model from the rows that are not held out, at most ``sample_rows`` of each language."""
    prepare(docs.sparkSession)
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    sample = _sample(docs.select("doc_id", "text", "lang").filter(usable), sample_rows)
    unit = "lang string, size int, unit string, n long"
    words = land(sample.mapInArrow(_word_counts, unit).groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")))
    grams = words.select("lang", "unit", "n").mapInArrow(_gram_counts, unit).groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
    units = land(words.unionByName(grams))
    totals = units.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()
    rows = _most_frequent(units).collect()
    return LanguageModel(
        [(r.lang, r.size, r.unit, r.n) for r in rows], {(r.lang, r.size): r.total for r in totals}
    )


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by MODEL_WORDS and MODEL_GRAMS per language
    judges: list[Judge] = []

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not judges:
            judges.append(Judge(shared.value))
        found = [judges[0](text) for text in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()),
             pa.array([x for _, x in found], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_slices(
        docs.select("doc_id", held_out().alias("held_out"), "text"), judged,
        "doc_id long, held_out boolean, lang_pred string, score double",
    )
