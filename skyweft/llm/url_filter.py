"""URL filter: rules first, else a ratio of character language models.

Rules of host and path judge the urls they fit. From those urls two smoothed
models of variable order are learned, one of accepted and one of rejected urls:
the probability of a character after the last ``ORDER`` ones blends all shorter
contexts, each with a weight that depends on how many different characters
followed it. A url that no rule fits is blocked where the difference of the log
likelihoods per character lies above a threshold, calibrated on labelled urls
that the models have not seen.

All urls that a rule fits are learned from, whole and at any length, but each
different url once, so one that fills much of the table says no more than others.
Only the longest contexts are counted; shorter ones are their sums. A character after
a context stays in the model if it makes up at least one in ``LEAST_SHARE`` of its
verdict's characters, at every size of table; rarer ones are left to the shorter
contexts. So a model has at most ``LEAST_SHARE`` entries for each context length.
Every url is judged whole.

Defined cases: a null url and one without ``://`` have an empty host and path; no
rule fits them; a url without characters says nothing and is allowed, and so is
every unfit url where one class has no labelled urls. Equal urls get equal
verdicts; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyweft.llm.common import land, map_slices, prepare

ORDER = 4
LEAST_SHARE = 200_000
#: A task hands its counts on when they are so many, and looks at so many characters before it asks.
COUNTED_TOGETHER, COUNTED_BETWEEN = 500_000, 100_000
REMEMBERED = 300_000
START, END = "\x02", "\x03"
CHARACTERS = 256
#: Allowed and blocked urls are weighed equally when the threshold is set, to steps of this size.
STEP = 0.01

# The rules of the production filter.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path, both empty where there is no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(verdict, gram, count) of labelled urls; a gram is a longest context and the character after it."""
    counts: dict[str, Counter] = {}

    def counted() -> pa.RecordBatch:
        rows = [(verdict, gram, n) for verdict, own in counts.items() for gram, n in own.items()]
        counts.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        types = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["verdict", "gram", "n"])

    for batch in batches:
        for verdict, url in zip(batch.column(0), batch.column(1), strict=True):
            text = START * ORDER + url.as_py() + END
            for start in range(0, len(text) - ORDER, COUNTED_BETWEEN):
                places = range(start, min(start + COUNTED_BETWEEN, len(text) - ORDER))
                counts.setdefault(verdict.as_py(), Counter()).update(text[at : at + ORDER + 1] for at in places)
                if sum(map(len, counts.values())) >= COUNTED_TOGETHER:
                    yield counted()
    yield counted()


class CharacterModel:
    """Witten-Bell blend of all context lengths up to ``ORDER``, down to an even chance over all characters."""

    def __init__(self, grams: dict[tuple[str, str], int]):
        self.grams = grams
        self.seen: Counter = Counter()
        self.kinds: Counter = Counter()
        for (context, _), n in grams.items():
            self.seen[context] += n
            self.kinds[context] += 1

    def chance(self, context: str, char: str) -> float:
        chance = 1.0 / CHARACTERS
        for size in range(len(context) + 1):
            shorter = context[len(context) - size :]
            seen = self.seen.get(shorter)
            if not seen:
                break
            kinds = self.kinds[shorter]
            chance = (self.grams.get((shorter, char), 0) + kinds * chance) / (seen + kinds)
        return chance


class UrlRatio:
    """Log likelihood difference per character, rejected minus accepted."""

    def __init__(self, accepted: CharacterModel, rejected: CharacterModel):
        self.accepted, self.rejected = accepted, rejected
        self.known: dict[str, float] = {}

    def __call__(self, url: str | None) -> float | None:
        if not url:
            return None
        text, total = START * ORDER + url + END, 0.0
        for at in range(ORDER, len(text)):
            gram = text[at - ORDER : at + 1]
            ratio = self.known.get(gram)
            if ratio is None:
                ratio = math.log(
                    self.rejected.chance(gram[:-1], gram[-1]) / self.accepted.chance(gram[:-1], gram[-1])
                )
                if len(self.known) < REMEMBERED:
                    self.known[gram] = ratio
            total += ratio
        return total / (len(url) + 1)


def _models(urls: DataFrame) -> dict[str, CharacterModel]:
    """The model of each verdict that has urls. ``urls``: (verdict, url), to be learned once each."""
    grams = urls.mapInArrow(_grams, "verdict string, gram string, n long")
    grams = land(grams.groupBy("verdict", "gram").agg(F.sum("n").alias("n")))
    totals = {r.verdict: r.n for r in grams.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # two verdicts
    least = F.lit(0)
    for verdict, total in totals.items():
        least = F.when(F.col("verdict") == verdict, -(-total // LEAST_SHARE)).otherwise(least)
    size = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("size")
    parts = grams.select("verdict", "gram", "n", size).groupBy(
        "verdict", F.expr(f"substring(gram, {ORDER + 1} - size, size)").alias("context"),
        F.expr(f"substring(gram, {ORDER + 1}, 1)").alias("next"))
    kept = parts.agg(F.sum("n").alias("n")).filter(F.col("n") >= least)  # bounded by LEAST_SHARE
    counts: dict[str, dict] = {verdict: {} for verdict in totals}
    for batch in kept.toArrow().to_batches():
        for verdict, context, char, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            counts[verdict][context, char] = n
    return {verdict: CharacterModel(own) for verdict, own in counts.items()}


def fit(labelled: DataFrame) -> tuple[UrlRatio, float] | None:
    """Models and threshold from (verdict, url) rows; None where a verdict has no urls to learn from.

    Four of five different urls teach, the fifth sets the threshold: the one with
    the fewest errors, both verdicts weighed equally, nearest to 0 among equals.
    """
    prepare(labelled.sparkSession)
    urls = land(labelled.filter(F.length("url") > 0).select("verdict", "url").distinct())
    fifth = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)) == 0
    models = _models(urls.filter(~fifth))
    if models.keys() != {"allow", "block"}:
        return None
    ratio = UrlRatio(models["allow"], models["block"])
    place = F.floor(F.col("ratio") / STEP)
    held = scored(urls.filter(fifth), ratio).groupBy("verdict", place.alias("place")).count().collect()
    return ratio, best_threshold([(r.verdict, r.place, r["count"]) for r in held])


def best_threshold(places: list[tuple[str, int, int]]) -> float:
    """Edge between steps with the least sum of both error shares."""
    total = Counter()
    for verdict, _, n in places:
        total[verdict] += n
    edges = sorted({0, *(p for _, p, _ in places), *(p + 1 for _, p, _ in places)}, key=lambda p: (abs(p), p))

    def errors(edge: int) -> float:
        wrong = Counter()
        for verdict, place, n in places:
            if (place >= edge) != (verdict == "block"):
                wrong[verdict] += n
        return sum(wrong[v] / total[v] for v in wrong)

    return min(edges, key=errors) * STEP


def scored(urls: DataFrame, ratio: UrlRatio) -> DataFrame:
    """Add ``ratio`` to a table with a column ``url``; null where the url has no characters."""
    shared = urls.sparkSession.sparkContext.broadcast(ratio)  # bounded by LEAST_SHARE
    place = urls.columns.index("url")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [shared.value(url) for url in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "ratio"]
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return map_slices(urls, score, f"{schema}, ratio double")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page. Only page_id and url are read."""
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.select("*", rule.alias("rule"), says.alias("says"))
    fitted = fit(ruled.filter(F.col("says").isNotNull()).select(F.col("says").alias("verdict"), "url"))
    if fitted is None:
        judged = ruled.withColumn("ratio", F.lit(None).cast("double"))
        by_method = F.lit("allow")
    else:
        judged = scored(ruled, fitted[0])
        by_method = F.when(F.col("ratio") >= fitted[1], "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", by_method).alias("verdict"), "ratio")
