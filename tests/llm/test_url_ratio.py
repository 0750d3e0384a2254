"""Url verdicts against a plain count of all contexts."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyweft.llm import url_filter


def chance_by_hand(counts: Counter, context: str, char: str) -> float:
    """Blend from the whole context down, by recursion over ever shorter ones."""
    lower = 1 / 256 if not context else chance_by_hand(counts, context[1:], char)
    after = [n for (before, _), n in counts.items() if before == context]
    return (counts[context, char] + len(after) * lower) / (sum(after) + len(after)) if context == "" or after else lower


def judged_by_hand(rows: list[tuple], folds: dict[str, int], least_share: int) -> tuple[dict[str, float], float]:
    """Ratio of every url and the threshold. ``rows``: (url, verdict of the rules)."""
    counts = {"allow": Counter(), "block": Counter()}
    ruled = {(url, says) for url, says in rows if url and says}
    for url, says in ruled:
        text = "\x02" * 4 + url + "\x03"
        for at in range(4, len(text)) if folds[url] else ():
            counts[says].update((text[at - size : at], text[at]) for size in range(5))
    for says, own in counts.items():
        total = sum(n for (context, _), n in own.items() if context == "")
        counts[says] = Counter({gram: n for gram, n in own.items() if n * least_share >= total})
    known: dict[tuple[str, str], float] = {}

    def ratio(url: str) -> float:
        text, total = "\x02" * 4 + url + "\x03", 0.0
        for at in range(4, len(text)):
            gram = text[at - 4 : at], text[at]
            if gram not in known:
                known[gram] = math.log(chance_by_hand(counts["block"], *gram)) - math.log(chance_by_hand(counts["allow"], *gram))
            total += known[gram]
        return total / (len(url) + 1)

    ratios = {url: ratio(url) for url, _ in rows if url}
    held = [(says, math.floor(ratios[url] / 0.01)) for url, says in ruled if not folds[url]]
    size = Counter(says for says, _ in held)
    errors = {
        edge: sum(1 / size[says] for says, place in held if (place >= edge) != (says == "block"))
        for edge in range(min(p for _, p in held) - 1, max(p for _, p in held) + 2)
    }
    errors.setdefault(0, sum(1 / size[says] for says, place in held if (place >= 0) != (says == "block")))
    return ratios, 0.01 * min(errors, key=lambda edge: (round(errors[edge], 9), abs(edge), edge))


@pytest.mark.parametrize("least_share", [200_000, 400])
def test_ratio_and_threshold_equal_brute_force(spark, monkeypatch, least_share):
    monkeypatch.setattr(url_filter, "LEAST_SHARE", least_share)
    draw = random.Random(7)
    good, bad, other = ["garden", "news", "köln", "library"], ["casino", "win", "free-x", "日本"], ["list", "page"]
    name = lambda words: f"{draw.choice(words)}{draw.choice(other)}{draw.randrange(30)}"
    urls = [f"http://{name(good)}.org/fr/{name(good)}" for _ in range(60)] + [f"http://{name(bad)}.net/{name(bad)}" for _ in range(60)]
    urls += [f"https://{name(good + bad)}.info/{name(good + bad)}?q={draw.randrange(9)}" for _ in range(60)]
    urls += [f"http://{name(bad)}.net/" + name(bad) * 700, None, "", "nothing", "http://one.net/"] + ["http://one.net/"] * 90
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(6)
    folds = {r.url: r.fold for r in frame.select("url", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)).alias("fold")).collect()}
    found = url_filter.filter_urls(frame).collect()
    says = {rule: verdict for verdict, rule in url_filter.RULES}
    ratios, threshold = judged_by_hand([(urls[r.page_id], says.get(r.rule)) for r in found], folds, least_share)
    assert len(found) == len(urls)
    for r in found:
        url = urls[r.page_id]
        assert r.ratio is None if not url else abs(r.ratio - ratios[url]) < 1e-9
        by_ratio = "block" if url and ratios[url] >= threshold else "allow"
        assert r.verdict == says.get(r.rule, by_ratio), url
    assert {"allow", "block"} == {r.verdict for r in found if r.rule is None}


def test_counts_do_not_depend_on_how_they_are_handed_on(monkeypatch):
    urls = [("allow", "http://a.org/" + "abcdefg" * 50), ("block", "x"), ("allow", "日本語")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*urls)], names=["verdict", "url"])

    def counted() -> tuple[Counter, int]:
        given = [b.to_pylist() for b in url_filter._grams(iter([batch, batch]))]
        total = Counter()
        for row in (r for rows in given for r in rows):
            total[row["verdict"], row["gram"]] += row["n"]
        return total, max(map(len, given))

    by_hand = Counter()
    for verdict, url in urls * 2:
        text = "\x02" * 4 + url + "\x03"
        by_hand.update((verdict, text[at : at + 5]) for at in range(len(text) - 4))
    assert counted()[0] == by_hand
    monkeypatch.setattr(url_filter, "COUNTED_TOGETHER", 3)
    monkeypatch.setattr(url_filter, "COUNTED_BETWEEN", 7)
    in_parts, largest = counted()
    assert in_parts == by_hand and largest < 10


def test_one_verdict_alone_allows_the_rest(spark):
    frame = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/"), (None, None), (2, "http://b.com/")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_filter.filter_urls(frame).collect()) == [(0, "allow"), (1, "block"), (2, "allow"), (2, "allow")]
