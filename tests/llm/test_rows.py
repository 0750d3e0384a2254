"""Null and repeated doc_ids, and the pipeline's stages 2 to 4 against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skyweft.llm import line_dedup, mixing, ngram_join, slack_packing
from test_llm_operators import WORD, components_by_hand

LAST = (1 << 63) - 1


def dedup_by_hand(rows: list[tuple[int | None, str | None]]) -> list[str | None]:
    """Cleaned texts; what earlier ranked rows have is told by looking at all of them."""
    seen: dict[tuple[bytes, bool], set[int]] = defaultdict(set)
    units_in = []
    for doc_id, text in rows:
        units, found = line_dedup.units_of(text or ""), {}
        for first, behind in line_dedup.lines_of(text or "", units):
            spans = [(first, units[first][0], units[behind - 1][1], True)]
            spans += [(n, units[n][0], units[n][1], False) for n in range(first, behind)] if behind - first > 1 else []
            for place, start, end, line in spans:
                digest, words = line_dedup.digest_of(text[start:end])
                if words:
                    found.setdefault((digest, line), place)
        units_in.append(found)
        for digest, line in found:
            seen[digest, False].add(LAST if doc_id is None else doc_id)
            if line:
                seen[digest, True].add(LAST if doc_id is None else doc_id)
    out = []
    for (doc_id, text), found in zip(rows, units_in, strict=True):
        rank = LAST if doc_id is None else doc_id
        repeats = [place for (digest, _), place in found.items() if min(seen[digest, False]) < rank]
        lines = [place for (digest, line), place in found.items() if line and min(seen[digest, True]) < rank]
        out.append(line_dedup.cleaned(text, repeats, line_dedup.LEAST_WORDS, lines)[0] if text else text)
    return out


def planted_rows(seed: int) -> list[tuple[int | None, str | None, str | None]]:
    """Copies, near copies, shared passages and lines, with nulls and repeated doc_ids."""
    draw = random.Random(seed)
    words = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(draw.choices(words, k=n)).capitalize() + "."
    passage, line = " ".join(say(12) for _ in range(6)), say(25)
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(40):
        text = "\n".join(say(draw.randint(5, 30)) for _ in range(draw.randint(1, 5)))
        if i % 4 == 0:
            text += "\n" + passage
        if i % 5 == 0:
            text = line + "\n" + text
        rows.append((i, text, draw.choice(["a", "b", "c", None])))
    base = say(150)
    for i in range(40, 48):
        edited = base.split(" ")
        edited[draw.randrange(len(edited))] = f"edit{i}"
        rows.append((i, " ".join(edited), "a"))
    rows += [(i, rows[3][1], "b") for i in range(50, 56)]
    # Rows of one doc_id, or of none, with texts of other lengths; some are copies.
    rows += [(60, "Short.", "a"), (60, "\n".join(say(20) for _ in range(9)), "a"), (60, rows[5][1], "a")]
    rows += [(61, "One line only here.\nTwo lines.", "c"), (61, "One line only here.\nTwo lines.", "c")]
    rows += [(None, say(40) + "\n" + line, "b"), (None, passage, "a"), (None, "\n".join(say(30) for _ in range(4)), None), (None, None, "a")]
    rows += [(None, say(3), "b"), (62, None, None), (63, "", "b")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    rows = planted_rows(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = line_dedup.dedup_lines(frame.withColumn("was", F.col("text")), carry=("doc_id", "was")).collect()
    expected = Counter((r[0], r[1], t) for r, t in zip(rows, dedup_by_hand([r[:2] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.was, r.text) for r in found) == expected
    assert sum(t != w for _, w, t in expected) > 15


def test_two_texts_of_one_doc_id_keep_their_own(spark):
    text = "A sentence that nobody else has, of more than twenty words " * 3
    rows = [(1, "copied " * 30), (5, text), (5, "copied " * 30), (None, text + "."), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.dedup_lines(frame.withColumn("was", F.col("text")), carry=("doc_id", "was")).collect()
    assert {r.was for r in found if r.text == r.was} >= {text, "x"} and {r.was: r.text for r in found if r.doc_id == 5}["copied " * 30] == ""


def linked_by_hand(rows: list[tuple], words: int, percent: int) -> list[int]:
    """Component of every row, named by its first row's place."""
    named = components_by_hand({i: r[1] for i, r in enumerate(rows)}, words, percent)
    return [named[i] for i in range(len(rows))]


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_join_tells_rows_apart(spark, group_rows):
    rows = planted_rows(3)
    rows += [(1, "A b c d e."), (7, "A b c d e."), (7, "Other words than those of one."), (9, "Other words than those of one.")]
    rows = [(r[0], r[1]) for r in rows]
    found = ngram_join.ngram_components(
        spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80, group_rows=group_rows).collect()
    least: dict[int, int | None] = {}
    named = linked_by_hand(rows, 5, 80)
    for (doc_id, _), group in zip(rows, named, strict=True):
        own = least.get(group)
        least[group] = doc_id if own is None else own if doc_id is None else min(own, doc_id)
    expected = Counter((d, max(0, *[len(WORD(t or ""))]) > 0, least[g]) for (d, t), g in zip(rows, named, strict=True))
    assert Counter((r.doc_id, r.n_shingles > 0, r.component_id) for r in found) == expected


def test_stages_equal_plain_python(spark):
    rows = planted_rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit(1) for c in ("row", "_row", "class", "_key", "size")})
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    groups = defaultdict(list)
    for row, group in zip(rows, linked_by_hand(rows, 5, 80), strict=True):
        groups[group].append(row)
    expected = []
    for own in groups.values():
        if not WORD(own[0][1] or ""):
            expected += [(d, t) for d, t, _ in own]
            continue
        first = min((d is None, d or 0) for d, _, _ in own)
        expected.append(next((d, t) for d, t, _ in own if (d is None, d or 0) == first))
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(expected) and len(kept) < len(rows) - 10
    assert kept[0].asDict().keys() == set(docs.columns)

    docs = spark.createDataFrame(kept, docs.schema)
    cleaned = corpus_pipeline.remove_repeated_passages(spark, docs, "").collect()
    rest = [(r.doc_id, r.text) for r in kept]
    by_hand = Counter((d, t) for (d, _), t in zip(rest, dedup_by_hand(rest), strict=True))
    assert Counter((r.doc_id, r.text) for r in cleaned) == by_hand and by_hand != Counter(rest)

    docs = spark.createDataFrame(cleaned, docs.schema)
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    times = Counter((r.doc_id, r.text, r.source) for r in mixed)
    own = Counter((r.doc_id, r.text, r.source) for r in cleaned)
    assert set(times) <= set(own) and all(n <= 3 * own[key] for key, n in times.items())
    size = lambda counter: {s: sum(n * len(WORD(t or "")) for (_, t, x), n in counter.items() if x == s) for s in ("a", "b", "c", None)}
    had, taken = size(own), size(times)
    open_, left, level = set(had), float(sum(had.values())), 0.0
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    target = {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 3 * had[s] + 1e-9}
        if not above:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 3.0 * had[s] for s in above}
        left -= sum(3.0 * had[s] for s in above)
        open_ -= above
    longest = max(len(WORD(t or "")) for _, t, _ in own)
    for s in target:
        assert abs(taken[s] - target[s]) <= longest, s


def test_mix_settles_rows_and_splits_equal_ones(spark):
    rows = [(None, "same words here", "a")] * 900 + [(5, f"{'w ' * (i % 7 + 1)}", "a") for i in range(300)] + [(i, "x y z " * (i % 5 + 1), "b") for i in range(1000, 1400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_documents(frame, group_rows=50).collect()
    assert len({r._row for r in found}) == len(found) == len(rows)
    for source, n in (("a", 1200), ("b", 400)):
        own = [r for r in found if (r.source_size == sum(len(WORD(t)) for _, t, s in rows if s == source))]
        assert len(own) == n and abs(sum(r.taken for r in own) / own[0].target - 1) < 0.01
    again = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_documents(frame.repartition(3), group_rows=50).collect() if r.doc_id not in (None, 5))
    assert again == Counter((r.doc_id, r.size, r.taken) for r in found if r.doc_id not in (None, 5))
    assert mixing.mixed_rows(frame).count() == sum(r.repeats for r in mixing.mix_documents(frame).collect())


def test_equal_pieces_of_one_doc_id_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(slack_packing, "RANKED_TOGETHER", 8)
    lengths = [7] * 600 + [n % 40 + 1 for n in range(500)] + [100] * 20
    rows = [(None if i < 400 else 5, 0, n, i) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _number long")
    packed = slack_packing.pack_pieces(pieces, 100)
    assert packed.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    sequences = defaultdict(list)
    found = packed.collect()
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert Counter((r.doc_id, r.length) for r in found) == Counter((d, n) for d, _, n, _ in rows)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    assert len(sequences) <= -(-sum(lengths) // 100) + 1
