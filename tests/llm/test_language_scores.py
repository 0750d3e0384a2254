"""Word-first backoff against a direct reading of its definition."""

from __future__ import annotations

import math
import random
from collections import Counter

import regex

from skyweft.llm import language_id


def test_letters_are_runs_of_letters():
    draw = random.Random(1)
    signs = "aZ1²½_ª-.'éßİǅŁ日ภ́Ⅷ٣ \n"
    for _ in range(4000):
        text = "".join(draw.choices(signs, k=draw.randint(0, 12))).lower()
        assert language_id.letters(text) == regex.findall(r"\p{L}+", text), repr(text)


def model_of(draw: random.Random) -> tuple[language_id.LanguageModel, dict, dict]:
    counts: dict[tuple[str, int, str], int] = {}
    for lang in ("de", "en", "xx"):
        for word in ("".join(draw.choices("abcde", k=draw.randint(1, 6))) for _ in range(40)):
            counts[lang, 0, word] = draw.randint(1, 9)
            for size in language_id.GRAMS:
                for gram in language_id.grams_of(word, size)[:2]:
                    counts[lang, size, gram] = counts.get((lang, size, gram), 0) + 1
    totals = Counter()
    for (lang, size, _), n in counts.items():
        totals[lang, size] += n + draw.randint(0, 3)
    return language_id.LanguageModel([(*k, n) for k, n in counts.items()], totals), counts, totals


def test_scores_equal_the_definition():
    draw = random.Random(2)
    for _ in range(5):
        model, counts, totals = model_of(draw)
        kinds = Counter(size for size, _ in {(s, u) for _, s, u in counts})

        def score(lang: str, size: int, unit: str) -> float:
            return math.log(counts.get((lang, size, unit), 0) + 0.5) - math.log(totals[lang, size] + 0.5 * kinds[size])

        known = {(s, u) for _, s, u in counts}
        judge = language_id.Judge(model)
        for _ in range(60):
            words = ["".join(draw.choices("abcdez", k=draw.choice([1, 3, 5, 70, 100]))) for _ in range(draw.randint(1, 50))]
            total = dict.fromkeys(model.langs, 0.0)
            for word in words:
                for lang in model.langs:
                    if (0, word) in known:
                        total[lang] += score(lang, 0, word)
                        continue
                    for size in language_id.GRAMS:
                        found = [g for g in language_id.grams_of(word, size) if (size, g) in known]
                        if found:
                            total[lang] += sum(score(lang, size, g) for g in found) / len(found)
                            break
            best = max(total.values())
            share = min(1.0, language_id.WEIGHED_WORDS / len(words))
            lang, sure = judge(" ".join(words))
            assert abs(total[lang] - best) < 1e-9
            assert abs(sure - 1 / sum(math.exp((t - best) * share) for t in total.values())) < 1e-9


def test_forgetting_words_changes_nothing(monkeypatch):
    model, *_ = model_of(random.Random(3))
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices("abcdefg", k=4)) for _ in range(30)) for _ in range(40)]
    plain = [language_id.Judge(model)(t) for t in texts]
    monkeypatch.setattr(language_id, "REMEMBERED", 50)
    judge = language_id.Judge(model)
    assert [judge(t)[0] for t in texts] == [p[0] for p in plain] and len(judge.places) <= 50


def test_text_with_more_words_than_are_remembered(monkeypatch):
    model, *_ = model_of(random.Random(5))
    text = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(3000))
    plain = language_id.Judge(model)(text)
    monkeypatch.setattr(language_id, "REMEMBERED", 100)
    lang, sure = language_id.Judge(model)(text)
    assert lang == plain[0] and abs(sure - plain[1]) < 1e-9


def test_most_frequent_units_keep_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_WORDS", 50)
    monkeypatch.setattr(language_id, "MODEL_GRAMS", 10)
    rows = [("en", 0, f"w{i}", 100 - i if i < 40 else 3) for i in range(1000)] + [("de", 0, f"v{i}", 1) for i in range(30)]
    rows += [("en", 4, f"g{i}", 7) for i in range(2000)]
    units = spark.createDataFrame(rows, "lang string, size int, unit string, n long")
    kept = {}
    for r in language_id._most_frequent(units).collect():
        kept.setdefault((r.lang, r.size), set()).add(r.unit)
    assert {f"w{i}" for i in range(40)} <= kept["en", 0] and 42 <= len(kept["en", 0]) <= 62
    assert len(kept["de", 0]) == 30 and 2 <= len(kept["en", 4]) <= 25
    again = {r.unit for r in language_id._most_frequent(units.repartition(3)).collect()}
    assert again == set().union(*kept.values())
