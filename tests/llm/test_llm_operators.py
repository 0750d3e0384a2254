from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyweft.llm import (
    components, language_id, line_dedup, mixing, nearest_vectors, ngram_join, packed_output, quality, queries,
    slack_packing, token_counts, tokens, url_filter,
)

TABLES = "/root/testdata/sf0.001"
BYTE_BPE, PIECE_BPE = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
ODD_TEXTS = [
    "", " ", "\n\n", "a", "  a  b ", "don't  stop\n\n\tnow", "x<|endoftext|> y <|endoftext|>", "a▁b ▁▁c", "  x　y z",
    "né à l'été ñandú größe", "日本語 テスト", "🙂👍🏽 é", "<s></s><unk><0x0A>", "tab\tnul\x00\x1c\x85end", "9999 12,000.50!!!", "word " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with names used inside."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    data = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "The same few words.", None, "a"), (3, "The same few words.", None, "a"),
        (None, "no number here", "en", "a"), (5, long, "en", "b"), (6, long, "en", "b"), (7, "\n \t", "de", None), (8, "?? 12 !!", "", "b"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = {c: F.lit(1) for c in ("length", "piece", "n", "size", "class", "component", "target", "_rank", "rank", "count", "_key")}
    return spark.createDataFrame(data, schema).withColumns(extra)


def components_by_hand(texts: dict[int, str | None], words: int, percent: int) -> dict[int, int]:
    sets = {}
    for d, t in texts.items():
        w = WORD((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    forest, order = {d: d for d in sets}, sorted(sets)

    def root(d):
        while forest[d] != d:
            d = forest[d]
        return d

    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                forest[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_join_finds_all_components(spark, group_rows):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: "Only three words", 3: "only THREE words"}
    passage = " ".join(draw.choices(vocabulary, k=60))
    for family in range(6):
        base = draw.choices(vocabulary, k=120)
        for copy in range(8):
            edited = list(base)
            for _ in range(copy // 2):
                edited[draw.randrange(len(edited))] = draw.choice(vocabulary)
            texts[len(texts)] = " ".join(edited[: 120 - family * copy]) if copy else " ".join(base)
    for _ in range(20):
        texts[len(texts)] = passage + " " + " ".join(draw.choices(vocabulary, k=50))
    frame = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    found = ngram_join.ngram_components(frame, words=3, percent=80, group_rows=group_rows).collect()
    assert {r.doc_id: r.component_id for r in found} == components_by_hand(texts, 3, 80)


def test_join_on_given_documents(docs, rows):
    found = ngram_join.ngram_components(docs, words=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == components_by_hand({r.doc_id: r.text for r in rows}, 4, 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_fullest_is_the_best_subset_sum():
    draw = random.Random(1)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(5)}
        room = draw.randint(1, 60)
        items, sums = [x for x, n in counts.items() for _ in range(n)], {0}
        for x in items:
            sums |= {s + x for s in sums}
        chosen = slack_packing.fullest(room, counts)
        assert sum(chosen) == max(s for s in sums if s <= room) and not Counter(chosen) - Counter(items)


def test_ids_equal_the_library(rows):
    encoder = tokens.ByteTokenizer(BYTE_BPE)
    assert encoder.ranked is not None
    for text in [*ODD_TEXTS, *(r.text for r in rows[:100])]:
        assert encoder.ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs, rows):
    packed = slack_packing.pack_documents(docs, BYTE_BPE, with_ids=True)
    library = tokens.ByteTokenizer(BYTE_BPE).library
    whole = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in rows}
    found = packed.collect()
    places, seen = defaultdict(list), Counter()
    for r in found:
        ids = whole[r.doc_id][r.start : r.start + r.length].tobytes()
        assert zlib.crc32(ids) == r.ids_crc32 and ids == bytes(r.ids)
        assert r.piece == 0 or r.length == slack_packing.CAPACITY
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in whole.items()}
    for taken in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(taken))])
        assert [o for o, _ in sorted(taken)] == ends[:-1].tolist() and ends[-1] <= slack_packing.CAPACITY
    assert len(places) <= -(-sum(seen.values()) // slack_packing.CAPACITY) + 1
    sequences = slack_packing.packed_ids(packed).collect()
    assert sum(len(s.ids) for s in sequences) == 4 * sum(seen.values())


def test_token_counts_equal_the_library(rows):
    counter = token_counts.PieceCounter(PIECE_BPE)
    assert counter.splits and len(counter.whole) > 10_000
    for text in [*ODD_TEXTS, *(r.text for r in rows)]:
        assert counter.count(text) == len(counter.library.encode(text)), text[:40]


def test_nearest_vectors_recall_and_scores(spark):
    vectors = nearest_vectors.usable(spark.read.parquet(f"{TABLES}/embeddings.parquet"))
    found = nearest_vectors.search(vectors, F.col("vec_id") % 20 == 0, vector_rows=300, query_rows=10).collect()
    data = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    ids, matrix = np.array(sorted(data)), np.array([data[i] for i in sorted(data)])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        scores = (matrix * data[q]).sum(axis=1)
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        assert [r.rank for r in own] == list(range(1, 21)) and q not in [r.vec_id for r in own]
        assert all(abs(r.score - float((data[r.vec_id] * data[q]).sum())) < 1e-12 for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(best)), total + 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("norms", ["equal", "one long", "log-normal"])
def test_nearest_vectors_recall_in_whole_blocks(norms):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((40, 64))
    matrix = centres[draw.integers(0, 40, 8192)] + 0.8 * draw.standard_normal((8192, 64))
    matrix /= np.sqrt((matrix**2).sum(axis=1))[:, None]
    if norms == "one long":
        matrix[7] *= 3
    elif norms == "log-normal":
        matrix *= draw.lognormal(0, 0.5, 8192)[:, None]
    block = pa.table({"vec_id": np.arange(8192), "vector": pa.array(list(matrix))})
    asked = list(range(0, 8192, 82))
    found = nearest_vectors._searched(block.take(asked), block, 20).to_pylist()
    hits = 0
    for q in asked:
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(asked)


def test_vectors_that_take_no_part(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 0.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0, 0.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = nearest_vectors.search(nearest_vectors.usable(frame), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 10, 1.0), (3, 2, 0.5)]
    assert nearest_vectors.search(nearest_vectors.usable(frame.limit(0)), F.col("vec_id") == 0).count() == 0


def test_quality_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{TABLES}/documents.parquet')")
    expected = sorted(connection.sql(queries.oracle_sql()["op5_quality_rules"]).fetchall())
    assert sorted(map(tuple, queries.op5_quality_rules(spark, TABLES).collect())) == expected


def test_repeat_words_by_hand(spark):
    texts = ["a b c d a b c", "x x x x x", "a b", "one two three four", "a b c\na b c\na b c\n \n"]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality.text_measures(frame).collect()}
    assert found == {0: (6, 0), 1: (5, 0), 2: (0, 0), 3: (0, 0), 4: (9, 2)}


def test_mix_meets_targets(docs, rows):
    found = mixing.mix_documents(docs, group_rows=7).collect()
    again = mixing.mix_documents(docs, group_rows=7).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD(r.text))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:  # share out, cap, share out the excess again
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 3 * sizes[s] + 1e-9}
        if not above:
            break
        targets |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3.0 * sizes[s] for s in above)
        open_ -= above
    targets |= {s: level * weights[s] for s in open_}
    taken = Counter()
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and abs(r.target - targets[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert abs(sum(taken.values()) / sum(targets.values()) - 1) < 0.03


def test_flight_keeps_sums():
    draw = random.Random(5)
    sizes, chances = [draw.randint(1, 500) for _ in range(200)], [0.3] * 200
    left = mixing.flight(sizes, chances, random.Random(1))
    assert sum(0 < p < 1 for p in left) <= 2 and abs(sum(left) - 60) < 1e-6
    assert abs(sum(s * p for s, p in zip(sizes, left, strict=True)) - 0.3 * sum(sizes)) < 1e-4


def test_repeated_passages_go_once(spark):
    draw = random.Random(9)
    say = lambda n: " ".join(f"t{draw.randrange(10**6)}" for _ in range(n)) + "."
    passage = "\n".join(say(15) for _ in range(4))
    texts = {1: f"{say(30)}\n{passage}\n{say(30)}", 2: f"{say(30)}\n{passage}", 3: say(80), 4: f"{passage}\n{say(10)}", 5: "Short line.", 6: "Short line."}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert [d for d in texts if passage in found[d].text] == [1]
    assert {d for d in texts if found[d].text != texts[d]} == {2, 4}
    for d in (2, 4):
        kept, at = "", 0
        for span in found[d]._removed:
            kept, at = kept + texts[d][at : span.start], span.end
        assert kept + texts[d][at:] == found[d].text and texts[d][found[d]._removed[0].start :].startswith(passage)


def test_short_lines_and_unspaced_scripts_go_once(spark):
    draw = random.Random(12)
    say = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n)) + "."
    chinese = "".join(chr(0x4E00 + draw.randrange(9000)) for _ in range(60)) + "。"
    other = ["".join(chr(0x4E00 + draw.randrange(9000)) for _ in range(50)) + "。" for _ in range(4)]
    one, two = say(12), say(12)
    texts = {
        1: f"{one}\nAll rights reserved.\n{other[0]}{chinese}{other[1]}", 2: f"{two}\nAll  rights reserved.\n{other[2]}{chinese}{other[3]}",
        3: f"All rights reserved.\n{say(9)} Few words. {say(9)}", 4: f"{say(9)} Few words. {say(9)}\nAll rights reserved."}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert found[1] == texts[1] and found[2] == f"{two}\n{other[2]}{other[3]}"
    assert found[3] == texts[3].split("\n")[1] and found[4] == texts[4].split("\n")[0] + "\n"


def test_matrix_round_trip(docs, rows, tmp_path, spark):
    matrix = packed_output.pack_matrix(docs, BYTE_BPE, capacity=512, block_bytes=100_000)
    packed_output.write_matrix(matrix, f"{tmp_path}/m")
    library = tokens.ByteTokenizer(BYTE_BPE).library
    whole = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in rows}
    seen = Counter()
    for r in spark.read.parquet(f"{tmp_path}/m").collect():
        line = np.frombuffer(bytes(r.input_ids), "<u4")
        assert len(line) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 512
        positions = packed_output.position_ids(r.cu_seqlens, 512)
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, strict=False):
            assert (line[a:b] == whole[d][s : s + b - a]).all() and (positions[a:b] == np.arange(b - a)).all()
            seen[d] += b - a
    assert seen == {d: len(x) for d, x in whole.items()}


def test_best_fit_takes_the_least_room():
    lengths = sorted((random.Random(2).randint(1, 100) for _ in range(300)), reverse=True)
    rooms: list[int] = []
    by_hand = []
    for n in lengths:
        fitting = [r for r in rooms if r >= n]
        room = min(fitting) if fitting else 100
        if fitting:
            rooms.remove(room)
        rooms.append(room - n)
        by_hand.append(room)
    filled = packed_output.best_fit_decreasing(lengths, 100)
    assert len(filled) == len(rooms) and sorted(100 - sum(lengths[i] for i in row) for row in filled) == sorted(rooms)


def test_url_rules_and_ratio(spark):
    urls = ["http://A.Example.NET/en/x?q", "http://x.net/", "http://x.net", "ftp://example.com/de/a#b", "http://example.com/dex", "http://b.org/fr/", "no scheme",
            None, "http://", "http://myexample.net/en/", "http://net/", "http://q?://w.net/"]
    good = [f"http://site{i}.org/fr/good-{i}" for i in range(300)]
    bad = [f"http://casino{i}.net/win-{i}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls + good + bad + ["http://casino777.info/win-1", "http://site9.info/fr/good-3"])), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(frame.withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("x.net", "/", "net/"), ("x.net", "", None), ("example.com", "/de/a", "example.com/de/"),
        ("example.com", "/dex", None), ("b.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("myexample.net", "/en/", "net/"),
        ("net", "/", "net/"), ("q", "", None)]
    assert found[7].verdict == "allow" and found[len(found) - 2].verdict == "block" and found[len(found) - 1].verdict == "allow"
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_character_model_sums_to_one():
    grams = Counter()
    for text in ("abcab", "abd"):
        for at in range(len(text)):
            for size in range(min(at, 2) + 1):
                grams[text[at - size : at], text[at]] += 1
    model = url_filter.CharacterModel(dict(grams))
    for context in ("", "a", "ab", "zz"):
        assert abs(sum(model.chance(context, chr(c)) for c in range(256)) - 1) < 1e-9


def test_language_held_out_accuracy(docs, rows):
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    held = [r for r in rows if found[r.doc_id].held_out]
    assert {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {r.doc_id for r in held}
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_rare_languages_and_repeats_are_learned_by_bound(spark):
    draw = random.Random(3)
    say = lambda mark: " ".join(mark + "".join(draw.choices("aeiou", k=6)) for _ in range(12))
    data = [(i, say("k"), "xx") for i in range(2000)] + [(9000 + i, say("z"), "yy") for i in range(8)]
    data += [(5000, say("q"), "zz")] * 700 + [(5001 + i, say("r"), "zz") for i in range(300)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    taught = Counter(r.lang for r in language_id._sample(frame, 40).collect())
    assert taught == {"xx": 40, "yy": 8, "zz": 40}
    judged = language_id.identify(frame, language_id.fit(frame, sample_rows=40)).collect()
    assert {r.lang_pred for r in judged if r.doc_id >= 9000} == {"yy"}
    again = frame.repartition(7)
    assert sorted(language_id._sample(again, 40).collect()) == sorted(language_id._sample(frame, 40).collect())


def test_odd_rows_have_defined_results(odd_docs):
    model = language_id.fit(odd_docs)
    langs = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify(odd_docs, model).collect())
    assert [x for d, x in langs if d in (1, 2, 7, 8)] == ["und"] * 4 and len(langs) == 9
    joined = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd_docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (7, 0, 7), (None, 1, None)} <= joined and {c for d, _, c in joined if d in (5, 6)} == {5}
    assert token_counts.count_tokens(odd_docs, PIECE_BPE).filter("n_tokens = 0").count() == 2
    packed = slack_packing.pack_documents(odd_docs, BYTE_BPE).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == {1: 1, 2: 1, 3: 2, None: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert sum(len(r.doc_ids) for r in packed_output.pack_matrix(odd_docs, BYTE_BPE).collect()) == len(packed)
    judged = quality.judge_quality(odd_docs).collect()
    assert len(judged) == 9 and all(r.kept is not None for r in judged) and sum(r.n_words == 0 for r in judged) == 3
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.count() == 9 and mixed.filter("taken > 3 * size").count() == 0
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns
    cleaned = line_dedup.dedup_lines(odd_docs, carry=tuple(odd_docs.columns)).collect()
    assert {r.doc_id: r.text for r in cleaned}[6] == "" and {r.doc_id: r.text for r in cleaned}[1] is None and len(cleaned) == 9


def test_empty_tables(docs):
    empty = docs.limit(0)
    model = language_id.fit(empty)
    frames = (
        ngram_join.ngram_components(empty), slack_packing.pack_documents(empty, BYTE_BPE), token_counts.count_tokens(empty, PIECE_BPE),
        quality.judge_quality(empty), mixing.mix_documents(empty), line_dedup.dedup_lines(empty), packed_output.pack_matrix(empty, BYTE_BPE),
        language_id.identify(empty, model),
    )
    assert [f.count() for f in frames] == [0] * len(frames)
    assert [r.lang_pred for r in language_id.identify(docs, model).limit(3).collect()] == ["und"] * 3
