from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyweft.llm import conversation_repair as repair, queries, sharding, token_alignment

TABLES = "/root/testdata/sf0.001"
BYTE_BPE, PIECE_BPE = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\x0c\r"


# Conversation repair


def least_repair(symbols: str) -> tuple[int, str]:
    """Cheapest repair by growing every edit sequence in order of (cost, audit)."""
    import heapq

    step = {(p, role): q for p, role, q in repair.STEPS}
    queue, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(symbols) and state in repair.ENDS:
            return cost, audit
        done.add((at, state))
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(queue, (cost + 5, audit + "I", at, step[state, role]))
        if at < len(symbols):
            symbol = symbols[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state))
            more = 5 if symbol.isupper() else 0
            if symbol != "x":
                for role in "sua":
                    if (state, role) in step and role == symbol.lower():
                        heapq.heappush(queue, (cost + more, audit + "K", at + 1, step[state, role]))
                    if (state, role) in step and role != "s":
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, step[state, role]))


def all_splits(symbols: str) -> repair.Cell:
    """The whole chart: every span from all its splits."""
    chart = {(i, i + 1): repair._terminal(s) for i, s in enumerate(symbols)}
    for length in range(2, len(symbols) + 1):
        for i in range(len(symbols) - length + 1):
            cell: repair.Cell = {}
            for k in range(i + 1, i + length):
                for pair, found in repair.combine(chart[i, k], chart[k, i + length]).items():
                    cell[pair] = min(found, cell.get(pair, found))
            chart[i, i + length] = cell
    return chart[0, len(symbols)]


def test_parse_equals_cheapest_repair_and_full_chart():
    draw = random.Random(4)
    short = ["".join(s) for n in (1, 2, 3) for s in itertools.product("suaoSUAx", repeat=n)]
    for symbols in [*short, *("".join(draw.choices("suaoSUAOx", k=draw.randint(4, 40))) for _ in range(150))]:
        assert repair.cheapest(repair.parse(symbols)) == least_repair(symbols), symbols
    for _ in range(20):
        symbols = "".join(draw.choices("suaoSUAx", k=11))
        assert repair.parse(symbols) == all_splits(symbols)


def repaired_by_hand(rows: list[tuple]) -> dict:
    """The contract in plain Python over (conv_id, turn, role, text)."""
    whole = defaultdict(list)
    for conv_id, turn, role, text in rows:
        whole[conv_id]  # noqa: B018
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        whole[conv_id] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv_id, found in whole.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(),
                                  hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        counts, symbols, seen = Counter(), "", set()
        for _, role, text in found:
            kind = ("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen
                    else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "fine")
            seen.add((role, text))
            counts[kind] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if kind in ("blank", "duplicate") else initial.upper() if kind == "truncated" else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = least_repair(symbols)
        lines, rest = [], iter(found)
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (None, "", "")
            before = lines[-1][0] if lines else ""
            wanted = "assistant" if before == "u" else "user"
            if edit != "D":
                lines.append(f"{role if edit == 'K' else wanted}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv_id] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def repaired_by_spark(frame) -> dict:
    found = repair.repair_damaged(frame).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_repair_on_given_conversations(spark):
    frame = queries.queries()["op11_conversation_repair"](spark, TABLES)
    expected = repaired_by_hand([tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()])
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}
    assert found == expected


def test_repair_of_odd_and_long_conversations(spark):
    draw = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "system", "Be short."),
            (1, 2**63 - 1, "user", "x"), (1, -(2**62), "tool", "y!"), (2, 1, "", "  "), (3, 0, "unknown", "what?"), (3, 1, "Assistant", "no.")]
    roles, texts = ["system", "user", "assistant", "tool", None], ["Yes.", "No!", "why", "", "Why?\n", None, "long " * 5000 + "end."]
    rows += [(7, draw.randint(0, 300), draw.choice(roles), draw.choice(texts) or str(draw.random())) for _ in range(900)]
    rows += [(8, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(2000)]
    rows += [(c, t, draw.choice(roles), draw.choice(texts)) for c in range(20, 60) for t in range(draw.randint(1, 9))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    frame = frame.withColumns({c: F.lit(1) for c in ("_kind", "part", "audit", "place", "_digest")})
    expected = repaired_by_hand(rows)
    wide = repaired_by_spark(frame)
    expected[1] = (min(expected[1][0], repair.MOST), *expected[1][1:])
    assert wide == expected
    assert repaired_by_spark(frame.limit(0)) == {}


def test_pieces_of_a_conversation_join(spark):
    """Ranges that cut conversations give the same reports."""
    rows = [(5, t, ("user", "assistant", "system")[t * t % 3], f"Text {t % 50}{'.' * (t % 7 > 0)}") for t in range(600)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired_by_spark(frame) == repaired_by_hand(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Token alignment

ODD = [
    None, "", " ", "\n\n", "a", "  a  b ", "x<|endoftext|> y <|endoftext|>", "a▁b ▁▁c", "  x　y z", "né à l'été ñandú größe",
    "日本語 テスト", "🙂👍🏽 é", "<s></s><unk><0x0A>", "tab\tnul\x00\x1c\x85end", "9999 12,000.50!!!", "word " * 4000, "aaaa aaaaaaaa aaaaaaaaaaa",
]


def aligned_by_hand(texts: list[str | None]) -> list[tuple]:
    first, second = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    first.encode_special_tokens = True
    symbols = token_alignment.byte_of_symbol()
    said = {i: bytes(symbols[c] for c in p) for p, i in first.get_vocab(with_added_tokens=False).items() if all(c in symbols for c in p)}
    pieces, corpus, docs = [], Counter(), []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        if not text or b"".join(said[i] for i in a) != whole or b"".join(pieces[i] for i in b) != whole:
            docs.append((0, 0, [], []))
            continue
        spans = []
        for ids, names in ((a, said), (b, pieces)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(own)
        links, j = [], 0
        for start, end, i in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in own if low <= s and e <= high) for own in spans) if len(whole) < 4000 else "")
        corpus.update(links)
        docs.append((len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, b), n in corpus.items():
        highest[b] = max(highest[b], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(corpus[x] == highest[x[1]] for x in links), sum(corpus[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if links else "")
        for n_a, n_b, groups, links in docs]


def test_ids_by_words_equal_the_library(spark):
    pieces = token_alignment.PieceTokenizer(PIECE_BPE)
    assert pieces.splits
    given = [r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("text").collect()]
    draw = random.Random(1)
    odd = ["".join(draw.choices(" \n\t▁aé日🙂.<s>\u3000\x00", k=draw.randint(1, 12))) for _ in range(3000)]
    for text in filter(None, [*ODD, *given, *odd]):
        ids = pieces.library.encode(text)
        whole = b"".join(pieces.bytes_of[i] for i in ids) == (" " + text).encode()
        found = pieces.ids(text)
        assert (found is None) == (not whole) and (found is None or found.tolist() == ids), repr(text)


def test_identity_map_names_the_same_bytes():
    align = token_alignment.aligner(BYTE_BPE, PIECE_BPE)
    named = [(a, int(b)) for a, b in enumerate(align.identity) if b >= 0]
    assert len(named) > 10_000 and all(align.a.bytes_of[a] == align.b.bytes_of[b] for a, b in named)


@pytest.mark.parametrize("frequent", [1, 50, token_alignment.FREQUENT])
def test_alignment_equals_brute_force(spark, frequent):
    given = [r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("text").limit(60).collect()]
    texts = [*ODD, *given, *given[:5], *ODD]
    frame = spark.createDataFrame([(i % 70 or None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a long")
    frame = frame.withColumns({c: F.lit(1) for c in ("_row", "code", "key", "n", "_kind")})
    found = token_alignment.align_tokens(frame, BYTE_BPE, PIECE_BPE, frequent).collect()
    expected = aligned_by_hand(texts)
    short = [t is None or len(t) + 1 < 4000 for t in texts]  # groups of longer ones are too slow by hand
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    assert Counter((r.doc_id, *(r[c] for c in columns)) for r in found) == Counter(
        (i % 70 or None, *e[:6]) for i, e in enumerate(expected))
    digests = Counter((r.doc_id, r.groups_sha256) for r in found)
    assert not Counter((i % 70 or None, e[6]) for i, (e, s) in enumerate(zip(expected, short, strict=True)) if s) - digests


def test_alignment_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_tokens(empty, BYTE_BPE, PIECE_BPE).collect() == []


# Sharding


def shards_by_hand(rows: list[tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """(shard, slot) of different keys: cuts at the ends of rows nearest to equal bytes, the lower one on ties."""
    total, below, shard, slot, out = sum(s for _, s in rows), 0, 0, 0, {}
    for key, size in sorted(rows):
        while shard + 1 < shards and abs(total * (shard + 1) / shards - below) <= abs(below + size - total * (shard + 1) / shards):
            shard, slot = shard + 1, 0
        out[key] = (shard, slot)
        below, slot = below + size, slot + 1
    return out


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_shards_equal_cuts_by_hand(spark, part_rows):
    draw = random.Random(8)
    keys = list({draw.getrandbits(63) for _ in range(400)} | {draw.getrandbits(20) for _ in range(300)} | {0, 2**63 - 1})
    rows = [(k, draw.choice([8, 9, 50, 700, 12_000])) for k in keys]
    frame = spark.createDataFrame([(k, s, k) for k, s in rows], "_key long, _size long, id long")
    found = {r.id: (r.shard, r.slot) for r in sharding.shard_by_key(frame, 24, 0.0, part_rows).collect()}
    assert found == shards_by_hand(rows, 24)


def test_rounds_stop_within_the_tolerance(spark):
    key = F.shiftrightunsigned(F.xxhash64("id"), 1).alias("_key")
    frame = spark.range(20_000).select(key, F.lit(10).cast("long").alias("_size"), "id")
    loose = sharding.count_histogram(frame, 24, 0.05, 10**6)
    assert len(loose.levels) == 1
    sizes = Counter(r.shard for r in sharding.shard_by_key(frame, 24, 0.05).collect())
    assert len(sizes) == 24 and max(abs(n - 20_000 / 24) for n in sizes.values()) <= 0.1 * 20_000 / 24


def test_documents_in_shards(spark):
    text = "same text for a third of all rows"
    rows = [(1, text)] * 400 + [(i, f"text {i} " + "w " * (i % 90)) for i in range(700)] + [(None, None), (None, ""), (None, None), (5, "né")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("row", "_key", "size", "shard", "slot", "_part")})
    found = sharding.shard_documents(frame, part_rows=50).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in found) == Counter(rows)
    assert all(r.size == len((r.row.text or "").encode()) + 8 for r in found)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(sizes.values()) / 24, max(r.size for r in found)
    assert set(sizes) == set(range(24)) and all(abs(s - share) <= largest for s in sizes.values())
    again = sharding.shard_documents(frame, part_rows=50).collect()
    assert Counter((r.row.doc_id, r.row.text, r.shard) for r in again) == Counter((r.row.doc_id, r.row.text, r.shard) for r in found)
    assert sharding.shard_documents(frame.limit(0)).collect() == []


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    sharding.write_shards(sharding.shard_documents(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


def test_shard_query_has_its_columns(spark):
    found = queries.queries()["op13_byte_shards"](spark, TABLES).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in found)
