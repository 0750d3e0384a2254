"""Alignment of the tokens of two tokenizers, with an identity map as the fast path.

Both tokenizers cut the same bytes. Places where tokens of both end cut a text into
groups; a link is a token of each whose byte ranges overlap. Between two neighbouring
ends, of either tokenizer, lies exactly one link, so links are read off the merged ends.

For every A id the id of the B token with the same bytes is looked up once in an array.
A group of one A token and the B token that this identity map names for it is regular:
it is counted in a vector of the length of A's vocabulary, one for each task, and only
the sums of these vectors travel. All other links are irregular; only they enter the
shuffle of pairs, summed up within a task before.

A text's own part is written once: its regular A ids and its irregular pairs, each with
how often they occur in it. The sums then come back: the identity vector, whether each
of its pairs is its B token's most frequent, and the pairs of more than 1 in
``FREQUENT`` of all links (there can be no more than ``FREQUENT`` of these) are bounded
and reach every task; the occurrences of the other pairs are joined to their counts, and
none of them is frequent enough to burden one task.

Defined cases: a text that is null, empty, or not given back byte for byte by both
tokenizers has no tokens, and all its numbers are 0 and its groups ''; rows with null or
repeated doc_ids are aligned each for itself; equal counts are all highest; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyweft.llm.common import SLICE_ROWS, land, prepare
from skyweft.llm.token_counts import PieceCounter
from skyweft.llm.tokens import ByteTokenizer, byte_of_symbol

MARK = "▁"
#: Pairs that a task sums up before it hands them on, and links in one row of them.
HELD_PAIRS, ROW_PAIRS = 1_000_000, 1 << 16
#: Words whose ids a task remembers, and their length.
REMEMBERED, LONGEST_KNOWN = 500_000, 64
FREQUENT = 200_000


class PlainTokenizer(ByteTokenizer):
    """Ids of a ``tokenizers`` file that takes special strings inside texts as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        if self.ranked is not None:
            self.ranked = _Ordinary(self.ranked)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        symbols = byte_of_symbol()
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(symbols[c] for c in piece) if all(c in symbols for c in piece) else piece.encode()


class _Ordinary:
    """A rank table that knows no special strings."""

    def __init__(self, ranked):
        self.ranked = ranked

    def encode_to_numpy(self, text: str, allowed_special: object = ()) -> np.ndarray:
        return self.ranked.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


class PieceTokenizer:
    """Ids of a sentencepiece model and the bytes of its pieces.

    Where the vocabulary proves that no merge crosses a space or line feed, a text is
    encoded word by word and the ids of words met before are remembered.
    """

    def __init__(self, path: str):
        counter = PieceCounter(path)
        self.library, self.splits, self.parts_of = counter.library, counter.splits, counter._parts
        self.bytes_of = [self._bytes(i) for i in range(self.library.get_piece_size())]
        self.known: dict[str, tuple[int, ...]] = {}

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.library.is_byte(i) else piece.replace(MARK, " ").encode()

    def _given_back(self, ids: list[int], text: str) -> bool:
        return b"".join([self.bytes_of[i] for i in ids]) == text.encode()

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a part inside a longer text, where a line feed keeps it apart from the leading mark; none if not given back."""
        ids = self.library.encode("\n" + part)[2:]
        found = tuple(ids) if self._given_back(ids, part) else ()
        if len(part) <= LONGEST_KNOWN:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = found
        return found

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of ``text``, or None where their bytes are not those of a space and the text."""
        if not self.splits or MARK in text:
            ids = self.library.encode(text)
            return np.array(ids, dtype=np.int64) if self._given_back(ids, " " + text) else None
        parts = self.parts_of(" " + text)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self.known.get(p) or self._part(p) if f is None else f for p, f in zip(parts, found, strict=True)]
        if () in found:
            return None
        return np.fromiter(itertools.chain.from_iterable(found), np.int64)


class Aligner:
    """Two tokenizers, the identity map between them, and the alignment of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainTokenizer(path_a), PieceTokenizer(path_b)
        self.lengths = [np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b)]
        same = {x: i for i, x in reversed(list(enumerate(self.b.bytes_of))) if x and not self.b.library.is_byte(i)}
        #: B id with the same bytes as each A id, -1 where there is none.
        self.identity = np.array([same.get(x, -1) for x in self.a.bytes_of], dtype=np.int64)
        self.n_a, self.n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        self.code_type = np.dtype("<u4") if self.n_a * self.n_b < 1 << 32 else np.dtype("<i8")
        #: Every id as text with what may follow it: its neighbour in the group, or the other side.
        self.said = [np.array([f"{i}{end}" for end in ends for i in range(n)], dtype=object)
                     for n, ends in ((self.n_a, ",|"), (self.n_b, ",;"))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where the bytes of either are not those of a space and the text."""
        if not text:
            return None
        b = self.b.ids(text)
        if b is None:
            return None
        a = self.a.ids(" " + text).astype(np.int64)
        # Ranks over bytes give every byte back; another file may not.
        if self.a.ranked is None and b"".join([self.a.bytes_of[i] for i in a.tolist()]) != (" " + text).encode():
            return None
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray, np.ndarray, int]:
        """(number of groups, their sha256, A ids of regular links, codes of irregular links, number of links)."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        both = np.concatenate([ends_a, ends_b])
        both.sort(kind="stable")  # two ascending runs, which it merges
        twice = both[1:] == both[:-1]
        ends = both[np.append(~twice, True)]
        # Ends of either tokenizer that come before each of ``ends``.
        shared = np.append(twice, False)[np.append(True, ~twice)]
        of_a = np.searchsorted(ends_a, ends)
        of_b = np.arange(len(ends)) + np.cumsum(shared) - shared - of_a
        link_a, link_b = a[of_a], b[of_b]
        # The only link of its group: the link before it closed a group too.
        alone = shared & np.append(True, shared[:-1])
        regular = alone & (self.identity[link_a] == link_b)
        irregular = link_a[~regular] * self.n_b + link_b[~regular]
        # Groups that are closed before each link, and so before the token that ends there.
        group = np.cumsum(shared) - shared
        n_groups = int(group[-1]) + 1
        closing_a, closing_b = ends_a[of_a] == ends, ends_b[of_b] == ends
        group_a, group_b = group[closing_a], group[closing_b]
        said = np.empty(len(a) + len(b), dtype=object)
        closes_a, closes_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        said[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.said[0][a + self.n_a * closes_a]
        said[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.said[1][b + self.n_b * closes_b]
        groups = hashlib.sha256("".join(said.tolist())[:-1].encode()).hexdigest()
        return n_groups, groups, link_a[regular], irregular, len(ends)


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED = [
    ("_row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("_same", pa.binary()), ("_same_n", pa.binary()),
    ("_codes", pa.binary()), ("_codes_n", pa.binary()), ("_kind", pa.int32())]
ALIGNED_SCHEMA = (
    "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _same binary,"
    " _same_n binary, _codes binary, _codes_n binary, _kind int")
#: Kinds of rows: a document, a task's vector of regular links, a task's irregular links.
DOCUMENT, VECTOR, PAIRS = 0, 1, 2


def _packed(numbers: np.ndarray, kind: np.dtype) -> tuple[bytes, bytes]:
    """Different numbers and how often each occurs."""
    values, counts = np.unique(numbers, return_counts=True)
    return values.astype(kind).tobytes(), counts.astype("<u4").tobytes()


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    align = aligner(path_a, path_b)
    vector = np.zeros(align.n_a, dtype=np.int64)
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 2  # codes in order, their counts
    waiting: list[np.ndarray] = []
    blank = (None,) * 7

    def merge() -> None:
        codes, at = np.unique(np.concatenate([held[0], *waiting]), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, at, np.concatenate([held[1], *[np.ones(len(w), np.int64) for w in waiting]]))
        held[:] = codes, n
        waiting.clear()

    def handed_on() -> Iterator[pa.RecordBatch]:
        for start in range(0, len(held[0]), ROW_PAIRS):
            codes, n = (h[start : start + ROW_PAIRS].astype("<i8").tobytes() for h in held)
            yield _rows([(*blank, None, None, codes, n, PAIRS)], ALIGNED)
        held[:] = [np.empty(0, np.int64)] * 2

    for whole in batches:
        for start in range(0, whole.num_rows, SLICE_ROWS):
            batch, rows = whole.slice(start, SLICE_ROWS), []
            for row, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = align.tokens(text)
                if tokens is None:
                    rows.append((row, doc_id, 0, 0, 0, 0, "", b"", b"", b"", b"", DOCUMENT))
                    continue
                n_groups, digest, regular, irregular, n_links = align.align(*tokens)
                vector += np.bincount(regular, minlength=align.n_a)
                waiting.append(irregular)
                rows.append((
                    row, doc_id, len(tokens[0]), len(tokens[1]), n_groups, n_links, digest, *_packed(regular, np.dtype("<u4")),
                    *_packed(irregular, align.code_type), DOCUMENT))
            yield _rows(rows, ALIGNED)
            if sum(map(len, waiting)) > HELD_PAIRS:
                merge()
                if len(held[0]) > HELD_PAIRS:
                    yield from handed_on()
    merge()
    yield from handed_on()
    seen = np.flatnonzero(vector)
    if len(seen):
        yield _rows([(*blank, seen.astype("<i8").tobytes(), vector[seen].tobytes(), None, None, VECTOR)], ALIGNED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) from rows of two arrays of 64-bit numbers."""
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], names=["key", "n"])


class Counts:
    """What every task needs of the corpus: the counts of regular and of frequent pairs, and which are highest."""

    def __init__(self, same: np.ndarray, same_best: np.ndarray, codes: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.same, self.same_best, self.codes, self.n, self.best = same, same_best, codes, n, best


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(code, n, best) of every pair that occurs, best where no pair of its B id occurs more often; and regular ids alone."""
    align = aligner(path_a, path_b)
    spark = aligned.sparkSession
    vectors = aligned.filter(F.col("_kind") == VECTOR).select("_same", "_same_n").mapInArrow(_unpacked, "key long, n long")
    vector = vectors.groupBy("key").agg(F.sum("n").alias("n"))
    named = spark.createDataFrame(  # as long as A's vocabulary
        [(i, i * align.n_b + int(b)) for i, b in enumerate(align.identity) if b >= 0], "key long, code long")
    regular = vector.join(F.broadcast(named), "key").select("code", "n")
    pairs = aligned.filter(F.col("_kind") == PAIRS).select("_codes", "_codes_n").mapInArrow(_unpacked, "code long, n long")
    counts = land(regular.unionByName(pairs).groupBy("code").agg(F.sum("n").alias("n")))
    highest = counts.groupBy((F.col("code") % align.n_b).alias("_b")).agg(F.max("n").alias("_most"))  # B's vocabulary
    told = counts.join(F.broadcast(highest), (F.col("code") % align.n_b) == F.col("_b"))
    told = land(told.select("code", "n", (F.col("n") == F.col("_most")).alias("best")))
    return told, told.join(F.broadcast(named), "code")


def _collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    table = df.select(*columns).toArrow()
    return [table.column(c).to_numpy(zero_copy_only=False) for c in columns]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    spark = docs.sparkSession
    prepare(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    aligned = land(numbered.mapInArrow(lambda batches: _aligned(batches, path_a, path_b), ALIGNED_SCHEMA))
    counts, regular = pair_counts(aligned, path_a, path_b)
    align = aligner(path_a, path_b)
    same, same_best = np.zeros(align.n_a, np.int64), np.zeros(align.n_a, bool)
    key, n, best = _collected(regular, "key", "n", "best")
    same[key], same_best[key] = n, best
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most ``frequent`` pairs can have more than that share of all links.
    often = F.col("n") > F.lit(links // frequent)
    codes, n, best = _collected(counts.filter(often).orderBy("code"), "code", "n", "best")
    shared = spark.sparkContext.broadcast(Counts(same, same_best, codes.astype(np.int64), n.astype(np.int64), best.astype(bool)))
    code_type = align.code_type

    texts = aligned.filter(F.col("_kind") == DOCUMENT)
    fixed = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sums = []
            for same, same_n, codes, codes_n in zip(*[c.to_pylist() for c in batch.columns[1:5]], strict=True):
                ids, n = np.frombuffer(same, "<u4"), np.frombuffer(same_n, "<u4").astype(np.int64)
                total, best = int(n @ known.same[ids]), int(n[known.same_best[ids]].sum())
                found, where = _lookup(known, np.frombuffer(codes, code_type))
                n = np.frombuffer(codes_n, "<u4").astype(np.int64)[found]
                sums.append((total + int(n @ known.n[where]), best + int(n[known.best[where]].sum())))
            columns = [batch.column(0), *[pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)], *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "count_sum", "n_best", *fixed])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows, codes_of, counts_of = [], [], []
                for row, codes, codes_n in zip(*[c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns], strict=True):
                    codes = np.frombuffer(codes, code_type).astype(np.int64)
                    found, _ = _lookup(known, codes)
                    codes_of.append(codes[~found])
                    counts_of.append(np.frombuffer(codes_n, "<u4").astype(np.int64)[~found])
                    rows.append(np.full(len(codes_of[-1]), row, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (rows, codes_of, counts_of)], names=["_row", "code", "times"])

    own = texts.select("_row", "_same", "_same_n", "_codes", "_codes_n", *fixed).mapInArrow(
        summed, "_row long, count_sum long, n_best long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
    seldom = texts.select("_row", "_codes", "_codes_n").mapInArrow(rare, "_row long, code long, times long")
    seldom = seldom.join(counts.filter(~often), "code").select(
        "_row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    seldom = seldom.groupBy("_row").agg(F.sum("count_sum").alias("_more_sum"), F.sum("n_best").alias("_more_best"))
    out = own.join(seldom, "_row", "left")
    more = {c: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "_more_best"), ("count_sum", "_more_sum"))}
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more["n_best"], more["count_sum"], "groups_sha256")


def _lookup(known: Counts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``codes`` are frequent pairs, and the places of those."""
    if not len(known.codes):
        return np.zeros(len(codes), bool), np.empty(0, np.int64)
    where = np.minimum(np.searchsorted(known.codes, codes.astype(np.int64)), len(known.codes) - 1)
    found = known.codes[where] == codes
    return found, where[found]
