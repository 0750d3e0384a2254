"""Similarity join of documents on word n-gram sets by a prefix-tree join.

A document's set are the 64-bit hashes of its distinct n-word shingles. Two sets
link when their Jaccard similarity reaches a threshold, and linked documents form
components. The join is exact on the sets:

1. Rows are told apart by a 64-bit hash of doc_id and text, so that neither null nor
   repeated doc_ids mix their sets. Equal sets become one class, named by its smallest row.
2. A fixed-size table counts shingles by the first bits of their hash. It gives all
   sets one global order, frequent shingles last. Any order gives right results;
   this one keeps passages that very many documents share out of the prefixes.
3. Similar sets share a shingle among the first ``n - ceil(t n) + 1`` in that order.
   Prefix shingles are brought together once. Those that only one class has are dropped,
   and of those that the same classes have all but the first; few are left. Up to step 5
   a class goes by the first half of its set's digest.
4. Classes that share a prefix shingle meet, each with the rest of its prefix. The
   rests are stored in a trie; every class walks it, sharing the overlap of common
   paths, and leaves subtrees whose remaining length cannot reach the overlap that
   the sizes ask for. What is found are candidates: enough of a spanning forest to
   tell which classes may be linked at all.
5. Classes that hang together by candidates are checked on their whole sets, once,
   by counting overlaps exactly. The result is again a spanning forest of true
   links, whose components are the answer.

Groups larger than a task's share are dealt over chunks: candidates of a frequent
shingle first within chunks, then across them wherever they do not hang together
yet; whole sets of a large candidate cluster in pairs of chunks.

Defined cases: a null text and one without words have an empty set and link with
nothing; fewer words than a shingle form one shingle; repeated rows are one class, and
different texts of one doc_id are two; rows with a null doc_id link like others but
name no component, which is null where all its rows' doc_ids are; no documents give no
rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.llm.common import SLICE_ROWS, land, map_slices, prepare, spread
from skyweft.llm.components import Forest, connected_components

WORDS, PERCENT = 5, 80
#: The frequency table has 2 ** TABLE_BITS counts, in chunks of 2 ** CHUNK_BITS.
TABLE_BITS, CHUNK_BITS = 20, 16
MERGED_AT_ONCE = 64
GROUP_ROWS = 4096
#: Rows of small groups that one task takes together.
ROWS_AT_ONCE = 2000
SEEN_SETS = 200_000
HASHED_BYTES = 1 << 20
#: Bits of the filter that tells which rows need not be looked at again. When full, it lets all through.
FILTER_BITS = 23
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# Shingle sets


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(HASHED_BYTES, _BASE, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(HASHED_BYTES, inverse, np.uint64)])
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes) -> np.ndarray:
    """One hash per word of lower-cased bytes, all words at once by differences of a running sum."""
    if len(text) > HASHED_BYTES:
        words = text.split()
        return np.array([xxhash.xxh3_64_intdigest(w) if len(w) > HASHED_BYTES else int(_word_hashes(w)[0]) for w in words], np.uint64)
    codes = np.frombuffer(text, np.uint8)
    inside = np.empty(len(codes) + 2, np.bool_)
    inside[0] = inside[-1] = False
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers()
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    hashes = _word_hashes(text.encode().lower()) if text else np.zeros(0, np.uint64)
    size = min(words, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    joined = np.full(n, size, np.uint64)
    for k in range(size):
        joined = _mixed(joined + hashes[k : k + n]) * np.uint64(_BASE)
    return np.unique(joined)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Mostly small numbers, as a few bits each."""
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), "<i8")


def _sets_and_counts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and digest; at the end of a task, its share of the frequency table."""
    table, waiting, held = np.zeros(1 << TABLE_BITS, np.int64), [], 0
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                        ("part", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
    with np.errstate(over="ignore"):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sizes, digests = [], []
                for text in part.column(2).to_pylist():
                    shingles = shingle_set(text, words)
                    sizes.append(len(shingles))
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.data), np.int64))
                    waiting.append(shingles)
                    held += len(shingles)
                    if held > 1 << TABLE_BITS:
                        table += np.bincount(_bucket(np.concatenate(waiting)), minlength=1 << TABLE_BITS)
                        waiting, held = [], 0
                both = np.array(digests, np.int64).reshape(-1, 2)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                     none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
    if waiting:
        table += np.bincount(_bucket(np.concatenate(waiting)), minlength=1 << TABLE_BITS)
    if table.any():
        step, number = 1 << CHUNK_BITS, TaskContext.get().partitionId()
        for chunk in range(len(table) // step):
            counts = _packed(table[chunk * step : (chunk + 1) * step])
            yield pa.RecordBatch.from_pylist([{"part": number, "chunk": chunk, "counts": counts}], schema=schema)


def _added(rows: pa.Table) -> pa.Table:
    total = sum(_unpacked(x.as_py()) for x in rows.column("counts"))
    return pa.table({"part": [rows.column("part")[0].as_py()], "chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()),
                     "counts": pa.array([_packed(total)], pa.binary())})


def _frequency_table(shares: DataFrame, n_parts: int) -> np.ndarray:
    """Sum of the tasks' tables, a few dozen at a time."""
    shares = shares.select("part", "chunk", "counts")
    while n_parts > 1:
        shares = shares.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE)).groupBy("part", "chunk")
        shares = shares.applyInArrow(_added, "part long, chunk int, counts binary")
        n_parts = math.ceil(n_parts / MERGED_AT_ONCE)
    table = np.zeros(1 << TABLE_BITS, np.int64)
    for row in shares.collect():  # at most 2 ** TABLE_BITS numbers
        table[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] += _unpacked(row.counts)
    return table


# Prefixes


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, class, n * 2 ** 32 + place) of prefix shingles; a set met before in the task is left out."""
    seen: set[bytes] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            tokens, classes, places = [], [], []
            with np.errstate(over="ignore"):
                for text in part.column(0).to_pylist():
                    shingles = shingle_set(text, words)
                    digest = xxhash.xxh3_128_digest(shingles.data)
                    n = len(shingles)
                    if not n or digest in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(digest)
                    prefix = shingles[np.argsort(table[_bucket(shingles)], kind="stable")[: prefix_length(n, percent)]]
                    tokens.append(prefix.view(np.int64))
                    classes.append(np.full(len(prefix), np.frombuffer(digest, np.int64)[0]))
                    places.append((n << 32) + np.arange(len(prefix), dtype=np.int64))
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, classes, places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined], names=["token", "class", "at"])


# Candidates


def least_common(n_a: int, n_b: int, percent: int) -> tuple[int, int, int]:
    """(misses that a may have, misses that b may have, prefix shingles that both must share)."""
    overlap = -(-percent * (n_a + n_b) // (100 + percent))
    miss_a, miss_b = n_a - overlap, n_b - overlap
    return miss_a, miss_b, min(prefix_length(n_a, percent) - miss_a, prefix_length(n_b, percent) - miss_b)


class _Node:
    __slots__ = ("below", "height", "ends", "least", "most")

    def __init__(self):
        self.below: dict[int, _Node] = {}
        self.height, self.ends = 0, []
        self.least, self.most = 1 << 62, 0


class PrefixTrie:
    """Rests of prefixes, in global order, as paths. Every node knows the longest path and the set sizes below it."""

    def __init__(self, percent: int):
        self.root, self.percent = _Node(), percent

    def add(self, tokens: list[int], n: int, entry: int) -> None:
        node = self.root
        for at in range(len(tokens) + 1):
            node.height = max(node.height, len(tokens) - at)
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == len(tokens):
                node.ends.append((entry, n))
            else:
                node = node.below.setdefault(tokens[at], _Node())

    def overlapping(self, tokens: list[int], n: int) -> Iterator[tuple[int, int, int]]:
        """(entry, size, shared tokens) of all entries that remaining lengths and sizes do not exclude."""
        places, percent = {t: i for i, t in enumerate(tokens)}, self.percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, shared, used = stack.pop()
            if percent * n > 100 * node.most or percent * node.least > 100 * n:
                continue
            least, most = max(node.least, -(-percent * n // 100)), min(node.most, 100 * n // percent)
            if least > most:
                continue
            # The bound falls with the smaller size on one side and with the larger on the other.
            needed = min(
                prefix_length(n, percent) - n + -(-percent * (n + least) // (100 + percent)),
                prefix_length(most, percent) - most + -(-percent * (n + most) // (100 + percent)),
            ) - 1
            if shared + min(node.height, len(tokens) - used) + 1 < needed:
                continue
            for entry, size in node.ends:
                yield entry, size, shared
            for token, below in node.below.items():
                place = places.get(token)
                stack.append((below, shared, used) if place is None else (below, shared + 1, place + 1))


def _may_link(n_a: int, at_a: int, n_b: int, at_b: int, shared: int, percent: int) -> bool:
    """``shared``: common tokens after the one they meet in, taken as the first that they have in common."""
    if percent * n_a > 100 * n_b or percent * n_b > 100 * n_a:
        return False
    miss_a, miss_b, needed = least_common(n_a, n_b, percent)
    return at_a <= miss_a and at_b <= miss_b and 1 + shared >= needed


def _candidates(group: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the candidate links among classes that share a token.

    Neighbours in path order are compared first, so large families of near
    copies fall together; then all but the largest part walk the trie. Entries
    that carry a part known to hang together are not compared with each other.
    """
    owner, known = group.column("class").to_pylist(), group.column("known").to_pylist()
    at = group.column("at").to_numpy()
    sizes, places = (at >> 32).tolist(), (at & 0xFFFFFFFF).tolist()
    rests = group.column("rest").to_pylist()
    forest, edges = Forest(len(owner)), []
    first_known: dict[int, int] = {}
    for i, k in enumerate(known):
        if k is not None and first_known.setdefault(k, i) != i:
            forest.join(i, first_known[k])

    def link(i: int, j: int) -> None:
        if forest.join(i, j):
            edges.append((owner[i], owner[j]))

    order = sorted(range(len(owner)), key=lambda i: (rests[i], owner[i]))
    for i, j in zip(order, order[1:], strict=False):
        if forest.root(i) != forest.root(j):
            shared = len(set(rests[i]).intersection(rests[j]))
            if _may_link(sizes[i], places[i], sizes[j], places[j], shared, percent):
                link(i, j)
    parts: dict[int, int] = {}
    for i in range(len(owner)):
        parts[forest.root(i)] = parts.get(forest.root(i), 0) + 1
    if len(parts) > 1:
        largest = max(parts, key=lambda r: (parts[r], -r))
        outside = [i for i in range(len(owner)) if forest.root(i) != largest]
        trie = PrefixTrie(percent)
        for i in range(len(owner)):
            trie.add(rests[i], sizes[i], i)
        for i in outside:
            for j, size, shared in trie.overlapping(rests[i], sizes[i]):
                if forest.root(i) != forest.root(j) and _may_link(sizes[i], places[i], size, places[j], shared, percent):
                    link(i, j)
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _met(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Add to (token, class, at) rows what of the class's prefix comes after the token."""
    later = F.filter("_list", lambda x: x["place"] > F.col("at").bitwiseAND(0xFFFFFFFF))
    return rows.join(lists, "class").withColumn("rest", F.transform(later, lambda x: x["token"])).drop("_list")


def _telling(rows: DataFrame) -> DataFrame:
    """Rows (token, class, place, ...) of the first token of every different group of classes.

    Tokens that the same classes share say the same about them. All pairs of such
    classes have these tokens in common, so only the first in the global order can
    be the first of any pair. Groups are told apart by two 64-bit sums of hashes.
    """
    groups = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_xor(F.xxhash64("class")).alias("_x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("_y"), F.min_by("place", "class").alias("_place"))
    first = groups.filter(F.col("_rows") > 1).groupBy("_rows", "_x", "_y").agg(F.min_by("token", "_place").alias("token"))
    return rows.join(first.select("token"), "token")


def _viable(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, class, n, place, rest) that sizes and remaining lengths in their token's group do not exclude.

    The trie's bound for a whole group at once: only its longest rest and its
    smallest and largest set count, so the group itself is never gathered.
    """
    groups = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("rest").alias("_rest"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    met = rows.join(groups.filter(F.col("_rows") > 1), "token").withColumns({
        "_least": F.greatest("_lo", F.expr(f"({percent} * n + 99) div 100")),
        "_most": F.least("_hi", F.expr(f"100 * n div {percent}"))})
    prefix = lambda n: f"({n} - ({percent} * {n} + 99) div 100 + 1)"
    overlap = lambda m: f"(({percent} * (n + {m}) + {99 + percent}) div {100 + percent})"
    needed = F.least(
        F.expr(f"{prefix('n')} - n + {overlap('_least')}"), F.expr(f"{prefix('_most')} - _most + {overlap('_most')}")) - 1
    kept = (F.least("rest", "_rest") + 1 >= needed) & (F.col("place") <= F.expr(f"n - {overlap('_least')}"))
    return met.filter(kept).select(*rows.columns)


def _marked(rows: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` stands in ``marks``, and a few by chance, told by a bitmap of fixed size before any shuffle."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    word, flag = F.shiftright(bit, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    bitmap = F.broadcast(marks.groupBy(word).agg(F.bit_or(flag).alias("_bits")))  # 2 ** (FILTER_BITS - 6) rows
    return rows.withColumn("_word", word).join(bitmap, "_word").filter(F.col("_bits").bitwiseAND(flag) != 0).drop("_word", "_bits")


def _found(rows: DataFrame, n_rows: int, keys: list[str], percent: int) -> DataFrame:
    """Candidate edges of all groups named by ``keys``; tasks take many small groups at a time."""
    buckets = F.lit(-(-n_rows // ROWS_AT_ONCE) or 1)

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        values = np.column_stack([table.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        return pa.concat_tables([_candidates(table.slice(i, j - i), percent) for i, j in zip(cuts, cuts[1:], strict=False)])

    return rows.groupBy(spread(keys, buckets).alias("_bucket")).applyInArrow(find, "a long, b long")


def candidate_edges(shared: DataFrame, percent: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect all classes which may be linked.

    ``shared``: a written table (token, class, at); a class may have a row more than once.
    """
    place = F.col("at").bitwiseAND(0xFFFFFFFF)
    listed = F.array_sort(F.collect_set(F.struct(place.alias("place"), "token"))).alias("_list")
    lists = land(shared.groupBy("class").agg(F.max(F.shiftright("at", 32)).alias("n"), listed))
    rows = lists.select("class", "n", F.size("_list").alias("_size"), F.posexplode("_list").alias("_i", "_x")).select(
        "_x.token", "class", "n", "_x.place", (F.col("_size") - F.col("_i") - 1).alias("rest"))
    rows = land(_viable(land(_viable(land(_telling(rows)), percent)), percent))
    shared = land(rows.select("token", "class", (F.shiftleft("n", 32) + F.col("place")).alias("at")))
    lists = _marked(lists.select("class", "_list"), shared, "class")
    sizes = shared.groupBy("token").agg(F.count(F.lit(1)).alias("_rows"))
    dealt = shared.join(sizes, "token").withColumn("_chunk", spread(["token", "class"], F.ceil(F.col("_rows") / group_rows)))
    within = _met(dealt.drop("_rows"), lists).withColumn("known", F.lit(None).cast("long"))
    within = land(_found(within, shared.count(), ["token", "_chunk"], percent).distinct())
    large = land(sizes.filter(F.col("_rows") > group_rows))
    if large.isEmpty():
        return within
    # Across the chunks of frequent tokens: the rows outside the largest known part meet every chunk.
    names = connected_components(within).select(F.col("node").alias("class"), F.col("component").alias("known"))
    rows = shared.join(large, "token").join(names, "class", "left").withColumn("known", F.coalesce("known", "class"))
    parts = rows.groupBy("token", "known").agg(F.count(F.lit(1)).alias("_n"))
    main = parts.groupBy("token").agg(
        F.max_by("known", F.struct("_n", "known")).alias("_main"), (F.sum("_n") - F.max("_n")).alias("_outside")
    ).filter(F.col("_outside") > 0)
    rows = rows.join(main, "token").withColumn("_in", F.col("known") == F.col("_main"))
    half = group_rows // 2
    outer, inner = F.ceil(F.col("_outside") / half), F.ceil((F.col("_rows") - F.col("_outside")) / half)
    own = F.when(F.col("_in"), outer + spread(["class"], inner)).otherwise(spread(["class"], outer))
    meets = F.when(F.col("_in"), F.sequence(F.lit(0).cast("long"), outer - 1)).otherwise(
        F.sequence(F.lit(0).cast("long"), outer + inner - 1))
    rows = land(rows.withColumn("_own", own).withColumn("_other", F.explode(meets)).select(
        "token", "class", "at", "known", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")))
    across = _found(_met(rows, lists), rows.count(), ["token", "_i", "_j"], percent)
    return land(within.union(across).distinct())


# Checking on whole sets


def _links(group: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the true links among whole sets, by counting overlaps in postings."""
    owner = group.column("class").to_pylist()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
    order = sorted(range(len(owner)), key=lambda i: (len(sets[i]), owner[i]))
    owner, sets = [owner[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)
    by_code = np.argsort(codes, kind="stable")
    posted, bounds = holder[by_code], np.r_[0, np.cumsum(np.bincount(codes))]
    ends = np.cumsum(sizes)
    forest, edges = Forest(len(sets)), []
    for i in range(1, len(sets)):
        own = codes[ends[i] - sizes[i] : ends[i]]
        met = np.concatenate([posted[bounds[c] : bounds[c + 1]] for c in own])
        overlap = np.bincount(met[met < i], minlength=i)
        for j in np.flatnonzero(100 * overlap >= percent * (sizes[i] + sizes[:i] - overlap)):
            if forest.join(i, int(j)):
                edges.append((owner[i], owner[j]))
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _true_links(
    texts: DataFrame, clusters: DataFrame, words: int, percent: int, group_rows: int, repeated: bool
) -> DataFrame:
    """Edges between linked classes; ``clusters``: (node, component) by candidates."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"))
    chunks = F.ceil(F.col("_rows") / group_rows)
    members = clusters.join(sizes, "component").select(
        F.col("node").alias("row"), "component", spread(["node"], chunks).alias("_own"), chunks.alias("_chunks"))

    def as_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            sets = [shingle_set(text, words).tobytes() for text in batch.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=[*names, "shingles"])

    # Texts are moved instead of sets, of which each has 8 bytes a word.
    names = ["row", "component", "_own", "_chunks"]
    sets = _marked(texts.select("row", "text"), members, "row").join(members, "row")
    if repeated:
        sets = sets.dropDuplicates(["row"])
    sets = map_slices(sets.select(*names, "text"), as_sets, "row long, component long, _own long, _chunks long, shingles binary")
    sets = sets.withColumnRenamed("row", "class")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_other")
    dealt = sets.select("class", "component", "_own", "shingles", other).select(
        "class", "component", "shingles", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    return dealt.groupBy("component", "_i", "_j").applyInArrow(lambda group: _links(group, percent), "a long, b long")


def row_key() -> Column:
    """What tells rows apart: doc_id and text."""
    return F.xxhash64("doc_id", "text")


def _linked_rows(docs: DataFrame, words: int, percent: int, group_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """(row, doc_id, n) of every document; (row, class, component) of every different row with words; whether rows repeat."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(row_key().alias("row"), "doc_id", "text")
    first = land(texts.mapInArrow(
        lambda batches: _sets_and_counts(batches, words),
        "row long, doc_id long, n long, hi long, lo long, part long, chunk int, counts binary"))
    shares = first.filter(F.col("counts").isNotNull())
    n_parts = (shares.agg(F.max("part")).first()[0] or 0) + 1
    table = spark.sparkContext.broadcast(_frequency_table(shares, n_parts))  # 2 ** TABLE_BITS counts
    sets = first.filter(F.col("counts").isNull()).select("row", "doc_id", "n", "hi", "lo")
    full = sets.filter(F.col("n") > 0).select("row", "hi", "lo", "n")
    repeated = not full.groupBy("row").count().filter(F.col("count") > 1).isEmpty()
    if repeated:
        full = full.distinct()
    # Written first, so that the join can split a class that very many documents are in.
    classes = land(full.groupBy("hi", "lo", "n").agg(F.min("row").alias("class")))
    members = land(full.join(classes, ["hi", "lo", "n"]).select("row", "class"))

    prefixes = texts.select("text").mapInArrow(
        lambda batches: _prefixes(batches, words, percent, table.value), "token long, class long, at long")
    same = Window.partitionBy("token")
    met = prefixes.withColumns({"_a": F.min("class").over(same), "_b": F.max("class").over(same)}).filter(F.col("_a") != F.col("_b"))
    shared = land(met.select("token", "class", "at"))

    clusters = connected_components(candidate_edges(shared, percent, group_rows))
    clusters = land(classes.join(clusters, F.col("hi") == F.col("node")).select(F.col("class").alias("node"), "component"))
    links = land(_true_links(texts, clusters, words, percent, group_rows, repeated).distinct())
    linked = connected_components(links).select(F.col("node").alias("class"), "component")
    named = members.join(linked, "class", "left").select("row", "class", F.coalesce("component", "class").alias("component"))
    return sets.select("row", "doc_id", "n"), land(named), repeated


def ngram_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest that is reachable by links, the document itself included.
    """
    sets, named, _ = _linked_rows(docs, words, percent, group_rows)
    rows = sets.join(named, "row", "left")
    out = rows
    for group, name in (("class", "class_id"), ("component", "component_id")):
        least = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min("doc_id").alias(name))
        out = out.join(least, group, "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        *[F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")])


def first_of_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that with the smallest doc_id, nulls last, then row hash.

    Of rows with one doc_id and text, any one stays. Documents without words all stay.
    """
    sets, named, repeated = _linked_rows(docs, words, percent, group_rows)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = sets.join(named, "row").groupBy("component").agg(F.min(order).alias("_first")).select(F.col("_first.row").alias("_row"))
    alone = sets.filter(F.col("n") == 0).select(F.col("row").alias("_row")).distinct()
    key = "_key_of_row"
    first, alone = (x.select(F.col("_row").alias(key)) for x in (first, alone))
    keyed = docs.withColumn(key, row_key())
    if not repeated:
        return keyed.join(first.union(alone), key, "left_semi").drop(key)
    kept = keyed.join(first, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(keyed.join(alone, key, "left_semi")).drop(key)
