"""Conversation structure repair by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in its roles' initials. Rows may be kept,
given another role, deleted, and rows without text inserted, each at a cost. The
repair grammar is in Chomsky normal form: a nonterminal (p, q) derives what leads the
role order from state p to state q; its binary rules are (p, q) -> (p, r) (r, q), its
terminal rules the edits of one row. The insertion closure, the cheapest insertions
alone that lead from state to state, stands on both sides of every terminal. The cell
of a span of rows holds, for each nonterminal, the smallest (cost, audit), and spans are
combined bottom-up by length: 1, 2, 4 and so on.

One split of a span is enough. Whatever its derivation, it passes some state at the
split, so the rules through all states r find it; other splits give the same cell.
Nor can the least audits of two parts be wrong for the whole: of two audits of equal
cost neither begins the other, as the rest would be insertions at a cost.

Because cells are combined in order whatever the bracketing, a long conversation needs
no task of its own. Rows are dealt by ranges of (conversation, turn, role, text), each
task parses the runs of its range, and a conversation that spans ranges has one cell in
each, of which the whole one is made. Texts stay out of this: a row brings its role, a
short head and a digest of its text. Only the repaired rows are written in one stream
a conversation, row by row, because their order is theirs alone.

Defined cases: rows stand by turn, nulls first, then role, then the first 64 characters
of the text, then its digest; a null role or text reads as one space; a null conv_id is
a conversation like others, and so are its repeated rows; a role whose initial is none of
s, u and a can only be changed or deleted; a conversation without rows has no report; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyweft.llm.common import prepare

SPACE = "\x20\t\n\x0b\x0c\r"
NO_SPACE = r"[^\x20\x09-\x0D]"
#: Steps of the role order from state to state; 0 begins, 1 follows s, 2 follows u, 3 follows a.
STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
RETYPE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
HEAD = 64

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """Cell of two spans that follow each other: (p, q) -> (p, r) (r, q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                found = (cost + more, audit + rest)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _insertions() -> Cell:
    """Insertion closure: any number of inserted rows."""
    once: Cell = {(p, p): (0, "") for p in range(4)}
    once |= {(p, q): (INSERT, "I") for p, role, q in STEPS if role in ROLES}
    return reduce(combine, [once] * 4)


INSERTIONS = _insertions()


def _terminal(symbol: str) -> Cell:
    """Edits of one row: ``x`` must go, capitals are truncated."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "x":
        more = KEEP_TRUNCATED if symbol.isupper() else 0
        for p, role, q in STEPS:
            if role == symbol.lower():
                edits[p, q] = (more, "K")
            elif role in ROLES:
                edits[p, q] = (RETYPE + more, "R")
    return combine(combine(INSERTIONS, edits), INSERTIONS)


@lru_cache(maxsize=100_000)
def _short(symbols: str) -> Cell:
    if len(symbols) == 1:
        return _terminal(symbols)
    split = 1 << (len(symbols) - 1).bit_length() - 1
    return combine(_short(symbols[:split]), _short(symbols[split:]))


def parse(symbols: str) -> Cell:
    """Cell of a span of rows, bottom-up: spans of 8 rows are remembered, longer ones combined in pairs."""
    spans = [_short(symbols[i : i + 8]) for i in range(0, len(symbols), 8)] or [INSERTIONS]
    while len(spans) > 1:
        pairs = [combine(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cell[0, end] for end in ENDS if (0, end) in cell)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the checksum of ``conv_id:turn``."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault"))
    rows = rows.filter("_fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with what their order needs beside turn and role."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumns({"_head": F.left("text", F.lit(HEAD)), "_digest": digest})


ORDER = ("turn", "role", "_head", "_digest")


def _symbol() -> Column:
    """``x`` for a row without a character, else the initial that the role order knows or ``o``; capitals are truncated."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    return F.when(~F.col("text").rlike(NO_SPACE), "x").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))


CELL_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
PIECE_FIELDS = [
    ("conv_id", pa.int64()), ("part", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cell", CELL_TYPE)]
PIECE_SCHEMA = (
    "conv_id long, part long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long,"
    " illegal long, first string, last string, cell array<struct<start: int, end: int, cost: long, audit: string>>")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Run:
    """Rows of one conversation as they come by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.before, self.symbols = conv_id, None, []
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, symbol: str, later: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last is None:
            self.first = initial
        elif (self.last, initial) not in LEGAL:
            self.illegal += 1
        if symbol == "x":
            self.blank += 1
        elif later or (turn, digest) == self.before:
            self.duplicate += 1
            symbol = "x"
        elif symbol.isupper():
            self.truncated += 1
        self.symbols.append(symbol)
        self.last, self.before = initial, (turn, digest)

    def row(self, part: int) -> tuple:
        cell = [{"start": p, "end": q, "cost": c, "audit": a} for (p, q), (c, a) in parse("".join(self.symbols)).items()]
        return (self.conv_id, part, self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated,
                self.illegal, self.first, self.last, cell)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation in a sorted range."""
    run, part, done = None, 0, []
    for batch in batches:
        for conv_id, turn, initial, symbol, later, digest, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if run is None or conv_id != run.conv_id:
                if run is not None:
                    done.append(run.row(part))
                run = _Run(conv_id)
            run.add(turn, initial, symbol, later, digest)
        if done:
            yield _batch(done, PIECE_FIELDS)
            done = []
    if run is not None:
        yield _batch([run.row(part)], PIECE_FIELDS)


REPORT_FIELDS = [
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
MOST = (1 << 63) - 1


def _joined(a: dict, b: dict) -> dict:
    """Two pieces of a conversation that follow each other."""
    shared = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return {
        **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")},
        "conv_id": a["conv_id"], "turns": a["turns"] + b["turns"] - shared, "first": a["first"], "last": b["last"],
        "first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"],
        "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"],
        "illegal": a["illegal"] + b["illegal"] + ((a["last"], b["first"]) not in LEGAL),
        "cell": combine(a["cell"], b["cell"]),
    }


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order."""
    whole, done = None, []

    def report(p: dict) -> tuple:
        gaps = 0 if p["last_turn"] is None else min(MOST, p["last_turn"] - p["first_turn"] + 1 - p["turns"])
        return (p["conv_id"], gaps, p["blank"], p["duplicate"], p["truncated"], p["illegal"], *cheapest(p["cell"]))

    for batch in batches:
        for piece in batch.to_pylist():
            piece["cell"] = {(c["start"], c["end"]): (c["cost"], c["audit"]) for c in piece["cell"]}
            if whole is not None and whole["conv_id"] == piece["conv_id"]:
                whole = _joined(whole, piece)
                continue
            if whole is not None:
                done.append(report(whole))
            whole = piece
        if done:
            yield _batch(done, REPORT_FIELDS)
            done = []
    if whole is not None:
        yield _batch([report(whole)], REPORT_FIELDS)


def repair_reports(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text)."""
    prepare(rows.sparkSession)
    small = _ordered(rows).select(
        "conv_id", *ORDER, F.substring("role", 1, 1).alias("_initial"), _symbol().alias("_symbol"))
    # A text seen at an earlier turn; copies at one turn stand next to each other and are told there.
    turn = F.struct("turn")
    seen = small.groupBy("conv_id", "_digest").agg(F.min(turn).alias("_since"), F.max(turn).alias("_until"))
    seen = seen.filter(~F.col("_since").eqNullSafe(F.col("_until"))).select(
        F.col("conv_id").alias("_conv"), F.col("_digest").alias("_seen"), "_since")
    same = (F.col("_digest") == F.col("_seen")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    later = F.col("_since").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("_since"))
    marked = small.join(seen, same, "left").select("conv_id", *ORDER, "_initial", "_symbol", later.alias("_later"))
    ranged = marked.repartitionByRange("conv_id", "turn", "role", "_head").sortWithinPartitions("conv_id", *ORDER)
    pieces = ranged.select(
        "conv_id", "turn", "_initial", "_symbol", "_later", "_digest", F.spark_partition_id().cast("long").alias("_part"),
    ).mapInArrow(_pieces, PIECE_SCHEMA)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_reports, REPORT_SCHEMA)


REPAIRED_FIELDS = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
_NEXT = {(p, role): q for p, role, q in STEPS}


class _Writer:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.place = conv_id, audit, 0, 0, 0

    def _put(self, initial: str, role: str, text: str, edit: str) -> tuple:
        self.state, self.place = _NEXT[self.state, initial], self.place + 1
        return (self.conv_id, self.place - 1, role, text, edit)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            wanted = "a" if self.state == 2 else "u"
            yield self._put(wanted, ROLES[wanted], "", "I")

    def edited(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit, wanted = self.audit[self.at], "a" if self.state == 2 else "u"
        self.at += 1
        if edit == "K":
            yield self._put(role[0], role, text, "K")
        elif edit == "R":
            yield self._put(wanted, ROLES[wanted], text, "R")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = None
    for batch in batches:
        done: list[tuple] = []
        for conv_id, audit, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if audit is not None:  # the report comes before its rows
                done += writer.inserted() if writer else ()
                writer = _Writer(conv_id, audit)
            else:
                done += writer.edited(role, text)
        yield _batch(done, REPAIRED_FIELDS)
    if writer:
        yield _batch(list(writer.inserted()), REPAIRED_FIELDS)


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text, edit) after the repair; each partition holds whole conversations in order."""
    no_text = F.lit(None).cast("string")
    told = reports.select("conv_id", F.lit(0).alias("_kind"), "audit", F.lit(None).cast("long").alias("turn"),
                          no_text.alias("role"), no_text.alias("text"), no_text.alias("_head"), F.lit(None).cast("binary").alias("_digest"))
    both = told.unionByName(_ordered(rows).withColumns({"_kind": F.lit(1), "audit": no_text}))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", *ORDER)
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(
        _rewritten, "conv_id long, place long, role string, text string, edit string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv_id", pa.int64()), ("repaired_sha256", pa.string())]
    current, running = None, None
    for batch in batches:
        done = []
        for conv_id, place, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if place == 0:
                if running is not None:
                    done.append((current, running.hexdigest()))
                current, running = conv_id, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield _batch(done, fields)
    if running is not None:
        yield _batch([(current, running.hexdigest())], fields)


def digest_conversations(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over the ``role:text`` lines of ``repaired_rows``, read as it hands them out."""
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, faults, repair and digest of every conversation, those that lost all rows included."""
    rows = damage(conversations)
    reports = repair_reports(rows)
    digests = digest_conversations(repaired_rows(rows, reports))
    out = conversations.select(F.col("conv_id").alias("_id")).distinct()
    for found in (reports, digests):
        out = out.join(found, F.col("_id").eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
    numbers = [F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n, t in REPORT_FIELDS[1:] if t == pa.int64()]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
