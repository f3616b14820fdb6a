"""Conversation structure repair by error-correcting Earley parsing.

Grammar: a conversation's roles have to read (s? (u a)+)?, where s, u and a are the initials of roles. Its weighted error
productions delete a row (4), give it the role user or assistant (3), or insert an empty row of these roles (3); a row
that is cut off and stays costs 3 more; rows that are blank or repeat an earlier one have to go.

Chart: rows are read from the last to the first and the grammar is written in that direction with left recursion only,
so every item begins in column 0 and a column has one item for each production and dot, however long the conversation.
An item retains the minimum (cost, audit) of what it covers, audits as links to the items they go on with: the letter of
the edit in front, D, I, K or R, is stored, and the rest is the audit of the item it came from. Ways into an item that
cost the same differ in that letter, so the least letter gives the least audit. The completed chart is followed from
its first column and yields audit and repair.

Spark: rows that are alike combine before anything is shuffled; what comes first is an aggregate by conversation, role
and digest of the text. The facts of a row (a few bytes, no text) stream in order through the task that has the
conversation. Audits then go back to the rows in pieces that stand in the stream before the rows they edit, and the
hash of a repaired conversation is fed row by row. A text is never gathered with others; the chart keeps two bytes for
each item and row. That one task reads all rows of a conversation is in the nature of its results, one audit and one hash.

Cases: null role and text are one space, and so are null ids and turns where ids are hashed; a null conv_id is a
conversation; rows of one turn stand in order of role and digest of the text; rows alike in all columns are repeats of
each other; a role without an initial fits nowhere; a conversation of which no row is left gives zeros, an empty audit
and the hash of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, checkpointed, shuffle_width

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Letters of an audited piece; conversations up to SHORT rows are looked up among those parsed before.
PIECE, SHORT, KNOWN = 4096, 24, 1 << 16
#: Rows of an output batch.
BATCH = 4096
MUST_GO, IS_CUT = 1, 2
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Productions in reading direction, last row first: a symbol in capitals is a non-terminal and stands in front only.
PAIRS = (("T", ""), ("T", "Tau"), ("S", "T"), ("S", "Taus"))
GIVEN = "ua"  # roles that rerole and insert may give
FAR = 1 << 60


class Grammar:
    """The items of a left-recursive grammar and the steps between them."""

    def __init__(self, productions: Iterable[tuple[str, str]] = PAIRS, start: str = "S") -> None:
        productions = tuple(productions)
        self.items = [(p, dot) for p, (_, body) in enumerate(productions) for dot in range(len(body) + 1)]
        number = {item: i for i, item in enumerate(self.items)}
        symbol = [body[dot] if dot < len(body := productions[p][1]) else "" for p, dot in self.items]
        self.moves = [(i, s, number[p, dot + 1]) for i, ((p, dot), s) in enumerate(zip(self.items, symbol)) if s.islower()]
        #: Completion: what is done goes on behind the dot of every item that waits for it.
        self.completions = [(i, number[p2, 1]) for i, (p, dot) in enumerate(self.items) if not symbol[i] for p2, (_, body) in enumerate(productions) if body[:1] == productions[p][0] and (p2, 1) in number]
        self.final = [i for i, (p, _) in enumerate(self.items) if not symbol[i] and productions[p][0] == start]
        #: Rows can be deleted where a terminal comes next and at the end of all, not in between: one way for each audit.
        self.waiting = sorted({i for i, _, _ in self.moves} | set(self.final))
        self.first = [i for i, (p, dot) in enumerate(self.items) if not symbol[i] and not productions[p][1]]
        self.inserts = [(i, to) for i, s, to in self.moves if s in GIVEN]

    def closed(self, cost: list[int], letter: bytearray, origin: bytearray) -> None:
        """Complete and insert in a column until nothing gets better."""
        again = True
        while again:
            again = False
            for i, to in self.completions:
                if (cost[i], letter[i]) < (cost[to], letter[to]):
                    cost[to], letter[to], origin[to], again = cost[i], letter[i], i, True
            for i, to in self.inserts:
                if (cost[i] + INSERT, 73) < (cost[to], letter[to]):  # I
                    cost[to], letter[to], origin[to], again = cost[i] + INSERT, 73, i, True

    def parse(self, initials: bytes, facts: bytes) -> tuple[int, str]:
        """(cost, audit) of rows given by initials and facts; 0 initial: none that a role has."""
        n, width = len(initials), len(self.items)
        cost, letter, origin = [FAR] * width, bytearray(width), bytearray(range(width))
        for i in self.first:
            cost[i] = 0
        self.closed(cost, letter, origin)
        letters, origins = bytearray((n + 1) * width), bytearray((n + 1) * width)
        letters[:width], origins[:width] = letter, origin
        for j in range(1, n + 1):
            initial, fact = chr(initials[n - j]), facts[n - j]
            new, letter, origin = [FAR] * width, bytearray(width), bytearray(range(width))
            for i in self.waiting:
                if cost[i] < FAR:
                    new[i], letter[i], origin[i] = cost[i] + DELETE, 68, i  # D
            if not fact & MUST_GO:
                more = CUT if fact & IS_CUT else 0
                for i, s, to in self.moves:
                    edit = (KEEP, 75) if s == initial else (REROLE, 82) if s in GIVEN else None  # K, R
                    if edit and cost[i] < FAR and (cost[i] + edit[0] + more, edit[1]) < (new[to], letter[to]):
                        new[to], letter[to], origin[to] = cost[i] + edit[0] + more, edit[1], i
            cost = new
            self.closed(cost, letter, origin)
            letters[j * width : (j + 1) * width], origins[j * width : (j + 1) * width] = letter, origin
        ends = [(cost[i], self.audit(letters, origins, n, i)) for i in self.final if cost[i] < FAR]
        return min(ends)

    def audit(self, letters: bytearray, origins: bytearray, n: int, item: int) -> str:
        width, out, j = len(self.items), bytearray(), n
        done = {i for i, _ in self.completions}
        waits = {to for _, to in self.completions}
        while True:
            at = j * width + item
            edit, before = letters[at], origins[at]
            if item in waits and before in done:  # by completion: the edit is that of the item completed
                item = before
                continue
            if not edit:
                return out.decode()
            out.append(edit)
            item, j = before, j if edit == 73 else j - 1


_GRAMMAR = Grammar()


@lru_cache(KNOWN)
def _short(initials: bytes, facts: bytes) -> tuple[int, str]:
    return _GRAMMAR.parse(initials, facts)


def repaired(initials: bytes, facts: bytes) -> tuple[int, str]:
    return (_short if len(initials) <= SHORT else _GRAMMAR.parse)(initials, facts)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often the row stands there (0: it is dropped)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), F.concat_ws(":", filled("conv_id"), filled("turn")).alias("_name"))
    kind = F.crc32(F.col("_name").cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


SPACE = "[\\x20\\x09-\\x0D]"
PLACE = ["conv_id", "turn", "role", "digest"]


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("text", 256))


def row_facts(rows: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn, role, text) with the number of copies, without text: blank, cut, fresh."""
    last = F.regexp_extract("text", f"([^\\x20\\x09-\\x0D]){SPACE}*+\\z", 1)
    facts = rows.select(*PLACE, "copies", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    facts = facts.groupBy(*PLACE, "blank", "cut").agg(F.sum("copies").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = facts.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(turn).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return facts.join(first, same, "left").select(*PLACE, "copies", "blank", "cut", (F.col("_first") == turn).alias("fresh"))


def _streamed(df: DataFrame, order: list[str]) -> DataFrame:
    return df.repartition(shuffle_width(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


@dataclass
class _Facts:
    """What is known of a conversation while its rows stream in."""

    initials: bytearray
    facts: bytearray
    places: list
    counts: list
    turns: int = 0
    low: int | None = None
    high: int | None = None


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, pieces array<struct<turn:long,role:string,digest:string,letters:string>>"
_LEGAL = (b"su", b"ua", b"au")


def _parsed(f: _Facts) -> list:
    cost, audit = repaired(bytes(f.initials), bytes(f.facts))
    pieces, at, rows = [], 0, 0
    for i, letter in enumerate(audit):  # a piece ends behind the letter of its last row
        if len(pieces) + 1 < len(f.places) and rows == f.places[len(pieces) + 1][0] and audit[i - 1] != "I":
            pieces.append(audit[at:i])
            at = i
        rows += letter != "I"
    pieces.append(audit[at:])
    held = [dict(zip(("turn", "role", "digest"), place[1:]), letters=p) for place, p in zip(f.places, pieces)]
    return [f.high - f.low + 1 - f.turns if f.turns else 0, *f.counts, cost, held]


def conversations_parsed(facts: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each conversation: statistics, cost, and the audit in pieces with the place of their first row."""
    schema = "conv_id long, " + STATS
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        conv, f = None, None
        for batch in batches:
            for c, turn, role, digest, copies, blank, cut, fresh in zip(*(column.to_pylist() for column in batch.columns)):
                if f is None or c != conv:
                    if f:
                        out.append([conv, *_parsed(f)])
                    conv, f = c, _Facts(bytearray(), bytearray(), [], [0, 0, 0, 0])
                    if len(out) >= BATCH:
                        yield _batch(out, to)
                        out = []
                if copies and turn is not None and turn != f.high:
                    f.low, f.high, f.turns = turn if f.low is None else f.low, turn, f.turns + 1
                initial = ord(role[0]) if role[:1] in ROLES else 0
                raw = role[:1]
                if copies and (not f.places or len(f.initials) - f.places[-1][0] >= piece):
                    f.places.append((len(f.initials), turn, role, digest))
                for _ in range(copies):
                    if f.initials and (chr(f.initials[-1]) + raw).encode() not in _LEGAL:
                        f.counts[3] += 1
                    fault = 0 if blank else 1 if not fresh else 2 if cut else None
                    if fault is not None:
                        f.counts[fault] += 1
                    f.initials.append(initial)
                    f.facts.append((MUST_GO if blank or not fresh else 0) | (IS_CUT if cut else 0))
                    fresh = False
        if f:
            out.append([conv, *_parsed(f)])
        if out:
            yield _batch(out, to)

    return _streamed(facts, ["turn", "role", "digest"]).mapInArrow(run, schema)


def _batch(rows: list, to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=t.type) for column, t in zip(zip(*rows), to)], schema=to)


class _Writer:
    """The repaired rows of a conversation as they come, one after the other."""

    def __init__(self) -> None:
        self.hash, self.letters, self.at, self.rows, self.expect = hashlib.sha256(), "", 0, 0, "u"

    def piece(self, letters: str) -> None:
        self.inserted()
        self.letters, self.at = letters, 0

    def emit(self, role: str, text: str) -> None:
        self.hash.update(("\n" * bool(self.rows) + f"{role}:{text}").encode())
        self.rows += 1
        self.expect = "a" if role[:1] == "u" else "u"

    def inserted(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.emit(ROLES[self.expect], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.emit(role, text)
        elif edit == "R":
            self.emit(ROLES[self.expect], text)


def hashes(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The hash of each repaired conversation."""
    schema = "conv_id long, repaired_sha256 string"
    to = arrow_schema(schema)
    pieces = parsed.select("conv_id", F.inline("pieces")).select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), F.col("letters").alias("text"), F.lit(1).cast("long").alias("copies"))
    stream = rows.where("copies > 0").select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", "copies").unionByName(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        conv, writer = None, None

        def done() -> list:
            writer.inserted()
            return [conv, writer.hash.hexdigest()]

        for batch in batches:
            for c, role, kind, text, copies in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "kind", "text", "copies"))):
                if writer is None or c != conv:
                    if writer:
                        out.append(done())
                    conv, writer = c, _Writer()
                    if len(out) >= BATCH:
                        yield _batch(out, to)
                        out = []
                if kind == 0:
                    writer.piece(text)
                    continue
                for _ in range(copies):
                    writer.row(role, text)
        if writer:
            out.append(done())
        if out:
            yield _batch(out, to)

    return _streamed(stream, ["turn", "role", "digest", "kind"]).mapInArrow(run, schema)


def repair(df: DataFrame, damage: bool = True, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = damaged(df) if damage else df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), F.lit(1).cast("long").alias("copies"))
    rows = _marked(rows)
    parsed = checkpointed(conversations_parsed(row_facts(rows), piece))
    made = hashes(rows, parsed).withColumnRenamed("conv_id", "_conv")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = parsed.join(made, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat_ws("", F.col("pieces.letters")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
