"""Structure repair of conversations: the cheapest edits that make roles alternate, by a checkpointed dynamic program.

A conversation's rows, in order, are a path of edits: keep, give another role, delete, insert. The state is what was
emitted last (nothing, system, user, assistant); a backward vector holds each state's cheapest cost to the end. Such
vectors are stored only at the ends of blocks of about the square root of the longest conversation's rows:

1. every block's costs from each state to each state, blocks apart;
2. down a conversation's blocks, the vector at the end of each: the checkpoints;
3. every block's inner vectors again, backward from its checkpoint, blocks apart;
4. forward over the rows with their vectors, taking the ASCII-least letter among the edits that keep the cost.

So a conversation of any length is spread over tasks in all but the last step, whose digest of the repaired text is a
stream by nature; none of the tasks holds a conversation. Only digests of role and text go through the first three steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from larder.llm.common import stored

#: Costs of edits; TRUNCATED on top for a row without an end that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Fewest rows of a block.
BLOCK = 1_024
#: White space.
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 60
_INITIALS = "sua"
#: State after emitting an initial; only moves of ``(s?(ua)+)?`` are there.
_MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The one user or assistant turn that may follow each state.
_NEXT = {s: next((x, t) for x, t in moves.items() if x != "s") for s, moves in _MOVES.items()}
_ROLES = {"u": "user", "a": "assistant"}

Vector = tuple[int, int, int, int]


def _with_inserts(v: list[int]) -> Vector:
    v[USER] = min(v[USER], INSERT + v[ASSISTANT])
    v[ASSISTANT] = min(v[ASSISTANT], INSERT + v[USER])
    v[START] = min(v[START], INSERT + v[USER])
    v[SYSTEM] = min(v[SYSTEM], INSERT + v[USER])
    return tuple(min(x, _NEVER) for x in v)


#: Cheapest cost of each state where no row is left.
END: Vector = _with_inserts([0, _NEVER, _NEVER, 0])


@lru_cache(1 << 16)
def _before(initial: str, cut: bool, after: Vector) -> Vector:
    """The vector before a row that need not go, from the one after it."""
    extra, out = TRUNCATED * cut, []
    for s in range(4):
        best = DELETE + after[s]
        if initial in _MOVES[s]:
            best = min(best, extra + after[_MOVES[s][initial]])
        out.append(min(best, REROLE + extra + after[_NEXT[s][1]]))
    return _with_inserts(out)


def _add(v: Vector, cost: int) -> Vector:
    return tuple(min(x + cost, _NEVER) for x in v) if cost else v


def _live(kind: int, first: bool) -> bool:
    """Of a run of equal rows at one turn: whether one of them need not be deleted."""
    return first and not kind & 4


def _initial(kind: int) -> str:
    return "sua-"[kind & 3]


def _back(kind: int, n: int, first: bool, after: Vector) -> Vector:
    """The vector before a run of ``n`` equal rows; only costs' differences are looked up."""
    if not _live(kind, first):
        return _add(after, DELETE * n)
    after = _add(after, DELETE * (n - 1))
    low = min(after)
    return _add(_before(_initial(kind), bool(kind & 8), tuple(x - low if x < _NEVER else x for x in after)), low)


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs through each block, row by row from its last to its first: entry 4 * end + start."""
    unit = tuple(tuple(0 if s == e else _NEVER for s in range(4)) for e in range(4))
    at, costs = None, unit
    for b in batches:
        out = []
        for conv, block, kind, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (conv, block) != at:
                if at is not None:
                    out.append((*at, [x for v in costs for x in v]))
                at, costs = (conv, block), unit
            costs = tuple(_back(kind, n, first, v) for v in costs)
        yield _batch(out, _COSTS)
    if at is not None:
        yield _batch([(*at, [x for v in costs for x in v])], _COSTS)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector at each block's end, from the blocks' costs in falling order."""
    conv, v = None, END
    for b in batches:
        out = []
        for own, block, costs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != conv:
                conv, v = own, END
            out.append((own, block, list(v)))
            v = tuple(min(min(costs[4 * e + s] + v[e] for e in range(4)), _NEVER) for s in range(4))
        yield _batch(out, _ENDS)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector after each row; a block's checkpoint comes before its rows, which come last to first."""
    v = END
    for b in batches:
        out = []
        for conv, turn, digest, kind, n, first, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if end is not None:
                v = tuple(end)
                continue
            out.append((conv, turn, digest, kind, n, first, list(v)))
            v = _back(kind, n, first, v)
        yield _batch(out, _VECTORS)


_COSTS = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
_ENDS = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("end", pa.list_(pa.int64()))])
_VECTORS = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("digest", pa.binary()), ("kind", pa.int32()), ("n", pa.int64()), ("first", pa.bool_()), ("after", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Walk:
    """Forward over one conversation; ``lines`` receives the repaired (role, text) in order."""

    def __init__(self, conv_id, lines):
        self.conv_id, self.lines, self.state, self.cost = conv_id, lines, START, None
        self.audit: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.initial = self.due = None

    def _insert(self) -> None:
        initial, self.state = _NEXT[self.state]
        self.audit.append("I")
        self.lines(_ROLES[initial], "")

    def row(self, turn, kind: int, n: int, first: bool, after: Vector) -> None:
        live, initial, cut = _live(kind, first), _initial(kind), bool(kind & 8)
        self._count(turn, kind, n, live, initial)
        self.due = None
        now = _back(kind, n, first, after)
        if self.cost is None:
            self.cost = now[START]
        if live:
            then, extra = _add(after, DELETE * (n - 1)), TRUNCATED * cut
            while True:
                s = self.state
                if DELETE + then[s] == now[s]:
                    self.audit.append("D")
                elif INSERT + now[_NEXT[s][1]] == now[s]:
                    self._insert()
                    continue
                elif initial in _MOVES[s] and extra + then[_MOVES[s][initial]] == now[s]:
                    self.audit.append("K")
                    self.state, self.due = _MOVES[s][initial], ("K", None)
                else:
                    self.audit.append("R")
                    to, self.state = _NEXT[s]
                    self.due = ("R", _ROLES[to])
                break
        self.audit.append("D" * (n - live))

    def _count(self, turn, kind: int, n: int, live: bool, initial: str) -> None:
        if kind & 4:
            self.blank += n
        else:
            self.duplicate += n - live
            self.truncated += bool(live and kind & 8)
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn

    def text(self, role: str, text: str) -> None:
        if self.due is not None:
            self.lines(self.due[1] or role, text)
            self.due = None

    def end(self) -> tuple:
        while END[self.state]:
            self._insert()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, "".join(self.audit))


class _Digest:
    """SHA-256 of lines ``role:text`` with newlines between."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def __call__(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def take(self, conv_id) -> list:
        return []


def _walked(batches: Iterator[pa.RecordBatch], new_lines, done) -> Iterator[list]:
    """Lists of results of ``done(walk)`` over a stream of headers, rows with vectors, and the rows' texts."""
    walk = None
    for b in batches:
        out = []
        for conv_id, tag, turn, kind, n, first, after, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tag == 0:
                if walk is not None:
                    out += done(walk)
                walk = _Walk(conv_id, new_lines())
            elif tag == 1:
                walk.row(turn, kind, n, first, tuple(after))
            else:
                walk.text(role, text)
            out += walk.lines.take(walk.conv_id)
        yield out
    if walk is not None:
        yield done(walk)


class _Lines:
    """Repaired lines as rows (conversation, place, role, text)."""

    def __init__(self):
        self.rows, self.place = [], 0

    def __call__(self, role: str, text: str) -> None:
        self.rows.append((self.place, role, text))
        self.place += 1

    def take(self, conv_id) -> list[tuple]:
        out, self.rows = [(conv_id, *r) for r in self.rows], []
        return out


def _measured(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """(conv_id, conv, turn, role, text, digest, kind, n): kind holds the initial, 4 for blank, 8 for no end."""
    said, by = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    out = rows.select(F.col(conv).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"), by.alias("role"), said.alias("text"), copies.cast("long").alias("n"))
    left = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, _INITIALS)), F.substring("role", 1, 1)) - 1, F.lit(-1))
    kind = F.when(initial < 0, 3).otherwise(initial) + F.when(left == "", 4).otherwise(0) + F.when(F.substring(left, -1, 1).isin(*".!?"), 0).otherwise(8)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return out.withColumns({"kind": kind.cast("int"), "digest": digest})


def _vectors(measured: DataFrame, least_block: int) -> DataFrame:
    """(conv, turn, digest, kind, n, first, after): each run of equal rows with the vector after it."""
    own = ["conv", "turn", "digest"]
    runs = stored(measured.where("n > 0").groupBy(*own).agg(F.first("kind").alias("kind"), F.sum("n").alias("n")), "runs")
    earliest = runs.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    marked = runs.withColumn("first", F.lit(False)).unionByName(earliest.selectExpr(*own, "int(null) kind", "0L n", "true first"))
    marked = marked.groupBy(*own).agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.bool_or("first").alias("first"))
    rows = marked.sort("conv", F.col("turn").asc_nulls_first(), "digest").withColumn("pos", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    block = max(least_block, math.isqrt(longest) + 1)
    rows = rows.withColumn("block", F.expr(f"pos div {block}"))
    falling = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("pos").desc())
    costs = stored(falling.select("conv", "block", "kind", "n", "first").mapInArrow(_block_costs, "conv string, block long, costs array<long>"), "costs")
    down = costs.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    ends = stored(down.mapInArrow(_checkpoints, "conv string, block long, end array<long>"), "checkpoints")
    both = rows.withColumn("end", F.lit(None).cast("array<long>")).unionByName(ends.withColumn("pos", F.lit((1 << 63) - 1)), allowMissingColumns=True)
    both = both.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("pos").desc())
    return both.select(*own, "kind", "n", "first", "end").mapInArrow(_inner, "conv string, turn long, digest binary, kind int, n long, first boolean, after array<long>")


def _stream(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None, least_block: int) -> DataFrame:
    measured = _measured(rows, conv, turn, role, text, F.lit(1) if copies is None else copies)
    heads = measured.groupBy("conv").agg(F.first("conv_id").alias("conv_id")).withColumn("tag", F.lit(0))
    vectors = _vectors(measured, least_block).withColumn("tag", F.lit(1))
    texts = measured.where("n > 0").select("conv", "turn", "digest", "role", "text", F.lit(2).alias("tag"))
    all_ = heads.unionByName(vectors, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    dealt = all_.repartition("conv").sortWithinPartitions("conv", F.col("tag") > 0, F.col("turn").asc_nulls_first(), "digest", "tag")
    return dealt.select("conv_id", "tag", "turn", "kind", "n", "first", "after", "role", "text")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, least_block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first), rows of one turn by the digest of role and text. A null role or text is one space. A row
    is blank without other than white space, a duplicate where role and text came before, truncated where its last
    character but white space is none of ``.!?``; the first of these counts. Keeping a row costs 0, another role 1, deleting
    2, inserting an empty user or assistant turn 5, and a truncated row that stays 5; blank and duplicate rows go. The edits
    are the cheapest that give roles ``(s?(ua)+)?`` by their initials, of equal ones those of ASCII-least letters (D, I, K,
    R). ``gaps``: turns missing between the least and the greatest. ``copies``: how often each row counts; a conversation
    of no rows comes with zeros. Null is a conversation of its own; equal rows are duplicates; other columns are ignored.
    An empty table gives an empty result.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    own = pa.schema([("conv_id", to_arrow_type(rows.schema[conv].dataType)), *[(x, pa.int64()) for x in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _walked(batches, _Digest, lambda w: [(*w.end(), w.lines.sha.hexdigest())]):
            yield _batch(found, own)

    return _stream(rows, conv, turn, role, text, copies, least_block).mapInArrow(run, from_arrow_schema(own))


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, least_block: int = BLOCK) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text; edits as in :func:`repaired`."""
    own = pa.schema([("conv_id", to_arrow_type(rows.schema[conv].dataType)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def done(walk: _Walk) -> list[tuple]:
        walk.end()
        return walk.lines.take(walk.conv_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _walked(batches, _Lines, done):
            yield _batch(found, own)

    return _stream(rows, conv, turn, role, text, copies, least_block).mapInArrow(run, from_arrow_schema(own))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by the CRC-32 of ``conv_id:turn`` modulo 20, and how often each row counts then.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    out = rows.select("conv_id", "turn", "role", "text").withColumn("__fault", fault).withColumns({"text": text, "role": role})
    return out, F.when(F.col("__fault") == 0, 0).when(F.col("__fault") == 3, 2).otherwise(1)
