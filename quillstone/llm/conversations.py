"""Cheapest repairs of the structure of conversations.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Rows can be
kept, get another role, be deleted, and rows can be inserted; the cheapest way
is found by dynamic programming over the rows and four states: nothing so far,
after system, after user, after assistant. To the programme a row is one of
nine symbols, and equal neighbours are collapsed to runs. A symbol's step is a
4 x 4 matrix in which sums take the place of products and minima that of sums;
its powers of two are cached, and a run is passed by the powers that make up its
length. The choices are unrolled forwards, each the first by name among those
that still lead to the least cost.

Conversations are cut into segments by ranges of all rows in order, so that one
of any length is shared by many tasks. The driver sees the matrices of those
segments that may go on in another range, two a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.ranges import BOUND_CHARS, dealt, range_of, sampled_bounds
from quillstone.llm.storage import bounded, row_key, stash

NAME = "op11_conversation_repair"
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"

# -- costs ------------------------------------------------------------------------

BEGIN, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = "sua"
#: Neighbouring initials that may stand together, and the state after a row of each initial.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: What may follow each state, as the state it leads to: rows with a role of an initial, and those added or given a role.
FOLLOWS = {0: {BEGIN: SYSTEM}, 1: {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
NEXT = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
#: A symbol is an initial (3 is any other), 4 more if the row is truncated; GONE has to be deleted.
GONE = 8
#: What is still to be inserted at the end, after each state.
CLOSING = ("", "II", "I", "")
AT_END = tuple(INSERT * len(c) for c in CLOSING)


def times(a: list, b: list) -> list:
    return [[min(a[p][k] + b[k][q] for k in STATES) for q in STATES] for p in STATES]


def before(m: list, v: tuple) -> tuple:
    """Costs to go ahead of a step, from those after it."""
    return tuple(min(m[p][q] + v[q] for q in STATES) for p in STATES)


IDENTITY = [[0 if p == q else FAR for q in STATES] for p in STATES]


def _inserts() -> list:
    once = [[min(IDENTITY[p][q], INSERT if q == NEXT[p] else FAR) for q in STATES] for p in STATES]
    return times(once, times(once, once))


def _row(symbol: int) -> list:
    m = [[DELETE if p == q else FAR for q in STATES] for p in STATES]
    if symbol != GONE:
        more = TRUNCATED * (symbol // 4)
        for p in STATES:
            m[p][NEXT[p]] = min(m[p][NEXT[p]], REROLE + more)
            if p in FOLLOWS[symbol % 4]:
                q = FOLLOWS[symbol % 4][p]
                m[p][q] = min(m[p][q], more)
    return m


#: For each symbol, its step's powers of two as far as they have been asked for.
POWERS = [[times(_inserts(), _row(x))] for x in range(9)]


def powers(symbol: int, n: int) -> Iterator[list]:
    """The cached powers of two of a symbol's step that make up ``n`` steps."""
    own, k = POWERS[symbol], 0
    while n >> k:
        if len(own) <= k:
            own.append(times(own[-1], own[-1]))
        if n >> k & 1:
            yield own[k]
        k += 1


def passed(symbol: int, n: int, v: tuple) -> tuple:
    """Costs to go ahead of a run of ``n`` equal symbols."""
    for m in powers(symbol, n):
        v = before(m, v)
    return v


def product(runs: list[tuple[int, int]]) -> list:
    out = IDENTITY
    for symbol, n in runs:
        for m in powers(symbol, n):
            out = times(out, m)
    return out


_CHOICES: dict[tuple, tuple[str, int]] = {}


def choice(symbol: int, state: int, v: tuple) -> tuple[str, int]:
    """The edits up to and with a row, the first by name of those of least cost, and the state after it; ``v`` is what comes after the row."""
    least = min(v)
    key = (symbol, state, tuple(x - least for x in v))
    if key not in _CHOICES:
        w, out, p = before(POWERS[symbol][0], v), "", state
        row = symbol % 4 if symbol != GONE else None
        more = TRUNCATED * (symbol // 4)
        while True:
            if DELETE + v[p] == w[p]:
                end = ("D", p)
            elif INSERT + w[NEXT[p]] == w[p]:
                out, p = out + "I", NEXT[p]
                continue
            elif row is not None and p in FOLLOWS[row] and more + v[FOLLOWS[row][p]] == w[p]:
                end = ("K", FOLLOWS[row][p])
            else:
                end = ("R", NEXT[p])
            break
        _CHOICES[key] = (out + end[0], end[1])
    return _CHOICES[key]


#: Rows of a run whose costs are held at once.
BLOCK = 4096


def unrolled(runs: list[tuple[int, int]], state: int, v: tuple) -> tuple[str, int, int]:
    """The edits of a stretch of rows from ``state``, with costs ``v`` to go after it; the state after it, and the edits' cost."""
    after = [v]
    for symbol, n in reversed(runs):
        after.append(passed(symbol, n, after[-1]))
    first, out = after[-1][state], []
    for (symbol, n), end in zip(runs, after[-2::-1], strict=True):
        done = 0
        while done < n:
            block = min(BLOCK, n - done)
            inside = [passed(symbol, n - done - block, end)]
            for _ in range(block - 1):
                inside.append(before(POWERS[symbol][0], inside[-1]))
            for u in reversed(inside):
                edits, state = choice(symbol, state, u)
                out.append(edits)
            done += block
    return "".join(out), state, first - v[state]


# -- rows ---------------------------------------------------------------------------

def _turn_key() -> Column:
    return F.struct(F.col("turn").isNotNull().cast("int").alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))


def faults(turns: DataFrame) -> DataFrame:
    """Different rows of conversations: conv_id, turn, role, text, copies, ``fault`` and ``initial`` (a number; 3 for others).

    ``fault`` is that of the first copy: blank, duplicate, truncated or null;
    further copies of a row that is not blank are duplicates. A null role or
    text reads as one space. ``turns`` may have ``copies``, by default 1.
    """
    copies = F.col("copies").cast("bigint") if "copies" in turns.columns else F.lit(1).cast("bigint")
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_like", row_key("role", "text"))
    seen = rows.groupBy("conv_id", "_like").agg(F.min(_turn_key()).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("_like").alias("_other"), "_first")
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_like") == F.col("_other")), "left")
    said = F.rtrim("text", F.lit(WHITE))
    fault = F.when(said == "", "blank").when(_turn_key() > F.col("_first"), "duplicate").when(~F.right(said, F.lit(1)).isin(*ENDS), "truncated")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", fault.alias("fault"), F.when((initial < 0) | (F.col("role") == ""), 3).otherwise(initial).cast("int").alias("initial"),
    )


def fault_counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of the rows of ``faults``."""
    total = lambda c, n: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
    blank, again = F.col("fault") == "blank", F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        total(blank, F.col("copies")).alias("blank"),
        total(F.coalesce(~blank, F.lit(True)), F.col("copies") - F.when(again, 0).otherwise(1)).alias("duplicate"),
        total(F.col("fault") == "truncated", F.lit(1)).alias("truncated"),
    )


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``: ranges by conversation, turn, role and text, and the place within each."""
    null = lambda c: F.col(c).isNotNull().cast("int")
    zero = F.lit(0).cast("bigint")
    key = [null("conv_id").alias("c"), F.coalesce(F.col("conv_id").cast("bigint"), zero).alias("conv"), null("turn").alias("t"), F.coalesce("turn", zero).alias("turn")]
    cut = F.struct(*key, F.substring("role", 1, BOUND_CHARS).alias("role"), F.substring("text", 1, BOUND_CHARS).alias("text"))
    bounds = sampled_bounds(rows, cut, parts)
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", range_of(F.struct(*key, "role", "text"), F.col("_bounds"), parts)).drop("_bounds")  # one row
    return dealt(ranged, parts, "conv_id", "turn", "role", "text").withColumn("_at", F.monotonically_increasing_id())


SEGMENT = "conv_id bigint, _part int, symbols binary, lengths array<bigint>, first int, last int, illegal bigint, edge boolean, matrix array<bigint>"


class _Segment:
    """The rows of one conversation in one range, collapsed as they come."""

    def __init__(self, conv, part: int, edge: bool):
        self.conv, self.part, self.edge, self.runs, self.first, self.last, self.illegal = conv, part, edge, [], None, None, 0

    def add(self, symbol: int, n: int, initial: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])
        if self.last is None:
            self.first, self.illegal = initial, n - 1
        else:
            self.illegal += n - 1 + ((self.last, initial) not in LEGAL)
        self.last = initial

    def row(self) -> tuple:
        matrix = [x for r in product(self.runs) for x in r] if self.edge else None
        return (self.conv, self.part, bytes(r[0] for r in self.runs), [r[1] for r in self.runs], self.first, self.last, self.illegal, self.edge, matrix)


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("_part", pa.int32()), ("symbols", pa.binary()), ("lengths", pa.list_(pa.int64())), ("first", pa.int32()), ("last", pa.int32()), ("illegal", pa.int64()),
    ("edge", pa.bool_()), ("matrix", pa.list_(pa.int64())),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a range, from its rows in order."""
    now = None
    for batch in batches:
        out = []
        for part, conv, initial, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("_part", "conv_id", "initial", "fault", "copies")), strict=True):
            if now is None or (now.conv, now.part) != (conv, part):
                if now:
                    now.edge |= now.part != part
                    out.append(now.row())
                now = _Segment(conv, part, now is None or now.part != part)
            gone = fault in ("blank", "duplicate")
            now.add(GONE if gone else initial + 4 * (fault == "truncated"), copies if gone else 1, initial)
            if copies > 1 and not gone:
                now.add(GONE, copies - 1, initial)
        if out:
            yield _batch(out, _SEGMENT)
    if now:
        now.edge = True
        yield _batch([now.row()], _SEGMENT)


class Plan(NamedTuple):
    """Where a segment that others follow or go before begins and ends: state, costs to go after it, whether it is the last, illegal neighbours where it meets the one before."""

    state: int
    after: tuple
    last: bool
    illegal: int


WHOLE = Plan(BEGIN, AT_END, True, 0)


def plans(segments: DataFrame) -> dict[tuple, Plan]:
    """A plan for each segment of a conversation that several ranges share; at most two for each range."""
    chains: dict = {}
    for r in segments.filter("edge").select("conv_id", "_part", "matrix", "first", "last").collect():  # two a range
        chains.setdefault(r["conv_id"], []).append(r)
    chains = {c: sorted(rs, key=lambda r: r["_part"]) for c, rs in chains.items() if len(rs) > 1}
    if not chains:
        return {}
    after = {}
    for conv, rs in chains.items():
        v = AT_END
        for r in reversed(rs):
            after[conv, r["_part"]] = v
            v = before([r["matrix"][4 * p : 4 * p + 4] for p in STATES], v)

    def ends(batches):
        for batch in batches:
            out = []
            for conv, part, symbols, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_part", "symbols", "lengths")), strict=True):
                if (conv, part) in after:
                    out.append((conv, part, [unrolled(list(zip(symbols, lengths, strict=True)), p, after[conv, part])[1] for p in STATES]))
            if out:
                yield _batch(out, pa.schema([("conv_id", pa.int64()), ("_part", pa.int32()), ("ends", pa.list_(pa.int64()))]))

    maps = {(r["conv_id"], r["_part"]): r["ends"] for r in segments.filter("edge").mapInArrow(ends, "conv_id bigint, _part int, ends array<bigint>").collect()}  # two a range
    out = {}
    for conv, rs in chains.items():
        state, last = BEGIN, None
        for k, r in enumerate(rs):
            key = (conv, r["_part"])
            out[key] = Plan(state, after[key], k == len(rs) - 1, int(last is not None and (last, r["first"]) not in LEGAL))
            state, last = maps[key][state], r["last"]
    return out


AUDIT = "conv_id bigint, _part int, audit string, cost bigint, illegal bigint"


def audits(segments: DataFrame, known: dict[tuple, Plan]) -> DataFrame:
    """``AUDIT`` for each segment: its edits, and what they cost; ``known`` are the plans of those that share a conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("_part", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def make(batches):
        for batch in batches:
            out = []
            for conv, part, symbols, lengths, illegal in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_part", "symbols", "lengths", "illegal")), strict=True):
                plan = known.get((conv, part), WHOLE)
                edits, state, cost = unrolled(list(zip(symbols, lengths, strict=True)), plan.state, plan.after)
                close = CLOSING[state] if plan.last else ""
                out.append((conv, part, edits + close, cost + INSERT * len(close), illegal + plan.illegal))
            if out:
                yield _batch(out, schema)

    return segments.mapInArrow(make, AUDIT)


REPAIRED = "conv_id bigint, _part int, place bigint, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("_part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
NAMES = {USER: "user", ASSISTANT: "assistant"}


class _Editor:
    """Applies the edits of a segment to its rows as they come."""

    def __init__(self, conv, part: int, audit: str, state: int):
        self.conv, self.part, self.audit, self.state, self.at, self.place = conv, part, audit, state, 0, 0

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self.made("I", NAMES[self.state], "")

    def made(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.part, self.place, edit, role, text)

    def row(self, role: str, text: str, initial: int, copies: int) -> Iterator[tuple]:
        for _ in range(copies):
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = FOLLOWS[initial][self.state]
                yield self.made(edit, role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                yield self.made(edit, NAMES[self.state], text)


def _edit(starts: dict[tuple, int]):
    def apply(batches):
        now = None
        for batch in batches:
            out = []
            for part, conv, audit, role, text, initial, copies in zip(*(batch.column(c).to_pylist() for c in ("_part", "conv_id", "audit", "role", "text", "initial", "copies")), strict=True):
                if audit is not None:
                    if now:
                        out.extend(now.inserts())
                    now = _Editor(conv, part, audit, starts.get((conv, part), BEGIN))
                else:
                    out.extend(now.row(role, text, initial, copies))
            if out:
                yield _batch(out, _REPAIRED)
        if now and (rest := list(now.inserts())):
            yield _batch(rest, _REPAIRED)

    return apply


class Repair(NamedTuple):
    """What ``repair`` finds: fault counts and audits by conversation, and the repaired rows."""

    counts: DataFrame
    audits: DataFrame
    rows: DataFrame


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text, and maybe copies; other columns are ignored).

    ``counts``: conv_id, gaps, blank, duplicate, truncated. ``audits``:
    conv_id, cost, audit, illegal. ``rows``: ``REPAIRED``, in the order of
    conv_id, ``_part`` and ``place``. Rows are taken by turn, nulls first, then
    role and text; repeated rows follow each other. A null conv_id is a
    conversation, a null role or text a space. A conversation without rows has
    no row in any of the tables.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    rows = stash(in_order(stash(faults(turns), "turns"), parts), "turns-in-order")
    short = bounded(rows).select("_part", "_at", "conv_id", "initial", "fault", "copies")
    segments = stash(dealt(short, parts, "_at").mapInArrow(_collapse, SEGMENT), "segments")
    known = plans(segments)
    made = stash(audits(segments, known), "audits")
    starts = {k: p.state for k, p in known.items()}
    columns = ("_part", "conv_id", "_at", "role", "text", "initial", "copies", "audit")
    head = made.select("_part", "conv_id", F.lit(-1).cast("bigint").alias("_at"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("initial", "int"), ("copies", "bigint"))), "audit")
    both = head.union(rows.withColumn("audit", F.lit(None).cast("string")).select(*columns))
    fixed = dealt(both, parts, "conv_id", "_at").mapInArrow(_edit(starts), REPAIRED)
    # a row for each range that a conversation is in
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "audit"))), lambda s: s.audit), "")
    whole = made.groupBy("conv_id").agg(F.sum("cost").alias("cost"), joined.alias("audit"), F.sum("illegal").alias("illegal"))
    return Repair(fault_counts(rows), whole, fixed)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows: ``role:text`` of each, joined by newlines.

    A digest of this kind has to see a conversation's rows one after another,
    so they stream through one task, a batch at a time.
    """
    def digest(batches):
        now = key = None
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != key:
                    if now:
                        out.append((key, now.hexdigest()))
                    now, key = hashlib.sha256(), conv
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, schema)
        if now:
            yield _batch([(key, now.hexdigest())], schema)

    own = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "place").select("conv_id", "role", "text")
    return own.mapInArrow(digest, "conv_id bigint, repaired_sha256 string")


# -- the query -----------------------------------------------------------------------------

def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` after the damage that the query does, with ``copies``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    k = F.col("_kind")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).cast("bigint").alias("copies"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns))
    tables = (turns.select("conv_id").distinct(), found.counts, found.audits, digests(found.rows))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """The same by a recursion from each conversation's last row to its first.

    For each state it keeps the least cost, edits and lines of what is left.
    DuckDB has no CRC-32, so its table is made first.
    """
    ops = []
    for p in STATES:
        own = [f"{{'c': s[{p + 1}].c + {DELETE}, 'a': 'D' || s[{p + 1}].a, 'l': s[{p + 1}].l}}"]
        for k, letter in enumerate(INITIALS):
            if p in FOLLOWS[k]:
                t = FOLLOWS[k][p] + 1
                own.append(f"{{'c': CASE WHEN gone OR initial <> '{letter}' THEN 1000000 ELSE s[{t}].c + more END, 'a': 'K' || s[{t}].a, 'l': chr(10) || role || ':' || text || s[{t}].l}}")
        t = NEXT[p]
        own.append(f"{{'c': CASE WHEN gone THEN 1000000 ELSE s[{t + 1}].c + {REROLE} + more END, 'a': 'R' || s[{t + 1}].a, 'l': chr(10) || '{NAMES[t]}:' || text || s[{t + 1}].l}}")
        ops.append(f"list_sort([{', '.join(own)}])[1]")
    led = []
    for p in STATES:
        own, at, lines = [f"z[{p + 1}]"], p, ""
        for n in (1, 2):
            at = NEXT[at]
            lines += f" || chr(10) || '{NAMES[at]}:'"
            own.append(f"{{'c': z[{at + 1}].c + {n * INSERT}, 'a': '{'I' * n}' || z[{at + 1}].a, 'l': ''{lines} || z[{at + 1}].l}}")
        led.append(f"list_sort([{', '.join(own)}])[1]")
    last = ", ".join(f"{{'c': {c}, 'a': '{e}', 'l': {' || '.join([repr('')] + [f'chr(10) || {n!r}' for n in names])}}}" for c, e, names in zip(AT_END, CLOSING, ([], ["user:", "assistant:"], ["assistant:"], []), strict=True))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT *, list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)) AS b FROM conversations),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(b, lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS k FROM k, t),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c
  FROM src WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS nth,
  rtrim(text, {white}) AS said, left(role, 1) AS initial FROM dam),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, coalesce(fault = 'truncated', false)::INT AS more FROM f),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
r AS (SELECT conv_id, n + 1 AS i, [{last}] AS s FROM n
  UNION ALL SELECT conv_id, i, [{', '.join(led)}] FROM (SELECT g.conv_id, g.i, [{', '.join(ops)}] AS z FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i - 1)),
d AS (SELECT conv_id, s[1] AS s FROM r WHERE i = 1)
SELECT a.conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in COUNTS[:-1])}, coalesce(d.s.c, 0)::BIGINT AS cost, coalesce(d.s.a, '') AS audit, sha256(substr(coalesce(d.s.l, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _oracle()
