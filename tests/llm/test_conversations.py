"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import cache

from pyspark.sql import functions as F

from quillstone.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of damaged rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.rstrip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]

    def goes(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    @cache
    def best(i, state, inserted):
        """The least (cost, audit, lines) from row i; at most two inserts in a row can help."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            for c, name in (("u", "user"), ("a", "assistant")):
                if goes(state, c):
                    cost, audit, lines = best(i, goes(state, c), inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for edit, cost_of, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    to = goes(state, name[:1])
                    if to:
                        cost, audit, lines = best(i + 1, to, 0)
                        found.append((cost + cost_of + more, edit + audit, (f"{name}:{text}", *lines)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    count = faults.count
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        out.setdefault(conv, []).append((turn, role, text))
    return out


def talks(draw):
    rows = []
    roles = ["user", "assistant", "system", "tool", "", "unknown", None, "ß"]
    for conv in range(60):
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9])):
            common = ["user", "assistant"][turn % 2]
            role = common if draw.random() < 0.6 else draw.choice(roles)
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, draw.choice([f"Say {turn}.", f"What {draw.random()}?", "no end", "", " \n", None, "Same.", "é!", "x ", "End. \t"])))
    rows += [(None, k, r, f"t{k}.") for k, r in enumerate(["user", "user", "assistant"])] + [(500, None, "user", "a."), (500, None, "user", "a."), (501, 7, "system", "Only.")]
    # one conversation with more rows than a range, some of them in long runs
    rows += [(77, k, "user" if k % 90 < 60 else "assistant", f"line {k}." if k % 7 else "line") for k in range(900)]
    return rows


def test_repair(spark):
    rows = talks(random.Random(3))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    frame = frame.withColumn("edge", F.lit(1)).withColumn("audit", F.lit("clash"))
    import sys
    sys.setrecursionlimit(20_000)
    own = by_conversation(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = {c: plain(own[c]) if c in own else empty for c in {r[0] for r in rows}}
    path = C.stash(frame, "all").inputFiles()[0].rsplit("/", 1)[0]
    import os
    import tempfile

    top = tempfile.mkdtemp()
    os.symlink(path.removeprefix("file://").removeprefix("file:"), f"{top}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in C.query(spark, top).collect()}
    assert found.keys() == wanted.keys()
    for c in wanted:
        assert found[c] == wanted[c], (c, own.get(c))
    import duckdb

    short = frame.filter("conv_id IS NULL OR conv_id <> 77").select("conv_id", "turn", "role", "text").toPandas()
    con = duckdb.connect()
    con.register("conversations", short.astype({"conv_id": "Int64", "turn": "Int64"}))
    rows_of = con.execute(C.ORACLE)
    names = [d[0] for d in rows_of.description]
    told = {r[names.index("conv_id")]: tuple(r[names.index(c)] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows_of.fetchall()}
    assert told == {c: w for c, w in wanted.items() if c != 77}


def test_repaired_rows_are_right(spark):
    rows = damage(talks(random.Random(4)))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    out = {}
    for r in sorted(C.repair(frame).rows.collect(), key=lambda r: (r["_part"], r["place"])):
        out.setdefault(r["conv_id"], []).append(r)
    import re

    given = by_conversation(rows)
    for conv, made in out.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in made))
        assert {r["text"] for r in made if r["edit"] != "I"} <= {t for _, _, t in given[conv]} and not any(r["text"] for r in made if r["edit"] == "I")
    none = C.repair(frame.limit(0))
    assert none.rows.collect() == [] and none.counts.collect() == [] and none.audits.collect() == []


def test_runs_equal_single_steps():
    draw = random.Random(9)
    for _ in range(60):
        runs = [(draw.randrange(9), draw.choice([1, 2, 3, 17, 1000])) for _ in range(draw.randint(1, 5))]
        steps = [(x, 1) for x, n in runs for _ in range(n)]
        v = C.AT_END
        for state in C.STATES:
            assert C.unrolled(runs, state, v) == C.unrolled(steps, state, v)
        assert C.product(runs) == C.product(steps)
    # a run longer than can be walked is passed by its powers
    assert C.passed(C.GONE, 10**15, C.AT_END)[C.BEGIN] == 3 * 10**15
