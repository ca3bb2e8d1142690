"""Conversation structure repair by shortest paths.

A conversation's rows, in order of turn (nulls first), then role, then text, become a graph: a node says how many
rows were read and which role was written last, an arc is an edit: Keep, Rerole, Delete, Insert. Costs are small
whole numbers, so the distance of every node to the end comes from Dial's queue: a ring of as many buckets as the
dearest arc costs. The audit is the walk from the start that takes, of the arcs on a shortest path, always the
letter that comes first in ASCII. An edit's new role follows from the role before it, so a walk and its letters tell each
other.

Only roles' initials and faults matter to the graph: they are a byte a row, and short conversations that are
alike share one result.

A conversation may hold any share of all rows. Rows that repeat are one row with a count. The rows are range
partitioned by conversation and order, and a task cuts what it reads into segments, of a conversation each and
bounded. Most conversations are one segment. For the others each segment gives the distances between what may come in
and what may go out of it (four states), a conversation's segments (one small row each) are put together from the
end, and then each segment walks its part. Only a hash of all of a long conversation has to read it in order, row by row
(SHA-256 is a chain); its audit, a letter a row, is a value of the result.

Defined results: a null role or text counts as one space; a null conv_id is a conversation; rows of a null turn
come first; a role whose initial is none of s, u and a cannot be kept; a conversation of which no row is left has
zeros, an empty audit and the hash of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, table

#: Rows and bytes of text of a segment at most (and one row more).
SEGMENT_ROWS, SEGMENT_BYTES = 1 << 16, 8 << 20
#: Rows of a conversation whose result a worker remembers, and how many of these.
_ALIKE_ROWS, _ALIKE = 64, 100_000

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
_BLANKS = " \t\n\v\f\r"
# Nothing yet, and after a system, user or assistant row; where each leads with the next row's role (s, u, a, other), and with a row that is inserted or given a role.
_START, _S, _U, _A = range(4)
_NEXT = ((_S, _U, None, None), (None, _U, None, None), (None, None, _A, None), (None, _U, None, None))
_MADE = (_U, _U, _A, _U)
_ROLE = {_U: "user", _A: "assistant"}
FINE, CUT_SHORT, MUST_GO = range(3)
INFINITE = 1 << 60


def role_class(role: str) -> int:
    return "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3


def symbol(role: int, fault: int) -> int:
    return fault * 4 + role


def edits(mark: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state, in ASCII order: letter, cost, new state."""
    fault, role = divmod(mark, 4)
    out = [("D", DELETE, state)]
    if fault != MUST_GO:
        more = TRUNCATED * (fault == CUT_SHORT)
        if _NEXT[state][role] is not None:
            out.append(("K", more, _NEXT[state][role]))
        out.append(("R", REROLE + more, _MADE[state]))
    return out


_EDITS = [[edits(mark, state) for state in range(4)] for mark in range(12)]
# The same backwards: for a mark and the state behind it, steps to the nodes before it, and their costs.
_INTO = [[[(s - t - 4, c) for s in range(4) for _, c, to in _EDITS[mark][s] if to == t] for t in range(4)] for mark in range(12)]
_INSERTED = [[s - t for s in range(4) if _MADE[s] == t] for t in range(4)]
_DEAREST = max(INSERT, max(c for row in _EDITS for es in row for _, c, _ in es))


def distances(marks: bytes, ends: tuple[int, ...]) -> list[int]:
    """The distance of every node (4 * rows read + state) to the end, where ``ends`` are those of the last four."""
    n, low, high = len(marks), min(ends), max((e for e in ends if e < INFINITE), default=0)
    dist = [INFINITE] * (4 * n + 4)
    if low >= INFINITE:
        return dist
    ring = [[] for _ in range(max(_DEAREST, high - low) + 1)]
    waiting = 0
    for t, e in enumerate(ends):
        if e < INFINITE:
            dist[4 * n + t] = e - low
            ring[(e - low) % len(ring)].append(4 * n + t)
            waiting += 1
    d = 0
    while waiting:
        bucket = ring[d % len(ring)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue
            t = node & 3
            for step in _INSERTED[t]:
                if d + INSERT < dist[node + step]:
                    dist[node + step] = d + INSERT
                    ring[(d + INSERT) % len(ring)].append(node + step)
                    waiting += 1
            if node > 3:
                for step, cost in _INTO[marks[(node >> 2) - 1]][t]:
                    if d + cost < dist[node + step]:
                        dist[node + step] = d + cost
                        ring[(d + cost) % len(ring)].append(node + step)
                        waiting += 1
        d += 1
    return [x + low if x < INFINITE else x for x in dist]


def walk(marks: bytes, dist: list[int], ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """The letters of the ASCII-least shortest path from a state, and the state it ends in. It stops at the first node behind all rows that is as far from the end as ``ends`` allows."""
    out, at, n = [], 0, len(marks)
    while at < n or dist[4 * n + state] != ends[state]:
        own = dist[4 * at + state]
        here = [("I", INSERT, _MADE[state], at)]
        if at < n:
            here += [(letter, cost, to, at + 1) for letter, cost, to in _EDITS[marks[at]][state]]
            here.sort()
        for letter, cost, to, then in here:
            if own == cost + dist[4 * then + to]:
                out.append(letter)
                at, state = then, to
                break
        else:
            raise AssertionError("a node without a tight arc")
    return "".join(out), state


#: A whole conversation may end as it began, or after an assistant.
_WHOLE = (0, INFINITE, INFINITE, 0)


def _solved(marks: bytes) -> tuple[int, str]:
    dist = distances(marks, _WHOLE)
    return dist[0], walk(marks, dist, _WHOLE, _START)[0]


_remembered = lru_cache(_ALIKE)(_solved)


def solved(marks: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's marks."""
    return (_remembered if len(marks) <= _ALIKE_ROWS else _solved)(marks)


class Replay:
    """The rows that an audit makes of a conversation's."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = _MADE[self.state], self.at + 1
            yield _ROLE[self.state], ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = _NEXT[self.state][role_class(role)]
            yield role, text
        elif letter == "R":
            self.state = _MADE[self.state]
            yield _ROLE[self.state], text


class _Hash:
    """SHA-256 of role:text, joined by newlines."""

    def __init__(self):
        self.own, self.any = hashlib.sha256(), False

    def add(self, rows) -> None:
        for role, text in rows:
            self.own.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True


class _Segment:
    """What is read of one conversation by one task, up to a bound."""

    def __init__(self, conv, number: int, cut: bool = False):
        self.conv, self.number, self.cut = conv, number, cut
        self.marks, self.rows, self.bytes = bytearray(), [], 0
        self.counts = [0, 0, 0]
        self.low = self.high = None
        self.turns = 0

    def seen(self, turn) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def add(self, turn, role: str, text: str, copies: int, first: bool) -> None:
        self.seen(turn)
        kind, stripped = role_class(role), text.rstrip(_BLANKS)
        if not stripped:
            self.counts[0] += copies
            self.marks += bytes([symbol(kind, MUST_GO)]) * copies
        else:
            if first:
                short = stripped[-1] not in ".!?"
                self.counts[2] += short
                self.marks.append(symbol(kind, CUT_SHORT if short else FINE))
            self.counts[1] += copies - first
            self.marks += bytes([symbol(kind, MUST_GO)]) * (copies - first)
        self.rows.append((role, text, copies))
        self.bytes += len(text)

    def result(self, task: int, edge: bool) -> dict:
        marks = bytes(self.marks)
        cost, audit = solved(marks)
        made, replay = _Hash(), Replay(audit)
        for role, text, copies in self.rows:
            for _ in range(copies):
                made.add(replay.row(role, text))
        made.add(replay.inserted())
        out = {"conv_id": self.conv, "task": task, "number": self.number, "edge": edge, "n": len(marks), "low": self.low, "high": self.high, "turns": self.turns, "blank": self.counts[0], "duplicate": self.counts[1], "truncated": self.counts[2], "illegal": illegal(marks)}
        out |= {"cost": cost, "audit": audit, "repaired_sha256": made.own.hexdigest(), "marks": None, "through": None}
        if edge:
            out["marks"] = marks
            # From each state before the segment to each behind it.
            behind = [distances(marks, tuple(0 if t == k else INFINITE for k in range(4)))[:4] for t in range(4)]
            out["through"] = [behind[t][s] for s in range(4) for t in range(4)]
        return out


def illegal(marks: bytes) -> int:
    """Neighbouring rows whose roles may not stand so."""
    roles = np.frombuffer(marks, dtype=np.uint8) & 3
    pairs = roles[:-1] * 4 + roles[1:]
    return int(np.count_nonzero(~np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) that are alike as one, with the sum of copies."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))


def _key(n: str):
    return F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))


def marked(rows: DataFrame) -> DataFrame:
    """Different rows with their copies, and whether a conversation has the row's role and text here first. The first turn of each comes from an aggregation and goes back by all of a row's key, so no key is hot."""
    own = _counted(rows).withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    there = own.where("copies > 0").groupBy("conv_id", "same").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    there = there.select("conv_id", "same", F.when(~F.col("none"), F.col("least")).alias("turn"))
    joined = own.alias("x").join(there.alias("y"), _key("conv_id") & _key("turn") & _key("same"), "left")
    return joined.select("x.conv_id", "x.turn", "x.role", "x.text", "x.copies", F.col("y.same").isNotNull().alias("first"))


_FIELDS = "task int, number bigint, edge boolean, n bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, marks binary, through array<bigint>"


def _schema(df: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T.StructType.fromDDL(rest).fields])


def _batch(rows: list[dict], like: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(like))


def segments(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of all conversations, each with its result as if it were all; ``edge`` where it may not be, and then with its marks and the distances through it. Write it before use."""
    schema = _schema(rows, _FIELDS)

    def run(batches):
        task, number, own, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own.conv != conv:
                    if own:
                        done.append(own.result(task, edge=own.number == 0 or own.cut))
                        number += 1
                    own = _Segment(conv, number)
                while copies:
                    some = min(copies, most_rows)
                    own.add(turn, role, text, some, first)
                    copies, first = copies - some, False
                    if len(own.marks) >= most_rows or own.bytes >= most_bytes:
                        done.append(own.result(task, edge=True))
                        number += 1
                        own = _Segment(conv, number, cut=True)
            if done:
                yield _batch(done, schema)
                done = []
        if own:
            yield _batch([own.result(task, edge=True)], schema)

    ordered = marked(rows).repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def _through(through: list[int], ends: tuple[int, ...]) -> tuple[int, ...]:
    """The distances before a segment, by those behind it."""
    return tuple(min(min(through[4 * s + t] + ends[t], INFINITE) for t in range(4)) for s in range(4))


def _combined(parts: DataFrame) -> DataFrame:
    """Conversations of several segments: what repair() gives, but the hash."""
    kind = parts.schema["conv_id"].dataType

    def behind(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["task"], r["number"]))
        ends = reduce(lambda e, r: [_through(r["through"], e[0]), *e], reversed(rows), [_WHOLE])
        out = [{"task": r["task"], "number": r["number"], "ends": list(e), "whole": ends[0][_START]} for r, e in zip(rows, ends[1:], strict=True)]
        return pa.Table.from_pylist(out, schema=pa.schema([("task", pa.int32()), ("number", pa.int64()), ("ends", pa.list_(pa.int64())), ("whole", pa.int64())]))

    ends = parts.select("conv_id", "task", "number", "through").groupBy("conv_id").applyInArrow(behind, "task int, number bigint, ends array<bigint>, whole bigint")
    names = ["conv_id", "task", "number", "n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "whole"]
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("task int, number bigint, n bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, whole bigint, roles array<int>, audits array<string>, exits array<int>").fields])

    def walked(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                e, marks = tuple(r["ends"]), r["marks"]
                dist = distances(marks, e)
                found = [walk(marks, dist, e, s) if dist[s] < INFINITE else ("", s) for s in range(4)]
                out.append({n: r[n] for n in names} | {"roles": [marks[0] & 3, marks[-1] & 3] if marks else [], "audits": [f[0] for f in found], "exits": [f[1] for f in found]})
            if out:
                yield _batch(out, schema)

    pieces = parts.join(ends, ["task", "number"]).select(*names, "marks", "ends").mapInArrow(walked, schema)
    result = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string").fields])

    def joined(t: pa.Table) -> pa.Table:
        state, audit, last, turn = _START, [], None, None
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = None
        rows = sorted(t.to_pylist(), key=lambda r: (r["task"], r["number"]))
        for r in rows:
            for n in total:
                total[n] += r[n]
            if r["roles"]:
                total["illegal"] += last is not None and (last, r["roles"][0]) not in ((0, 1), (1, 2), (2, 1))
                last = r["roles"][1]
            if r["low"] is not None:
                total["turns"] -= r["low"] == turn
                low, high, turn = r["low"] if low is None else low, r["high"], r["high"]
            audit.append(r["audits"][state])
            state = r["exits"][state]
        gaps = high - low + 1 - total.pop("turns") if low is not None else 0
        row = {"conv_id": rows[0]["conv_id"], "gaps": gaps, **total, "cost": rows[0]["whole"], "audit": "".join(audit)}
        return pa.Table.from_batches([_batch([row], result)])

    return pieces.groupBy("conv_id").applyInArrow(joined, result)


def replayed(rows: DataFrame, audits: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired rows of the conversations in ``audits`` (conv_id, audit): conv_id, place, role, text; or their hash. A conversation's rows pass through a task one after the other."""
    own = rows.alias("x").join(audits.alias("y"), _key("conv_id"), "left_semi").where("copies > 0")
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("bigint").alias("copies"))
    both = first.unionByName(_counted(own).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies"))
    schema = _schema(rows, "repaired_sha256 string" if digest else "place bigint, role string, text string")

    def run(batches):
        conv, replay, made, place, out = None, None, None, 0, []

        def put(found) -> None:
            nonlocal place
            if digest:
                made.add(found)
                return
            for role, text in found:
                out.append({"conv_id": conv, "place": place, "role": role, "text": text})
                place += 1

        def ended() -> None:
            put(replay.inserted())
            if digest:
                out.append({"conv_id": conv, "repaired_sha256": made.own.hexdigest()})

        for batch in batches:
            for own_conv, kind, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if replay:
                        ended()
                    conv, replay, made, place = own_conv, Replay(text), _Hash(), 0
                else:
                    for _ in range(copies):
                        put(replay.row(role, text))
            yield _batch(out, schema)
            out.clear()
        if replay:
            ended()
            yield _batch(out, schema)

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return ordered.select("conv_id", "kind", "role", "text", "copies").mapInArrow(run, schema)


def plain(conversations: DataFrame) -> DataFrame:
    """Rows as the repair reads them: conv_id, turn, role, text, copies (1 where there is no such column; 0 means that only the conversation is there)."""
    copies = F.col("copies").cast("bigint") if "copies" in conversations.columns else F.lit(1).cast("bigint")
    space = F.lit(" ")
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies"))


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(conversations: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row a conversation: its faults, the cost of the cheapest repair, its audit, and the hash of the repaired rows (``replayed`` gives the rows)."""
    rows = plain(conversations)
    found = stored(segments(rows, most_rows))
    several = found.where("edge").groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("conv_id")
    part_of = lambda how: found.where("edge").alias("x").join(several.alias("y"), _key("conv_id"), how)
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("bigint").alias("gaps")
    whole = found.where("NOT edge").unionByName(part_of("left_anti")).select(*[gaps if n == "gaps" else n for n in RESULT])
    put_together = stored(_combined(part_of("left_semi")))
    hashes = replayed(rows, put_together, digest=True)
    long = put_together.alias("x").join(hashes.alias("y"), _key("conv_id")).select(*[f"x.{n}" for n in RESULT[:-1]], "y.repaired_sha256")
    return whole.unionByName(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows, damaged by crc32 of ``conv_id:turn`` modulo 20: 0 leaves only the conversation, 1 empties the text, 2 takes its full stops, exclamation and question marks, 3 repeats the row, 4 makes it the user's."""
    name = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(how.isin(0, 1), "").when(how == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(how == 0, "").when(how == 4, "user").otherwise(name("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def op11_structure(spark, sf_dir) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: By trying all edits row by row, and keeping of each state's ways the cheapest, of equal ones the ASCII-least.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
keyed AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
how AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS how FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM how, LATERAL (SELECT unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END))) WHERE how <> 0),
n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) = 1 AS is_first, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM n),
f AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN NOT is_first THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
ends AS (SELECT DISTINCT conv_id FROM conversations),
s AS (
  SELECT conv_id, 0::BIGINT AS i, state, cost, audit, made FROM ends, (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) b(state, cost, audit, made)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, made FROM (
    SELECT conv_id, i, CASE j WHEN 0 THEN state WHEN 1 THEN CASE state WHEN 2 THEN 3 ELSE 2 END ELSE CASE state WHEN 2 THEN 2 ELSE 3 END END AS state, cost + 5 * j AS cost, audit || repeat('I', j::INT) AS audit,
           made || CASE j WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE CASE state WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END AS made
    FROM (
      SELECT s.conv_id, f.i, e.letter, s.cost + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost, s.audit || e.letter AS audit,
             CASE e.letter WHEN 'D' THEN s.state WHEN 'R' THEN CASE s.state WHEN 2 THEN 3 ELSE 2 END
               ELSE CASE WHEN s.state = 0 AND f.initial = 's' THEN 1 WHEN s.state IN (0, 1, 3) AND f.initial = 'u' THEN 2 WHEN s.state = 2 AND f.initial = 'a' THEN 3 END END AS state,
             s.made || CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE s.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] END AS made
      FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1, (VALUES ('D', 2), ('K', 0), ('R', 1)) e(letter, price)
      WHERE e.letter = 'D' OR f.fault IN ('', 'truncated')) x, range(3) r(j)
    WHERE state IS NOT NULL) y
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1),
per AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       s.cost::BIGINT AS cost, s.audit, sha256(array_to_string(s.made, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN per p ON e.conv_id IS NOT DISTINCT FROM p.conv_id JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.i = coalesce(p.n, 0) AND s.state IN (0, 3)
QUALIFY row_number() OVER (PARTITION BY e.conv_id ORDER BY s.cost, s.audit) = 1
"""
