"""Conversation repair against a search over all edits, by cost and then audit; hot conversations cut into segments; edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from rangeloom.llm import structure

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """The cheapest edits of (turn, role, text) rows, of equal ones the ASCII-least: by a heap of (cost, letters) over all there are."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        for role in ("user", "assistant"):
            if role[0] in NEXT[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                for new, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if new[:1] and new[0] in NEXT[last]:
                        heapq.heappush(heap, (cost + price + more, audit + letter, i + 1, new[0], (*out, (new, text))))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, list(out)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def results(df):
    return {r["conv_id"]: {k: r[k] for k in structure.RESULT[1:]} for r in df.collect()}


def drawn(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "a.", "b", "c!", "hello there.", "x?\t ", " ", "é。", "end. "]
    roles = ["user", "assistant", "system", "tool", "", "U", None, "umpire"]
    return [(rng.choice([0, 0, 0, None, *range(2, 150)]), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("most_rows", [structure.SEGMENT_ROWS, 7])
def test_against_all_edits(spark, most_rows):
    """A third of the rows are one conversation's; the same result however it is cut."""
    rows = drawn(2500, 5)
    want = {c: brute(x)[0] for c, x in damaged(rows).items()}
    assert results(structure.repair(structure.damaged(spark.createDataFrame(rows, SCHEMA)), most_rows)) == want


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = {c: brute(x)[0] for c, x in damaged([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}
    assert results(structure.op11_structure(spark, "/root/testdata/sf0.001")) == want


def test_repaired_rows(spark):
    rows = [r for r in drawn(400, 9) if r[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    found = structure.repair(df)
    got = {}
    for r in structure.replayed(structure.plain(df), found.select("conv_id", "audit")).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, text))
    for conv, own in by_conv.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got.get(conv, []) == brute(own)[1]


def test_nothing_left_and_empty(spark):
    gone = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "hello.")], SCHEMA)
    none = hashlib.sha256(b"").hexdigest()
    assert results(structure.repair(structure.damaged(df))) == {gone[0]: dict.fromkeys(structure.RESULT[1:-2], 0) | {"audit": "", "repaired_sha256": none}}
    assert structure.repair(structure.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_repeats_long_texts_and_clashing_names(spark):
    """One row ten thousand times, a text of two megabytes, and columns of the names used inside."""
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "again.")] * 10_000 + [(1, 1, "assistant", "x" * 2_000_000 + "."), (2, 3, "user", "a."), (2, 4, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("task", "number", "edge", "marks", "same", "first", "audit", "kind")})
    got = results(structure.repair(df, 1000))
    assert got[1]["audit"] == "K" + "D" * 9999 + "K" and got[1]["cost"] == 2 * 9999 and got[1]["duplicate"] == 9999
    assert got[1]["repaired_sha256"] == hashlib.sha256(f"user:again.\nassistant:{'x' * 2_000_000}.".encode()).hexdigest()
    assert got[2]["audit"] == "KK" and got[2]["gaps"] == 0


def test_distances_are_shortest():
    """Dial's queue against relaxation until nothing changes."""
    rng = random.Random(3)
    for _ in range(200):
        marks = bytes(rng.randrange(12) for _ in range(rng.randrange(9)))
        ends = tuple(rng.choice([structure.INFINITE, rng.randrange(30)]) for _ in range(4))
        n = len(marks)
        want = [structure.INFINITE] * (4 * n) + list(ends)
        for _ in range(4 * n + 8):
            for at in range(n, -1, -1):
                for s in range(4):
                    steps = [(structure.INSERT, 4 * at + structure._MADE[s])] + ([(c, 4 * at + 4 + to) for _, c, to in structure.edits(marks[at], s)] if at < n else [])
                    want[4 * at + s] = min(want[4 * at + s], *(c + want[v] for c, v in steps if want[v] < structure.INFINITE), structure.INFINITE)
        assert structure.distances(marks, ends) == want
