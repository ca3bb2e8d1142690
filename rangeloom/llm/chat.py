"""Chat formatting with a grammar round trip.

A conversation becomes ``<s>`` and then its turns::

    user        [INST] text [/INST]
    system      [SYS] text [/SYS]
    assistant   (one space) text</s>
    other       [ROLE=name] text [/ROLE]

Each turn is rendered, read back by a deterministic parser that stops at any control string, and
compared with its source. If it does not come back the same, the control strings in its text are
escaped (a backslash after the bracket; one more where there are some) and it is tried again; reading
takes one backslash away. Texts without control strings stay as they are.

Defined results: a null text or role counts as empty; turns of the same number come in the order of
role, then text; null turns come first; rows that repeat are turns of their own; a null conv_id is a
conversation; an empty table gives no rows. The turns of a conversation stream through a task one by
one, so its length is not bound by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_CONTROL = r"/?s>|/?INST\]|/?SYS\]|/ROLE\]|ROLE=[A-Za-z0-9_.~%-]*\]"
CONTROL = re.compile(rf"[<\[](?:{_CONTROL})")
_TO_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
BEGIN = "<s>"
_FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}


def frame(role: str) -> tuple[str, str]:
    """What stands before and after a turn's text."""
    return _FRAMES.get(role) or (f"[ROLE={quote(role, safe='')}] ", " [/ROLE]")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the text (escaped) begins and ends, for each turn from ``at`` on. ValueError if it is not of the grammar."""
    if formatted.startswith(BEGIN, at):
        at += len(BEGIN)
    while at < len(formatted):
        if formatted[at] == " ":
            role, start = "assistant", at + 1
        else:
            opening = CONTROL.match(formatted, at)
            if not opening or formatted[opening.end() : opening.end() + 1] != " ":
                raise ValueError(f"no turn begins at {at}")
            name, start = opening[0], opening.end() + 1
            role = {"[INST]": "user", "[SYS]": "system"}.get(name) or (unquote(name[6:-1]) if name.startswith("[ROLE=") else None)
            if role is None:
                raise ValueError(f"no turn begins with {name}")
        after = frame(role)[1]
        closing = CONTROL.search(formatted, start)
        if not closing or closing[0] != after.lstrip():
            raise ValueError(f"the turn at {at} does not end")
        end = closing.start() - (len(after) - len(closing[0]))
        if end < start or formatted[end : closing.end()] != after:
            raise ValueError(f"the turn at {at} does not end")
        yield role, unescape(formatted[start:end]), start, end
        at = closing.end()


def render(role: str, text: str) -> str:
    """One turn, its text escaped if it would not read back the same otherwise."""
    before, after = frame(role)
    shown = text
    while True:
        formatted = f"{before}{shown}{after}"
        try:
            back = [x[:2] for x in parse(formatted)]
        except ValueError:
            back = []
        if back == [(role, text)]:
            return formatted
        if shown is not text:
            raise AssertionError("an escaped turn must read back the same")
        shown = escape(text)


def render_conversation(turns: Iterable[tuple[str, str]]) -> str:
    return BEGIN + "".join(render(role, text) for role, text in turns)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order within each partition: conv_id, is_first, formatted, loss_start, loss_end.

    A conversation's formatted text is its rows' one after the other; the loss mask covers the
    assistant's text in each, from loss_start to loss_end in code points.
    """

    def run(batches):
        last = ()
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            firsts, shown, starts, ends = [], [], [], []
            for conv, role, text in zip(ids, roles, texts, strict=True):
                piece = render(role or "", text or "")
                first, last = last != (conv,), (conv,)
                piece = BEGIN + piece if first else piece
                a = len(piece) - len(frame("assistant")[1])
                firsts.append(first)
                shown.append(piece)
                starts.append(len(BEGIN) * first + 1 if role == "assistant" else 0)
                ends.append(a if role == "assistant" else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(firsts, pa.bool_()), pa.array(shown, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "is_first", "formatted", "loss_start", "loss_end"],
            )

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, is_first boolean, formatted string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the parser and the loss mask find in the rows of ``format_turns``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        state = None

        def ended():
            conv, n, turns, chars, loss, total = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

        for batch in batches:
            done = []
            for conv, first, shown, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    if state:
                        done.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(shown):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if b:
                    masked = unescape(shown[a:b])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(shown)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([ended()], schema=schema)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark, sf_dir) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    return read_back(format_turns(conversations.unionByName(probe)))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/ROLE\]|ROLE=[A-Za-z0-9_.~%-]*\])', '\1\\\2\3', 'g'))
            + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 16 + length(url_encode(role)) END AS chars FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
