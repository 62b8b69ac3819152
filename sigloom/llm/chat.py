"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` a turn. A
deterministic parser reads the result back: it takes a turn's role up to the
line break and its text up to the first end marker, and undoes escapes. If the
recovered turns differ from the source, the content that conflicts is escaped
and the conversation rendered again, until they are identical.

Escape: a marker inside content gets one more backslash after its ``<`` (so does
one that has backslashes there already), which the parser takes away again; in a
role, line breaks and backslashes are escaped too. As that is one-to-one and
leaves no marker, one round is enough; ``rounds`` tells how many were needed.

Defined results: a null role or text counts as empty; turns are in order of
(turn, role, text) with nulls first, so ties have one order, and repeated rows
are repeated turns; null conv_ids form one conversation; very long texts are
read whole; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


_LONE = re.compile(r"\\(?:\\|n)|(\\)")


def unescape_role(role: str) -> str | None:
    """The role; None if it has a marker, or a backslash that begins no escape."""
    role_ = unescape(role)
    if START in role or END in role or any(m[1] for m in _LONE.finditer(role_)):
        return None
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role_)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> str:
    """The rendered conversation; turns marked in ``escaped`` have their content escaped."""
    return "".join(f"{START}{escape_role(r) if e else r}\n{escape(t) if e else t}{END}\n" for (r, t), e in zip(turns, escaped))


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, by one pass from left to right; None if it isn't in the grammar."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        line = text.find("\n", at)
        end = text.find(END, line + 1) if line >= 0 else -1
        if line < 0 or end < 0 or text[end + len(END) : end + len(END) + 1] != "\n":
            return None
        role, content = unescape_role(text[at + len(START) : line]), text[line + 1 : end]
        if role is None or START in content:
            return None
        turns.append((role, unescape(content)))
        at = end + len(END) + 1
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, int, int]:
    """(rendered, escaped turns, rounds): rendered again with conflicting turns escaped until parsing gives the source."""
    escaped = [False] * len(turns)
    rounds = 0
    while True:
        text = render(turns, escaped)
        back = parse(text)
        if back == turns:
            return text, sum(escaped), rounds
        rounds += 1
        # a turn conflicts if it doesn't come back by itself
        now = [e or parse(render([t], [False])) != [t] for t, e in zip(turns, escaped)]
        if now == escaped:
            now = [True] * len(turns)
        escaped = now


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist()):
            text, escaped, rounds = format_turns([(t["role"], t["text"]) for t in turns])
            rows.append((conv, len(turns), escaped, rounds, text))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "escaped_turns", "rounds", "chat"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, escaped_turns, rounds, chat) of every conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_format, "conv_id long, n_turns int, escaped_turns int, rounds int, chat string")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), e AS (
  SELECT *, regexp_matches(text, '<\\*\|im_(start|end)\|>') OR regexp_matches(role, '<\\*\|im_(start|end)\|>')
            OR contains(role, chr(10)) OR contains(role, '\') AS clash FROM t
), r AS (
  SELECT *, CASE WHEN clash THEN regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') ELSE role END AS r2,
         CASE WHEN clash THEN regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') ELSE text END AS t2 FROM e
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(count_if(clash) AS INTEGER) AS escaped_turns,
       CAST(CASE WHEN bool_or(clash) THEN 1 ELSE 0 END AS INTEGER) AS rounds,
       string_agg('<|im_start|>' || r2 || chr(10) || t2 || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
FROM r GROUP BY conv_id
"""
