"""Chat formatting with a grammar round trip.

The rendered form of a conversation is a regular language: each turn is an opening mark, its
text and a closing mark. A text that would not come back from the parser is escaped: every
control string in it (with any backslashes already inside) gets one more backslash after its
first character. The parser takes one away, so the escape is reversible for all texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import load

#: Opening and closing mark of each role.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
#: Control strings without their first character, between which backslashes may stand.
CONTROL = re.compile(r"(\[|<)(\\*)(/?INST\]|/?s>|</?SYS>>|/SYS>>|/?ROLE[ \]])")
#: Characters of a piece of a rendered conversation.
PIECE = 1 << 20
OTHER = re.compile(r"\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + "\\" + m[2] + m[3], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def opening(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return "[ROLE " + re.sub(r"([\\\]])", r"\\\1", role) + "] ", " [/ROLE]"


class Broken(ValueError):
    """The text is not in the grammar."""


def turn_at(text: str, at: int) -> tuple[str, str, int, int, int]:
    """Role, unescaped text, the span of the escaped text, and the end, of the turn that begins at `at`."""
    if m := OTHER.match(text, at):
        role, start, close = re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL), m.end(), " [/ROLE]"
        if role in MARKS:
            raise Broken(f"a plain role is written out at {at}")
    else:
        role = next((r for r, (o, _) in MARKS.items() if text.startswith(o, at)), None)
        if role is None:
            raise Broken(f"no turn opens at {at}")
        start, close = at + len(MARKS[role][0]), MARKS[role][1]
    end = text.find(close, start)
    if end < 0:
        raise Broken(f"the turn at {at} has no end")
    bare = next((m.start() for m in CONTROL.finditer(text, start, end + len(close)) if not m[2]), -1)
    if bare != end + 1:
        raise Broken(f"a control string stands inside the turn at {at}")
    return role, unescape(text[start:end]), start, end, end + len(close)


class Reader:
    """Reads a rendered conversation that comes in pieces cut anywhere, and gives its turns: role, unescaped text, and the escaped text."""

    def __init__(self):
        self.text, self.tried = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        self.text += piece
        if len(self.text) >= 2 * self.tried:  # a long turn is looked at again when there is twice as much of it
            yield from self._turns(False)

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._turns(True)

    def _turns(self, all_: bool) -> Iterator[tuple[str, str, str]]:
        at = 0
        while at < len(self.text):
            try:
                role, text, start, end, to = turn_at(self.text, at)
            except Broken:
                if all_:
                    raise
                break
            yield role, text, self.text[start:end]
            at = to
        self.text = self.text[at:]
        self.tried = len(self.text)


def parse(text: str) -> list[tuple[str, str, str]]:
    """Role, unescaped text and escaped text of each turn of a rendered conversation."""
    reader = Reader()
    return [*reader.feed(text), *reader.end()]


def render(role: str, text: str) -> str:
    """One turn, escaped only if it would not come back as it was."""
    before, after = opening(role)
    for body in (text, escape(text)):
        turn = before + body + after
        try:
            if [x[:2] for x in parse(turn)] == [(role, text)]:
                return turn
        except Broken:
            pass
    raise Broken(f"a {role} turn can't be written")


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order: by turn (null first), ties by role and text."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, piece (from 0), rendered: the pieces of a conversation one after another are its rendered form; they are cut at PIECE characters, wherever that is in a turn.

    Null role or text is empty; null conv_id is a conversation too; repeated rows stay; other
    columns are not looked at. A conversation is one task's, streamed turn by turn and piece by
    piece: its length does not matter to memory, but a turn is held whole.
    """
    ordered = _ordered(turns)
    out = StructType([StructField("conv_id", ordered.schema["conv_id"].dataType), StructField("piece", LongType()), StructField("rendered", StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, waiting, rows = object(), 0, "", []

        def cut(least: int) -> None:
            nonlocal piece, waiting
            while len(waiting) >= least:
                rows.append((now, piece, waiting[:PIECE]))
                piece, waiting = piece + 1, waiting[PIECE:]

        for batch in batches:
            conv, _, role, text = (batch.column(k).to_pylist() for k in range(4))
            for c, r, t in zip(conv, role, text, strict=True):
                if c != now:
                    cut(1)
                    now, piece = c, 0
                waiting += render(r, t)
                cut(PIECE)
            yield _batch(rows, schema)
            rows = []
        cut(1)
        yield _batch(rows, schema)

    return ordered.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, from its rendered form only: the turns that the parser finds, and the texts under the loss mask, unescaped."""
    done = formatted(turns)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    out = StructType([done.schema["conv_id"], *[StructField(n, StringType() if n.endswith("sha256") else LongType()) for n in names]])
    schema = to_arrow_schema(out)

    class Conversation:
        def __init__(self, conv):
            self.conv, self.reader, self.turns, self.chars, self.loss = conv, Reader(), 0, 0, 0
            self.said, self.learned = hashlib.sha256(), hashlib.sha256()

        def take(self, found) -> None:
            for role, text, escaped in found:
                self.turns += 1
                self.said.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    masked = unescape(escaped)
                    self.loss += len(masked)
                    self.learned.update(masked.encode())

        def row(self) -> tuple:
            self.take(self.reader.end())
            return self.conv, self.turns, self.said.hexdigest(), self.loss, self.learned.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            rows = []
            for c, piece, rendered in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if piece == 0:
                    if open_:
                        rows.append(open_.row())
                    open_ = Conversation(c)
                open_.chars += len(rendered)
                open_.take(open_.reader.feed(rendered))
            yield _batch(rows, schema)
        if open_:
            yield _batch([open_.row()], schema)

    return done.mapInArrow(run, out)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said})
    return read_back(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


#: A text is escaped where it holds a control string, with or without backslashes; each gets one character more.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '(\[|<)(\\*)(/?INST\]|/?s>|</?SYS>>|/SYS>>|/?ROLE[ \]])')) AS body,
         CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 16 + length(role) + len(regexp_extract_all(role, '[\\\]]')) END AS marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(body + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
