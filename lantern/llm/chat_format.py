"""Chat formatting with a grammar round trip.

A conversation's formatted text is the concatenation of its turns' segments, in turn
order. The grammar is deterministic:

    segment = open text close        open, close by role, see ``MARKS``
    other   = "[ROLE=" role "]" text "[/ROLE]"
    "\\" x in a role or text is the character x

A turn is rendered as it is and parsed again; if the turn that comes back differs, its
control strings and backslashes are escaped and, should that not do, every character,
so that what is written always parses to its source. A segment ends in a control string
and the next begins with one, so segments parse alike alone and one after another.

Only turns are rows: nothing is collected, and a conversation of any length spreads over
tasks. ``digests`` reads formatted turns back in order, a running hash per conversation,
so its memory does not grow with a conversation either.

Defined results: null text or role counts as empty; turns of one conversation that share
a number are ordered by role, then text (null numbers first); a null conversation id is
a conversation of its own; the loss mask covers the text of ``assistant`` turns, without
marks; an empty table gives no rows; other columns pass through, and input columns named
like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import map_arrow

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE=", "[/ROLE]")
CONTROL = [*(m for pair in MARKS.values() for m in pair), *OTHER]
_CONTROL = "|".join(map(re.escape, CONTROL))
_ESCAPED = re.compile(rf"\\|(?={_CONTROL})")
_TOKEN = re.compile(rf"\\(.)|({_CONTROL})|([^\\<\[]+|[<\[])", re.S)
_ROLE = re.compile(r"((?:\\.|[^\\\]])*)\]", re.S)
LEVELS = 3


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _ESCAPED.sub(lambda m: "\\" + m.group(), text)
    return "".join("\\" + ch for ch in text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """A segment, and where its text begins and ends."""
    if role in MARKS:
        start, end = MARKS[role]
    else:
        start, end = f"{OTHER[0]}{re.sub(r'([\\\]<\[])', r'\\\1', role)}]", OTHER[1]
    body = escape(text, level)
    return start + body + end, len(start), len(start) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text; a ``ValueError`` where it is not in the grammar."""
    by_open, turns, at = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}, [], 0
    while at < len(formatted):
        m = _TOKEN.match(formatted, at)
        mark = m and m.group(2)
        if mark in by_open:
            (role, close), at = by_open[mark], m.end()
        elif mark == OTHER[0]:
            got = _ROLE.match(formatted, m.end())
            if not got or (role := unescape(got.group(1))) in MARKS:
                raise ValueError(f"no role at {at}")
            close, at = OTHER[1], got.end()
        else:
            raise ValueError(f"no turn begins at {at}")
        parts = []
        while True:
            m = _TOKEN.match(formatted, at)
            if m is None:
                raise ValueError(f"turn not closed at {at}")
            at = m.end()
            if m.group(2):
                if m.group(2) != close:
                    raise ValueError(f"stray {m.group(2)} at {m.start()}")
                break
            parts.append(m.group(1) or m.group(3))
        turns.append((role, "".join(parts)))
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int, int]:
    """The first rendering that parses to its source: segment, text's begin and end, level."""
    for level in range(LEVELS):
        segment, a, b = render(role, text, level)
        try:
            if parse(segment) == [(role, text)]:
                return segment, a, b, level
        except ValueError:
            pass
    raise AssertionError("escaping every character always parses")


def format_turns(df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``df`` with ``segment``, ``text_begin``, ``text_end`` (code points of the segment),
    ``escape_level`` and ``in_loss`` (1 for assistant turns)."""
    out = ["segment", "text_begin", "text_end", "escape_level", "in_loss"]
    rest = [c for c in df.columns if c not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(rest.index(c)).to_pylist()] for c in (role_col, text_col))
            done = [(*round_trip(r, t), int(r == "assistant")) for r, t in zip(roles, texts)]
            cols = [pa.array([d[k] for d in done], pa.string() if k == 0 else pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*rest, *out])

    schema = StructType([*df.select(*rest).schema, StructField("segment", StringType()),
                         *[StructField(c, IntegerType()) for c in out[1:]]])
    return map_arrow(df.select(*rest), run, schema)


def digests(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Per conversation, parsed from its segments: ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    kind = formatted.schema[conv_col].dataType
    rows = (formatted.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, role_col, text_col)
            .select(conv_col, "segment", "text_begin", "text_end", "in_loss"))
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None  # now: conversation, turns, hash, loss characters, loss hash, characters

        def batch_of(rows: list) -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, arrow_kind[0]), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in turns]),
                 pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(size, pa.int64())], names)

        arrow_kind = [None]
        for batch in batches:
            arrow_kind[0] = batch.schema.field(0).type
            for conv, segment, a, b, in_loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(now)
                        if len(done) == 5000:
                            yield batch_of(done)
                            done = []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                (role, text), = parse(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    text = unescape(segment[a:b])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(segment)
        if now is not None:
            yield batch_of([*done, now])

    schema = StructType([StructField(conv_col, kind), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
                         StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
                         StructField("formatted_chars", LongType())])
    return map_arrow(rows, run, schema)
