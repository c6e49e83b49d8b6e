"""Chat formatting with a grammar round trip.

Each turn is rendered with control strings around it. A deterministic parser reads the rendered turn again; if what it
recovers is not the source, the control strings inside the text are escaped and the turn is rendered anew, until both are
identical. The grammar is regular and every turn ends where the parser is back in its first state, so the turns of a
conversation can be rendered and parsed as a stream: no conversation is held whole, however long it is.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"            user
                 | "[OUT] " text " </s>"                assistant (under the loss mask)
                 | "[SYS] " text " [/SYS]"              system
                 | "[ROLE] " name " [/ROLE][BODY] " text " [/BODY]"   any other role

A control string inside a text, with k backslashes before it, is written with 2k + 1 backslashes; the parser takes an odd
run before a control string for an escape and halves it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import readable

BEGIN = "<s>"
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
NAME, BODY = ("[ROLE]", "[/ROLE]"), ("[BODY]", "[/BODY]")
CONTROLS = [BEGIN, *(c for pair in (*FRAMES.values(), NAME, BODY) for c in pair)]
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")

TURN = "conv_id {kind}, position long, formatted string, mask_start long, mask_end long"
DIGEST = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class GrammarError(ValueError):
    """The text is not a sentence of the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _span(data: str, at: int, opening: str, closing: str) -> tuple[int, int, int]:
    """Start and end of the text between two control strings that starts at ``at``, and where the parser goes on."""
    if not data.startswith(opening + " ", at):
        raise GrammarError(f"expected {opening} at {at}")
    start = at + len(opening) + 1
    for m in _CONTROL.finditer(data, start):
        if len(m[1]) % 2:
            continue
        end = m.start(2) - 1
        if m[1] or m[2] != closing or end < start or data[end] != " ":
            raise GrammarError(f"unexpected {m[2]} at {m.start(2)}")
        return start, end, m.end()
    raise GrammarError(f"no {closing}")


def parse(data: str, at: int = 0) -> Iterator[tuple[str, str, int, int, int]]:
    """(role, text, start, end, next) of each turn from position ``at``; start and end enclose the rendered text."""
    while at < len(data):
        role = next((r for r, (opening, _) in FRAMES.items() if data.startswith(opening, at)), None)
        if role is not None:
            start, end, after = _span(data, at, *FRAMES[role])
        else:
            start, end, after = _span(data, at, *NAME)
            role = unescape(data[start:end])
            start, end, after = _span(data, after, *BODY)
        yield role, unescape(data[start:end]), start, end, after
        at = after


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text lies in it: plain if that parses back to the source, else escaped."""
    for write in (str, escape):
        if role in FRAMES:
            opening, closing = FRAMES[role]
            out = f"{opening} {write(text)} {closing}"
        else:
            out = f"{NAME[0]} {write(role)} {NAME[1]}{BODY[0]} {write(text)} {BODY[1]}"
        try:
            turns = list(parse(out))
        except GrammarError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return out, turns[0][2], turns[0][3]
    raise GrammarError("the escaped turn does not parse back to its source")


def format_turns(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, position (from 0), formatted, mask_start, mask_end.

    ``formatted`` of all positions, in order, is the conversation's text. The mask bounds are code points from its start
    and enclose an assistant's (escaped) text; they are null for other turns. Rows go by turn; nulls come first, ties by
    role and text, so repeated rows are turns of their own. A null text or role is empty. Rows with a null conv_id are one
    conversation. Other columns are ignored. Rows of a conversation stay in one partition, in order, and are streamed.
    """
    role, text = (F.coalesce(readable(c), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now: object = run  # no conversation yet
        at = position = 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                lead = ""
                if conv != now:
                    now, at, position, lead = conv, 0, 0, BEGIN
                piece, start, end = render(r, t)
                start, end = at + len(lead) + start, at + len(lead) + end
                masked = r == "assistant"
                for column, value in zip(out, (position, lead + piece, start if masked else None, end if masked else None)):
                    column.append(value)
                at += len(lead) + len(piece)
                position += 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["conv_id", "position", "formatted", "mask_start", "mask_end"],
            )

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, TURN.format(kind=kind))


def read_back(formatted: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Parse formatted conversations and return a digest of each (DIGEST), made from what was read only.

    ``ordered`` says that the rows come straight from ``format_turns``; otherwise they are brought into order first. Text
    under the loss mask is unescaped before it is counted and hashed.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        now: object = run
        state: list = []
        rows: list[tuple] = []

        def close():
            if now is not run:
                conv, n, turns, chars, loss, at = state
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), at))

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_end"))
            for conv, data, start, end in zip(*columns):
                lead = 0
                if conv != now:
                    close()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if not data.startswith(BEGIN):
                        raise GrammarError(f"no {BEGIN}")
                    lead = len(BEGIN)
                for role, text, *_ in parse(data, lead):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescape(data[start - state[5] : end - state[5]])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(data)
            if len(rows) >= 10_000:
                yield _digests(rows, names, kind_of)
                rows.clear()
        close()
        if rows:
            yield _digests(rows, names, kind_of)

    return formatted.mapInArrow(run, DIGEST.format(kind=kind))


def _digests(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
