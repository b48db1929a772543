"""Chat formatting with loss masks, found by rendering a template as a black box.

A template is any function from turns to text. Successive prefixes of a conversation are rendered and compared: what the
next prefix adds is the turn's span, and a probe in place of the turn's text shows where in the span that text stands. A
template that changes what it had written before is detected; it has no valid spans, so such turns carry no loss.

Conversations are streamed in turn order. A template with a true attribute ``local`` writes each turn by itself: of its
prefixes the last ``window`` turns at most are held and rendered. Any other template is given true prefixes, whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Private-use characters.
PROBES = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))
TURNS_AT_ONCE = 1000

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

FORMATTED = "conv_id long, nth long, piece string, start long, end long, text_start long, text_end long, in_loss boolean, rewrites boolean"


def escape(text: str) -> str:
    """Put a backslash into everything that could be read as a control string; one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: each turn between start and end marks, its role on the first line."""
    return "".join(f"{START}{escape(role).replace(chr(10), LINE)}\n{escape(text)}{END}\n" for role, text in turns)


marked_turns.local = True


class Reader:
    """Reads turns back from the output of :func:`marked_turns`, by its marks alone, as parts of it come in."""

    def __init__(self) -> None:
        self.rest = ""

    def add(self, part: str) -> Iterator[Turn]:
        """Role and text of the turns that end in this part; ValueError where there is no turn."""
        searched = max(0, len(self.rest) - len(END))
        self.rest += part
        while (at := self.rest.find(END + "\n", searched)) >= 0:
            role, line, text = self.rest[:at].partition("\n")
            if not role.startswith(START) or not line:
                raise ValueError("no turn: " + role[:80])
            yield unescape(role[len(START) :].replace(LINE, "\n")), unescape(text)
            self.rest, searched = self.rest[at + len(END) + 1 :], 0


class Span(NamedTuple):
    piece: str
    start: int
    end: int
    text_start: int | None
    text_end: int | None
    rewrites: bool


class Renderer:
    """Spans of one conversation's turns, as they come."""

    def __init__(self, template: Template, window: int) -> None:
        self.template, self.window = template, window if getattr(template, "local", False) else None
        self.turns: list[Turn] = []
        self.before = template([])
        self.written = len(self.before)

    def add(self, turn: Turn) -> Span:
        if self.window is not None and len(self.turns) >= self.window:
            self.turns = self.turns[self.window // 2 :]
            self.before = self.template(self.turns)
        now = self.template([*self.turns, turn])
        same = len(self.before) if now.startswith(self.before) else len(os.path.commonprefix([self.before, now]))
        rewrites = same < len(self.before)
        start = self.written - (len(self.before) - same)
        span = Span(now[same:], start, start + len(now) - same, None, None, rewrites)
        if not rewrites and (found := self._text(turn, now, same)):
            span = span._replace(text_start=start + found[0] - same, text_end=start + found[1] - same)
        self.turns.append(turn)
        self.before, self.written = now, span.end
        return span

    def _text(self, turn: Turn, now: str, same: int) -> tuple[int, int] | None:
        """Where the turn's text stands in ``now``: what stays around a probe in its place."""
        used = {*turn[0], *turn[1]}
        probe = next((chr(c) for some in PROBES for c in some if chr(c) not in used), None)
        if probe is None:
            return None
        other = self.template([*self.turns, (turn[0], probe)])
        at = other.find(probe, same)
        behind = len(other) - at - len(probe)
        if at >= 0 and at + behind <= len(now) and now[:at] == other[:at] and now[len(now) - behind :] == other[at + len(probe) :]:
            return at, len(now) - behind
        return None


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text")), strict=True)


def format_turns(conversations: DataFrame, template: Template = marked_turns, window: int = WINDOW) -> DataFrame:
    """One row per turn: its piece of the output, its span and the span of its text (code points), and the loss mask.

    Turns go by turn, then role and text; a null turn comes first. Null roles and texts count as empty, a null conv_id is
    one conversation. Repeated rows are turns of their own. Rows of a conversation come together and in order: its output
    is the concatenation of its pieces. Assistant text is under the mask where it could be located.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("piece", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end")), ("in_loss", pa.bool_()), ("rewrites", pa.bool_())])
        last: object = ()
        held: list[tuple] = []
        for conv, role, text in _turns(batches):
            if conv != last:
                renderer, nth, last = Renderer(template, window), 0, conv
            span = renderer.add((role, text))
            loss = role == "assistant" and span.text_start is not None
            held.append((conv, nth, *span[:5], loss, span.rewrites))
            nth += 1
            if len(held) >= TURNS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(work, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation as read back from its output, that is the pieces of :func:`format_turns` one after another.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (what stands under
    the mask in the output, unescaped), formatted_chars. Turns are found by the default template's marks, whatever the
    pieces. Output that isn't turns, and assistant text that isn't under the mask, are errors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = ()
        done: list[tuple] = []
        state: list | None = None

        def told() -> tuple:
            conv, n, turns, chars, loss, end, reader, said = state
            if reader.rest or chars != said:
                raise ValueError(f"conversation {conv}: its output has {len(reader.rest)} characters beyond its turns, and {chars} of {said} of loss")
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), end

        for batch in batches:
            for conv, piece, start, a, b, in_loss, end in zip(*(batch[n].to_pylist() for n in ("conv_id", "piece", "start", "text_start", "text_end", "in_loss", "end")), strict=True):
                if conv != last or state is None:
                    if state is not None:
                        done.append(told())
                    state, last = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader(), 0], conv
                for role, text in state[6].add(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[7] += len(text) if role == "assistant" else 0
                if in_loss:
                    own = unescape(piece[a - start : b - start])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] = end
            if done:
                yield _digests(done)
                done = []
        if state is not None:
            yield _digests([told()])

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
