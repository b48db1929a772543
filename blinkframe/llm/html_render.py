"""Layout-aware text of HTML pages.

A page is scanned once. A stack of open elements is the tree as far as it is needed: tags that HTML implies are closed or
opened on the way, and hidden elements keep their text off the output. Blocks keep their distance, list items their marks
and depth, and the cells of a table are padded to columns; cells of a row that holds paragraphs or lists follow each other
as blocks. Output is linear in the page and all text is in it. Spans hold as far as HTML lets them; they are intervals, and
only columns with text are written. What padding and empty cells may add to a table is ROOM times its own characters and
cells: columns are padded from the left as long as that lasts, and a table whose empty cells alone would take more is
written without them. Tables of usual shape are far below either bound.
"""

from __future__ import annotations

import heapq
import heapq
import heapq
import heapq
import heapq
import html
import re
from bisect import bisect_left, bisect_right
from bisect import bisect_left, bisect_right
from bisect import bisect_left, bisect_right
from bisect import bisect_left, bisect_right
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by what they do to layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
UNSEEN = frozenset("script style title noscript template iframe noframes head datalist audio video canvas object desc metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption hr legend details summary figcaption option optgroup menu dir center thead tbody tfoot td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag: open elements that it ends, up to the nearest of the elements in CLOSED_WITHIN.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "p", "caption", "colgroup"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "thead": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "body": {"head"},
}
CLOSED_WITHIN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
WALLS = frozenset("table td th caption html template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_SIGHT = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: The widest spans that HTML knows, in columns and rows.
WIDEST, TALLEST = 1000, 65_534
ROOM = 8


_WHOLE = re.compile(r"-?[0-9]{1,9}")
_DIGITS = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def _span(value: str, most: int) -> int | None:
    """The whole number that an attribute starts with, ``most`` at most; None without one."""
    found = _DIGITS.match(value)
    return None if found is None else most if len(found[1]) > 6 else min(int(found[1]), most)


_WHOLE = re.compile(r"-?[0-9]{1,9}")
_DIGITS = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def _span(value: str, most: int) -> int | None:
    """The whole number that an attribute starts with, ``most`` at most; None without one."""
    found = _DIGITS.match(value)
    return None if found is None else most if len(found[1]) > 6 else min(int(found[1]), most)


_WHOLE = re.compile(r"-?[0-9]{1,9}")
_DIGITS = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def _span(value: str, most: int) -> int | None:
    """The whole number that an attribute starts with, ``most`` at most; None without one."""
    found = _DIGITS.match(value)
    return None if found is None else most if len(found[1]) > 6 else min(int(found[1]), most)


_WHOLE = re.compile(r"-?[0-9]{1,9}")
_DIGITS = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def _span(value: str, most: int) -> int | None:
    """The whole number that an attribute starts with, ``most`` at most; None without one."""
    found = _DIGITS.match(value)
    return None if found is None else most if len(found[1]) > 6 else min(int(found[1]), most)


_WHOLE = re.compile(r"-?[0-9]{1,9}")
_DIGITS = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def _span(value: str, most: int) -> int | None:
    """The whole number that an attribute starts with, ``most`` at most; None without one."""
    found = _DIGITS.match(value)
    return None if found is None else most if len(found[1]) > 6 else min(int(found[1]), most)


def _tokens(page: str) -> Iterator[tuple]:
    """(kind, value, attributes): text, start, end; one pass, linear in the page."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], None
            return
        if mark > at:
            yield "text", page[at:mark], None
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
        elif found := _NAME.match(page, mark + 2 if page.startswith("</", mark) else mark + 1):
            closing, name, at = page[mark + 1] == "/", found[0].lower(), found.end()
            attributes: dict[str, str] = {}
            while (pair := _ATTRIBUTE.match(page, at)) and pair.end() > at:
                attributes.setdefault(pair[1].lower(), html.unescape(pair[2] or pair[3] or pair[4] or ""))
                at = pair.end()
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            if closing:
                yield "end", name, None
                continue
            yield "start", name, attributes
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                raw_end = close.start() if close else size
                if name == "textarea":
                    yield "text", page[at:raw_end], None
                at = raw_end
                if not close:
                    yield "end", name, None
        else:
            yield "text", "<", None
            at = mark + 1


class _Lines:
    """Lines of a block context; blank lines are asked for, never doubled."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is open
        self.prefix = ""
        self.blank = self.gap = self.inked = self.structured = False

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.lines.append("".join(self.parts))
                self.drop()
                self._add(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.gap = self.inked and not self.parts[-1].endswith(" ")
            words = words[1:]
        if words:
            tail = words.endswith(" ")
            self._add(words[:-1] if tail else words)
            self.gap = tail

    def _add(self, text: str) -> None:
        if not text:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if not self.parts:
            # A list item's mark stands before its first line only.
            self.parts.append(self.prefix)
            self.inked = bool(self.prefix.strip())
            self.prefix = " " * len(self.prefix)
        self.parts.append((" " if self.gap else "") + text)
        self.inked = self.inked or bool(text.strip())
        self.gap = False

    def drop(self) -> None:
        self.parts, self.inked = [], False

    def end_line(self, blank: bool = False) -> None:
        if self.inked:
            self.lines.append("".join(self.parts).rstrip())
        self.drop()
        self.gap = False
        self.blank = self.blank or (blank and bool(self.lines))

    def force_break(self) -> None:
        if self.inked:
            self.end_line()
        elif self.lines and self.lines[-1]:
            self.blank = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Taken:
    """Columns that cells of rows above still take: blocks without a gap between them, and when each cell gives its own back."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (last row, start, end)
        self.under: list[tuple[int, int, int]] = []  # cells, or parts of them, below others that end before they do

    def free_from(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.starts, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def add(self, start: int, end: int, last: int) -> None:
        """Take columns up to a row; what is taken already waits below."""
        at = start
        while at < end:
            free = self.free_from(at)
            if free > at:
                self.under.append((at, min(free, end), last))
                at = free
                continue
            nth = bisect_left(self.starts, at)
            stop = min(end, self.starts[nth]) if nth < len(self.starts) else end
            self._put(at, stop)
            heapq.heappush(self.until, (last, at, stop))
            at = stop

    def _put(self, start: int, end: int) -> None:
        nth = bisect_left(self.starts, start)
        if nth and self.ends[nth - 1] == start:
            nth -= 1
            start = self.starts[nth]
            del self.starts[nth], self.ends[nth]
        if nth < len(self.starts) and self.starts[nth] == end:
            end = self.ends[nth]
            del self.starts[nth], self.ends[nth]
        self.starts.insert(nth, start)
        self.ends.insert(nth, end)

    def row(self, number: int) -> None:
        """Give back what ended above this row."""
        while self.until and self.until[0][0] < number:
            _, start, end = heapq.heappop(self.until)
            nth = bisect_right(self.starts, start) - 1
            first, last = self.starts[nth], self.ends[nth]
            del self.starts[nth], self.ends[nth]
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.starts.insert(nth, a)
                    self.ends.insert(nth, b)
            waiting, self.under = self.under, []
            for a, b, until in waiting:
                if until < number:
                    continue
                if a < end and start < b:
                    self.under += [(x, y, until) for x, y in ((a, start), (end, b)) if x < y]
                    self.add(max(a, start), min(b, end), until)
                else:
                    self.under.append((a, b, until))


class _Taken:
    """Columns that cells of rows above still take: blocks without a gap between them, and when each cell gives its own back."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (last row, start, end)
        self.under: list[tuple[int, int, int]] = []  # cells, or parts of them, below others that end before they do

    def free_from(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.starts, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def add(self, start: int, end: int, last: int) -> None:
        """Take columns up to a row; what is taken already waits below."""
        at = start
        while at < end:
            free = self.free_from(at)
            if free > at:
                self.under.append((at, min(free, end), last))
                at = free
                continue
            nth = bisect_left(self.starts, at)
            stop = min(end, self.starts[nth]) if nth < len(self.starts) else end
            self._put(at, stop)
            heapq.heappush(self.until, (last, at, stop))
            at = stop

    def _put(self, start: int, end: int) -> None:
        nth = bisect_left(self.starts, start)
        if nth and self.ends[nth - 1] == start:
            nth -= 1
            start = self.starts[nth]
            del self.starts[nth], self.ends[nth]
        if nth < len(self.starts) and self.starts[nth] == end:
            end = self.ends[nth]
            del self.starts[nth], self.ends[nth]
        self.starts.insert(nth, start)
        self.ends.insert(nth, end)

    def row(self, number: int) -> None:
        """Give back what ended above this row."""
        while self.until and self.until[0][0] < number:
            _, start, end = heapq.heappop(self.until)
            nth = bisect_right(self.starts, start) - 1
            first, last = self.starts[nth], self.ends[nth]
            del self.starts[nth], self.ends[nth]
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.starts.insert(nth, a)
                    self.ends.insert(nth, b)
            waiting, self.under = self.under, []
            for a, b, until in waiting:
                if until < number:
                    continue
                if a < end and start < b:
                    self.under += [(x, y, until) for x, y in ((a, start), (end, b)) if x < y]
                    self.add(max(a, start), min(b, end), until)
                else:
                    self.under.append((a, b, until))


class _Taken:
    """Columns that cells of rows above still take: blocks without a gap between them, and when each cell gives its own back."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (last row, start, end)
        self.under: list[tuple[int, int, int]] = []  # cells, or parts of them, below others that end before they do

    def free_from(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.starts, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def add(self, start: int, end: int, last: int) -> None:
        """Take columns up to a row; what is taken already waits below."""
        at = start
        while at < end:
            free = self.free_from(at)
            if free > at:
                self.under.append((at, min(free, end), last))
                at = free
                continue
            nth = bisect_left(self.starts, at)
            stop = min(end, self.starts[nth]) if nth < len(self.starts) else end
            self._put(at, stop)
            heapq.heappush(self.until, (last, at, stop))
            at = stop

    def _put(self, start: int, end: int) -> None:
        nth = bisect_left(self.starts, start)
        if nth and self.ends[nth - 1] == start:
            nth -= 1
            start = self.starts[nth]
            del self.starts[nth], self.ends[nth]
        if nth < len(self.starts) and self.starts[nth] == end:
            end = self.ends[nth]
            del self.starts[nth], self.ends[nth]
        self.starts.insert(nth, start)
        self.ends.insert(nth, end)

    def row(self, number: int) -> None:
        """Give back what ended above this row."""
        while self.until and self.until[0][0] < number:
            _, start, end = heapq.heappop(self.until)
            nth = bisect_right(self.starts, start) - 1
            first, last = self.starts[nth], self.ends[nth]
            del self.starts[nth], self.ends[nth]
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.starts.insert(nth, a)
                    self.ends.insert(nth, b)
            waiting, self.under = self.under, []
            for a, b, until in waiting:
                if until < number:
                    continue
                if a < end and start < b:
                    self.under += [(x, y, until) for x, y in ((a, start), (end, b)) if x < y]
                    self.add(max(a, start), min(b, end), until)
                else:
                    self.under.append((a, b, until))


class _Taken:
    """Columns that cells of rows above still take: blocks without a gap between them, and when each cell gives its own back."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (last row, start, end)
        self.under: list[tuple[int, int, int]] = []  # cells, or parts of them, below others that end before they do

    def free_from(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.starts, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def add(self, start: int, end: int, last: int) -> None:
        """Take columns up to a row; what is taken already waits below."""
        at = start
        while at < end:
            free = self.free_from(at)
            if free > at:
                self.under.append((at, min(free, end), last))
                at = free
                continue
            nth = bisect_left(self.starts, at)
            stop = min(end, self.starts[nth]) if nth < len(self.starts) else end
            self._put(at, stop)
            heapq.heappush(self.until, (last, at, stop))
            at = stop

    def _put(self, start: int, end: int) -> None:
        nth = bisect_left(self.starts, start)
        if nth and self.ends[nth - 1] == start:
            nth -= 1
            start = self.starts[nth]
            del self.starts[nth], self.ends[nth]
        if nth < len(self.starts) and self.starts[nth] == end:
            end = self.ends[nth]
            del self.starts[nth], self.ends[nth]
        self.starts.insert(nth, start)
        self.ends.insert(nth, end)

    def row(self, number: int) -> None:
        """Give back what ended above this row."""
        while self.until and self.until[0][0] < number:
            _, start, end = heapq.heappop(self.until)
            nth = bisect_right(self.starts, start) - 1
            first, last = self.starts[nth], self.ends[nth]
            del self.starts[nth], self.ends[nth]
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.starts.insert(nth, a)
                    self.ends.insert(nth, b)
            waiting, self.under = self.under, []
            for a, b, until in waiting:
                if until < number:
                    continue
                if a < end and start < b:
                    self.under += [(x, y, until) for x, y in ((a, start), (end, b)) if x < y]
                    self.add(max(a, start), min(b, end), until)
                else:
                    self.under.append((a, b, until))


class _Taken:
    """Columns that cells of rows above still take: blocks without a gap between them, and when each cell gives its own back."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (last row, start, end)
        self.under: list[tuple[int, int, int]] = []  # cells, or parts of them, below others that end before they do

    def free_from(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.starts, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def add(self, start: int, end: int, last: int) -> None:
        """Take columns up to a row; what is taken already waits below."""
        at = start
        while at < end:
            free = self.free_from(at)
            if free > at:
                self.under.append((at, min(free, end), last))
                at = free
                continue
            nth = bisect_left(self.starts, at)
            stop = min(end, self.starts[nth]) if nth < len(self.starts) else end
            self._put(at, stop)
            heapq.heappush(self.until, (last, at, stop))
            at = stop

    def _put(self, start: int, end: int) -> None:
        nth = bisect_left(self.starts, start)
        if nth and self.ends[nth - 1] == start:
            nth -= 1
            start = self.starts[nth]
            del self.starts[nth], self.ends[nth]
        if nth < len(self.starts) and self.starts[nth] == end:
            end = self.ends[nth]
            del self.starts[nth], self.ends[nth]
        self.starts.insert(nth, start)
        self.ends.insert(nth, end)

    def row(self, number: int) -> None:
        """Give back what ended above this row."""
        while self.until and self.until[0][0] < number:
            _, start, end = heapq.heappop(self.until)
            nth = bisect_right(self.starts, start) - 1
            first, last = self.starts[nth], self.ends[nth]
            del self.starts[nth], self.ends[nth]
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.starts.insert(nth, a)
                    self.ends.insert(nth, b)
            waiting, self.under = self.under, []
            for a, b, until in waiting:
                if until < number:
                    continue
                if a < end and start < b:
                    self.under += [(x, y, until) for x, y in ((a, start), (end, b)) if x < y]
                    self.add(max(a, start), min(b, end), until)
                else:
                    self.under.append((a, b, until))


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, str]]] = []  # (column, text) of cells with text
        self.blocks: dict[int, list[list[str]]] = {}  # cells of rows that hold blocks, by row
        self.taken = _Taken()
        self.column = self.cells = 0
        self.caption = ""

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.taken.row(len(self.rows) - 1)

    def cell(self, lines: list[str], columns: int, rows: int, structured: bool) -> None:
        if not self.rows:
            self.row()
        row, nth = self.rows[-1], len(self.rows) - 1
        at = self.taken.free_from(self.column)
        self.column, self.cells = at + columns, self.cells + 1
        text = " ".join(filter(None, (line.strip() for line in lines)))
        if rows > 1:
            self.taken.add(at, at + columns, nth + rows - 1)
        if structured and len(lines) > 1 and nth not in self.blocks:
            self.blocks[nth] = [[c] for _, c in row]
        if nth in self.blocks and any(lines):
            self.blocks[nth].append(lines)
        if text:
            row.append((at, text))

    def done(self) -> list[str]:
        """Lines of the table; an empty one asks for a blank line."""
        plain = [row for n, row in enumerate(self.rows) if row and n not in self.blocks]
        place = {c: i for i, c in enumerate(sorted({c for row in plain for c, _ in row}))}
        room = ROOM * (self.cells + sum(len(c) for row in plain for _, c in row))
        empty = sum(place[row[-1][0]] + 1 - len(row) for row in plain)
        widths = self._widths(plain, place, room) if empty <= room else None
        out = [self.caption] if self.caption else []
        for n, row in enumerate(self.rows):
            if n in self.blocks:
                for lines in self.blocks[n]:
                    out += ["", *lines, ""]
            elif row and widths is None:
                out.append(" | ".join(c for _, c in row))
            elif row:
                cells = [""] * (place[row[-1][0]] + 1)
                for column, text in row:
                    cells[place[column]] = text
                out.append(" | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=False)).rstrip())
        return out

    def _widths(self, plain: list[list[tuple[int, str]]], place: dict[int, int], room: int) -> list[int]:
        """Width of each column: that of its widest text, while there is room for what this adds to other cells."""
        lengths: list[list[int]] = [[] for _ in place]
        reach = [0] * (len(place) + 1)  # rows that end at a column
        for row in plain:
            reach[place[row[-1][0]]] += 1
            for column, text in row:
                lengths[place[column]].append(len(text))
        widths, rows = [], len(plain)
        for i, own in enumerate(lengths):
            own.sort()
            # The last cell of a row isn't padded; counting it all the same only spends room.
            width, empty = own[-1], rows - len(own)
            if width * rows - sum(own) > room:
                width, spent, below = 0, 0, empty
                for length in own:  # raise the width from one length to the next as far as it goes
                    step = min(length - width, (room - spent) // below if below else length - width)
                    width, spent = width + step, spent + step * below
                    if width < length:
                        break
                    below += 1
            room -= sum(width - n for n in own if n < width) + width * empty
            widths.append(width)
            rows -= reach[i]
        return widths


class Page:
    """Visible text of one page."""

    def __init__(self) -> None:
        self.open: list[tuple] = []  # (name, hidden, what was seen before, what to undo)
        self.at: dict[str, list[int]] = {}  # positions in ``open`` by name
        self.seen = True
        self.out = [_Lines()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []
        self.hidden = self.kept = 0

    def render(self, page: str) -> str:
        for kind, value, attributes in _tokens(page):
            if kind == "text":
                if self.seen and not self.hidden:
                    self.out[-1].text(html.unescape(value), self.kept > 0)
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)
        while self.open:
            self.pop()
        return "\n".join(self.out[0].done())

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self._imply(name)
        if name == "br":
            if not self.hidden:
                self.out[-1].force_break()
            return
        if name == "hr" and not self.hidden:
            self.out[-1].end_line(True)
        if name in VOID:
            return
        style = attributes.get("style", "")
        hidden = name in UNSEEN or "hidden" in attributes or bool(_HIDES.search(style))
        self.hidden += hidden
        before = self.seen
        if sight := _SIGHT.findall(style):
            self.seen = sight[-1].lower() == "visible"
        undo = None
        if not self.hidden:
            undo = self._enter(name, attributes)
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, hidden, before, undo))

    def _imply(self, name: str) -> None:
        """Close and open what the start tag implies."""
        if name in BLOCK and name not in ("td", "th", "tr", "option") and self._within("p", WALLS):
            self.end("p")
        walls = CLOSED_WITHIN.get(name, {"table"})
        ends = ENDS.get(name, ())
        while ends and self._last(ends) > self._last(walls):
            self.pop()
        if name in ("td", "th") and not self._within("tr", {"table"}) and self._within("table", ()):
            self.start("tr", {})

    def _last(self, names) -> int:
        """Position of the innermost open element of these names; -1 without one."""
        return max((own[-1] for n in names if (own := self.at.get(n))), default=-1)

    def _within(self, name: str, walls) -> bool:
        own = self._last((name,))
        return own >= 0 and own >= self._last(walls)

    def _enter(self, name: str, attributes: dict[str, str]):
        out = self.out[-1]
        if name == "li" or (name in SPACED and name != "table"):
            out.structured = True
        if name == "table":
            out.end_line(True)
            self.tables.append(_Table())
            return "table"
        if name == "tr" and self.tables:
            self.tables[-1].row()
            return None
        if name in ("td", "th", "caption") and self.tables:
            columns, rows = _span(attributes.get("colspan", ""), WIDEST) or 1, _span(attributes.get("rowspan", ""), TALLEST)
            self.out.append(_Lines())
            return ("cell", name, columns, TALLEST if rows == 0 else rows or 1, self.lists, self.kept)
        if name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and bool(self.lists)
            out.end_line(name in SPACED and not nested)
        if name in ("ul", "ol", "menu", "dir"):
            first = attributes.get("start", "1")
            # Counting down without a start would need the items to come: such a list counts up.
            self.lists.append([name == "ol", int(first) if _WHOLE.fullmatch(first) else 1, -1 if "reversed" in attributes and "start" in attributes else 1])
            return "list"
        if name == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists and _WHOLE.fullmatch(attributes.get("value", "")):
                self.lists[-1][1] = int(attributes["value"])
            numbered, number, step = self.lists[-1] if self.lists else (False, 0, 1)
            mark = f"{number}. " if numbered else "- "
            if self.lists:
                self.lists[-1][1] += step
            undo = ("li", out.prefix)
            out.prefix = "  " * depth + mark
            out.drop()
            return undo
        if name == "pre":
            self.kept += 1
            return "pre"
        return None

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        if name == "p" and not self._within("p", WALLS):
            self.start("p", {})
        walls = () if name in ("table", "html", "body") else WALLS - {name}
        if name in HEADINGS and not self._within(name, walls):
            at = self._last(HEADINGS)
            name = self.open[at][0] if at > self._last(walls) else name
        if self._within(name, walls):
            while self.pop() != name:
                pass

    def pop(self) -> str:
        name, hidden, self.seen, undo = self.open.pop()
        self.at[name].pop()
        seen = not self.hidden
        self.hidden -= hidden
        if not seen:
            return name
        if undo == "table":
            out, table = self.out[-1], self.tables.pop()
            out.structured = out.structured or len(table.rows) > 1
            for line in table.done():
                if line:
                    out.text(line, True)
                out.end_line(not line)
            out.end_line(True)
        elif undo and undo[0] == "cell":
            _, kind, columns, rows, self.lists, self.kept = undo
            own = self.out.pop()
            lines = own.done()
            if kind == "caption":
                self.tables[-1].caption = " ".join(lines)
            else:
                self.tables[-1].cell(lines, columns, rows, own.structured)
        elif undo == "list":
            self.lists.pop()
            self.out[-1].end_line(not self.lists)
        elif undo and undo[0] == "li":
            self.out[-1].end_line()
            self.out[-1].prefix = undo[1]
        else:
            if undo == "pre":
                self.kept -= 1
            if name in BLOCK:
                self.out[-1].end_line(name in SPACED)
        return name


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per input row: key, text, n_chars, n_lines.

    Null pages have empty text. A span wider than SPANS counts as SPANS. Broken markup never fails: unclosed elements end with the page, stray end tags are dropped,
    an unfinished tag at the end is no text. Rows that repeat give equal rows; other columns are ignored.
    """
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{source}`"))
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page().render(page) if page else "" for page in batch[source].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                [key, "text", "n_chars", "n_lines"],
            )

    return rows.mapInArrow(work, f"`{key}` {kind}, text string, n_chars long, n_lines long")
