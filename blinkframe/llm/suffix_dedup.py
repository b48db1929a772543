"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Only windows that can repeat are sorted. Every window of ``length`` bytes names one anchor inside itself (mod-minimizer
sampling: about one anchor for each half window of text), and equal windows name equal anchors.

1. Anchor hashes, packed by destination, are dealt out; an anchor met in one text only is dropped there.
2. Texts with other anchors give the runs of windows that share one, with their bytes. Dealing and sorting these runs
   by anchor is the first, distributed digit of the radix sort. An anchor of very many texts would fill one task: the
   windows of its runs are dealt one by one, with all their bytes as the digit, and repeats within a batch go before.
3. A task streams its runs in (anchor, doc_id) order. Runs of equal bytes collapse to their first document; where an
   anchor has several distinct runs, their suffixes are ordered by most-significant-digit passes of eight bytes, to the
   depth of the window and no further; groups of one are dropped after every pass. Equal groups are the repeats.

A document is only ever compared with smaller doc_ids, so a task holds the distinct runs of one anchor, not its copies.
Equal whole texts are told from a digest beforehand: only the first of them takes part, the others lose every byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.frames import slices, text_bytes

LENGTH = 50
SLICE_BYTES = 1 << 18
RUNS_AT_ONCE = 40_000
#: Bytes of text for each part that anchors and spans are dealt to, so that a task's memory doesn't grow with the corpus.
PART_BYTES = 1 << 27
#: Bytes of runs that are copied at once; their positions take eight times as much.
COPIED_BYTES = 1 << 20
#: Copies of one text are dealt by digest and one of so many salts when they look for the first of them.
SALTS = 64
#: Texts that share an anchor beyond which its windows are dealt one by one, by all their bytes.
HOT_TEXTS = 10_000
HOT = np.uint64(1 << 63)
LAST = (1 << 63) - 1
#: Texts are found again by 32 bits of their uid: those that share them get each other's anchors too, which changes nothing.
SHORT_UID = 0xFFFFFFFF
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(buffer: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, least first; the buffer must end in seven spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a text that name one anchor: (row, first window, windows, anchor hash).

    ``bounds`` cut ``data`` into texts; positions are in ``data``.
    """
    step = (length - 4) // 2
    size = length - step + 1
    short = size - step
    total = len(data)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if total < length:
        return empty
    words = _words(np.concatenate([data, np.zeros(8, np.uint8)]))
    positions = total - short + 1
    least = _mixed((words[:positions] << np.uint64(64 - 8 * short)) * MIX)
    least = (least & np.uint64(0xFFFFFFFF00000000)) | np.arange(positions, dtype=np.uint64)
    reach, span = length - short + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    windows = np.arange(len(least), dtype=np.int64)
    anchor = windows + ((least & np.uint64(0xFFFFFFFF)).astype(np.int64) - windows) % step
    row = np.searchsorted(bounds, windows, "right") - 1
    valid = windows + length <= bounds[row + 1]
    windows, anchor, row = windows[valid], anchor[valid], row[valid]
    if not len(windows):
        return empty
    starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1) | (row[1:] != row[:-1])])
    counts = np.diff(np.r_[starts, len(windows)])
    at = anchor[starts]
    value = np.zeros(len(at), np.uint64)
    for offset in [*range(0, size - 8, 8), size - 8]:
        value = _mixed(value * MIX + words[at + offset])
    return row[starts], windows[starts], counts, value


def _parts(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows from a to b and the bytes of them to look at: texts by slices, and a longer one in parts.

    Parts overlap by a byte less than a window has, so each window lies in one part. What a window names is told from its own
    bytes, so a run that is cut there is two runs of one anchor, whose windows are compared like those of any other.
    """
    for a, b in slices(bounds, SLICE_BYTES):
        low, high = int(bounds[a]), int(bounds[b])
        if high - low < SLICE_BYTES + length:
            yield a, b, low, high
        else:
            for at in range(low, high - length + 1, SLICE_BYTES):
                yield a, b, at, min(at + SLICE_BYTES + length - 1, high)


def _codes(anchors: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Destination of an anchor, and what tells it from others there."""
    return (anchors % np.uint64(parts)).astype(np.int64), (anchors >> np.uint64(32)).astype(np.uint32)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary column of consecutive parts of ``data``, which begin at ``starts``."""
    ends = np.r_[starts, len(data)] * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _packed_anchors(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts of each batch: part, short uids, index into them, rest of the hash; equal texts once."""
    for batch in batches:
        data, bounds = text_bytes(batch["text"])
        ids, uids = batch["doc_id"].to_numpy(), batch["uid"].to_numpy()
        first: dict[bytes, int] = {}
        for row in range(len(ids)):
            key = xxhash.xxh3_128_digest(data[bounds[row] : bounds[row + 1]])
            if key not in first or ids[row] < ids[first[key]]:
                first[key] = row
        chosen = np.zeros(len(ids), bool)
        chosen[list(first.values())] = True
        found = []
        for a, b, low, high in _parts(bounds, length):
            row, _, _, anchors = runs(data[low:high], np.clip(bounds[a : b + 1], low, high) - low, length)
            keep = chosen[a + row]
            found.append((a + row[keep], anchors[keep]))
        row, anchors = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if not len(row):
            continue
        part, rest = _codes(anchors, parts)
        order = np.lexsort((rest, row, part))
        part, rest, row = part[order], rest[order], row[order]
        fresh = np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])]
        part, rest, row = part[fresh], rest[fresh], row[fresh]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            own, index = np.unique(row[a:b], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[a]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in ((uids[own] & SHORT_UID).astype("<u4"), index.astype("<u2" if len(own) <= 1 << 16 else "<u4"), rest[a:b]))],
                ["part", "shorts", "at", "rest"],
            )


def _packs(uid: np.ndarray, values: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``values`` (64-bit, one for each uid given) packed by bucket of their uid: bucket, uids, counts, rows."""
    if not len(uid):
        return
    bucket = (_mixed(uid.view(np.uint64) * MIX) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((uid, bucket))
    uid, values, bucket = uid[order], values[order], bucket[order]
    edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(uid)]
    columns: list[list] = [[], [], [], []]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, counts = np.unique(uid[a:b], return_counts=True)
        for column, value in zip(columns, (int(bucket[a]), own.tobytes(), counts.astype("<u4").tobytes(), values[a:b].tobytes()), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "uids", "counts", "rows"])


PACKS = "bucket long, uids binary, counts binary, rows binary"


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each uid with all its values: uid, rows."""
    uids, values = [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
    for batch in batches:
        for own, counts, rows in zip(*(batch[n].to_pylist() for n in ("uids", "counts", "rows")), strict=True):
            uids.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(counts, "<u4")))
            values.append(np.frombuffer(rows, np.int64).reshape(-1, width))
    uid, value = np.concatenate(uids), np.concatenate(values)
    order = np.argsort(uid, kind="stable")
    uid, value = uid[order], value[order]
    starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, np.int64)
    edges = np.r_[starts, len(uid)]
    for at in range(0, len(starts), 2000):
        some = edges[at : at + 2001]
        yield pa.RecordBatch.from_arrays([pa.array(uid[some[:-1]]), _binary(value[some[0] : some[-1]].ravel(), (some[:-1] - some[0]) * width)], ["uid", "rows"])


def _shared_anchors(batches: Iterator[pa.RecordBatch], parts: int, hot_texts: int) -> Iterator[pa.RecordBatch]:
    """Anchors that two texts or more have, packed by short uid. Each text comes once, with its anchors told apart.

    Anchors of more than ``hot_texts`` texts are marked.
    """
    shorts, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for part, own, at, rest in zip(*(batch[n].to_pylist() for n in ("part", "shorts", "at", "rest")), strict=True):
            shorts.append(np.frombuffer(own, "<u4")[np.frombuffer(at, "<u2" if len(own) <= 4 << 16 else "<u4")].astype(np.int64))
            codes.append(np.frombuffer(rest, np.uint32).astype(np.uint64) * np.uint64(parts) + np.uint64(part))
    short, code = np.concatenate(shorts), np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    short, code = short[order], code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    texts = np.diff(np.r_[starts, len(code)])
    texts = np.repeat(texts, texts)
    code[texts > hot_texts] |= HOT
    yield from _packs(short[texts > 1], code[texts > 1].view(np.int64), parts)


def _spans_of(uid: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with those of one document joined where they touch: uid, rows of (doc, begin, end)."""
    order = np.lexsort((begin, doc, uid))
    uid, doc, begin, end = uid[order], doc[order], begin[order], end[order]
    new = np.r_[True, (uid[1:] != uid[:-1]) | (doc[1:] != doc[:-1])][: len(uid)]
    # Shifted apart by document, spans of different documents never touch.
    apart = np.cumsum(new) * (int(end.max(initial=0)) + 2)
    low, high = merged(begin + apart, end + apart)
    first = np.searchsorted(begin + apart, low)
    return uid[first], np.stack([doc[first], low - apart[first], high - apart[first]], 1)


def _window_keys(piece: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the windows that begin at ``start``."""
    words = _words(np.concatenate([piece, np.zeros(8, np.uint8)]))
    value = np.zeros(len(start), np.uint64)
    for offset in [*range(0, length - 8, 8), length - 8]:
        value = _mixed(value * MIX + words[start + offset])
    return value


def _among(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in a sorted pool."""
    if not len(pool):
        return np.zeros(len(values), bool)
    return pool[np.minimum(np.searchsorted(pool, values), len(pool) - 1)] == values


def _copied(piece: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of all runs one behind the other, some at a time."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.empty(ends[-1], np.uint8)
    cuts = np.unique(np.r_[0, np.searchsorted(begins, np.arange(0, ends[-1], COPIED_BYTES)), len(sizes)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[begins[a] : ends[b - 1]] = piece[np.repeat(start[a:b] - begins[a:b], sizes[a:b]) + np.arange(begins[a], ends[b - 1])]
    return out


def _shared_runs(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose anchor other texts have too.

    A run that a smaller document of the same batch has as well is a repeat whatever else there is, and is not compared.
    Runs of marked anchors are cut into their windows, each under a key of its own.
    """
    for batch in batches:
        data, bounds = text_bytes(batch["text"])
        ids, uids, codes = batch["doc_id"].to_numpy(), batch["uid"].to_numpy(), batch["rows"]
        found: list[tuple] = []
        text, plain, marked = -1, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for a, b, low, high in _parts(bounds, length):
            piece = data[low:high]
            row, start, count, anchors = runs(piece, np.clip(bounds[a : b + 1], low, high) - low, length)
            part, rest = _codes(anchors, parts)
            code = rest.astype(np.uint64) * np.uint64(parts) + part.astype(np.uint64)
            edges = np.searchsorted(row, np.arange(b - a + 1))
            keep, hot = np.zeros(len(row), bool), np.zeros(len(row), bool)
            for r in range(b - a):
                if text != a + r:
                    text, own = a + r, np.sort(np.frombuffer(codes[a + r].as_py(), np.uint64))
                    plain, marked = np.split(own, [np.searchsorted(own, HOT)])
                    marked = marked & ~HOT
                some = slice(edges[r], edges[r + 1])
                hot[some] = _among(code[some], marked)
                keep[some] = hot[some] | _among(code[some], plain)
            row, start, count, anchors, hot = row[keep], start[keep], count[keep], anchors[keep], hot[keep]
            if not len(row):
                continue
            sizes = count + length - 1
            if hot.any():
                times = np.where(hot, count, 1)
                sizes = np.repeat(np.where(hot, length, sizes), times)
                row, start, anchors, hot, first = (np.repeat(v, times) for v in (row, start, anchors, hot, np.cumsum(times) - times))
                start = start + np.arange(len(start)) - first
                anchors[hot] = _window_keys(piece, start[hot], length)
            found.append((anchors.view(np.int64), a + row, start + low - bounds[a + row], sizes, _binary(_copied(piece, start, sizes), np.cumsum(sizes) - sizes)))
            if sum(len(f[4]) for f in found) >= RUNS_AT_ONCE:
                yield from _sent(found, ids, uids, parts)
                found = []
        yield from _sent(found, ids, uids, parts)


RUNS = "anchor long, doc_id long, uid long, start int, more binary, content binary, uids binary, counts binary"


def _sent(found: list[tuple], ids: np.ndarray, uids: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs to compare; what is a repeat already goes along as packs, whose rows stand in ``content``."""
    if not found:
        return
    anchors, row, start, sizes = (np.concatenate([f[i] for f in found]) for i in range(4))
    content = pa.concat_arrays([f[4] for f in found])
    code = content.dictionary_encode().indices.to_numpy()
    least = np.full(code.max() + 1, LAST, np.int64)
    np.minimum.at(least, code, ids[row])
    known = ids[row] > least[code]
    names = ["anchor", "doc_id", "uid", "start", "more", "content", "uids", "counts"]
    # Equal runs of one text, as periodic texts have them by the hundred, are one row: its first start and the others.
    open_ = np.flatnonzero(~known)
    open_ = open_[np.lexsort((start[open_], row[open_], code[open_]))]
    new = np.flatnonzero(np.r_[True, (code[open_][1:] != code[open_][:-1]) | (row[open_][1:] != row[open_][:-1])][: len(open_)])
    others = np.ones(len(open_), bool)
    others[new] = False
    edges = np.r_[0, np.cumsum(others)][np.r_[new, len(open_)]] * 4
    more = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(start[open_][others].astype("<i4"))])
    open_ = open_[new]
    none = pa.nulls(len(open_), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(anchors[open_]), pa.array(ids[row[open_]]), pa.array(uids[row[open_]]), pa.array(start[open_].astype(np.int32)), more, content.take(pa.array(open_)), none, none], names)
    own = row[known]
    if len(own):
        for pack in _packs(*_spans_of(uids[own], ids[own], start[known], start[known] + sizes[known]), parts):
            n = len(pack)
            yield pa.RecordBatch.from_arrays([pack["bucket"], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pack["rows"], pack["uids"], pack["counts"]], names)


def equal_groups(buffer: np.ndarray, suffixes: np.ndarray, group: np.ndarray, depth: int, still: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes through ``depth`` bytes by most-significant-digit passes, within the groups they start in.

    Returns (index into suffixes, group) of all that are equal to another one; ``buffer`` ends in eight spare bytes.
    ``still(index, starts)`` may drop more groups after a pass: True for each group that is worth another.
    """
    words = _words(buffer)
    index = np.arange(len(suffixes))
    order = np.argsort(group, kind="stable")
    index, group = index[order], group[order]
    for offset in [*range(0, depth - 8, 8), max(0, depth - 8)] if depth >= 8 else [0]:
        if not len(index):
            break
        digit = words[suffixes[index] + offset].byteswap()
        if depth < 8:
            digit = digit >> np.uint64(64 - 8 * depth)
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        change = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.r_[starts, len(index)])
        worth = sizes > 1
        if still is not None:
            worth &= still(index, starts)
        keep = np.repeat(worth, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)[keep]
        index = index[keep]
    return index, group


def _repeats(anchor: np.ndarray, doc: np.ndarray, content: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of repeats in runs, positions from the run's start, and the row of each distinct run's first document."""
    coded = content.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    order = np.lexsort((np.arange(len(code)), doc, code))
    starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    first_row = np.empty(len(distinct), np.int64)
    first_row[code[order][starts]] = order[starts]
    first = doc[first_row]
    sizes = np.asarray(pa.compute.binary_length(distinct), np.int64)
    whole = np.flatnonzero(doc > first[code])
    # Distinct runs of an anchor that has several: their suffixes, window by window.
    _, inverse, counts = np.unique(anchor[first_row], return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[inverse] > 1)
    row, begin = [whole, np.zeros(0, np.int64)], np.zeros(0, np.int64)
    if len(several):
        part = distinct.take(pa.array(several))
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        buffer = np.concatenate([np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        windows = np.diff(offsets) - length + 1
        of = np.repeat(np.arange(len(several)), windows)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        owner = first[several][of]
        index, group = equal_groups(
            buffer, offsets[of] - offsets[0] + inner, inverse[several][of], length,
            lambda i, starts: np.minimum.reduceat(owner[i], starts) < np.maximum.reduceat(owner[i], starts),
        )
        if len(index):
            least = np.minimum.reduceat(owner[index], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
            later = index[owner[index] > np.repeat(least, np.unique(group, return_counts=True)[1])]
            # Every row of the first document with this run loses the window: rows of other documents lose the run already.
            lost_of, lost_at = of[later], inner[later]
            rows = order[(doc[order] == first[code[order]])]
            by_code = code[rows]
            low, high = np.searchsorted(by_code, several[lost_of], "left"), np.searchsorted(by_code, several[lost_of], "right")
            times = high - low
            row[1] = rows[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            begin = np.repeat(lost_at, times)
    rows = np.concatenate(row)
    begins = np.concatenate([np.zeros(len(whole), np.int64), begin])
    ends = np.concatenate([sizes[code[whole]], begin + length])
    return rows, begins, ends, first_row


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; such that touch become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    return begin[new], end[np.r_[new[1:], True]]


def _places(row: np.ndarray, start: np.ndarray, more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every start of the runs in ``row``: index into ``row``, start."""
    more = more.fill_null(b"")
    edges = np.frombuffer(more.buffers()[1], np.int32)[more.offset : more.offset + len(more) + 1] // 4
    data = more.buffers()[2]
    other = np.frombuffer(data, "<i4") if data is not None and data.size else np.zeros(1, "<i4")
    times = 1 + np.diff(edges)[row]
    which = np.repeat(np.arange(len(row)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    place = np.minimum(edges[row[which]] + np.maximum(nth - 1, 0), len(other) - 1)
    return which, np.where(nth == 0, start[row[which]], other[place])


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Repeats in runs that come sorted by anchor and doc_id, packed by text; packs pass through."""
    carried: pa.Table | None = None
    held: list[pa.RecordBatch] = []

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal carried
        table = pa.Table.from_batches(held)
        old = 0
        if carried is not None:
            old = len(carried)
            table = pa.concat_tables([carried, table])
        anchor, doc, uid, start = (table[n].to_numpy() for n in ("anchor", "doc_id", "uid", "start"))
        row, begin, end, first = _repeats(anchor, doc, pa.concat_arrays(table["content"].chunks), length)
        # What later rows of the last anchor have to be compared with.
        carried = table.take(pa.array(np.sort(first[anchor[first] == anchor[-1]])))
        mine = row >= old
        row, begin, end = row[mine], begin[mine], end[mine]
        which, at = _places(row, start, pa.concat_arrays(table["more"].chunks))
        row = row[which]
        yield from _packs(*_spans_of(uid[row], doc[row], begin[which] + at, end[which] + at), parts)

    for batch in batches:
        packed = pa.compute.is_valid(batch["uids"])
        packs = batch.filter(packed)
        if len(packs):
            yield pa.RecordBatch.from_arrays([packs["anchor"], packs["uids"], packs["counts"], packs["content"]], ["bucket", "uids", "counts", "rows"])
        plain = batch.filter(pa.compute.invert(packed)).select(["anchor", "doc_id", "uid", "start", "more", "content"])
        if len(plain):
            held.append(plain)
        if sum(map(len, held)) >= RUNS_AT_ONCE:
            yield from work()
            held = []
    if held:
        yield from work()


def _removed(row: dict, length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Text of a row and the spans that it loses."""
    data = (row["text"] or "").encode()
    if row["first_id"] < row["doc_id"]:
        return data, *(np.array(x, np.int64) for x in (([0], [len(data)]) if len(data) >= length else ([], [])))
    own = np.frombuffer(row["lost"] or b"", np.int64).reshape(-1, 3)
    own = own[own[:, 0] == row["doc_id"]]
    return data, *merged(own[:, 1], own[:, 2])


def _with_spans(docs: DataFrame, key: str, text: str, length: int, hot_texts: int, payload) -> DataFrame:
    """doc_id, text, payload, first_id (least id of equal texts) and lost (spans) of every row."""
    if length < 16:
        raise ValueError("windows of 16 bytes or more")
    known = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), payload.alias("payload"))
    known = known.withColumn("uid", F.xxhash64("doc_id", "text"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    # Copies of one text meet by salts: a salt's first, then the first of all, which goes back to each salt that is there.
    digests = known.select("doc_id", "uid", F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod("uid", F.lit(SALTS)).alias("salt")).distinct()
    salted = digests.groupBy("digest", "salt").agg(F.min("doc_id").alias("first_id"))
    firsts = salted.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.collect_list("salt").alias("salts"))
    status = digests.join(firsts.select("digest", "first_id", F.explode("salts").alias("salt")), ["digest", "salt"]).select("uid", F.col("doc_id").alias("of"), "first_id")

    # All joins with texts deal the same columns by uid, so that the texts are shuffled once.
    texts = known.select("doc_id", "uid", "text", "payload")
    firsts_only = status.filter("of = first_id").select("uid").distinct()
    own = texts.join(firsts_only, "uid").select("doc_id", "uid", "text", "payload")
    packed = own.mapInArrow(lambda it: _packed_anchors(it, length, parts), "part long, shorts binary, at binary, rest binary")
    shared = packed.repartition(parts, "part").mapInArrow(lambda it: _shared_anchors(it, parts, hot_texts), PACKS)
    hits = shared.repartition(parts, "bucket").mapInArrow(lambda it: _unpacked(it, 1), "uid long, rows binary")
    hits = firsts_only.join(hits.withColumnRenamed("uid", "short"), F.col("uid").bitwiseAND(F.lit(SHORT_UID)) == F.col("short")).select("uid", "rows")
    found = texts.join(hits, "uid").select("doc_id", "uid", "text", "payload", "rows").mapInArrow(lambda it: _shared_runs(it, length, parts), RUNS)
    sorted_runs = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
    spans = sorted_runs.mapInArrow(lambda it: _sorted_runs(it, length, parts), PACKS)
    lost = spans.repartition(parts, "bucket").mapInArrow(lambda it: _unpacked(it, 3), "uid long, rows binary").withColumnRenamed("rows", "lost")
    marks = status.join(lost, "uid", "left")
    # Texts with one uid but other ids are told apart behind the join: as a key the id would ask for another shuffle.
    return texts.join(marks, "uid").filter("doc_id - of = 0").select("doc_id", "uid", "text", "payload", "first_id", "lost")


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Null text
    counts as empty; a null id is above every other, and rows of one id never count against each other. Rows that repeat
    give equal rows. Other columns are ignored. ``hot_texts`` decides how work is dealt, not what is found.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, begin, end = _removed(row, length)
                kept = hashlib.sha256()
                at = 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((None if row["doc_id"] == LAST else row["doc_id"], len(data), int((end - begin).sum()), len(begin), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, key, text, length, hot_texts, F.lit(0).cast("byte")).mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``; other columns are unchanged, null text stays null.

    Rules as in :func:`repeat_digests`. A character that loses some of its bytes goes as a whole.
    """
    schema = docs.schema
    carried = [name for name in docs.columns if name != text]
    payload = F.struct(*[F.col(f"`{name}`").alias(f"c{n}") for n, name in enumerate(carried)], F.col(f"`{text}`").isNull().alias("empty"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, begin, end = _removed(row, length)
                cuts = np.r_[0, np.stack([begin, end], 1).ravel(), len(data)].tolist()
                # Piece by piece: halves of characters on both sides of a cut must not make up another one.
                kept = "".join(data[a:b].decode(errors="ignore") for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                own = row["payload"]
                out.append({name: own[f"c{n}"] for n, name in enumerate(carried)} | {text: None if own["empty"] else kept})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return _with_spans(docs, key, text, length, hot_texts, payload).mapInArrow(work, schema)
