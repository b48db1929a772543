"""Pair merging with segment trees, and a bounded cache of what words become.

A segment tree over the positions of a string holds in each node the least pair rank below it with its leftmost
position. The root names the next merge; a merge updates only the leaves of the live neighbours and the paths
above them. Strings of up to SHORT symbols are merged many at a time, their trees side by side in numpy arrays.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable

import numpy as np

NONE = 1 << 40
#: Rank of no pair, and the bits of a position, where both share a number of 64 bits.
GONE, PLACE = (1 << 31) - 1, (1 << 32) - 1
SHORT = 32
ROWS = 8192


class Merges:
    """Pairs of ids by rank: ``pairs[k]`` merges into ``result[k]``, lower k first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, size: int) -> None:
        self.size, self.result = size, result.astype(np.int64)
        keys = left.astype(np.int64) * size + right
        self.pairs = dict(zip(keys.tolist(), rank.tolist(), strict=True))
        # Open addressing for whole arrays of pairs.
        bits = max(8, int(8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            placed = todo[free][first]
            self.slot_key[at[placed]], self.slot_rank[at[placed]] = keys[placed], rank[placed]
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it has none; ids below 0 have none."""
        key = left * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = np.where(self.slot_key[at] == key, self.slot_rank[at], NONE)
        for _ in range(1, self.probes):
            more = np.flatnonzero((found == NONE) & (self.slot_key[at] >= 0) & (key >= 0))
            if not len(more):
                break
            at[more] = (at[more] + 1) & self.mask
            here = at[more]
            found[more] = np.where(self.slot_key[here] == key[more], self.slot_rank[here], NONE)
        return found


def merge_one(ids: list[int], merges: Merges) -> list[int]:
    """Merge one string of any length; logarithmic work for each merge, some 50 bytes for each symbol.

    A node is one number, rank above position, so that the least of two is the leftmost of the least rank. An update ends
    where a node stays what it was: nothing above it can change.
    """
    n = len(ids)
    if n < 2:
        return list(ids)
    start = np.array(ids, np.int64)
    width = 1 << max(1, (n - 1).bit_length())
    grid = np.full(2 * width, (GONE << 32) | PLACE, np.int64)
    grid[width : width + n - 1] = (np.minimum(merges.ranks(start[:-1], start[1:]), GONE) << 32) | np.arange(n - 1)
    level = width
    while level > 1:
        level >>= 1
        np.minimum(grid[2 * level : 4 * level : 2], grid[2 * level + 1 : 4 * level : 2], out=grid[level : 2 * level])
    # Single items of the array module are read and written without a numpy object for each.
    tree, own = array("q", grid.tobytes()), array("q", start.tobytes())
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    del grid, start
    pair, size, result = merges.pairs.get, merges.size, merges.result

    def put(i: int, rank: int) -> None:
        node, least = width + i, (rank << 32) | i
        while tree[node] != least:
            tree[node] = least
            if node == 1:
                return
            least, other = tree[node], tree[node ^ 1]
            least = other if other < least else least
            node >>= 1

    while (top := tree[1]) >> 32 < GONE:
        i = top & PLACE
        j = after[i]
        own[i] = new = int(result[top >> 32])
        own[j] = -1
        after[i] = k = after[j]
        put(j, GONE)
        if k < n:
            before[k] = i
        put(i, pair(new * size + own[k], GONE) if k < n else GONE)
        if (h := before[i]) >= 0:
            put(h, pair(own[h] * size + new, GONE))
    return [x for x in own if x >= 0]


def _merge_rows(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge strings of at most SHORT symbols; every round merges once in each live row."""
    rows = len(lengths)
    width = 1 << max(1, (int(lengths.max()) - 1).bit_length())
    across = width + 1
    columns = np.arange(across)
    ids = np.full((rows, across), -1, np.int64)
    ids[columns < lengths[:, None]] = symbols
    after = np.minimum(columns + 1, lengths[:, None]).ravel()
    before = np.tile(columns - 1, rows)
    grid = np.full((rows, 2 * width), NONE * SHORT, np.int64)  # rank and position in one number: the least is the leftmost
    grid[:, width:] = merges.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width) * SHORT + columns[:-1]
    level = width
    while level > 1:
        level >>= 1
        np.minimum(grid[:, 2 * level : 4 * level : 2], grid[:, 2 * level + 1 : 4 * level : 2], out=grid[:, level : 2 * level])
    tree, ids = grid.ravel(), ids.ravel()
    root, cell = np.arange(rows) * 2 * width, np.arange(rows) * across
    live = np.flatnonzero(tree[root + 1] < NONE * SHORT)
    while len(live):
        base, at = root[live], cell[live]
        top = tree[base + 1]
        rank, i = top // SHORT, top % SHORT
        new = merges.result[rank]
        j = after[at + i]
        k = after[at + j]
        ids[at + i], ids[at + j] = new, -1
        after[at + i] = k
        before[at + np.minimum(k, width)] = i
        h = before[at + i]
        some = np.flatnonzero(h >= 0)
        here = merges.ranks(
            np.concatenate([new, ids[at[some] + h[some]]]),
            np.concatenate([np.where(k < lengths[live], ids[at + np.minimum(k, width)], -1), new[some]]),
        )
        n = len(live)
        leaf = np.concatenate([i, j, h[some]])
        bases = np.concatenate([base, base, base[some]])
        tree[bases + width + leaf] = np.concatenate([here[:n], np.full(n, NONE), here[n:]]) * SHORT + leaf
        node = leaf + width
        for _ in range(width.bit_length() - 1):
            node >>= 1
            below = bases + 2 * node
            tree[bases + node] = np.minimum(tree[below], tree[below + 1])
        live = live[tree[base + 1] < NONE * SHORT]
    kept = ids >= 0
    return ids[kept].astype("<u4"), kept.reshape(rows, across).sum(1)


def merge_all(strings: list[bytes], symbols: Callable[[np.ndarray, np.ndarray], np.ndarray], merges: Merges) -> dict[bytes, bytes]:
    """Ids (little-endian, 32 bits) of each distinct string.

    ``symbols`` turns the bytes of strings and the index of each string's last byte into starting ids.
    """
    found: dict[bytes, bytes] = {}
    strings = sorted(strings, key=len)
    for some in (strings[at : at + ROWS] for at in range(0, len(strings), ROWS)):
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        if not lengths[-1]:
            found[b""] = b""
            continue
        start = symbols(np.frombuffer(b"".join(some), np.uint8), np.cumsum(lengths[lengths > 0]) - 1)
        short = int(np.searchsorted(lengths, SHORT, "right"))
        if short:
            ids, counts = _merge_rows(start[: int(lengths[:short].sum())], lengths[:short], merges)
            data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            found |= zip(some, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=False)
        at = int(lengths[:short].sum())
        for string in some[short:]:
            found[string] = np.array(merge_one(start[at : at + len(string)].tolist(), merges), "<u4").tobytes()
            at += len(string)
    return found


class WordCache:
    """Values by word in two generations; the older is dropped when the newer is full."""

    def __init__(self, learn: Callable[[set], dict], limit: int, longest: int = 40) -> None:
        self.learn, self.limit, self.longest = learn, limit, longest
        self.now: dict = {}
        self.clear()

    def clear(self, kept: int = 0) -> None:
        """Drop all words but ``kept``: those met first, so mostly frequent ones."""
        self.now = dict(itertools.islice(self.now.items(), kept))
        self.older: dict = {}

    def holding(self, words: set) -> dict:
        """A mapping that has every one of the words until the next call."""
        new = words - self.now.keys()
        if len(self.now) + len(new) > self.limit:
            self.older, self.now = {w: v for w, v in self.now.items() if len(w) <= self.longest}, {}
            new = set(words)
        if self.older:
            again = {w: self.older[w] for w in new if w in self.older}
            self.now |= again
            new -= again.keys()
        self.now |= self.learn(new)
        return self.now
