"""A byte-level BPE tokenizer compiled into two deterministic transducers, to count tokens without making them.

The first has eight states and reads code points by class; it tells where the tokenizer's pieces start. Its states are so few
that a chunk of text is a map from entry state to exit state: all chunks are run from all states side by side, a parallel
prefix scan composes their maps, and a second run from the states so found marks the starts.

The second reads bytes and starts anew at each piece. The ids of a prefix are unique, and an id may follow another exactly if
the two, put together, are left as they are by the merges. So it is enough to know, for every suffix that some id's bytes
still go on from, the id before that suffix and how many ids it took since: that is a state. A transition carries the change
of the count: below 1 where a byte joins ids into one, above where it parts them. States are made when text first leads to them.
"""

from __future__ import annotations

import json
import math
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

#: Classes of code points; white space comes in two kinds, spaces and the rest, each before white space or not.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST_SPACE, WHITE, LAST_WHITE, END, PAD = range(11)
FRESH, LETTERS, NUMBERS, OTHERS, WHITES, JOINS, ONE_MORE, TWO_MORE = range(8)
CHUNK = 256
LANE = 512
#: Fewer lanes than this are run one by one.
SINGLE = 8
BLOCK = 1 << 20
MOST_STATES = 1 << 18
#: Stands for no change of the count in the upper eight bits of a code; the lower 24 hold the next state.
EVEN = 128


def _piece_rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by symbol and state, for the pattern of contractions, letters, numbers, others and white space.

    A white-space run gives its last character to what follows: a space joins it, any other stands alone.
    """
    to, starts = np.zeros((11, 8), np.uint8), np.ones((11, 8), np.uint8)
    own = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE, SPACE: WHITES, LAST_SPACE: JOINS, WHITE: WHITES, LAST_WHITE: FRESH, END: FRESH}
    for symbol, state in own.items():
        to[symbol] = state
    for symbol, state in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (SPACE, WHITES), (WHITE, WHITES)):
        starts[symbol, state] = 0
    for apostrophe in (SHORT, LONG):  # a contraction stands only where a piece starts
        to[apostrophe, OTHERS], starts[apostrophe, OTHERS] = OTHERS, 0
        to[apostrophe, JOINS], starts[apostrophe, JOINS] = OTHERS, 0
    for symbol in (LETTER, NUMBER, OTHER):
        starts[symbol, JOINS] = 0
    to[:PAD, ONE_MORE], starts[:PAD, ONE_MORE] = FRESH, 0
    to[:PAD, TWO_MORE], starts[:PAD, TWO_MORE] = ONE_MORE, 0
    to[PAD] = range(8)
    return to.ravel(), starts.ravel()


def _classes(library: Tokenizer) -> np.ndarray:
    """Class of each code point. Where two Unicode tables differ, the tokenizer itself is asked."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    made = np.full(0x110000, OTHER, np.uint8)
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        made[at[[m.start() for m in regex.finditer(pattern, text)]]] = kind
    major = {"L": LETTER, "N": NUMBER}
    doubtful = [c for c in points if made[c] != WHITE and major.get(unicodedata.category(chr(c))[0], OTHER) != made[c]]
    split = library.pre_tokenizer.pre_tokenize_str("".join(f"\na{c}\n1{c}\n!{c}" for c in map(chr, doubtful)))
    begins = {span[0] for _, span in split}
    for k, c in enumerate(doubtful):
        made[c] = next(kind for kind, place in ((LETTER, 2), (NUMBER, 5), (OTHER, 8)) if 9 * k + place not in begins)
    made[32] = SPACE
    return made


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in the file: themselves if printable, else those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Pieces:
    """The first transducer."""

    def __init__(self, library: Tokenizer) -> None:
        self.kind = _classes(library)
        self.to, self.begins = _piece_rules()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbol of each code point; ``ends`` are the places of separators."""
        kind = self.kind[points]
        kind[ends] = END
        after = np.append(kind[1:], END)
        for white, last in ((SPACE, LAST_SPACE), (WHITE, LAST_WHITE)):
            here = np.flatnonzero(kind == white)
            follows = after[here]
            kind[here[(follows != SPACE) & (follows != WHITE) & (follows != LAST_WHITE) & (follows != LAST_SPACE) & (follows != END)]] = last
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            far = np.append(points, [0, 0])
            far[ends] = 0
            one, two = far[quotes + 1], far[quotes + 2]
            kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
            kind[quotes[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]] = LONG
        return kind

    def starts(self, symbols: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Flags of the code points at which a piece starts, and the exit state; chunk maps by parallel prefix scan."""
        n, chunks = len(symbols), max(1, -(-len(symbols) // CHUNK))
        rows = np.ascontiguousarray(np.append(symbols, np.full(chunks * CHUNK - n, PAD, np.uint8)).reshape(chunks, CHUNK).T) * np.uint8(8)
        maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], chunks, 1)
        for row in rows:
            maps = self.to.take(maps + row)
        step = 1
        while step < chunks:
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
            step *= 2
        state = np.append(np.uint8(entry), maps[entry, :-1])
        flags = np.empty((CHUNK, chunks), np.uint8)
        for row, out in zip(rows, flags, strict=True):
            at = row + state
            self.begins.take(at, out=out, mode="clip")
            state = self.to.take(at)
        return flags.T.ravel()[:n].astype(bool), int(maps[entry, -1])


class Counts:
    """The second transducer: states are numbered as they are met, transitions stand in one table of 32-bit codes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], most: int = MOST_STATES) -> None:
        byte, self.most = _byte_of(), most
        rank = {}
        self.rank: dict[tuple[int, int], int] = rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {vocabulary[c]: -1 for c in byte if c in vocabulary}
        if len(self.born) < 256:
            raise ValueError("the vocabulary has no id for some byte")
        for nth, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if made in self.born or left not in self.born or right not in self.born:
                raise ValueError("merges have to make each id once, from ids made before")
            rank[left, right], self.parts[made], self.born[made] = nth, (left, right), nth
        self.child: dict[int, int] = {}
        self.token = [-1]
        for text, own in vocabulary.items():
            node = 0
            for b in (byte[c] for c in text):
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = own if own in self.born else -1
        self.spines: tuple[dict, dict] = ({}, {})
        # The earliest merge that takes the first byte of any token below a node, -1 for a leaf; children are numbered after parents.
        self.taken: list[float] = [-1.0] * len(self.token)
        self.first = bytearray(len(self.token))
        for key, node in self.child.items():
            self.first[node] = self.first[key >> 8] if key >> 8 else key & 255
        for key, node in reversed(self.child.items()):
            under = [self._spine(self.token[node], 0)[-1][1]] if self.token[node] >= 0 else []
            under += [t for t in (self.taken[node], self.taken[key >> 8]) if t >= 0]
            self.taken[key >> 8] = min(under, default=-1.0)
        self.byte_token = [vocabulary[c] for _, c in sorted((b, c) for c, b in byte.items())]
        self.joins: dict[tuple[int, int], float] = {}
        self.stable: dict[int, bool] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Only the start state stays."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.filled = 0
        self._sized(16)

    def _sized(self, bits: int) -> None:
        """An empty table of 2 ** bits slots, each 32 bits of key above 32 bits of code."""
        self.shift, self.slots, self.reach = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _codes(self, key: np.ndarray) -> np.ndarray:
        """Codes of transitions, -1 where one is not known yet."""
        at = self._slot(key)
        found = self.slots.take(at)
        other = np.flatnonzero(found >> 32 != key)
        code = found & 0xFFFFFFFF
        for _ in range(1, self.reach):
            if not len(other):
                return code
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            found = self.slots[at[other]]
            code[other] = found & 0xFFFFFFFF
            other = other[found >> 32 != key[other]]
        code[other] = -1
        return code

    def _put(self, entries: np.ndarray) -> None:
        """Enter transitions that the table lacks; it is kept at most a third full."""
        if 3 * (self.filled + len(entries)) > len(self.slots):
            entries = np.append(self.slots[self.slots >= 0], entries)
            self._sized(max(16, int(6 * len(entries)).bit_length()))
            self.filled = 0
        self.filled += len(entries)
        at, tries = self._slot(entries >> 32), 1
        while len(entries):
            free = np.flatnonzero(self.slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]] = entries[first]
            rest = np.ones(len(entries), bool)
            rest[first] = False
            entries, at = entries[rest], (at[rest] + 1) & (len(self.slots) - 1)
            self.reach = max(self.reach, tries)
            tries += 1

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Ids that stand at an edge of a token one after the other, each with the merge that takes it."""
        if (known := self.spines[side].get(token)) is None:
            known, own, taken = [(token, math.inf)], token, math.inf
            while own in self.parts:
                taken, own = self.born[own], self.parts[own][side]
                known.append((own, taken))
            self.spines[side][token] = known
        return known

    def _meet(self, a: int, b: int, whole: bool) -> bool:
        """Whether merges join something across the border of two ids; ``whole``: the two themselves count too.

        A merge that both could take goes to the leftmost place.
        """
        rank, second = self.rank.get, self._spine(b, 0)
        for left, until in self._spine(a, 1):
            for right, before in second:
                if (own := rank((left, right))) is not None and own < until and own <= before and (whole or left != a or right != b):
                    return True
        return False

    def _stable(self, token: int) -> bool:
        """Whether a token's own bytes become that token."""
        if (known := self.stable.get(token)) is None:
            parts = self.parts.get(token)
            known = self.stable[token] = parts is None or (self._stable(parts[0]) and self._stable(parts[1]) and not self._meet(*parts, whole=False))
        return known

    def _may_follow(self, token: int, last: int) -> bool:
        if last < 0:
            return self._stable(token)
        key = (last, token)
        if (known := self.follows.get(key)) is None:
            if len(self.follows) + len(self.joins) > 500_000:
                self.follows.clear()
                self.joins.clear()
            known = self.follows[key] = self._stable(token) and not self._meet(last, token, whole=True)
        return known

    def _joined(self, last: int, byte: int) -> float:
        """The earliest merge of a byte with what stands at the end of an id, while that stands there; infinite if none."""
        key = (last, byte)
        if (known := self.joins.get(key)) is None:
            found = [r for left, until in self._spine(last, 1) if (r := self.rank.get((left, self.byte_token[byte]), math.inf)) < until] if last >= 0 else []
            known = self.joins[key] = min(found, default=math.inf)
        return known

    def _moved(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """State after a byte, and the change of the count."""
        going, found = [], None
        child, token_at = self.child.get, self.token
        for node, last, since in state:
            if (node := child(node << 8 | byte)) is None:
                continue
            if found is None and (token := token_at[node]) >= 0 and self._may_follow(token, last):
                found = (token, 1 - since)
            # No token below may follow if the first byte joins the id before it sooner than any of them takes that byte.
            if self.taken[node] >= 0 and self._joined(last, self.first[node]) > self.taken[node]:
                going.append((node, last, since))
        token, change = found
        return (*((node, last, since + change) for node, last, since in going), (0, token, 0)), change

    def _numbered(self, state: tuple) -> int:
        if (number := self.number.get(state)) is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def _learn(self, keys: list[int]) -> None:
        made = []
        for key in keys:
            after, change = self._moved(self.states[key >> 8], key & 255)
            made.append(key << 32 | (EVEN - change) << 24 | self._numbered(after))
        self._put(np.array(made, np.int64))

    def _kept(self, live: np.ndarray) -> np.ndarray:
        """Start a new table that has the live states alone; their new numbers."""
        old = [self.states[i] for i in live.tolist()]
        self.forget()
        return np.array([self._numbered(s) for s in old], np.int64)

    def changes(self, data: np.ndarray, begins: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """Change of the count at each byte, and the state after the last; flags tell where pieces start.

        Lanes of some LANE bytes start where a piece does and run side by side. What a piece longer than that makes of a
        lane is run on its own.
        """
        n = len(data)
        at = np.flatnonzero(begins)
        cuts = at[np.minimum(np.searchsorted(at, np.arange(0, n, LANE)), max(len(at) - 1, 0))] if len(at) else at
        cuts = np.unique(np.append(cuts, 0))
        lengths = np.diff(np.append(cuts, n))
        order = np.argsort(-lengths, kind="stable")
        cuts, lengths = cuts[order], lengths[order]
        state = np.zeros(len(cuts), np.int64)
        state[cuts == 0] = self._numbered(entry)
        keep = (~begins).astype(np.int64)
        out = np.empty(n, np.int16)
        final = int(np.flatnonzero(cuts == cuts.max())[0])
        running = len(cuts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right") if n else []
        for t, k in enumerate(running):
            if len(self.states) + k > self.most:
                state = self._kept(state)
            if k <= SINGLE:
                for lane in range(k):
                    state[lane] = self._numbered(self._alone(data, begins, out, int(cuts[lane]) + t, int(cuts[lane] + lengths[lane]), self.states[int(state[lane])]))
                break
            here = cuts[:k] + t
            key = (state[:k] * keep[here]) << 8 | data[here]
            code = self._codes(key)
            if int(code.min()) < 0:
                self._learn(np.unique(key[code < 0]).tolist())
                code = self._codes(key)
            out[here] = EVEN - (code >> 24)
            state[:k] = code & 0xFFFFFF
        return out, self.states[int(state[final])]

    def _alone(self, data: np.ndarray, begins: np.ndarray, out: np.ndarray, at: int, end: int, state: tuple) -> tuple:
        """Run one lane by itself, a byte at a time, with numbers of its own; the state at its end."""
        states, number = [self.states[0]], {self.states[0]: 0}
        known: dict[int, tuple[int, int]] = {}

        def entered(some: tuple) -> int:
            if (own := number.get(some)) is None:
                own = number[some] = len(states)
                states.append(some)
            return own

        now, changes = entered(state), []
        for byte, fresh in zip(data[at:end].tolist(), begins[at:end].tolist(), strict=True):
            key = byte if fresh else now << 8 | byte
            if (step := known.get(key)) is None:
                after, change = self._moved(states[key >> 8], byte)
                if len(states) >= self.most:
                    states, number, known = [self.states[0]], {self.states[0]: 0}, {}
                    key = -1
                step = known[key] = (entered(after), change)
            now, change = step
            changes.append(change)
        out[at:end] = changes
        return states[now]


class Compiled:
    """Both transducers of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = {"dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        if (
            told["normalizer"] is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE"
            or any(model.get(k) not in (v, None) for k, v in plain.items()) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"])
        ):
            raise ValueError("only plain byte-level BPE files can be compiled")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(told["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.pieces = Pieces(Tokenizer.from_file(path))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.counts = Counts(model["vocab"], merges)
        self.start = self.counts.states[0]

    def _segments(self, texts: list[str], counts: list[int], sizes: list[int]):
        """(row, text, what follows) of segments between special strings; an overlong one comes in blocks, each with two more characters."""
        for row, text in enumerate(texts):
            at = 0
            for m in [*self.special.finditer(text), None]:
                end = m.start() if m else len(text)
                while end - at > BLOCK:
                    yield row, text[at : at + BLOCK], text[at + BLOCK : at + BLOCK + 2]
                    at += BLOCK
                yield row, text[at:end], ""
                if m:
                    counts[row] += 1
                    sizes[row] += len(m.group().encode())
                    at = m.end()

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        counts, sizes = [0] * len(texts), [0] * len(texts)
        carry, group, held = (FRESH, self.start), [], 0
        for row, text, follows in self._segments(texts, counts, sizes):
            if group and held + len(text) > BLOCK:
                carry = self._block(group, "", carry, counts, sizes)
                group, held = [], 0
            group.append((row, text))
            held += len(text) + 1
            if follows:
                carry = self._block(group, follows, carry, counts, sizes)
                group, held = [], 0
        if group:
            self._block(group, "", carry, counts, sizes)
        return sizes, counts

    def _block(self, group: list[tuple[int, str]], follows: str, carry: tuple, counts: list[int], sizes: list[int]) -> tuple:
        """Count some segments; if characters follow, the last one goes on in the next block."""
        joined = "\0".join([t for _, t in group]) + ("" if follows else "\0")
        points = np.frombuffer((joined + follows).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for _, t in group])
        ends = np.cumsum(lengths + 1) - 1
        symbols = self.pieces.symbols(points, ends[:-1] if follows else ends)[: len(joined)]
        points = points[: len(joined)]
        begins, state = self.pieces.starts(symbols, carry[0])
        data = np.frombuffer(joined.encode(), np.uint8)
        places = np.arange(len(points) + 1)
        if len(data) != len(points):
            places = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)))
            flags = np.zeros(len(data), bool)
            flags[places[:-1][begins]] = True
            begins = flags
        changes, after = self.counts.changes(data, begins, carry[1])
        total = np.append(0, np.cumsum(changes, dtype=np.int64))
        first, last = places[ends - lengths], places[np.minimum(ends, len(points))]
        for (row, _), tokens, size in zip(group, (total[last] - total[first]).tolist(), (last - first).tolist(), strict=True):
            counts[row] += tokens
            sizes[row] += size
        return (state, after) if follows else (FRESH, self.start)


_LOADED: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The transducers of a file, compiled once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Compiled(path)
    return _LOADED[path]
