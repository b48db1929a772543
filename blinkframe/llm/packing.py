"""Best-fit packing of tokenized documents into sequences of a fixed length.

Token counts are found where the text is read, words through a bounded cache; only small rows (id, piece,
length, checksum) go on. They are dealt evenly over as many tasks as their number asks for, and every task
packs its share online: a fixed number of open bins, kept in a bitset keyed by free space, each piece into
the fullest bin it fits, and the fullest bin closed when another must be opened. What comes when is for Spark
to say: a task's pieces come in groups of some thousands, drawn by hash, and longest first within each. So a
lost task is packed again just as before, and fewer bins are left half full than with pieces as they stand.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.bpe import Merges, WordCache, merge_all
from blinkframe.llm.frames import checkpoint

LENGTH = 4096
OPEN_BINS = 1024
PIECES_A_TASK = 100_000
PIECES_A_GROUP = 8192
#: Words a worker keeps, and parts of words.
CACHED_WORDS, CACHED_PARTS = 500_000, 250_000
KEPT_WORDS = 50_000
ENDS = frozenset(".,;:!?")
#: Characters that need the tokenizer itself: beyond Latin-1, or white space to Python alone.
BEYOND = re.compile("[\x1c-\x1f\x85\xa0\u0100-\U0010ffff]").search
CHARS_AT_ONCE = 2 << 20
SPREAD = 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of words by a tokenizer file with word ends, lower case and white space dropped.

    The tokenizer's pattern never joins across white space, so a text's ids are those of its words in order.
    Words of Latin-1 texts are cut and merged here, each distinct part once; words of any other text go to
    the tokenizer itself. Added tokens of the file are taken out of a text first, as the tokenizer does it, and
    have their ids. Of a file that normalizes or cuts in any other way, the tokenizer encodes whole texts.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.parts, self.words = WordCache(self._merged, min(limit, CACHED_PARTS)), WordCache(self._split, limit)
        self.known = known_kind(told)
        if not self.known:
            return
        self.added = {t["content"]: (t["id"],) for t in told["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        model, (pattern, *_) = told["model"], told["pre_tokenizer"]["pretokenizers"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.parts_of = regex.compile(pattern["pattern"]["Regex"]).findall
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(
            np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]),
            np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs]), max(vocab.values()) + 1,
        )
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)

    def _symbols(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = self.inner[data]
        found[ends] = self.last[data[ends]]
        return found

    def _merged(self, parts: set[str]) -> dict[str, bytes]:
        data = {p.encode(): p for p in parts}
        return {data[d]: ids for d, ids in merge_all(list(data), self._symbols, self.merges).items()}

    def _split(self, words: set) -> dict:
        """Ids of words: lower-case text of Latin letters, or else the bytes of any word, or an added token's id in a tuple."""
        found: dict = {}
        whole, ended, others = [], [], {}
        for word in words:
            if word.__class__ is bytes:
                found[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            elif word.__class__ is tuple:
                found[word] = np.array(word, "<u4").tobytes()
            elif word.isalpha():
                whole.append(word)
            elif word[-1] in ENDS and word[:-1].isalpha():
                ended.append(word)
            else:
                others[word] = self.parts_of(word)
        needed = set(whole).union(ENDS, [word[:-1] for word in ended], *others.values())
        ids = self.parts.holding(needed)
        found |= zip(whole, map(ids.__getitem__, whole), strict=True)
        for word in ended:
            found[word] = ids[word[:-1]] + ids[word[-1]]
        for word, parts in others.items():
            found[word] = b"".join([ids[p] for p in parts])
        return found

    def _listed(self, text: str) -> list:
        """Words of a text in order, with the added tokens between them."""
        if not any(token in text for token in self.added):
            return text.encode().split() if BEYOND(text) else text.lower().split()
        found: list = []
        for nth, part in enumerate(self.apart(text)):
            found += [self.added[part]] if nth % 2 else part.encode().split() if BEYOND(part) else part.lower().split()
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text (little-endian, 32 bits), texts worked off in groups of bounded length."""
        if not self.known:
            yield from (np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() for text in texts)
            return
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at] or "") <= CHARS_AT_ONCE):
                text = texts[at] or ""
                size += len(text)
                group.append(self._listed(text))
                at += 1
            ids = self.words.holding(set().union(*group)).__getitem__
            for words in group:
                yield b"".join(map(ids, words))

    def forget(self) -> None:
        """Drop most of the caches: workers outlive their tasks, and the next may be another operator's."""
        self.parts.clear(KEPT_WORDS)
        self.words.clear(KEPT_WORDS)


def known_kind(told: dict) -> bool:
    """Whether a tokenizer file lowers, drops white space, cuts and ends words in the one way that is worked off here."""
    normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    cut = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    model, flags = told["model"], ("lstrip", "rstrip", "single_word", "normalized")
    return (
        told["normalizer"] == normal and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [cut, letters]} and model["type"] == "BPE"
        and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t[f] for t in told["added_tokens"] for f in flags)
    )


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker for the tokenizer file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Cut every document's ids, closed by ``end_id``, into pieces of ``length``; the last may be shorter.

    Null and empty texts have the closing id alone. Null ids and repeated rows are kept as they are.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, length)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class BestFit:
    """Bounded-space online best fit; open bins are found through a bitset keyed by free space."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.open_bins = length, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``length`` tokens."""
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.length
            self.made += 1
        left = free - need
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.length - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` column; sequences are gapless from 0.

    The number of tasks follows the number of pieces, so the few bins that each task leaves half full stay a
    fixed small share. An empty table gives no rows.
    """
    pieces = checkpoint(pieces)
    count = pieces.count()
    tasks = max(1, -(-count // pieces_a_task))
    groups = max(1, count // tasks // PIECES_A_GROUP)
    order = [F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)), F.desc("length"), "doc_id", "piece"]
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = BestFit(length, open_bins), TaskContext.get().partitionId() << SPREAD
        for batch in batches:
            placed = [bins.place(need) for need in batch["length"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + number for number, _ in placed], pa.int64()), pa.array([offset for _, offset in placed], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return pieces.repartition(tasks).sortWithinPartitions(*order).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Any other column of ``docs`` is ignored. Rows that repeat are packed as often as they occur.
    """
    return pack(token_pieces(docs, tokenizer, end_id, length), length, open_bins)
