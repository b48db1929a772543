"""Byte-level BPE encoding and decoding.

Text is cut by the vocabulary's pattern and every match is merged on its own with the segment trees of
:mod:`blinkframe.llm.bpe`. Words that were met before come from a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.bpe import Merges, WordCache, merge_all

CACHED = 200_000
KEPT_WORDS = 50_000
CHARS_AT_ONCE = 2 << 20
ENDS = frozenset(".,;:!?")
SINGLE = regex.compile(r"(?<=\S) (?=\S)")
DOUBLED = regex.compile(r"\s\s")


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, lines: list[bytes], pattern: str, limit: int = CACHED) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        left, right, ranks = [], [], []
        for token, rank in self.rank.items():
            self.token[rank] = token
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(rank)
        self.merges = Merges(np.array(left), np.array(right), np.array(ranks), np.arange(size), size)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.decimal = [str(i).encode() for i in range(size)]
        self.matches = regex.compile(pattern).findall
        self.spaced = pattern == PATTERN
        self.parts = WordCache(self._merged, limit)
        self.words = WordCache(self._split, limit)

    def _merged(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of matches; a match that is a token is that token."""
        data = {p: p.encode() for p in parts}
        whole = {p: np.array([self.rank[d]], "<u4").tobytes() for p, d in data.items() if d in self.rank}
        rest = {d: p for p, d in data.items() if p not in whole}
        found = merge_all(list(rest), lambda some, _: self.byte[some], self.merges)
        return whole | {rest[d]: ids for d, ids in found.items()}

    def _split(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words, by their matches."""
        matches = {}
        for word in words:
            if not self.spaced or (word[0] == " " and word[1:].isalpha()):
                matches[word] = (word,)
            elif word[0] == " " and word[-1] in ENDS and word[1:-1].isalpha():
                matches[word] = (word[:-1], word[-1])
            else:
                matches[word] = self.matches(word)
        ids = self.parts.holding({m for ms in matches.values() for m in ms})
        return {w: ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms]) for w, ms in matches.items()}

    def _words(self, text: str) -> list[str]:
        """Pieces of a text that may be encoded one by one.

        Where no two white-space characters meet, the pattern never matches across the start of a space: the
        words with their leading space are such pieces. Otherwise the text is cut only at spaces between two
        other characters, which the same holds for. Of any other pattern than PATTERN the pieces are the matches.
        """
        if not self.spaced:
            return self.matches(text)
        first, *rest = SINGLE.split(text) if DOUBLED.search(text) else text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts are worked off in groups of bounded length, an overlong one by itself."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) <= CHARS_AT_ONCE):
                chars += len(texts[at])
                group.append(self._words(texts[at]))
                at += 1
            ids = self.words.holding(set().union(*group)).__getitem__
            for words in group:
                yield np.frombuffer(b"".join(map(ids, words)), "<u4")

    def forget(self) -> None:
        """Drop most of the caches: workers outlive their tasks, and the next may be another operator's."""
        self.parts.clear(KEPT_WORDS)
        self.words.clear(KEPT_WORDS)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as file:
            _LOADED[path, pattern] = Codec(file.read().splitlines(), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array column ``ids``; null texts have no ids. A column of that name is replaced."""
    schema = docs.drop(ids).withColumn(ids, F.array().cast("array<int>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = pa.array((x.tolist() for x in own.encode_batch([t or "" for t in batch[text].to_pylist()])), pa.list_(pa.int32()))
            kept = [name for name in batch.schema.names if name != ids]
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in kept), found], [*kept, ids])
        own.forget()

    return docs.mapInArrow(work, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add the binary column ``data`` with the bytes of ``ids``; null ids have none."""
    schema = docs.drop(data).withColumn(data, F.lit(b"")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = pa.array([own.decode(i or []) for i in batch[ids].to_pylist()], pa.binary())
            kept = [name for name in batch.schema.names if name != data]
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in kept), found], [*kept, data])

    return docs.mapInArrow(work, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode what was encoded.

    Ids stay in the task that made them; null and empty texts have no tokens. Repeated rows give repeated rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, told, back = [], [], []
            for found in own.encode_batch([t or "" for t in batch["text"].to_pylist()]):
                ids = found.tolist()
                counts.append(len(ids))
                told.append(hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
