"""Exact deduplication by Grace hashing.

Two steps, one shuffle of text:

* every Arrow batch is first combined where it is read: equal texts of a batch become one record with the
  list of their ids, so a group that holds a third of all rows travels as one copy a batch;
* records are dealt by a 64-bit hash; a task then builds an open-addressing table that compares complete
  texts. Records beyond ``memory_bytes`` are partitioned to spill files by the next four bits of the hash,
  and each file is worked off the same way. A file whose records all share one hash can't be split any
  further: it is read twice, and only its distinct texts are held.

Spill files belong to a task and are gone when it ends, so a lost executor costs a retry of its tasks only.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY_BYTES = 96 << 20
FANOUT_BITS = 4

Record = tuple[int, bytes, list, object]


class ContentTable:
    """Open addressing with linear probing; two entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, key: int, content: bytes) -> int:
        """Number of the entry with this content, made if it is new."""
        at = key & self.mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == key and self.contents[found] == content:
                return found
            at = (at + 1) & self.mask
        self.slots[at] = new = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        if 3 * new > 2 * self.mask:
            self._grow()
        return new

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for number, key in enumerate(self.hashes):
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = number


def _order(key: object) -> tuple:
    """Null sorts below every id."""
    return (key is not None, key)


class _Groups:
    """Distinct contents with the count of their rows and the record that holds the largest id."""

    def __init__(self) -> None:
        self.table = ContentTable()
        self.size: list[int] = []
        self.best: list[tuple] = []
        self.holder: list[int] = []

    def add(self, number: int, record: Record) -> int:
        key, content, ids, _ = record
        entry = self.table.entry(key, content)
        top = _order(ids[0])
        if entry == len(self.size):
            self.size.append(len(ids))
            self.best.append(top)
            self.holder.append(number)
        else:
            self.size[entry] += len(ids)
            if top > self.best[entry]:
                self.best[entry], self.holder[entry] = top, number
        return entry


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def grace_groups(records: Iterable[Record], memory_bytes: int, folder: str, level: int = 0) -> Iterator[tuple]:
    """Yield (record, largest id, rows in its group, does it hold the row that stays) for every record."""
    held: list[Record] = []
    used = 0
    records = iter(records)
    for record in records:
        held.append(record)
        used += len(record[1]) + 8 * len(record[2]) + 300
        if used > memory_bytes:
            break
    else:
        groups = _Groups()
        entries = [groups.add(number, record) for number, record in enumerate(held)]
        for number, (record, entry) in enumerate(zip(held, entries, strict=True)):
            yield record, groups.best[entry][1], groups.size[entry], groups.holder[entry] == number
        return

    shift = FANOUT_BITS * level
    files: dict[int, object] = {}
    span: dict[int, list[int]] = {}
    for part in (held, records):
        for record in part:
            key = record[0]
            bucket = (key >> shift) & ((1 << FANOUT_BITS) - 1)
            if bucket not in files:
                files[bucket] = open(os.path.join(folder, f"{level}-{bucket}"), "wb")
                span[bucket] = [key, key]
            pickle.dump(record, files[bucket], pickle.HIGHEST_PROTOCOL)
            span[bucket] = [min(span[bucket][0], key), max(span[bucket][1], key)]
        held.clear()
    for file in files.values():
        file.close()
    for bucket in sorted(files):
        path = os.path.join(folder, f"{level}-{bucket}")
        low, high = span[bucket]
        if low == high or shift + FANOUT_BITS >= 64:
            groups = _Groups()
            for number, record in enumerate(_read(path)):
                groups.add(number, record)
            for number, record in enumerate(_read(path)):
                entry = groups.table.entry(record[0], record[1])
                yield record, groups.best[entry][1], groups.size[entry], groups.holder[entry] == number
        else:
            below = os.path.join(folder, f"{level}-{bucket}.d")
            os.mkdir(below)
            yield from grace_groups(_read(path), memory_bytes, below, level + 1)
            shutil.rmtree(below)
        os.remove(path)


def _combined(batch: pa.RecordBatch, normalize: Callable[[str], str] | None) -> Iterator[Record]:
    """One record for each distinct text of a batch; ids in falling order, the payload of the first id."""
    table = ContentTable()
    members: list[list[int]] = []
    ids, payloads = batch["id"].to_pylist(), batch["payload"]
    for row, text in enumerate(batch["content"].to_pylist()):
        text = text or ""
        content = (normalize(text) if normalize else text).encode()
        entry = table.entry(xxhash.xxh3_64_intdigest(content), content)
        if entry == len(members):
            members.append([])
        members[entry].append(row)
    for key, content, rows in zip(table.hashes, table.contents, members, strict=True):
        rows.sort(key=lambda r: _order(ids[r]), reverse=True)
        yield key, content, [ids[r] for r in rows], payloads[rows[0]].as_py()


def _dealt(docs: DataFrame, key: str, text: str, normalize: Callable[[str], str] | None, payload) -> DataFrame:
    """Records of every batch, dealt by hash."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("content"), payload.alias("payload"))
    kinds = rows.schema
    schema = T.StructType([
        T.StructField("hash", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("ids", T.ArrayType(kinds["id"].dataType)),
        T.StructField("payload", kinds["payload"].dataType),
    ])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(_combined(batch, normalize))
            id_type = pa.list_(batch.schema.field("id").type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k - (1 << 64) if k >> 63 else k for k, *_ in out], pa.int64()),
                    pa.array([content for _, content, *_ in out], pa.binary()),
                    pa.array([ids for _, _, ids, _ in out], id_type),
                    pa.array([p for *_, p in out], batch.schema.field("payload").type),
                ],
                ["hash", "content", "ids", "payload"],
            )

    return rows.mapInArrow(combine, schema).repartition("hash")


def _worked_off(batches: Iterator[pa.RecordBatch], memory_bytes: int) -> Iterator[tuple]:
    def records() -> Iterator[Record]:
        for batch in batches:
            columns = [batch["hash"].to_pylist(), batch["content"].to_pylist(), batch["ids"].to_pylist(), batch["payload"].to_pylist()]
            for key, content, ids, payload in zip(*columns, strict=True):
                yield key & 0xFFFFFFFFFFFFFFFF, content, ids, payload

    folder = tempfile.mkdtemp(prefix="grace-")
    try:
        yield from grace_groups(records(), memory_bytes, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _in_batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalize: Callable[[str], str] | None = None,
    memory_bytes: int = MEMORY_BYTES,
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalize`` (default: no change). The row with the largest key of a
    group stays. Null text counts as empty; a null key is below every other; of rows that repeat the largest
    key exactly one stays. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(key_type)),
        T.StructField("keep_id", key_type),
        T.StructField("group_size", T.LongType()),
        T.StructField("holds", T.BooleanType()),
        T.StructField("text_sha256", T.StringType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (
            {"ids": r[2], "keep_id": keep, "group_size": size, "holds": holds, "text_sha256": hashlib.sha256(r[1]).hexdigest()}
            for r, keep, size, holds in _worked_off(batches, memory_bytes)
        )
        yield from _in_batches(rows, to_arrow_schema(schema))

    groups = _dealt(docs, key, text, normalize, F.lit(0)).mapInArrow(work, schema)
    # The ids of one large group leave the task that found it before they become rows.
    members = groups.hint("rebalance").select("keep_id", "group_size", "holds", "text_sha256", F.posexplode("ids").alias("nth", key))
    return members.select(f"`{key}`", "keep_id", "group_size", (F.col("holds") & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalize: Callable[[str], str] | None = None,
    memory_bytes: int = MEMORY_BYTES,
) -> DataFrame:
    """The rows that stay, with all columns of ``docs``; groups and ties as in :func:`exact_groups`.

    The kept row is returned as it was read: a null text stays null.
    """
    schema = docs.schema
    carried = [name for name in docs.columns if name != text or normalize]
    fields = [F.col(f"`{name}`").alias(f"c{n}") for n, name in enumerate(carried)]
    payload = F.struct(*fields, F.col(f"`{text}`").isNull().alias("empty"))

    def row(record: Record) -> dict:
        _, content, _, kept = record
        found = {name: kept[f"c{n}"] for n, name in enumerate(carried)}
        return found if normalize else found | {text: None if kept["empty"] else content.decode()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (row(record) for record, _, _, holds in _worked_off(batches, memory_bytes) if holds)
        yield from _in_batches(rows, to_arrow_schema(schema), 500)

    return _dealt(docs, key, text, normalize, payload).mapInArrow(work, schema)
