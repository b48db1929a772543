"""Fill-in-middle transformation by big-integer bit-parallelism.

The UTF-8 bytes of a text become masks, one bit a byte, as Python's big integers: ``bytes.translate`` marks the bytes of a
class, shifted boolean operations tell where units start and where a mark stands, ``bit_count`` gives the number of units,
and a ranked start is found by halving the mask again and again. Time and memory are linear in the text, whole texts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNITS = ("chars", "words", "lines")


def _class(members: bytes) -> bytes:
    """Translation table: '1' for the bytes of a class, '0' for all others."""
    return bytes(49 if b in members else 48 for b in range(256))


INNER = _class(bytes(range(0x80, 0xC0)))
SPACE = _class(b"\t\n\x0b\x0c\r ")
NEWLINE = _class(b"\n")
OPENING, CLOSING, LETTER = _class(b"<"), _class(b">"), _class(b"PSM")


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set where byte i belongs to the class."""
    return int(data.translate(table)[::-1] or b"0", 2)


def starts(data: bytes, unit: str = "chars") -> int:
    """Bits of the bytes at which a unit starts; the first byte starts one.

    A unit is a code point, a word with the (ASCII) white space after it, or a line with its line feed.
    """
    whole = (1 << len(data)) - 1
    if unit == "chars":
        ends = whole & ~(mask(data, INNER) >> 1)  # the byte after it doesn't go on with the code point
        return (ends << 1 | 1) & whole
    if unit == "words":
        space = mask(data, SPACE)
        return (whole & ~space & (space << 1)) | (1 & whole)
    if unit == "lines":
        return (mask(data, NEWLINE) << 1 | 1) & whole
    raise ValueError(f"unit is one of {', '.join(UNITS)}")


def marked(data: bytes) -> bool:
    """Whether one of the three marks stands in the text."""
    return mask(data, OPENING) & mask(data, LETTER) >> 1 & mask(data, CLOSING) >> 2 != 0


def select(bits: int, rank: int) -> int:
    """Place of the set bit that ``rank`` others precede; each halving drops the half without it."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, at, rank = bits >> half, width - half, at + half, rank - below
    return at


@dataclass(frozen=True)
class Cut:
    """A transformed text: units in all, its form, units of prefix and middle (none if plain), and the output."""

    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: bytes


@dataclass(frozen=True)
class Rule:
    """Chances in per cent, the seed of the digest that decides, and the unit that texts are cut by."""

    seed: int = 1
    moved: int = 90
    spm: int = 20
    unit: str = "chars"


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and key."""
    told = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(data: bytes, key: str, rule: Rule = Rule()) -> Cut:
    """Cut and rearrange one text; empty and marked texts stay plain."""
    at = starts(data, rule.unit)
    n = at.bit_count()
    first, second, whether, which = draws(key, rule.seed)
    if not data or marked(data) or whether % 100 >= rule.moved:
        return Cut(n, "plain", None, None, data)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (select(at, k) if k < n else len(data) for k in (low, high))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if which % 100 < rule.spm:
        return Cut(n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Cut(n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def restore(output: bytes, form: str) -> bytes:
    """The text, from an output and its form: parts hold no mark, so that each mark stands once."""
    if form == "plain":
        return output
    opened, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(opened).split(between)
    other, middle = rest.split(MIDDLE)
    return one + middle + other if form == "psm" else other + middle + one


ADDED = {"fim_text": "string", "n": "long", "form": "string", "prefix_units": "long", "middle_units": "long"}


def _cuts(batch: pa.RecordBatch, key: str, text: str, rule: Rule) -> Iterator[Cut]:
    for k, t in zip(batch[key], batch[text], strict=True):
        yield transform((t.as_py() or "").encode(), "" if (own := k.as_py()) is None else str(own), rule)


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add fim_text, n, form, prefix_units and middle_units to every row.

    Rows are taken one by one, so repeated rows give repeated rows and equal keys the same draws. A null text counts as
    empty and gives an empty plain output; a null key counts as an empty one. Columns that have a name of the new ones are
    replaced, all others stay. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ADDED or c in (key, text)]
    clash = {c: f"_own_{c}" for c in (key, text) if c in ADDED}  # a text column of that name is read before it is replaced
    rows = docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in kept])
    own_key, own_text = clash.get(key, key), clash.get(text, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {kind}" for c, kind in ADDED.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                cuts = list(_cuts(part, own_key, own_text, rule))
                made = [
                    pa.array([c.output.decode() for c in cuts], pa.string()), pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()),
                    pa.array([c.prefix for c in cuts], pa.int64()), pa.array([c.middle for c in cuts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *ADDED])

    return rows.mapInArrow(work, schema).drop(*clash.values())


def digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document.

    Outputs stay in the task that made them; each is read back by its form. Nulls and repeats as in :func:`fill_in_middle`.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = [(c.n, c.form, c.prefix, c.middle, told(c.output), told(restore(c.output, c.form))) for c in _cuts(batch, "doc_id", "text", rule)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def duckdb_sql(seed: int = 1) -> str:
    """The query's rows as DuckDB SQL."""
    draw = lambda k: f"('0x' || substr(told, {8 * k + 1}, 8))::BIGINT"
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS told FROM documents),
        drawn AS (SELECT *, length(text)::BIGINT AS n, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM docs),
        cut AS (
          SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM drawn
        ), parts AS (SELECT *, substr(text, 1, low) AS a, substr(text, low + 1, high - low) AS b, substr(text, high + 1, n - high) AS c FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """
