"""Token counts of texts by the compiled transducers of :mod:`blinkframe.llm.transducer`."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.transducer import BLOCK, compiled

LIMIT = 512
ADDED = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}


def _counted(own, column: pa.Array) -> tuple[list[int], list[int]]:
    """Bytes and tokens of a column of texts, as many at once as a block holds."""
    sizes: list[int] = []
    counts: list[int] = []
    held: list[str] = []
    chars = 0
    for text in column:
        held.append(text.as_py() or "")
        chars += len(held[-1])
        if chars >= BLOCK:
            for made, more in zip((sizes, counts), own.count(held), strict=True):
                made.extend(more)
            held, chars = [], 0
    for made, more in zip((sizes, counts), own.count(held), strict=True):
        made.extend(more)
    return sizes, counts


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) to every row.

    Counts are those of the tokenizer file at ``path``, which every worker has to reach, without tokens that it would add;
    special strings inside texts are special tokens. A null or empty text has none. Rows are taken one by one, repeated
    ones too; columns that have a name of the new ones are replaced; an empty table gives an empty one. A text is worked
    off in blocks, whatever its length.
    """
    source = "_text" if text in ADDED else text
    rows = docs.withColumnRenamed(text, source) if source != text else docs
    rows = rows.drop(*ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_bytes long, n_tokens long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(path)
        for batch in batches:
            sizes, counts = _counted(own, batch[source])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [*batch.schema.names, "n_bytes", "n_tokens"])

    found = rows.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return found.drop(source) if source != text else found
