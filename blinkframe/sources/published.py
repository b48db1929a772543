"""Published tables that keep their generation for as long as their content stays the same, across runs and sessions.

A table is a folder with the rows of its generations and a manifest, one row a generation. Rows are written first and
named in the manifest last, so a run that ends between the two leaves a folder that nobody reads. One run at a time may
publish to a folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from blinkframe.sources.shared import children, remove

MANIFEST = "generation long, path string, columns string, n_rows long, first decimal(38,0), second decimal(38,0)"
PLAIN = ("array", "map", "struct", "variant")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def content(rows: DataFrame) -> DataFrame:
    """One row: columns, n_rows and two sums of row hashes, equal for equal rows in whatever order and partitions.

    A null differs from every value and from a null elsewhere; repeated rows count. An empty table has sums of 0.
    """
    parts: list[Column] = []
    for name, kind in rows.dtypes:
        one = _quoted(name)
        if kind.startswith(PLAIN):
            one = F.to_json(F.struct(one.alias("v")), {"ignoreNullFields": "false"})
        parts += [one.isNull(), one]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n_rows"), total(1).alias("first"), total(2).alias("second")).select(F.lit(rows.schema.simpleString()).alias("columns"), "n_rows", "first", "second")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """generation, path, columns, n_rows, first, second of every generation; no rows if nothing was published."""
    if not children(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _newest(spark: SparkSession, folder: str, generation: int | None = None) -> Row | None:
    known = manifest(spark, folder)
    return (known if generation is None else known.filter(F.col("generation") == generation)).orderBy(F.desc("generation")).first()


def publish(rows: DataFrame, folder: str) -> int:
    """Publish ``rows`` and return their generation: that of the table as it is if the content is the same, else the next.

    The content is told from what was written, so a lineage that is computed again can't give another. Column names, types
    and their order belong to the content.
    """
    spark = rows.sparkSession
    path = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{path}")
    found, before = content(spark.read.parquet(f"{folder}/{path}")).first(), _newest(spark, folder)
    if before is not None and tuple(found) == (before.columns, before.n_rows, before["first"], before.second):
        remove(spark, f"{folder}/{path}")
        return before.generation
    generation = before.generation + 1 if before else 1
    spark.createDataFrame([(generation, path, *found)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return generation


def read(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """Rows of a generation, by default the newest. An unknown generation, or none at all, is an error."""
    found = _newest(spark, folder, generation)
    if found is None:
        raise ValueError(f"{folder} has no generation{'' if generation is None else f' {generation}'}")
    return spark.read.parquet(f"{folder}/{found.path}")


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Remove the rows of all but the newest ``keep`` generations, and folders that no generation names; generations stay counted.

    Returns the generations that can still be read. Whoever reads an older one at that time loses it.
    """
    kept = manifest(spark, folder).orderBy(F.desc("generation")).limit(keep).collect()
    names = {r.path.removeprefix("data/") for r in kept}
    for name in children(spark, f"{folder}/data"):
        if name not in names:
            remove(spark, f"{folder}/data/{name}")
    return sorted(r.generation for r in kept)
