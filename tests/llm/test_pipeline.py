"""The pipeline's stages on planted cases, and whole over the smallest documents."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blinkframe.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was"]
    return " ".join(rng.choice(common) if rng.random() < 0.35 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    texts = {i: prose(rng, 160) for i in range(60)}
    passage = prose(rng, 70)
    texts[100] = texts[0]  # exact copy
    words = texts[1].split()
    words[80] = "changed"
    texts[101] = " ".join(words)  # near copy
    for i in (102, 103):
        texts[i] = prose(rng, 90) + " " + passage + " " + prose(rng, 90)
    texts[104] = "### $$$ " * 200  # junk
    texts[105] = "too short"
    rows = [(i, t, "en", "x", len(t)) for i, t in texts.items()] + [(106, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages_on_planted_cases(spark, planted):
    docs, passage = planted
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        if name != "best-fit packing":
            assert docs.columns == COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(60)) <= set(seen["quality rules"]) and not {104, 105, 106} & set(seen["quality rules"])
    assert 0 not in seen["exact dedup"] and 100 in seen["exact dedup"]
    assert {1, 102, 103} <= set(seen["MinHash near-dedup"]) and 101 not in seen["MinHash near-dedup"]
    cut = seen["suffix-array dedup"]
    assert passage in cut[102] and passage[20:-20] not in cut[103] and cut[5] == seen["MinHash near-dedup"][5]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(cut)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    assert corpus_pipeline.ORACLE_SQL is None


CLASHES = ["uid", "payload", "digest", "salt", "first_id", "lost", "rows", "ids", "hash", "content", "kept", "n_words", "band", "rep", "start", "a.b"]


def test_run_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, prose(rng, 120)), (None, texts[5]), (None, prose(rng, 120)), (None, None), (20, None), (21, ""), (22, texts[6] + " " + texts[7])]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHES)])
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, FOLDER)
        assert seen.columns == docs.columns, name
        seen = seen.cache()
        assert all(r[c] == n for r in seen.collect() for n, c in enumerate(CLASHES))
    found = sorted(r.doc_id for r in seen.collect() if r.doc_id is not None)
    # Equal texts keep the largest id, a null one is the least; a repeated row is one of two equal texts.
    assert set(range(12)) <= set(found) and found.count(3) == 1 and found.count(4) == 2
    assert sum(r.doc_id is None for r in seen.collect()) == 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({(r.doc_id or -1) for r in packed}) == sorted({(-1 if r.doc_id is None else r.doc_id or -1) for r in seen.collect()})


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_last_stage_table_stays(spark):
    from blinkframe.sources.shared import children, shared_folder

    folder = shared_folder(spark)
    before = set(children(spark, folder))
    corpus_pipeline.run(spark, FOLDER).count()
    (made,) = [f for f in set(children(spark, folder)) - before if f.startswith("corpus-")]
    assert children(spark, f"{folder}/{made}") == [str(len(corpus_pipeline.STAGES) - 2)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    # Values as they are: pandas would show whole numbers beside nulls as floats.
    text = lambda rows: sorted("|".join(map(str, r)) for r in rows)
    assert text(got.select(*columns).collect()) == text(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "conversations", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op1_chat_format" else 0)
