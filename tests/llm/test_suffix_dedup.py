"""Repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blinkframe.llm import suffix_dedup


def brute(rows, length):
    """Digest of every row: a window counts if a smaller id has it anywhere; None is above every id."""
    big = 1 << 62
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, big), big if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (big if doc_id is None else doc_id):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(data) else 0
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(spark, rows, length, **other):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in suffix_dedup.repeat_digests(df, length=length, **other).collect()), key=str)


def made(seed, n, short):
    rng = random.Random(seed)
    words = ["ab", "the", "é", "tion", "xyzzy", "of", "中", "a"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(passages)[rng.randint(0, 30) : rng.randint(60, 110)] if rng.random() < 0.4 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, short))) for _ in range(rng.randint(0, 5)))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (None, rows[3][1] + "tail of a row without an id"), (5, rows[5][1]), (5, rows[7][1]), (n + 2, rows[0][1]), (n + 3, rows[0][1]), (n + 4, "q" * 400), (n + 5, "q" * 300)]
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 20), (3, 33)])
def test_against_brute_force(spark, seed, length):
    rows = made(seed, 60, 60)
    assert digests(spark, rows, length) == brute(rows, length)


@pytest.mark.parametrize(("seed", "length", "hot"), [(4, 50, 2), (5, 21, 3), (6, 16, 0)])
def test_windows_of_hot_anchors_are_dealt_one_by_one(spark, seed, length, hot):
    rows = made(seed, 60, 60)
    assert digests(spark, rows, length, hot_texts=hot) == brute(rows, length)


def test_periodic_texts(spark):
    line = "Is on he. "
    rows = [(i, "x" * (i % 3) + line * (4 + i % 9) + f"own words of {i} " * 5 + line * 7) for i in range(30)] + [(40, "ab" * 90), (41, "c" + "ab" * 60 + "d" * 60)]
    for hot in (2, 1000):
        assert digests(spark, rows, 50, hot_texts=hot) == brute(rows, 50)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert digests(spark, rows, 50) == brute(rows, 50)


def test_streamed_in_small_chunks(monkeypatch):
    """A hot anchor is cut over many chunks: distinct runs seen so far are carried on."""
    import pyarrow as pa

    rng = random.Random(5)
    base = [[bytes(rng.choice(letters) for _ in range(70)) for _ in range(4)] for letters in (b"abcd", b"efgh", b"ijkl")]
    rows = sorted((anchor, rng.randint(0, 40), base[anchor][rng.randint(0, 3)][rng.randint(0, 9) :]) for anchor in range(3) for _ in range(60))
    batches = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([d]), pa.array([d]), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), pa.array([c], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], ["anchor", "doc_id", "uid", "start", "more", "content", "uids", "counts"]) for a, d, c in rows]

    def lost(at_once):
        monkeypatch.setattr(suffix_dedup, "RUNS_AT_ONCE", at_once)
        found = {}
        for batch in suffix_dedup._unpacked(suffix_dedup._sorted_runs(iter(batches), 50, 5), 3):
            for r in batch.to_pylist():
                gone = found.setdefault(r["uid"], np.zeros(80, bool))
                for _, a, b in np.frombuffer(r["rows"], np.int64).reshape(-1, 3):
                    gone[a:b] = True
        return {d: g.tobytes() for d, g in found.items()}

    assert lost(10**6) == lost(7) == lost(1)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_long_texts_in_parts(spark, monkeypatch, hot):
    """Texts much longer than a slice, cut in the middle of shared passages, and many copies of one."""
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(60, 400))) for _ in range(8)]
    long = ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("fghij ") for _ in range(80)) for _ in range(30)) for _ in range(4)]
    rows = [(i, text) for i, text in enumerate([*long, long[0][:3000], long[1], long[1], "z" * 3000, "yy" * 900 + "z" * 120])]
    texts = [text.encode() for _, text in rows]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for most in (1, 37, 256, 5000):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", most)
        seen = [low + i for a, b, low, high in suffix_dedup._parts(bounds, 50) for t in range(a, b) for i in range(max(bounds[t], low) - low, min(bounds[t + 1], high) - low - 49)]
        assert seen == [i for t in range(len(texts)) for i in range(bounds[t], bounds[t + 1] - 49)]
    whole = suffix_dedup.runs(data, bounds, 50)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 256)
    cut = [(a + r, low + s, n, h) for a, b, low, high in suffix_dedup._parts(bounds, 50) for r, s, n, h in zip(*suffix_dedup.runs(data[low:high], np.clip(bounds[a : b + 1], low, high) - low, 50), strict=True)]
    named = lambda found: {s + i: h for _, s, n, h in found for i in range(n)}
    assert named(cut) == named(zip(*whole, strict=True))
    # Workers import the module anew: the parts of a batch are taken here, with both kinds of anchors.
    import pyarrow as pa

    part, rest = suffix_dedup._codes(whole[3], 5)
    code = rest.astype(np.uint64) * np.uint64(5) + part.astype(np.uint64)
    own = [np.unique(code[whole[0] == t]) for t in range(len(texts))]
    marks = suffix_dedup.HOT if hot == 1 else np.uint64(0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(100, 100 + len(texts))), pa.array([t.decode() for t in texts]), pa.array([(o | marks).tobytes() for o in own])], ["doc_id", "uid", "text", "rows"])

    def sent(most):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", most)
        monkeypatch.setattr(suffix_dedup, "COPIED_BYTES", most)
        runs = pa.Table.from_batches(list(suffix_dedup._shared_runs(iter([batch]), 50, 5)))
        plain = runs.filter(pa.compute.is_null(runs["uids"]))
        ordered = plain.sort_by([("anchor", "ascending"), ("doc_id", "ascending")]).to_batches() + runs.filter(pa.compute.is_valid(runs["uids"])).to_batches()
        gone = {t: np.zeros(len(x) + 1, bool) for t, x in enumerate(texts)}
        for spans in suffix_dedup._unpacked(suffix_dedup._sorted_runs(iter(ordered), 50, 5), 3):
            for r in spans.to_pylist():
                for doc, x, y in np.frombuffer(r["rows"], np.int64).reshape(-1, 3):
                    gone[doc][x:y] = True
        return {t: g[:-1].tobytes() for t, g in gone.items()}

    want = {}
    first = {}
    for t, x in enumerate(texts):
        want[t] = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 49):
            if first.setdefault(x[i : i + 50], t) < t:
                want[t][i : i + 50] = True
    want = {t: g[:-1].tobytes() for t, g in want.items()}
    assert sent(1 << 18) == want
    assert sent(300) == want


def test_many_copies_and_parts_by_size(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SALTS", 3)
    passage = "a passage of far more than fifty bytes that all of the copies share, word by word "
    rows = [(i, passage * 2) for i in range(40)] + [(7, passage * 2)] * 5 + [(50 + i, f"own {i} " + passage) for i in range(10)] + [(None, passage * 2)]
    assert digests(spark, rows, 50) == brute(rows, 50)


def whole_characters(rows, length):
    """Texts without every character that loses a byte."""
    first = {}
    for doc_id, text in rows:
        data = text.encode()
        for i in range(len(data) - length + 1):
            first[data[i : i + length]] = min(first.get(data[i : i + length], doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = True
        ends = np.cumsum([len(c.encode()) for c in text]).tolist()
        out[doc_id] = "".join(c for c, a, b in zip(text, [0, *ends], ends, strict=False) if not gone[a:b].any())
    return out


def test_no_character_is_made_up_where_bytes_are_cut(spark):
    rng = random.Random(4)
    same = "p" * 60
    rows = [(1, "é" + same + "é"), (2, "©" + same + "ê"), (3, "中" + same + "丮"), (4, "丁" + same + "也")]
    passages = ["".join(rng.choice("éê©ªæ中丮也a") for _ in range(40)) for _ in range(4)]
    rows += [(i, "".join(rng.choice("éê©ª中丮") + rng.choice(passages)[rng.randint(0, 6) :] for _ in range(3))) for i in range(5, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()} == whole_characters(rows, 50)


def test_rows_with_extra_columns_and_empty_table(spark):
    passage = "a passage of more than fifty bytes that two of the documents share in full "
    df = spark.createDataFrame([(1, passage + "one", "x", 1), (2, "two " + passage, "y", 2), (3, None, None, 3)], "doc_id long, text string, payload string, lost int")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert out[1].text == passage + "one" and out[2].text == "two " and out[3].text is None
    assert out[2].payload == "y" and out[2].lost == 2
    assert suffix_dedup.repeat_digests(df.filter(F.lit(False))).count() == 0
