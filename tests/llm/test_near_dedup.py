"""Near-duplicate components against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from blinkframe.llm import near_dedup
from blinkframe.llm.components import components


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    least = {i: i for i, _ in rows if i is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    holders = {}
    for n, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {(a, b) for hs in holders.values() for a in hs for b in hs if a < b}
    for a, b in pairs:
        ia, ib = rows[a][0], rows[b][0]
        if ia is not None and ib is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(ia), root(ib)
            least[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def found(spark, rows, size, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in near_dedup.near_components(df, size=size, percent=percent).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = []
    for group in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.choice([1, 2, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy) if group % 2 else " \n".join(copy).upper()))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "one"), (None, rows[0][1]), (3, rows[3][1]), (4, rows[20][1])]
    got, want = found(spark, rows, 4, 80), brute(rows, 4, 80)
    assert [g for g in got if g not in want] == [w for w in want if w not in got]
    assert got == want


def test_large_buckets_meet_by_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8 * (near_dedup.MEMBER + 55))
    named = spark.range(200).selectExpr("id % 2 AS band", "id AS doc_id", "id AS component", "50 + id % 10 AS n_shingles")
    met = set()
    for same in (True, False):
        sides = {}
        for r in near_dedup._meetings(named, 80, same).collect():
            sides.setdefault((r.band, r.i, r.j), ([], []))[r.side].append(r.doc_id)
        assert max(len(d) for own in sides.values() for d in own) <= 24
        met |= {(min(u, v), max(u, v)) for own, other in sides.values() for u in own for v in (own if same else other) if u != v}
    assert met == {(u, v) for u in range(200) for v in range(u + 2, 200, 2)}
    # A template family: all share most of their words, few are near each other.
    rng = random.Random(5)
    common = [f"c{i}" for i in range(80)]
    rows = []
    for group in range(12):
        base = common + [f"g{group}x{i}" for i in range(24)]
        rows += [(len(rows) + i, " ".join([*base, *(f"u{group}y{i}z{k}" for k in range(rng.randint(0, 9)))])) for i in range(3)]
    assert found(spark, rows, 4, 80) == brute(rows, 4, 80)


def family(n, words=400, changed=7, seed=3):
    """Texts that are alike to about 0.75, some of them nearer."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), changed if i % 10 else 3):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    return rows


def test_links_of_a_family_grow_with_its_size(spark, monkeypatch):
    given = []
    plain = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: given.append(plain(*a).cache()) or given[-1])
    for n in (150, 300):
        given.clear()
        rows = family(n)
        assert found(spark, rows, 4, 80) == brute(rows, 4, 80)
        assert sum(d.count() for d in given) <= 40 * n
    # Cut into many blocks, with more first members and blocks that meet others, the components are the same.
    monkeypatch.setattr(near_dedup, "BLOCK", 20 * (near_dedup.MEMBER + 400))
    monkeypatch.setattr(near_dedup, "FOLLOWERS", 16)
    assert found(spark, rows, 4, 80) == brute(rows, 4, 80)


def test_common_counts():
    rng = np.random.default_rng(1)
    for m, n, values, most in ((3, 5, 50, 20), (40, 70, 300, 100), (120, 90, 40_000, 200), (1, 1, 10, 4)):
        x, y = ([rng.choice(values, rng.integers(0, most), replace=False).astype(np.uint64) for _ in range(k)] for k in (m, n))
        assert (near_dedup.common_counts(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_clashing_columns_and_long_texts(spark):
    text = " ".join(f"word{i % 5000}x{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text, 1, 0), (2, text + " end", 2, 0), (3, "short text", 3, 0)], "doc_id long, text string, _kept_id int, component_id int")
    assert sorted(r._kept_id for r in near_dedup.near_dedup(df).collect()) == [1, 3]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_dedup.near_components(docs, size=4).collect()), key=str)
    assert got == brute(rows, 4, 80)


def test_rows_and_empty_table(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(9, text, 1), (4, text + " end", 2), (7, "other text of few words", 3)], "doc_id long, text string, kept int")
    assert sorted((r.doc_id, r.kept) for r in near_dedup.near_dedup(df).collect()) == [(4, 2), (7, 3)]
    assert near_dedup.near_components(df.filter(F.lit(False))).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)] + [(100, 100), (101, 100)]
    links = spark.createDataFrame(path + star, "u long, v long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_buckets_of_equal_members_are_one(spark):
    """Near copies share many bands: of buckets with the same texts only the first goes on, and every link is still found."""
    rng = random.Random(8)
    rows = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(100)]
        for copy in range(3):
            words = list(base)
            words[rng.randrange(100)] = f"x{group}y{copy}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1, rows[60][1] + " more"), (2, rows[60][1] + " less")]  # other texts of ids that have one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = near_dedup.signatures(docs, 4).select("doc_id", "n_shingles", "set_a", "bands", "sketch")
    sets, known = {}, {}
    for r in reps.collect():
        for place, band in enumerate(r.bands):
            assert band % near_dedup.PLACES == place
            sets.setdefault(band, set()).add((r.doc_id, r.n_shingles, r.set_a & 0xFFFFFF))
    for band, own in sets.items():
        if len(own) > 1:
            known[frozenset(own)] = min(known.get(frozenset(own), near_dedup.PLACES), band % near_dedup.PLACES)
    got = {}
    for r in near_dedup._buckets(reps).collect():
        got.setdefault(r.band, []).append(r)
        assert r.n == len(sets[r.band]) and r.first == min(d for d, *_ in sets[r.band])
    assert sorted(band % near_dedup.PLACES for band in got) == sorted(known.values())
    assert {frozenset(sets[band]) for band in got} == set(known) and all(len(got[band]) == len(sets[band]) for band in got)
    assert 2 * len(got) < sum(len(own) > 1 for own in sets.values())
    assert found(spark, rows, 4, 80) == brute(rows, 4, 80)


def test_finished_components_take_no_round(spark, monkeypatch):
    """Stars are final: they are told by one look, without another round of joins."""
    made, plain = [], components.__globals__["_small"]
    monkeypatch.setitem(components.__globals__, "_small", lambda links: made.append(1) or plain(links))
    stars = [(9, 1), (8, 1), (7, 2), (2, 6), (2, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {(1, 1), (8, 1), (9, 1), (2, 2), (6, 2), (7, 2)} and not made
    got = {tuple(r) for r in components(spark.createDataFrame([*stars, (9, 7)], "u long, v long")).collect()}
    assert got == {(i, 1) for i in (1, 2, 6, 7, 8, 9)} and made
