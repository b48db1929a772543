"""Quality rules and URL rules on small fixtures, and against their DuckDB SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from blinkframe.llm import queries, quality_rules, url_filter
from blinkframe.llm.url_filter import Rule, domain_rule


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def sql(query, **views):
    con = duckdb.connect()
    for name, rows in views.items():
        con.register(name, rows)
    return con.sql(query).df()


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_url_filter"])
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for view in ("documents", "pages"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, folder).toPandas()
    key = want.columns[0]
    got, want = got[want.columns].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_quality_edges(spark):
    good = "the cat of the house and a dog that is in it was for on with be as are to " * 9
    rows = [(1, None, None, 7), (2, "", "en", 7), (3, "a b a b a b", "xx", 7), (4, "x\n \nx\ny\nx", "en", 7), (None, good, "en", 7), (5, "a" * 100_000, "de", 7), (6, "#$ %x", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, q_kept int")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].kept) == (0, 0, False)
    assert (got[3].n_words, got[3].n_repeat_words, got[3].word_chars) == (6, 6, 6)
    assert got[4].n_dup_lines == 2 and got[6].n_symbols == 3
    assert got[None].n_repeat_words == got[None].n_words and got[None].base_failed
    assert quality_rules.keep_good(df).columns == df.columns
    assert quality_rules.judge(df.filter(F.lit(False))).count() == 0


def test_junk_goes_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    kept = quality_rules.judge(docs).join(docs.select("doc_id", "quality"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in kept.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0
    assert counts[0, False] > 2 * counts[0, True]


def test_url_rules(spark):
    urls = [
        "http://Example.NET/en/x", "https://a.example.net/en/", "https://a.example.net/de/", "http://example.com/de/1", "http://badexample.com/de/1", "http://x.org/fr/1?q",
        "http://net/", "http://net", "ftp://u.spam-farm.org/x", "no scheme", None, "", "a://b://c/d", "http://x.org/en/viagra", "http://x.org/fr/viagra", "http://x.org#frag/",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = queries.URL_RULES
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got[0] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2] == "net/" and got[7][2] is None
    assert got[8][2:] == (None, "block") and got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("b:", "//c/d", None, "allow") and got[13][3] == "block" and got[14][3] == "allow" and got[15][:2] == ("x.org", "")
    assert sorted(got.items()) == sorted((r.page_id, (r.host, r.path, None if r.rule != r.rule else r.rule, r.verdict)) for r in sql(url_filter.duckdb_sql(rules), pages=df.toPandas()).itertuples())
    assert url_filter.judge(df.filter(F.lit(False)), rules).count() == 0


def test_rule_without_token_and_index(spark):
    rules = [Rule("dots", "block", r"[.][.]", [], False), domain_rule("b.a/", "allow")]
    df = spark.createDataFrame([(1, "http://x..y/"), (2, "http://b.a/"), (3, "http://a/")], "page_id long, url string")
    assert rows_of(url_filter.judge(df, rules), ["page_id", "rule", "verdict"]) == [(1, None, "block"), (2, "b.a/", "allow"), (3, None, "allow")]
    targets = url_filter.parse(df).withColumn("target", F.concat("host", "path"))
    assert dict(url_filter.rule_index(spark, targets, rules).select("name", "token").collect()) == {"dots": "", "b.a/": "b"}


def test_tokens_are_taken_from_patterns():
    assert {r.name: r.tokens for r in url_filter.PATTERNS} == {
        "spam farms": ["spam", "farm"], "pills": ["cheap", "pills"], "casinos": ["casino"], "adult": ["adult", "x"], "xxx": ["xxx"], "porn": ["porn"],
        "viagra": ["viagra"], "payday loans": ["payday"], "warez": ["warez"], "ad servers": ["adserver"],
    }
    for pattern, tokens in {r"casino": [], r"\bab?\b": [], r"\bab\b|\bcd\b": [], r"^Ab[.]c[a-z]": ["ab"], r"\b(?:x|y)-z\b": ["z"], r"[-.]a[.]": [], r"\bx{2}-\dy-\bq$": ["q"], "": []}.items():
        assert url_filter.literal_tokens(pattern) == tokens, pattern


def test_rules_from_a_table_and_capitals_in_paths(spark):
    rules = spark.createDataFrame([tuple(r) for r in queries.URL_RULES], "name string, action string, pattern string, tokens array<string>, domain boolean")
    df = spark.createDataFrame([(1, "http://x.org/en/Viagra"), (2, "http://x.org/EN/fine"), (3, "http://x.org/fr/1")], "page_id long, url string")
    assert rows_of(url_filter.judge(df, rules), ["page_id", "rule", "verdict"]) == [(1, None, "block"), (2, None, "allow"), (3, "org/fr/", "allow")]


def test_rules_of_one_name(spark):
    rules = [url_filter.pattern_rule("gambling", r"\bcasino\b"), url_filter.pattern_rule("gambling", r"\bpoker\b"), url_filter.pattern_rule(None, r"\bslots\b"), url_filter.pattern_rule(None, r"\bdice\b")]
    urls = ["http://a.b/poker", "http://a.b/casino", "http://casino.b/", "http://a.b/slots", "http://a.b/DICE", "http://a.b/pokers", None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == ["block"] * 5 + ["allow"] * 3


def test_a_thousand_rules_against_all_of_them(spark):
    """Random rules, many of one name, each run against every URL in plain Python."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("red", "blue", "shop", "news", "x") for b in range(40)]
    hosts = [f"{rng.choice(words)}.{rng.choice(words)}.{rng.choice(['com', 'net', 'org'])}" for _ in range(60)]
    rules = [domain_rule(f"{rng.choice(hosts)}/{rng.choice(words)}/", rng.choice(["allow", "block"])) for _ in range(300)]
    rules = list({r.name: r for r in rules}.values())
    rules += [url_filter.pattern_rule(f"g{n % 50}", rng.choice([r"\b{}\b", r"^[^/]*\b{}[.]", r"/{}s?/", r"(?:{}|zzz)-"]).format(rng.choice(words))) for n in range(700)]
    urls = [f"http://{rng.choice(hosts).upper() if n % 7 == 0 else rng.choice(hosts)}/{rng.choice(words)}/{rng.choice(words)}{rng.choice(['', '/', '-', 's/', '?q'])}" for n in range(400)] + [None, "x"] * 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    for n, url in enumerate(urls):
        if not url or "://" not in url:
            assert got[n] == (None, "allow")
            continue
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url).groups()
        target = host.lower() + path
        own = [r for r in rules if r.domain and re.search(r.pattern, target)]
        best = max(own, key=lambda r: (len(r.name), r.name), default=None)
        blocked = any(not r.domain and re.search(r.pattern, target.lower()) for r in rules)
        assert got[n] == ((best.name, best.action) if best else (None, "block" if blocked else "allow")), url
