"""Fill-in-middle, token counts and phrase mining on small fixtures, against plain forms and the library."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blinkframe.llm import fill_in_middle as fim
from blinkframe.llm import phrases, queries, token_counts, transducer

FOLDER = "/root/testdata/sf0.001"


# Fill-in-middle.


def plain_form(text, key):
    told = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab<PSM> \né日😀", max_size=60), key=st.integers(0, 10_000))
def test_cuts_as_by_code_points(text, key):
    made = fim.transform(text.encode(), str(key))
    assert (made.n, made.form, made.prefix, made.middle, made.output.decode()) == plain_form(text, key)
    assert fim.restore(made.output, made.form).decode() == text


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab \t\né", max_size=60), key=st.integers(0, 10_000))
def test_words_and_lines_are_units(text, key):
    words, lines = (re.findall(r"^[ \t\n]+[^ \t\n]*[ \t\n]*|[^ \t\n]+[ \t\n]*", text), text.splitlines(True))
    begins = [0] * bool(text) + [m.start() for m in re.finditer(r"(?<=[ \t\n])[^ \t\n]", text)]
    assert fim.starts(text.encode(), "words").bit_count() == len(begins)
    assert fim.starts(text.encode(), "lines").bit_count() == len(lines) and (words or not text)
    for unit in fim.UNITS:
        made = fim.transform(text.encode(), str(key), fim.Rule(unit=unit))
        assert fim.restore(made.output, made.form).decode() == text


def test_select_finds_every_bit():
    rng = random.Random(3)
    bits = rng.getrandbits(500) | 1 << 499
    assert [fim.select(bits, k) for k in range(bits.bit_count())] == [i for i in range(500) if bits >> i & 1]


def test_long_text_is_cut_whole():
    text = "日本 text " * 300_000
    made = fim.transform(text.encode(), "3")
    assert (made.n, made.output.decode()) == (len(text), plain_form(text, 3)[-1])


def test_fill_in_middle_rows(spark):
    rows = [(1, "abc", 7), (1, "abc", 8), (None, "x", None), (2, None, 1), (3, "", 2), (4, "a<M>b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")  # n clashes with a column that is added
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "fim_text", "n", "form", "prefix_units", "middle_units"]
    for r in got.collect():
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.fim_text) == plain_form(r.text or "", "" if r.doc_id is None else r.doc_id)
    assert got.count() == 6 and fim.fill_in_middle(docs.limit(0)).count() == 0 and fim.digests(docs.limit(0)).count() == 0


# Token counts.


@pytest.fixture(scope="module")
def own():
    return transducer.Compiled(queries.BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.BYTE_TOKENIZER)


ODD = ["", " ", "\n\n", "  a", " \n a", "\ta", "it's we're 're 'rex ''s!'s a'll'll", "x  ", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|>", "-" * 300, " " * 300, "aaaa" * 99, "日本😀 é", "\x00\x00a", "１２ ½Ⅷ", "՘Ᲊ\U000105c0ꟍ x"]


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("abcdest 'rvlm \n\t0189.!é日😀 \x00"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_counts_as_the_library(own, library, text):
    assert own.count([text, *ODD]) == ([len(t.encode()) for t in [text, *ODD]], [len(library.encode(t, add_special_tokens=False).ids) for t in [text, *ODD]])


def test_blocks_and_small_tables_change_nothing(library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(3000))) for a in ("abcdefgh", " ab'stre \n", "ñé日😀 á", "0123456789", "the and ") for _ in range(8)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(transducer, "BLOCK", 500)
    small = transducer.Compiled(queries.BYTE_TOKENIZER)
    small.counts.most = 3000
    assert small.count(texts)[1] == want
    monkeypatch.setattr(transducer, "BLOCK", 1 << 20)
    assert small.count(texts)[1] == want and small.count(["ab" * 400_000])[1] == [len(library.encode("ab" * 400_000).ids)]


def test_only_known_files_are_compiled():
    with pytest.raises(ValueError):
        transducer.Compiled(queries.WORD_TOKENIZER)


def test_count_rows(spark, library):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 1), (2, "", 2)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, queries.BYTE_TOKENIZER, limit=1)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False)]
    assert token_counts.count_tokens(docs.limit(0), queries.BYTE_TOKENIZER).count() == 0


def test_query_counts_whole_documents(spark, library):
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    told = library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)
    assert len(got) == len(docs)
    for d, t in zip(docs, told, strict=True):
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (len(t.ids), len((d.text or "").encode()), len(t.ids) > 512)


# Phrases.


def mined_plainly(rows, least, longest, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) >= 2}
    most = Counter()
    for (lang, p), a in cand.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                most[lang, p[i : i + size]] = max(most[lang, p[i : i + size]], a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * most[lang, p] >= percent * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, nth = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        nth[lang] += 1
        if nth[lang] <= top:
            ranked.append((lang, nth[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def texts_of_few_words(rng, n):
    vocabulary = ["the", "The", "a", "of", "über", "日本", "x\xa0y", "and", "rare", "x1"]
    return ["".join(rng.choices(vocabulary, [9, 2, 7, 6, 3, 2, 2, 5, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("percent", [100, 60])
def test_phrases_as_counted_plainly(spark, percent):
    rng = random.Random(7)
    rows = [(rng.choice(["en", "en", "en", "de", None]), t) for t in texts_of_few_words(rng, 250)] + [("en", None), ("fr", ""), ("en", "the the the the of of the the of")] * 3
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    got = phrases.collocations(docs.repartition(5), least=4, percent=percent, top=40).collect()
    assert sorted(tuple(r) for r in got) == sorted(mined_plainly(rows, 4, 5, percent, 40)) and len(got) > 60
    assert phrases.collocations(docs.limit(0), least=4).count() == 0


def test_hot_pivots_are_dealt_out(monkeypatch):
    """Groups of one occurrence each, in process: sums over all groups are the plain counts."""
    monkeypatch.setattr(phrases, "PER_GROUP", 1)
    rng = random.Random(8)
    texts = texts_of_few_words(rng, 120)
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["en"] * len(some), pa.string()), pa.array(some, pa.string())], ["lang", "text"]) for some in (texts[:50], texts[50:])])
    counted = [b for b in phrases._counts(batches(), 1) if b["block"].null_count == 0]
    sorted_blocks = pa.Table.from_batches(counted).select(["block", "counts"]).sort_by("block").to_batches()
    told = [r for b in phrases._summed(iter(sorted_blocks), 1) for r in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True)]
    made = pa.Table.from_batches(list(phrases._fragments(batches(), phrases.Table(told, 1), 5))).sort_by([("lang", "ascending"), ("pivot", "ascending"), ("salt", "ascending")])
    assert len(set(made["salt"].to_pylist())) > 5
    sums = Counter()
    for b in phrases._mined(iter(made.to_batches()), 1, 5):
        for phrase, n in zip(b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True):
            sums[phrase] += n
    want = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\n]", text.replace("T", "t")):
            words = re.findall(r"[^ \t]+", piece)
            want.update(" ".join(words[i : i + size]) for size in range(2, 6) for i in range(len(words) - size + 1))
    assert sums == want


def test_long_text_is_mined_whole(spark):
    docs = spark.createDataFrame([(0, "one two three " * 100_000, "en")], "doc_id long, text string, lang string")
    got = {r.phrase: r.a for r in phrases.frequencies(docs)[0].collect()}
    assert got["one two"] == 100_000 and got["three one two three one"] == 99_998 and len(got) == 12
