"""Tokenizers, packing, exact dedup, chat formatting, HTML and toxicity on small fixtures and against libraries."""

import base64
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blinkframe.llm import byte_bpe, chat_format, exact_dedup, html_render, packing, queries, toxicity
from blinkframe.llm.bpe import merge_one

LETTERS = "abc déß \n\t  '1 2,.!s't 　中😀\x1cİΣ\x00"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(queries.BYTE_RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=LETTERS, max_size=80))
def test_byte_bpe_as_the_library(own, library, text):
    ids = next(own.encode_batch([text])).tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_match_and_trees_agree(own, library):
    text = "ab" * 700 + "é" * 50
    assert next(own.encode_batch([text])).tolist() == library.encode_ordinary(text)
    rng = random.Random(3)
    for _ in range(200):
        part = bytes(rng.choice(b"abcdetion") for _ in range(rng.randint(1, 32)))
        if part not in own.rank:
            assert merge_one([own.rank[part[i : i + 1]] for i in range(len(part))], own.merges) == np.frombuffer(own._merged({part.decode()})[part.decode()], "<u4").tolist()


def test_round_trip_and_columns(spark, library):
    df = spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (None, "", "z"), (1, "the cat", "x")], "doc_id long, text string, ids string")
    rows = byte_bpe.round_trip(df, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert {r.decoded_sha256 for r in rows} == {hashlib.sha256(t).hexdigest() for t in (b"", b"the cat")}
    coded = byte_bpe.encode(df, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert {bytes(r.decoded) for r in back.collect()} == {b"", b"the cat"}


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=LETTERS + "<|endoftext|>ABC", max_size=60))
def test_word_ids_as_the_library(text):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    assert np.frombuffer(next(packing.word_encoder(queries.WORD_TOKENIZER).encode([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "in<|startoftext|>side", "It's<|endoftext|>'s", "<|endoftext|><|startoftext|> 日本 é\x85x<|endoftext|>", "<|EndOfText|> <|endoftext |>", "A <|startoftext|>\n B<|endoftext"]


@pytest.mark.parametrize("text", [*SPECIAL, " ".join(SPECIAL * 50)])
def test_added_tokens_as_the_library(text):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    assert np.frombuffer(next(packing.word_encoder(queries.WORD_TOKENIZER).encode([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_encode_whole_texts():
    own, library = packing.word_encoder(queries.BYTE_TOKENIZER), Tokenizer.from_file(queries.BYTE_TOKENIZER)
    assert not own.known
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(["The Cat  sat", None])] == [library.encode("The Cat  sat").ids, []]


def test_packing(spark):
    df = spark.createDataFrame([(i, "word " * (i * 37 % 5000)) for i in range(120)] + [(200, None), (201, ""), (5, "twice"), (5, "twice")], "doc_id long, text string").withColumn("offset", F.lit(1))
    rows = packing.pack_documents(df, queries.WORD_TOKENIZER).collect()
    total = sum(r.length for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) * 1.03 + 1
    own = [r for r in rows if r.doc_id == 119]
    ids = np.frombuffer(next(packing.word_encoder(queries.WORD_TOKENIZER).encode(["word " * (119 * 37 % 5000)])) + b"\x01\0\0\0", "<u4")
    assert [(r.start, r.length, r.ids_crc32) for r in sorted(own, key=lambda r: r.piece)] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert packing.pack_documents(df.filter(F.lit(False)), queries.WORD_TOKENIZER).count() == 0


def test_packing_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    library.encode_special_tokens = True
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(r.doc_id, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))}
    rows = queries.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) * 1.03 + 1


def test_byte_bpe_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with open(queries.BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.read().splitlines()))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        told = " ".join(map(str, ids)).encode()
        want.add((r.doc_id, len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"[a-m ]+|[^a-m ]+", r"."])
def test_byte_bpe_by_other_patterns(library, pattern):
    text = "the cat, a dog: it's\n  nice, 12 of the  mice."
    other = tiktoken.Encoding("other", pat_str=pattern + r"|\n", mergeable_ranks=library._mergeable_ranks, special_tokens={})
    assert next(byte_bpe.codec(queries.BYTE_RANKS, pattern + r"|\n").encode_batch([text])).tolist() == other.encode_ordinary(text)


def test_a_megabyte_without_a_space(spark):
    text = "abcdé" * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    told = byte_bpe.round_trip(df, queries.BYTE_RANKS, public_tokenizers.PATTERN).first()
    assert told.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    rows = packing.pack_documents(df, queries.WORD_TOKENIZER).collect()
    ids = [*Tokenizer.from_file(queries.WORD_TOKENIZER).encode(text, add_special_tokens=False).ids, 1]
    assert sum(r.length for r in rows) == len(ids)


def test_bounded_space_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third closes bin 2, the fullest
    assert bins.place(2) == (1, 7) and bins.place(4) == (0, 6) and bins.place(1) == (1, 9)


@pytest.mark.parametrize("memory", [1, 2000, 1 << 30])
def test_grace_groups_at_any_memory(tmp_path, memory):
    rng = random.Random(4)
    texts = [b"", b"x" * 500, *(bytes([i]) * i for i in range(1, 60))]
    records = [((hash(t) % 7 if memory == 2000 else rng.getrandbits(8) if False else zlib.crc32(t)), t, sorted((rng.randrange(1000) for _ in range(rng.randint(1, 3))), reverse=True), None) for t in rng.choices(texts, k=400)]
    got = sorted((r[1], tuple(r[2]), keep, size) for r, keep, size, _ in exact_dedup.grace_groups(iter(records), memory, str(tmp_path)))
    want = []
    for _, text, ids, _ in records:
        every = [i for r in records if r[1] == text for i in r[2]]
        want.append((text, tuple(ids), max(every), len(every)))
    assert got == sorted(want)
    holders = [r[1] for r, _, _, holds in exact_dedup.grace_groups(iter(records), memory, str(tmp_path)) if holds]
    assert len(holders) == len(set(holders)) == len({r[1] for r in records})


def test_exact_dedup(spark):
    df = spark.createDataFrame([(1, "a", 1), (3, "a", 2), (2, None, 3), (None, "", 4), (5, "b", 5), (5, "b", 5), (7, "A", 6)], "doc_id long, text string, kept int").repartition(3)
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()))
    assert got == [(0, 2, 2, False), (1, 3, 2, False), (2, 2, 2, True), (3, 3, 2, True), (5, 5, 2, False), (5, 5, 2, True), (7, 7, 1, True)]
    rows = sorted(tuple(r) for r in exact_dedup.exact_dedup(df).collect())
    assert rows == [(2, None, 3), (3, "a", 2), (5, "b", 5), (7, "A", 6)]
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df, normalize=str.lower).collect()) == [2, 5, 7]
    assert exact_dedup.exact_groups(df.filter(F.lit(False))).count() == 0


@settings(max_examples=300, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n<|nl|>", ""]), st.text(alphabet="<|\\im_endstar>\n é", max_size=30)), max_size=6), window=st.integers(2, 5))
def test_chat_spans(turns, window):
    renderer = chat_format.Renderer(chat_format.marked_turns, window)
    spans = [renderer.add(t) for t in turns]
    whole = chat_format.marked_turns(turns)
    assert "".join(s.piece for s in spans) == whole
    for (role, text), s in zip(turns, spans, strict=True):
        assert whole[s.start : s.end] == s.piece and not s.rewrites
        assert list(chat_format.Reader().add(s.piece)) == [(role, text)]
        if s.text_start is not None:
            assert chat_format.unescape(whole[s.text_start : s.text_end]) == text
    # Turns come back whatever the parts in which the output comes.
    reader = chat_format.Reader()
    assert [t for at in range(0, len(whole), window) for t in reader.add(whole[at : at + window])] == turns and not reader.rest


def test_chat_output_that_is_no_turn_fails():
    with pytest.raises(ValueError, match="no turn"):
        list(chat_format.Reader().add("x<|im_start|>user\nhi<|im_end|>\n"))


def test_chat_template_that_rewrites_history():
    latest_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '..'}" for i, (r, t) in enumerate(turns))
    renderer = chat_format.Renderer(latest_only, 64)
    assert [renderer.add(("assistant", t)).rewrites for t in ("one", "two", "three")] == [False, True, True]


def test_chat_long_conversations_get_true_prefixes():
    turns = [("assistant", f"t{i}") for i in range(150)]
    numbered = lambda turns: "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns, 1))
    renderer = chat_format.Renderer(numbered, 64)
    assert "".join(renderer.add(t).piece for t in turns) == numbered(turns)
    header = lambda turns: f"<{len(turns) // 100}>" + "".join(t for _, t in turns)
    renderer = chat_format.Renderer(header, 64)
    spans = [renderer.add(t) for t in turns]
    assert [i for i, s in enumerate(spans) if s.rewrites] == [99] and spans[99].start == 1 and spans[-1].end == len(header(turns))


def test_chat_text_of_private_use_characters_is_located():
    text = "\ue000 said \ue001"
    span = chat_format.Renderer(chat_format.marked_turns, 64).add(("assistant", text))
    assert span.piece[span.text_start : span.text_end] == text


def test_chat_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (2, None, None, "x", 0), (None, 0, "assistant", "y", 0)], "conv_id long, turn long, role string, text string, start int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and (got[1].loss_chars, got[1].n_turns) == (1, 2)
    assert got[2].loss_chars == 0 and got[None].loss_sha256 == hashlib.sha256(b"y").hexdigest()
    long = spark.range(3000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat_format.read_back(chat_format.format_turns(long)).first()
    assert row.n_turns == 3000 and row.loss_sha256 == hashlib.sha256("".join(str(i) for i in range(1, 3000, 2)).encode()).hexdigest()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("one <b>two</b>\n three<br>four", "one two three\nfour"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><th>A<th>Long<tr><td>1<td>two</table>", "A | Long\n1 | two"),
        ("<table><td>a<table><td>n<td>m</table><td>z</table>", "a n | m | z"),
        ("<p hidden>no<p>yes<div style='display:none'><p>no</div><script>a<b</script><style>p{}</style>", "yes"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("a &lt; b &amp; c < d<!-- no --><!doctype x>", "a < b & c < d"),
        ("<div>a</div></div></p>b<", "a\n\nb<"),
        ("text<a href='", "text"),
        ("<select><option>x<option>y</select>", "x\ny"),
        ("", ""),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<svg><title>no</title><text>label</text></svg><math><mi>x</mi><annotation>no</annotation></math>", "labelx"),
        ("<table><tr><td><h1>Title</h1><p>one<p>two<ul><li>a<li>b</ul><td>side<tr><td>x<td>y</table>", "Title\n\none\n\ntwo\n\n- a\n- b\n\nside\n\nx | y"),
        ("<table><tr><td>a<br>b<td>c</table>", "a b | c"),
        ("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>a<td>b</table>", "w" * 60 + " | z\na" + " " * 59 + " | b"),
        ("<table><tr><td colspan=40>a<td>b<tr><td>c" + "<td>" * 39 + "<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=40>a<td>b" + "<tr><td>c" * 39 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 39 + "d | e"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 50 + "</table>", "a | b\n" + "\n".join(["  | c"] * 50)),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td colspan=9>d<tr><td>e<td>f</table>", "a | b | c\n  |   | d\n  | e | f"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3 rowspan=3>d<tr><td>e<tr><td>f<tr><td>g</table>", "a | b | c\nd\n  |   |   | e\n  |   |   | f\ng"),
        ("<ol><li value=9>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>", "9. a\n10. b\n\n3. x\n2. y"),
        ("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>a<td>b</table>", "w" * 60 + " | z\na" + " " * 59 + " | b"),
        ("<table><tr><td colspan=40>a<td>b<tr><td>c" + "<td>" * 39 + "<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=40>a<td>b" + "<tr><td>c" * 39 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 39 + "d | e"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 50 + "</table>", "a | b\n" + "\n".join(["  | c"] * 50)),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td colspan=9>d<tr><td>e<td>f</table>", "a | b | c\n  |   | d\n  | e | f"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3 rowspan=3>d<tr><td>e<tr><td>f<tr><td>g</table>", "a | b | c\nd\n  |   |   | e\n  |   |   | f\ng"),
        ("<ol><li value=9>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>", "9. a\n10. b\n\n3. x\n2. y"),
        ("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>a<td>b</table>", "w" * 60 + " | z\na" + " " * 59 + " | b"),
        ("<table><tr><td colspan=40>a<td>b<tr><td>c" + "<td>" * 39 + "<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=40>a<td>b" + "<tr><td>c" * 39 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 39 + "d | e"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 50 + "</table>", "a | b\n" + "\n".join(["  | c"] * 50)),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td colspan=9>d<tr><td>e<td>f</table>", "a | b | c\n  |   | d\n  | e | f"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3 rowspan=3>d<tr><td>e<tr><td>f<tr><td>g</table>", "a | b | c\nd\n  |   |   | e\n  |   |   | f\ng"),
        ("<ol><li value=9>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>", "9. a\n10. b\n\n3. x\n2. y"),
        ("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>a<td>b</table>", "w" * 60 + " | z\na" + " " * 59 + " | b"),
        ("<table><tr><td colspan=40>a<td>b<tr><td>c" + "<td>" * 39 + "<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=40>a<td>b" + "<tr><td>c" * 39 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 39 + "d | e"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 50 + "</table>", "a | b\n" + "\n".join(["  | c"] * 50)),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td colspan=9>d<tr><td>e<td>f</table>", "a | b | c\n  |   | d\n  | e | f"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3 rowspan=3>d<tr><td>e<tr><td>f<tr><td>g</table>", "a | b | c\nd\n  |   |   | e\n  |   |   | f\ng"),
        ("<ol><li value=9>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>", "9. a\n10. b\n\n3. x\n2. y"),
        ("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>a<td>b</table>", "w" * 60 + " | z\na" + " " * 59 + " | b"),
        ("<table><tr><td colspan=40>a<td>b<tr><td>c" + "<td>" * 39 + "<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=40>a<td>b" + "<tr><td>c" * 39 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 39 + "d | e"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 50 + "</table>", "a | b\n" + "\n".join(["  | c"] * 50)),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td colspan=9>d<tr><td>e<td>f</table>", "a | b | c\n  |   | d\n  | e | f"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3 rowspan=3>d<tr><td>e<tr><td>f<tr><td>g</table>", "a | b | c\nd\n  |   |   | e\n  |   |   | f\ng"),
        ("<ol><li value=9>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>", "9. a\n10. b\n\n3. x\n2. y"),
    ],
)
def test_html(page, text):
    assert html_render.Page().render(page) == text


def test_html_is_linear_in_time_and_output():
    import time

    began = time.process_time()
    assert html_render.Page().render("<div>" * 300_000 + "deep") == "deep"
    assert html_render.Page().render("<b>x</b>" * 300_000) == "x" * 300_000
    assert html_render.Page().render("<table><tr><td>" * 20_000 + "deep") == "deep"
    assert time.process_time() - began < 30
    for page in (
        "<table><tr><td>" + "w" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 300 + "</table>",
        "<table>" + "<tr><td colspan=1000>a<td>b" * 1000 + "</table>",
        "<table><tr>" + "<td rowspan=9999>a" * 1000 + "<tr><td>x" * 1000 + "</table>",
        "<table>" + "".join(f"<tr><td colspan={n}><td>a" for n in range(1000)) * 5 + "</table>",
        "<table><tr>" + "".join(f"<td rowspan={n}>a" for n in range(20_000, 1, -1)) + "<tr><td>x" * 20_000 + "</table>",
    ):
        text = html_render.Page().render(page)
        assert len(text) < 20 * len(page)
        assert text.count("a") + text.count("x") + text.count("b") + text.count("z") + text.count("w") == len(re.sub("<[^>]*>", "", page))


@settings(max_examples=300, deadline=None)
@given(page=st.text(alphabet="<>/tablerdhpu li!-'\"=&;x\n", max_size=80))
def test_html_never_fails(page):
    html_render.Page().render(page)


class Words(HTMLParser):
    """Text outside of elements that are never seen, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text = [], []

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        if tag not in html_render.VOID and (self.hidden or tag in html_render.UNSEEN or "hidden" in dict(attrs) or re.search(r"display\s*:\s*none", style)):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        while tag in self.hidden and self.hidden.pop() != tag:
            pass

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_html_query_keeps_every_visible_word(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    letters = lambda t: "".join(re.findall(r"\w+", re.sub(r"(?m)^ *\d+\. ", "", t)))
    for r in rows:
        known = Words()
        known.feed(pages[r.page_id] or "")
        known.close()
        assert letters(r.text) == letters(" ".join(known.text))


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (3, "<div>" * 20_000 + "deep", "t")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_render.extract(df).collect()} == {1: "a", 2: "", 3: "deep"}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank = got["score"].rank().to_numpy()
    y = got["toxic"].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95 and got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.7


def test_toxicity_edges(spark):
    model = toxicity.train(["you idiot", "a fine day", "", None] * 30, np.array([1, 0, 0, 0] * 30))
    df = spark.createDataFrame([(1, "you idiot", 1), (2, None, 2), (3, "", 3), (None, "idiot " * 50_000, 4)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[1].predicted == 1 and got[2].score == got[3].score < 0.5 and got[None].predicted == 1 and got[None].held_out
    assert toxicity.train([], np.zeros(0)).logits(toxicity.words_of(*_buffer(["x"]))).shape == (1,)


def test_toxicity_thresholds_come_from_all_labelled_rows(spark):
    # One row in 13 is toxic and half of these say so; a fifth of the clean rows share the other half's word.
    word = "CASE WHEN id % 13 = 0 THEN IF(id % 2 = 0, 'vile awful', 'vile') WHEN id % 5 = 0 THEN 'vile' ELSE 'fine' END"
    docs = spark.range(40_000).selectExpr("id AS doc_id", f"concat('the day was ', {word}) AS text")
    labels = spark.range(40_000).selectExpr("id AS doc_id", "int(id % 13 = 0) AS toxic")
    got = toxicity.classify(docs, labels).join(docs, "doc_id").groupBy("text").agg(F.min("predicted").alias("low"), F.max("predicted").alias("high")).collect()
    assert {r.text.removeprefix("the day was "): (r.low, r.high) for r in got} == {"vile awful": (1, 1), "vile": (0, 0), "fine": (0, 0)}


def test_toxicity_learns_from_six_thousand_rows(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a' AS text")
    texts, y = toxicity.sample(docs, spark.range(20_000).selectExpr("id AS doc_id", "int(id % 2) AS toxic"))
    assert (len(texts), y.sum()) == (6000, 2000)


def test_toxicity_sample_has_one_row_an_id_and_a_bound_in_bytes(spark):
    docs = spark.range(20_000).selectExpr("id % 40 AS doc_id", "concat('text ', id) AS text", "1 AS k")
    labels = spark.range(40).selectExpr("id AS doc_id", "int(id % 2) AS toxic", "2 AS text")
    texts, y = toxicity.sample(docs, labels)
    assert len(texts) == len(y) == toxicity.learnt(labels).count() <= 40
    long = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 200) AS text")
    assert sum(map(len, toxicity.sample(long, spark.range(200).selectExpr("id AS doc_id", "int(id % 2) AS toxic"), most_bytes=20_000)[0])) == 20_000


def _buffer(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_windows_of_the_classifier_end_with_their_text():
    model = toxicity.train(["a b", "c d"] * 40, np.array([1, 0] * 40))
    together = model.logits(toxicity.words_of(*_buffer(["x a b", "", "c d e"])))
    alone = [model.logits(toxicity.words_of(*_buffer([t])))[0] for t in ("x a b", "", "c d e")]
    assert np.allclose(together, alone, atol=1e-5)
    assert pa.array(together).null_count == 0
