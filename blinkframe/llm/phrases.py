"""Phrase collocations by pivot partitioning.

Every phrase belongs to its pivot, the rarest of its words (the leftmost, if that word stands in it twice). Around each word
of a text lies the longest fragment in which that word is the pivot: up to four words to the left that are less rare, up to four to
the right that are no rarer. Cut at words and at pairs of neighbours that can't be frequent, these fragments go to their
pivot; there the phrases across the pivot are counted, each occurrence in exactly one fragment, and only the pivot's own.

What tells rare words and pairs before anything is exact is a table of fixed size: occurrences by hash. A bucket counts at
least what each of its words or pairs has, so nothing frequent is cut off, and any total order gives every phrase one pivot.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.llm.frames import checkpoint, slices, text_bytes

LONGEST = 5
LEAST = 100
KEPT_WITHIN = 100
TOP = 2000
#: Hash buckets of words and of pairs; both fixed, whatever the corpus.
WORD_BITS, PAIR_BITS = 20, 24
PART = 1 << 12
#: Distinct fragments that a task gathers before it gives them out, and how many of a pivot go into one row at most.
HELD = 500_000
ROW = 4096
SLICE_BYTES = 4 << 20
#: Occurrences of a pivot that one group holds at most, about; a word with more has its fragments dealt over several.
PER_GROUP = 200_000
MOST_WORDS = 300_000
#: Languages up to this number are sent to all executors with their totals.
FEW_LANGS = 10_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_ITEMS = re.compile(rb"[^ \n]+|\n")


class Words:
    """Words of a language met by a task, numbered from 1 (0 is a break), with their hashes."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number))
        self.number[b"\n"] = 0
        self.hashes = np.zeros(1, np.uint64)

    def numbers(self, items: list[bytes]) -> np.ndarray:
        """Numbers of items; new ones are entered."""
        found = np.fromiter(map(self.number.__getitem__, items), np.int64, len(items))
        if len(self.number) > len(self.hashes):
            fresh = pa.array(list(self.number)[len(self.hashes) :], pa.binary())
            self.hashes = np.append(self.hashes, _hashed(fresh))
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the same in every task, salted by nothing."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
    bounds = bounds - bounds[0]
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    spread = _mixed((data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _mixed(np.add.reduceat(spread, bounds[:-1]) + np.diff(bounds).astype(np.uint64))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(3) + right)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, items) of runs of texts of one language; a text ends with a break."""
    for batch in batches:
        langs = batch["lang"].to_pylist()
        data, bounds = text_bytes(batch["text"])
        whole = data.tobytes()
        for start, end in slices(bounds, SLICE_BYTES):
            texts = defaultdict(list)
            for row in range(start, end):
                texts[langs[row]].append(whole[bounds[row] : bounds[row + 1]].translate(_LOWER))
            for lang, some in texts.items():
                yield lang, _ITEMS.findall(b"\n".join(some) + b"\n")


def _counts(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Counts of a task: words by language, and its hash buckets as blocks (no language, a block's number, its counts).

    A pair's bucket counts up to ``least``: sums of such counts reach it exactly if the sums of all do.
    """
    names = ["lang", "word", "n", "block", "counts"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    found: dict[str, Counter] = defaultdict(Counter)
    known: dict[str, Words] = defaultdict(Words)
    words, pairs = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << PAIR_BITS, _narrow(least))

    def told() -> Iterator[pa.RecordBatch]:
        for lang, some in found.items():
            if some:
                values = [pa.array([lang] * len(some), kinds[0]), pa.array([w.decode() for w in some], kinds[1]), pa.array(list(some.values()), kinds[2])]
                yield pa.RecordBatch.from_arrays([*values, pa.nulls(len(some), kinds[3]), pa.nulls(len(some), kinds[4])], names)
        found.clear()
        known.clear()

    for lang, items in _sliced(batches):
        own = known[lang]
        numbers = own.numbers(items)
        amounts = np.bincount(numbers, minlength=len(own.hashes))
        hashes = own.hashes + np.uint64(hash_of(lang))
        at = np.flatnonzero(amounts[1:]) + 1
        listed = list(own.number)
        found[lang].update({listed[i]: n for i, n in zip(at.tolist(), amounts[at].tolist(), strict=True)})
        np.add.at(words, _bucket(hashes[at], WORD_BITS), amounts[at])
        both = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        places, times = np.unique(_bucket(_pairs(hashes[numbers[both]], hashes[numbers[both + 1]]), PAIR_BITS), return_counts=True)
        pairs[places] = np.minimum(pairs[places] + times, least)
        if sum(map(len, found.values())) > MOST_WORDS:
            yield from told()
    yield from told()
    for first, table in ((0, words), (len(words) // PART, pairs)):
        blocks = table.reshape(-1, PART)
        at = np.flatnonzero(blocks.any(1))
        for some in (at[i : i + 64] for i in range(0, len(at), 64)):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds[:3]), pa.array(first + some, kinds[3]), pa.array([blocks[i].tobytes() for i in some], kinds[4])], names)


def _narrow(least: int) -> type:
    """Type of a pair's count, which is ``least`` at most."""
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.int64


def hash_of(lang: str) -> int:
    """A fixed number for a language, so that its words have hashes of their own."""
    return int(_hashed(pa.array([lang.encode() + b"\0"], pa.binary()))[0] >> np.uint64(1))


def _summed(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """One row for each block: counts of words, bits of the pairs that are frequent; blocks come sorted."""
    now, total = None, np.zeros(0)

    def row() -> pa.RecordBatch:
        told = total if now < (1 << WORD_BITS) // PART else np.packbits(total >= least, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([told.tobytes()], pa.binary())], ["block", "counts"])

    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
            own = np.frombuffer(counts.as_buffer(), np.int64 if block < (1 << WORD_BITS) // PART else _narrow(least)).astype(np.int64)
            if block == now:
                total = total + own
            else:
                if now is not None:
                    yield row()
                now, total = block, own
    if now is not None:
        yield row()


class Table:
    """The hash table: occurrences by word bucket, and which pair buckets reach the least frequency."""

    def __init__(self, rows: Iterable[tuple[int, bytes]], least: int) -> None:
        self.words, self.least = np.zeros(1 << WORD_BITS, np.int64), least
        self.pairs = np.zeros((1 << PAIR_BITS) // 8, np.uint8)
        for block, counts in rows:
            at = block - len(self.words) // PART
            if at < 0:
                self.words[block * PART : (block + 1) * PART] = np.frombuffer(counts, np.int64)
            else:
                self.pairs[at * PART // 8 : (at + 1) * PART // 8] = np.frombuffer(counts, np.uint8)

    def frequent_pairs(self, buckets: np.ndarray) -> np.ndarray:
        return (self.pairs[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def _cut(numbers: np.ndarray, hashes: np.ndarray, weight: np.ndarray, table: Table, longest: int) -> np.ndarray:
    """Fragments of a run of items as rows of words, 0 where there is none, the pivot in the middle column.

    Words rank by weight, then by hash, 0 for what can't be frequent. Equal hashes rank alike, so that tasks that know other
    words agree.
    """
    same = np.lexsort((hashes, weight))
    tied = np.append(False, (weight[same][1:] == weight[same][:-1]) & (hashes[same][1:] == hashes[same][:-1]))
    order = np.empty(len(hashes), np.int64)
    order[same] = np.maximum.accumulate(np.where(tied, 0, np.arange(1, len(hashes) + 1)))
    order[weight < table.least] = 0
    reach = longest - 1
    inner = np.concatenate([np.zeros(reach, np.int64), numbers, np.zeros(reach, np.int64)])
    rank = order[inner]
    rank[inner == 0] = 0
    link = (rank[:-1] > 0) & (rank[1:] > 0)
    at = np.flatnonzero(link)
    link[at] = table.frequent_pairs(_bucket(_pairs(hashes[inner[at]], hashes[inner[at + 1]]), PAIR_BITS))
    here = np.flatnonzero(link[:-1] | link[1:]) + 1
    rows = np.zeros((len(here), 2 * reach + 1), np.int32)
    rows[:, reach] = inner[here]
    for step in (-1, 1):
        some = np.arange(len(here))
        for far in range(1, longest):
            place, own = here[some] + step * far, rank[here[some]]
            some = some[link[place - (step > 0)] & (rank[place] > own if step < 0 else rank[place] >= own)]
            rows[some, reach + step * far] = inner[here[some] + step * far]
    return rows[(rows[:, reach - 1] > 0) | (rows[:, reach + 1] > 0)]


def _distinct(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows once each, and the sums of their times."""
    rows = np.ascontiguousarray(rows)
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return rows[first], np.bincount(group, times, len(first)).astype(np.int64)


def _fragments(batches: Iterator[pa.RecordBatch], table: Table, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, pivot, salt, fragments, at, n): lists of distinct fragments, the pivot's place in them and how often each, as many as a task gathers."""
    known: dict[str, Words] = defaultdict(Words)
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    reach = longest - 1

    def told(lang: str) -> Iterator[pa.RecordBatch]:
        rows, times = held.pop(lang)
        own = known[lang]
        weights = table.words[_bucket(own.hashes[rows[:, reach]] + np.uint64(hash_of(lang)), WORD_BITS)]
        groups = weights // PER_GROUP + 1
        mixed = _mixed((own.hashes[rows] * np.arange(1, rows.shape[1] + 1, dtype=np.uint64)).sum(1)) % groups.astype(np.uint64)
        salt = np.where(groups > 1, mixed.astype(np.int64) + 1, 0)
        order = np.lexsort((salt, rows[:, reach]))
        rows, times, salt = rows[order], times[order], salt[order]
        words = pa.array(list(own.number), pa.binary()).cast(pa.string())
        bounds = np.append(0, np.cumsum((rows > 0).sum(1)))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(rows[rows > 0]))), " ")
        key = rows[:, reach].astype(np.int64) * (int(salt.max()) + 1) + salt
        first = np.unique(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), np.arange(0, len(rows), ROW)))
        listed = lambda values: pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), values)
        at, n = pa.array((rows[:, :reach] > 0).sum(1), pa.int32()), pa.array(times)
        columns = [pa.array([lang] * len(first), pa.string()), words.take(pa.array(rows[first, reach])), pa.array(salt[first]), listed(texts), listed(at), listed(n)]
        for some in range(0, len(first), 10_000):
            yield pa.RecordBatch.from_arrays(columns, FRAGMENTS).slice(some, 10_000)

    for lang, items in _sliced(batches):
        own = known[lang]
        numbers = own.numbers(items)
        hashes = own.hashes + np.uint64(hash_of(lang))
        weight = table.words[_bucket(hashes, WORD_BITS)]
        weight[0] = 0
        rows = _cut(numbers, hashes, weight, table, longest)
        if len(rows):
            rows, times = _distinct(rows, np.ones(len(rows)))
            if lang in held:
                rows, times = _distinct(np.concatenate([held[lang][0], rows]), np.concatenate([held[lang][1], times]))
            held[lang] = rows, times
            if len(rows) > HELD:
                yield from told(lang)
        if len(own.number) > MOST_WORDS:
            if lang in held:
                yield from told(lang)
            del known[lang]
    for lang in list(held):
        yield from told(lang)


FRAGMENTS = ["lang", "pivot", "salt", "fragments", "at", "n"]


def _mined(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of each pivot's phrases; groups come sorted. A pivot that was dealt out gives all its sums, others the frequent ones."""
    now, counts = None, Counter()

    def told() -> pa.RecordBatch:
        kept = {p: n for p, n in counts.items() if n >= least or now[2]}
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept), pa.string()), pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["lang", "phrase", "n"])

    for batch in batches:
        for row in range(len(batch)):
            lang, pivot, salt, *lists = (batch[c][row].as_py() for c in FRAGMENTS)
            if (lang, pivot, salt) != now:
                if now is not None:
                    yield told()
                now, counts = (lang, pivot, salt), Counter()
            for fragment, at, n in zip(*lists, strict=True):
                words = fragment.split(" ")
                for start in range(max(0, at - longest + 1), at + 1):
                    for end in range(max(at + 1, start + 2), min(len(words), start + longest) + 1):
                        counts[" ".join(words[start:end])] += n
    if now is not None:
        yield told()


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 2 to ``longest`` words with ``a`` >= ``least`` occurrences, and (lang, word, n) of all words.

    A phrase lies within a piece of a text; A-Z are lowered; a null text is empty, a null language ``und``. Repeated rows
    count as often as they stand there.
    """
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = checkpoint(own.mapInArrow(lambda b: _counts(b, least), "lang string, word string, n long, block int, counts binary"))
    words = counted.filter("block is null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    blocks = counted.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    summed = blocks.mapInArrow(lambda b: _summed(b, least), "block int, counts binary")
    # A fixed number of blocks, whatever the corpus: counts of 2 ** 20 buckets of words and bits of 2 ** 24 of pairs make 10 MB.
    told = docs.sparkSession.sparkContext.broadcast(Table(((r.block, bytes(r.counts)) for r in summed.toLocalIterator()), least))
    fragments = own.mapInArrow(lambda b: _fragments(b, told.value, longest), "lang string, pivot string, salt long, fragments array<string>, at array<int>, n array<long>")
    dealt = fragments.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt")
    mined = dealt.mapInArrow(lambda b: _mined(b, least, longest), "lang string, phrase string, n long")
    phrases = mined.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    return phrases.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a"), words


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = KEPT_WITHIN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their weakest cut.

    A phrase goes if one that holds it has ``percent`` of its occurrences or more. Scores are whole numbers, exact: products
    are decimals of 38 digits. Of cuts with one score the leftmost counts. No document, no row.
    """
    phrases, words = frequencies(docs, least, longest)
    words, phrases = checkpoint(words), checkpoint(phrases)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    if totals.count() <= FEW_LANGS:
        totals = F.broadcast(totals)
    split = F.split("phrase", " ")
    join = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))

    inner = phrases.filter("size > 2").withColumn("words", split).withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    holders = inner.select("lang", join(F.col("start"), F.col("k")).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = phrases.join(holders, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("most") < F.lit(percent) * F.col("a"), F.lit(True)))

    cuts = kept.withColumn("words", split).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    cuts = cuts.withColumns({"over": (_wide("a") * 1000).cast("decimal(19,0)") * _wide("n"), "under": _wide("l") * _wide("r")}).withColumn("score", F.expr("over div under"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = weakest.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(least: int = LEAST, longest: int = LONGEST, percent: int = KEPT_WITHIN, top: int = TOP) -> str:
    """The query's rows as DuckDB SQL."""
    return f"""
        WITH pieces AS (
          SELECT row_number() OVER () AS id, lang, piece FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
        ), listed AS (SELECT id, lang, [w for w in regexp_split_to_array(piece, '[ \\t]+') if w <> ''] AS words FROM pieces),
        grams AS (
          SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM (
            SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM listed, (SELECT unnest(range(1, {longest + 1})) AS size) WHERE len(words) >= size)
        ), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE a >= {least}),
        cand AS (SELECT * FROM often WHERE size >= 2),
        holders AS (
          SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM (
            SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM cand)) GROUP BY ALL
        ), kept AS (SELECT c.* FROM cand c LEFT JOIN holders h USING (lang, phrase) WHERE h.most IS NULL OR 100 * h.most < {percent} * c.a),
        cuts AS (
          SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) c JOIN totals t USING (lang)
          JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[:k], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
        ), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest) WHERE rank <= {top}
    """
