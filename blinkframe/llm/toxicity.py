"""Toxicity by a convolutional text classifier on hashed word embeddings.

A word's vector is the sum of two hashed embeddings, of the word and of its first bytes. Filters of several widths run over
the words, the largest activation of each filter is kept, and a logistic layer gives the score. The model is trained in
numpy, from random weights, on a bounded sample of labelled rows. A threshold is then chosen for each language, told from
the text's own words, from counts over all labelled rows of a fold that training doesn't see, and the logit is shifted so
that every language's threshold is a score of one half. The sample's share of toxic rows adds a constant to all logits; it
leaves with the shift, so neither score nor verdict depends on it.

Scoring needs no matrix products: a filter's response to a bucket at each offset is one table, made when the model is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.llm.frames import checkpoint, slices, text_bytes
from blinkframe.llm.shingles import mixed, word_bounds, word_hashes

#: At most so many labelled rows are learnt from, a third of them of label 1 if there are as many, and so many bytes of text.
MOST_ROWS = 6000
MOST_BYTES = 64 << 20
BUCKETS = 1 << 15
WIDTH = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
PREFIX_BYTES = 4
EPOCHS = 8
RATE = 0.1
#: Share of words left out at random whenever a text is learnt from.
DROPPED = 0.1
FOLDS = 5
#: Fold of the rows that thresholds are chosen on; fold 0 is held out, the others are learnt from.
TUNED = 1
SLICE_BYTES = 1 << 19
#: Thresholds are chosen from counts of logits in bins of 1 / BINS, within MOST_LOGIT.
BINS = 128
MOST_LOGIT = 30

#: Words by which a text's language is told.
TELLING = {
    "de": "der die und den von zu das mit sich des auf ist nicht ein dem".split(),
    "en": "the of and to is that it was for with as this by are be".split(),
    "es": "el los del las por con una su para es al lo que y se".split(),
    "fr": "le et les du une est pour qui dans par des pas sur au avec".split(),
}
LANGUAGES = (*sorted(TELLING), "")


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_hashes(data, *word_bounds(data, np.array([0, len(data)]))[:2])


_TELLING = {k: np.sort(_hash(v)) for k, v in TELLING.items()}


class Words(NamedTuple):
    """Words of many texts: bucket of the word, bucket of its beginning, bounds by text, and the texts' languages."""

    word: np.ndarray
    begin: np.ndarray
    bounds: np.ndarray
    lang: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Punctuation at the end of a word is no part of it."""
    starts, ends, firsts = word_bounds(data, bounds)
    last = np.zeros(256, bool)
    last[[ord(c) for c in ".,;:!?"]] = True
    trimmed = ends - (last[data[ends - 1]] & (ends - starts > 1))
    whole = word_hashes(data, starts, trimmed)
    begin = word_hashes(data, starts, np.minimum(trimmed, starts + PREFIX_BYTES))
    votes = []
    for own in _TELLING.values():
        at = np.minimum(np.searchsorted(own, whole), len(own) - 1)
        total = np.r_[0, np.cumsum(own[at] == whole)]
        votes.append(total[firsts[1:]] - total[firsts[:-1]])
    votes = np.array(votes)
    lang = np.where(votes.max(0, initial=0) > 0, votes.argmax(0), len(LANGUAGES) - 1)
    buckets = np.uint64(BUCKETS)
    return Words((whole % buckets).astype(np.int32), (mixed(begin) % buckets).astype(np.int32) + BUCKETS, firsts, lang)


def words_in(column: pa.Array) -> Iterator[Words]:
    """Words of a column's texts, some texts at a time."""
    data, bounds = text_bytes(column)
    for a, b in slices(bounds, SLICE_BYTES):
        yield words_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def _joined(parts: list[Words]) -> Words:
    sizes = np.cumsum([0, *(len(p.word) for p in parts)])
    bounds = np.concatenate([[0], *(p.bounds[1:] + at for p, at in zip(parts, sizes, strict=False))]).astype(np.int64)
    return Words(*(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i in (0, 1)), bounds, np.concatenate([p.lang for p in parts]) if parts else np.zeros(0, np.int64))


class Model(NamedTuple):
    """Trained weights, folded into tables: response of each filter to each bucket at each offset."""

    tables: list[np.ndarray]  # by width: (offset, bucket, filter)
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: np.ndarray  # by language

    def logits(self, words: Words) -> np.ndarray:
        """Logit of each text, shifted by its language; a text without words has the bias alone."""
        n = len(words.word)
        counts = np.diff(words.bounds)
        pooled = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        some = np.flatnonzero(counts > 0)
        for w, (size, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
            reply = np.zeros((n, FILTERS), np.float32)
            for offset in range(size):
                part = table[offset, words.word[offset:]] + table[offset, words.begin[offset:]]
                if offset:
                    # Windows end with their text: past its last word there is nothing to add.
                    owner_end = np.repeat(words.bounds[1:], counts)[: n - offset]
                    part[np.arange(n - offset) + offset >= owner_end] = 0
                reply[: n - offset] += part
            if len(some):
                pooled[some, w * FILTERS : (w + 1) * FILTERS] = np.maximum.reduceat(reply, words.bounds[:-1][some])
        active = np.maximum(pooled + self.bias, 0)
        return active @ self.out + self.base - self.shift[words.lang]


def _folded(embedding: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    return [np.stack([(embedding @ f[o]) for o in range(len(f))]).astype(np.float32) for f in filters]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on texts and 0/1 labels; equal input gives an equal model. Labels of one kind give a constant score."""
    rng = np.random.default_rng(seed)
    words = _joined(list(words_in(pa.array([t or "" for t in texts], pa.large_string()))))
    labels = labels.astype(np.float64)
    rows = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    prior = float(np.clip(labels.mean() if len(labels) else 0.0, 0.001, 0.999))

    kinds = len(WIDTHS) * FILTERS
    embedding = rng.normal(0, 0.1, (2 * BUCKETS, WIDTH))
    filters = [rng.normal(0, 0.3, (size, WIDTH, FILTERS)) for size in WIDTHS]
    bias, out = np.zeros(kinds), rng.uniform(0.2, 0.6, kinds)
    base = float(np.log(prior / (1 - prior)))
    # Squares of past gradients: each weight's rate falls by its own.
    past_embedding, past_filters = np.full(2 * BUCKETS, 0.01), [np.full(f.shape, 0.01) for f in filters]
    past_bias, past_out, past_base = np.full(kinds, 0.01), np.full(kinds, 0.01), 0.01
    weight = np.where(labels == 1, min(8.0, (1 - prior) / prior) ** 0.5, 1.0)

    # One text's gradient reaches only the windows that won its pooling.
    starts = words.bounds
    for _ in range(EPOCHS if 0 < labels.sum() < len(labels) else 0):
        for t in rng.permutation(len(texts)):
            a, b = starts[t], starts[t + 1]
            if a == b:
                continue
            word, begin = words.word[a:b], words.begin[a:b]
            x = (embedding[word] + embedding[begin]) * (rng.random(b - a) >= DROPPED)[:, None]
            padded = np.concatenate([x, np.zeros((max(WIDTHS) - 1, WIDTH))])
            best, tops = np.empty(kinds), []
            for w, f in enumerate(filters):
                reply = sum(padded[o : o + len(x)] @ f[o] for o in range(len(f)))
                top = reply.argmax(0)
                tops.append(top)
                best[w * FILTERS : (w + 1) * FILTERS] = reply[top, np.arange(FILTERS)]
            active = np.maximum(best + bias, 0)
            score = 1 / (1 + np.exp(-np.clip(active @ out + base, -30, 30)))
            error = (score - labels[t]) * weight[t]
            if abs(error) < 0.02:
                continue
            back = np.where(active > 0, out, 0.0) * error
            past_out += (error * active) ** 2
            out = out - RATE * error * active / np.sqrt(past_out)
            past_base += error**2
            base -= RATE * error / past_base**0.5
            past_bias += back**2
            bias = bias - RATE * back / np.sqrt(past_bias)
            for w, (f, past) in enumerate(zip(filters, past_filters, strict=True)):
                for j in np.flatnonzero(back[w * FILTERS : (w + 1) * FILTERS]):
                    pull, at = back[w * FILTERS + j], tops[w][j]
                    for o in range(min(len(f), len(x) - at)):
                        to_word, to_filter = pull * f[o, :, j], pull * padded[at + o]
                        past[o, :, j] += to_filter**2
                        f[o, :, j] -= RATE * to_filter / np.sqrt(past[o, :, j])
                        for bucket in (word[at + o], begin[at + o]):
                            past_embedding[bucket] += (to_word**2).mean()
                            embedding[bucket] -= RATE * to_word / past_embedding[bucket] ** 0.5
    model = Model(_folded(embedding, filters), bias.astype(np.float32), out.astype(np.float32), base, np.zeros(len(LANGUAGES)))
    logits = [model.logits(w) for w in words_in(pa.array([t or "" for t in texts], pa.large_string()))]
    bins = _binned(np.concatenate(logits) if logits else np.zeros(0))
    return model._replace(shift=_thresholds(words.lang, labels, bins, np.ones(len(bins), np.int64)))


def _binned(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -MOST_LOGIT, MOST_LOGIT) * BINS).astype(np.int32)


def _thresholds(lang: np.ndarray, label: np.ndarray, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logit of each language's threshold, from counts ``n``: the cut with the best F1, midway between its neighbours; few examples share one."""

    def cut(own: np.ndarray) -> float:
        at, where = np.unique(-bins[own], return_inverse=True)
        hits = np.cumsum(np.bincount(where, n[own] * label[own], len(at)))
        f1 = 2 * hits / (np.cumsum(np.bincount(where, n[own], len(at))) + hits[-1])
        best = int(f1.argmax())
        z = (0.5 - at) / BINS  # the middle of each bin, falling
        low = z[best + 1] if best + 1 < len(z) else z[best] - 1
        # Bins are half open, so between neighbouring bins the cut is their edge.
        return float((z[best] + low) / 2)

    every = cut(np.ones(len(bins), bool)) if (n * label).any() else 0.0
    shift = np.full(len(LANGUAGES), every)
    for code in range(len(LANGUAGES)):
        own = lang == code
        if (n * label)[own].sum() >= 20 and (n * (1 - label))[own].sum() >= 20:
            shift[code] = cut(own)
    return shift


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null ids are in fold 0, which is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS, F.lit(0))


def learnt(labels: DataFrame, key: str = "doc_id", label: str = "toxic", tuned: bool = False) -> DataFrame:
    """Ids and labels (k, y) that training sees, or those of the fold ``tuned``; of an id's labels the largest counts."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("y is not null and k is not null")
    own = fold(F.col("k")) == TUNED if tuned else ~fold(F.col("k")).isin(0, TUNED)
    return known.filter(own).groupBy("k").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic", most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray]:
    """Training sample of at most ``most`` rows and ``most_bytes``, in the order of a hash of their ids; an id's first text counts."""
    rows = learnt(labels, key, label)
    order = F.xxhash64("k")
    chosen = rows.filter("y = 1").orderBy(order, "k").limit(most // 3).unionByName(rows.filter("y = 0").orderBy(order, "k").limit(most - most // 3))
    # Texts are cut neither here nor in scoring.
    own = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    picked = own.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("text").alias("text"))
    picked = picked.withColumn("until", F.sum(F.octet_length("text")).over(Window.orderBy(order, "k")))  # at most ``most`` rows
    picked = picked.filter(F.col("until") <= most_bytes).toPandas().sort_values("k")
    return picked["text"].tolist(), picked["y"].to_numpy()


def raw(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang (a code), logit with the model's own shift, and its bin."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size, whatever the corpus
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (fold(F.col(f"`{key}`")) == 0).alias("held_out"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [(words.lang, own.logits(words)) for words in words_in(batch["text"])]
            lang, z = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0))
            columns = [pa.array(lang.astype(np.int32)), pa.array(z.astype(np.float64)), pa.array(_binned(z))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *columns], ["doc_id", "held_out", "lang", "logit", "bin"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang int, logit double, bin int")


def _scored(rows: DataFrame, shift: np.ndarray) -> DataFrame:
    own = F.element_at(F.array(*[F.lit(float(s)) for s in shift]), F.col("lang") + 1)
    z = F.greatest(F.least(F.col("logit") - own, F.lit(30.0)), F.lit(-30.0))
    return rows.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"), (z >= 0).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any text without words. Rows that repeat give equal rows; other columns are ignored.
    """
    return _scored(raw(docs, model, key, text), np.zeros(len(LANGUAGES)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on a sample of labelled rows, choose thresholds on all those of a fold of their own, score every document."""
    model = train(*sample(docs, labels))._replace(shift=np.zeros(len(LANGUAGES)))
    # Texts are read once more here; what is kept is some 30 bytes a row.
    rows = checkpoint(raw(docs, model))
    known = rows.join(learnt(labels, tuned=True).withColumn("k", F.col("k").cast("long")), F.col("doc_id") == F.col("k"))
    counts = known.groupBy("lang", "y", "bin").agg(F.count("*").alias("n")).toPandas()  # bounded by the number of bins
    return _scored(rows, _thresholds(*(counts[c].to_numpy() for c in ("lang", "y", "bin", "n"))))
