"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Every text gets MinHash samples in bands, an odd sketch of them (a parity bitmap: each sample flips one bit) and a
   fingerprint of its whole shingle set. Texts with one set are one class; only a representative goes on.
2. A bucket is all representatives that share a band; of buckets with the same members one goes on. Each member is
   compared with the bucket's first member: links for a group of copies grow with its size, not with its square. A first
   member travels once to every thousand or so others.
3. Pairs whose sketches differ in more bits than a pair at the threshold plausibly would are dropped: the population
   count of their XOR estimates high similarities closely. The others are confirmed on complete shingle sets.
4. Members of one bucket that are still in different components meet block by block, each pair of blocks a group of its
   own. First the sketch and one of 1,024 samples, made for them alone, tell which members may have a link there; their
   complete sets then meet, are confirmed on the spot, and only a spanning forest of the links between components is given
   out. So no link hangs on a bucket's first member, and what is given out grows with the members, not with their pairs.

A task holds two blocks, which are bounded by their shingles, however large the bucket. Large buckets get more first
members before, as long as these link many, and blocks meet themselves before they meet others: buckets that are one
component by then are left out. Comparisons grow with the square of what is left of a bucket.

With 40 bands of 4, a pair at similarity 0.8 shares no band once in 10^9; the sketches lose one such pair in 10^7.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.llm.components import components
from blinkframe.llm.frames import checkpoint
from blinkframe.llm.shingles import mixed, shingle_sets

BANDS = 40
ROWS = 4
#: A band's number is in the low bits of its key.
PLACES = 64
SIMILARITY = 80
#: Shingles of a block, each member counted as MEMBER more: at most 2,048 members and 16 MB of sets, a longer text alone.
BLOCK = 1 << 21
MEMBER = 1024
#: Members to which a first member travels at once.
FOLLOWERS = 1024


class Samples:
    """A family of MinHash functions, and odd sketches of their samples."""

    def __init__(self, count: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.count, self.bits = count, bits
        self.factor = rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, count, np.uint32)
        self.salt = rng.integers(0, 1 << 63, count, np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """Samples of one set, over 32 bits of each shingle."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.count, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            values = self.factor[:, None] * x[None, at : at + 1024]
            values += self.shift[:, None]
            np.minimum(best, values.min(1), out=best)
        return best

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps of rows of samples, as 64-bit words."""
        rows = len(samples)
        bit = (mixed(samples.astype(np.uint64) ^ self.salt) % np.uint64(self.bits)).astype(np.int64)
        counts = np.bincount((bit + np.arange(rows)[:, None] * self.bits).ravel(), minlength=rows * self.bits)
        return np.packbits((counts & 1).astype(bool).reshape(rows, self.bits), axis=1).view(np.int64)

    def farthest(self, similarity: float, deviations: float = 5.5) -> int:
        """Bits in which sketches may differ at this similarity, by so many standard deviations above the mean."""
        k, n = self.count, self.bits
        flips = 2 * (k * (1 - similarity) + deviations * np.sqrt(k * similarity * (1 - similarity)))
        return int(np.ceil(n / 2 * (1 - np.exp(-2 * flips / n)))) + n // 200


COARSE = Samples(BANDS * ROWS, 512, 20250202)
FINE = Samples(1024, 4096, 20250303)

SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Signature of every row of (doc_id, text); texts without words have no bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            counts, sets = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            samples = np.zeros((rows, COARSE.count), np.uint32)
            for row, found in enumerate(shingle_sets(batch["text"], size)):
                if len(found):
                    counts[row] = len(found)
                    sets[row] = mixed(found).sum(), mixed(found ^ COARSE.salt[0]).sum()
                    samples[row] = COARSE.of(found)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (rows, BANDS)).copy()
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::ROWS])
            key = key & ~np.uint64(PLACES - 1) | np.arange(BANDS, dtype=np.uint64)
            sketch = COARSE.sketches(samples)
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts), pa.array(sets[:, 0].view(np.int64)) if rows else pa.array([], pa.int64()), pa.array(np.ascontiguousarray(sets[:, 1]).view(np.int64)),
                 _lists(key[some].ravel().view(np.int64), BANDS * some), _lists(sketch[some].ravel(), sketch.shape[1] * some)],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, SIGNATURES)


def _with_first(pairs: DataFrame, own: DataFrame, payload: list[str], compare: Callable) -> DataFrame:
    """Rows (u, v, n) that ``compare`` accepts; ``own`` has the payload of each doc_id.

    The v of one u are dealt into about n / FOLLOWERS groups; u's payload is sent to each group once, ahead of theirs.
    compare(batch, at, first) tells of rows ``at`` of a batch whether they go with row ``first`` of it.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / FOLLOWERS)))
    first = F.struct(F.lit(0).alias("side"), F.col("u").alias("doc_id"), F.lit(0).cast("long").alias("n"))
    rest = F.struct(F.lit(1).alias("side"), F.col("v").alias("doc_id"), F.col("n").cast("long").alias("n"))
    told = pairs.select("u", "part", F.explode(F.array(first, rest)).alias("row")).select("u", "part", "row.*").distinct()
    rows = told.join(own, "doc_id").select("u", "part", "side", "doc_id", "n", *payload).repartition("u", "part").sortWithinPartitions("u", "part", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            side, u, doc, size = (batch[n].to_numpy() for n in ("side", "u", "doc_id", "n"))
            lead = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), 0))
            at = np.flatnonzero(side == 1)
            hit = at[compare(batch, at, lead[at])] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(u[hit]), pa.array(doc[hit]), pa.array(size[hit])], ["u", "v", "n"])
            if len(lead):
                last = batch.slice(int(lead[-1]), 1)

    return rows.mapInArrow(work, "u long, v long, n long")


def _sketches(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Rows (u, v, n) whose sketches and set sizes allow the similarity."""
    most = COARSE.farthest(percent / 100)

    def compare(batch: pa.RecordBatch, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        sketch, count = _sketches(batch["sketch"]), batch["n_shingles"].to_numpy()
        bits = np.bitwise_count(sketch[at] ^ sketch[first]).sum(1, np.int64)
        return (bits <= most) & (100 * np.minimum(count[at], count[first]) >= percent * np.maximum(count[at], count[first]))

    return _with_first(pairs, reps.select("doc_id", "n_shingles", "sketch"), ["n_shingles", "sketch"], compare)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Numbers that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of rows (u, v, n) with 100 * intersection >= percent * union of their complete shingle sets."""

    def compare(batch: pa.RecordBatch, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        sets = batch["shingles"]
        hit, now, own = [], -1, None
        for row, lead in zip(at.tolist(), first.tolist(), strict=True):
            if lead != now:
                now, own = lead, np.frombuffer(sets[lead].as_buffer(), np.uint64)
            other = np.frombuffer(sets[row].as_buffer(), np.uint64)
            common = _common(own, other)
            hit.append(100 * common >= percent * (len(own) + len(other) - common))
        return np.array(hit, bool)

    return _with_first(pairs, known.select("doc_id", "shingles"), ["shingles"], compare).select("u", "v")


def _complete(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Complete shingle sets and larger odd sketches of the documents with these ids: doc_id, shingles, fine."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, samples = [], np.zeros((len(batch), FINE.count), np.uint32)
            for row, own in enumerate(shingle_sets(batch["text"], size)):
                found.append(own.tobytes())
                samples[row] = FINE.of(own)
            sketch = FINE.sketches(samples)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary()), _lists(sketch.ravel(), np.full(len(found), sketch.shape[1]))], ["doc_id", "shingles", "fine"])

    return docs.join(ids, "doc_id").select("doc_id", "text").mapInArrow(work, "doc_id long, shingles binary, fine array<long>")


def _buckets(reps: DataFrame) -> DataFrame:
    """Members of bands that several share: band, first (their least), doc_id, n_shingles, n (their number).

    Near copies share many bands, so that many buckets have the same members. Of these the one of the first band stays; it
    is the first that any two of its members share, too.
    """
    own = F.shiftleft("n_shingles", 24).bitwiseOR(F.col("set_a").bitwiseAND(0xFFFFFF)).alias("own")  # tells texts of one id apart
    dealt = reps.select("doc_id", own, F.explode("bands").alias("band"))
    several = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    dealt = checkpoint(dealt.join(several, "band").select("band", "first", "doc_id", "own", "n"))
    marks = {f"mark_{k}": F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", "own", F.lit(k)), 32)) for k in range(3)}  # sums of 32 bits don't pass 64
    told = dealt.groupBy("band").agg(F.first("n").alias("n"), F.first("first").alias("first"), *[m.alias(k) for k, m in marks.items()])
    kept = told.groupBy("n", "first", *marks).agg(F.min_by("band", F.col("band").bitwiseAND(PLACES - 1)).alias("band")).select("band")
    return checkpoint(dealt.join(kept, "band").select("band", "first", "doc_id", F.shiftrightunsigned("own", 24).alias("n_shingles"), "n"))


def _mixed_up(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: band, doc_id, component, n_shingles, size (their bucket's, in what BLOCK counts)."""
    named = buckets.join(labels, buckets["doc_id"] == labels["id"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n_shingles")
    several = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.col("n_shingles") + MEMBER).alias("size")).filter("low < high")
    return checkpoint(named.join(several, "band").select("band", "doc_id", "component", "n_shingles", "size"))


def _largest(named: DataFrame) -> int:
    """Size of the largest bucket."""
    return named.agg(F.max("size")).first()[0] or 0


def _stars(named: DataFrame, nth: int) -> DataFrame:
    """Pairs (u, v, n) of one member of each bucket of several blocks and all its n members of other components."""
    order = F.struct(F.xxhash64("doc_id", F.lit(nth)), F.col("doc_id").alias("hub"), F.col("component").alias("own"))
    hubs = named.filter(F.col("size") > BLOCK).groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("least"))
    pairs = named.join(hubs.select("band", "n", "least.hub", "least.own"), "band").filter("component <> own")
    return pairs.groupBy(F.col("hub").alias("u"), F.col("doc_id").alias("v")).agg(F.max("n").alias("n"))


def _meetings(named: DataFrame, percent: int, same: bool, one: bool = False) -> DataFrame:
    """Members of each pair of blocks (band, i, j) whose sizes allow the similarity, those of i with side 0, of j with 1.

    A bucket's members stand by size, those of equal size by hash, and are cut into blocks of about BLOCK. ``same``
    gives each block with itself (side 0 alone), else each pair of different blocks. ``one`` tells that no bucket needs cutting.
    """
    if one and same:
        return named.select("band", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "doc_id", "component")
    weight = F.col("n_shingles") + MEMBER
    sizes = named.groupBy("band", "n_shingles").agg(F.count("*").alias("n"))
    before = F.sum(F.col("n") * weight).over(Window.partitionBy("band").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1))  # a row for each size
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    at = F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("n")) * weight
    placed = named.join(sizes, ["band", "n_shingles"]).select("band", "doc_id", "component", "n_shingles", F.floor(at / BLOCK).alias("block"))
    if same:
        return placed.select("band", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "doc_id", "component")
    placed = checkpoint(placed)
    spans = placed.groupBy("band", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a = spans.select("band", F.col("block").alias("i"), F.col("high").alias("most"))
    b = spans.select("band", F.col("block").alias("j"), F.col("low").alias("least"))
    pairs = a.join(b, "band").filter((F.col("i") < F.col("j")) & (100 * F.col("most") >= percent * F.col("least"))).select("band", "i", "j")
    sides = [placed.withColumnRenamed("block", name).join(pairs, ["band", name]).select("band", "i", "j", F.lit(side).alias("side"), "doc_id", "component") for side, name in enumerate("ij")]
    return sides[0].unionByName(sides[1])


MEETING = ["band", "i", "j"]


def _by_meeting(rows: DataFrame, meet: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``meet`` gives for the rows of each pair of blocks, those of side 0 first."""
    rows = rows.repartition(*MEETING).sortWithinPartitions(*MEETING, "side", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            key = np.stack([batch[n].to_numpy() for n in MEETING])
            cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(key[:, a])
                if held and last != now:
                    yield from meet(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from meet(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(work, schema)


def _plausible(members: DataFrame, reps: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Rows of ``members`` that pass both sketch tests and the size test with one of another component they meet."""
    rows = members.join(reps.join(known.select("doc_id", "fine"), "doc_id"), "doc_id").select(*MEETING, "side", "doc_id", "component", "n_shingles", "sketch", "fine", "bands")
    limits = COARSE.farthest(percent / 100), FINE.farthest(percent / 100)
    names = [*MEETING, "side", "doc_id", "component"]

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part, count, side = (table[n].to_numpy() for n in ("component", "n_shingles", "side"))
        if (part == part[0]).all():
            return
        sketch, fine, bands = (_sketches(table[n].combine_chunks()) for n in ("sketch", "fine", "bands"))
        band = np.int64(table["band"][0].as_py()).view(np.uint64)
        cut = int((side == 0).sum())
        first = 0 if cut == len(side) else cut
        found = np.zeros(len(side), bool)
        for a in range(0, cut, 256):
            x, y = slice(a, min(a + 256, cut)), slice(first, None)
            bits = np.zeros((len(part[x]), len(part[y])), np.uint16)
            for w in range(sketch.shape[1]):
                bits += np.bitwise_count(sketch[x, w][:, None] ^ sketch[y, w][None, :])
            u, v = np.nonzero((bits <= limits[0]) & (part[x][:, None] != part[y][None, :]))
            u, v = u + a, v + first
            for at in range(0, len(u), 16384):
                i, j = u[at : at + 16384], v[at : at + 16384]
                near = np.bitwise_count(fine[i] ^ fine[j]).sum(1, np.int64) <= limits[1]
                i, j = i[near], j[near]
                # A pair belongs to the first band that it shares.
                shared = bands[i] == bands[j]
                own = (bands[i, shared.argmax(1)] == band) & (100 * np.minimum(count[i], count[j]) >= percent * np.maximum(count[i], count[j]))
                found[i[own]] = found[j[own]] = True
        if found.any():
            yield table.select(names).filter(pa.array(found)).combine_chunks().to_batches()[0]

    return _by_meeting(rows, meet, "band long, i long, j long, side int, doc_id long, component long")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``; sets are arrays of distinct numbers.

    Numbers that many sets hold are counted by products of 0/1 matrices, a slice of them at a time, the others pair by pair.
    """
    rows, columns = len(x), len(y)
    found = np.zeros((rows, columns), np.float32)
    codes, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    owner = np.repeat(np.arange(rows + columns), [len(s) for s in (*x, *y)])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    left = owner < rows
    a, b = np.bincount(code[left], minlength=len(codes)), np.bincount(code[~left], minlength=len(codes))
    many = (a * b).astype(np.float64) > max(64.0, rows * columns / 256)
    starts = np.r_[0, np.cumsum(a + b)]
    flat = found.reshape(-1)
    # Owners of a number are in rising order: those of x come first.
    rare = np.flatnonzero((a * b > 0) & ~many)
    pairs = np.cumsum(a[rare] * b[rare])
    for low, high in _spans(pairs, 1 << 20):
        some = rare[low:high]
        times = a[some] * b[some]
        of = np.repeat(np.arange(len(some)), times)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i = owner[starts[some][of] + inner // b[some][of]]
        j = owner[starts[some][of] + a[some][of] + inner % b[some][of]] - rows
        flat += np.bincount(i * columns + j, minlength=rows * columns).astype(np.float32) if len(i) * 8 > rows * columns else _added(i * columns + j, rows * columns)
    frequent = np.flatnonzero(many)
    for at in range(0, len(frequent), 2048):
        some = frequent[at : at + 2048]
        place = np.full(len(codes), -1)
        place[some] = np.arange(len(some))
        of = place[code]
        chosen = of >= 0
        table = np.zeros((rows + columns, len(some)), np.float32)
        table[owner[chosen], of[chosen]] = 1
        found += table[:rows] @ table[rows:].T
    return found


def _added(at: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros(size, np.float32)
    np.add.at(found, at, 1)
    return found


def _spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows with these running totals into runs of about ``most``."""
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def _spanning(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between components of the members that meet: a spanning forest for each pair of blocks."""
    rows = members.join(known.select("doc_id", "shingles"), "doc_id").select(*MEETING, "side", "doc_id", "component", "shingles")

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, part, side = (table[n].to_numpy() for n in ("doc_id", "component", "side"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for chunk in table["shingles"].chunks for s in chunk]
        sizes = np.array([len(s) for s in sets], np.float32)
        cut = int((side == 0).sum())
        first = 0 if cut == len(side) else cut
        y = sets[first:]
        label = np.unique(part, return_inverse=True)[1]
        links = []
        for a in range(0, cut, 512):
            x = slice(a, min(a + 512, cut))
            common = common_counts(sets[x], y)
            near = 100 * common >= percent * (sizes[x][:, None] + sizes[first:][None, :] - common)
            for row in range(len(near)):
                at = first + np.flatnonzero(near[row])
                other, index = np.unique(label[at], return_index=True)
                fresh = other != label[a + row]
                links += [(doc[a + row], doc[j]) for j in at[index[fresh]]]
                if fresh.any():
                    label[np.isin(label, other[fresh])] = label[a + row]
        if links:
            u, v = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return _by_meeting(rows, meet, "u long, v long")


def _across(named: DataFrame, reps: DataFrame, known: DataFrame, percent: int, same: bool, one: bool = False) -> DataFrame:
    """Links (u, v) that join the components within buckets: at most a row for each member and pair of blocks.

    Blocks meet themselves (``same``) or others; every pair of blocks is a group of its own.
    """
    return _spanning(checkpoint(_plausible(_meetings(named, percent, same, one), reps, known, percent)), known, percent)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word shingles (A-Z lower-cased;
    fewer words make one shingle). component_id is the least id reachable. Null and empty texts, and texts without words,
    have no shingles and no links. Rows with one id are one vertex; a null id is linked with nothing and kept.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = checkpoint(signatures(docs, size))
    same = ["set_a", "set_b", "n_shingles"]
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    members = signed.select("doc_id", *same).join(classes, same, "left")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same]).dropDuplicates(["doc_id", *same])
    reps = checkpoint(reps.select("doc_id", "n_shingles", "set_a", "bands", "sketch"))

    buckets = _buckets(reps)
    known = checkpoint(_complete(docs, buckets.select("doc_id").distinct(), size))
    stars = buckets.filter("first < doc_id").groupBy(F.col("first").alias("u"), F.col("doc_id").alias("v")).agg(F.max("n").alias("n"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return checkpoint(_confirmed(_near(pairs, reps, percent), known, percent))

    links = confirmed(checkpoint(stars))
    labels = components(links)
    named = _mixed_up(buckets, labels)
    largest = _largest(named)
    for nth in itertools.count():  # saves comparisons of large buckets; links are the same without it
        if largest <= BLOCK:
            break
        more = checkpoint(_stars(named, nth))
        found = confirmed(more)
        some = found.count()
        if some:
            links = checkpoint(links.union(found))
            labels = components(links)
            named = _mixed_up(buckets, labels)
            largest = _largest(named)
        if some * 20 < more.count() or not some:
            break
    links = checkpoint(links.union(_across(named, reps, known, percent, True, largest <= BLOCK)))
    labels = components(links)
    if largest > BLOCK:
        named = _mixed_up(buckets, labels)
        labels = components(links.union(_across(named, reps, known, percent, False)))
    # Members of a class are linked by their equal sets.
    labels = labels.withColumnRenamed("id", "rep")
    found = members.join(labels, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` whose id is the least of its component, as in :func:`near_components`; all columns are kept."""
    own = "kept_id" + "_" * max(map(len, docs.columns))
    kept = near_components(docs, key, text, size, percent).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(own)), "left_semi")
