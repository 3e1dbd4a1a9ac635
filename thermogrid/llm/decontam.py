"""Benchmark decontamination: rare word n-gram seeds join passages to items, Smith-Waterman alignment scores them.

Words are runs of letters and digits (any non-ASCII byte counts as a letter), A-Z as a-z. How often each n-gram of the benchmark occurs in the
corpus is counted over all texts. Of every ``stretch`` n-grams in a row of an item the rarest that occurs is a seed (of equal ones that of the least hash), so seeds lie
in every part of an item however often it or parts of it have leaked: a text that shares ``stretch + n - 1`` words in a row with an item (three) holds a
seed of it. Each hit of a seed names a stretch of the text on its diagonal, and touching stretches are joined.
A stretch no part of which holds enough words of the item among others, counted as errors, can't reach ``least_score`` and is left out.
Local alignment of the item with the others, over words, gives a score from 0 to 1 (1: the whole item, word by word). Substituted,
inserted and missing words only lower it. A pair is reported from ``least_score`` on.

A benchmark of up to ``broadcast_words`` words is looked up in memory, in two map-only passes over the texts (counts, then hits). A larger one stays a table: the
texts' n-grams meet its n-grams and then its seeds by joins on the n-gram, those of frequent ones dealt over shares, and hits meet the words of their item and text by
two more. Both ways give the same pairs.

Defined results: null or empty texts and items match nothing; items of fewer words than ``n`` are one seed; repeated
items and rows are each reported; null ids are kept as null; an empty table gives an empty result; texts of any length are taken whole; a
column that has the name of the output is replaced, others are not looked at.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BASE, Table, mix, row_counts, run_hashes, word_bounds, word_hashes
from .support import Store, fresh, pieces, record, ship, small_batches, text_buffers

HIT = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("seeds", T.LongType()),
])


@dataclass(frozen=True)
class DecontamParams:
    n: int = 2
    least_score: float = 0.5
    match: float = 1.0
    mismatch: float = -0.5
    gap: float = -0.5
    slack: int = 8  # words beyond the item's own length on either side of a stretch
    stretch: int = 2  # n-grams of an item in a row of which the rarest is a seed
    broadcast_words: int = 2_000_000  # of the whole benchmark
    share_hits: int = 100_000  # occurrences of a seed that one share of a join takes


GATHERED = 1 << 20  # words of stretches looked up at once

def text_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a string array, and each text's bounds among them."""
    data, bounds = text_buffers(column)
    starts, ends = word_bounds(data, bounds, letters=True)
    return word_hashes(data, starts, ends), row_counts(starts, bounds)


def align(item: np.ndarray, stretches: np.ndarray, lengths: np.ndarray, params: DecontamParams) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each padded row of ``stretches``, as a share of the item's own, and where it ends."""
    rows, width = stretches.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    climb = -params.gap * np.arange(width)
    before = np.zeros((rows, width + 1))
    best, end = np.zeros(rows), np.zeros(rows, np.int64)
    for word in item:
        gain = np.where((stretches == word) & inside, params.match, params.mismatch)
        now = np.maximum(before[:, :-1] + gain, before[:, 1:] + params.gap)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + climb, axis=1) - climb
        now[~inside] = 0
        before[:, 1:] = now
        top = now.argmax(axis=1)
        high = now[np.arange(rows), top]
        better = high > best
        best[better], end[better] = high[better], top[better]
    return best / (params.match * len(item)), end


class Seeds:
    """Seed lookup of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], grams: np.ndarray, item: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, item, grams))
        self.items, self.item, self.at = items, item[order], at[order]
        self.keys, self.first, self.size = np.unique(grams[order], return_index=True, return_counts=True)
        self.table = Table(self.keys)
        self.size_of = np.array([len(w) for _, w in items], np.int64)
        own = _words_of(np.concatenate([w for _, w in items]), np.repeat(np.arange(len(items)), self.size_of)) if items else np.zeros(0, np.uint64)
        self.words = Table(np.unique(own))

    def sizes(self, params: DecontamParams) -> list[int]:
        """Lengths of the n-grams: items of fewer words than ``n`` are n-grams of their own length."""
        return sorted({params.n} | {int(k) for k in np.unique(self.size_of) if 0 < k < params.n})

    def most(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, params: DecontamParams) -> np.ndarray:
        """What an alignment of each stretch can score at most: the greatest sum of a part of it, words of its item counted as matches, others as errors."""
        out = np.zeros(len(item))
        error = max(params.mismatch, params.gap)
        sizes = high - low
        total = np.cumsum(sizes)
        first = 0
        while first < len(item):
            last = max(int(np.searchsorted(total, total[first] - sizes[first] + GATHERED, "right")), first + 1)
            size = sizes[first:last]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(low[first:last], size)
            known = self.words.find(_words_of(words[at], np.repeat(item[first:last], size))) >= 0
            sums = np.concatenate([[0], np.cumsum(np.where(known, params.match, error))])
            # a place before each stretch's first word and one behind each of its words; strides keep minima inside a stretch
            place = np.arange(ends[-1] + len(size)) - np.repeat(np.arange(len(size)), size + 1)
            level = sums[place] - np.repeat(np.arange(len(size)), size + 1) * (4.0 * ends[-1] * (params.match - error) + 1)
            rise = level - np.minimum.accumulate(level)
            out[first:last] = np.maximum.reduceat(rise, np.cumsum(size + 1) - size - 1)
            first = last
        return out


def _words_of(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """One key for a word and an item."""
    return mix(words + (item + 1).astype(np.uint64) * np.uint64(BASE))


def item_grams(items: list[tuple[int, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, position) of all items; one shorter than ``n`` words is one gram of its own length."""
    grams, owner, at = [], [], []
    for i, (_, words) in enumerate(items):
        g = run_hashes(words, min(n, len(words)))
        grams.append(g)
        owner.append(np.full(len(g), i))
        at.append(np.arange(len(g)))
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in ((grams, np.uint64), (owner, np.int64), (at, np.int64)))


def text_grams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay in one text, and where they begin."""
    grams = run_hashes(words, n)
    inside = np.ones(len(grams), bool)
    for back in range(1, n):
        cut = bounds[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(grams))]] = False
    where = np.flatnonzero(inside)
    return grams[where], where


def lookup(words: np.ndarray, bounds: np.ndarray, seeds: Seeds, params: DecontamParams) -> np.ndarray:
    """(text, item, place in all words, place in the item) of every hit, a row each."""
    hits = [np.zeros((4, 0), np.int64)]
    for n in seeds.sizes(params):
        grams, where = text_grams(words, bounds, n)
        place = seeds.table.find(grams)
        found = np.flatnonzero(place >= 0)
        if len(found):
            p, w = place[found], where[found]
            size = seeds.size[p]
            each = np.repeat(np.arange(len(p)), size)
            within = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            slot = seeds.first[p][each] + within
            hits.append(np.stack([np.searchsorted(bounds, w[each], "right") - 1, seeds.item[slot], w[each], seeds.at[slot]]))
    return np.concatenate(hits, axis=1)


def find(words: np.ndarray, bounds: np.ndarray, seeds: Seeds, params: DecontamParams, hits: np.ndarray | None = None) -> list[list[dict]]:
    """The reported pairs of each text, from its hits."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    hits = lookup(words, bounds, seeds, params) if hits is None else hits
    if not hits.shape[1]:
        return out
    row, item, at, inner = hits
    size = seeds.size_of
    low = np.maximum(at - inner - params.slack, bounds[row])
    high = np.minimum(at - inner + size[item] + params.slack, bounds[row + 1])
    order = np.lexsort((low, item, row))
    row, item, low, high = row[order], item[order], low[order], high[order]
    # touching stretches of one text and item become one
    group = np.ones(len(row), bool)
    same = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
    key = np.cumsum(np.concatenate([[True], ~same]))
    reach = np.maximum.accumulate(high + key * (1 << 40)) - key * (1 << 40)
    group[1:] = ~same | (low[1:] > reach[:-1])
    first = np.flatnonzero(group)
    row, item, low = row[first], item[first], low[first]
    high, count = np.maximum.reduceat(high, first), np.diff(np.append(first, len(group)))
    able = seeds.most(words, item, low, high, params) >= params.least_score * params.match * size[item] - 1e-3
    row, item, low, high, count = row[able], item[able], low[able], high[able], count[able]
    best: dict[tuple[int, int], tuple] = {}
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        target = seeds.items[i][1]
        span = 4 * len(target) + 4 * params.slack
        for k in mine:
            starts = [int(low[k])]
            while high[k] - starts[-1] > span:  # long stretches in blocks that overlap by more than an alignment
                starts.append(starts[-1] + span // 2)
            lengths = np.array([min(span, int(high[k]) - s) for s in starts])
            padded = np.zeros((len(starts), int(lengths.max())), np.uint64)
            for r, s in enumerate(starts):
                padded[r, :lengths[r]] = words[s:s + lengths[r]]
            score, end = align(target, padded, lengths, params)
            r = int(score.argmax())
            if score[r] >= params.least_score:
                pair, last = (int(row[k]), int(i)), starts[r] + int(end[r]) - int(bounds[row[k]])
                if pair not in best or score[r] > best[pair][0]:
                    best[pair] = (float(score[r]), last, int(count[k]))
    for (r, i), (score, last, n) in sorted(best.items()):
        out[r].append({"item_id": seeds.items[i][0], "score": score, "first_word": max(0, last + 1 - len(seeds.items[i][1])), "last_word": last, "seeds": n})
    return out


def _items(benchmark: DataFrame, text: str, item: str, store: Store) -> DataFrame:
    """``(number, item, words)`` of every item that has words; a table."""
    schema = pa.schema([("item", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in pieces(batches, 1):
            words, bounds = text_words(batch.column(1))
            own = [words[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
            keep = np.flatnonzero(np.diff(bounds) > 0)
            yield record(schema, batch.column(0).take(pa.array(keep)), pa.array([own[i] for i in keep], pa.binary()))

    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    return store.put(rows.mapInArrow(run, "item bigint, words binary").withColumn("number", F.monotonically_increasing_id()))


def _grams(items: DataFrame, n: int, store: Store) -> DataFrame:
    """``(gram, number, at)`` of every n-gram of every item; a table."""
    schema = pa.schema([("gram", pa.int64()), ("number", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in batches:
            own = [(None, np.frombuffer(w, np.uint64)) for w in batch.column(1).to_pylist()]
            grams, owner, at = item_grams(own, n)
            yield record(schema, grams.view(np.int64), batch.column(0).to_numpy()[owner], at)

    return store.put(items.select("number", "words").mapInArrow(run, "gram bigint, number bigint, at bigint"))


def _sizes(items: DataFrame, params: DecontamParams) -> list[int]:
    few = items.select((F.octet_length("words") / 8).cast("int").alias("size")).where(F.col("size") < params.n).distinct()
    return sorted({params.n, *[r["size"] for r in few.collect()]})  # at most n different ones


def text_gram_rows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``(gram, row, at)`` of every n-gram of ``texts(row, text)``."""
    schema = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in pieces(batches, 1):
            words, bounds = text_words(batch.column(1))
            ids = batch.column(0).to_numpy()
            for n in sizes:
                grams, where = text_grams(words, bounds, n)
                owner = np.searchsorted(bounds, where, "right") - 1
                yield record(schema, grams.view(np.int64), ids[owner], where - bounds[owner])

    return texts.mapInArrow(run, "gram bigint, row bigint, at bigint")


def _counts(docs: DataFrame, text: str, grams: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``(gram, n)``: how often each n-gram of the benchmark occurs in the texts; those that don't are left out."""
    spark = docs.sparkSession
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    wanted = grams.select("gram").distinct()
    texts = docs.select(F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()).view(np.uint64)) if small else None

    def run(batches):
        keys = Table(shared.value) if shared else None
        seen = np.zeros(len(shared.value), np.int64) if shared else None
        for batch in pieces(batches, 0):
            words, bounds = text_words(batch.column(0))
            for n in sizes:
                found = text_grams(words, bounds, n)[0]
                if keys is None:
                    yield record(schema, *(x.view(np.int64) for x in np.unique(found, return_counts=True)))
                else:
                    place = keys.find(found)
                    seen += np.bincount(place[place >= 0], minlength=len(seen))
        if keys is not None:
            some = np.flatnonzero(seen)
            yield record(schema, shared.value[some].view(np.int64), seen[some])

    found = texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return found if small else found.join(wanted, "gram", "left_semi")


def rarest(counts: np.ndarray, grams: np.ndarray, stretch: int) -> np.ndarray:
    """Places of the seeds of an item: of every ``stretch`` n-grams in a row the rarest that occurs, of equal ones the least hash."""
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, counts, counts == 0))] = np.arange(len(grams))
    if len(grams) <= stretch:
        return np.array([int(np.argmin(rank))])
    windows = np.lib.stride_tricks.sliding_window_view(rank, stretch)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def choose_seeds(grams: DataFrame, counts: DataFrame, store: Store, params: DecontamParams) -> DataFrame:
    """``(gram, number, at, n)``: the seeds of each item and how often they occur; those that occur nowhere are left out. A table."""
    schema = pa.schema([("gram", pa.int64()), ("number", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, parts = None, []

        def done():
            gram, at, n = (np.concatenate(p) for p in zip(*parts))
            keep = rarest(n, gram.view(np.uint64), params.stretch)
            keep = keep[n[keep] > 0]
            return record(schema, gram[keep], np.full(len(keep), held), at[keep], n[keep])

        for batch in batches:
            gram, number, at, n = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(number[1:] != number[:-1]) + 1
            for first, last in zip([0, *cuts], [*cuts, len(number)]):
                if first == last:
                    continue
                if parts and number[first] != held:
                    yield done()
                    parts = []
                held = number[first]
                parts.append((gram[first:last], at[first:last], n[first:last]))
        if parts:
            yield done()

    told = grams.join(counts, "gram", "left").select("gram", "number", "at", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return store.put(told.repartition("number").sortWithinPartitions("number", "at").mapInArrow(run, "gram bigint, number bigint, at bigint, n bigint"))


def contaminate(docs: DataFrame, benchmark: DataFrame, hits: str = "hits", text: str = "text", item_text: str = "text", item_id: str = "item_id", params: DecontamParams = DecontamParams(), store: Store | None = None) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each text."""
    spark = small_batches(docs.sparkSession)
    store = store or Store(spark)
    items = _items(benchmark, item_text, item_id, store)
    total = items.agg((F.sum(F.octet_length("words")) / 8).cast("long").alias("words")).first()["words"] or 0
    if not total:
        return docs.withColumn(hits, F.array().cast(T.ArrayType(HIT)))
    small, sizes = total <= params.broadcast_words, _sizes(items, params)
    grams = _grams(items, params.n, store)
    seeds = choose_seeds(grams, _counts(docs, text, grams, sizes, small), store, params)
    return (_in_memory if small else _by_joins)(docs, text, hits, items, seeds, sizes, params, store)


def _output(docs: DataFrame, hits: str) -> list[T.StructField]:
    return [f for f in docs.schema.fields if f.name.lower() != hits.lower()]


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("seeds", pa.int64())]))


def _in_memory(docs: DataFrame, text: str, hits: str, items: DataFrame, seeds: DataFrame, sizes: list[int], params: DecontamParams, store: Store) -> DataFrame:
    """Items and seeds, of which the caller has checked the size, in every task; the texts are not moved."""
    held = items.orderBy("item", "words", "number").toArrow()
    order = {n: i for i, n in enumerate(held.column("number").to_pylist())}
    own = [(i, np.frombuffer(w, np.uint64)) for i, w in zip(held.column("item").to_pylist(), held.column("words").to_pylist())]
    gram, number, place, _ = (c.to_numpy() for c in seeds.toArrow().columns)
    shared = docs.sparkSession.sparkContext.broadcast((own, gram.view(np.uint64), np.array([order[n] for n in number.tolist()], np.int64), place))
    kept, at = _output(docs, hits), docs.columns.index(text)
    stay = [i for i, c in enumerate(docs.columns) if c.lower() != hits.lower()]

    def scan(batches):
        known = Seeds(*shared.value)
        for batch in pieces(batches, at):
            words, bounds = text_words(batch.column(at))
            found = find(words, bounds, known, params)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), pa.array(found, KIND)], names=[*(kept[k].name for k in range(len(stay))), hits])

    return docs.mapInArrow(scan, T.StructType([*kept, T.StructField(hits, T.ArrayType(HIT))]))


def _by_joins(docs: DataFrame, text: str, hits: str, items: DataFrame, seeds: DataFrame, sizes: list[int], params: DecontamParams, store: Store) -> DataFrame:
    """Seeds as a table: n-grams of texts meet them by a join, hits meet their item's words, then their text."""
    kept, row = _output(docs, hits), fresh(docs, "row")
    filed = store.put(docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields], F.monotonically_increasing_id().alias(row)))
    texts = filed.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    shares = store.put(seeds.groupBy("gram").agg((F.floor(F.max("n") / params.share_hits) + 1).cast("int").alias("shares")))
    often = store.put(shares.where("shares > 1"))
    spread = text_gram_rows(texts, sizes).join(often, "gram", "left").select(
        "gram", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("shares"))).cast("int").alias("share"), "row", F.col("at").alias("place"))
    dealt = seeds.join(shares, "gram").select("gram", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "number", "at")
    met = spread.join(dealt, ["gram", "share"]).select("row", "number", "place", "at")
    named = met.join(items, "number").select("row", "number", "item", "place", "at", "words")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    both = texts.select("row", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("place"),
                        F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("words"), "text")
    both = both.join(named.select("row").distinct(), "row", "left_semi").unionByName(
        named.select("row", F.lit(1).alias("kind"), "number", "item", "place", "at", "words", F.lit(None).cast("string").alias("text")))
    schema = pa.schema([("row", pa.int64()), ("found", KIND)])

    def align_all(batches):
        held, words, own, met_at = None, None, {}, []

        def done():
            order = {k: i for i, k in enumerate(sorted(own, key=lambda k: (own[k][0] is not None, own[k][0] or 0, k)))}
            known = Seeds([own[k] for k in order], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = np.array([(0, order[k], place, at) for k, place, at in met_at], np.int64).T
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array(find(words, np.array([0, len(words)]), known, params, rows), KIND)], schema=schema)

        for batch in batches:
            for r, kind, number, item, place, at, raw, i in zip(*(batch.column(k).to_pylist() for k in range(7)), range(batch.num_rows)):
                if kind == 0:
                    if met_at:
                        yield done()
                    held, own, met_at = r, {}, []
                    words = text_words(batch.column(7).slice(i, 1))[0]
                else:
                    own.setdefault(number, (item, np.frombuffer(raw, np.uint64)))
                    met_at.append((number, place, at))
        if met_at:
            yield done()

    found = both.repartition(n, "row").sortWithinPartitions("row", "kind").mapInArrow(align_all, T.StructType([T.StructField("row", T.LongType()), T.StructField("found", T.ArrayType(HIT))]))
    told = store.put(found.where(F.size("found") > 0))
    out = filed.join(told.withColumnRenamed("row", row), row, "left")
    return out.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce("found", F.array().cast(T.ArrayType(HIT))).alias(hits))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", params: DecontamParams = DecontamParams()) -> DataFrame:
    """One row per text and benchmark item found in it."""
    found = contaminate(docs.select(id_col, "text"), benchmark, params=params)
    return found.select(id_col, F.explode("hits").alias("hit")).select(id_col, "hit.*")


ship(sys.modules[__name__])
