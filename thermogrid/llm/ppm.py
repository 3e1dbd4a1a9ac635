"""Language-model scores by prediction by partial matching over bytes, beside a smoothed word-count baseline.

Training counts, over all training texts, how often each byte follows each context of ``order`` bytes; shorter contexts are sums of
these, so one shuffle of distinct (context, byte) counts yields the whole trie. A byte is coded in the longest context that
training has seen. A context of total T and D distinct bytes gives a byte of count c probability c / (T + D) and the escape D / (T + D);
after an escape, bytes of the longer context are excluded from the counts of the next shorter one. As training is static, what
an exclusion leaves is a number for each context, computed once. Below order 0 the bytes never seen share evenly. Each
step's probabilities sum to 1. A text starts in the context of ``order`` line feeds.

The trie is broadcast, so it has a bound: ``max_entries`` for each order, the contexts of smallest totals beyond it left out whole. What is broadcast
is a head, not the model: bytes whose whole context it lacks are handed on, each text's distinct (context, byte) once, and scored from all counts in a
shuffle by the last two bytes of the context. Scores don't depend on the bound.

Word counts have no bound, so they aren't broadcast whole: the most frequent words, at most ``head_words``, are; the other
words of each text are joined with their counts in a shuffle, where no key is frequent.

Defined results: null text counts as empty, of score 0 and one token (the end); rows are scored one by one, repeated or not; null ids are kept,
and count as the empty text where a fold is taken; with no training rows every byte has probability 1/256; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Table, row_counts, row_sums, word_bounds, word_hashes
from .support import Store, pieces, record, ship, small_batches, text_buffers

WORD, GRAM, ROWS = 0, 1, 2
TAIL = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
COUNT = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class PpmParams:
    order: int = 4
    max_entries: int = 2_000_000
    head_words: int = 1_000_000
    block: int = 1 << 20  # bytes whose keys are in memory at once
    flush: int = 1 << 21  # distinct counts that a task gathers before it passes them on


def context_keys(data: np.ndarray, bounds: np.ndarray, order: int, block: int):
    """(first byte, keys): each byte with the ``order`` bytes before it in its text, as one number; blocks of bytes."""
    rows = np.searchsorted(bounds, np.arange(0, len(data), block), "right") - 1
    for first, row in zip(range(0, len(data), block), rows):
        last = min(first + block, len(data))
        keys = data[first:last].astype(np.uint64)
        inner = bounds[row:int(np.searchsorted(bounds, last, "left"))]
        for back in range(1, order + 1):
            low = first - back
            part = np.full(last - first, 10, np.uint8)
            part[max(0, -low):] = data[max(0, low):last - back]
            for b in range(back):  # bytes before a text's start
                at = inner + b - first
                part[at[(at >= 0) & (at < len(part))]] = 10
            keys |= part.astype(np.uint64) << np.uint64(8 * back)
        yield first, keys


class Gather:
    """Distinct keys and their counts, merged now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, times: np.ndarray | None = None) -> None:
        keys, counts = np.unique(keys, return_counts=True) if times is None else (keys, times)
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(where, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64))]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count(train: DataFrame, text: str, params: PpmParams) -> DataFrame:
    """``(kind, key, n)``: counts of words, of (context, byte) and of rows over all of ``train``."""

    def gather(batches):
        words, grams, rows = Gather(), Gather(), 0

        def out(kind, got):
            keys, n = got.merge()
            got.parts, got.size = [], 0
            for s in range(0, len(keys), 1 << 16):
                e = min(s + (1 << 16), len(keys))
                yield record(COUNT, np.full(e - s, kind, np.int8), keys[s:e].view(np.int64), n[s:e].astype(np.int64))

        for batch in pieces(batches):
            data, bounds = text_buffers(batch.column(0))
            rows += batch.num_rows
            starts, ends = word_bounds(data, bounds)
            words.add(word_hashes(data, starts, ends))
            for _, keys in context_keys(data, bounds, params.order, params.block):
                grams.add(keys)
            for kind, got in ((WORD, words), (GRAM, grams)):
                if got.size > params.flush:
                    got.merge()
                    if got.size > params.flush // 2:
                        yield from out(kind, got)
        yield from out(WORD, words)
        yield from out(GRAM, grams)
        yield record(COUNT, np.array([ROWS], np.int8), np.zeros(1, np.int64), np.array([rows], np.int64))

    counted = train.select(text).mapInArrow(gather, "kind tinyint, key bigint, n bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _least_kept(rows: DataFrame, total: str, entries: Column, bound: int) -> int:
    """The least power of two so that rows of at least that total have at most ``bound`` entries."""
    sizes = rows.groupBy(F.floor(F.log2(F.col(total).cast("double"))).cast("int").alias("power")).agg(F.sum(entries).alias("n")).collect()
    left = sum(r["n"] for r in sizes)
    least = 1
    for r in sorted(sizes, key=lambda r: r["power"]):
        if left <= bound:
            break
        left -= r["n"]
        least = 1 << (r["power"] + 1)
    return least


def build_trie(counts: DataFrame, params: PpmParams) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """For each order 0, 1, ...: keys (context and byte) and counts, contexts whole or not at all; and whether all are there."""
    grams = counts.where(F.col("kind") == GRAM)
    levels, least = [], 1
    for order in range(params.order + 1):
        mask = (1 << 8 * (order + 1)) - 1
        level = grams.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n"))
        context = F.shiftrightunsigned("key", 8)
        if order >= 2:
            sizes = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
            least = max(least, _least_kept(sizes, "total", F.col("entries"), params.max_entries))
            if least > 1:
                level = level.withColumn("context", context).join(sizes.where(F.col("total") >= least), "context").select("key", "n")
        got = level.select("key", "n").toArrow()
        keys = got.column("key").to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        levels.append((keys[by], got.column("n").to_numpy()[by].astype(np.float64)))
    return levels, least <= 1


class Trie:
    """Lookup of log10 probabilities. ``levels``: keys and counts by order."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.entries, self.logs, self.contexts, self.plain, self.escape, self.rest, self.far = [], [], [], [], [], [], []
        totals = []
        for order, (keys, n) in enumerate(levels):
            contexts, owner, distinct = np.unique(keys >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(owner, n, len(contexts)) if len(keys) else np.zeros(0)
            full = distinct == 256
            whole = total + np.where(full, 0, distinct)
            self.entries.append(Table(keys))
            self.logs.append(np.log10(n))
            self.contexts.append(Table(contexts))
            self.plain.append(np.log10(whole))
            with np.errstate(divide="ignore"):
                self.escape.append(np.where(full, 0.0, np.log10(distinct / whole)))
            rest, far = np.zeros(len(contexts)), np.zeros(len(contexts))
            if order and len(keys):
                # what the next shorter context has beyond this one's bytes
                up = self.entries[order - 1].find(keys & np.uint64((1 << 8 * order) - 1))
                parent = self.contexts[order - 1].find(contexts & np.uint64((1 << 8 * (order - 1)) - 1))
                taken = np.bincount(owner, levels[order - 1][1][up], len(contexts))
                left, more = totals[order - 1][0][parent] - taken, totals[order - 1][1][parent] - distinct
                none = left < 0.5
                whole = left + np.where(totals[order - 1][1][parent] == 256, 0, more)
                rest = np.log10(np.where(none, 1, whole))
                far = np.where(none | (more <= 0), 0.0, np.log10(np.maximum(more, 1) / np.where(none, 1, whole)))
            self.rest.append(rest)
            self.far.append(far)
            totals.append((total, distinct))
        seen = int(totals[0][1][0]) if len(levels[0][0]) else 0
        self.bottom = -np.log10(256 - seen) if seen < 256 else 0.0
        # the common case in one lookup: the byte is known in its whole context
        top, (keys, _) = self.order, levels[self.order]
        where = self.contexts[top].find(keys >> np.uint64(8))
        self.direct = self.logs[top] - self.plain[top][where]

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context."""
        place = self.entries[self.order].find(keys)
        out = np.zeros(len(keys))
        hit = place >= 0
        out[hit] = self.direct[place[hit]]
        open_ = np.flatnonzero(~hit)
        above = np.full(len(open_), -1)  # place of the context that was escaped from, one order up; -1: none
        for order in range(self.order, -1, -1):
            if not len(open_):
                return out
            own = keys[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            context = self.contexts[order].find(own >> np.uint64(8))
            entry = self.entries[order].find(own)
            known = entry >= 0
            first = above < 0
            base = np.where(first, self.plain[order][np.maximum(context, 0)] if len(self.plain[order]) else 0.0,
                            self.rest[order + 1][np.maximum(above, 0)] if order < self.order and len(self.rest[order + 1]) else 0.0)
            out[open_[known]] += self.logs[order][entry[known]] - base[known]
            miss = ~known
            step = np.where(first, np.where(context >= 0, self.escape[order][np.maximum(context, 0)] if len(self.escape[order]) else 0.0, 0.0),
                            self.far[order + 1][np.maximum(above, 0)] if order < self.order and len(self.far[order + 1]) else 0.0)
            out[open_[miss]] += step[miss]
            open_, above = open_[miss], context[miss]
        out[open_] += self.bottom
        return out


def distinct_in_rows(owner: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    """Each row's distinct values, with how often it has them."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(value)))
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner[at], np.arange(rows + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(value[at].view(np.int64)), pa.array(times, pa.int64())], ["key", "n"])).cast(TAIL)


def score_texts(column, trie: Trie, whole: bool, params: PpmParams) -> tuple[np.ndarray, pa.Array]:
    """log10 probability of each text of a string array; without the bytes, given by text, whose context the trie lacks though training may have it."""
    data, bounds = text_buffers(column)
    out = np.zeros(len(bounds) - 1)
    owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, keys in context_keys(data, bounds, params.order, params.block):
        logs = trie.score(keys)
        if not whole:
            far = np.flatnonzero(trie.contexts[trie.order].find(keys >> np.uint64(8)) < 0)
            logs[far] = 0
            owners.append(np.searchsorted(bounds, far + first, "right") - 1)
            values.append(keys[far])
        cuts = np.clip(bounds - first, 0, len(keys))
        out += row_sums(logs, cuts)
    return out, distinct_in_rows(np.concatenate(owners), np.concatenate(values), len(out))


def score_keys(counts: DataFrame, asked: DataFrame, shared, params: PpmParams) -> DataFrame:
    """``(key, log)`` of each distinct ``asked(key)`` from all counts. Keys and counts that share the last two bytes of the context meet, as all contexts of
    order 2 and more that a key may be coded in do; those of orders 0 and 1 are whole in the broadcast trie."""
    part = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("part")
    both = counts.where(F.col("kind") == GRAM).select(part, "key", "n").unionByName(asked.select("key").distinct().select(part, "key", F.lit(0).cast("long").alias("n")))
    n = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = pa.schema([("key", pa.int64()), ("log", pa.float64())])

    def answer(keys, n):
        grams, wanted = (keys[n > 0], n[n > 0].astype(np.float64)), keys[n == 0]
        if not len(wanted):
            return
        levels = list(shared.value[0][:2])
        for order in range(2, params.order + 1):
            own, where = np.unique(grams[0] & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            levels.append((own, np.bincount(where, grams[1], len(own))))
        trie = Trie(levels)
        for s in range(0, len(wanted), 1 << 16):
            some = wanted[s:s + (1 << 16)]
            yield record(schema, some.view(np.int64), trie.score(some))

    def run(batches):
        """Parts follow one another; many small ones are answered at once."""
        held, size = [], 0
        for batch in batches:
            parts, keys, n = (c.to_numpy() for c in batch.columns)
            held.append((parts, keys.view(np.uint64), n))
            size += len(keys)
            if size >= params.flush:
                parts, keys, n = (np.concatenate(c) for c in zip(*held))
                end = int(np.searchsorted(parts, parts[-1]))  # the last part may go on
                yield from answer(keys[:end], n[:end])
                held, size = [(parts[end:], keys[end:], n[end:])], 0
        if held:
            yield from answer(*[np.concatenate(c) for c in zip(*held)][1:])

    return both.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "key bigint, log double")


def score(docs: DataFrame, held_out: Column, store: Store, id_col: str = "doc_id", text: str = "text", params: PpmParams = PpmParams()) -> DataFrame:
    """Scores of all ``docs`` by a model of those that aren't ``held_out``; see the module for columns and cases."""
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    counts = store.put(count(rows.where("not held"), "text", params))
    words = counts.where(F.col("kind") == WORD)
    size = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    sizes = {r["kind"]: (r["n"], r["distinct"]) for r in size}
    ends = sizes.get(ROWS, (0, 0))[0]
    total = sizes.get(WORD, (0, 0))[0] + ends
    distinct = sizes.get(WORD, (0, 0))[1] + (ends > 0)
    least = _least_kept(words, "n", F.lit(1), params.head_words)
    head = words.where(F.col("n") >= least).select("key", "n").toArrow()
    levels, whole = build_trie(counts, params)
    shared = spark.sparkContext.broadcast((
        levels, head.column("key").to_numpy().astype(np.int64).view(np.uint64), np.log10(head.column("n").to_numpy() + 1.0)))

    def run(batches):
        tables = shared.value
        levels, keys, logs = tables
        trie, known = Trie(levels), Table(keys)
        schema = pa.schema([("row", pa.int64()), ("id", batch_type[0]), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", TAIL), ("far", TAIL)])
        for batch in pieces(batches, 3):
            data, bounds = text_buffers(batch.column(3))
            starts, ends_ = word_bounds(data, bounds)
            hashes = word_hashes(data, starts, ends_)
            cuts = row_counts(starts, bounds)
            place = known.find(hashes)
            hit = place >= 0
            logsum = np.zeros(len(hashes))
            logsum[hit] = logs[place[hit]]
            # the other words of each text, each once
            far = np.flatnonzero(~hit)
            tails = distinct_in_rows(np.searchsorted(cuts, far, "right") - 1, hashes[far], batch.num_rows)
            scores, grams = score_texts(batch.column(3), trie, whole, params)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cuts) + 1, pa.int64()), pa.array(row_sums(hit, cuts), pa.int64()),
                pa.array(row_sums(logsum, cuts)), pa.array(scores), tails, grams], names=schema.names)

    kind = rows.schema["id"].dataType
    batch_type = [pa.int64() if isinstance(kind, T.LongType) else pa.string()]
    made = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("held", T.BooleanType())]).simpleString()[7:-1].replace(":", " ")
    main = store.put(rows.select(F.monotonically_increasing_id().alias("row"), "id", "held", "text").mapInArrow(
        run, f"{made}, n_tokens bigint, n_known bigint, base double, score double, tail array<struct<key:bigint,n:bigint>>, far array<struct<key:bigint,n:bigint>>"))
    rare = main.select("row", F.explode("tail").alias("word")).select("row", "word.key", F.col("word.n").alias("times"))
    met = rare.join(words.where(F.col("n") < least).select("key", "n"), "key").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end = F.lit(float(np.log10(ends + 1.0)))
    out = main.drop("tail", "far").join(met, "row", "left")
    if not whole:
        asked = main.select("row", F.explode("far").alias("gram")).select("row", "gram.key", F.col("gram.n").alias("times"))
        logs = asked.join(store.put(score_keys(counts, asked, shared, params)), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("far"))
        out = out.join(logs, "row", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0)))
    return out.select(
        "id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") + end - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"), "score")


ship(sys.modules[__name__])
