"""Spelling variants by PartEnum signatures.

Words of a text are runs of letters; those frequent enough are the vocabulary. A word's letter multiset is a binary vector: dimension (letter, k)
is set if the letter occurs more than k times. A word with one letter more or less has distance one, one with a replaced letter distance
two at most. PartEnum: dimensions are dealt over ``parts`` partitions of like load; two vectors at distance two or less agree on all but two of
them, so each word gets a signature for every choice of ``parts - 2`` partitions, the choice and what the vector holds there. Words
with an equal signature meet by an equi-join, and are verified letter by letter: exactly one inserted, deleted or replaced code point.

A word's vector is packed as one 60-bit number, a field (a hash of what is set) for each partition, so a signature is that number with two fields cleared.
Fields of two words tell which partitions differ; a pair is reported only under the first choice that leaves those out, so it
is found once and no distinct is needed. Words that differ by one code point also share their first or their last letters, so in a bucket
only words that agree there are compared. Signatures of more than ``bucket`` words are cut into blocks, whose pairs are dealt over tasks; every
pair of words still meets.

A word's form is its most frequent near word, if that is ``times`` as frequent; roots come by doubling along forms, whose counts grow ``times`` fold a
step, so some rounds are enough.

Defined results: null and empty texts have no word; a null id counts as an empty one; rows that repeat count each; words of equal counts are ranked
in code-point order; an empty table gives an empty result; texts and words of any length are taken whole; columns other than those
named are not looked at.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, U, mix
from .support import Store, record, ship, small_batches

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = 60  # bits of a packed vector; the number of the choice takes the other four
PAIR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


@dataclass(frozen=True)
class SpellingParams:
    least_length: int = 7
    least_count: int = 2
    times: int = 10
    parts: int = 5
    dealt: int = 4096  # most frequent dimensions that are dealt by load; others by hash
    bucket: int = 4096  # words of a signature that one task compares with one another
    pairs: int = 1 << 18  # pairs of words looked at at once
    slab: int = 1 << 23  # letters compared at once
    rounds: int = 20

    def __post_init__(self):
        if not 3 <= self.parts <= 6:
            raise ValueError("parts: 3 to 6, as choices have four bits")

    @property
    def bits(self) -> int:
        return FIELDS // self.parts

    @property
    def affix(self) -> int:
        """Words at one edit share this many first or last letters: all but one of the shorter word's are shared, on two sides."""
        return max((self.least_length - 1) // 2, 0)


def choices(parts: int) -> list[tuple[int, ...]]:
    """The two partitions that each choice leaves out."""
    return list(itertools.combinations(range(parts), 2))


def masks(params: SpellingParams) -> np.ndarray:
    """For each choice the bits of a packed vector that stay."""
    field = (1 << params.bits) - 1
    return np.array([sum(field << params.bits * p for p in range(params.parts) if p not in out) for out in choices(params.parts)], np.uint64)


def first_choices(params: SpellingParams) -> np.ndarray:
    """For each set of differing partitions, as bits, the first choice that leaves it out; -1 if there are more than two."""
    table = np.full(1 << params.parts, -1, np.int64)
    for differ in range(len(table)):
        for c, out in enumerate(choices(params.parts)):
            if differ & ~sum(1 << p for p in out) == 0:
                table[differ] = c
                break
    return table


def words_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: SpellingParams = SpellingParams(), typo_share: int = 31) -> DataFrame:
    """``(word, n)``: the vocabulary. In one of ``typo_share`` runs, drawn by a checksum of id and run, a letter is left out (0: in none)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    run = f"{LETTERS}{{{params.least_length},}}"  # shorter runs can't become longer
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if typo_share:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        runs = runs.select("word", h.alias("h"))
        at = F.pmod("h", F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        runs = runs.select(F.when(F.col("h") % typo_share == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.length("word") >= params.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= params.least_count)


def letters_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words of a string array, and each word's bounds among them."""
    words = column.to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def dimensions(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set dimensions of all words, a letter's code and its number among its like in the word, and whose they are."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = owner.astype(np.uint64) << U(32) | codes
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return (key & U(0xFFFFFFFF)) | (np.arange(len(key)) - start).astype(np.uint64) << U(32), (key >> U(32)).astype(np.int64)


def partition_of_dimensions(words: DataFrame, params: SpellingParams) -> dict[int, int]:
    """The partition of each frequent dimension: the most frequent first, to the partition of least load. Their number is bounded by ``dealt``."""
    schema = pa.schema([("dimension", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            found, n = np.unique(dimensions(*letters_of(batch.column(0)))[0], return_counts=True)
            yield record(schema, found.view(np.int64), n)

    counts = words.select("word").mapInArrow(run, "dimension bigint, n bigint").groupBy("dimension").agg(F.sum("n").alias("n"))
    load, out = [0] * params.parts, {}
    for row in counts.orderBy(F.desc("n"), "dimension").limit(params.dealt).collect():
        at = min(range(params.parts), key=load.__getitem__)
        out[row["dimension"]] = at
        load[at] += row["n"]
    return out


def pack(codes: np.ndarray, bounds: np.ndarray, dealt: tuple[np.ndarray, np.ndarray], params: SpellingParams) -> np.ndarray:
    """Each word's vector as one number: in a field for each partition the hash of the dimensions set there."""
    dims, owner = dimensions(codes, bounds)
    with np.errstate(over="ignore"):
        hashed = mix(dims * U(BASE) + U(1))
        keys, place = dealt
        part = (hashed % U(params.parts)).astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, dims), len(keys) - 1)
            part = np.where(keys[at] == dims, place[at], part)
        sums = np.zeros((len(bounds) - 1, params.parts), np.uint64)
        np.add.at(sums, (owner, part), mix(hashed))
        fields = mix(sums) >> U(64 - params.bits)
        fields[sums == 0] = 0
    out = np.zeros(len(bounds) - 1, np.uint64)
    for p in range(params.parts):
        out |= fields[:, p] << U(params.bits * p)
    return out


def signatures(words: DataFrame, params: SpellingParams) -> DataFrame:
    """``(signature, packed, word, n)``: a row for each word and choice of partitions."""
    found = partition_of_dimensions(words, params)
    keys = np.array(sorted(found), np.int64)
    dealt = keys.view(np.uint64), np.array([found[k] for k in keys.tolist()], np.int64)
    order = np.argsort(dealt[0])
    dealt = dealt[0][order], dealt[1][order]
    stay = masks(params)
    schema = pa.schema([("signature", pa.int64()), ("packed", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = pack(*letters_of(batch.column(0)), dealt, params)
            for c, mask in enumerate(stay):
                yield record(schema, ((packed & mask) | U(c << FIELDS)).view(np.int64), packed.view(np.int64), batch.column(0), batch.column(1))

    return words.select("word", "n").mapInArrow(run, "signature bigint, packed bigint, word string, n bigint")


def one_edit(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether row by row two padded words differ by exactly one inserted, deleted or replaced code point."""
    width = a.shape[1]
    out = np.zeros(len(a), bool)
    same = a_size == b_size
    differ = a != b
    out[same] = differ[same].sum(axis=1) == 1  # padding is equal where lengths are
    for first, second, n, m in ((a, b, a_size, b_size), (b, a, b_size, a_size)):
        rows = np.flatnonzero(n + 1 == m)
        if len(rows):
            upto = differ[rows].argmax(axis=1)  # the longer word's extra letter, or the first that differs
            shifted = first[rows, :width - 1] != second[rows, 1:]
            at = np.arange(width - 1)
            out[rows] = ~(shifted & (at >= upto[:, None]) & (at < n[rows][:, None])).any(axis=1)
    return out


def near_in_buckets(group: np.ndarray, block: np.ndarray, choice: np.ndarray, packed: np.ndarray, codes: np.ndarray, bounds: np.ndarray, params: SpellingParams):
    """Near pairs (places of both words) among rows of whole groups. ``block`` is -1 in groups of one block, else pairs join 0 with 1."""
    sizes = np.diff(bounds)
    first = first_choices(params)
    reach = params.affix
    at = np.arange(reach)
    affixes = []
    for origin in (bounds[:-1], bounds[1:] - reach):
        letters = codes[origin[:, None] + at] if reach else np.zeros((len(sizes), 0), np.uint32)
        key = group.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(reach):
                key = mix(key * U(BASE) + letters[:, k])
        affixes.append(key)
    for side, key in enumerate(affixes):
        order = np.lexsort((sizes, key))
        sorted_key, sorted_size = key[order], sizes[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        ends = np.append(starts[1:], len(order))
        run = np.repeat(np.arange(len(starts)), ends - starts)
        # lengths rise within a run: partners are the rows behind up to those one letter longer
        spread = (run.astype(np.int64) << 32) + sorted_size
        last = np.searchsorted(spread, spread + 1, "right")
        partners = last - np.arange(len(order)) - 1
        total = np.concatenate([[0], np.cumsum(partners)])
        begin = 0
        while begin < len(order):
            stop = max(int(np.searchsorted(total, total[begin] + params.pairs, "right")) - 1, begin + 1)
            mine = np.repeat(np.arange(begin, stop), partners[begin:stop])
            theirs = np.arange(len(mine)) - np.repeat(total[begin:stop] - total[begin], partners[begin:stop]) + mine + 1
            a, b = order[mine], order[theirs]
            begin = stop
            differ = packed[a] ^ packed[b]
            parts = np.zeros(len(a), np.int64)
            for p in range(params.parts):
                parts |= ((differ >> U(params.bits * p)) & U((1 << params.bits) - 1) != 0).astype(np.int64) << p
            good = (first[parts] == choice[a]) & (group[a] == group[b]) & ((block[a] < 0) | (block[a] != block[b]))
            if side:
                good &= affixes[0][a] != affixes[0][b]
            a, b = a[good], b[good]
            while len(a):
                width = int(max(sizes[a].max(), sizes[b].max())) + 1
                some = max(params.slab // width, 1)
                if some < len(a):  # long words in the slab: fewer rows, which then may be narrower
                    some = min(some, max(len(a) // 2, 1))
                x, y = a[:some], b[:some]
                width = int(max(sizes[x].max(), sizes[y].max())) + 1
                near = one_edit(_padded(codes, bounds, x, width), _padded(codes, bounds, y, width), sizes[x], sizes[y])
                yield x[near], y[near]
                a, b = a[some:], b[some:]


def _padded(codes: np.ndarray, bounds: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    at = bounds[rows][:, None] + np.arange(width)
    return np.where(at < bounds[rows + 1][:, None], codes[np.minimum(at, len(codes) - 1)], 0)


def near_words(words: DataFrame, store: Store, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(word, other, other_n)``: every near word of every word of ``words(word, n)``, both ways. Shorter words than ``least_length`` are left out."""
    spark = small_batches(words.sparkSession)
    words = words.where(F.length("word") >= params.least_length)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    filed = store.put(signatures(words, params))
    wide = store.put(filed.groupBy("signature").agg(F.count("*").alias("size")).where(F.col("size") > params.bucket))
    cut = filed.join(wide, "signature", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / params.bucket).cast("int"), F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = cut.select("signature", "packed", "word", "n", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    low, high = F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high")
    # a pair of different blocks compares words across; a block with itself within
    side = F.when(F.col("own") == F.col("to"), -1).when(F.col("own") < F.col("to"), 0).otherwise(1).cast("int").alias("side")
    rows = met.select("signature", low, high, side, "packed", "word", "n").repartition(dealt, "signature", "low", "high").sortWithinPartitions("signature", "low", "high")

    def compare(table: pa.Table):
        signature, lows, highs, side, packed = (table.column(i).to_numpy() for i in range(5))
        change = np.ones(len(signature), bool)
        change[1:] = (signature[1:] != signature[:-1]) | (lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1])
        group = np.cumsum(change) - 1
        size = np.bincount(group)
        some = np.flatnonzero(size[group] > 1)
        if not len(some):
            return
        rows = table.take(pa.array(some))
        group, side, signature = group[some], side[some], signature[some].view(np.uint64)
        codes, bounds = letters_of(rows.column(5))
        for a, b in near_in_buckets(group, side.astype(np.int64), (signature >> U(FIELDS)).astype(np.int64), packed[some].view(np.uint64), codes, bounds, params):
            if len(a):
                both, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                yield pa.RecordBatch.from_arrays([rows.column(5).take(both).combine_chunks(), rows.column(5).take(other).combine_chunks(), rows.column(6).take(other).combine_chunks()], schema=PAIR)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 4 * params.bucket:
                table = pa.Table.from_batches(held)
                keys = [table.column(i).to_numpy() for i in range(3)]
                same = np.logical_and.reduce([k == k[-1] for k in keys])
                whole = int(np.argmax(same))  # rows are in order: the last group may go on in the next batch
                if whole:
                    yield from compare(table.slice(0, whole))
                held, count = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield from compare(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "word string, other string, other_n bigint")


def roots(forms: DataFrame, store: Store, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the end of each word's chain of forms, found by doubling."""
    steps = store.put(forms.select("word", F.col("form").alias("root")))
    for _ in range(params.rounds):
        further = steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = store.put(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        store.drop(steps)
        steps = after
        if steps.where("moved").isEmpty():
            break
    return steps.select("word", "root")


def best_near(near: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)``: the near word of largest count, then first in code-point order."""
    first = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("best")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", "first.best", (-F.col("first.less")).alias("best_n"))


def variants(words: DataFrame, store: Store, params: SpellingParams = SpellingParams()) -> DataFrame:
    """One row for each word of ``words(word, n)``: its form and root, and the counts; ``words`` should be a table."""
    best = best_near(near_words(words, store, params))
    named = words.join(best, "word", "left")
    enough: Column = F.col("best_n") >= params.times * F.col("n")
    named = store.put(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    ends = roots(named.where("form is not null"), store, params)
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ship(sys.modules[__name__])
