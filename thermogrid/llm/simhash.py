"""SimHash near-duplicates: fingerprints, and links by a generalised pigeonhole index.

A fingerprint is the majority of the bits of the XXH64 hashes of a text's word shingles. Fingerprints that differ in at most
``radius`` bits are linked. The index deals the 64 bits into groups of correlated bits and gives group i a
threshold t_i >= -1, with sum(t_i + 1) = radius + 1: two fingerprints within ``radius`` then differ in at most
t_i bits in some group. Thresholds come from dynamic programming over what each costs, that is the probes it needs and the
candidate pairs it lets through, estimated on a bounded sample of fingerprints. Each fingerprint is filed under
its value in every group and asks for all values within the group's threshold; asked and filed meet in buckets,
where all pairs are verified. From a bucket comes a spanning set of its links, not all pairs, so that a large group of copies
costs rows in proportion to its size.

Exact copies share a fingerprint and meet once. Defined results: null or wordless text has fingerprint 0 and is linked
like any other; repeated rows are copies; null ids sort last, so a group's id is null only if all its ids are; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import word_bounds
from .support import Store, fresh, pieces, record, ship, small_batches, text_buffers

SEED = 42
BITS = 64


@dataclass(frozen=True)
class SimHashParams:
    words: int = 4
    radius: int = 4
    group_counts: tuple[int, ...] = (2, 3, 4, 5)
    sample: int = 20_000  # fingerprints from which correlations and costs are estimated
    probe_cost: float = 12.0  # one probe against one verified candidate pair


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    out = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first:first + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def shingle_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, n: int, block: int = 1 << 14):
    """XXH64 of the space-joined runs of ``n`` words, block by block; fewer words count as one run."""
    digest = xxhash.xxh64_intdigest
    size = len(starts)
    if size <= n:
        if size:
            yield np.array([digest(b" ".join([text[s:e] for s, e in zip(starts, ends)]), SEED)], np.uint64)
        return
    for first in range(0, size - n + 1, block):
        last = min(first + block, size - n + 1)
        s, e = starts[first:last + n - 1], ends[first:last + n - 1]
        lengths = e - s
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        plain = bool((s[1:] == e[:-1] + 1).all()) and b"\n" not in (part := text[s[0]:e[-1]]) and b"\t" not in part and b"\r" not in part and b"\x0b" not in part and b"\x0c" not in part
        joined = part if plain else b" ".join([text[a:b] for a, b in zip(s.tolist(), e.tolist())])
        low, high = at[:last - first].tolist(), (at[n:n + last - first] - 1).tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(low, high)), np.uint64, last - first)


def fingerprints(column, words: int = 4) -> np.ndarray:
    """Fingerprint of each text of a string array."""
    data, bounds = text_buffers(column)
    lower = bytes(data).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    starts, ends = word_bounds(data, bounds)
    rows = np.searchsorted(starts, bounds)
    out = np.zeros(len(bounds) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i in range(len(out)):
        counts, n = np.zeros(BITS, np.int64), 0
        for hashes in shingle_hashes(lower, starts[rows[i]:rows[i + 1]], ends[rows[i]:rows[i + 1]], words):
            counts += bit_counts(hashes)
            n += len(hashes)
        out[i] = weights[2 * counts > n].sum(dtype=np.uint64)
    return out


def fingerprint(df: DataFrame, name: str = "fingerprint", text: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """``df`` with the fingerprint of each text as a long in place of the text. No shuffle."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)
    rest = [f for f in df.schema.fields if f.name != text]
    schema = type(df.schema)([*rest, *df.sparkSession.range(0).withColumnRenamed("id", name).schema.fields])

    def run(batches):
        for batch in pieces(batches, at):
            made = fingerprints(batch.column(at), params.words).view(np.int64)
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(made)], names=[*(n for n, _ in kept), name])

    return df.mapInArrow(run, schema)


def group_bits(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Deal the bits into groups of near-equal size, correlated bits together, so that the groups vary freely of each other."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    unit = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tie = np.abs(unit.T @ unit) / max(len(bits), 1)
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        out.append(sorted(group))
    return out


def extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` bits among ``width``."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], np.uint64)


def plan(sample: np.ndarray, total: int, params: SimHashParams) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of least estimated cost for ``total`` fingerprints."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    rng = np.random.default_rng(1)
    pairs = min(200_000, len(sample) ** 2)
    left, right = (sample[rng.integers(0, len(sample), pairs)] for _ in range(2)) if len(sample) else (sample, sample)
    best = None
    for m in params.group_counts:
        if m > params.radius + 1:
            continue
        groups = group_bits(sample, m)
        cost = []
        for bits in groups:
            gap = np.bitwise_count(extract(left, bits) ^ extract(right, bits))
            row = [0.0]
            for t in range(params.radius + 1):
                # a threshold's candidates: pairs so close in the group, and never fewer than random bits would give
                near = max(float((gap <= t).mean()) if len(gap) else 0.0, len(ball(len(bits), t)) / 2.0 ** len(bits))
                row.append(params.probe_cost * total * (1 + len(ball(len(bits), t))) + near * total * total)
            cost.append(row)
        # least[s]: least cost of the groups so far whose (t + 1) add up to s
        least = {0: (0.0, [])}
        for row in cost:
            nxt = {}
            for s, (c, path) in least.items():
                for used, extra in enumerate(row[:params.radius + 2 - s]):
                    if s + used not in nxt or c + extra < nxt[s + used][0]:
                        nxt[s + used] = (c + extra, [*path, used - 1])
            least = nxt
        got = least[params.radius + 1]
        if best is None or got[0] < best[0]:
            best = (got[0], groups, got[1])
    return best[1], best[2]


def bucket_links(filed: np.ndarray, asked: np.ndarray, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links that span, in each bucket, what its links connect: asked against filed, verified block by block."""
    values = np.unique(np.concatenate([filed, asked]))
    if len(values) < 2:
        return values[:0], values[:0]
    parent = np.arange(len(values))
    filed, asked = np.searchsorted(values, np.unique(filed)), np.searchsorted(values, np.unique(asked))
    a, b = [], []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(asked), block):
        for j in range(0, len(filed), block):
            p, q = asked[i:i + block], filed[j:j + block]
            near = np.bitwise_count(values[p][:, None] ^ values[q][None, :]) <= radius
            for x, y in zip(*np.nonzero(near)):
                x, y = root(int(p[x])), root(int(q[y]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(x)
                    b.append(y)
    return values[np.array(a, np.int64)], values[np.array(b, np.int64)]


def link_fingerprints(distinct: DataFrame, store: Store, params: SimHashParams = SimHashParams(), name: str = "fingerprint") -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within the radius; ``distinct`` has each fingerprint once."""
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.select(name).orderBy(F.xxhash64(name), name).limit(params.sample).collect()], np.int64).view(np.uint64)
    groups, thresholds = plan(sample, total, params)
    used = [(g, bits, ball(len(bits), t)) for g, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def file(batches):
        schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("asks", pa.bool_()), ("value", pa.int64())])
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, bits, masks in used:
                keys = extract(values, bits)
                for asks, each in ((False, masks[:1]), (True, masks)):
                    n = len(values) * len(each)
                    yield record(schema, np.full(n, g, np.int32), (keys[:, None] ^ each[None, :]).ravel().view(np.int64), np.full(n, asks), np.repeat(values, len(each)).view(np.int64))

    def meet(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held, last = [], None

        def links(columns):
            part, key, asks, value = (np.concatenate(c) for c in zip(*columns))
            edge = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            edge = np.concatenate([[0], edge, [len(key)]])
            a, b = [], []
            sizes = np.diff(edge)
            for k in np.flatnonzero(sizes > 1):
                s, e = edge[k], edge[k + 1]
                mine = asks[s:e]
                if mine.all() or e - s == 2 and value[s] == value[s + 1]:
                    continue
                x, y = bucket_links(value[s:e][~mine], value[s:e][mine], params.radius)
                a.append(x)
                b.append(y)
            if a:
                return record(schema, np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            return record(schema, np.zeros(0, np.int64), np.zeros(0, np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            part, key, asks, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            value = value.view(np.uint64)
            own = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            cut = int(own[-1]) + 1 if len(own) else 0  # the last bucket may go on in the next batch
            if cut:
                yield links([*held, (part[:cut], key[:cut], asks[:cut], value[:cut])])
                held = []
            elif held and last != (part[0], key[0]):
                yield links(held)
                held = []
            held.append((part[cut:], key[cut:], asks[cut:], value[cut:]))
            last = (part[-1], key[-1])
        if held:
            yield links(held)

    spark = distinct.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    filed = distinct.select(name).mapInArrow(file, "part int, key bigint, asks boolean, value bigint")
    dealt = filed.repartition(n, "part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(meet, "a bigint, b bigint").where("a is not null")


def near_duplicates(df: DataFrame, store: Store, text: str = "text", id_col: str = "doc_id", params: SimHashParams = SimHashParams()) -> DataFrame:
    """``(id, fingerprint long, component_id)`` for every row: the smallest id that links lead to."""
    rows = store.put(fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), params=params))
    return attach_components(rows, store, params)


def attach_components(rows: DataFrame, store: Store, params: SimHashParams = SimHashParams(), keep: str = "min(id)") -> DataFrame:
    """``rows(fingerprint, id, ...)`` with ``component_id``. Rows of one fingerprint are counted in one row before they are linked."""
    distinct = store.put(rows.groupBy("fingerprint").agg(F.expr(keep).alias("least")))
    edges = store.put(link_fingerprints(distinct, store, params))
    labels = components(edges, store).withColumnRenamed("node", "fingerprint")
    named = distinct.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fingerprint", "label").join(tops, "label").select("fingerprint", "component_id"), "fingerprint")


def hex_text(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, store: Store, text: str = "text", id_col: str = "doc_id", params: SimHashParams = SimHashParams()) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, the first in content order among equals; columns as given."""
    at, mark = fresh(docs, "row"), fresh(docs, "first")
    numbered = store.put(docs.withColumn(at, F.monotonically_increasing_id()))
    rows = fingerprint(numbered.select(F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("y"), F.col(at).alias("z")).alias("id"), F.col(text).alias("text")), params=params)
    out = attach_components(store.put(rows), store, params)
    kept = out.groupBy("component_id").agg(F.min("id").alias("id")).select(F.col("id.z").alias(at))
    return numbered.join(kept, at, "left_semi").drop(at)


ship(sys.modules[__name__])
