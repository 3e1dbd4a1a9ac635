"""Near-duplicate vectors by NN-descent.

Vectors of equal components meet once. A first neighbour graph comes from random projections: each of ``tables`` tables
sorts the vectors by the signs of random hyperplanes and compares runs of ``run`` neighbours in that order, so a hot sign pattern is cut
like any other stretch. The more vectors there are, the less often a table brings two together, so the number of tables grows with them. Then rounds of NN-descent: the vectors on each other's lists are brought
together at each vector that has new list entries, compared with one another, and what is closer than a list's
last entry goes on the list. Rounds stop when few entries change. Lists hold ``neighbours`` entries of at least ``floor``.

All pairs found at the threshold or above are links, also those that no longer fit on a list. A vector whose list is full of
links is saturated: its list is enlarged to the whole component of links it lies in, whose members are compared block by
block, so a group of thousands of near copies yields all its links while the lists stay short; links are counted, not listed.

Recall is audited: vectors drawn by hash, the same number without a link, of small and of large components, are compared with all vectors. The recall of
a vector is the share of its links that the graph has; the audited recall is the mean over vectors with links, and over those with few links if that is
less, each vector weighted by what it stands for, so that a large group doesn't hide lost pairs. Below ``least_recall`` the search is repeated with new tables, whose
links are added; if the recall isn't reached after ``attempts``, the job fails. The measured recall of the search is a column of the result.

What lists, runs and rounds leave out is then found exactly: vectors of different components are compared, all with all, group by group over tasks of bounded memory.
Two components that hold a link between them become one, whose pairs are all counted. This check is quadratic in the distinct vectors.

Cosines are in double precision. Defined results: vectors that are null, zero, or hold null or non-finite components
link with nothing, and neither do vectors of different lengths; repeated rows of one id are vectors of their own that link; null ids never are a component's name unless
all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .support import Store, record, ship, small_batches

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


@dataclass(frozen=True)
class DescentParams:
    threshold: float = 0.9
    neighbours: int = 12
    floor: float = 0.6
    tables: int = 16  # at least; see count_tables
    least_miss: float = 0.005  # chance of an isolated pair at the threshold to meet in no table
    planes: int = 30
    run: int = 256
    rounds: int = 6
    least_change: float = 0.002  # of all list entries
    block: int = 512
    audit: int = 256  # vectors of each kind
    few: int = 16  # links of a vector, or members of a component, that count as few
    least_recall: float = 0.98
    attempts: int = 8
    group_bytes: int = 1 << 24  # of vectors in a group of the exact check; a task holds two
    seed: int = 11


def unit_rows(column) -> np.ndarray:
    """Unit vectors of a binary column of doubles."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def prepare(vectors: DataFrame, store: Store, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``(row, id, node)`` of all rows, ``node`` null for vectors that can't be compared; ``(node, size, copies, unit)`` of the distinct ones."""
    value = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), value.alias("v"))

    def pack(batches):
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("unit", pa.binary())])
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                got = None
                if v and None not in v:
                    array = np.array(v, np.float64)
                    # scaled by a power of two first, so that no square overflows or vanishes
                    if np.isfinite(array).all() and array.any():
                        array = np.ldexp(array, -int(np.frexp(np.abs(array).max())[1]))
                        got = (array / np.linalg.norm(array) + 0.0).tobytes()
                out.append(got)
            yield record(schema, batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out, pa.binary()))

    packed = store.put(rows.mapInArrow(pack, "row bigint, id bigint, unit binary"))
    named = packed.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))
    distinct = named.where("node is not null").groupBy("node", F.octet_length("unit").alias("size")).agg(F.count("*").alias("copies"), F.first("unit").alias("unit"))
    return named.select("row", "id", "node"), store.put(distinct)


def _top(sims: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest values of at least ``floor``, ties by column."""
    k = min(k, sims.shape[1])
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(sims)), k)
    best = best.ravel()
    good = sims[row, best] >= floor
    return row[good], best[good]


def count_tables(total: int, params: DescentParams) -> int:
    """Tables of ``total`` vectors: a pair meets in one if the signs that part it into runs agree, about four fifths of the time as runs also end between the two."""
    agree = 1 - np.arccos(np.clip(params.threshold, -1, 1)) / np.pi
    meet = 0.8 * agree ** max(np.log2(max(total, 1) / params.run), 0)
    return max(params.tables, int(np.ceil(np.log(params.least_miss) / np.log1p(-meet))))


def first_pairs(distinct: DataFrame, params: DescentParams, attempt: int, tables: int) -> DataFrame:
    """Pairs ``(a, b, cosine)`` found by sorting along random projections, table by table; each vector's best in its run."""

    def sign(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ids, units = batch.column(0).to_numpy(), batch.column(2)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = unit_rows(units.take(pa.array(at)))
                for t in range(tables):
                    planes = np.random.default_rng([params.seed, attempt, t, int(size)]).standard_normal((rows.shape[1], params.planes))
                    code = ((rows @ planes) > 0) @ (1 << np.arange(params.planes, dtype=np.int64)[::-1])
                    yield record(schema, np.full(len(at), t, np.int32), np.full(len(at), size, np.int32), code, ids[at], units.take(pa.array(at)))

    schema = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("unit", pa.binary())])

    def compare(held):
        ids = np.array([h[0] for h in held])
        rows = np.frombuffer(b"".join(h[1] for h in held), np.float64).reshape(len(held), -1)
        sims = rows @ rows.T
        np.fill_diagonal(sims, -2)
        i, j = _top(sims, params.neighbours, params.floor)
        return record(PAIRS, ids[i], ids[j], sims[i, j])

    def runs(batches):
        held, key = [], None
        for batch in batches:
            for part, size, node, unit in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (part, size) != key or len(held) >= params.run:
                    if len(held) > 1:
                        yield compare(held)
                    held, key = [], (part, size)
                held.append((node, unit))
        if len(held) > 1:
            yield compare(held)

    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    coded = distinct.select("node", "size", "unit").mapInArrow(sign, "part int, size int, code bigint, node bigint, unit binary")
    dealt = coded.repartitionByRange(n, "part", "size", "code", "node").sortWithinPartitions("part", "size", "code", "node")
    return dealt.mapInArrow(runs, "a bigint, b bigint, cosine double")


def shorten(pairs: DataFrame, k: int) -> DataFrame:
    """Each vector's best ``k`` distinct neighbours, with those that weren't on its list before marked new."""
    distinct = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min("new").alias("new"))
    rank = F.expr("row_number() over (partition by a order by cosine desc, b)")
    return distinct.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def descend(graph: DataFrame, distinct: DataFrame, params: DescentParams) -> DataFrame:
    """New pairs from one round: neighbours, in either direction, of each vector with new entries are compared among themselves."""
    both = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), "cosine", "new").unionByName(
        graph.select(F.col("b").alias("at"), F.col("a").alias("node"), "cosine", "new"))
    both = both.groupBy("at", "node").agg(F.max("cosine").alias("cosine"), F.max("new").alias("new"))
    rank = F.expr("row_number() over (partition by at order by new desc, cosine desc, node)")
    near = both.withColumn("rank", rank).where(F.col("rank") <= 2 * params.neighbours).drop("rank")
    active = near.groupBy("at").agg(F.max("new").alias("any")).where("any = 1").select("at")
    last = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("last")).select(
        F.col("a").alias("node"), F.when(F.col("n") >= params.neighbours, F.col("last")).otherwise(params.floor).alias("last"))
    carried = near.join(active, "at").join(distinct.select("node", "unit"), "node").join(last, "node", "left")
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = carried.select("at", "node", "new", F.coalesce("last", F.lit(params.floor)).alias("last"), "unit").repartition(n, "at").sortWithinPartitions("at")

    def meet(held):
        ids, new, last = (np.array([h[i] for h in held]) for i in (0, 1, 2))
        rows = np.frombuffer(b"".join(h[3] for h in held), np.float64).reshape(len(held), -1)
        sims = rows @ rows.T
        np.fill_diagonal(sims, -2)
        fresh = (new[:, None] | new[None, :]) == 1
        i, j = np.nonzero(fresh & (sims >= params.floor) & (sims > last[:, None]))
        return ids[i], ids[j], sims[i, j]

    def run(batches):
        held, at, out = [], None, []

        def flush():
            if out:
                yield record(PAIRS, *(np.concatenate(c) for c in zip(*out)))
                out.clear()

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if len(held) > 1:
                        out.append(meet(held))
                    held, at = [], key
                held.append(row)
            yield from flush()
        if len(held) > 1:
            out.append(meet(held))
        yield from flush()

    return dealt.mapInArrow(run, "a bigint, b bigint, cosine double")


def count_within(members: DataFrame, params: DescentParams) -> DataFrame:
    """``(node, n_links)`` over all members of each component: pairs of blocks, one task each, counted in place."""
    sized = members.join(members.groupBy("label").agg((F.floor((F.count("*") - 1) / params.block) + 1).cast("int").alias("blocks")), "label")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    mine = sized.withColumn("block", block)
    # each block meets every block of its component: as the first of the pair, or as the second
    left = mine.select("label", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"), "node", "copies", "unit")
    right = mine.where("blocks > 1").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "node", "copies", "unit").where("x <> y")
    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = left.unionByName(right).repartition(n, "label", "x", "y").sortWithinPartitions("label", "x", "y", "side")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def count(held):
        ids, copies, side = (np.array([h[i] for h in held]) for i in (1, 2, 0))
        rows = np.frombuffer(b"".join(h[3] for h in held), np.float64).reshape(len(held), -1)
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(other):
            other = own
        out = np.zeros(len(own), np.int64)
        for s in range(0, len(other), 4096):
            part = other[s:s + 4096]
            near = rows[own] @ rows[part].T >= params.threshold
            near &= ids[own][:, None] != ids[part][None, :]
            out += near @ copies[part]
        return record(schema, ids[own], out)

    def run(batches):
        held, key = [], None
        for batch in batches:
            for label, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, x, y) != key:
                    if held:
                        yield count(held)
                    held, key = [], (label, x, y)
                held.append(row)
        if held:
            yield count(held)

    return dealt.mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n_links"))


def audit(distinct: DataFrame, labels: DataFrame, store: Store, params: DescentParams) -> float:
    """Recall of links, by drawn vectors against all vectors; a link is found if both ends are in one component, whose pairs are all compared."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    kind = F.when(F.col("members").isNull(), 0).when(F.col("members") <= params.few, 1).otherwise(2).alias("kind")
    all_rows = store.put(distinct.join(labels.join(sizes, "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"), "size", "unit", kind))
    totals = {r["kind"]: r["n"] for r in all_rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    drawn = [all_rows.where(F.col("kind") == k).orderBy(F.xxhash64("node", F.lit(params.seed)), "node").limit(params.audit).select("node", "label", "unit").toArrow() for k in totals]
    weights = np.concatenate([np.full(d.num_rows, n / max(d.num_rows, 1)) for d, n in zip(drawn, totals.values())] + [np.zeros(0)])
    if not len(weights):
        return 1.0
    asked = pa.concat_tables(drawn)
    shared = distinct.sparkSession.sparkContext.broadcast((asked.column("node").to_numpy(), asked.column("label").to_numpy(), asked.column("unit").to_pylist()))
    least = params.threshold + 1e-12  # what rounding decides isn't asked for

    def run(batches):
        ids, tops, units = shared.value
        found, there = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            for size in np.unique(batch.column(2).to_numpy()):
                at = np.flatnonzero(batch.column(2).to_numpy() == size)
                own = [i for i, u in enumerate(units) if len(u) == size]
                if own:
                    rows = unit_rows(batch.column(3).take(pa.array(at)))
                    wanted = np.frombuffer(b"".join(units[i] for i in own), np.float64).reshape(len(own), -1)
                    near = rows @ wanted.T >= least
                    near &= batch.column(0).to_numpy()[at][:, None] != ids[own][None, :]
                    there[own] += near.sum(axis=0)
                    found[own] += (near & (batch.column(1).to_numpy()[at][:, None] == tops[own][None, :])).sum(axis=0)
        yield record(pa.schema([("at", pa.int64()), ("found", pa.int64()), ("there", pa.int64())]), np.arange(len(ids)), found, there)

    got = all_rows.drop("kind").mapInArrow(run, "at bigint, found bigint, there bigint").groupBy("at").agg(F.sum("found").alias("found"), F.sum("there").alias("there")).orderBy("at").toPandas()
    store.drop(all_rows)
    found, there = got["found"].to_numpy(), got["there"].to_numpy()
    means = []
    for some in (there > 0, (there > 0) & (there <= params.few)):
        if some.any():
            means.append(float(np.average(found[some] / there[some], weights=weights[some])))
    return min(means, default=1.0)


def missed_components(distinct: DataFrame, labels: DataFrame, total: int, params: DescentParams) -> DataFrame:
    """Pairs ``(a, b, cosine)`` of components' labels that have a link between them: every pair of vectors is compared, each pair of groups in one task.

    Products are taken in single precision with room for its rounding; what comes near the threshold is taken again in double.
    """
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    longest = distinct.agg(F.max("size")).first()[0] or 0
    groups = max(int(np.ceil(total * longest / params.group_bytes)), int(np.ceil(np.sqrt(2 * n))))
    mine = distinct.join(labels, "node", "left").select(
        "size", F.coalesce("label", "node").alias("label"), "unit", F.pmod(F.xxhash64("node", F.lit(params.seed)), F.lit(groups)).cast("int").alias("group"))
    first = mine.select("size", F.col("group").alias("x"), F.explode(F.sequence("group", F.lit(groups - 1))).alias("y"), F.lit(0).alias("side"), "label", "unit")
    second = mine.where("group > 0").select("size", F.explode(F.sequence(F.lit(0), F.col("group") - 1)).alias("x"), F.col("group").alias("y"), F.lit(1).alias("side"), "label", "unit")
    dealt = first.unionByName(second).repartition(n, "size", "x", "y").sortWithinPartitions("size", "x", "y", "side")

    def compare(held):
        labels, side = (np.array([h[i] for h in held], np.int64) for i in (1, 0))
        rows = np.frombuffer(b"".join(h[2] for h in held), np.float64).reshape(len(held), -1)
        rough, room = rows.astype(np.float32), 2.0**-22 * (rows.shape[1] + 4)
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(other):
            other = own
        found = {}
        for s in range(0, len(own), 1024):
            for t in range(0, len(other), 4096):
                at, to = own[s:s + 1024], other[t:t + 4096]
                i, j = np.nonzero(rough[at] @ rough[to].T >= params.threshold - room)
                i, j = at[i], to[j]
                apart = labels[i] != labels[j]
                i, j = i[apart], j[apart]
                for part in range(0, len(i), 1 << 16):
                    u, v = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
                    cosine = np.einsum("ij,ij->i", rows[u], rows[v])
                    near = cosine >= params.threshold
                    for a, b, c in zip(labels[u[near]].tolist(), labels[v[near]].tolist(), cosine[near].tolist()):
                        found[min(a, b), max(a, b)] = c
        return record(PAIRS, [a for a, _ in found], [b for _, b in found], list(found.values()))

    def run(batches):
        held, key = [], None
        for batch in batches:
            for size, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (size, x, y) != key:
                    if held:
                        yield compare(held)
                    held, key = [], (size, x, y)
                held.append(row)
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def near_duplicates(vectors: DataFrame, store: Store, id_col: str = "vec_id", vec_col: str = "embedding", params: DescentParams = DescentParams()) -> DataFrame:
    """One row per vector: id, links, component (smallest id), whether it is kept, and the audited recall."""
    small_batches(vectors.sparkSession)
    rows, distinct = prepare(vectors, store, id_col, vec_col)
    total, links, recall = distinct.count(), None, 1.0
    tables = count_tables(total, params)
    for attempt in range(params.attempts):
        pairs = store.put(first_pairs(distinct, params, attempt, tables))
        read, before = [pairs], links
        ties = [pairs.where(F.col("cosine") >= params.threshold)] + ([links] if links is not None else [])
        graph = store.put(shorten(pairs.withColumn("new", F.lit(1)), params.neighbours))
        for _ in range(params.rounds):
            got = store.put(descend(graph, distinct, params))
            read.append(got)
            ties.append(got.where(F.col("cosine") >= params.threshold))
            nxt = store.put(shorten(graph.withColumn("new", F.lit(0)).unionByName(got.withColumn("new", F.lit(1))), params.neighbours))
            changed = nxt.where("new = 1").count()
            store.drop(graph)
            graph = nxt
            if changed <= params.least_change * max(total, 1) * params.neighbours:
                break
        links = ties[0].select("a", "b", "cosine")
        for t in ties[1:]:
            links = links.unionByName(t.select("a", "b", "cosine"))
        links = store.put(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct())
        for table in [*read, graph, *([before] if before is not None else [])]:
            store.drop(table)
        labels = components(links, store)
        recall = audit(distinct, labels, store, params)
        if recall >= params.least_recall:
            break
    if recall < params.least_recall:
        raise RuntimeError(f"audited recall {recall:.4f} of links is below {params.least_recall} after {params.attempts} attempts of {tables} tables")
    missed = store.put(missed_components(distinct, labels, total, params))
    if not missed.isEmpty():
        labels = components(links.unionByName(missed), store)
    members = distinct.join(labels, "node").select("label", "node", "copies", "unit")
    counts = count_within(members, params)
    named = distinct.select("node", "copies").join(labels, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whose = store.put(rows.join(named, "node", "left"))
    tops = whose.where("node is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    out = whose.join(tops, "label", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))).withColumn("audit_recall", F.lit(recall))


ship(sys.modules[__name__])
