"""Merkle manifest of a dataset, with octopus multiproofs.

Rows are leaves, ordered within their group; while a group has more than one node, every two consecutive ones become their hash (a last one without partner becomes its own
hash), up to the group's subroot; the subroots, in order of the groups, give the root in the same way. H is SHA-256 as lower-case hex,
of its inputs put together.

Building: one range exchange sorts the leaves; positions follow from counts of each task's part. Groups are cut into stretches of ``stretch``
leaves, and each is a leaf partition: what it can hash by itself is hashed there, and only the nodes whose parents need others (at most two a
level) leave it. Those are joined layer by layer, ``layer`` levels at a time, a block of a layer to a task. So hashes of leaves are
exchanged once, and everything above grows with the number of stretches.

Proving: a leaf partition needs, for all its leaves together, the siblings that it can't derive, one or two a level (the octopus). It computes their
coordinates (level, index), fetches the union once by a join with the nodes, derives all interiors that its leaves share, and
expands each leaf's own proof there. Folding a leaf with its siblings gives the root again, or another if the row was changed.

Ties: rows of equal group and order are ordered by their leaf; equal leaves are interchangeable.

Defined results: a null group comes first, then
groups bytewise; null order values come first; nulls are ``-`` in a leaf; rows that repeat are leaves of their own; a single leaf is its own root and has an empty proof; an empty table gives an empty result; other
columns are not looked at; texts of any length are hashed whole, on the JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Store, record, ship, small_batches

NODE = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("hash", pa.string())])
NODE_SQL = "tree string, size bigint, level int, at bigint, hash string"


@dataclass(frozen=True)
class MerkleParams:
    stretch: int = 10_000
    layer: int = 10


def leaf_hash(*values: Column) -> Column:
    """H of the values: ``-`` for null, else the length in UTF-8 bytes, a colon, the value."""
    parts = []
    for c in values:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(*hashes: str) -> str:
    return sha256("".join(hashes).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    return (size - 1).bit_length()


def climb(known: dict[tuple[int, int], str], size: int, first: int, last: int) -> list[tuple[int, int]]:
    """Add to ``known`` (level, index) all nodes between two levels whose children are there; gives those whose parent isn't."""
    stuck = []
    row = sorted(i for level, i in known if level == first)
    waiting: dict[int, list[int]] = {}
    for level, i in known:
        if level > first:
            waiting.setdefault(level, []).append(i)
    for level in range(first, last):
        count = -(-size // (1 << level))
        above = []
        for i in row:
            if i % 2 and (level, i - 1) in known:
                continue  # made from its left sibling
            if i % 2 == 0 and (level, i + 1) in known:
                made = digest(known[level, i], known[level, i + 1])
            elif i % 2 == 0 and i + 1 == count:
                made = digest(known[level, i])
            else:
                stuck.append((level, i))
                continue
            known[level + 1, i // 2] = made
            above.append(i // 2)
        row = sorted({*above, *waiting.get(level + 1, ())})
    return stuck + [(last, i) for i in row]


def missing(size: int, low: int, high: int) -> list[tuple[int, int]]:
    """Coordinates of the siblings that the leaves ``low`` to ``high`` of a tree need and can't derive."""
    out = []
    for level in range(height(size)):
        count = -(-size // (1 << level))
        if low % 2:
            out.append((level, low - 1))
        if high % 2 == 0 and high + 1 < count:
            out.append((level, high + 1))
        low, high = low // 2, high // 2
    return out


def siblings(known: dict[tuple[int, int], str], size: int, at: int) -> list[str | None]:
    """A leaf's proof: its sibling on each level, None where it has none."""
    out = []
    for level in range(height(size)):
        i = (at >> level) ^ 1
        out.append(known[level, i] if i < -(-size // (1 << level)) else None)
    return out


def fold(leaf: str, at: int, proof: Sequence[str | None]) -> str:
    for other in proof:
        leaf = digest(leaf) if other is None else digest(other, leaf) if at % 2 else digest(leaf, other)
        at //= 2
    return leaf


def placed(rows: DataFrame, order: Sequence[str], store: Store) -> DataFrame:
    """``rows`` (tree, leaf and more; a table, as it is read twice) with ``at`` and ``size``: each leaf's position in its tree, and the tree's leaves; a table."""
    spark = rows.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tie = "_tie"  # rows alike in every key must not be one range
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("leaf"), F.col(tie)]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(dealt, *keys).sortWithinPartitions(*keys).drop(tie)
    at = ranged.columns.index("tree")

    def number(batches):
        tree, count = None, 0
        for batch in batches:
            names = batch.column(at).to_pylist()
            out = np.empty(len(names), np.int64)
            for i, name in enumerate(names):
                if name != tree:
                    tree, count = name, 0
                out[i] = count
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "nth"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    numbered = store.put(ranged.mapInArrow(number, f"{fields}, nth bigint").withColumn("part", F.spark_partition_id()))
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "tree", "part", F.expr("sum(n) over (partition by tree order by part) - n").alias("before"), F.expr("sum(n) over (partition by tree)").alias("size"))
    return numbered.join(store.put(before), ["part", "tree"]).select(*ranged.columns, (F.col("before") + F.col("nth")).alias("at"), "size")


def _runs(batches, keys: Sequence[int]):
    """Whole groups of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        first = 0
        for i, key in enumerate(zip(*columns)):
            if key != current:
                if i > first:
                    held.append(batch.slice(first, i - first))
                if held:
                    yield pa.Table.from_batches(held)
                held, first, current = [], i, key
        if batch.num_rows > first:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _stretched(leaves: DataFrame, params: MerkleParams, *columns: str) -> DataFrame:
    """Leaves grouped by tree and stretch, in order, a group to a task."""
    dealt = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = leaves.select("tree", F.floor(F.col("at") / params.stretch).alias("stretch"), "at", "size", "leaf", *columns)
    return rows.repartition(dealt, "tree", "stretch").sortWithinPartitions("tree", "stretch", "at")


def nodes(leaves: DataFrame, store: Store, params: MerkleParams = MerkleParams()) -> DataFrame:
    """``(tree, size, level, at, hash)``: nodes above the stretches of ``leaves(tree, at, size, leaf)``, and those at their edges; a table."""
    def own(batches):
        for group in _runs(batches, (0, 1)):
            tree, size = group.column(0)[0].as_py(), group.column(3)[0].as_py()
            known = {(0, i): h for i, h in zip(group.column(2).to_pylist(), group.column(4).to_pylist())}
            edge = climb(known, size, 0, height(size))
            yield record(NODE, [tree] * len(edge), [size] * len(edge), *zip(*edge), [known[e] for e in edge])

    edges = store.put(_stretched(leaves, params).mapInArrow(own, NODE_SQL))
    most = edges.agg(F.max("size").alias("size")).first()["size"] or 1
    made, low, top = edges, 0, 0
    dealt = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    while top < height(most):
        low, top = top, min(top + params.layer, height(most))

        def joined(batches, top=top):
            for group in _runs(batches, (0, 1)):
                tree, size = group.column(0)[0].as_py(), group.column(2)[0].as_py()
                known = {(level, i): h for level, i, h in zip(*(group.column(c).to_pylist() for c in (3, 4, 5)))}
                given = set(known)
                climb(known, size, min(level for level, _ in known), min(top, height(size)))
                new = [k for k in known if k not in given]
                if new:
                    yield record(NODE, [tree] * len(new), [size] * len(new), *zip(*new), [known[k] for k in new])

        # blocks of 2^top leaves; what lies below ``low`` has been joined
        waiting = made.where((F.col("level") >= low) & (F.col("level") < top)).withColumn("block", F.expr(f"shiftright(at, {top} - level)"))
        met = waiting.select("tree", "block", "size", "level", "at", "hash").repartition(dealt, "tree", "block").sortWithinPartitions("tree", "block", "level", "at")
        made = store.put(made.unionByName(met.mapInArrow(joined, NODE_SQL)))
    return made


def prove(leaves: DataFrame, made: DataFrame, params: MerkleParams = MerkleParams(), *columns: str) -> DataFrame:
    """Each leaf (tree, at, size, leaf and ``columns``) with its ``proof``: siblings level by level, null where there is none. One fetch a stretch."""
    spark = small_batches(leaves.sparkSession)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    stretch = F.floor(F.col("at") / params.stretch)
    parts = leaves.select("tree", "size", stretch.alias("stretch")).distinct()
    wanted = pa.schema([("tree", pa.string()), ("stretch", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64())])

    def ask(batches):
        for batch in batches:
            for tree, size, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                low = s * params.stretch
                need = missing(size, low, min(low + params.stretch, size) - 1)
                if need:
                    yield record(wanted, [tree] * len(need), [s] * len(need), [size] * len(need), *zip(*need))

    asked = parts.mapInArrow(ask, "tree string, stretch bigint, size bigint, level int, at bigint")
    fetched = asked.join(made.select("tree", "level", "at", F.col("hash").alias("leaf")), ["tree", "level", "at"]).select("tree", "stretch", "at", "size", "level", "leaf")
    own = leaves.select("tree", stretch.alias("stretch"), "at", "size", F.lit(-1).alias("level"), "leaf", *columns)
    both = own.unionByName(fetched, allowMissingColumns=True).repartition(dealt, "tree", "stretch").sortWithinPartitions("tree", "stretch", "level", "at")
    names = ["tree", "at", "size", "leaf", *columns]
    kind = pa.list_(pa.string())

    def expand(batches):
        for group in _runs(batches, (0, 1)):
            size = group.column(3)[0].as_py()
            level, at, leaf = (group.column(c).to_pylist() for c in (4, 2, 5))
            count = level.count(-1)
            known = {(max(n, 0), i): h for n, i, h in zip(level, at, leaf)}
            climb(known, size, 0, height(size))
            for first in range(0, count, 512):
                some = group.slice(first, min(512, count - first))
                proofs = pa.array([siblings(known, size, i) for i in at[first:first + some.num_rows]], kind)
                flat = [some.column(n).combine_chunks() for n in names]
                yield pa.RecordBatch.from_arrays([*flat, proofs], names=[*names, "proof"])

    fields = ", ".join(f"`{n}` {both.schema[n].dataType.simpleString()}" for n in names)
    return both.mapInArrow(expand, f"{fields}, proof array<string>")


def grown(rows: DataFrame, order: Sequence[str], store: Store, params: MerkleParams, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Leaves with proofs, and ``(tree, top)``: the top node of each tree."""
    leaves = store.put(placed(rows, order, store))
    made = nodes(leaves, store, params)
    tops = made.where(F.expr("at = 0 and shiftleft(1L, level) >= size and (level = 0 or shiftleft(1L, level - 1) < size)"))
    return prove(leaves, made, params, *columns), tops.select("tree", F.col("hash").alias("top"))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, store: Store, found: Column | None = None, params: MerkleParams = MerkleParams()) -> DataFrame:
    """One row for each row of ``docs``: its place in the tree, and whether the leaf ``found`` there later (null: its own) still leads to the root.

    Columns: ``key`` (the order column), ``leaf``, ``subroot``, ``root``, ``proof`` (its siblings up to the root, null where a level has none), ``folded_root``, ``verified``.
    """
    small_batches(docs.sparkSession)
    name = F.col(group).cast("string")
    tree = F.coalesce(F.concat(F.lit("+"), name), F.lit(""))  # null before all others
    rows = store.put(docs.select(
        tree.alias("tree"), F.col(order).alias("key"), leaf_hash(*map(F.col, columns)).alias("leaf"), (F.lit(None) if found is None else found).cast("string").alias("found")))
    proved, subroots = grown(rows, ["key"], store, params, "key", "found")
    named = store.put(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("leaf")))
    upper, root = grown(named, ["group"], store, params, "group")
    upper = store.put(upper.join(root.withColumnRenamed("top", "root"), "tree").select(
        F.col("group").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("at").alias("upper_at"), F.col("proof").alias("upper_proof")))
    whole = proved.join(upper, "tree").select("key", "leaf", "subroot", "root", "at", F.col("proof"), "upper_at", "upper_proof", "found")
    kind = pa.list_(pa.string())

    def check(batches):
        for batch in batches:
            leaf, at, proof, upper_at, upper_proof, later = (batch.column(c).to_pylist() for c in (1, 4, 5, 6, 7, 8))
            folded = [fold(fold(own if new is None else new, i, p), j, q) for own, new, i, p, j, q in zip(leaf, later, at, proof, upper_at, upper_proof)]
            both = [p + q for p, q in zip(proof, upper_proof)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, kind), pa.array(folded, pa.string())], names=["key", "leaf", "subroot", "root", "proof", "folded_root"])

    kind_of = whole.schema["key"].dataType.simpleString()
    out = whole.mapInArrow(check, f"key {kind_of}, leaf string, subroot string, root string, proof array<string>, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """H of the siblings of a proof."""
    return F.sha2(F.array_join(F.filter(proof, lambda h: h.isNotNull()), "").cast("binary"), 256)


ship(sys.modules[__name__])
