"""Cross-product sums of a wide table: the only thing linear fits need from the data.

One pass over the rows gives ``Z'Z`` of ``Z = [1, x, y]`` for each split. Its size is fixed by the number of
columns, so it can go to the driver whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(column: pa.Array) -> list[tuple[str | None, np.ndarray | slice]]:
    """Each label of a batch and its rows; all rows at once where there is one label."""
    found = column.dictionary_encode()
    codes, names = found.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*found.dictionary.to_pylist(), None]
    own = np.flatnonzero(np.bincount(codes + 1, minlength=len(names))) - 1
    return [(names[code], slice(None) if len(own) == 1 else codes == code) for code in own]


def column_means(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([0.0 if m is None else m for m in means])


def triangle(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``R`` of the QR decomposition of ``[1, *columns - shift]`` over all rows, and the ``shift``: the columns' means.

    Cross-products square the condition number, so columns that differ by 1e-7 can't be told apart in them; ``R`` keeps it. Each task
    folds its batches into one triangle (``R`` of the triangle so far on top of the batch), and triangles are folded likewise, first in as many groups
    as there are shuffle partitions, then those. A triangle's size is fixed by the number of columns. Reads ``df`` twice.
    """
    size = len(columns) + 1
    shift = column_means(df, columns)
    groups = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def told(group: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            if batch.num_rows:
                values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) - shift[i] for i in range(size - 1)]
                r = np.linalg.qr(np.vstack([r, np.column_stack([np.ones(batch.num_rows), *values])]), mode="r")
        if len(r):
            yield told(0, r)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(raw, float).reshape(-1, size)]), mode="r")
        if len(r):
            yield told(0, r)

    schema = "part long, r binary"
    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(own, schema).withColumn("part", F.spark_partition_id().cast("long"))
    few = parts.repartition(groups, F.pmod("part", F.lit(groups))).mapInArrow(folded, schema)
    found = few.repartition(1).mapInArrow(folded, schema).collect()
    if not found:
        raise ValueError("no rows to fit")
    r = np.frombuffer(found[0]["r"], float).reshape(-1, size)
    return np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r, shift


def cross_products(df: DataFrame, columns: Sequence[str], split: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``{split value: symmetric matrix}`` over ``[1, *columns - shift]``, and the ``shift``: the columns' means over all rows.

    A first pass takes the means, so that a column of large mean and small spread keeps its digits. In the second each
    task adds up its batches with one matrix product per batch and emits one upper triangle per
    split; triangles are then added cell by cell in a grouped aggregate. Reads ``df`` twice.
    """
    size = len(columns) + 1
    shift = column_means(df, columns)
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            block = np.column_stack([
                np.ones(batch.num_rows),
                *[batch.column(i).to_numpy(zero_copy_only=False) - shift[i - 1] for i in range(1, size)],
            ])
            for label, mine in labelled(batch.column(0)):
                part = block[mine]
                sums[label] = sums.get(label, 0.0) + part.T @ part
        for label, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "split": pa.array([label] * len(upper[0]), pa.string()),
                "cell": pa.array(np.arange(len(upper[0])), pa.int32()),
                "total": pa.array(total[upper], pa.float64()),
            })

    plain = df.select(F.col(split).cast("string").alias("split"), *[F.col(c).cast("double").alias(c) for c in columns])
    summed = (
        plain.mapInArrow(partial, "split string, cell int, total double")
        .groupBy("split", "cell").agg(F.sum("total").alias("total")).toPandas()
    )
    out = {}
    for label, part in summed.groupby("split"):
        matrix = np.zeros((size, size))
        matrix[upper[0][part["cell"]], upper[1][part["cell"]]] = part["total"]
        out[label] = matrix + np.triu(matrix, 1).T
    return out, shift


def affine(size: int, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Matrix that maps ``[1, v]`` to ``[1, (v - shift) / scale]``."""
    change = np.eye(size)
    change[1:, 1:] /= scale
    change[1:, 0] = -shift / scale
    return change


def absolute_errors(
    df: DataFrame, x: Sequence[str], y: Sequence[str], weights: list[np.ndarray], split: str
) -> dict[str, np.ndarray]:
    """Mean absolute error of several linear maps ``[1, x] @ w -> y`` per split, in one pass."""
    stacked, n_maps, n_y = np.hstack(weights), len(weights), len(y)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            inputs = np.column_stack([np.ones(batch.num_rows), *[column(1 + i) for i in range(len(x))]])
            actual = np.column_stack([column(1 + len(x) + i) for i in range(n_y)])
            guess = (inputs @ stacked).reshape(len(inputs), n_maps, n_y)
            error = np.abs(guess - actual[:, None, :]).sum(axis=2)
            for label, mine in labelled(batch.column(0)):
                part = error[mine]
                row = np.append(part.sum(axis=0), len(part) * n_y)
                totals[label] = totals.get(label, 0.0) + row
        for label, row in totals.items():
            yield pa.RecordBatch.from_pydict({
                "split": pa.array([label] * len(row), pa.string()),
                "cell": pa.array(np.arange(len(row)), pa.int32()),
                "total": pa.array(row, pa.float64()),
            })

    plain = df.select(F.col(split).cast("string").alias("split"), *[F.col(c).cast("double").alias(c) for c in (*x, *y)])
    summed = (
        plain.mapInArrow(partial, "split string, cell int, total double")
        .groupBy("split", "cell").agg(F.sum("total").alias("total")).orderBy("cell").toPandas()
    )
    return {
        label: part["total"].to_numpy()[:-1] / part["total"].to_numpy()[-1] for label, part in summed.groupby("split")
    }
