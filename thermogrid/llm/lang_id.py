"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its hashed character n-grams (2 to 4 code points, lower case, runs of anything but letters
as one space). Their embeddings are averaged over the whole text and a linear layer with a softmax follows. Training is
stochastic gradient descent in NumPy on a bounded sample of labelled rows; what training draws from a long text
is a bounded number of its n-grams, spread over the whole of it. Averaging and the layer are both linear, so
prediction adds up one small row per n-gram. A temperature and a rejection threshold are set on rows that training
did not see.

Defined results: null text, or text without a letter: ``und``, score 0, rejected. Labels that are null take no
part in training. With no labelled row at all every text is ``und``. Repeated rows are predicted one by one; an empty
table gives an empty result; input columns of any name are untouched, as output names are the caller's own.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import pieces, record, ship, small_batches

UND = "und"


@dataclass(frozen=True)
class LangParams:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    width: int = 12
    rows_per_label: int = 1500  # bound of the training sample
    grams_per_row: int = 384
    epochs: int = 4
    rate: float = 8.0
    calibration_share: float = 0.2
    accuracy: float = 0.995  # wanted among accepted calibration rows
    floor: float = 0.5  # a probability below it is rejected whatever calibration says
    seed: int = 7


@dataclass
class LangModel:
    labels: list[str]
    scores: np.ndarray  # buckets x labels: embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    params: LangParams = field(default_factory=LangParams)


def gram_buckets(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(chars):
        return np.zeros(0, np.int64)
    gap = (chars < 128) & ((chars < 97) | (chars > 122))
    chars = np.where(gap, 32, chars).astype(np.uint64)
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    chars = np.concatenate([[32], chars[keep], [32]]).astype(np.uint64)
    out = []
    h = chars.copy()
    for n in range(2, max(orders) + 1):
        if len(chars) < n:
            break
        h = h[:len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:]
        if n in orders:
            spread = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((spread >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def text_blocks(text: str, block: int = 1 << 18, overlap: int = 3):
    """A long text in blocks that share their border, so that no n-gram is lost; short ones in one."""
    if len(text) <= block:
        yield text
        return
    for first in range(0, len(text), block):
        yield text[first:first + block + overlap]


def fit(features: list[np.ndarray], targets: np.ndarray, labels: list[str], params: LangParams) -> LangModel:
    """Train by gradient steps on single texts in random order, then calibrate on the held-back share."""
    rng = np.random.default_rng(params.seed)
    buckets, k = 1 << params.bits, len(labels)
    table = (rng.random((buckets, params.width)) - 0.5).astype(np.float32) / params.width
    layer = np.zeros((params.width, k), np.float32)
    bias = np.zeros(k, np.float32)
    order = rng.permutation(len(features))
    held = order[:int(len(order) * params.calibration_share)]
    seen = order[len(held):]
    # every label weighs the same, however many rows it has
    weight = len(seen) / (k * np.maximum(np.bincount(targets[seen], minlength=k), 1))
    total, step = params.epochs * max(len(seen), 1), 0
    bags = [(u, (n / max(len(g), 1)).astype(np.float32)) for g in features for u, n in [np.unique(g, return_counts=True)]]
    for _ in range(params.epochs):
        for i in rng.permutation(seen):
            rate = params.rate * (1 - step / total) * min(weight[targets[i]], 4.0)
            step += 1
            grams, part = bags[i]
            if not len(grams):
                continue
            rows = table.take(grams, axis=0)
            mean = part @ rows
            p = mean @ layer + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[targets[i]] -= 1
            back = layer @ p
            layer -= 0.1 * rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            table[grams] = rows - part[:, None] * (np.float32(rate) * back)
    model = LangModel(labels, (table @ layer).astype(np.float32), bias.astype(np.float64), params=params)
    if len(held):
        calibrate(model, [features[i] for i in held], targets[held])
    return model


def calibrate(model: LangModel, features: list[np.ndarray], targets: np.ndarray) -> None:
    """Temperature by held-out log loss; threshold: the least at which accepted rows reach the wanted accuracy."""
    logits = np.array([model.scores[g].mean(axis=0, dtype=np.float64) + model.bias if len(g) else model.bias for g in features])
    best = None
    for t in np.geomspace(0.05, 20, 49):
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        loss = -logp[np.arange(len(targets)), targets].mean()
        if best is None or loss < best[0]:
            best = (loss, t, np.exp(logp))
    model.temperature = float(best[1])
    top, right = best[2].max(axis=1), best[2].argmax(axis=1) == targets
    by = np.argsort(-top)
    share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    enough = np.flatnonzero(share >= model.params.accuracy)
    least = top[by][enough[-1]] if len(enough) and enough[-1] + 1 < len(by) else 0.0 if len(enough) else 1.0
    model.threshold = float(min(max(model.params.floor, least), 0.9))


def predict_texts(model: LangModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, calibrated probability and rejection of each text."""
    labels, score, out = [], np.zeros(len(texts)), np.ones(len(texts), bool)
    for i, text in enumerate(texts):
        if text is None or not model.labels or not has_letter(text):
            labels.append(UND)
            continue
        total, n = np.zeros(len(model.labels)), 0
        for block in text_blocks(text):
            grams = gram_buckets(block, model.params.orders, model.params.bits)
            total += model.scores.take(grams, axis=0).sum(axis=0, dtype=np.float64)
            n += len(grams)
        z = (total / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        labels.append(model.labels[best])
        score[i], out[i] = p[best], p[best] < model.threshold
    return labels, score, out


def train(labelled: DataFrame, text: str = "text", label: str = "lang", params: LangParams = LangParams(), key: Column | None = None) -> LangModel:
    """Fit on about ``rows_per_label`` rows a label, taken by a hash; counting and sampling run on Spark.

    Only hashed n-grams of the sampled rows reach the driver: at most ``grams_per_row`` each, drawn from all blocks of the text.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), (F.xxhash64(F.col(text), F.lit(params.seed)) if key is None else key).alias("key"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return LangModel([], np.zeros((1 << params.bits, 0), np.float32), np.zeros(0), params=params)
    parts = 1 << 30
    shares = F.create_map(*[F.lit(x) for lab in labels for x in (lab, min(parts, int(parts * params.rows_per_label / counts[lab]) + 1))])
    sample = rows.where(F.pmod(F.col("key"), F.lit(parts)) < shares[F.col("label")])

    def draw(batches):
        schema = pa.schema([("label", pa.string()), ("key", pa.int64()), ("grams", pa.list_(pa.int32()))])
        for batch in batches:
            grams = []
            for value, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                rng = np.random.default_rng(abs(key))
                parts = []
                blocks = list(text_blocks(value)) if has_letter(value) else []
                for block in blocks:
                    found = gram_buckets(block, params.orders, params.bits)
                    parts.append(rng.choice(found, min(len(found), max(1, params.grams_per_row // len(blocks))), replace=False))
                pool = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                if len(pool) > params.grams_per_row:  # more blocks than n-grams: some of all of them
                    pool = rng.choice(pool, params.grams_per_row, replace=False)
                grams.append(pool.astype(np.int32))
            yield record(schema, batch.column(1), batch.column(2), pa.array(grams, pa.list_(pa.int32())))

    drawn = sample.mapInArrow(draw, "label string, key bigint, grams array<int>").toPandas().sort_values(["key", "label"], kind="stable")
    drawn = drawn[drawn["grams"].map(len) > 0]
    index = {lab: i for i, lab in enumerate(labels)}
    features = [np.asarray(g, np.int64) for g in drawn["grams"]]
    return fit(features, np.array([index[x] for x in drawn["label"]], np.int64), labels, params)


def identify(df: DataFrame, model: LangModel, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``df`` with three more columns. No shuffle: the model (buckets x labels floats) is broadcast."""
    spark = small_batches(df.sparkSession)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    shared = spark.sparkContext.broadcast({**vars(model), "params": vars(model.params)})  # plain values, which any worker can load

    def run(batches):
        model = LangModel(**{**shared.value, "params": LangParams(**shared.value["params"])})
        for batch in pieces(batches, at):
            labels, p, out = predict_texts(model, batch.column(at).to_pylist())
            added = [pa.array(labels, pa.string()), pa.array(p), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, lang, score, rejected])

    return df.mapInArrow(run, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


ship(sys.modules[__name__])
