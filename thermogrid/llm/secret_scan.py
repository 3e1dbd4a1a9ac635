"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Patterns find assignments, access keys and hex runs. Beyond them, each run of at least ``least_length`` token characters is scored
under two first-order Markov models of its characters; the log-likelihood ratio of random against ordinary decides.
The models are counted from labelled samples; :func:`labelled_samples` takes the values that the patterns find as random and
the other words as ordinary, from a bounded share of the rows.

DataFrame functions only: text stays in the JVM. Positions are code points, ends exclusive. Defined results: null text
counts as empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty result, and models without samples
leave the patterns alone to decide; texts of any length are scanned whole; other columns pass through :func:`scan` untouched, but one that
has the name of an output is replaced (``base`` and ``extra`` name them).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import fresh

#: The kinds and their patterns, as their finder is defined. A match fails below its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A maximal run of 24 or more is what the finder keeps of all runs, so shorter ones need no listing; likewise for access keys.
QUICK = {"access": "AKIA[A-Z0-9]{16,}+", "hex": "[0-9a-f]{24,}+"}
TOKEN = "[A-Za-z0-9+/_=-]"
MASK = "[SECRET]"
CODES = 128
BLOCK = 4096  # code points of a text that are masked at once


@dataclass(frozen=True)
class SecretParams:
    least_length: int = 20
    log_odds: float = 15.0  # log-likelihood ratio of a whole run
    per_character: float = 0.6
    sample_rows: int = 20_000  # bound of the labelled sample: rows searched for random values
    ordinary_rows: int = 2_000  # rows of which all words count as ordinary
    random_prior: float = 2.0
    ordinary_prior: float = 0.2
    backoff: float = 5.0
    clip: float = 4.0


def _lengths(parts: str) -> str:
    return f"transform({parts}, x -> length(x))"


def _spans(df: DataFrame, kind: int, found: str, between: str, good: str, out: str) -> DataFrame:
    """Add ``out``: array of (start, kind, end, value) of the matches that ``good`` (an array of booleans) lets stand.

    A match starts after the lengths of all that lies before it: sums over blocks, then within the block, so that many matches stay cheap.
    """
    step, block = f"zip_with({_lengths(between)}, {_lengths(found)}, (a, b) -> a + coalesce(b, 0))", 512
    steps, sums = fresh(df, "steps"), fresh(df, "sums")
    df = df.withColumn(steps, F.expr(f"case when size({found}) > 0 then {step} end"))
    df = df.withColumn(sums, F.expr(
        f"case when size({found}) > 0 then transform(sequence(0, cast(size({steps}) / {block} as int)), "
        f"k -> aggregate(slice({steps}, k * {block} + 1, {block}), 0, (s, x) -> s + x)) end"))
    start = (
        f"aggregate(slice({sums}, 1, cast(floor(i / {block}) as int)), 0, (s, y) -> s + y) + "
        f"aggregate(slice({steps}, cast(floor(i / {block}) as int) * {block} + 1, i % {block}), 0, (s, y) -> s + y) + length({between}[i])")
    made = (
        f"case when size({found}) > 0 then filter(transform({found}, (x, i) -> case when {good}[i] then "
        f"named_struct('start', {start}, 'kind', {kind}, 'end', {start} + length(x), 'value', x) end), x -> x is not null) "
        f"else cast(array() as array<struct<start:int,kind:int,end:int,value:string>>) end")
    return df.withColumn(out, F.expr(made)).drop(steps, sums)


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add ``out``: the patterns' spans, sorted by start, then kind."""
    made = []
    for kind, name in enumerate(KINDS[:3]):
        pattern = ASSIGN if name == "assign" else QUICK[name]
        found, between, good, spans = (fresh(df, f"{n}_{name}") for n in ("found", "between", "good", "spans"))
        df = df.withColumn(found, F.expr(f"regexp_extract_all(coalesce({text}, ''), {_literal(pattern)}, 0)"))
        if name == "assign":
            df = df.withColumn(good, F.expr(
                f"case when size({found}) > 0 then transform(regexp_extract_all({text}, {_literal(pattern)}, 2), x -> length(x) >= {LEAST[name]}) end"))
        else:
            df = df.withColumn(good, F.expr(f"case when size({found}) > 0 then transform({found}, x -> length(x) >= {LEAST[name]}) end"))
        df = df.withColumn(between, F.expr(f"case when size({found}) > 0 then split({text}, {_literal(pattern)}, -1) end"))
        df = _spans(df, kind, found, between, good, spans).drop(found, between, good)
        made.append(spans)
    return df.withColumn(out, F.array_sort(F.concat(*made))).drop(*made)


def _pairs(tokens: DataFrame, token: str, label: int) -> DataFrame:
    pair = F.explode(F.expr(f"transform(sequence(1, length({token}) - 1), i -> substring({token}, i, 2))"))
    return tokens.where(F.length(token) >= 2).select(F.lit(label).alias("label"), pair.alias("pair"))


def labelled_samples(docs: DataFrame, text: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """``(label, token)``: 1 for values that the patterns find, 0 for other words, from a bounded hashed share of ``docs``."""
    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    count = rows.count()
    parts = 1 << 30
    draw = F.pmod(F.xxhash64("text"), F.lit(parts))
    share = lambda bound: F.lit(min(parts, int(parts * bound / max(count, 1)) + 1))
    found = base_spans(rows.where(draw < share(params.sample_rows))).select(F.explode("base.value").alias("token"))
    value = F.regexp_extract("token", f"({TOKEN}+)$", 1)
    cleared = rows.where(draw < share(params.ordinary_rows))
    for pattern in (ASSIGN, QUICK["access"], QUICK["hex"]):
        cleared = cleared.withColumn("text", F.regexp_replace("text", pattern, " "))
    words = cleared.select(F.explode(F.regexp_extract_all("text", F.lit(f"({TOKEN}{{4,}})"), F.lit(1))).alias("token"))
    return found.select(F.lit(1).alias("label"), value.alias("token")).unionByName(words.select(F.lit(0).alias("label"), "token"))


def train(labelled: DataFrame, params: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII characters, random against ordinary; both models smoothed. Counting runs on Spark."""
    ascii_only = labelled.where(F.col("token").rlike(f"^{TOKEN}+$"))
    pairs = _pairs(ascii_only.where("label = 1"), "token", 1).unionByName(_pairs(ascii_only.where("label = 0"), "token", 0))
    counts = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect():
        counts[r["label"]][r["pair"]] = r["n"]
    letters = [c for c in map(chr, range(33, CODES)) if c.isalnum() or c in "+/_=-"]
    table = [0.0] * (CODES * CODES)
    if not counts[0] or not counts[1]:
        return table
    total = {(label, a): sum(counts[label].get(a + b, 0) for b in letters) for label in (0, 1) for a in letters}
    size = len(letters)
    seconds = {b: sum(counts[0].get(a + b, 0) for a in letters) for b in letters}
    # random strings fall back on equal letters, ordinary ones on how frequent a letter is among them
    plain = {b: (seconds[b] + params.ordinary_prior) / (sum(seconds.values()) + params.ordinary_prior * size) for b in letters}
    for a in letters:
        for b in letters:
            drawn = (counts[1].get(a + b, 0) + params.random_prior) / (total[1, a] + params.random_prior * size)
            said = (counts[0].get(a + b, 0) + params.backoff * plain[b]) / (total[0, a] + params.backoff)
            table[ord(a) * CODES + ord(b)] = round(max(-params.clip, min(params.clip, math.log(drawn / said))), 6)
    return table


def scan(df: DataFrame, table: list[float], text: str = "text", base: str = "base", extra: str = "random", params: SecretParams = SecretParams(), touching: bool = False) -> DataFrame:
    """``df`` with two more columns, arrays of (start, kind, end, value): the patterns' spans, and the runs that the models call random,
    those that a pattern's span touches only with ``touching``."""
    df = base_spans(df, text, base)
    pattern = f"(?<!{TOKEN}){TOKEN}{{{params.least_length},}}+"
    found, between, good, spans, ratio = (fresh(df, n) for n in ("found", "between", "good", "spans", "ratio"))
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    df = df.withColumn(found, F.expr(f"regexp_extract_all(coalesce({text}, ''), {_literal(pattern)}, 0)"))
    codes = lambda token: F.transform(F.split(token, ""), lambda c: F.ascii(c))

    def score(token: Column) -> Column:
        both = F.arrays_zip(codes(token).alias("a"), codes(F.substr(token, F.lit(2))).alias("b"))
        step = lambda p: F.coalesce(F.get(ratios, p["a"] * CODES + p["b"]), F.lit(0.0))
        return F.aggregate(both, F.lit(0.0), lambda total, p: total + step(p))

    decide = F.transform(F.col(found), lambda t: score(t) >= F.greatest(F.lit(params.log_odds), params.per_character * F.length(t)))
    df = df.withColumn(good, F.when(F.size(found) > 0, decide))
    df = df.withColumn(between, F.expr(f"case when size({found}) > 0 then split({text}, {_literal(pattern)}, -1) end"))
    df = _spans(df, 3, found, between, good, spans).drop(found, between, good)
    if touching:
        return df.withColumnRenamed(spans, extra) if extra not in df.columns else df.withColumn(extra, F.col(spans)).drop(spans)
    free = f"filter({spans}, r -> not exists({base}, b -> b.start < r.end and r.start < b.end))"
    return df.withColumn(extra, F.expr(f"case when size({spans}) > 0 then {free} else {spans} end")).drop(spans)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, table: list[float], id_col: str = "doc_id", text: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """Per document: spans by kind, their digest and their list."""
    rows = scan(docs.select(F.col(id_col), F.col(text).alias("text")), table, params=params)
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("random").cast("long").alias("n_random"),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


def mask_spans(text: Column, spans: Column) -> Column:
    """``text`` with :data:`MASK` in place of each island of ``spans`` (start, end), which are sorted by start and may overlap.

    The text is cut into blocks first, so that a span far behind costs no walk from the start; the block in which an island begins gets the mask.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def clean(block: Column, k: Column) -> Column:
        low, high = k * BLOCK, (k + 1) * BLOCK

        def add(acc: Column, s: Column) -> Column:
            start, end = s["start"] - low, F.least(s["end"], high) - low
            gap = F.substr(block, acc["at"] + 1, F.greatest(start - acc["at"], F.lit(0)))
            begins = (start >= acc["at"]) & (start >= 0)
            return F.struct(F.greatest(acc["at"], end).cast("int").alias("at"), F.concat(acc["out"], F.when(begins, F.concat(gap, F.lit(MASK))).otherwise(F.lit(""))).alias("out"))

        inside = F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(inside, first, add, lambda acc: F.concat(acc["out"], F.substr(block, acc["at"] + 1)))

    return F.array_join(F.transform(blocks, clean), "")


def redact(docs: DataFrame, table: list[float], text: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """``docs`` with every secret masked; columns as given. Texts without secrets, nulls included, stay as they are.

    What is masked are stretches of the text: the value of each assignment, whole keys and hex runs, and whole runs that the models call random but for the
    names that values are assigned to, also where one lies in another or touches it.
    """
    base, extra = fresh(docs, "base"), fresh(docs, "random")
    rows = scan(docs, table, text, base, extra, params, touching=True)
    value = lambda s: F.when(s["kind"] == 0, s["end"] - F.length(F.regexp_extract(s["value"], ASSIGN, 2))).otherwise(s["start"])
    part = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    heads = F.transform(F.filter(base, lambda s: s["kind"] == 0), lambda s: part(s["start"], value(s)))

    def around(run: Column) -> Column:
        """A random run without the names and signs of assignments in it."""
        inside = F.filter(heads, lambda h: (h["start"] < run["end"]) & (h["end"] > run["start"]))
        starts, ends = F.concat(F.array(run["start"]), F.transform(inside, lambda h: h["end"])), F.concat(F.transform(inside, lambda h: h["start"]), F.array(run["end"]))
        return F.zip_with(starts, ends, part)

    parts = F.concat(F.transform(base, lambda s: part(value(s), s["end"])), F.flatten(F.transform(extra, around)))
    spans = F.array_sort(F.filter(parts, lambda s: s["start"] < s["end"]))
    return rows.withColumn(text, F.when(F.size(base) + F.size(extra) > 0, mask_spans(F.col(text), spans)).otherwise(F.col(text))).select(*docs.columns)
