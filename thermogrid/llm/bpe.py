"""Byte-level BPE encoding and decoding with a public vocabulary file.

A text is cut at the vocabulary's special strings, then into words by the vocabulary's pattern. The pairs of a short word are scanned for the lowest rank until none
merges. A longer word's bytes are symbols of a doubly linked list; a priority queue holds the rank and place of each pair that merges, lowest rank first, leftmost on ties. A popped
entry whose symbols have changed meanwhile is stale and skipped. So a word of n bytes takes O(n log n), also if a text is one word. Results of short
words are remembered, in a memory of bounded size, as the words of a language repeat. Decoding
concatenates vocabulary strings and reads the bytes as UTF-8, invalid ones replaced.

No shuffle; the merge table is broadcast, its size being that of the vocabulary file. Defined results: null text counts as empty, an empty text has no ids; repeated rows
are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .support import pieces, ship, small_batches

#: Fixed value: the word pattern that byte-level vocabularies of this kind are made with.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 150_000  # results in each of the newer and older halves of a memory
REMEMBERED_LENGTH = 64
SCANNED_LENGTH = 48  # bytes of a word whose pairs are scanned for the lowest rank, which is faster than a queue while they are few
NO_RANK = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Plain tables of a vocabulary file: bytes of each id, merges in order of rank, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
    alphabet = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    return {"strings": strings, "merges": ids, "alphabet": alphabet, "special": special}


class Codec:
    def __init__(self, tables: dict):
        self.strings = tables["strings"]
        self.alphabet = tables["alphabet"]
        self.left, self.right, self.made = (c.tolist() for c in tables["merges"].T)
        self.ranks = {a << 20 | b: rank for rank, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}
        self.special = tables["special"]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS).findall
        self.solid = regex.compile(r"\S").match
        self.memory: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ranks, left, right, made, alphabet = self.ranks, self.left, self.right, self.made, self.alphabet
        symbols = [alphabet[b] for b in word]
        n = len(symbols)
        if n <= SCANNED_LENGTH:
            return self._scanned(symbols)
        queue = []
        a = symbols[0]
        for i in range(1, n):
            b = symbols[i]
            rank = ranks.get(a << 20 | b)
            if rank is not None:
                queue.append(rank << 40 | i - 1)
            a = b
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, at = entry >> 40, entry & 0xFFFFFFFFFF
            nxt = after[at]
            if symbols[at] != left[rank] or nxt >= n or symbols[nxt] != right[rank]:
                continue  # stale
            new = symbols[at] = made[rank]
            symbols[nxt] = -1
            far = after[at] = after[nxt]
            if far < n:
                before[far] = at
                rank = ranks.get(new << 20 | symbols[far])
                if rank is not None:
                    heappush(queue, rank << 40 | at)
            back = before[at]
            if back >= 0:
                rank = ranks.get(symbols[back] << 20 | new)
                if rank is not None:
                    heappush(queue, rank << 40 | back)
        return [s for s in symbols if s >= 0]

    def _scanned(self, symbols: list[int]) -> list[int]:
        """As the queue does: the lowest rank first, leftmost on ties."""
        rank_of, made = self.ranks.get, self.made
        pairs = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            rank = min(pairs)
            if rank == NO_RANK:
                break
            at = pairs.index(rank)
            new = symbols[at] = made[rank]
            del symbols[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank_of(new << 20 | symbols[at + 1], NO_RANK)
            if at:
                pairs[at - 1] = rank_of(symbols[at - 1] << 20 | new, NO_RANK)
        return symbols

    def _remember(self, word: str) -> bytes:
        ids = self.older[0].get(word)
        if ids is None:
            found = self.merge(word.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.older[0].clear()
                self.older[0].update(self.memory)
                self.memory.clear()
            self.memory[word] = ids
        return ids

    def _stretch(self, part: str) -> bytes:
        """Ids of a space and ``part``, which begins and ends with other characters than white space, so that words end with it."""
        known, learn = self.memory.get, self._remember
        ids = self.older[1].get(part)
        if ids is None:
            ids = b"".join([known(w) or learn(w) for w in self.words(" " + part)])
        if len(part) <= REMEMBERED_LENGTH:
            if len(self.stretches) >= REMEMBERED:
                self.older[1].clear()
                self.older[1].update(self.stretches)
                self.stretches.clear()
            self.stretches[part] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings. Words never run across a single space, so stretches between them are looked up first."""
        known, learn = self.memory.get, self._remember
        first, *rest = text.split(" ")
        if rest and not (first and self.solid(first[-1])):
            return b"".join([known(w) or learn(w) for w in self.words(text)])
        out = [known(w) or learn(w) for w in self.words(first)]
        seen, solid = self.stretches.get, self.solid
        for part in rest:
            ids = seen(part)
            if ids is None:
                if not (part and solid(part[0]) and solid(part[-1])):
                    return b"".join([known(w) or learn(w) for w in self.words(text)])
                ids = self._stretch(part)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not (self.cut and any(s in text for s in self.special)):
            return self._plain(text) if text else b""
        return b"".join([
            np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
            for part in self.cut.split(text) if part
        ])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _mapped(df: DataFrame, tables: dict, text: str, added: list[tuple[str, T.DataType, pa.DataType]], drop: bool, work) -> DataFrame:
    spark = small_batches(df.sparkSession)
    at = df.columns.index(text)
    fields = [f for f in df.schema.fields if not (drop and f.name == text)]
    shared = spark.sparkContext.broadcast(tables)
    kind_of = df.schema[text].dataType

    def run(batches):
        tables = shared.value  # one object per worker process, so that later tasks find what earlier ones remembered
        codec = tables.get("codec") or tables.setdefault("codec", Codec(tables))
        for batch in pieces(batches, at) if isinstance(kind_of, T.StringType) else batches:
            rows = [work(codec, t) for t in batch.column(at).to_pylist()]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if not (drop and n == text)]
            made = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *made], names=[*(n for n, _ in kept), *(n for n, _, _ in added)])

    return df.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, kind) for n, kind, _ in added)]))


def encode(df: DataFrame, tables: dict, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with each text's ids in place of the text."""

    def work(codec, value):
        return (np.frombuffer(codec.encode(value or ""), "<u4").astype(np.int32),)

    return _mapped(df, tables, text, [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], True, work)


def decode(df: DataFrame, tables: dict, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the text of each array of ids in place of the ids; null ids count as none."""

    def work(codec, value):
        return (codec.decode(np.array(value if value is not None else [], "<u4").tobytes()),)

    return _mapped(df, tables, ids, [(text, T.StringType(), pa.string())], True, work)


def digests(df: DataFrame, tables: dict, text: str = "text") -> DataFrame:
    """``df`` with, in place of the text: number of ids, SHA-256 of the ids, SHA-256 of what they decode to."""

    def work(codec, value):
        got = codec.encode(value or "")
        return len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(codec.decode(got).encode()).hexdigest()

    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(df, tables, text, added, True, work)


ship(sys.modules[__name__])
