"""Small tables with the cases every operator must bear."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use themselves.
CLASH = "score double, row bigint, hits string, base string, found string, fingerprint string, label string, ids string, random string, first string"

EN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"
DE = "der schnelle braune fuchs springt über den faulen hund während sieben weise eulen von einer alten eiche am ruhigen fluss zusehen"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_docs(spark, clash=True):
    """Nulls in every column, an empty and a very long text, ties, repeated rows, clashing names."""
    rng = random.Random(1)
    long = " ".join(rng.choice(EN.split()) for _ in range(80_000))
    rows = [
        (1, EN, "en", "a", 1), (1, EN, "en", "a", 1), (2, EN, "en", None, None), (3, DE, "de", "b", 2), (4, None, None, None, None), (5, "", "en", "a", 0),
        (None, EN + " again", "en", "a", 1), (None, None, None, None, None), (6, long, "en", "c", 3), (7, "  \t\n ", "de", "c", 3), (8, "12 34 !!", "de", "c", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split(" ")
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
