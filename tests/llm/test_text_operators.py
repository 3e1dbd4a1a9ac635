import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DE, DOCS, EN, WORDS, empty_docs, lower, odd_docs
from thermogrid.llm import bpe, decontam, kernels, lang_id, passages, ppm, secret_scan, simhash
from thermogrid.llm import queries
from thermogrid.llm.queries import vocabulary
from thermogrid.llm.support import Store


def invented(seed, n, syllables=("ka", "lo", "mi", "ter", "un", "ess", "or", "va", "pi", "den")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- kernels


def test_words_and_hashes_match_plain_python():
    texts = ["Ab  cd\tAB", "", None, "é x", "x" * 3, " lead and trail ", "ab"]
    data, bounds = kernels_buffers(texts)
    starts, ends = kernels.word_bounds(data, bounds)
    got = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert got == [w for t in texts for w in WORDS.findall(t or "")]
    hashes = kernels.word_hashes(data, starts, ends)
    same = defaultdict(set)
    for w, h in zip(got, hashes.tolist()):
        same[lower(w)].add(h)
    assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)


def kernels_buffers(texts):
    from thermogrid.llm.support import text_buffers

    return text_buffers(pa.array(texts, pa.string()))


def test_a_word_longer_than_a_block_hashes_like_its_letters(monkeypatch):
    data, bounds = kernels_buffers(["a" * 40 + " " + "b" * 7, "A" * 40])
    starts, ends = kernels.word_bounds(data, bounds)
    whole = kernels.word_hashes(data, starts, ends)
    monkeypatch.setattr(kernels, "BLOCK", 16)
    assert (kernels.word_hashes(data, starts, ends) == whole).all() and whole[0] == whole[2]


def test_table_finds_all_keys_and_no_others():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    table = kernels.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2


# --- language


def test_language_is_learned_and_doubt_rejected(spark):
    rows = [(i, " ".join(random.Random(i).sample((EN if i % 2 else DE).split(), 12)), "en" if i % 2 else "de", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    model = lang_id.train(docs, key=F.xxhash64("doc_id"))
    out = {r["doc_id"]: r for r in lang_id.identify(odd_docs(spark), model, "text", "p_lang", "p_score", "p_out").collect()}
    assert (out[1]["p_lang"], out[3]["p_lang"]) == ("en", "de") and not out[1]["p_out"] and out[6]["p_lang"] == "en"
    assert all(out[i]["p_lang"] == "und" and out[i]["p_score"] == 0 and out[i]["p_out"] for i in (4, 5, 7, 8))
    assert lang_id.identify(empty_docs(spark), model).count() == 0
    right = lang_id.identify(docs, model).where("lang = lang_pred").count()
    assert right >= 118


def test_language_without_labels_knows_nothing(spark):
    docs = spark.createDataFrame([(1, EN, None, "s", 1)], DOCS)
    assert lang_id.identify(docs, lang_id.train(docs)).first()["lang_pred"] == "und"


def test_blocks_of_a_long_text_hold_every_gram():
    text = invented(3, 400)
    whole = Counter(lang_id.gram_buckets(text, (2, 3, 4), 20).tolist())
    parts = Counter()
    for block in lang_id.text_blocks(text, 100, 3):
        parts.update(lang_id.gram_buckets(block, (2, 3, 4), 20).tolist())
    assert set(whole) <= set(parts)


# --- SimHash


def brute_fingerprint(text):
    w = WORDS.findall(lower(text or ""))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_match_brute_force(spark):
    base = [invented(i, 60) for i in range(25)]
    texts = base + [t + " more" for t in base[:10]] + base[:5] + [t.upper() for t in base[:3]] + ["", None, "one", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r for r in simhash.near_duplicates(docs, Store(spark)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] & (1 << 64) - 1 for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.product(range(len(texts)), repeat=2):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[i] = label[j] = min(label[i], label[j])
    assert [got[i]["component_id"] for i in range(len(texts))] == label


@pytest.mark.parametrize("groups", [(2,), (3,), (4,), (5,)])
def test_pigeonhole_index_loses_no_link(spark, groups):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    near = values.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    all_ = np.unique(np.concatenate([values, near]))
    df = spark.createDataFrame([(int(v),) for v in all_.view(np.int64)], "fingerprint bigint")
    params = simhash.SimHashParams(group_counts=groups)
    links = {tuple(sorted((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1))) for r in simhash.link_fingerprints(df, Store(spark), params).collect()}
    pairs = {(int(a), int(b)) for a, b in itertools.combinations(all_, 2) if (int(a) ^ int(b)).bit_count() <= 4}
    assert links <= pairs
    root = {int(v): int(v) for v in all_}
    for a, b in links:
        old, new = sorted((root[a], root[b]), reverse=True)
        root = {k: new if v == old else v for k, v in root.items()}
    assert all(root[a] == root[b] for a, b in pairs)


def test_thresholds_satisfy_the_pigeonhole_sum():
    sample = np.random.default_rng(2).integers(0, 1 << 62, 500).astype(np.uint64)
    for total in (10, 10**5, 10**9):
        groups, thresholds = simhash.plan(sample, total, simhash.SimHashParams())
        assert sum(t + 1 for t in thresholds) == 5 and sorted(b for g in groups for b in g) == list(range(64))


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs, Store(spark))
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 1, its repeat and 2 are copies; 4, 5, 7 and the null text have no word and so one fingerprint
    assert ids[1] == 1 and 2 not in ids and ids[4] == 1 and 5 not in ids and 7 not in ids and ids[3] == 1 and ids[6] == 1
    assert simhash.keep_one(empty_docs(spark), Store(spark)).count() == 0


# --- decontamination


def brute_alignment(item, words, match=1.0, miss=-0.5):
    rows = [[0.0] * (len(words) + 1) for _ in range(len(item) + 1)]
    best = 0.0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (match if a == b else miss), rows[i - 1][j] + miss, rows[i][j - 1] + miss)
            best = max(best, rows[i][j])
    return best / len(item)


def test_alignment_equals_the_full_matrix():
    rng = random.Random(4)
    for _ in range(20):
        item = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        words = [rng.randint(0, 6) for _ in range(rng.randint(1, 30))]
        got, _ = decontam.align(np.array(item, np.uint64), np.array([words], np.uint64), np.array([len(words)]), decontam.DecontamParams())
        assert got[0] == pytest.approx(brute_alignment(item, words))


def test_copies_and_edited_copies_are_found_and_clean_texts_left(spark):
    items = {i: invented(100 + i, 30) for i in range(12)}
    items |= {50: "two words", 51: "", 52: None}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    edited = items[3].split()
    edited[5], edited[17] = "changed", "words"
    del edited[10]
    texts = {
        0: invented(1, 200), 1: invented(2, 50) + " " + items[2].upper() + ". " + invented(3, 50), 2: " ".join(edited), 3: items[4] + " " + items[5],
        4: None, 5: "", 6: "here are two words indeed", 7: " ".join(items[6].split()[:8]), 8: (items[7] + " " + invented(8, 500)) * 3,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 4), (3, 5), (6, 50), (8, 7)}
    assert got[1, 2] == 1 and 0.7 < got[2, 3] < 1
    out = decontam.contaminate(odd_docs(spark), bench, "found_items")
    assert out.where("size(found_items) > 0").count() == 0 and out.count() == odd_docs(spark).count()
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.matches(empty_docs(spark), bench).count() == 0


def test_benchmark_blocks_give_the_same(spark):
    bench = spark.createDataFrame([(i, invented(200 + i, 20)) for i in range(9)], "item_id bigint, text string")
    docs = bench.selectExpr("item_id as doc_id", "text")
    params = decontam.DecontamParams(broadcast_words=5)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, params=params).collect()} == {(i, i) for i in range(9)}


def test_excerpts_of_an_item_that_leaked_a_thousand_times_are_found(spark):
    item = invented(300, 50).split()
    edited = [w if k % 4 < 3 else "changed" for k, w in enumerate(item)]  # no four words in a row
    texts = [(i, f"{invented(i, 20)} {' '.join(item)}") for i in range(1000)]
    texts += [(1000 + i, f"{invented(2000 + i, 30)} {' '.join(part)} {invented(3000 + i, 30)}") for i, part in enumerate([item[20:], item[:30], item[10:40], edited])]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.matches(docs, bench).collect()}
    assert set(got) == set(range(1004)) and all(got[i] == 1 for i in range(1000))
    assert all(got[i] >= 0.6 for i in (1000, 1001, 1002)) and got[1003] >= 0.5


def plain_score(item, words, p):
    """Smith-Waterman of two word lists, as a share of the item's own score."""
    best, before = 0.0, [0.0] * (len(words) + 1)
    for w in item:
        now = [0.0]
        for k, x in enumerate(words):
            now.append(max(0.0, before[k] + (p.match if w == x else p.mismatch), before[k + 1] + p.gap, now[k] + p.gap))
        best, before = max(best, *now), now
    return best / (p.match * len(item))


def leaky(rng, items):
    """Texts with whole, cut, reordered and edited items, some item in a third of all."""
    texts = []
    for i in range(90):
        item = list(items[0] if i % 3 == 0 else rng.choice(items))
        low = rng.randrange(max(len(item) // 2, 1))
        item = item[low:low + max(rng.randint(len(item) // 2, len(item)), 1)]
        for _ in range(rng.randint(0, 4)):
            item[rng.randrange(len(item))] = "other"
        texts.append(" ".join(invented(500 + i, rng.randint(0, 40)).split() + item + invented(900 + i, rng.randint(0, 40)).split()))
    return texts


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_every_pair_that_shares_three_words_is_aligned_in_memory_and_by_joins(spark, bound):
    """Against Smith-Waterman of all texts with all items: what shares three words in a row and scores enough, with its score."""
    rng, params = random.Random(14), decontam.DecontamParams(broadcast_words=bound, share_hits=7)
    items = [invented(700 + i, rng.randint(6, 30)).split() for i in range(12)] + [["two", "words"], ["one"]]
    texts = leaky(rng, items) + ["just two words here", "and one", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("row", F.lit("x")).withColumn("hits", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(0, " ".join(items[0])), (99, None)], "item_id bigint, text string")
    out = decontam.contaminate(docs, bench, params=params)
    assert out.columns == ["doc_id", "text", "row", "hits"]
    rows = out.collect()
    assert len(rows) == len(texts)
    got = {(r["doc_id"], h["item_id"]): h["score"] for r in rows for h in r["hits"]}
    score, sure = {}, set()
    for d, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        runs = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        for i, item in enumerate(items):
            score[d, i], n = plain_score(item, words, params), min(3, len(item))
            if runs(words, n) & runs(item, n) and score[d, i] >= params.least_score:
                sure.add((d, i))
    assert sure <= set(got) and len(sure) > 40 and all(score[k] >= params.least_score and abs(got[k] - score[k]) < 1e-9 for k in got)
    assert sum(len(r["hits"]) for r in rows) == len(got) + sum(k[1] == 0 for k in got)  # the item that is there twice is reported twice


def test_the_rarest_grams_of_every_stretch_are_seeds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, stretch = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        counts, grams = rng.integers(0, 4, n), rng.permutation(n).astype(np.uint64)
        key = [(c == 0, c, g) for c, g in zip(counts.tolist(), grams.tolist())]
        want = {min(range(k, min(k + stretch, n)), key=key.__getitem__) for k in range(max(n - stretch + 1, 1))}
        assert set(decontam.rarest(counts, grams, stretch).tolist()) == want


def test_stretches_that_are_left_out_could_not_reach_the_score(monkeypatch):
    monkeypatch.setattr(decontam, "GATHERED", 64)
    rng, params = random.Random(8), decontam.DecontamParams()
    items = [(i, np.array([rng.randint(1, 30) for _ in range(12)], np.uint64)) for i in range(8)]
    rows = [np.array([w for _ in range(6) for w in (items[rng.randrange(8)][1][rng.randrange(6):rng.randrange(6, 13)].tolist() + [rng.randint(1, 40)])], np.uint64) for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    seeds = decontam.Seeds(items, *decontam.item_grams(items, params.n))
    found = decontam.find(np.concatenate(rows), bounds, seeds, params)
    monkeypatch.setattr(decontam.Seeds, "most", lambda self, words, item, low, high, params: self.size_of[item])
    assert found == decontam.find(np.concatenate(rows), bounds, seeds, params) and sum(map(len, found)) > 10


# --- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_brute_force_and_models_add(spark):
    rng = random.Random(7)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    odd = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        f'é password = "{hexes[0]}" then token:abc and secret=token: abcdefgh', "AKIA" + "A1" * 8 + " AKIAAKIA" + "B2" * 9, "AKIASHORT x" + hexes[1],
        'Api_Key"="abc.def/ghi" PASSWD:x API-KEY=zzzzzz', "", None, "token=" * 700 + "abcdef", f"key {odd} end", invented(5, 300), "internationalizationofidentifiers",
    ] + [f"{invented(i, 40)} token={h} {h}" for i, h in enumerate(hexes)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = secret_scan.train(secret_scan.labelled_samples(docs.where("doc_id <> 7")))
    got = {r["doc_id"]: r for r in secret_scan.report(docs, table).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(brute_spans(t or "").encode()).hexdigest(), t
    assert got[7]["spans"] == "random:4:44" and not any(got[i]["n_random"] for i in (8, 9))
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, table).collect()}
    assert masked[7] == "key [SECRET] end" and masked[5] is None and masked[8] == texts[8] and hexes[0] not in masked[0] and "AKIAA" not in masked[1]
    assert masked[0].startswith('é password = "[SECRET]"')
    assert secret_scan.redact(odd_docs(spark), table).columns == odd_docs(spark).columns


def test_masked_texts_hold_no_character_of_a_secret(spark):
    """Prefixes, overlaps, repeats and neighbours of secrets, at places on both sides of a block's end."""
    rng = random.Random(21)
    draw = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    table = [0.0] * (secret_scan.CODES ** 2)
    for a in range(48, 123):
        for b in range(48, 123):
            table[a * secret_scan.CODES + b] = 2.0  # every long run is random to this model
    rows = []
    for i in range(60):
        one = draw(30)
        secrets = [one, one + draw(14), one[:24], "AKIA" + "A1B2" * 6, "deadbeef" * 5, draw(12) + "deadbeef" * 4 + draw(9)]
        text = "é" * rng.choice([0, 4000, 4060, 4090, 8150])
        for s in rng.choices(secrets, k=12):
            text += rng.choice([" plain ", "\n", " ü, ", " token: "]) + s
        text += " token:token:abcdefgh end"
        rows.append((i, text + " " + one, secrets))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, table).collect()}
    spans = {r["doc_id"]: r for r in secret_scan.scan(df, table, touching=True).collect()}
    for i, text, secrets in rows:
        hidden = np.zeros(len(text), bool)
        for s in [*spans[i]["random"], *spans[i]["base"]]:
            hidden[s["start"]:s["end"]] = True
        for s in spans[i]["base"]:
            if s["kind"] == 0:  # names stay
                low = s["end"] - len(re.search(secret_scan.ASSIGN.replace("\\x20", " "), s["value"]).group(2))
                hidden[s["start"]:low] = [any(o["kind"] and o["start"] <= k < o["end"] for o in spans[i]["base"]) for k in range(s["start"], low)]
        want, k = "", 0
        while k < len(text):
            if not hidden[k]:
                want += text[k]
                k += 1
                continue
            want += secret_scan.MASK
            while k < len(text) and hidden[k]:
                k += 1
        got = masked[i].replace(secret_scan.MASK * 2, secret_scan.MASK)
        assert got == want.replace(secret_scan.MASK * 2, secret_scan.MASK)
        left = masked[i].replace(secret_scan.MASK, " ")
        assert not any(s[k:k + 6] in left for s in secrets for k in range(len(s) - 5)), i
        assert masked[i].count("token:token:abcdefgh end") == 1  # the short match uses up the second word, as for the spans
    assert secret_scan.report(empty_docs(spark), secret_scan.train(secret_scan.labelled_samples(empty_docs(spark)))).count() == 0


def test_many_matches_keep_their_places(spark):
    text = " ".join(f"secret=abcdef{i} ü" for i in range(1500))
    got = secret_scan.report(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [0.0] * 128**2).first()
    assert got["n_assign"] == 1500 and got["base_sha256"] == hashlib.sha256(brute_spans(text).encode()).hexdigest()


# --- BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_equals_the_library(library):
    codec = bpe.Codec(vocabulary())
    rng = random.Random(3)
    pool = [*map(chr, range(0x20, 0x250)), *"   \n\t\r'sdmlt", "<|endoftext|>", "日", "本", "😀", " ", "　"]
    texts = ["", " ", "  a  b ", "a\n\nb \n", "don't we'll", "<|endoftext|><|endoftext|> x", "x" * 5000, invented(9, 300)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_memory_has_a_bound_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small, large = bpe.Codec(vocabulary()), bpe.Codec(vocabulary())
    text = invented(1, 200)
    assert small.encode(text) == small.encode(text) and len(small.memory) <= 6 and len(small.older[0]) <= 6
    monkeypatch.undo()
    assert small.encode(text) == large.encode(text)


def test_encoded_tables_decode_to_their_texts(spark):
    docs = odd_docs(spark)
    back = bpe.decode(bpe.encode(docs, vocabulary(), "token_ids"), vocabulary(), "again", "token_ids")
    assert sorted(r[0] for r in back.select("again").collect()) == sorted(r[0] or "" for r in docs.select("text").collect())
    assert bpe.digests(empty_docs(spark), vocabulary()).count() == 0


# --- PPM


def brute_ppm(train, order):
    levels = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        b = b"\n" * order + text.encode()
        for k in range(order, len(b)):
            for j in range(order + 1):
                levels[j][b[k - j:k]][b[k]] += 1

    def prob(context, byte):
        p, gone = 1.0, set()
        for j in range(order, -1, -1):
            seen = levels[j].get(context[order - j:])
            left = {a: n for a, n in (seen or {}).items() if a not in gone}
            if not left:
                continue
            total = sum(left.values()) + (0 if len(seen) == 256 else len(left))
            if byte in left:
                return p * left[byte] / total
            p *= len(left) / total
            gone |= set(left)
        return p / (256 - len(levels[0].get(b"", ())))

    def score(text):
        b = b"\n" * order + text.encode()
        return sum(math.log10(prob(b[k - order:k], b[k])) for k in range(order, len(b)))

    return prob, score


def test_scores_and_baseline_match_brute_force(spark):
    texts = [invented(i, 30) for i in range(20)] + ["", None, "Zürich " * 3, "\n\n tab\t", "ÿþ" * 20, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    params = ppm.PpmParams(order=3, head_words=8, block=64, flush=16)
    held = lang_id.fold(F.col("doc_id"), 7) == 2
    got = {r["id"]: r for r in ppm.score(docs, held, Store(spark), params=params).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    train = [t or "" for i, t in enumerate(texts) if not out[i]]
    _, score = brute_ppm(train, 3)
    words = Counter(w for t in train for w in [*WORDS.findall(lower(t)), None])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*WORDS.findall(lower(t or "")), None]
        assert got[i]["held_out"] == out[i] and got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(words[w] > 0 for w in tokens)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert got[i]["score"] == pytest.approx(score(t or ""), abs=1e-9)


def test_each_step_sums_to_one():
    train = ["abracadabra", "alakazam", "bca" * 5]
    keys = np.concatenate([k for t in train for _, k in ppm.context_keys(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 2, 99)])
    levels = [tuple(np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True)) for j in range(3)]
    trie = ppm.Trie([(k, n.astype(float)) for k, n in levels])
    for context in (b"ab", b"zz", b"\n\n", b"za", b"ra"):
        own = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], np.uint64)
        assert (10 ** trie.score(own)).sum() == pytest.approx(1)


def test_scoring_bears_odd_rows_and_small_bounds(spark):
    small = ppm.PpmParams(order=3, max_entries=50)
    docs = odd_docs(spark)
    rows = ppm.score(docs, F.lit(False), Store(spark), params=small).collect()
    assert len(rows) == docs.count() and all(r["score"] <= 0 for r in rows)
    assert ppm.score(empty_docs(spark), F.lit(False), Store(spark)).count() == 0
    unknown = ppm.score(docs.where("doc_id = 1"), F.lit(True), Store(spark)).first()
    assert unknown["score"] == pytest.approx(-len(EN) * math.log10(256)) and unknown["base_score"] == 0 and unknown["n_known"] == 0


@pytest.mark.parametrize("order, bound", [(4, 40), (3, 200), (2, 30)])
def test_scores_do_not_depend_on_the_bound_of_the_trie(spark, order, bound):
    texts = [invented(i, 40) for i in range(20)] + [EN, DE, "", None, "Zürich " * 3, "a" * 300, "qqq zzz xyx", "ÿþ" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = F.col("doc_id") % 3 == 1
    small = ppm.PpmParams(order=order, max_entries=bound, block=64, flush=16)
    got = {r["id"]: r["score"] for r in ppm.score(docs, held, Store(spark), params=small).collect()}
    _, score = brute_ppm([t or "" for i, t in enumerate(texts) if i % 3 != 1], order)
    assert got == pytest.approx({i: score(t or "") for i, t in enumerate(texts)}, abs=1e-9)


# --- passages


def brute_windows(hashes, width):
    out = set()
    for c in range(len(hashes)):
        low = high = c
        while low and hashes[low - 1] > hashes[c]:
            low -= 1
        while high + 1 < len(hashes) and hashes[high + 1] > hashes[c]:
            high += 1
        if high - low + 1 >= width:
            out.add((low, c, high))
    return out


def test_compact_windows_are_those_of_the_cartesian_tree():
    hashes = kernels.mix(np.arange(1, 400, dtype=np.uint64))
    bounds = np.array([0, 0, 150, 170, 399])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(hashes, bounds, 25))))
    want = {(a + l, a + c, a + h) for a, b in zip(bounds[:-1], bounds[1:]) for l, c, h in brute_windows((hashes[a:b] >> np.uint64(20)).tolist(), 25)}
    assert got == want


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    shared, other = invented(1000, 70), invented(1001, 60)
    edited = shared.split()
    edited[35] = "edited"
    texts = {
        1: invented(1, 150) + " " + shared + " " + invented(2, 80), 2: shared.upper() + " " + invented(3, 200), 3: invented(4, 90) + "\n" + " ".join(edited), 4: invented(5, 300),
        5: invented(6, 55) + " " + other, 6: other + " " + invented(7, 99), 7: " ".join(shared.split()[:30]) + " " + invented(8, 90), 8: None, 9: "", 10: "short text", 11: "short text",
        12: invented(9, 60), 13: invented(9, 60), 14: "same " * 200, 15: "word " + "same " * 150,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = passages.repeated_passages(docs, Store(spark)).collect()
    by = defaultdict(set)
    for r in rows:
        by[r["class_id"]].add(r["id"])
    assert {1, 2, 3} in by.values() and {5, 6} in by.values() and {12, 13} in by.values()
    assert not {r["id"] for r in rows} & {4, 7, 8, 9, 10, 11}
    span = next(r for r in rows if r["id"] == 1)
    assert abs(span["first_word"] - 150) <= 2 and abs(span["last_word"] - 219) <= 2
    assert passages.repeated_passages(empty_docs(spark), Store(spark)).count() == 0
    odd = {(r["id"], r["n_rows"]) for r in passages.repeated_passages(odd_docs(spark), Store(spark)).collect()}
    assert all(i in (6,) for i, _ in odd)


VOCABULARY = [f"w{i}" for i in range(3000)]


def passage_pair(rng, words, edits, core=()):
    """A passage and an edited copy that are similar as a whole; ``core`` stands in the middle of both."""
    while True:
        one = rng.choices(VOCABULARY, k=words)
        one[words // 2:words // 2 + len(core)] = core
        two = list(one)
        for _ in range(edits):
            at, kind = rng.randrange(len(two)), rng.randrange(3)
            if kind == 0:
                two[at] = rng.choice(VOCABULARY)
            elif kind == 1:
                two.insert(at, rng.choice(VOCABULARY))
            else:
                del two[at]
        x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (one, two))
        if min(len(x), len(y)) >= 46 and len(x & y) / len(x | y) >= 0.8 and (not core or " ".join(core) in " ".join(two)):
            return one, two


@pytest.mark.parametrize("words,edits", [(50, 0), (50, 1), (60, 1), (75, 2), (120, 3), (300, 6)])
def test_similar_stretches_are_found_among_other_words(words, edits):
    rng, params = random.Random(words), passages.PassageParams()
    tokens = lambda t: passages.text_tokens(pa.array([" ".join(t)]), 5)[0]
    for _ in range(60):
        one, two = passage_pair(rng, words, edits)
        a, b = (tokens(rng.choices(VOCABULARY, k=rng.randint(0, 60)) + p + rng.choices(VOCABULARY, k=rng.randint(0, 60))) for p in (one, two))
        found = passages.verify(a, b, params)
        assert found
        for i, j, u, v, like in found:
            x, y = set(a[i:j].tolist()), set(b[u:v].tolist())
            assert min(j - i, v - u) >= params.width and like == len(x & y) / len(x | y) >= params.similarity
        assert not passages.verify(tokens(rng.choices(VOCABULARY, k=150)), b, params)


def test_two_passages_in_other_order_are_both_found():
    rng, params = random.Random(5), passages.PassageParams()
    tokens = lambda t: passages.text_tokens(pa.array([" ".join(t)]), 5)[0]
    (one, two), (three, four) = passage_pair(rng, 80, 2), passage_pair(rng, 60, 1)
    a, b = tokens(one + rng.choices(VOCABULARY, k=30) + three), tokens(four + rng.choices(VOCABULARY, k=45) + two)
    assert len(passages.verify(a, b, params)) == 2


def test_edited_passages_are_found_in_hot_buckets_too(spark):
    """Recall of edited passages, alone and where a third of the texts share the shingle in their middle."""
    rng = random.Random(9)
    core, rows, kinds = rng.choices(VOCABULARY, k=5), [], {}
    for hot in (False, True):
        for words, edits in ((60, 1), (75, 2), (120, 3)):
            for _ in range(40):
                for text in passage_pair(rng, words, edits, core if hot else ()):
                    kinds[len(rows)] = (hot, words)
                    rows.append((len(rows), " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 80)) + text + rng.choices(VOCABULARY, k=rng.randint(0, 80)))))
    heads = [(10_000 + i, " ".join(rng.choices(VOCABULARY, k=60) + core + rng.choices(VOCABULARY, k=60))) for i in range(150)]
    docs = spark.createDataFrame(rows + heads, "doc_id bigint, text string")
    got = {r["id"]: r for r in passages.passage_report(docs, Store(spark)).collect()}
    assert len(got) == len(rows) + len(heads)
    found = Counter(kinds[i] for i in range(0, len(rows), 2) if got[i]["repeated"] and {p["class_id"] for p in got[i]["passages"]} & {p["class_id"] for p in got[i + 1]["passages"] or ()})
    assert all(found[k] >= 38 for k in set(kinds.values())), found
    for i, _ in heads:
        assert not got[i]["repeated"] and got[i]["class_id"] == i and got[i]["n_passages"] == 0 and got[i]["passages"] is None


@pytest.mark.parametrize("seed,few", [(1, 64), (1, 8), (3, 8)])
def test_every_pair_of_a_group_of_edited_copies_is_compared(spark, seed, few):
    """Copies so edited that few pairs are similar anywhere, so that the first text of a bucket says nothing of the others; linked by a join or in blocks."""
    rng, params = random.Random(seed), passages.PassageParams(few=few, block_texts=50)
    base, texts = rng.choices(VOCABULARY, k=110), []
    for _ in range(120):
        texts.append(list(base))
        for at in rng.sample(range(len(base)), 9):
            texts[-1][at] = rng.choice(VOCABULARY)
    texts = [" ".join(t) for t in texts]
    tokens = [passages.text_tokens(pa.array([t]), 5)[0] for t in texts]
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if passages.verify(tokens[i], tokens[j], params)}
    rows = passages.passage_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), Store(spark), params=params).collect()
    got = {r["id"]: r["class_id"] for r in rows}
    assert len(similar) > 4 and {r["id"] for r in rows if r["repeated"]} == {i for pair in similar for i in pair}
    assert all(got[i] == got[j] for i, j in similar)


def test_windows_of_equal_minima_are_one_and_every_two_texts_of_a_bucket_are_linked(spark):
    rng = random.Random(2)
    shared = rng.choices(VOCABULARY, k=60)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(VOCABULARY, k=30) + shared + rng.choices(VOCABULARY, k=30))) for i in range(6)] + [(6, "same " * 300), (7, "same " * 400)], "text_id bigint, text string")
    params = passages.PassageParams()
    windows = passages.file_windows(docs, params)
    assert windows.where("text_id > 5").count() == 2 * params.hashes
    links = passages.link_windows(passages.meetings(windows), params).select("x", "y", "hash").distinct().collect()
    pairs = Counter((r["x"], r["y"]) for r in links)
    assert set(pairs) == {(i, j) for j in range(6) for i in range(j)} | {(6, 7)} and set(pairs.values()) == {params.hashes}


def test_passage_query_against_all_exact_repeats(spark):
    """Every document that shares 50 words in a row with another is in the result; every other one in it shares nearly as much."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r["doc_id"]: [lower(w) for w in WORDS.findall(r["text"] or "")] for r in docs.collect()}
    holders, shingles = defaultdict(set), defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k:k + 50])].add(i)
        for k in range(len(w) - 4):
            shingles[tuple(w[k:k + 5])].add(i)
    exact = {i for h in holders.values() if len(h) > 1 for i in h}
    got = {r["doc_id"]: r for r in queries.op9_passages(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(words)
    repeated = {i for i, r in got.items() if r["repeated"]}
    assert exact and exact <= repeated
    for i in repeated - exact:
        shared = Counter(j for k in range(len(words[i]) - 4) for j in shingles[tuple(words[i][k:k + 5])] if j != i)
        assert max(shared.values()) >= 37  # 0.8 of 46 on both sides
    for r in got.values():
        assert r["repeated"] == (r["n_passages"] > 0) and (not r["repeated"] or r["class_id"] == min(p["class_id"] for p in r["passages"]))


def test_texts_and_their_spans_meet_where_joins_shuffle(spark):
    """Each side's partitions are merged in its own way, as on tables too large to broadcast: every span gets its tokens all the same."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(VOCABULARY, k=400))) for i in range(240)], "text_id bigint, text string")
    spans = spark.createDataFrame([(i, 10 + i % 5, 70) for i in range(200)], "text_id bigint, low bigint, high bigint")
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = passages.take_tokens(docs, spans, passages.PassageParams()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["text_id"], r["low"], len(r["tokens"]) // 8) for r in got) == [(i, 10 + i % 5, 61 - i % 5) for i in range(200)]


def test_passage_report_bears_odd_rows_and_an_empty_table(spark):
    got = passages.passage_report(odd_docs(spark), Store(spark)).collect()
    assert len(got) == odd_docs(spark).count() and {r["id"] for r in got if r["repeated"]} <= {6}
    assert passages.passage_report(empty_docs(spark), Store(spark)).count() == 0


def test_short_words_merge_as_the_queue_does(monkeypatch):
    from thermogrid.llm.queries import vocabulary

    tables, rng = vocabulary(), random.Random(4)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for letters in ("ab", "etaoinshr", "aé漢 0'") for _ in range(200)]
    scanned = list(map(bpe.Codec(tables).merge, [w.encode() for w in words]))
    monkeypatch.setattr(bpe, "SCANNED_LENGTH", 0)
    assert scanned == list(map(bpe.Codec(tables).merge, [w.encode() for w in words]))
