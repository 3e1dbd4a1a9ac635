import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.llm import chat, graph, nndescent, warc
from thermogrid.llm.support import CLEANUP, Store
from thermogrid.session import scratch_path

# --- components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(300, 300), (400, 401), (401, 400), (None, 5)]
    edges += [(rng.randint(500, 540), rng.randint(500, 540)) for _ in range(30)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Store(spark)).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# --- vectors


def test_links_and_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(40)]  # one group beyond the lists
    rows += [(200 + i, base[1].tolist()) for i in range(5)] + [(210, (base[1] * 4).tolist()), (5, base[5].tolist())]
    odd = [(300, None), (301, [0.0] * 16), (302, [1.0, None] + [0.0] * 14), (303, [float("nan")] * 16), (304, [float("inf")] + [1.0] * 15), (305, [1.0, 2.0]), (306, []), (307, [1e-200] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = nndescent.near_duplicates(df, Store(spark), params=nndescent.DescentParams(neighbours=6, run=32, tables=6, block=16)).collect()
    assert len(got) == len(rows) + len(odd)
    full = [(i, np.array(v)) for i, v in rows + [odd[-1]]]
    unit = np.array([v / np.abs(v).max() for _, v in full])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = [i for i, _ in full]
    for _ in range(8):
        for i, j in zip(*np.nonzero(near)):
            label[i] = label[j] = min(label[i], label[j])
    want = sorted((i, int(n) - 1, c, i == c) for (i, _), n, c in zip(full, near.sum(axis=1), label))
    plain = {x[0] for x in odd[:-1]}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] not in plain) == want
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if r["vec_id"] in plain)
    assert got[0]["audit_recall"] == 1
    assert nndescent.near_duplicates(df.limit(0), Store(spark)).count() == 0


def isolated_pairs(n, size=64, cosine=0.905):
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, other = unit(rng.standard_normal((n, size))), rng.standard_normal((n, size))
    other = unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    return one, cosine * one + np.sqrt(1 - cosine**2) * other


def vectors(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")


def test_isolated_pairs_meet_however_many_vectors_there_are(spark):
    df = vectors(spark, np.concatenate(isolated_pairs(2000)))
    got = nndescent.near_duplicates(df, Store(spark), params=nndescent.DescentParams(run=4, rounds=0, attempts=1)).where("n_links = 1").count()
    assert got >= 0.98 * 4000


def test_pairs_that_lists_and_runs_leave_out_are_found_exactly(spark):
    rows = np.concatenate([*isolated_pairs(200), np.ones((3, 5 * 64)).reshape(-1, 64)])
    blind = nndescent.DescentParams(tables=1, least_miss=0.999, run=4, rounds=0, attempts=1, least_recall=0.0)
    got = nndescent.near_duplicates(vectors(spark, rows), Store(spark), params=blind)
    assert got.where("audit_recall < 1").count() == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()} == (
        {(i, 1, i % 200) for i in range(400)} | {(i, 14, 400) for i in range(400, 415)})


def test_a_large_group_does_not_hide_lost_pairs(spark):
    one, other = isolated_pairs(300)
    group = one[0] + 0.01 * np.random.default_rng(1).standard_normal((400, 64))
    blind = nndescent.DescentParams(planes=1, run=20, rounds=1, attempts=1)
    with pytest.raises(RuntimeError, match="audited recall"):
        nndescent.near_duplicates(vectors(spark, np.concatenate([group, one[1:], other[1:]])), Store(spark), params=blind)


# --- archives


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>ü</p>" * 300, "<p>x</p>"
    rows = [(1, "http://a/é", big), (2, "http://b", big), (3, "http://c", small), (4, "http://d", small), (5, None, None), (6, "http://e\r\nx", ""), (None, "http://f", big), (7, "u", big + "z"), (7, "u", big + "z")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_give_back_every_page(spark, pages):
    path = scratch_path(spark)
    warc.write(pages, path, Store(spark))
    got = warc.page_report(spark, path).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    big = "<p>ü</p>" * 300
    want = {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2), (7, "response", None)}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == 9
    by = {r["page_id"]: r for r in got}
    for i, t in ((1, big), (2, big), (3, "<p>x</p>"), (5, None), (7, big + "z")):
        assert by[i]["payload_digest"] == sha(t) and by[i]["payload_bytes"] == len((t or "").encode())
    urls = {r["record_id"]: r["target_uri"] for r in warc.read(spark, path, payload=False).collect()}
    assert urls["urn:page:1"] == "http://a/é" and urls["urn:page:6"] == "http://e\r\nx" and urls["urn:page:5"] == ""


def test_filters_are_pushed_and_payloads_skipped(spark, pages):
    path = scratch_path(spark)
    warc.write(pages, path, Store(spark))
    some = warc.read(spark, path, payload=False).where("warc_type = 'revisit' and content_length > 10 and target_uri like 'http://a%'")
    assert [r["record_id"] for r in some.collect()] == ["urn:page:1"] and some.first()["payload"] is None
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "warc_type" not in plan.split("Filter", 1)[-1].split("\n")[0].replace("isnotnull(warc_type", "")
    empty = scratch_path(spark)
    warc.write(pages.limit(0), empty, Store(spark))
    assert warc.page_report(spark, empty).count() == 0


def test_members_without_sizes_and_plain_files_are_read(tmp_path):
    import gzip
    import io

    records = [warc.record_bytes(f"urn:page:{i}", "u", b"x" * n, n, "00" * 20, None) for i, n in enumerate((0, 10, 50_000))]
    zipped = io.BufferedReader(io.BytesIO(b"".join(gzip.compress(r) for r in records)))
    assert [len(r[-1]) for r in warc.read_members(zipped, [], True)] == [0, 10, 50_000]
    assert [len(r[-1]) for r in warc.read_plain(io.BytesIO(b"".join(records)), [("=", "record_id", "urn:page:2")], True)] == [50_000]


def test_foreign_and_broken_archives_give_defined_rows(spark, tmp_path):
    import gzip
    import io

    def raw(fields, block=b"body"):
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"

    sha = hashlib.sha1(b"body")
    import base64
    b32 = base64.b32encode(sha.digest()).decode()
    records = [
        raw([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/\\u00zz/é"), ("WARC-Payload-Digest", "sha1:" + b32.lower()), ("Content-Length", 4)]),
        raw([("warc-type", "resource"), ("WARC-Payload-Digest", "SHA1:" + sha.hexdigest().upper()), ("content-length", "4"), ("WARC-Date", "2020\r\n -01")]),
        raw([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + "1" * 32), ("Content-Length", 37)], b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n"[:37]),
        raw([("WARC-Type", "metadata"), ("WARC-Payload-Digest", "md5:zz"), ("Content-Length", "-4")]),
        raw([("WARC-Type", "metadata"), ("no colon", "")]),
        b"nothing of the kind\r\n\r\n",
    ]
    rows = list(warc.read_members(io.BufferedReader(io.BytesIO(b"".join(gzip.compress(r) for r in records))), [], True))
    names = [c.split()[0] for c in warc.SCHEMA.split(", ")]
    got = [dict(zip(names, r)) for r in rows]
    assert [g["warc_type"] for g in got] == ["response", "resource", "response", "metadata", "metadata"]
    assert got[0]["target_uri"] == "http://a/\\u00zz/é" and got[0]["payload_digest"] == got[1]["payload_digest"] == sha.hexdigest() and got[1]["date"] == "2020 -01"
    assert got[2]["payload_digest"] == "sha1:" + "1" * 32 and [g["content_length"] for g in got] == [4, 4, 37, None, None]
    assert [g["payload"] for g in got] == [b"body", b"body", b"", b"body", b"body"]
    plain = [dict(zip(names, r)) for r in warc.read_plain(io.BytesIO(b"junk\r\n" + b"".join(records)), [], True)]
    assert [(g["warc_type"], g["payload"]) for g in plain] == [("response", b"body"), ("resource", b"body"), ("response", b""), ("metadata", None)]
    whole = gzip.compress(records[0])
    for broken in (whole + gzip.compress(records[1])[:30], whole + b"\x1f\x8b\x08" + b"garbage" * 9, whole + b"no gzip here, just text", whole[:-20]):
        assert len(list(warc.read_members(io.BufferedReader(io.BytesIO(broken)), [], True))) in (0, 1) and (broken == whole[:-20] or len(list(warc.read_members(io.BufferedReader(io.BytesIO(broken)), [], True))) == 1)
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    df = warc.read(spark, str(tmp_path))
    assert df.count() == 5 and df.where("content_length > 3").count() == 3 and df.where("target_uri like 'http%'").count() == 1


def test_urls_of_all_kinds_come_back(spark):
    urls = ["http://a/\\u0041\\x", " leading", "trailing ", "tab\tin", "nul\x00", "\u2028line", "é\r\nWARC-Type: x", "\x85", "emoji 😀", "", "a  b", " é "]
    path = scratch_path(spark)
    warc.write(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("html", F.lit("x")), path, Store(spark))
    got = {r["record_id"]: r["target_uri"] for r in warc.read(spark, path, payload=False).collect()}
    assert [got[f"urn:page:{i}"] for i in range(len(urls))] == urls


def test_parts_of_tasks_that_failed_are_never_seen(tmp_path, pages, spark):
    path = str(tmp_path / "a")
    warc.write(pages, path, Store(spark))
    (tmp_path / "a" / "_passing-part-x.warc.gz").write_bytes(b"broken")
    reader = warc.WarcReader(path, True, 1)
    assert not any("_passing" in p for part in reader.partitions() for p in part.paths)


# --- chat

MESSAGES = "tree string, node bigint, parent bigint, role string, text string, score double"


def test_all_paths_of_a_tree_ranked_and_formatted(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "c", 9.0), ("t", 5, 4, "assistant", "d", None),
            ("t", 6, 3, "user", "e", 1.0), ("u", 1, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 2, "user", "z", 0.0)]
    messages = spark.createDataFrame(rows, MESSAGES)
    found = {(r["tree"], r["leaf"], r["node"]): r["distance"] for r in chat.paths(messages, Store(spark), chat.ChatParams(rounds=6)).collect()}
    assert found == {("t", 5, 5): 0, ("t", 5, 4): 1, ("t", 5, 2): 2, ("t", 5, 1): 3, ("t", 6, 6): 0, ("t", 6, 3): 1, ("t", 6, 1): 2, ("u", 1, 1): 0}
    best = chat.format_trees(messages, Store(spark), chat.ChatParams(branches=1, rounds=6)).where("tree = 't'").collect()
    assert [r["leaf"] for r in best] == [5]
    text = best[0]["formatted"]
    assert [text[s["start"]:s["end"]] for s in best[0]["loss_spans"]] == ["a", "d"]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_cycles_end_and_lie_on_no_path(spark, size):
    rows = [("c", i, (i + 1) % size, "user", "x", 0.0) for i in range(size)] + [("c", 100, 0, "user", "below", 0.0), ("c", 101, 100, "user", "leaf", 0.0)]
    rows += [("c", 200 + i, 199 + i if i else None, "user", "good", 0.0) for i in range(11)] + [("t", i, i - 1 if i else None, "user", "long", 0.0) for i in range(40)]
    found = chat.paths(spark.createDataFrame(rows + rows[:3], MESSAGES), Store(spark)).collect()
    assert len(found) == 51 and {(r["tree"], r["leaf"]) for r in found} == {("c", 210), ("t", 39)}
    assert {(r["node"], r["distance"]) for r in found if r["tree"] == "t"} == {(i, 39 - i) for i in range(40)}


def test_the_loss_is_read_through_the_mask(spark):
    rng = random.Random(5)
    texts = ["\\<|ü" * rng.randint(0, 3000) + str(t) for t in range(9)]
    rows = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_trees(chat.linear(rows), Store(spark))
    loss = lambda df: chat.digests(df).first()
    whole = loss(formatted)
    said = "".join(texts[1::2])
    assert (whole["loss_chars"], whole["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    moved = loss(formatted.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('start', s.start, 'end', s.end - 1))")))
    assert moved["loss_sha256"] != whole["loss_sha256"] and moved["turns_sha256"] == whole["turns_sha256"] and moved["loss_chars"] == len(said) - 4
    assert loss(formatted.withColumn("loss_spans", F.slice("loss_spans", 1, 0)))["loss_chars"] == 0


def test_conversations_read_back_as_they_were(spark):
    rng = random.Random(2)
    bits = ["\\", "<|", "<|end|>\n", "<|turn|>", "<|text|>", "<", "|", "\n", "ü", "ok", "\\|", "<\\|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(90, 0, "user", None), (90, 0, None, "tie"), (90, None, "assistant", ""), (None, 1, "user", "nobody"), (91, 0, "assistant", "x"), (91, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("leaf", F.lit(None).cast("string"))
    got = {r["conv_id"]: r for r in chat.report(df, Store(spark)).collect()}
    first = lambda x: (x is not None, x)
    for c, turns in itertools.groupby(sorted([*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], key=lambda r: tuple(map(first, r))), key=lambda r: r[0]):
        turns = list(turns)
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns)
        loss = "".join(x or "" for _, _, r, x in turns if r == "assistant")
        r = got.pop(c)
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest(), c
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not got
    assert [r["conv_id"] for r in chat.report(df.limit(0), Store(spark)).collect()] == [-7]


def test_the_report_ranks_branches_and_keeps_every_turn(spark, monkeypatch):
    asked, rank = [], chat.rank_branches
    monkeypatch.setattr(chat, "rank_branches", lambda rows, messages, params: asked.append(params.branches) or rank(rows, messages, params))
    df = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(1, 6) for t in range(c)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.report(df, Store(spark)).collect()}
    assert asked == [1] and got == {-7: 2} | {c: c for c in range(1, 6)}


def test_loss_spans_cover_assistants_texts(spark):
    rows = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"<|é{t}|>") for t in range(7)], "conv_id bigint, turn bigint, role string, text string")
    messages = chat.linear(rows)
    r = chat.format_trees(messages, Store(spark)).first()
    assert [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]] == [f"<\\|é{t}|>" for t in (1, 3, 5)]


def test_shuffles_of_a_stored_table_are_deleted(spark):
    seen, before = [], spark.conf.get(CLEANUP, None)
    rows = spark.range(20).groupBy((F.col("id") % 3).alias("k")).count()
    real = type(rows).write

    class Watched(type(rows)):
        @property
        def write(self):
            seen.append(spark.conf.get(CLEANUP, None))
            return real.fget(self)

    rows.__class__ = Watched
    assert Store(spark).put(rows).count() == 3
    assert seen == ["true"] and spark.conf.get(CLEANUP, None) == before
