"""Reply trees as training conversations.

Messages ``(tree, node, parent, role, text, score)`` are nodes of reply trees; a node without parent, or whose parent isn't in its tree, is a
root. Iterative self-joins enumerate the path from each leaf to its root: a round joins every path so far with the nodes' ancestors at twice the
distance of the round before, so a path of n turns takes log2(n) rounds, and rows are never more than the paths' own. Branches are
ranked by the sum of their scores; the best ``branches`` of a tree, or all, are formatted. Nodes that lie on a cycle of parents, or below one, reach no
root: their jumps never end, which a round that loses no node shows, and they lie on no path.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed for each turn. Inside roles and texts a backslash is doubled and a backslash is put
between ``<`` and ``|``, so no control string can occur there, and reading removes exactly what writing put in. The loss mask covers assistants' texts.

DataFrame functions only. A conversation is one value in the end, so its turns meet in one task; only ids take part in the
iteration. Defined results: null role or text counts as empty, null score as 0; turns of equal number come by role, then text; of messages with the
same number in a tree the least parent counts, and each is a turn; null conversation ids are one conversation of null id; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Store

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
LOSS_ROLE = "assistant"
BLOCK = 4096


@dataclass(frozen=True)
class ChatParams:
    branches: int | None = None
    rounds: int = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _jumps(up: DataFrame, store: Store, rounds: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Each node's ancestor at distance 1, 2, 4, ... of ``up(tree, node, above)``, and the nodes that have one at any distance: those on a cycle or below one.

    A round that leaves as many nodes as it found has left out the last one that reaches a root, as depths have no gaps.
    """
    steps, left = [up], up.count()
    for _ in range(rounds):
        if not left:
            return steps[:-1], None
        last = steps[-1]
        onward = last.select("tree", "node", F.col("above").alias("middle")).join(
            last.select("tree", F.col("node").alias("middle"), "above"), ["tree", "middle"]).select("tree", "node", "above")
        onward = store.put(onward)
        now = onward.count()
        if now == left:
            return steps, onward.select("tree", "node")
        steps, left = [*steps, onward], now
    raise RuntimeError(f"a path is longer than {rounds} doublings reach")


def paths(messages: DataFrame, store: Store, params: ChatParams = ChatParams()) -> DataFrame:
    """``(tree, leaf, node, distance)`` for every node on every root-to-leaf path; distance counts from the leaf."""
    ids = store.put(messages.groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    real = ids.select("tree", F.col("node").alias("parent"))
    up = store.put(ids.where("parent is not null").join(real, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")))
    steps, endless = _jumps(up, store, params.rounds)
    leaves = ids.join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, ["tree", "node"], "left_anti")
    found = store.put(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")))
    for k, step in enumerate(steps):
        # of leaves that reach a root, every ancestor does
        further = found.join(step, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        longer = store.put(found.unionByName(further))
        store.drop(found)
        if k:
            store.drop(step)
        found = longer
    return found


def rank_branches(path_rows: DataFrame, messages: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """``(tree, leaf, score)`` of the chosen branches."""
    scores = path_rows.join(messages.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    if params.branches is None:
        return scores
    rank = F.expr("row_number() over (partition by tree order by score desc, leaf)")
    return scores.withColumn("rank", rank).where(F.col("rank") <= params.branches).drop("rank")


def format_paths(path_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``(tree, leaf, formatted, loss_spans)``: one conversation a path; spans (start, end) are code points of the formatted text."""
    turns = path_rows.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    turns = turns.select("tree", "leaf", "distance", (role == LOSS_ROLE).alias("loss"), F.length(head).cast("long").alias("before"), F.length(escape(text)).cast("long").alias("chars"),
                         F.concat(head, escape(text), F.lit(END)).alias("turn"))
    at = "sum(before + chars + {n}L) over (partition by tree, leaf order by distance desc)".format(n=len(END))
    placed = turns.withColumn("end", F.expr(at) - len(END))
    made = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "turn", "loss", (F.col("end") - F.col("chars")).alias("start"), "end"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return made.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    # the last turn's end is a line feed too, as nothing is trimmed
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substr(p, F.locate(TEXT, p) + len(TEXT), F.length(p) - F.locate(TEXT, p) - len(TEXT) + 1 - len(END))).alias("text")))


def linear(conversations: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of conversations as messages: each turn answers the one before it."""
    rows = conversations.select(F.col(tree).cast("string").alias("name"), F.col(order).alias("turn"), F.col("role"), F.col("text"))
    rows = rows.withColumn("tree", F.coalesce("name", F.lit("-")))
    number = F.expr("row_number() over (partition by tree order by turn nulls first, role nulls first, text nulls first)").cast("long")
    numbered = rows.withColumn("node", number)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(messages: DataFrame, store: Store, params: ChatParams = ChatParams()) -> DataFrame:
    """Chosen branches of all trees, formatted; ``messages`` is read several times and so should be a table."""
    rows = paths(messages, store, params)
    chosen = rank_branches(rows, messages, params) if params.branches is not None else None
    return format_paths(rows.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi") if chosen is not None else rows, messages)


def report(conversations: DataFrame, store: Store) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, and of one conversation (-7) whose texts hold control strings."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    messages = store.put(linear(rows))
    formatted = store.put(format_trees(messages, store, ChatParams(branches=1)))  # a linear conversation has one branch, so all of it stays
    return digests(formatted)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the mask, escapes removed. The conversation is cut into blocks first, so that a span far behind costs no walk from the start."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def under(block: Column, k: Column) -> Column:
        low, high = k * BLOCK, (k + 1) * BLOCK
        inside = F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))
        return F.array_join(F.transform(inside, lambda s: F.substr(
            block, (F.greatest(s["start"] - low, F.lit(0)) + 1).cast("int"), (F.least(s["end"], high) - F.greatest(s["start"], low)).cast("int"))), "")

    return unescape(F.array_join(F.transform(blocks, under), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """What ``formatted(tree, formatted, loss_spans)`` reads back as: the turns from the text, the loss from the text under its spans."""
    back = formatted.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "-", F.col("tree").try_cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
