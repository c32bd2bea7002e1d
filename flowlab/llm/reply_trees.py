"""Reply trees as conversations: every path from a root to a message that nobody answers, ranked by score, is one formatted text.

Messages name the message they answer. Iterative self-joins double the distance: after round k every message knows its ancestor 2^k
replies above, or its root, and the scores on the way, so a tree of depth d takes log2(d) rounds. Branches are ranked by the leaves' totals,
and only the chosen leaves' paths are enumerated, by the same tables from the longest jump to the shortest: each ancestor is
reached once, by the binary digits of its distance. Rounds carry numbers; texts are joined to the paths at the end.

Format: each turn is ``<|role|>``, the text and ``</s>``; roles are percent-encoded. In texts, ``<|``, ``</s>``, ``<s>``, ``[INST]`` and ``[/INST]``
get a backslash after their first character, and so do those that have backslashes there already; removing one gives the text
back, whatever it holds. The loss mask is a list of spans of code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.llm.common import written

RESTS = (r"\|", "/s>", "s>", r"INST\]", r"/INST\]")  # what makes a control string after its first character; none holds a first character
STARTS = r"[<\[]"
TRAINED = "assistant"
_plain = re.compile(rf"({STARTS})(\\*)(?={'|'.join(RESTS)})")
_escaped = re.compile(rf"({STARTS})\\(\\*)(?={'|'.join(RESTS)})")
_turn = re.compile(r"<\|([^|<>]*)\|>(.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _plain.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text, trained) turns and the spans (start, length) of the trained ones in it, in code points."""
    parts, spans, at = [], [], 0
    for role, text, trained in turns:
        head, body = f"<|{quote(role, safe='')}|>", escape(text)
        if trained:
            spans.append((at + len(head), len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unquote(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def chain_messages(rows: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """Messages (tree, node, up, role, text, score) of conversations that are lists: each row answers the one before it, by ``order`` (nulls
    first), then role and text; rows that repeat are turns like others. Null conversations are one conversation, null roles and texts are empty."""
    plain = rows.select(F.col(conversation).alias("tree"), F.col(order).alias("place"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    kept = written(plain.withColumn("node", F.monotonically_increasing_id()), "messages")
    line = Window.partitionBy("tree").orderBy("place", "role", "text", "node")
    return kept.withColumn("up", F.lag("node").over(line)).withColumn("score", F.lit(None).cast("double")).drop("place")


def tree_messages(rows: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str) -> DataFrame:
    """Messages (tree, node, up, role, text, score) of threads. A row whose parent is null, or is no message of its tree, is a root. Of rows
    that share tree and id, the least by (role, text, score) is answered; the others are leaves of their own, none is lost."""
    named = {"tree": tree, "id": message, "parent": parent, "role": role, "text": text, "score": score}
    plain = rows.select(*(F.col(c).alias(n) for n, c in named.items()))
    plain = plain.withColumns({"score": F.col("score").cast("double"), **{n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text")}})
    kept = written(plain.withColumn("node", F.monotonically_increasing_id()), "messages")
    answered = kept.where("id is not null").groupBy(F.col("tree").alias("its_tree"), F.col("id").alias("its_id")).agg(F.min(F.struct("role", "text", "score", "node"))["node"].alias("up"))
    same = F.col("tree").eqNullSafe(F.col("its_tree")) & (F.col("parent") == F.col("its_id"))
    return kept.join(answered, same, "left").select("tree", "node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("up"), "role", "text", "score")


@dataclass(frozen=True)
class Jumps:
    """tables[k]: (node, up), the ancestor 2^k replies above, where there is one; roots: (node, root, score: the mean of the path's known ones)."""

    tables: list[DataFrame]
    roots: DataFrame


def jumps(messages: DataFrame) -> Jumps:
    """Rounds of self-joins until every message has its root. Messages in a circle of replies, or below one, have none and are left out: no path from a root leads to them."""
    known = F.coalesce(F.col("score"), F.lit(0.0))
    now = written(messages.select("node", "up", F.col("node").alias("root"), known.alias("total"), F.col("score").isNotNull().cast("long").alias("n")), "jumps")
    count, tables = now.count(), []
    while True:
        climbing = now.where("up is not null")
        if (1 << len(tables)) >= 2 * max(count, 1) or climbing.isEmpty():
            break
        tables.append(climbing.select("node", "up"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("total").alias("more"), F.col("n").alias("m"))
        further = climbing.join(above, "up").select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        now = written(now.where("up is null").unionByName(further), "jumps")
    mean = F.col("total") / F.when(F.col("n") > 0, F.col("n"))
    return Jumps(tables, now.where("up is null").select("node", "root", mean.alias("score")))


def choose_leaves(messages: DataFrame, found: Jumps, branches: int | None = None) -> DataFrame:
    """(leaf, root, rank): messages that nobody answers, of each root the best ``branches`` by mean score (unknown last; ties by the text), all if None."""
    leaves = messages.join(messages.where("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    ranked = leaves.select("node", F.sha2("text", 256).alias("tie")).join(found.roots, "node")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("score").desc_nulls_last(), "tie", "node"))
    chosen = ranked.withColumn("rank", rank)
    return written((chosen.where(F.col("rank") <= branches) if branches else chosen).select(F.col("node").alias("leaf"), "root", "rank"), "leaves")


def paths(leaves: DataFrame, found: Jumps) -> DataFrame:
    """(leaf, node, above): every message on the path of each leaf, ``above`` replies above it."""
    have = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(found.tables))):
        further = have.join(found.tables[k], "node").select("leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        have = written(have.unionByName(further), "paths")
    return have


def format_trees(messages: DataFrame, branches: int | None = None, trained: Column | None = None) -> DataFrame:
    """(tree, rank, n_turns, formatted, loss) of each chosen path: loss has the spans (start, length) of the trained texts (by default the assistant's).

    A message on several chosen paths is trained in the one of the best rank only, so each text counts once. A path is one row: its texts must fit in a task."""
    found = jumps(messages)
    leaves = choose_leaves(messages, found, branches)
    steps = paths(leaves, found).join(leaves.select("leaf", "rank"), "leaf")
    first = steps.groupBy("node").agg(F.min(F.struct("rank", "leaf")).alias("first"))
    is_trained = F.col("role") == TRAINED if trained is None else trained
    texts = messages.select("tree", "node", "role", "text", F.coalesce(is_trained, F.lit(False)).alias("trained")).join(first, "node")
    turns = steps.join(texts, "node").withColumn("trained", F.col("trained") & (F.col("first") == F.struct("rank", "leaf")))
    turn = F.struct((-F.col("above")).alias("place"), "role", "text", "trained")
    grouped = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = StructType.fromDDL(f"tree {messages.schema['tree'].dataType.simpleString()}, rank int, n_turns long, formatted string, loss array<struct<start: long, length: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a path at a time: what is held besides the batch is one text
                own = batch.slice(i, 1)
                turns = own.column(2)[0].as_py()
                text, spans = format_turns([(t["role"], t["text"], t["trained"]) for t in turns])
                loss = pa.array([[{"start": a, "length": n} for a, n in spans]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([len(turns)], pa.int64()), pa.array([text]), loss], names=schema.names)

    return grouped.select("tree", "rank", "turns").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, rank, turns, loss_text, formatted_chars) from ``formatted`` and ``loss`` alone: turns as role, text; loss_text: all trained texts, nothing between."""
    rows = formatted.select("tree", "rank", "formatted", "loss")
    schema = StructType.fromDDL(f"tree {formatted.schema['tree'].dataType.simpleString()}, rank int, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long")
    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                text, spans = own.column(2)[0].as_py(), own.column(3)[0].as_py()
                turns = pa.array([[{"role": r, "text": t} for r, t in read_turns(text)]], pair)
                lost = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), turns, pa.array([lost]), pa.array([len(text)], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
