"""Reply trees as training conversations.

Messages name the message they answer. Self-joins that double their reach, as many as the depth
has binary digits, find each message's depth and the score of the branch it ends; a second
series walks back from the chosen leaves. Each chosen root-to-leaf path becomes one text whose
control strings can't come from a message: the characters they are made of are escaped there.

Defined results: a null role or text is empty; an answer to a message that isn't there starts a
tree of its own; messages that answer each other in a circle have no root and are left out; of
branches with equal scores the one whose leaf has the smaller id comes first; of repeated
(tree_id, msg_id) rows the first by role and text counts; an empty table gives an empty table;
other columns are ignored.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.common import Scratch

# The control strings of the template.
USER, USER_END, ASSISTANT_END = "[INST] ", " [/INST]", " </s>"
OTHER, OTHER_NAMED, OTHER_END = "<<", ">>\n", "\n<</>>"

_SPECIAL = re.compile(r"([\\<>\[\]])")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One text of (role, text) turns, and the spans of assistant texts in it, in code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            before, after = USER, USER_END
        elif role == "assistant":
            before, after = "", ASSISTANT_END
        else:
            before, after = OTHER + escape(role) + OTHER_NAMED, OTHER_END
        if role == "assistant":
            spans.append((at, at + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], 0

    def until(end: str, start: int) -> tuple[str, int]:
        """Up to a control string; escaped, its first bracket or its second one follows a backslash."""
        pos = text.index(end, start)
        return text[start:pos], pos + len(end)

    while at < len(text):
        if text.startswith(USER, at):
            body, at = until(USER_END, at + len(USER))
            turns.append(("user", unescape(body)))
        elif text.startswith(OTHER, at):
            name, at = until(OTHER_NAMED, at + len(OTHER))
            body, at = until(OTHER_END, at)
            turns.append((unescape(name), unescape(body)))
        else:
            body, at = until(ASSISTANT_END, at)
            turns.append(("assistant", unescape(body)))
    return turns


def _same(a: str, b: str):
    return F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Messages on the ``branches`` best root-to-leaf paths of each tree: tree_id, leaf_id, branch (from 1), depth, role, text.

    ``messages`` has tree_id, msg_id, parent_id (null for a root), score, role and text.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    messages = messages.select("tree_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    first = F.min(F.struct("role", "text", "parent_id", "score")).alias("m")
    messages = scratch.write(messages.groupBy("tree_id", "msg_id").agg(first).select("tree_id", "msg_id", "m.*"), "messages")
    known = messages.select("tree_id", "msg_id")

    there = messages.alias("a").join(known.alias("b"), _same("a", "b") & (F.col("a.parent_id") == F.col("b.msg_id")), "left")
    jump = there.select("a.tree_id", "a.msg_id", F.col("b.msg_id").alias("up"), F.col("a.score").alias("total"), F.lit(1).cast("bigint").alias("depth"))
    jump = scratch.write(jump, "jump-0")
    # Messages whose path is complete stay as they are; only the others are joined again.
    rooted, active, jumps = jump.where("up IS NULL"), jump.where("up IS NOT NULL"), []
    limit = max(1, messages.count()).bit_length() + 1
    while len(jumps) <= limit and not active.isEmpty():
        jumps.append(active)
        a, b = active.alias("a"), rooted.unionByName(active).alias("b")
        joined = a.join(b, _same("a", "b") & (F.col("a.up") == F.col("b.msg_id")))
        plus = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c)
        joined = scratch.write(joined.select("a.tree_id", "a.msg_id", "b.up", plus("total"), plus("depth")), f"jump-{len(jumps)}")
        rooted, active = rooted.unionByName(joined.where("up IS NULL")), joined.where("up IS NOT NULL")
    rooted = rooted.select("tree_id", "msg_id", "total", "depth")

    answered = jump.where("up IS NOT NULL").select("tree_id", F.col("up").alias("msg_id")).distinct()
    leaves = rooted.alias("a").join(answered.alias("b"), _same("a", "b") & (F.col("a.msg_id") == F.col("b.msg_id")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("total"), "msg_id")
    leaves = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    walk = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "branch", "msg_id")
    for k, hop in enumerate(jumps):
        up = walk.alias("a").join(hop.alias("b"), _same("a", "b") & (F.col("a.msg_id") == F.col("b.msg_id")))
        walk = scratch.write(walk.unionByName(up.select("a.tree_id", "a.leaf_id", "a.branch", F.col("b.up").alias("msg_id"))), f"walk-{k}")

    placed = walk.alias("a").join(rooted.alias("b"), _same("a", "b") & (F.col("a.msg_id") == F.col("b.msg_id")))
    placed = placed.select("a.*", "b.depth").alias("a").join(messages.alias("b"), _same("a", "b") & (F.col("a.msg_id") == F.col("b.msg_id")))
    return placed.select("a.tree_id", "a.leaf_id", "a.branch", "a.depth", "b.role", "b.text")


def format_paths(found: DataFrame) -> DataFrame:
    """One conversation for each path: tree_id, leaf_id, branch, text, loss_spans (start and end of each assistant text)."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))), lambda t: F.struct(t["role"], t["text"]))
    found = found.groupBy("tree_id", "leaf_id", "branch").agg(turns.alias("turns"))

    def run(batches):
        for batch in batches:
            done = [render([tuple(t.values()) for t in turns]) for turns in batch["turns"].to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t for t, _ in done], pa.string()), spans], names=["tree_id", "leaf_id", "branch", "text", "loss_spans"])

    kind = lambda c: found.schema[c].dataType.simpleString()
    return found.mapInArrow(run, f"tree_id {kind('tree_id')}, leaf_id {kind('leaf_id')}, branch int, text string, loss_spans array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and of the text under the loss mask, read from the formatted texts."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"].to_pylist(), batch["loss_spans"].to_pylist()):
                turns = parse(text)
                all_turns = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sha = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in (all_turns, loss)]
                rows.append((len(turns), sha[0], len(loss), sha[1], len(text)))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch["tree_id"], *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    kind = formatted.schema["tree_id"].dataType.simpleString()
    schema = f"tree_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.mapInArrow(run, schema)


def chains(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text as trees without branches: each turn answers the one before it.

    Turns of equal number follow each other by role and text.
    """
    turns = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("bigint").alias("msg_id"), "role", "text")
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select("tree_id", "msg_id", parent.alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")
