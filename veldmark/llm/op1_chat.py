"""Chat formatting of reply trees.

Messages are rows of a tree (tree, id, parent, role, text, score). Root-to-leaf paths come from
iterated self-joins that double the distance each round, so a path of n turns takes log2(n) rounds.
Leaves are ranked by the sum of the scores on their path, and every chosen path becomes one
conversation with a loss mask over the assistants' texts.

Template: ``### <Role>: <text></turn>`` and a line feed for each turn. Inside texts and roles a
backslash is doubled, every ``#`` after another has one before it and ``</turn>`` is broken by one (``#\\#\\#``, ``<\\/turn>``), so no two ``#`` stand
side by side in an escaped text and neither mark can be forged; roles that the template does not name are written as ``=role``. Dropping the
backslash of every backslash and its follower undoes it.

Nulls: a null tree is a tree like any other, a null role or text is empty, a null score counts 0, a parent that does
not exist makes its message a root. Messages on a cycle of parents have no root and are left out.
Ties between leaves go to the longer path, then to the smaller id. Of several messages with one (tree, id) the smallest by (parent, role,
text, score) stays, nulls first; `from_turns` makes ids from the order of the rows, so repeated turns stay turns of their own there. An empty
table gives no conversations; a score that is not a number counts 0; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common

END = "</turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
FORMATTED = "tree long, branch int, n_turns long, formatted string, loss_mask array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"(?<=#)#", r"\\#", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans, in code points, of the assistants' (escaped) texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = "### " + (NAMES.get(role) or "=" + escape(role).replace(":", "\\:")) + ": "
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        m = re.match(r"### ((?:\\.|[^\\:])*): ", part, flags=re.S)
        role = unescape(m[1][1:]) if m[1].startswith("=") else m[1].lower()
        out.append((role, unescape(part[m.end() :])))
    return out


def from_turns(conversations: DataFrame) -> DataFrame:
    """Reply trees from rows (conv_id, turn, role, text): each turn replies to the one before it."""
    order = "partition by conv_id order by turn, role, text"
    return conversations.select(
        F.col("conv_id").cast("long").alias("tree"), F.expr(f"cast(row_number() over ({order}) as long)").alias("id"), "role", "text", F.lit(0.0).alias("score")
    ).withColumn("parent", F.expr("nullif(id - 1, 0)"))


def paths(messages: DataFrame, branches: int, scratch: common.Scratch) -> DataFrame:
    """(tree, branch, id, back): the messages of the ``branches`` best paths of each tree, ``back`` steps before the leaf."""
    score = F.when(F.isnan(F.col("score").cast("double")), 0.0).otherwise(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    rows = messages.select("tree", "id", "parent", score.alias("score"))
    ids = rows.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.lit(True).alias("there"))
    first = rows.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left").select(
        "tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), F.col("score").cast("double").alias("total")
    )
    jumps, done = [scratch.save(first, "up")], []
    limit = max(1, messages.count()).bit_length()
    while len(jumps) <= limit and jumps[-1].where("up is not null").limit(1).count():
        # only messages that are still under way are joined; those at their root wait as targets
        s, done = jumps[-1].where("up is not null"), [*done, jumps[-1].where("up is null")]
        o = reduce(DataFrame.unionAll, [s, *done])
        o = o.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("total2"))
        nxt = s.join(o, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i"))).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")
        )
        jumps.append(scratch.save(nxt, "up"))
    ended = reduce(DataFrame.unionAll, [j.where("up is null") for j in jumps])
    replied = jumps[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("i")).distinct()
    leaves = ended.join(replied, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    order = "order by total desc, depth desc, id"
    near = leaves.withColumn("salt", F.expr("pmod(xxhash64(id), 64)")).withColumn("branch", F.expr(f"row_number() over (partition by tree, salt {order})")).where(F.col("branch") <= branches)
    chosen = near.withColumn("branch", F.expr(f"row_number() over (partition by tree {order})")).where(F.col("branch") <= branches)
    members = chosen.select("tree", "branch", "id", F.lit(0).cast("long").alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].where("up is not null").select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        more = members.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
        members = members.unionAll(more.select("tree", "branch", F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back")))
        members = scratch.save(members, "path")
    return members


def format_trees(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """One row for each chosen path: tree, branch (1 is best), n_turns, formatted, loss_mask.

    ``unique``: no (tree, id) comes twice, as in what `from_turns` gives.
    """
    scratch = common.Scratch(messages.sparkSession, "chat")
    messages = messages.select(F.col("tree").cast("long").alias("tree"), F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "role", "text", "score")
    if not unique:
        messages = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*")
    messages = scratch.save(messages, "messages")
    members = paths(messages, branches, scratch).select(F.col("tree").alias("t"), F.col("id").alias("i"), "branch", "back")
    full = messages.join(members, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    turns = full.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def write(frames):
        for pdf in frames:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            yield pd.DataFrame({
                "tree": pdf["tree"].astype("Int64"), "branch": pdf["branch"].astype("int32"), "n_turns": [len(t) for t in pdf["turns"]],
                "formatted": [m[0] for m in made], "loss_mask": [[{"start": a, "end": b} for a, b in m[1]] for m in made],
            })

    return turns.mapInPandas(write, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from the text and the mask."""

    def read(frames):
        for pdf in frames:
            out = []
            for text, mask in zip(pdf["formatted"], pdf["loss_mask"]):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([pdf["tree"].astype("Int64").rename("conv_id").reset_index(drop=True), cols], axis=1)

    return formatted.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold the template's own marks.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digest(format_trees(from_turns(turns.unionByName(more)), unique=True))
