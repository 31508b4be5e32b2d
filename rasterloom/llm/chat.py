"""Chat formatting over reply trees.

A forest of messages (tree, id, parent, role, text, score) becomes conversations:
every root-to-leaf path is one branch.  Paths are found by iterative self-joins
with doubling reach: after round k a leaf knows its ancestors up to distance 2^k
and a jump table knows everyone's 2^k-th ancestor, so a thread of n messages takes
log2(n) joins; ids alone travel, texts are joined once at the end.  Branches of a
tree are ranked by the mean score of their messages (ties: smaller leaf id), and
each chosen branch is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn.  Control strings
inside a text are escaped reversibly: a backslash goes after the first character
of every control string, and also of those that already have backslashes there,
so that undoing removes exactly one.  In a role, backslash and line feed are
written ``\\\\`` and ``\\n``.

The loss mask is a list of [start, end) code-point ranges of the output: the
(escaped) texts of assistant turns, nothing between.

Defined cases: a null text or role is the empty string; a conversation's rows
are ordered by turn (null first), then role, then text, so ties and repeated rows
are turns like any other; a null conv_id is a conversation of its own; a parent
that isn't in the tree makes its message a root; messages whose parents go round in a
circle all become roots, so that what answers them has an end; a message without a
tree or an id has no place in a tree and is left out; of several messages with one
(tree, id) the first by parent, role, text and score counts; an empty table gives only the
conversations that the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import drop, stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BODIES = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_BODIES})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_BODIES})")
_ROLE_UNESCAPE = re.compile(r"\\(.)")
#: The turn that must survive any template.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return _ROLE_UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The formatted conversation and its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(_role_out(role))}\n", escape(text)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((_role_in(unescape(role)), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


def threads(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: every row answers the one before it."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    return rows.withColumn("id", F.row_number().over(order).cast("long")).select(
        "tree", "conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score")
    )


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, up) for every leaf and each message on its path; ``up`` counts from the leaf.

    Rounds stop when no message has an ancestor at the reach of the jump table.
    Each round's tables are written to the shared folder, the one before deleted.
    """
    ids = messages.select("tree", "id", "parent")
    parents = ids.filter("parent is not null").select("tree", "id", F.col("parent").alias("to"))
    known = ids.select("tree", F.col("id").alias("to"))
    jumps = stage(parents.join(known, ["tree", "to"], "left_semi").select("tree", "id", "to"), "chat-jumps")
    links = jumps.count()
    answered = jumps.select("tree", F.col("to").alias("id")).distinct()
    reach = stage(ids.join(answered, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "chat-paths")
    length = 1
    while not jumps.isEmpty():
        if length > links:
            # Only a walk that goes round is longer than there are links, and it ends on the circle, every place of which some walk ends on.
            circle = stage(jumps.select("tree", F.col("to").alias("id")).distinct().withColumn("__round", F.lit(True)), "chat-circles")
            opened = ids.join(circle, ["tree", "id"], "left").select("tree", "id", F.when(F.col("__round").isNull(), F.col("parent")).alias("parent"))
            return branches(opened)
        further = reach.join(jumps, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + length).alias("up"))
        new_reach = stage(reach.unionByName(further), "chat-paths")
        ahead = jumps.select("tree", F.col("id").alias("to"), F.col("to").alias("__far"))
        new_jumps = stage(jumps.join(ahead, ["tree", "to"]).select("tree", "id", F.col("__far").alias("to")), "chat-jumps")
        drop(reach)
        drop(jumps)
        reach, jumps, length = new_reach, new_jumps, 2 * length
    return reach


def one_row_each(messages: DataFrame) -> DataFrame:
    """Messages with a tree and an id; of several rows with one (tree, id) the first by parent, role, text and score."""
    rows = messages.filter("tree is not null and id is not null")
    if rows.groupBy("tree", "id").count().filter("count > 1").isEmpty():
        return rows
    rest = [c for c in rows.columns if c not in ("tree", "id")]
    first = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score", *[c for c in rest if c not in ("parent", "role", "text", "score")])).alias("m"))
    return stage(first.select("tree", "id", "m.*"), "chat-messages").select(*rows.columns)


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, conv_id, leaf, branch (rank from 1), branch_score, formatted, loss (array of [start, end))."""
    return _format(one_row_each(messages), best)


def _format(messages: DataFrame, best: int | None = None) -> DataFrame:
    paths = branches(messages)
    full = paths.join(messages.select("tree", "conv_id", "id", "role", "text", "score"), ["tree", "id"])
    grouped = full.groupBy("tree", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.avg("score").alias("branch_score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("o"), "role", "text"))).alias("turns")
    )
    ranked = grouped.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("branch_score"), "leaf")))
    if best is not None:
        ranked = ranked.filter(F.col("branch") <= best)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            yield pdf.drop(columns="turns").assign(formatted=[d[0] for d in done], loss=[d[1] for d in done])

    return ranked.select("tree", "conv_id", "leaf", "branch", "branch_score", "turns").mapInPandas(
        write, "tree string, conv_id long, leaf long, branch int, branch_score double, formatted string, loss array<array<long>>"
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, from nothing but the formatted text and its mask."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for conv, text, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"], strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[int(a) : int(b)]) for a, b in loss)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), sha, len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return formatted.select("conv_id", "formatted", "loss").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` plus conversation -1: a user and an assistant row that say the probe."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format linear conversations, write them to the shared folder, and digest what is read back."""
    messages = stage(threads(conversations), "chat-messages")
    return digest(stage(_format(messages), "chat"))
