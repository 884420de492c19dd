"""Chat formatting (7): turns of a conversation as one string, Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn,
role, text).  A run of turns of one role becomes one block: an opening
mark, the texts with ``<turn>`` between them, a closing mark.

    system     <<SYS>>...<</SYS>>
    user       [INST]...[/INST]
    assistant  <s>...</s>
    other      <role>name</role>...<end>

Inside texts and role names ``<``, ``[`` and the escape sign itself are
written as two plain characters, so no text can contain a mark, and reading
back gives every text unchanged.  The loss covers the texts of assistant
turns, without marks.

Cases: null text and null role count as empty; an empty text is a turn of
its own; equal turn numbers go by role, then text; repeated rows are turns
of their own; null turns come first; a null conv_id is one conversation;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: marks of the template
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
TURN, ROLE_OPEN, ROLE_CLOSE, END = "<turn>", "<role>", "</role>", "<end>"
CLOSING = r"<</SYS>>|\[/INST\]|</s>|<end>"


def escaped(text: Column) -> Column:
    """``text`` without ``<`` and ``[``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("["), F.lit("\\b"))


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE_OPEN), escaped(role), F.lit(ROLE_CLOSE))
    for name, mark in OPEN.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(END)
    for name, mark in CLOSE.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def formatted(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, formatted), one row per conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sorted_turns = (turns.groupBy(F.col(conv_id).alias("conv_id"))
                    .agg(F.sort_array(F.collect_list(one)).alias("turns")))
    # each turn next to the role before and after it, so that a run is known without looking up places
    roles = F.transform("turns", lambda x: x["role"])
    none = F.array(F.lit(None).cast("string"))
    sided = sorted_turns.select("conv_id", F.arrays_zip(
        F.col("turns").alias("now"), F.concat(none, F.slice(roles, 1, F.size("turns") - 1)).alias("before"),
        F.concat(F.slice(roles, 2, F.size("turns")), none).alias("after")).alias("sided"))

    def written(x: Column) -> Column:
        r = x["now"]["role"]
        begin = F.when(r.eqNullSafe(x["before"]), F.lit(TURN)).otherwise(_opening(r))
        end = F.when(r.eqNullSafe(x["after"]), F.lit("")).otherwise(_closing(r))
        return F.concat(begin, escaped(x["now"]["text"]), end)

    return sided.select("conv_id", F.array_join(F.transform("sided", written), "").alias("formatted"))


def parsed(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    blocks = F.filter(F.split(text, CLOSING), lambda b: b != "")

    def read(block: Column) -> Column:
        other = block.startswith(F.lit(ROLE_OPEN))
        role = unescaped(F.substring_index(F.substr(block, F.lit(len(ROLE_OPEN) + 1)), ROLE_CLOSE, 1))
        body = F.when(other, F.substr(block, F.locate(ROLE_CLOSE, block) + len(ROLE_CLOSE)))
        for name, mark in OPEN.items():
            here = block.startswith(F.lit(mark))
            role = F.when(here, F.lit(name)).otherwise(role)
            body = F.when(here, F.substr(block, F.lit(len(mark) + 1))).otherwise(body)
        return F.transform(F.split(body, TURN), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: assistant texts in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                        parsed(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"),
                       lines.alias("lines"), loss_text(F.col("turns")).alias("loss"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
