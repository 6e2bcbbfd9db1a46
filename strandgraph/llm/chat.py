"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example: all turns before it as context, and its text alone under the loss mask.
A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts and roles, the control strings of common
templates lose their first character to an escape (`~1` for <, `~2` for [, `~0` for ~ itself; in roles
also `~3` for a line feed), so no text can open or close a turn, and reading back gives the very text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What stands after < or [ in the control strings that are escaped.
_ANGLE, _SQUARE = r"<(?=\||/?s>|<SYS>>|</SYS>>)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """`text` without control strings; a null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(out, _ANGLE, "~1"), _SQUARE, "~2")


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(rows: DataFrame) -> DataFrame:
    """Examples (conv_id, example, target_turn, formatted, loss_start, loss_length, trainable) from (conv_id, turn, role, text) rows.

    `formatted` is the rendered context and target; loss_start (from 0) and loss_length count code points of it.
    What follows the last assistant turn, or a conversation without any, gives one example with an empty mask
    (trainable false), so that no turn is lost. Null texts and roles are empty; each row with a null conv_id
    is a conversation of its own; turns are ordered by (turn, role, text), nulls first, and repeated rows stay.
    Other columns are not read."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("reply")))
    talks = talks.select("conv_id", pieces.alias("p"))
    targets = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.get("p", k)["reply"] | (k == F.size("p") - 1))
    each = talks.select("conv_id", "p", F.posexplode(targets).alias("example", "target_turn"))
    target = F.get("p", F.col("target_turn"))
    context = F.array_join(F.transform(F.slice("p", F.lit(1), F.col("target_turn")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    each = each.select("conv_id", "example", "target_turn", F.concat(context, target["head"]).alias("before"), target["body"].alias("body"), target["reply"].alias("trainable"))
    return each.select(
        "conv_id", "example", "target_turn", F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("before").alias("loss_start"), F.when(F.col("trainable"), F.length("body")).otherwise(0).alias("loss_length"), "trainable",
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted example holds."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
    cut = lambda x: F.instr(x, "\n")
    return F.transform(parts, lambda x: F.struct(unescape(F.substring(body(x), F.lit(1), F.instr(body(x), "\n") - 1)).alias("role"), unescape(F.substring(body(x), cut(body(x)) + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask."""
    return unescape(F.substring(formatted, start + 1, length))
