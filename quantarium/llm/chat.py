"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable. What
follows a conversation's last assistant turn (or a conversation without one) becomes an example without a target, so
that the output holds every turn. In texts and roles the template's control characters are escaped, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the template of a turn, and what stands for its control characters in texts and roles. Every backslash of an
#: escaped text starts one of these pairs, so the pairs can be undone one kind after the other, the backslash last.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), (":", "\\c"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, pair in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescape(text: Column) -> Column:
    for plain, pair in reversed(ESCAPES):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def format_chat(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples (conv_id, target_turn, text, loss_start, loss_end) of a table of turns (conv_id, turn, role, text).

    loss_start and loss_end are code points of ``text`` (end exclusive): the escaped reply of the target, or null in
    an example without one. target_turn is the place of the last turn, from 0. Turns are ordered by turn, then role,
    then text; a null role or text is empty, repeated rows are turns of their own. A turn without a conv_id belongs to no
    conversation with others: each is a conversation of one turn, an example whose conv_id is null.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known, alone = t.where("conv_id IS NOT NULL"), t.where("conv_id IS NULL")
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return _examples(known, by_turn, target_role).unionByName(_examples(alone, None, target_role))


def _examples(t: DataFrame, by_turn: Window | None, target_role: str) -> DataFrame:
    """Without a window, each turn is a conversation."""
    body = escape(F.col("text"))
    t = t.select("conv_id", "turn", "role", "text", body.alias("body"), F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MIDDLE), body, F.lit(TAIL)).alias("block"))
    if by_turn is None:
        t = t.select("*", F.lit(0).alias("place"), F.lit(True).alias("is_last"), F.length("block").cast("long").alias("end"), F.array("block").alias("blocks"))
    else:
        whole = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn("place", F.row_number().over(by_turn) - 1).withColumn("is_last", F.lead(F.lit(1)).over(by_turn).isNull())
        t = t.withColumn("end", F.sum(F.length("block")).over(whole)).withColumn("blocks", F.collect_list("block").over(whole))
    is_target = F.col("role") == target_role
    stop = F.col("end") - len(TAIL)
    return t.where(is_target | F.col("is_last")).select(
        "conv_id", F.col("place").alias("target_turn"), F.array_join("blocks", "").alias("text"), F.when(is_target, stop - F.length("body")).alias("loss_start"), F.when(is_target, stop).alias("loss_end")
    )


def read_chat(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: conv_id, roles, texts (arrays, in order), trained (the unescaped text
    under each loss mask, in order) and formatted_chars (code points of all examples). Examples with a null conv_id are
    conversations of their own."""
    masked = unescape(F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_end - loss_start AS INT))"))
    own = examples.where("conv_id IS NOT NULL")
    lean = own.select("conv_id", "target_turn", F.length("text").alias("n"), masked.alias("trained"))
    per = lean.groupBy("conv_id").agg(F.sum("n").alias("formatted_chars"), F.sort_array(F.collect_list(F.when(F.col("trained").isNotNull(), F.struct("target_turn", "trained")))).alias("trained"), F.max("target_turn").alias("target_turn"))
    cut = len(HEAD) + 1
    blocks = F.filter(F.split("text", TAIL), lambda x: x != "")  # a block is never empty: it starts with HEAD
    roles = F.transform(blocks, lambda x: unescape(F.substr(F.substring_index(x, MIDDLE, 1), F.lit(cut))))
    bodies = F.transform(blocks, lambda x: unescape(F.substr(x, F.length(F.substring_index(x, MIDDLE, 1)) + len(MIDDLE) + 1)))
    both = per.join(own.select("conv_id", "target_turn", "text"), ["conv_id", "target_turn"])
    found = both.select("conv_id", roles.alias("roles"), bodies.alias("texts"), F.transform("trained", lambda s: s["trained"]).alias("trained"), "formatted_chars")
    trained = F.filter(F.array(masked), lambda x: x.isNotNull())
    alone = examples.where("conv_id IS NULL").select("conv_id", roles.alias("roles"), bodies.alias("texts"), trained.alias("trained"), F.length("text").cast("long").alias("formatted_chars"))
    return found.unionByName(alone)
