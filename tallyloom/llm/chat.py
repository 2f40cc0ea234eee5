"""Chat formatting: cumulative snapshots collapse onto the longest logged conversation, then rendering.

A conversation's prefix of k turns is known by two 64-bit sums (exclusive or) over its turns' hashes, each
taken with the turn's place; as a running window this needs no conversation in one row. Prefix hashes and
whole-conversation hashes are made distinct by grouped aggregation before they meet in the anti-join, so a
first turn or a conversation that many logs share is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import materialise


def snapshot_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, h1, h2, n_turns): the running hash after each turn, places from 1."""
    over = f"partition by `{conv}` order by `{turn}`, c1, c2 rows between unbounded preceding and current row"
    content = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    # only hashes go through the windows
    turns = turns.where(F.col(conv).isNotNull()).select(conv, turn, F.xxhash64(F.lit(1), *content).alias("c1"), F.xxhash64(F.lit(2), *content).alias("c2"))
    placed = turns.withColumn("place", F.expr(f"row_number() over ({over.split(' rows')[0]})"))
    hashed = placed.withColumns({"a": F.xxhash64(F.lit(3), "place", "c1", "c2"), "b": F.xxhash64(F.lit(4), "place", "c1", "c2")})
    return hashed.select(
        conv, "place", F.expr(f"bit_xor(a) over ({over})").alias("h1"), F.expr(f"bit_xor(b) over ({over})").alias("h2"),
        F.expr(f"count(*) over (partition by `{conv}`)").alias("n_turns"),
    )


def collapse_snapshots(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, h1, h2, kept, copy_of) for each conversation.

    Kept: no longer conversation starts with all its turns, and among equal ones it has the smallest id.
    ``copy_of`` is the smallest id of an equal conversation, itself included. Turns go by number, equal
    numbers by content; repeated turn rows are turns of their own, null roles and texts equal each other only.
    Rows with a null conversation id are left out. No rows give no rows. Only the four columns are read, whatever
    others are named. The turns of one conversation are hashed and rendered in one task, as they are in one row
    of the result; a text or conversation of any length is whole.
    """
    found = materialise(snapshot_hashes(turns, conv, turn, role, text), "prefixes")
    last = found.where("place = n_turns").select(conv, "n_turns", "h1", "h2")
    inner = found.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    whole = last.groupBy("n_turns", "h1", "h2").agg(F.min(conv).alias("copy_of"))
    keys = ["n_turns", "h1", "h2"]
    maximal = whole.join(inner, keys, "left_anti").withColumn("maximal", F.lit(True)).select(*keys, "maximal")
    named = whole.join(maximal, keys, "left")
    return last.join(named, keys).select(
        conv, "n_turns", "h1", "h2", (F.coalesce("maximal", F.lit(False)) & (F.col(conv) == F.col("copy_of"))).alias("kept"), "copy_of"
    )


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, rendered): turns between ``<|im_start|>role`` and ``<|im_end|>``.

    Such marks inside a text are broken up by a zero-width space, so a text cannot open a turn. Null roles
    render as ``user``, null texts as empty ones.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|(im_start|im_end)\|>", "<\u200b|$1|>")
    one = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col(role), F.lit("user")), F.lit("\n"), clean, F.lit("<|im_end|>\n"))
    part = turns.where(F.col(conv).isNotNull()).select(conv, F.struct(F.col(turn), F.col(role), F.col(text), one.alias("line")).alias("x"))
    return part.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_join(F.array_sort(F.collect_list("x"))["line"], "").alias("rendered"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, rendered) of the conversations that ``collapse_snapshots`` keeps."""
    kept = collapse_snapshots(turns, conv, turn, role, text).where("kept").select(conv)
    return render(turns.join(kept, conv, "left_semi"), conv, turn, role, text)
