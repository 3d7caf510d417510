"""Chat formatting by prefix-target expansion.

A conversation becomes one rendered text.  Every assistant turn then becomes an example of
its own: all turns before it as context, and only that reply under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings: one backslash goes into every ``<|``, ``<\\|``, ``<\\\\|`` ..."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_out(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted``.

    ``turns`` has ``conv_id, turn, role, text``; null roles and texts are empty ones.  Rows
    go by turn (nulls first), equal turns by role, then text, so repeated rows stay and the
    order is always the same.  A null ``conv_id`` is one conversation.  A conversation is
    taken to fit into a task, as its rendered text must.
    """
    piece = F.concat(
        F.lit(OPEN), _role_in(text_of("role")), F.lit("\n"), escaped(text_of("text")), F.lit(f"{CLOSE}\n")
    )
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", text_of("role"), text_of("text"), piece.alias("piece")))).alias("t")
    )
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"))


def read_back(text: Column | str) -> Column:
    """The turns of a rendered text: an array of ``role, text`` with escapes undone, and the
    place (code points, from 0) of each text as it stands in the rendered one."""
    column = F.col(text) if isinstance(text, str) else text
    pieces = F.slice(F.split(column, r"<\|im_start\|>"), 2, 1 << 30)
    cut = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            F.length(F.substring_index(p, "\n", 1)).alias("head"),
            F.length(p).alias("size"), p.alias("piece"),
        ),
    )
    ends = len(CLOSE) + 1
    body = lambda t: F.substr(t["piece"], t["head"] + 2, t["size"] - t["head"] - 1 - ends)
    placed = F.aggregate(
        F.transform(cut, lambda t: t["size"] + len(OPEN)),
        F.array(F.lit(0)),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    return F.transform(
        F.arrays_zip(cut.alias("c"), F.slice(placed, F.lit(1), F.size(pieces)).alias("at")),
        lambda z: F.struct(
            _role_out(z["c"]["role"]).alias("role"), unescaped(body(z["c"])).alias("text"),
            (z["at"] + len(OPEN) + z["c"]["head"] + 1).alias("start"),
            (z["at"] + len(OPEN) + z["c"]["size"] - ends).alias("end"),
        ),
    )


def examples(rendered: DataFrame, *keep: Column | str) -> DataFrame:
    """An example per assistant turn: ``conv_id, example, text, loss_start, loss_end``.

    ``text`` ends with the reply; only its code points from ``loss_start`` to before
    ``loss_end`` are to be trained on.  Conversations without an assistant turn keep one
    row with null ``example``.  ``rendered`` is what ``formatted`` returns; ``keep`` names
    more of its columns.
    """
    replies = F.filter(read_back("formatted"), lambda t: t["role"] == TRAINED)
    rows = rendered.select("conv_id", "formatted", *keep, F.posexplode_outer(replies).alias("example", "t"))
    return rows.select(
        "conv_id", "example", *keep,
        F.substr("formatted", F.lit(1), F.col("t.end") + len(CLOSE) + 1).alias("text"),
        F.col("t.start").alias("loss_start"), F.col("t.end").alias("loss_end"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what its examples say when read back: turns, trained text, sizes."""
    turn_lines = F.transform(
        read_back("formatted"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    rendered = formatted(turns).select(
        "conv_id", "formatted",
        F.size(turn_lines).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn_lines, ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    kept = ["n_turns", "turns_sha256", "formatted_chars"]
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    trained = examples(rendered, *kept).select("conv_id", "example", *kept, loss.alias("loss"))
    whole = F.array_join(F.transform(F.sort_array("said"), lambda s: s["loss"]), "")
    return (
        trained.groupBy("conv_id", *kept)
        .agg(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "loss"))).alias("said"))
        .select(
            "conv_id", "n_turns", "turns_sha256", F.length(whole).cast("long").alias("loss_chars"),
            F.sha2(whole, 256).alias("loss_sha256"), "formatted_chars",
            F.size("said").cast("long").alias("n_examples"),
        )
    )
