"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block; blocks are concatenated into one string::

    ### user: first text</turn>
    second text of the same role</turn>
    ### assistant: answer</turn>

A backslash is put before a backslash, behind the first ``#`` of ``###`` and behind the ``<`` of
``</turn>`` inside texts, so that neither control string can come from a text; removing one
backslash from each pair restores every text. Roles are URL-encoded.

The loss mask is a list of runs ``(skip, take)`` in code points over the formatted string.

Nulls: a null text or role is empty, null conversation ids form one conversation, null turns come
first. Turns with equal numbers are ordered by role and text, and repeated rows are repeated turns.
An empty table gives no rows, and further input columns are ignored.

One conversation becomes one row, so its size is bounded by what a row can hold; the shuffle moves
texts once, in lists pre-collected by each map task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TURN_END = "### ", "</turn>\n"
_ESCAPE = r"\\|#(?=##)|<(?=/turn>)"


def escape(text: Column) -> Column:
    """``text`` with control strings broken up by backslashes."""
    return F.regexp_replace(text, _ESCAPE, r"$0\\")


def unescape(text: str) -> str:
    """The inverse of ``escape``: each backslash of the output follows the character it guards."""
    return re.sub(r"\\\\|\\", lambda m: "\\" if m[0] == "\\\\" else "", text)


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row for each conversation: its id, n_turns, formatted, loss_runs."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    by_conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # A block starts where the role changes; its texts are the slice up to the next start.
    starts = by_conv.select(
        "conv_id",
        "ts",
        F.expr("filter(sequence(1, size(ts)), i -> i = 1 or ts[i - 1].role != ts[i - 2].role)").alias("at"),
    )
    blocks = starts.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.transform(
            F.expr("transform(at, (a, k) -> slice(ts, a, coalesce(get(at, k + 1), size(ts) + 1) - a))"),
            lambda b: F.struct(
                b[0]["role"].alias("role"),
                F.concat(F.lit(OPEN), F.url_encode(b[0]["role"]), F.lit(": ")).alias("head"),
                F.transform(b, lambda t: escape(t["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )

    def runs(b: Column) -> Column:
        counted = b["role"].isin(*loss_roles)
        tail = len(TURN_END)
        return F.transform(
            b["texts"],
            lambda t, i: F.struct(
                F.when(i == 0, F.length(b["head"])).otherwise(F.lit(tail)).cast("long").alias("skip"),
                F.length(t).cast("long").alias("size"),
                counted.alias("take"),
            ),
        )

    formatted = F.concat(
        F.array_join(
            F.transform(
                "blocks",
                lambda b: F.concat(b["head"], F.array_join(b["texts"], TURN_END), F.lit(TURN_END)),
            ),
            "",
        )
    )
    # A block's last turn end is skipped before the next block's head.
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                runs(b),
                lambda r, i: F.struct(
                    (r["skip"] + F.when((i == 0) & (k > 0), F.lit(len(TURN_END))).otherwise(F.lit(0))).alias("skip"),
                    r["size"].alias("size"),
                    r["take"].alias("take"),
                ),
            ),
        )
    )
    return blocks.select("conv_id", "n_turns", formatted.alias("formatted"), mask.alias("loss_runs"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    from urllib.parse import unquote_plus

    out, role = [], ""
    for part in formatted.split(TURN_END)[:-1]:
        if part.startswith(OPEN):
            head, _, part = part[len(OPEN) :].partition(": ")
            role = unquote_plus(head)
        out.append((role, unescape(part)))
    return out


def masked_text(formatted: str, loss_runs: Sequence) -> str:
    """All text under the loss mask, unescaped."""
    at, out = 0, []
    for r in loss_runs:
        at += r["skip"]
        if r["take"]:
            out.append(unescape(formatted[at : at + r["size"]]))
        at += r["size"]
    return "".join(out)
