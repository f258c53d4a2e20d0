"""Operator 5, chat formatting: event-sourced reconstruction.

A log holds events ``(conv_id, seq, msg, kind, role, text)``; kinds are

* ``start``: the message begins, with its role;
* ``delta``: text is appended;
* ``edit``: the text so far is replaced;
* ``regenerate``: the text so far is thrown away and deltas start again;
* ``delete``: the message goes.

Events are partitioned by conversation and message, sorted by sequence number and folded into the
message's final text. Messages of a conversation are then rendered in runs of ``RUN`` sequence
numbers, and the runs joined, so that a conversation that holds a large share of the log is folded
and rendered by many tasks; only its finished runs meet, because one conversation is one output row.

Template: each turn is ``<s>role[INST]text[/INST]</s>``. Inside roles and texts every ``<``, ``[``
and backslash gets a backslash behind it, so no control string occurs there, and removing the
backslash behind those three gives the text back.

Everything runs as DataFrame expressions.

Edge cases: a null text is empty; a null role is the empty role; a null sequence number sorts
first; rows with equal sequence numbers are ordered by role and text, and repeated rows are turns
of their own; an empty log gives no rows; a conversation whose messages are all deleted is absent;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256
LOSS_ROLE = "assistant"
FIRST = -(1 << 63)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def message_events(rows: DataFrame) -> DataFrame:
    """Events of a log that holds finished messages (conv_id, turn, role, text): a start and a delta each."""
    base = rows.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("msg"), "role", "text")
    two = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text")),
    )
    return base.select("conv_id", "seq", "msg", F.inline(two))


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the message's first event), role, text."""
    order = F.coalesce(F.col("seq"), F.lit(FIRST)).alias("seq")
    step = F.col("step") if "step" in events.columns else F.lit(0)
    row = F.struct(order, step.alias("step"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(row)).alias("log"))
    # The fold: text is what followed the last event that replaced it, in order.
    resets = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: F.element_at("log", i)["kind"].isin("edit", "regenerate"))
    logs = logs.withColumn("from", F.coalesce(F.array_max(resets), F.lit(1)))
    live = F.slice("log", F.col("from"), F.size("log"))
    texts = F.transform(F.filter(live, lambda e: e["kind"].isin("edit", "delta")), lambda e: e["text"])
    starts = F.filter("log", lambda e: e["kind"] == "start")
    kept = logs.filter(~F.exists("log", lambda e: e["kind"] == "delete"))
    return kept.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("seq"),
        F.coalesce(F.get(starts, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render_conversations(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, ``formatted`` and ``loss_spans`` array<struct<start long, length long>>.

    Spans are in UTF-8 bytes of ``formatted`` and cover each text of ``loss_role`` without its marks.
    """
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))
    turn = messages.select(
        "conv_id",
        F.expr(f"seq div {RUN}").alias("run"),
        F.struct("seq", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss")).alias("turn"),
    )
    runs = turn.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = "[/INST]</s>"
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    bytes_of = lambda c: F.octet_length(c).cast("long")
    spans = F.aggregate(
        "turns",
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>))"),
        lambda acc, t: F.struct(
            (acc["at"] + bytes_of(t["head"]) + bytes_of(t["body"]) + len(tail)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + bytes_of(t["head"])).alias("start"), bytes_of(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    runs = runs.select("conv_id", "run", text.alias("text"), spans.alias("spans"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "text", "spans"))).alias("runs"))
    joined = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    starts = F.aggregate("runs", F.expr("array(0L)"), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + bytes_of(r["text"]))))
    moved = F.transform("runs", lambda r, i: F.transform(r["spans"], lambda s: F.struct((s["start"] + F.get("starts", i)).alias("start"), s["length"].alias("length"))))
    return whole.withColumn("starts", starts).select("conv_id", joined.alias("formatted"), F.flatten(moved).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns back from the output: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.replace(p, F.lit("<s>"), F.lit("")), "[INST]", 1)).alias("role"),
            unescape(F.replace(F.substring_index(p, "[INST]", -1), F.lit("[/INST]"), F.lit(""))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    raw = formatted.cast("binary")
    cut = F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return F.array_join(cut, "")


def format_conversations(events: DataFrame) -> DataFrame:
    return render_conversations(fold_messages(events))
