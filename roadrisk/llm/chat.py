"""Chat formatting from event logs, in DataFrame functions only.

An event log has (conv_id, turn, seq, kind, role, text). ``start`` opens a message, ``delta`` adds to
it, ``edit`` replaces its text and ``regenerate`` throws it away and begins anew. Folding is
associative: a stretch of events is summed up by whether it resets the text and by the text after
its last reset, so long messages are folded in stretches first.

A turn is written as ``### role: text </turn>`` and a line feed. Inside texts a backslash stands
before every backslash, ``#`` and ``<`` (in roles also before ``:``), so no text can hold a mark.
The loss mask has a span of code points for each assistant turn.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
STRETCH = 1024  #: events of a message that are folded together first


def escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<:])", "$1")


def _fold(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: whether anything in it resets the text, and the text after the last reset."""
    rows = F.array_sort(F.collect_list(F.struct(order, "resets", "role", "text")))
    d = events.groupBy(*keys).agg(rows.alias("_e"))
    last = F.expr("array_max(transform(_e, (x, i) -> if(x.resets, i, 0)))")
    return d.withColumn("_last", last).select(
        *keys, F.exists("_e", lambda x: x["resets"]).alias("resets"),
        F.expr("array_max(transform(_e, x -> x.role))").alias("role"),
        F.expr("array_join(transform(slice(_e, _last + 1, size(_e)), x -> x.text), '')").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, seq, kind, role, text) -> (conv_id, turn, copy, role, text): the final
    messages. ``copy`` tells messages with one turn number apart. NULL texts count as empty; of
    several roles in a message the greatest is kept; events after an edit add to the edited text."""
    d = events.select("conv_id", "turn", "copy", "seq", F.col("kind").isin("start", "edit", "regenerate").alias("resets"),
                      "role", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    parts = _fold(d, ["conv_id", "turn", "copy", "stretch"], "seq")
    return _fold(parts, ["conv_id", "turn", "copy"], "stretch").drop("resets")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text) -> (conv_id, formatted, loss_mask): one row per conversation.

    ``loss_mask`` has, for each turn with loss, its number, the place of its text in the turn and
    in the whole, and its length. A conversation is one string, so its turns meet in one task.
    """
    m = messages.select(
        "conv_id", "turn", "copy", F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("_body"))
    m = m.withColumn("_head", F.concat(F.lit(OPEN), escaped(F.col("role"), ":"), F.lit(COLON)))
    m = m.withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "copy")
    m = m.withColumns({
        "_no": F.row_number().over(order) - 1,
        "_from": F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    at = F.length("_head")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(
        F.col("_no").alias("turn"), at.alias("at"), (F.col("_from") + at).alias("start"), F.length("_body").alias("length")))
    d = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_no", "_piece", span.alias("span")))).alias("_t"))
    return d.select(
        "conv_id", F.expr("array_join(transform(_t, x -> x._piece), '')").alias("formatted"),
        F.expr("transform(filter(_t, x -> x.span IS NOT NULL), x -> x.span)").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) -> (conv_id, turns: array of (role, text), loss: array of
    texts), all from the formatted string."""
    d = formatted.withColumn("_p", F.expr(r"slice(split(formatted, ' </turn>\n'), 1, greatest(size(split(formatted, ' </turn>\n')) - 1, 0))"))
    # the first ": " that no backslash protects ends the role; escapes keep their length
    role = F.transform("_p", lambda p: F.substring(
        p, F.lit(len(OPEN) + 1), F.instr(F.regexp_replace(p, r"(?s)\\.", "xx"), COLON) - F.lit(len(OPEN) + 1)))
    d = d.withColumn("_r", role)
    turns = F.transform("_p", lambda p, i: F.struct(
        unescaped(F.get("_r", i)).alias("role"),
        unescaped(F.substring(p, F.length(F.get("_r", i)) + len(OPEN) + len(COLON) + 1, F.length(p))).alias("text")))
    loss = F.transform("loss_mask", lambda s: unescaped(F.substring(F.get("_p", s["turn"]), s["at"] + 1, s["length"])))
    return d.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def as_events(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """An event log that ends in the given conversations (conv_id, turn, role, text).

    Assistant texts stream in pieces of ``chunk`` characters, every third after a draft that is
    regenerated; other texts come at once, every fourth after a first version that is edited.
    Rows with one turn number are told apart by role and text (``copy``).
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("copy", F.row_number().over(same)).withColumn("_pick", F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(12)))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))

    def event(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    deltas = F.transform(pieces, lambda x: event("delta", x))
    draft = F.array(event("start", F.lit("")), event("delta", F.lit("draft ")), event("delta", F.col("role")), event("regenerate", F.lit("")))
    log = (
        F.when(F.col("role") == LOSS_ROLE, F.concat(F.when(F.col("_pick") % 3 == 0, draft).otherwise(F.array(event("start", F.lit("")))), deltas))
        .when(F.col("_pick") % 4 == 0, F.array(event("start", F.lit("first version")), event("edit", F.col("text"))))
        .otherwise(F.array(event("start", F.col("text"))))
    )
    return d.select("conv_id", "turn", "copy", "role", F.posexplode(log).alias("seq", "_e")).select(
        "conv_id", "turn", "copy", "seq", "_e.kind", "role", "_e.text")
