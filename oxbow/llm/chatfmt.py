"""Chat formatting by event-sourced reconstruction, on DataFrame functions alone.

A conversation is a log of events: streamed deltas, edits of a turn, regenerations of a turn. Folding the log leaves the final
messages; a template renders them to one text with a loss mask over what the assistant said.

An event (conv, seq, turn, kind, role, text) is, by kind:
* delta: `text` is appended to the turn;
* edit: `text` replaces what the turn held, and every later turn so far is discarded;
* regenerate: as edit; the usual form has no text and is followed by deltas.
So an event is dead exactly if an edit or regeneration of the same or an earlier turn has a greater sequence number: one running
minimum per conversation tells. What lives is put together in order of turn and sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: control strings around roles and texts, and how their characters are written inside texts.
OPEN, SEPARATOR, CLOSE = "<|", "|>", "<|end|>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;")]
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without any character of a control string; `unescape` undoes it."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log (conv_id, seq, turn, kind, role, text).

    Null texts count as empty, null kinds as delta, null roles are passed over (a message without any role has an empty one). The
    role of a message is that of its last living event with a role. Equal sequence numbers go by turn, kind, role and text, and do
    not overrule one another; null sequence numbers come first. Turns without a living event are gone; repeated events apply
    each time. One shuffle by conversation serves all steps.
    """
    resets = F.when(F.col("kind").isin("edit", "regenerate"), F.col("turn"))
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last())
    # A range frame that ends before the current value, as a running minimum over greater sequence numbers.
    least = F.min(resets).over(later.rangeBetween(Window.unboundedPreceding, -1))
    known = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", "text")
    living = known.withColumn("cut", least).where("cut is null or turn is null or cut > turn")
    parts = living.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("parts")
    )
    roles = F.filter("parts", lambda p: p["role"].isNotNull())
    role = F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit(""))
    return parts.select(
        "conv_id", "turn", role.alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from final messages (conv_id, turn, role, text).

    Messages go by turn, null turns first. loss_spans holds (start, length) in code points of each assistant text in `formatted`,
    as escaped there, in order; an assistant text that is empty has an empty span.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(SEPARATOR + "\n"))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    piece = F.concat("head", "body", F.lit("\n" + CLOSE))
    loss = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    columns = ["turn", "piece", "before", "length", "loss"]
    pieces = pieces.select(
        "conv_id", "turn", piece.alias("piece"), F.char_length("head").alias("before"), F.char_length("body").alias("length"), loss.alias("loss")
    )
    # A message begins where those before it end: a running sum, so that long conversations cost no more than their length.
    ahead = Window.partitionBy("conv_id").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.char_length("piece")).over(ahead), F.lit(0)).cast("int")
    placed = pieces.select("conv_id", F.struct(*columns, begins.alias("at")).alias("m"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("ms", lambda m: m["loss"]), lambda m: F.struct((m["at"] + m["before"]).alias("start"), m["length"].alias("length"))
        ).alias("loss_spans"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of an event log; an empty log gives no conversations. See `fold` and `render`."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts) parsed from the formatted text and its spans: turns (role, text), texts under the mask.

    One row of `formatted` for each conversation, as `render` gives them.
    """
    bodies = F.filter(F.split("formatted", "\\Q\n" + CLOSE + "\\E"), lambda t: t != "")

    def turn(piece: Column) -> Column:
        # The first separator ends the role: escaped roles and texts hold none.
        found = F.array(F.struct(piece.alias("p"), F.instr(piece, SEPARATOR + "\n").alias("at")))
        role = lambda f: F.substring(f["p"], F.lit(len(OPEN) + 1), f["at"] - len(OPEN) - 1)
        text = lambda f: F.substring(f["p"], f["at"] + len(SEPARATOR) + 1, F.char_length(f["p"]))
        return F.transform(found, lambda f: F.struct(unescape(role(f)).alias("role"), unescape(text(f)).alias("text")))[0]

    # Each span is cut from the piece that it lies in, found by an ordered pass over both, not from the start of the whole text.
    none = lambda kind: F.lit(None).cast(kind)
    pieces = F.transform(
        bodies,
        lambda body, nth: F.struct(nth.alias("nth"), F.concat(body, F.lit("\n" + CLOSE)).alias("piece"), none("bigint").alias("start"), none("int").alias("length")),
    )
    spans = F.transform(
        "loss_spans", lambda s: F.struct(none("int").alias("nth"), none("string").alias("piece"), s["start"].cast("long").alias("start"), s["length"].alias("length"))
    )
    rows = formatted.select("conv_id", F.inline_outer(F.concat(pieces, spans)))
    ahead = Window.partitionBy("conv_id").orderBy(F.col("nth").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("piece").isNotNull(), F.coalesce(F.sum(F.char_length("piece")).over(ahead), F.lit(0))).otherwise(F.col("start"))
    rows = rows.withColumn("at", at)
    order = Window.partitionBy("conv_id").orderBy("at", F.col("length").asc_nulls_first(), "nth")
    held = F.last(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")), ignorenulls=True).over(order)
    text = F.substring(F.col("held.piece"), (F.col("at") - F.col("held.at") + 1).cast("int"), F.col("length"))
    listed = rows.withColumn("held", held).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("nth", "piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("length").isNotNull(), F.struct("at", unescape(text).alias("text"))))).alias("said"),
    )
    body = lambda p: F.substring(p["piece"], F.lit(1), F.char_length(p["piece"]) - len("\n" + CLOSE))
    return listed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform("pieces", lambda p: turn(body(p))).alias("turns"),
        F.transform("said", lambda s: s["text"]).alias("loss_texts"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and SHA-256 digests, a row for each conversation."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
