"""Chat formatting by quotation linking, in DataFrame operations only.

Leading ``>`` marks give each line its quote level; runs of lines of one level are passages. A passage is looked
up whole, by paragraph, by line and by sentence: normalised, hashed, and joined to its original, the first message of its conversation
that says the same itself. Originals are one row a hash before the join, so a phrase that very many messages share makes no pairs.
A message answers what it quotes, else the message before it; conversations are then put in reply order, each
answer by quotation right after what it answers. What needs a conversation's order, the message before and the place in the reply
order, is found within ranges of that order and carried over from range to range, so a conversation may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unpacked, whole

#: Stands for a null turn, before all others.
NO_TURN = -(1 << 62)
#: Normalised characters that a part of a passage needs to be looked up: shorter ones say too little. The whole passage needs none.
LEAST = 12
#: A line that only introduces a quotation.
ATTRIBUTION = r"(?m)^[^\n]*\b(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\s*:[ \t]*$"
MARKS = r"^(?:[ \t]*>)+[ \t]?"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), "[^>]", ""))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level, in order: ``level, text`` without the marks."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))
    return _let(lines, lambda own: F.transform(_edges(own), lambda e: F.struct(
        F.get(own, e["first"])["level"].alias("level"), F.array_join(F.transform(F.slice(own, e["first"] + 1, e["many"]), lambda x: x["body"]), "\n").alias("text")
    )))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression named in a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edges(lines: Column) -> Column:
    """First line and number of lines of each run."""
    first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    return _let(first, lambda f: F.transform(f, lambda s, k: F.struct(s.alias("first"), (F.coalesce(F.get(f, k + 1), F.size(lines)) - s).alias("many"))))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "))


def pieces(text: Column, least: int) -> Column:
    """The normalised whole, and its paragraphs, lines and sentences of ``least`` characters or more."""
    parts = F.concat(F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"), F.split(text, r"(?<=[.!?])\s+"))
    some = F.filter(F.transform(parts, normal), lambda x: F.length(x) >= least)
    return F.filter(F.array_distinct(F.concat(F.array(normal(text)), some)), lambda x: x != "")


def _rows(df: DataFrame, text: Column, least: int, *more: Column) -> DataFrame:
    piece = df.select("conv_id", "_at", *more, F.explode(pieces(text, least)).alias("piece"))
    return piece.select("conv_id", "_at", *[c for c in piece.columns if c not in ("conv_id", "_at", "piece")], F.length("piece").alias("long"), F.md5(F.col("piece").cast("binary")).alias("hash"))


def _same(*names: str) -> Column:
    """Equal in ``x`` and ``y``, or null in both."""
    return reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in names])


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, _at, runs, own`` to ``conv_id, _at, passage, level, source``: the turn that a passage is from, or null."""
    quoting = messages.where(F.exists("runs", lambda r: r["level"] > 0))
    quoted = quoting.select("conv_id", "_at", F.posexplode(F.filter("runs", lambda r: (r["level"] > 0) & (F.trim(r["text"]) != ""))).alias("passage", "run"))
    asked = _rows(quoted, F.col("run.text"), LEAST, F.col("passage"))
    asking = asked.groupBy(F.col("conv_id").alias("_c")).agg(F.max("_at").alias("_last"))
    candidates = messages.join(asking, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_at") < F.col("_last")), "left_semi")
    originals = _rows(candidates, F.col("own"), 1).groupBy("conv_id", "hash").agg(F.min("_at").alias("source"))
    found = asked.alias("x").join(originals.alias("y"), _same("conv_id", "hash") & (F.col("y.source") < F.col("x._at")))
    best = found.groupBy("x.conv_id", "x._at", "x.passage").agg(F.max(F.struct("x.long", "y.source")).alias("best"))
    every = quoted.select("conv_id", "_at", "passage", F.col("run.level").alias("level")).distinct()
    return every.alias("x").join(best.alias("y"), _same("conv_id", "_at", "passage"), "left").select("x.conv_id", "x._at", "x.passage", "x.level", F.col("y.best.source").alias("source"))


def _in_ranges(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows dealt out by ranges of an order, each with the number of its range; stored, so that it stays as it is."""
    return stash(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def _carried(rows: DataFrame, value: Column, gather, name: str) -> DataFrame:
    """Adds ``name``: what the ranges before a row's gather of ``value`` in its conversation. One row a conversation and range is moved."""
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "_range").agg(gather(value).alias("_end")).withColumn(name, gather("_end").over(before))
    return rows.alias("x").join(ends.alias("y"), _same("conv_id", "_range"), "left").select("x.*", f"y.{name}")


def _turns(base: DataFrame, message: DataFrame) -> DataFrame:
    """One row a turn: ``n_linked, _source`` of its messages, the turn before, whether it answers another one than that, and the last turn up to it that does."""
    turns = base.select("conv_id", "_at").distinct().alias("x").join(message.alias("y"), _same("conv_id", "_at"), "left").select("x.*", "y.n_linked", "y._source")
    turns = _carried(_in_ranges(turns, "chat-turns", "conv_id", "_at"), F.col("_at"), F.max, "_end_before")
    here = Window.partitionBy("conv_id", "_range").orderBy("_at")
    turns = turns.withColumn("_before", F.coalesce(F.lag("_at").over(here), "_end_before"))
    turns = stash(turns.withColumn("_off", F.coalesce(F.col("_source") != F.col("_before"), F.lit(False))).drop("_end_before"), "chat-turns")
    branch = F.when(F.col("_off"), F.col("_at"))
    turns = _carried(turns, branch, F.max, "_branch_before")
    return stash(turns.withColumn("_segment", F.coalesce(F.max(branch).over(here), "_branch_before")).drop("_branch_before", "_range"), "chat-segments")


def _reply_paths(turns: DataFrame) -> DataFrame:
    """Sort keys of the segments that branch off: anchor and start of each branch on the way, by pointer doubling."""
    own = turns.where("_off").alias("x").join(turns.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x._source") == F.col("y._at")))
    now = stash(own.select("x.conv_id", F.col("x._at").alias("_segment"), F.col("y._segment").alias("_up"), F.array("x._source", "x._at").alias("_path")), "chat-paths")
    while True:
        joined = now.alias("x").join(now.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x._up") == F.col("y._segment")), "left")
        path = F.concat(F.coalesce("y._path", F.array().cast("array<long>")), "x._path")
        after = stash(joined.select("x.conv_id", "x._segment", F.col("y._up").alias("_up"), path.alias("_path"), F.col("y._path").isNotNull().alias("_moved")), "chat-paths")
        if not after.where("_moved").limit(1).count():
            return after.select("conv_id", "_segment", "_path")
        now = after.drop("_moved")


def _places(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``_key`` to the turn's figures and the number of messages that come before in reply order: one row for equal messages."""
    paths = _reply_paths(turns)
    turns = turns.alias("x").join(paths.alias("y"), _same("conv_id", "_segment"), "left").select("x.*", F.concat(F.coalesce("y._path", F.array().cast("array<long>")), F.array("x._at")).alias("_sort"))
    kinds = rows.groupBy("_key").agg(F.first("conv_id").alias("conv_id"), F.first("_at").alias("_at"), F.first("_row.role").alias("role"), F.count("*").alias("_many"))
    kinds = kinds.alias("x").join(turns.alias("y"), _same("conv_id", "_at")).select("x.*", "y.n_linked", "y._source", "y._before", "y._sort")
    kinds = _carried(_in_ranges(kinds, "chat-order", "conv_id", "_sort", "role", "_key"), F.col("_many"), F.sum, "_earlier")
    here = Window.partitionBy("conv_id", "_range").orderBy("_sort", "role", "_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_many").over(here), F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return stash(kinds.select(F.col("_key").alias("_place_key"), "n_linked", "_source", "_before", start.alias("_start")), "chat-places")


ADDED = ["own_text", "formatted", "n_passages", "n_linked", "max_level", "reply_to", "linked", "reply_order"]


def format_chats(conversations: DataFrame) -> DataFrame:
    """Adds ``own_text, formatted, n_passages, n_linked, max_level, reply_to, linked, reply_order`` to each message.

    Rows: conv_id, turn, role, text, ... A null text is empty, a null turn comes before all others, null conv_ids are one conversation.
    Messages of one turn are told apart by nothing: a quotation of it links to the turn. Repeated rows are
    kept and follow each other. Of several messages that say what is quoted the first is the original. A passage that no earlier message says stays unlinked. ``reply_to`` of a
    conversation's first turn is null. Texts are read whole; an empty table gives an empty result. Input columns with the names of the added ones are replaced.
    """
    plain = conversations.drop(*ADDED)
    text = F.coalesce("_row.text", F.lit(""))
    base = plain.select(whole(plain), "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("_at"), F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")).cast("binary")).alias("_key"))
    quotes = F.coalesce(F.regexp_like("_row.text", F.lit(r"(?m)^[ \t]*>")), F.lit(False))
    alone = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")))
    base = base.withColumn("runs", F.when(quotes, passages(F.col("_row.text"))).otherwise(alone))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    base = base.withColumn("own", F.when(quotes, F.trim(F.regexp_replace(F.regexp_replace(own, ATTRIBUTION, ""), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))).otherwise(own))

    found = stash(links(base.select("conv_id", "_at", "runs", "own")), "chat-links")
    message = found.groupBy("conv_id", "_at").agg(
        F.count("source").alias("n_linked"), F.max(F.when(F.col("source").isNotNull(), F.struct((F.col("level") == 1).alias("near"), "source")))["source"].alias("_source")
    )
    places = _places(base.select("_row", "conv_id", "_at", "_key"), _turns(base, message))
    rows = base.select(
        "_row", "_key", "own", F.size(F.filter("runs", lambda r: (r["level"] > 0) & (F.trim(r["text"]) != ""))).cast("long").alias("n_passages"),
        F.array_max(F.transform("runs", lambda r: r["level"])).cast("long").alias("max_level"),
    ).join(places, F.col("_key") == F.col("_place_key"))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_start"))
    reply_to = F.nullif(F.coalesce("_source", "_before"), F.lit(NO_TURN))
    return rows.withColumn("_turn", turn).select(
        *unpacked(plain.columns), F.col("own").alias("own_text"), F.concat(F.lit("<|"), F.coalesce("_row.role", F.lit("unknown")), F.lit("|>\n"), F.col("own")).alias("formatted"),
        "n_passages", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", reply_to.alias("reply_to"), F.col("_source").isNotNull().alias("linked"), (F.col("_start") + F.col("_turn")).cast("long").alias("reply_order"),
    )


def op10_chat(spark, sf_dir):
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
