"""Quotation linking: quoted passages are parsed by nesting level, hashed, and joined to the message they repeat.

A quoted line starts with one or more `>`. Neighbouring quoted lines of one level are a passage.
Originals are the unquoted part of each message, as a whole and by line. A passage links to the
latest earlier message of its conversation that has it, found by a running maximum over rows of
equal hash and not by joining all quotes with all originals. A message replies to the message that
its outermost linked passage repeats. Following replies gives each message its root and depth by
pointer doubling. Its position in its thread is its place in a walk around the reply tree, in which each
message points to the next step of the walk: doubling these pointers counts the messages that follow.
Sorting a conversation by root and position puts replies under their originals. All columns are numbers
of fixed size, so a long chain of replies costs no more than a short one, but for its rounds.

Defined cases: a null text is empty and quotes nothing. Empty passages link to nothing. Messages
without links are roots. Null conversation ids or turns are roots and link to nothing. Of equal passages
the latest earlier message counts. Repeated rows are kept; a reply to a repeated turn names that turn.
Very long texts are parsed whole. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

_PREFIX = r"^[ \t]*(?:>[ \t]*)+"


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """The text without its quoted lines."""
    text = F.coalesce(text, F.lit(""))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(_PREFIX)), "\n")
    return F.when(text.contains(">"), F.trim(kept)).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, first (line of the passage) and hash of every quoted passage, and of each line in it (whole = false)."""
    quoting = messages.where(F.col("text").contains(">") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("m"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    prefix = F.regexp_extract("line", _PREFIX, 0)
    quoted = lines.withColumn("prefix", prefix).where("prefix <> ''")
    quoted = quoted.select(
        "conv_id", "turn", "m", "pos",
        (F.length("prefix") - F.length(F.translate("prefix", ">", ""))).alias("level"),
        F.col("line").substr(F.length("prefix") + 1, F.length("line")).alias("body"),
    ).distinct()
    # a window per message, never per conversation
    w = Window.partitionBy("conv_id", "turn", "m", "level").orderBy("pos")
    runs = quoted.withColumn("run", F.col("pos") - F.row_number().over(w))
    whole = runs.groupBy("conv_id", "turn", "m", "level", "run").agg(
        F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ").alias("body")
    )
    both = whole.select("conv_id", "turn", "level", "first", "body", F.lit(True).alias("whole")).unionByName(
        quoted.select("conv_id", "turn", "level", F.col("pos").alias("first"), "body", F.lit(False).alias("whole"))
    )
    norm = normalise(F.col("body"))
    return both.where(norm != "").select("conv_id", "turn", "level", "first", "whole", F.xxhash64(norm).alias("hash"))


def originals(messages: DataFrame) -> DataFrame:
    """conv_id, turn and hash of each message's own text and of each of its lines."""
    own = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", unquoted(F.col("text")).alias("own"))
    unit = own.select("conv_id", "turn", F.explode(F.array_union(F.array("own"), F.split("own", "\n", -1))).alias("unit"))
    norm = normalise(F.col("unit"))
    return unit.where(norm != "").select("conv_id", "turn", F.xxhash64(norm).alias("hash")).distinct()


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, first, whole and linked turn of every passage that repeats an earlier message."""
    quotes = passages(messages)
    # only conversations that quote at all need their originals
    wanted = originals(messages).join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    none = F.lit(None)
    events = quotes.select("conv_id", "hash", "turn", "level", "first", "whole", none.cast("long").alias("from")).unionByName(
        wanted.select("conv_id", "hash", "turn", none.cast("int").alias("level"), none.cast("int").alias("first"), none.cast("boolean").alias("whole"), F.col("turn").cast("long").alias("from"))
    )
    w = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = events.withColumn("linked", F.max("from").over(w)).where("level is not null and linked is not null")
    return linked.select("conv_id", "turn", "level", "first", "whole", "linked")


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent and n_linked: outermost level first, whole passages before lines, then the first in the text."""
    rank = F.struct(F.col("level"), (~F.col("whole")).alias("line"), F.col("first"))
    return links(messages).groupBy("conv_id", "turn").agg(F.min_by("linked", rank).alias("parent"), F.sum(F.col("whole").cast("long")).alias("n_linked"))


def threads(parents: DataFrame) -> DataFrame:
    """Root and depth of each reply, by doubling the jump each round: log2(depth) rounds."""
    hop = materialise(parents.select("conv_id", "turn", F.col("parent").cast("long").alias("up"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = hop.select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"))
        joined = hop.join(above, (F.col("conv_id") == F.col("a_conv")) & (F.col("up") == F.col("a_turn")), "left")
        if joined.where(F.col("a_turn").isNotNull()).isEmpty():
            return hop
        last = hop
        hop = materialise(joined.select("conv_id", "turn", F.coalesce("a_up", "up").alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth")), "replies")
        discard(last)


def positions(parents: DataFrame, rooted: DataFrame) -> DataFrame:
    """conv_id, turn and position of each reply in its thread, by a walk down and up the tree; the root has position 0.

    `side` 0 enters a message and 1 leaves it. Entering leads to the first reply or to leaving, leaving to the
    next reply of the same message or to leaving that one. `ahead` counts the messages entered from here on.
    """
    up = parents.select("conv_id", "turn", F.col("parent").cast("long").alias("parent"))
    siblings = up.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id", "parent").orderBy("turn")))
    first = up.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    roots = rooted.select("conv_id", F.col("up").alias("turn")).distinct().select("conv_id", "turn", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("next"))
    nodes = siblings.select("conv_id", F.col("turn").cast("long").alias("turn"), "parent", F.col("next").cast("long").alias("next")).unionByName(roots).join(first, ["conv_id", "turn"], "left")

    def step(side: int, turn: Column, to: Column, count: int) -> Column:
        return F.struct(F.lit(side).alias("side"), turn.alias("to"), to.alias("to_side"), F.lit(count).cast("long").alias("ahead"))

    enter = step(0, F.coalesce("child", "turn"), F.when(F.col("child").isNull(), 1).otherwise(0), 1)
    leave = step(1, F.coalesce("next", "parent"), F.when(F.col("next").isNull(), 1).otherwise(0), 0)
    walk = nodes.select("conv_id", "turn", F.inline(F.array(enter, leave)))
    walk = materialise(walk, "walk")
    while not walk.where(F.col("to").isNotNull()).isEmpty():
        far = walk.select(F.col("conv_id").alias("f_conv"), F.col("turn").alias("f_turn"), F.col("side").alias("f_side"), F.col("to").alias("f_to"), F.col("to_side").alias("f_to_side"), F.col("ahead").alias("f_ahead"))
        joined = walk.join(far, (F.col("conv_id") == F.col("f_conv")) & (F.col("to") == F.col("f_turn")) & (F.col("to_side") == F.col("f_side")), "left")
        last = walk
        walk = materialise(joined.select("conv_id", "turn", "side", F.col("f_to").alias("to"), F.col("f_to_side").alias("to_side"), (F.col("ahead") + F.coalesce("f_ahead", F.lit(0))).alias("ahead")), "walk")
        discard(last)
    entered = walk.where("side = 0").select("conv_id", "turn", "ahead")
    whole = entered.select(F.col("conv_id").alias("w_conv"), F.col("turn").alias("w_turn"), F.col("ahead").alias("whole"))
    of = rooted.select("conv_id", F.col("turn").cast("long").alias("turn"), "up").join(entered, ["conv_id", "turn"])
    return of.join(whole, (F.col("conv_id") == F.col("w_conv")) & (F.col("up") == F.col("w_turn"))).select("conv_id", "turn", (F.col("whole") - F.col("ahead")).alias("position"))


def link_conversations(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, with parent turn, root turn, depth, position in its thread and number of linked passages."""
    messages = messages.select("conv_id", "turn", "role", "text")
    parents = materialise(replies(messages), "parents")
    rooted = threads(parents)
    up = rooted.join(parents, ["conv_id", "turn"]).join(positions(parents, rooted), ["conv_id", "turn"]).select(
        F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("parent").cast("long").alias("parent_turn"), F.col("up").alias("root"), F.col("depth").alias("r_depth"), F.col("position").alias("r_position"), "n_linked"
    )
    joined = messages.join(up, (F.col("conv_id") == F.col("r_conv")) & (F.col("turn") == F.col("r_turn")), "left")
    none = F.lit(0).cast("long")
    return joined.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root", F.col("turn").cast("long")).alias("root_turn"), F.coalesce("r_depth", none).alias("depth"), F.coalesce("r_position", none).alias("position"),
        F.coalesce("n_linked", none).alias("n_linked"), unquoted(F.col("text")).alias("body"),
    )
