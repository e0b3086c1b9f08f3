"""Chat formatting by quotation linking. DataFrame functions only.

Lines that begin with ``>`` quote; the number of ``>`` is their level. Quoted
passages, whole paragraphs and single lines, are normalised and hashed, and joined
to what earlier messages of the conversation say themselves; of several messages
that said it, the last before the quotation is meant. A message replies to the
message that it quotes most of at its lowest level. Replies give each message a
root, a depth and a position in the root's tree, depth first, replies to one message
by turn. Ordered by ``root_turn, position`` a conversation reads in reply order: each
reply comes after what it answers and the replies to that before it, with all that
follows from these. Its texts are without quotes.

The join to the last earlier saying isn't a join of all pairs: sayings and
quotations of a passage are sorted by turn, within blocks of turns, and carried
from block to block. Positions are ranks on the tour of the trees, which goes down
and up each reply once; each round of joins doubles the distance that is summed, so
deep trees take few rounds and no message holds its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = r"^[ \t]*(?:>[ \t]?)+"
#: Turns of one block.
BLOCK = 1024


def normal(text: Column) -> Column:
    """A-Z lower-cased, runs of ASCII white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[ \t\n\x0B\f\r]+", " "))


def parsed(text: Column) -> Column:
    """Each line's level and what follows its marks."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("rest")))


def at_level(lines: Column, level: Column | int) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["rest"]), "\n")


def passages(text: Column) -> Column:
    """Normalised paragraphs and lines of a text, distinct, empty ones apart."""
    both = F.concat(F.split(text, r"\n[ \t\r]*\n\s*"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(both, normal), lambda x: x != ""))


def positions(parents: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, turn, left``: for replies ``(conv, turn, parent)`` and what they answer, how many messages are left in the tree from there, itself included.

    A tree's root has all of its tree left, so the difference to that is a message's position.
    """
    nodes = parents.select("conv", "turn").unionByName(parents.select("conv", F.col("parent").alias("turn"))).distinct()
    # each reply's next sibling; siblings are sorted within blocks of turns, and a block's last is given the next block's first
    child = parents.withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv", "parent", "block").orderBy("turn")
    blocks = child.groupBy("conv", "parent", "block").agg(F.min("turn").alias("first"))
    blocks = blocks.withColumn("beyond", F.lead("first").over(Window.partitionBy("conv", "parent").orderBy("block"))).select("conv", "parent", "block", "beyond")
    sibling = child.withColumn("near", F.lead("turn").over(inside)).join(blocks, ["conv", "parent", "block"]).select("conv", "turn", "parent", F.coalesce("near", "beyond").alias("sibling"))
    eldest = parents.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    # the tour's steps: down to a message (counted) and up from it, each with the step that follows
    no, yes = F.lit(False), F.lit(True)
    down = nodes.join(eldest, ["conv", "turn"], "left").select("conv", "turn", no.alias("up"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_up"), F.lit(1).cast("long").alias("ahead"))
    up = nodes.join(sibling, ["conv", "turn"], "left").select("conv", "turn", yes.alias("up"), F.coalesce("sibling", "parent").alias("to"), F.col("sibling").isNull().alias("to_up"), F.lit(0).cast("long").alias("ahead"))
    tour = stored(down.unionByName(up), "tour")
    while not tour.where("to is not null").isEmpty():
        further = tour.select("conv", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("over"), F.col("to_up").alias("over_up"), F.col("ahead").alias("more"))
        tour = stored(tour.join(further, ["conv", "to", "to_up"], "left").select("conv", "turn", "up", F.col("over").alias("to"), F.coalesce("over_up", "to_up").alias("to_up"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "tour")
    return tour.where("not up").select("conv", "turn", F.col("ahead").alias("left"))


def threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``messages``: ids and role, ``clean_text``, ``n_quoted``, ``max_level``, ``parent_turn``, ``root_turn``, ``depth``, ``position``.

    ``n_quoted`` counts quoting lines. A message that quotes nothing known has no
    parent; its root is itself, its depth and position 0. A null text counts as empty. Null
    conversations or turns link to nothing; their root is their own turn. Rows
    of one conversation and turn say and quote together. Ties for a parent go to
    the later message. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    with_lines = df.withColumn("lines", parsed(F.col("text")))
    quoting = stored(with_lines.where(F.col("text").contains(">") & F.exists("lines", lambda x: x["level"] > 0) & F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", "lines"), "quoting")
    levels = quoting.withColumn("level", F.explode(F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda n: n > 0))))
    asked = levels.select("conv", "turn", "level", F.explode(passages(at_level(F.col("lines"), F.col("level")))).alias("passage"))
    asked = stored(asked.select("conv", "turn", "level", F.md5("passage").alias("hash"), F.length("passage").alias("size")).distinct(), "quoted")

    talks = asked.select("conv").distinct()
    said = with_lines.where(F.col("turn").isNotNull()).join(talks, "conv", "left_semi").select("conv", "turn", F.explode(passages(at_level(F.col("lines"), 0))).alias("passage")).select("conv", "turn", F.md5("passage").alias("hash")).distinct()
    said = said.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")

    rows = said.withColumn("own", F.col("turn")).unionByName(asked.select("conv", "hash", "turn").distinct().withColumn("own", F.lit(None).cast("long"))).withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv", "hash", "block").agg(F.max("own").alias("last")).select("conv", "hash", "block", F.max("last").over(before).alias("carried"))
    near = rows.withColumn("near", F.max("own").over(inside)).where("own is null").join(carried, ["conv", "hash", "block"])
    meant = near.select("conv", "hash", "turn", F.coalesce("near", "carried").alias("target")).where("target is not null").distinct()
    votes = asked.join(meant, ["conv", "hash", "turn"]).groupBy("conv", "turn", "level", "target").agg(F.sum("size").alias("votes"))
    parents = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "votes", "target")).alias("best")).select("conv", "turn", F.col("best.target").alias("parent"))
    parents = stored(parents, "parents")

    # each round doubles the distance that a pointer spans; a parent's turn is less, so there are no circles
    reach = parents.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        further = reach.select("conv", F.col("turn").alias("up"), F.col("up").alias("over"), F.col("depth").alias("more"))
        if reach.join(further, ["conv", "up"], "left_semi").isEmpty():
            break
        reach = stored(reach.join(further, ["conv", "up"], "left").select("conv", "turn", F.coalesce("over", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "reach")
    left = positions(parents, block)
    whole = left.select("conv", F.col("turn").alias("up"), F.col("left").alias("size"))
    placed = parents.join(reach, ["conv", "turn"]).join(left, ["conv", "turn"]).join(whole, ["conv", "up"]).withColumn("position", F.col("size") - F.col("left"))
    tree = placed.select(F.col("conv").alias("in_conv"), F.col("turn").alias("of_turn"), "parent", F.col("up").alias("root"), "depth", "position")

    out = with_lines.join(tree, (F.col("conv") == F.col("in_conv")) & (F.col("turn") == F.col("of_turn")), "left")
    level = F.array_max(F.transform("lines", lambda x: x["level"]))
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), at_level(F.col("lines"), 0).alias("clean_text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), level.cast("long").alias("max_level"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
    )
