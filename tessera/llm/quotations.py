"""Quotation linking for chats, with DataFrame functions only.

A line's quote level is the number of `>` marks before it. Runs of quoted lines of one level are passages; they and their
lines are normalised and hashed, and joined to the first message of the conversation that wrote the same text itself.
Messages then come without quotes, in reply order: a message that quotes an earlier one stands in that one's thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BREAK = r"\r\n|\r|\n"


def normalised(text: Column) -> Column:
    """White space collapsed, A-Z in lower case."""
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def _units(texts: Column) -> Column:
    """Distinct hashes of the normalised texts, without empty ones."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda t: t != ""), lambda t: F.sha2(t, 256)))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with levels and bodies of the lines, runs of equal level (level, lines), and own_text: the lines of level 0."""
    lines = messages.withColumn("_lines", F.split(F.coalesce(text_col, F.lit("")), BREAK))
    # A run of one class of characters, cut after its last mark: no group that a pattern would have to enter again for each mark.
    marks = F.transform("_lines", lambda x: F.rtrim(F.regexp_extract(x, r"^[ \t>]*", 0), F.lit(" \t")))
    lines = lines.withColumn("_marks", marks).withColumn("levels", F.transform("_marks", lambda m: F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))))
    lines = lines.withColumn("bodies", F.zip_with("_lines", "_marks", lambda x, m: F.substr(x, F.length(m) + 1)))
    starts = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    lines = lines.withColumn("_starts", starts)
    runs = F.transform("_starts", lambda s, k: F.struct(F.get("levels", s).alias("level"), F.slice("bodies", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("levels")) - s).alias("lines")))
    own = F.array_join(F.flatten(F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["lines"])), "\n")
    return lines.withColumn("runs", runs).withColumn("own_text", F.btrim(own, F.lit(" \t\n\x0b\x0c\r"))).drop("_lines", "_marks", "_starts")


def link_quotations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row: conversation, turn, role, n_quotes, n_linked, reply_to, thread, position, message.

    n_quotes counts the quoted passages, n_linked those whose whole text, or any line, an earlier turn wrote itself. reply_to is
    the turn that a passage of level 1 links to, whole passages before single lines, later turns before earlier ones. Each of
    these is told of the row's own text, also where rows share a turn. thread is the earliest turn that the replies of the
    turn's rows lead back to, or the own one. position counts from 0, by thread, then turn. message is the role and the text
    without quotes. A null text counts as empty, a null role as "unknown"; rows without a conversation or turn are linked with
    nothing and stay. Repeated rows stay, in any order. An empty table gives an empty result. Texts are read whole, in time that
    grows with their length; a single one lies in one row.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # Rows are numbered as they are stored, so the numbers stay the same from then on.
    parsed = saved(parse_quotes(rows).select("conv", "turn", "role", "own_text", "runs", F.monotonically_increasing_id().alias("row")), "parsed")
    quoted = F.filter("runs", lambda r: r["level"] > 0)
    passages = parsed.select("conv", "turn", "row", F.posexplode(F.array_distinct(quoted)).alias("passage", "run")).where("conv is not null and turn is not null")
    wholes = passages.select("conv", "turn", "row", "passage", F.col("run.level").alias("level"), F.lit(1).alias("whole"), F.explode(_units(F.array(F.array_join("run.lines", " ")))).alias("unit"))
    lines = passages.select("conv", "turn", "row", "passage", F.col("run.level").alias("level"), F.lit(0).alias("whole"), F.explode(_units(F.col("run.lines"))).alias("unit"))
    asked = saved(wholes.union(lines), "asked")
    # Every text that a message wrote itself: all of it, its runs, paragraphs and lines. Minima come before the shuffle.
    texts = F.concat(F.array("own_text"), F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.array_join(r["lines"], " ")), F.split("own_text", r"\n[\x20\x09]*\n"), F.split("own_text", r"\n"))
    wrote = parsed.where("conv is not null and turn is not null").join(asked.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.explode(_units(texts)).alias("unit"))
    origins = saved(wrote.groupBy("conv", "unit").agg(F.min("turn").alias("origin")), "origins")
    found = asked.join(origins.hint("merge"), ["conv", "unit"]).where("origin < turn")
    best = F.max(F.when(F.col("level") == 1, F.struct("whole", "origin")))
    each = found.groupBy("conv", "turn", "row", "passage").agg(best.alias("best"))
    links = saved(each.groupBy("conv", "turn", "row").agg(F.count("*").alias("n_linked"), F.max("best").getField("origin").alias("reply_to")), "links")
    # Replies lead to earlier turns. A turn takes the least thread of the turns that its rows reply to, and of its thread so far, which doubles the steps.
    replies = saved(links.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("to")).distinct(), "replies")
    roots = replies.groupBy("conv", "turn").agg(F.min("to").alias("thread"))
    while True:
        roots = saved(roots, "threads")
        steps = replies.unionByName(roots.select("conv", "turn", F.col("thread").alias("to")))
        further = steps.join(roots.select("conv", F.col("turn").alias("to"), "thread"), ["conv", "to"]).groupBy("conv", "turn").agg(F.min("thread").alias("further"))
        stepped = saved(roots.join(further, ["conv", "turn"], "left"), "threads")
        roots = stepped.select("conv", "turn", F.least("thread", "further").alias("thread"))
        if not stepped.where("further < thread").limit(1).count():
            break
    joined = parsed.join(links.select("row", "n_linked", "reply_to"), "row", "left").join(roots, ["conv", "turn"], "left")
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own_text"))
    told = joined.select(
        "conv", "turn", "role", F.size(F.array_distinct(quoted)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("thread", "turn").alias("thread"), message.alias("message"), "row",
    )
    # Places come from a range sort, so that a conversation of any length is dealt over many tasks.
    placed = saved(told.orderBy("conv", "thread", "turn", "role", "message", "row").withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_task", F.shiftright("_at", 33))
    spans = placed.groupBy("conv", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("conv").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = saved(spans.select(F.col("conv").alias("_conv"), F.col("_task").alias("_span"), "_first", earlier.alias("_earlier")), "spans")
    both = placed.join(spans.hint("merge"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_task") == F.col("_span")))
    return both.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "n_quotes", "n_linked", "reply_to", "thread",
        (F.col("_earlier") + F.col("_at") - F.col("_first")).alias("position"), "message",
    )


def render(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, chat): the messages of each conversation in reply order. For conversations that fit in one row."""
    told = F.array_sort(F.collect_list(F.struct("position", "message")))
    return linked.groupBy(conv_col).agg(F.array_join(F.transform(told, lambda m: m["message"]), "\n").alias("chat"))
