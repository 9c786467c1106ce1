"""Boxes: limits, padding, overlap and suppression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import strip
from ..functions.text import confidence
from ..rules import SECTION_ALIASES, SECTION_NAMES
from ..storage import saved
from .lookup import joined_by_key
from .scan import same

LEAST_SIDE, PAD_SHARE, PAD_LEAST, OVERLAP = 5, 0.03, 8, 0.75

#: Boxes that a box meets in its cells, on average, from which on cells are thinned out before pairs are made.
DENSE = 64
#: Groups of up to so many boxes are settled each in a row of its own.
FEW = 64


def auto_scale(width: Column, height: Column) -> Column:
    """How much an image is enlarged, by its shorter side."""
    side = F.least(width, height)
    out = F.when(side <= 400, 3.0)
    for limit, scale in ((600, 2.5), (800, 2.2), (1000, 2.0), (1400, 1.6), (1800, 1.4)):
        out = out.when(side <= limit, scale)
    return out.otherwise(1.2)


def limited(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """df (x1, y1, x2, y2) with corners in order and inside the image; boxes with a side under LEAST_SIDE go."""
    at = {}
    for a, b, most in (("x1", "x2", width), ("y1", "y2", height)):
        low, high = F.least(a, b), F.greatest(a, b)
        at |= {a: F.greatest(F.least(low, F.col(most)), F.lit(0)), b: F.greatest(F.least(high, F.col(most)), F.lit(0))}
    return df.withColumns(at).where(f"x2 - x1 >= {LEAST_SIDE} and y2 - y1 >= {LEAST_SIDE}")


def padded(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes with a margin of 3 % of a side, at least 8, inside the image."""
    x = F.greatest(F.lit(PAD_LEAST), F.bround((F.col("x2") - F.col("x1")) * PAD_SHARE).cast("int"))
    y = F.greatest(F.lit(PAD_LEAST), F.bround((F.col("y2") - F.col("y1")) * PAD_SHARE).cast("int"))
    return df.withColumns({"x1": F.greatest(F.col("x1") - x, F.lit(0)), "y1": F.greatest(F.col("y1") - y, F.lit(0)), "x2": F.least(F.col("x2") + x, F.col(width)), "y2": F.least(F.col("y2") + y, F.col(height))})


def iou(a: str | Column, b: str | Column) -> Column:
    """Shared area over joint area of two struct<x1,y1,x2,y2> columns; 0 without area."""
    c = lambda s, k: s[k] if isinstance(s, Column) else F.col(f"{s}.{k}")
    w = F.greatest(F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")), F.lit(0))
    h = F.greatest(F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")), F.lit(0))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    joint = area(a) + area(b) - w * h
    return F.when(joint > 0, w * h / joint).otherwise(0.0)


def _iou_of(a: str, b: str) -> Column:
    return iou(f"{a}.box", f"{b}.box")


def _level(side: Column, step: float) -> Column:
    return F.floor(F.log(side) / math.log(step)).cast("int")


def _size(level: Column, step: float) -> Column:
    return F.pow(F.lit(step), level + 1)


def _cells(boxes: DataFrame, step: float) -> DataFrame:
    """A row for each grid cell that a box touches, at its own level of size and the next one.

    A cell is at least as wide and high as a box of its level, so a box touches four at most; boxes that overlap enough are at most
    one level apart, so they share a level, and there the cell that holds the corner where their common part begins.
    """
    out = boxes
    for axis, low, high in (("x", "x1", "x2"), ("y", "y1", "y2")):
        own = _level(F.col(f"box.{high}") - F.col(f"box.{low}"), step)
        out = out.withColumn(f"_own_{axis}", own).withColumn(f"_l{axis}", F.explode(F.array(own, own + 1)))
        size = _size(F.col(f"_l{axis}"), step)
        out = out.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(f"box.{low}") / size), F.floor(F.col(f"box.{high}") / size))))
    return out.select(F.struct("group", "_lx", "_ly", "_cx", "_cy").alias("cell"), "rank", "box", F.struct("_own_x", "_own_y").alias("own"))


def _meets_here(a: str, b: str, step: float) -> Column:
    """Whether two boxes of a cell are to be compared in it, and in no other."""
    here = F.lit(True)
    for axis, low in (("x", "x1"), ("y", "y1")):
        level = F.col(f"cell._l{axis}")
        here = here & (level == F.greatest(f"{a}.own._own_{axis}", f"{b}.own._own_{axis}")) & (F.col(f"cell._c{axis}") == F.floor(F.greatest(f"{a}.box.{low}", f"{b}.box.{low}") / _size(level, step)))
    return here


def _settled(rows: DataFrame, group: tuple[str, ...], columns: list[str], overlap: float) -> DataFrame:
    """columns of the rows that stay, of groups of few boxes: one array a group, walked from its surest box on."""
    item = F.struct((-F.col("confidence")).alias("unsure"), "y1", "x1", F.col("_id").alias("id"), F.struct("x1", "y1", "x2", "y2").alias("box"), F.struct(*columns).alias("row"))
    by_rank = rows.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_boxes"))
    over = lambda kept, x: F.exists(kept, lambda k: iou(k["box"], x["box"]) >= overlap)
    kept = F.reduce("_boxes", F.filter("_boxes", lambda x: F.lit(False)), lambda acc, x: F.when(over(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return by_rank.select(F.explode(F.transform(kept, lambda x: x["row"])).alias("_row")).select("_row.*")


def suppress(sections: DataFrame, overlap: float = OVERLAP, dense: int = DENSE, few: int = FEW) -> DataFrame:
    """Of sections (image_index, section_type, x1, y1, x2, y2, confidence) that overlap within an image and type, the surest stay.

    As if boxes were taken surest first (then by y1 and x1) and each were kept unless it overlaps a kept one. Groups of up to `few`
    boxes are settled in one row each, which costs a shuffle of the boxes; the boxes of larger ones meet in grid
    cells. While cells are crowded (more than `dense` boxes a box on average), the best box of all its cells is kept in each, and
    what it overlaps goes; the pairs that are left are then decided in rounds: a box without a better one that is open is kept,
    and its worse neighbours go. Rounds are as many as the longest row of boxes of which each one decides the next.
    Equal boxes are one. Boxes without area overlap nothing and stay. An empty table gives an empty result.
    """
    step, group = 1 / (overlap - 1e-6), ("image_index", "section_type")
    rows = saved(sections.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    flat = rows.where("not coalesce(x2 > x1 and y2 > y1, false)").select(*sections.columns)
    solid = rows.where("x2 > x1 and y2 > y1")
    crowded = saved(solid.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*group), "crowded")
    if not crowded.limit(1).count():
        return _settled(solid, group, sections.columns, overlap).unionByName(flat)
    settled = _settled(solid.join(crowded, same(solid, crowded, group), "left_anti"), group, sections.columns, overlap).unionByName(flat)
    solid = solid.join(crowded, same(solid, crowded, group), "left_semi")
    rank = F.struct((-F.col("confidence")).alias("unsure"), "y1", "x1", F.col("_id").alias("id"))
    key, box = F.to_json(F.struct(*group)), F.struct("x1", "y1", "x2", "y2")
    open_ = saved(solid.groupBy(key.alias("group"), box.alias("box")).agg(F.min(rank).alias("rank")), "open")
    kept: list[DataFrame] = []
    while True:
        cells = saved(_cells(open_, step), "cells")
        tops = saved(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("rank", "box", "own")).alias("top")), "tops")
        pairs, boxes = tops.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
        if not pairs or pairs <= dense * boxes:
            break
        met = joined_by_key(cells, tops, "cell", "n")
        winners = saved(met.groupBy("rank").agg(F.bool_and(F.col("top.rank") == F.col("rank")).alias("won")).where("won").select(F.col("rank.id").alias("id")), "winners")
        kept.append(winners)
        won = saved(tops.join(winners.hint("merge"), tops["top.rank.id"] == winners["id"], "left_semi"), "won")
        beside = joined_by_key(cells.withColumn("me", F.struct("rank", "box", "own")), won, "cell", "n")
        gone = beside.where(_iou_of("me", "top") >= overlap).select(F.col("me.rank.id").alias("id")).distinct()
        open_ = saved(open_.join(gone.hint("merge"), open_["rank.id"] == gone["id"], "left_anti"), "open")
    a, b = (cells.select("cell", F.struct("rank", "box", "own").alias(x)) for x in ("a", "b"))
    near = a.join(b.hint("merge"), "cell").where((F.col("a.rank") < F.col("b.rank")) & _meets_here("a", "b", step) & (_iou_of("a", "b") >= overlap))
    links = saved(near.select(F.col("a.rank.id").alias("better"), F.col("b.rank.id").alias("worse")), "links")
    ids = saved(open_.select(F.col("rank.id").alias("id")), "ids")
    while True:
        worse = links.select(F.col("worse").alias("id")).distinct()
        winners = saved(ids.join(worse.hint("merge"), "id", "left_anti"), "winners")
        kept.append(winners)
        losers = saved(links.join(winners.select(F.col("id").alias("better")).hint("merge"), "better", "left_semi").select(F.col("worse").alias("id")).distinct(), "losers")
        if not losers.limit(1).count():
            break
        # What is still open has a better neighbour that is open too.
        ids = saved(ids.join(winners.unionByName(losers).hint("merge"), "id", "left_anti"), "ids")
        still = ids.hint("merge")
        links = saved(links.join(still.select(F.col("id").alias("better")), "better", "left_semi").join(still.select(F.col("id").alias("worse")), "worse", "left_semi"), "links")
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    chosen = rows.join(every.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi").select(*sections.columns)
    return chosen.unionByName(settled)


def presence(sections: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(image_index, has_<type>...) of each image."""
    return sections.groupBy("image_index").agg(*(F.max(F.col("section_type") == t).alias(f"has_{t}") for t in types))


def section_type(value: Column) -> Column:
    """The section that a name stands for, by any of its aliases; "unknown" if it stands for none."""
    aliases = F.create_map(*(F.lit(x) for section, names in SECTION_ALIASES.items() for name in names for x in (name, section)))
    text = strip(F.coalesce(value, F.lit("")))
    key, compact = F.translate(F.lower(text), "- ", "_"), F.translate(text, " -_", "")
    return F.coalesce(F.element_at(aliases, key), F.element_at(aliases, compact), F.lit("unknown"))


def located(sections: DataFrame, images: DataFrame, by: tuple[str, ...] = ("image_index",)) -> DataFrame:
    """sections (by, section_type, label, x1, y1, x2, y2, confidence) of images (by, width, height, ...) with what the image tells.

    A type that stands for no section is looked for in the label; sections of no kind, of no image, or with no box inside it are left
    out. A missing label is the section's usual one, a confidence that is no number is 0.
    """
    kinds = [section_type(F.col(c)) for c in ("section_type", "label")]
    typed = sections.withColumn("section_type", F.when(kinds[0] != "unknown", kinds[0]).otherwise(kinds[1])).where("section_type <> 'unknown'")
    names = F.create_map(*(F.lit(x) for pair in SECTION_NAMES.items() for x in pair))
    label = F.coalesce(F.nullif(strip(F.col("label")), F.lit("")), F.element_at(names, F.col("section_type")))
    return limited(typed.join(images, list(by)).withColumns({"label": label, "confidence": confidence(F.col("confidence"))}))
