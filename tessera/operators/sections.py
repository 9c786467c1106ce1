"""Sections: lines to labelled sections.

Every test of a line is evaluated once for each distinct text and stored; the walk over their results is a scan in blocks over
a few narrow columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import with_facts
from ..functions.text import section_label_removed
from ..rules import LABELS, SECTIONS, RuleSet
from ..storage import saved
from .lookup import of_distinct
from .scan import going_on

STICKY = ("ingredients", "usage", "cautions")


#: What classify adds, besides the facts that the walk needs.
GUESSED = ("name_like", "name_score", "list_score", "link", "amount", "meta", "usage", "caution", "capacity_word", "n_separators")


def classify(lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """lines, a stored table, with label, value, implicit, structure, for each section whether the line may go on with it, and what guesses need.

    Texts are as clean_text makes them. The facts of each distinct text are worked out once; its value, the text without its label,
    is cut from the line itself. Store the result before rows are chosen by them.
    """

    def told(texts: DataFrame) -> DataFrame:
        facts, x = with_facts(texts, "text", rules, cleaned=True)
        out = facts.withColumns({
            "label": x.label, "implicit": x.implicit, "structure": x.structure, "meta": x.meta, "listed": x.ingredient_list, "caution": x.caution, "usage": x.usage, "link": x.url, "amount": x.amount,
            "n_separators": x.separators, "n_tokens": F.size(x.tokens), "sentence_any": x.sentence(True), "name_like": x.product_name, "name_score": x.name_score, "list_score": x.list_score,
            "capacity_word": x.has("capacity"),
        })
        c = F.col
        out = out.withColumns({
            "free_ingredients": ~c("usage") & ~c("caution") & ~c("meta") & ~c("link"),
            "sure_ingredients": c("structure") | (c("n_separators") >= 1) | (c("n_tokens") >= 2),
            "on_usage": ~c("meta") & ~c("listed") & ~c("caution") & c("sentence_any"),
            "on_cautions": ~c("listed") & ~c("link") & c("sentence_any"),
            "on_capacity": ~c("meta") & c("amount"),
            "on_effects": ~c("meta") & ~c("listed") & ~c("link") & ~c("amount") & c("sentence_any"),
            "on_qr_url": ~c("meta") & c("link"),
        })
        return out.select(*texts.columns, *(n for n in dict.fromkeys([*FACTS, *GUESSED]) if n != "value"))

    facts = of_distinct(lines, "text", told, "line-facts")
    value = F.when(F.col("label").isNotNull(), section_label_removed(F.col("text"), F.col("label"), rules))
    return facts.withColumn("value", value).select(*dict.fromkeys([*lines.columns, *FACTS, *GUESSED]))


def classified(lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """lines if classify has been over them, else what it makes of them, as a stored table."""
    return lines if {*FACTS, *GUESSED} <= set(lines.columns) else saved(classify(saved(lines, "lines"), rules), "classified")


FACTS = ("label", "value", "implicit", "structure", "free_ingredients", "sure_ingredients", "on_usage", "on_cautions", "on_capacity", "on_effects", "on_qr_url")


def walk(lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """(image_id, center_y, x_min, line_index, section, reason, labelled) of the lines that lie in a section; no text is moved.

    A label starts its section, and lines go on with it while they can; what a line's content alone tells (implicit) comes before,
    and starts a section if it is one of STICKY.
    """
    told = classified(lines, rules)
    starts = F.coalesce("label", F.when(F.col("implicit").isin(*STICKY), F.col("implicit")))
    plain = F.col("label").isNull() & F.col("implicit").isNull()
    on = {s: F.col(f"on_{s}") for s in ("usage", "cautions", "capacity", "effects", "qr_url")}
    valued = told.withColumn("_valued", F.coalesce(F.col("value") != "", F.lit(False)))
    rows = going_on(valued, ("image_id",), ("center_y", "x_min", "line_index"), starts, plain, F.col("structure"), F.col("free_ingredients"), F.col("sure_ingredients"), on, rules.gap_tolerance, ("label", "implicit", "_valued"))
    section = F.when(F.col("label").isNotNull(), F.when(F.col("_valued"), F.col("label"))).otherwise(F.coalesce("implicit", "active"))
    reason = F.when(F.col("label").isNotNull(), F.concat("label", F.lit(" label value"))).when(F.col("implicit").isNotNull(), F.concat(F.lit("implicit "), "implicit")).otherwise(F.concat(F.lit("continued from "), "active"))
    out = rows.select("image_id", "center_y", "x_min", "line_index", section.alias("section"), reason.alias("reason"), F.col("label").isNotNull().alias("labelled"))
    return out.where("section is not null")


def detect(lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """(image_id, line_index, section, reason, section_text) of the lines that the walk puts in a section."""
    lines = classified(lines, rules)
    texts = lines.select("image_id", "line_index", "text", "value")
    rows = walk(lines, rules).join(texts, ["image_id", "line_index"])
    return rows.select("image_id", "line_index", "section", "reason", F.when(F.col("labelled"), F.col("value")).otherwise(F.col("text")).alias("section_text"))


def line_key(text, x="x_min", y="center_y"):
    return F.concat_ws("|", text, F.round(x, 1).cast("string"), F.round(y, 1).cast("string"))


def with_others(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found and, as others, every line whose text and place no section has. A header loses its label, so its key differs and it is kept.
    lines: a stored table, as it is read more than once."""
    placed = lines.select("image_id", "line_index", "text", "x_min", "center_y")
    used = found.where("section <> 'others'").join(placed, ["image_id", "line_index"]).select("image_id", line_key("section_text").alias("line_key")).distinct()
    rest = placed.withColumn("line_key", line_key("text")).join(used, ["image_id", "line_key"], "left_anti")
    return found.unionByName(rest.select("image_id", "line_index", F.lit("others").alias("section"), F.lit("unclassified other text").alias("reason"), F.col("text").alias("section_text")))


def guess_product_name(lines: DataFrame, rules: RuleSet = LABELS, first: int = 10, keep: str = "text") -> DataFrame:
    """(image_id, line_index, text, score): of the first lines that can be a name, the most like one; the higher on the page, the better."""
    own = Window.partitionBy("image_id")
    ranked = lines.withColumns({"_pos": F.row_number().over(own.orderBy("center_y", "x_min", "line_index")), "_low": F.max("center_y").over(own)}).where(f"_pos <= {first}")
    score = F.col("name_score") + F.greatest(F.lit(0.0), 1.0 - F.col("center_y") / F.greatest("_low", F.lit(1)))
    return _top(classified(ranked, rules).where("name_like").withColumn("score", score), "_pos").select("image_id", "line_index", keep, "score")


def _top(scored: DataFrame, order: str) -> DataFrame:
    """The best row of each document, the first of equals; scores that differ by rounding alone are equal."""
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.round("score", 9)), order))).where("_r = 1")


def guess_capacity(lines: DataFrame, rules: RuleSet = LABELS, keep: str = "text") -> DataFrame:
    """(image_id, line_index, text, score): the best line with an amount; a label word counts for it, what looks like a maker's note against it."""
    score = F.lit(1.0) + F.when(F.col("capacity_word"), 0.4).otherwise(0.0) - F.when(F.col("meta"), 1.0).otherwise(0.0)
    return _top(classified(lines, rules).where("amount").withColumn("score", score), "line_index").select("image_id", "line_index", keep, "score")


def islands(lines: DataFrame, candidate: str, tolerance: int = LABELS.gap_tolerance, by: str = "image_id", pos: str = "line_index") -> DataFrame:
    """(by, island, first, last): stretches of candidates with at most `tolerance` other lines between neighbours."""
    order = Window.partitionBy(by).orderBy(pos)
    gap = F.col(pos) - F.lag(pos).over(order) - 1
    marked = lines.where(candidate).select(by, pos, F.when(gap > tolerance, 1).otherwise(0).alias("_new"))
    return marked.withColumn("island", F.sum("_new").over(order)).groupBy(by, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"))


def guess_ingredients(lines: DataFrame, rules: RuleSet = LABELS, keep: str = "text") -> DataFrame:
    """(image_id, line_index, text) of the island of candidate lines that is most like an ingredient list."""
    against = F.when(F.col("meta"), 1.5).otherwise(0.0) + F.when(F.col("usage"), 1.0).otherwise(0.0) + F.when(F.col("caution"), 1.0).otherwise(0.0)
    told = classified(lines, rules).withColumn("_size", F.length("text")).withColumns({"_pos": F.row_number().over(Window.partitionBy("image_id").orderBy("center_y", "x_min", "line_index")), "_against": against})
    found = islands(told, "list_score > 0", rules.gap_tolerance, pos="_pos")
    inside = told.join(found, "image_id").where("_pos between first and last")
    each = inside.groupBy("image_id", "island").agg(F.count_if("structure").alias("_n"), F.sum(F.when(F.col("structure"), 2.0).otherwise(0.0) - F.col("_against")).alias("_s"), F.sum("n_separators").alias("_sep"), F.sum("_size").alias("_len"))
    score = F.col("_s") + F.least(F.col("_sep") * 0.3, F.lit(3.0)) + F.least(F.col("_len") * 0.005, F.lit(2.0))
    best = _top(each.where("_n > 0").withColumn("score", score), "island").select("image_id", "island")
    return inside.join(best, ["image_id", "island"]).select("image_id", "line_index", keep)


def fill_missing(found: DataFrame, lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """found and, for name, capacity, ingredients and links that a document lacks, the best guess over all its lines."""
    lines = classified(lines, rules)
    missing = _missing(found, lines, rules, "text")
    return found.unionByName(missing.select("image_id", "line_index", "section", "reason", F.col("text").alias("section_text")))


def _missing(found: DataFrame, lines: DataFrame, rules: RuleSet, keep: str) -> DataFrame:
    """(image_id, line_index, keep, section, reason) of the guesses for sections that a document lacks in found."""
    named = lambda df, section: df.select("image_id", "line_index", keep, F.lit(section).alias("section"))
    guesses = [named(guess_product_name(lines, rules, keep=keep), "product_name"), named(guess_capacity(lines, rules, keep), "capacity"), named(guess_ingredients(lines, rules, keep), "ingredients"), named(lines.where("link"), "qr_url")]
    missing = reduce(DataFrame.unionByName, guesses).join(found.select("image_id", "section").distinct(), ["image_id", "section"], "left_anti")
    return missing.withColumn("reason", F.concat(F.lit("global guess "), "section"))


def section_texts(found: DataFrame) -> DataFrame:
    """(image_id, section, texts, text): distinct texts of each section in line order; lists by spaces, sentences by lines."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_index", "section_text"))), lambda s: s["section_text"])
    each = found.groupBy("image_id", "section").agg(F.array_distinct(ordered).alias("texts"))
    lined = F.col("section").isin("usage", "cautions", "effects", "others")
    return each.withColumn("text", F.when(lined, F.array_join("texts", "\n")).otherwise(F.array_join("texts", " ")))


def section_boxes(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(image_id, section, text_count, x1, y1, x2, y2, reasons, preview) of each section."""
    boxes = lines.select("image_id", "line_index", "x_min", "x_max", "y_min", "y_max")
    rows = found.join(boxes, ["image_id", "line_index"])
    ordered = F.sort_array(F.collect_list(F.struct("line_index", "reason", "section_text")))
    told = rows.groupBy("image_id", "section").agg(F.count("*").alias("text_count"), F.min("x_min").alias("x1"), F.min("y_min").alias("y1"), F.max("x_max").alias("x2"), F.max("y_max").alias("y2"), ordered.alias("_rows"))
    return told.withColumns({"reasons": F.array_distinct(F.transform("_rows", lambda r: r["reason"])), "preview": F.array_join(F.transform(F.slice("_rows", 1, 3), lambda r: r["section_text"]), " / ")}).drop("_rows")


def section_map(texts: DataFrame) -> DataFrame:
    """One row per document with a column for each section."""
    return texts.groupBy("image_id").pivot("section", list(SECTIONS)).agg(F.first("texts"))


def detect_sections(lines: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """The whole way: classify once, walk, fill what is missing, and put the rest into others, as detect, fill_missing and with_others do.

    Which lines go where is settled by their MD5s; texts are joined once, at the end.
    """
    lines = classified(lines, rules)
    told = lines.withColumn("_text", F.unhex(F.md5("text")))
    walked = saved(walk(lines, rules).select("image_id", "line_index", "section", "reason", "labelled"), "walked")
    guessed = _missing(walked, told, rules, "_text").withColumn("labelled", F.lit(False))
    found = saved(walked.withColumn("_text", F.lit(None).cast("binary")).unionByName(guessed), "found")
    place = lambda c: F.coalesce(F.round(c, 1).cast("string"), F.lit(""))
    placed = told.select("image_id", "line_index", F.col("_text").alias("_own"), F.unhex(F.md5("value")).alias("_value"), place("x_min").alias("_x"), place("center_y").alias("_y"))
    own = F.col("_text").isNull() | (F.col("_text") == F.col("_own"))
    used = found.where("section <> 'others'").join(placed, ["image_id", "line_index"]).where(own).select("image_id", "_x", "_y", F.when(F.col("labelled"), F.col("_value")).otherwise(F.col("_own")).alias("_own")).distinct()
    rest = placed.join(used, ["image_id", "_x", "_y", "_own"], "left_anti")
    rest = rest.select("image_id", "line_index", F.lit("others").alias("section"), F.lit("unclassified other text").alias("reason"), F.lit(False).alias("labelled"), F.col("_own").alias("_text"))
    texts = told.select("image_id", "line_index", "text", "value", F.col("_text").alias("_own"))
    every = found.unionByName(rest).join(texts, ["image_id", "line_index"]).where(own)
    return every.select("image_id", "line_index", "section", "reason", F.when(F.col("labelled"), F.col("value")).otherwise(F.col("text")).alias("section_text"))
