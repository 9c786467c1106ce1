"""Sections of raw text, where none have been detected: a walk over lines with rules of their own, and the list that a text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import spaceless
from ..functions.phrases import general_text, list_text, own_labels_removed, with_phrase_facts
from ..rules import RAW, RuleSet
from ..storage import saved
from .lookup import of_distinct
from .scan import going_on

NAMES = ("product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url")
FACTS = ("label", "value", "alone", "structure", "free_ingredients", "sure_ingredients", "on_usage", "on_cautions", "on_capacity", "on_effects", "on_qr_url")


def raw_lines(docs: DataFrame, by: str, text: str = "raw_text", rules: RuleSet = RAW) -> DataFrame:
    """(by, pos, text, facts): the lines that are not blank, with what the walk and the guesses ask of them, as a stored table. Each distinct text is worked out once."""
    lines = docs.select(by, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("pos", "text")).withColumn("text", general_text(F.col("text"))).where("text <> ''")
    return saved(of_distinct(saved(lines, "raw-lines"), "text", lambda texts: _facts(texts, rules), "raw-facts"), "raw-lines").withColumn("value", _value(rules)).withColumn("list_value", F.when(F.col("opens"), own_labels_removed(F.col("text"), rules.ingredients)).otherwise(F.col("text")))


def _facts(texts: DataFrame, rules: RuleSet) -> DataFrame:
    facts, x = with_phrase_facts(texts, "text", rules)
    alone = (
        F.when(x.amount, "capacity").when(x.url, "qr_url").when(x.ingredient_list, "ingredients").when(x.usage, "usage").when(x.caution, "cautions").when(x.effects, "effects")
    )
    sentence = x.sentence()
    out = facts.withColumns({
        "label": x.label, "alone": alone, "structure": x.structure, "listed": x.ingredient_list, "name_like": x.product_name,
        "free_ingredients": ~x.usage & ~x.caution & ~x.meta & ~x.url, "sure_ingredients": x.structure | (x.separators >= 1) | (F.size(x.tokens) >= 2),
        "on_usage": sentence, "on_cautions": sentence, "on_effects": sentence, "on_capacity": x.amount, "on_qr_url": x.url | x.has("links"), "opens": x.has("list_headers"),
        "stops": x.has("product", "capacity", "usage", "cautions", "effects", "links", "makers", "storage") | x.meta | x.usage | x.caution,
    })
    return out.select(*texts.columns, *(n for n in FACTS if n != "value"), "listed", "name_like", "opens", "stops")


def _value(rules: RuleSet) -> Column:
    """A line with a label without it."""
    value = F.when(F.lit(False), F.col("text"))
    for name in NAMES[:-1]:
        value = value.when(F.col("label") == name, own_labels_removed(F.col("text"), rules.keywords(name)))
    return value.when(F.col("label") == "qr_url", F.col("text"))


def raw_sections(lines: DataFrame, by: str, rules: RuleSet = RAW) -> DataFrame:
    """(by, section, text) of raw_lines: each section's distinct lines, joined; a text without a product name gets its longest line, of
    the first ten, that can be one."""
    on = {s: F.col(f"on_{s}") for s in ("usage", "cautions", "capacity", "effects", "qr_url")}
    valued = lines.withColumn("_valued", F.coalesce(F.col("value") != "", F.lit(False)))
    told = going_on(valued, (by,), ("pos",), F.col("label"), F.col("label").isNull(), F.col("structure"), F.col("free_ingredients"), F.col("sure_ingredients"), on, rules.gap_tolerance, ("label", "alone", "_valued"))
    # A line that ends a section is looked at like one outside of any.
    section = F.when(F.col("label").isNotNull(), F.when(F.col("_valued"), F.col("label"))).otherwise(F.coalesce("active", "alone"))
    told = told.select(by, "pos", section.alias("section")).where("section is not null").join(lines.select(by, "pos", "text", "label", "value"), [by, "pos"])
    found = saved(told.select(by, "section", "pos", F.when(F.col("label").isNotNull(), F.col("value")).otherwise(F.col("text")).alias("text")), "raw-walk")
    first = lines.select(by, "pos", "text", "name_like").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where("_n <= 10 and name_like")
    like = F.struct(F.length("text").alias("a"), F.col("text").rlike("[A-Za-z]").alias("b"), F.col("text").rlike("[가-힣]").alias("c"), (-F.col("pos")).alias("d"))
    names = first.groupBy(by).agg(F.max_by("text", like).alias("text"), F.lit(0).alias("pos")).join(found.where("section = 'product_name'").select(by).distinct(), by, "left_anti")
    every = found.unionByName(names.select(by, F.lit("product_name").alias("section"), "pos", "text"))
    each = every.where("text <> ''").groupBy(by, "section", spaceless(F.col("text")).alias("_k")).agg(F.min(F.struct("pos", "text")).alias("_v"))
    joined = each.groupBy(by, "section").agg(F.transform(F.sort_array(F.collect_list("_v")), lambda v: v["text"]).alias("texts"))
    lined = F.col("section").isin("usage", "cautions", "effects")
    plain = joined.select(by, "section", F.when(lined, F.array_join("texts", "\n")).otherwise(F.array_join("texts", " ")).alias("text"))
    lists = saved(list_text(plain.where("section = 'ingredients'"), "text", rules), "raw-lists")
    return plain.where("section <> 'ingredients'").unionByName(lists)


def list_in_raw_text(lines: DataFrame, by: str, rules: RuleSet = RAW) -> DataFrame:
    """(by, text) of raw_lines: from the first line that opens or looks like an ingredient list up to a line that ends one, or to the fourth in a row
    that is not like one. Windows tell all of that; no state is carried."""
    order = Window.partitionBy(by).orderBy("pos")
    placed = lines.select(by, "pos", "text", "structure", "listed", "opens", "stops", "list_value").withColumn("_n", F.row_number().over(order))
    placed = placed.withColumn("_start", F.min(F.when(F.col("opens") | F.col("listed"), F.col("_n"))).over(Window.partitionBy(by))).where("_n >= _start")
    placed = placed.withColumn("_last", F.max(F.when(F.col("structure") | (F.col("_n") == F.col("_start")), F.col("_n"))).over(order))
    over = (F.col("_n") > F.col("_start")) & (F.col("stops") | (F.col("_n") - F.col("_last") > rules.gap_tolerance))
    kept = placed.withColumn("_over", F.max(over.cast("int")).over(order)).where("_over = 0")
    part = F.struct("_n", F.when(F.col("_n") == F.col("_start"), F.col("list_value")).otherwise(F.col("text")).alias("t"))
    joined = kept.groupBy(by).agg(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), lambda t: t != ""), " ").alias("text"))
    return saved(list_text(joined, "text", rules), "list-texts")
