"""Fields of raw section texts: names of a list, product name, amount, sentences and links.

Whatever has to be tested piece by piece is exploded into rows, so that a piece's facts are worked out once, a long text is dealt
over tasks, and no expression is repeated inside another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import compact, ordered_distinct, replaced, spaceless, strip
from ..functions.phrases import advert_cut, comma_after_ends, ends_as_advert, general_lines, general_text, list_text, name_text, own_labels_removed, tagged_phrase, trimmed, with_phrase_facts
from ..functions.predicates import Line, has_keyword
from ..rules import CAPACITIES, LINK_ENDS, RAW, SECTION_LABELS, RuleSet
from ..storage import saved
from .lookup import joined_by_key
from .routing import inline_segments, numbered_items

#: From this length a piece without separators is taken for several names.
LONG_NAME = 40
WHOLE = 1 << 30
#: Words that make up at least one in so many are hot. A name has at most 80 characters, so they are few bytes.
HOT_WORDS = 20_000


def first_of_equals(rows: DataFrame, by: str, order: tuple[str, ...], text: str = "text") -> DataFrame:
    """(by, items): texts in order, once each by key; partial minima come before the shuffle."""
    each = rows.where(f"{text} <> ''").groupBy(by, spaceless(F.col(text)).alias("_k")).agg(F.min(F.struct(*order, text)).alias("_v")).where("_k <> ''")
    return each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list("_v")), lambda v: v[text]).alias("items"))


def _candidates(named: DataFrame, rules: RuleSet) -> DataFrame:
    """The rows whose `text`, cleaned as a name, can be one. Told in place: pieces are short, and most of them differ."""
    plain, x = tagged_phrase(named.withColumn("_plain", general_text(F.col("text"))), "_plain", rules)
    return plain.where(x.candidate).select(*named.columns)


def _valid_names(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """rows with `text` cleaned as a name, those that can be one."""
    return _candidates(name_text(rows, "text", rules), rules)


def _word_key(word: Column) -> Column:
    """Short words are their own keys, long ones have an MD5, after a blank that no word has."""
    return F.when(F.length(word) <= 32, word).otherwise(F.concat(F.lit(" "), F.md5(word)))


def _loose(c: Column) -> tuple[Column, Column]:
    """Steps: a text without separators as _unseparated takes it, with the commas that known ends of names ask for."""
    return general_text(c), F.when(F.contains(c, F.lit(",")), c).otherwise(comma_after_ends(c))


def _unseparated(rows: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(words, parts) of rows, a stored table (..., row, piece, text) with one row a text, which _loose has made: the words of each text that are
    names, cleaned, and what is still to be tested: its parts if it has commas, all of it if none of its words is a name; with `sub` for their order.

    Each distinct word is worked out once, as often in turn as a name is. No name has up to four letters and nothing else.
    """
    key = [c for c in rows.columns if c != "text"]
    comma, blank = F.contains("text", F.lit(",")), F.contains("text", F.lit(" "))
    several = rows.where(~comma & blank)
    words = several.select(*key, F.posexplode(F.split("text", " ")).alias("sub", "word")).where(~F.col("word").rlike("^[a-zA-Z]{0,4}$"))
    named = saved(_valid_names(words.groupBy("word").agg(F.count("*").alias("_times")).withColumn("text", F.col("word")), rules), "word-names")
    # A word that is a name as it stands stays one.
    named = named.where("text = word").unionByName(_valid_names(_valid_names(named.where("text <> word"), rules), rules))
    table = saved(named.select(_word_key(F.col("word")).alias("_k"), "text", "_times"), "word-names")
    found = saved(joined_by_key(words.select(*key, "sub", _word_key(F.col("word")).alias("_k")), table, "_k", "_times", HOT_WORDS).drop("_k"), "words")
    whole = several.join(found.select("row", "piece").distinct(), ["row", "piece"], "left_anti").select(*key, F.lit(WHOLE).alias("sub"), "text")
    parts = rows.where(comma | ~blank).select(*key, F.posexplode(F.split("text", ",+")).alias("sub", "text"))
    return found, parts.unionByName(whole)


def ingredient_candidates(texts: DataFrame, by: str, text: str = "text", order: str | None = None, rules: RuleSet = RAW) -> DataFrame:
    """(by, items): the names in each group's texts, valid ones once each, in order. Groups without any have no row. A stored table.

    Texts are split at commas that stand outside of numbers, else at semicolons and bars, else at dots, else by known ends of
    names and by words; long pieces without separators once more by the latter.
    """
    rows = texts.select(by, (F.col(order) if order else F.lit(0)).alias("no"), F.col(text).alias("text")).where("text is not null and text <> ''")
    # Far more work is done on a text than its shuffle costs: dealt anew, so that a large file of one part is worked on by many tasks.
    # Stored between the two passes: as one plan they take several times as long as one after the other.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = list_text(saved(list_text(rows.repartition(parts, by), "text", rules), "once"), "text", rules)
    # Its marks are unified.
    commas = F.regexp_count("text", F.lit(",")) - F.regexp_count("text", F.lit(r"\d *, *\d"))
    at = F.when(commas >= 1, ",").when(F.contains("text", F.lit(";")), ";").when(F.contains("text", F.lit("·")), "·").otherwise("")
    # A text's number tells its pieces from those of others with the same id and place.
    rows = rows.withColumns({"_at": at, "row": F.monotonically_increasing_id()})
    for step in _loose(F.col("text")):
        rows = rows.withColumn("text", F.when(F.col("_at") == "", step).otherwise(F.col("text")))
    rows = saved(rows, "lists").where("text <> ''")
    words, loose = _unseparated(rows.where("_at = ''").select(by, "no", "row", F.lit(0).alias("piece"), "text"), rules)
    pieces = loose.select(by, "no", "row", F.col("sub").alias("piece"), "text")
    for mark, pattern in {",": ",+", ";": ";+", "·": "·+"}.items():
        pieces = pieces.unionByName(rows.where(F.col("_at") == mark).select(by, "no", "row", F.posexplode(F.split("text", pattern)).alias("piece", "text")))
    # Blanks at the ends of a piece would have its spaces made even, which they are.
    named = name_text(pieces.withColumn("text", F.trim("text")).where("text <> ''"), "text", rules)
    named = named.withColumn("long", (F.length("text") > LONG_NAME) & F.contains("text", F.lit(" ")) & ~F.col("text").rlike("[,;·]"))
    for step in _loose(F.col("text")):
        named = named.withColumn("text", F.when(F.col("long"), step).otherwise(F.col("text")))
    named = saved(named, "pieces")
    again, rest = _unseparated(named.where("long").drop("long"), rules)
    place = [by, "no", "piece", "sub", "text"]
    # A name once cleaned is cleaned again; those of words have been.
    short = _candidates(named.where("not long").select(by, "no", "piece", F.lit(0).alias("sub"), "text"), rules)
    good = _valid_names(short.unionByName(_valid_names(rest.select(place), rules)), rules)
    every = good.unionByName(again.select(place)).unionByName(words.select(by, "no", F.col("sub").alias("piece"), F.lit(0).alias("sub"), "text"))
    return saved(first_of_equals(every.withColumn("text", strip(F.col("text"))), by, ("no", "piece", "sub")), "names")


def amount_mended(c: Column) -> Column:
    c = replaced(c, (("㎖", "ml"), ("ｍｌ", "ml"), ("ＭＬ", "ml"), ("ｍL", "ml"), ("Ｍl", "ml"), ("ｍｇ", "mg"), ("ＭＧ", "mg"), ("ｇ", "g"), ("Ｇ", "g")))
    for pattern, new in ((r"(?i)(\d)\s*ml", "$1ml"), (r"(?i)(\d)\s*mg", "$1mg"), (r"(\d)\s*[gG]", "$1g"), (r"(?i)(\d)\s*(매|pcs|ea|개)", "$1$2"), (r"(\d)\s*[xX×]\s*(\d)", "$1 x $2")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def near_words(text: Column, part: Column, words: tuple[str, ...], around: int = 20) -> Column:
    """Whether any of the words stands within so many characters of the part's first occurrence."""
    at = F.position(part, text)
    start = F.greatest(at - around, F.lit(1))
    return (at > 0) & has_keyword(compact(F.substring(text, start, at + F.length(part) + around - start)), words)


def amounts(df: DataFrame, text: str, rules: RuleSet = RAW) -> DataFrame:
    """df with the text replaced by the amounts in it, joined by " / "; empty where there are none, or a lot number or date is named.

    A last digit 9 that stands for g is mended where a label tells that an amount is meant.
    """
    c = F.col(text)
    df = df.withColumn(text, amount_mended(general_text(c))).withColumn(text, own_labels_removed(c, rules.capacity))
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in CAPACITIES))
    df = df.withColumn("_found", F.transform(found, general_text))
    df = df.withColumn("_found", ordered_distinct(F.filter("_found", lambda x: (x != "") & ~near_words(c, x, rules.not_capacity))))
    x = Line(c, rules)
    digits = F.regexp_extract(c, r"(?<!\d)(\d{2,4})9(?!\d)", 1)
    guess = F.when(has_keyword(x.key, rules.capacity) & digits.try_cast("int").between(5, 1000), F.concat(digits, F.lit("g")))
    told = F.when(has_keyword(x.key, rules.not_capacity), "").when(F.size("_found") > 0, F.array_join("_found", " / ")).otherwise(F.coalesce(guess, F.when(x.amount, c), F.lit("")))
    return df.withColumn(text, told).drop("_found")


def sentence_parts(c: Column) -> Column:
    """Lines; a single line is cut into sentences. Each cleaned, blank ones left out."""
    lines = F.split(c, r"[\n\r]+")
    parts = F.when(F.size(lines) > 1, lines).otherwise(F.split(c, r"(?<=[.!?。])\s+|(?<=다\.)\s+"))
    return F.filter(F.transform(parts, general_text), lambda x: x != "")


def product_names(df: DataFrame, by: str, text: str, rules: RuleSet = RAW) -> DataFrame:
    """(by, name) of the texts that have one: the whole text without labels and advertising, else its best line or sentence."""
    c = F.col("text")
    rows = df.select(by, general_text(F.col(text)).alias("text")).withColumn("text", general_text(own_labels_removed(c, rules.product)))
    rows = rows.withColumn("text", strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?iU)^\s*brand\s*[:：]?\s*", ""), r"(?U)^\s*브랜드\s*[:：]?\s*", ""), r"(?U)^\s*상품\s*[:：]?\s*", "")))
    rows = rows.withColumn("text", advert_cut(c))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("tier"), c.alias("text"))), F.transform(sentence_parts(c), lambda p: F.struct(F.lit(1).alias("tier"), p.alias("text"))))
    each = rows.select(by, F.posexplode(parts).alias("pos", "p")).select(by, "pos", "p.tier", "p.text")
    each = each.withColumn("text", F.when(F.col("tier") == 0, c).otherwise(advert_cut(c)))
    facts, x = with_phrase_facts(each.withColumn("_plain", general_text(c)), "_plain", rules)
    told = saved(facts.withColumn("ok", x.product_name).select(by, "pos", "tier", "text", "ok"), "product-names").where("ok")
    rank = F.struct("tier", ends_as_advert(c).cast("int").alias("a"), F.abs(F.length(c) - 18).alias("b"), (~c.rlike("[가-힣]")).cast("int").alias("c"), "pos")
    return told.groupBy(by).agg(F.min_by("text", rank).alias("name"))


def section_part(c: Column, section: str) -> Column:
    """Of a section's text, what stands before the first label inside it, and after its own labels; all of it without any label."""
    parts = inline_segments(c, SECTION_LABELS, keep_lines=True)
    own = F.filter(parts, lambda p: p["section"].isNull() | (p["section"] == section))
    pattern = "(?i)" + "|".join(k for k, _ in SECTION_LABELS)
    return F.when(~c.rlike(pattern), c).otherwise(F.array_join(F.transform(own, lambda p: p["body"]), "\n"))


def section_sentences(df: DataFrame, by: str, text: str, section: str, rules: RuleSet = RAW) -> DataFrame:
    """(by, items): the sentences of a usage, cautions or effects text, once each, in order. Numbered cautions stay items of their own."""
    c, words, cautions = F.col("text"), rules.keywords(section), section == "cautions"
    rows = df.select(by, general_lines(F.col(text)).alias("text")).withColumn("text", section_part(c, section))
    rows = rows.withColumn("text", own_labels_removed(c, words)).withColumn("text", general_lines(c)).where("text <> ''")
    ends = r"(?U)[\s:：,.;/·ㆍ\-]+"
    part = lambda tier, x: F.struct(F.lit(tier).alias("tier"), x.alias("text"))
    parts = [F.transform(numbered_items(c), lambda x: part(0, x))] if cautions else []
    parts += [F.transform(sentence_parts(c), lambda x: part(1, strip(trimmed(x, ends)))), F.array(part(2, c))]
    each = rows.select(by, F.posexplode(F.concat(*parts)).alias("pos", "p")).select(by, "pos", "p.tier", "p.text").where("text <> ''")
    facts, x = with_phrase_facts(each.withColumn("_plain", general_text(c)), "_plain", rules)
    good = saved(facts.withColumn("ok", x.sentence(cautions)).select(by, "pos", "tier", "text", "ok"), "sentences").where("ok")
    best = good.withColumn("_least", F.min("tier").over(Window.partitionBy(by))).where("tier = _least")
    return first_of_equals(best, by, ("pos",))


def link_candidates(c: Column, ends: str = LINK_ENDS) -> Column:
    """Links in a text, broken ones mended: those with a scheme, then those with www, then bare domains; once each."""
    c = F.translate(F.coalesce(c, F.lit("")), "\n\t", "  ")
    for pattern, new in ((r"(?i)www\s*\.\s*", "www."), (r"(?i)(https?)\s*:\s*/\s*/", "$1://"), (rf"(?i)([a-z0-9])\s*\.\s*({ends})", "$1.$2")):
        c = F.regexp_replace(c, pattern, new)
    # A domain begins where its characters do: no place inside of a run of them is tried again.
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (r"(?i)https?://\S+", r"(?i)www\.\S+", rf"(?i)(?:(?<![\w.-])|(?<=_))[a-z0-9.-]+\.(?:{ends})\S*")))
    from ..functions.arrays import clean_list

    return clean_list(F.transform(found, lambda x: trimmed(x, r"[ ,.;:：()\[\]{}<>]+")))
