"""Queries of the engine's operators over the test tables; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import clean_list, compact, distinct_words, first_known, spaceless, value_or_unknown
from ..functions.predicates import Line, separator_count, split_tokens
from ..functions.text import clean_recognised, clean_text, html_description, html_title, lenient, plain_name, safe_file_name, splittable, until_keyword, with_scheme
from ..functions import phrases, projection
from ..operators import boxes, charsets, extraction, flow, layout, lookup, merge, raw_sections, records, routing, sections, stages, verify
from ..sources import cache, readers
from ..storage import saved, work_path
from ..streaming import sessions as streamed
from .labels import label_documents

#: Labels that the generated prose has, for routing over it.
PROSE_LABELS = (("that", "usage"), ("with", "cautions"), ("avec", "cautions"), ("pour", "effects"), ("nicht", "effects"), ("para", "usage"))
CUT_WORDS = ("the", "der", "que", "los")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"))


def lines_of(docs: DataFrame) -> DataFrame:
    return layout.lines_of_text(docs.select("doc_id", "text"), "doc_id")


def line_section_counts(spark, sf_dir):
    """Lines by language, label and noise."""
    return counts_by_label(table(spark, sf_dir, "documents"))


def counts_by_label(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("raw"))
    lines = docs.select("lang", clean_text(F.col("raw")).alias("text")).where("text <> ''")
    x = Line(F.col("text"))
    told = lines.select("lang", F.coalesce(x.label, F.lit("none")).alias("label"), x.noise.alias("noise"), F.length("text").alias("n"))
    return told.groupBy("lang", "label", "noise").agg(F.count("*").alias("n_lines"), F.sum("n").cast("long").alias("n_chars"))


def separator_profile(spark, sf_dir):
    """Separators and tokens of each document's lines."""
    lines = document_lines(spark, sf_dir)
    told = lines.select("image_id", separator_count(F.col("text")).alias("s"), F.size(split_tokens(F.col("text"))).alias("t"))
    many = ((F.col("s") >= 2) & (F.col("t") >= 3)) | ((F.col("s") >= 1) & (F.col("t") >= 2))
    return told.groupBy(F.col("image_id").alias("doc_id")).agg(F.sum("s").cast("long").alias("separators"), F.sum("t").cast("long").alias("tokens"), F.count_if(many).alias("list_lines"))


def ordered_distinct_tokens(spark, sf_dir):
    """Distinct words of each document, first spelling first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = distinct_words(docs, "doc_id", "text", "[ \n]+", lambda w: F.lower(w))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return words.select("doc_id", F.size(items).cast("long").alias("n_words"), F.md5(F.array_join(items, " ")).alias("words_md5"))


def sentinel_coalesce(spark, sf_dir):
    """A value that is missing, blank or a sentinel becomes the sentinel; the first known role of a conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("value", F.when(F.col("turn") % 3 == 0, " N/A ").when(F.col("turn") % 3 == 1, F.col("role")).otherwise(F.lit(None)))
    each = turns.groupBy("conv_id").agg(merge.ordered("value", "turn").alias("v"))
    return each.select("conv_id", value_or_unknown(F.get("v", F.lit(0))).alias("first_value"), F.coalesce(first_known(F.col("v")), F.lit("-")).alias("first_role"), F.size(clean_list(F.col("v"))).cast("long").alias("n_known"))


def amount_mentions(spark, sf_dir):
    """Lines with an amount and a unit, by language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    x = Line(F.col("line"))
    return docs.groupBy("lang").agg(F.count_if(x.amount).alias("n_amounts"), F.count("*").alias("n_lines"))


def url_normalise(spark, sf_dir):
    """URLs without their scheme get one again; file names are made safe."""
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", with_scheme(bare).alias("url"), safe_file_name(bare).alias("file_name"), Line(F.col("url")).url.alias("is_url"))


def html_titles(spark, sf_dir):
    """Title and description of fetched pages."""
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"), html_description(F.col("html")).alias("description"))


def fetched_page_status(spark, sf_dir):
    """Pages by outcome."""
    return readers.fetched_pages(table(spark, sf_dir, "pages")).groupBy("success", "status_code").agg(F.count("*").alias("n"), F.countDistinct("page_title").alias("titles"))


def query_variants(spark, sf_dir):
    """Spellings under which a name is looked up."""
    name = F.concat_ws("/", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit(" ppm")))
    names = saved(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "names")
    told = lookup.of_distinct(names, "name", lambda texts: texts.withColumn("variants", F.array_join(verify.query_variants(F.col("text")), "|")), "variants")
    return told.select("p_partkey", "variants")


def quality_score(spark, sf_dir):
    """Quality of each document's text."""
    return scores_of(table(spark, sf_dir, "documents"))


def scores_of(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.col("text").alias("raw_text"), F.lit(0.9).alias("confidence"), F.size(F.split("text", " ")).alias("n_blocks"), F.size(F.split("text", "\n")).alias("n_lines"))
    return layout.quality_score(docs).select("doc_id", F.round("score", 6).alias("score"))


def penalty_score(spark, sf_dir):
    """P25: how unlike a list of names the lines of each language are."""
    return penalties_of(table(spark, sf_dir, "documents"))


def penalties_of(docs: DataFrame) -> DataFrame:
    docs = docs.select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return docs.groupBy("lang").agg(F.sum(Line(F.col("line")).penalty).cast("long").alias("penalty"), F.count("*").alias("n"))


def keyword_cut(spark, sf_dir):
    """Texts up to the earliest of some words."""
    cut = until_keyword(F.col("text"), CUT_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n_kept"), F.md5(cut).alias("kept_md5"))


def anti_fill_others(spark, sf_dir):
    """Lines that no section has, by document."""
    lines = saved(document_lines(spark, sf_dir), "lines")
    found = lines.where(separator_count(F.col("text")) >= 2).select("image_id", "line_index", F.lit("ingredients").alias("section"), F.lit("listed").alias("reason"), F.col("text").alias("section_text"))
    return sections.with_others(found, lines).groupBy(F.col("image_id").alias("doc_id"), "section").agg(F.count("*").alias("n"))


def line_islands(spark, sf_dir):
    """Stretches of lines with separators."""
    lines = document_lines(spark, sf_dir).withColumn("hit", separator_count(F.col("text")) > 0)
    found = sections.islands(lines, "hit", 1)
    return found.select(F.col("image_id").alias("doc_id"), F.col("island").cast("long").alias("island"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def gap_threshold(spark, sf_dir):
    """A5: the break threshold from sorted gaps, over the users' event times."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("x_min"))
    lines = e.select("image_id", (F.col("us") / 1e6).alias("center_y"), "x_min", F.lit(1.0).alias("height"))
    return layout.section_break(lines).select(F.col("image_id").alias("user_id"), F.round("threshold", 3).alias("threshold"))


def top_line_per_document(spark, sf_dir):
    """The line most like a name."""
    return top_lines(document_lines(spark, sf_dir))


def top_lines(lines: DataFrame) -> DataFrame:
    best = sections.guess_product_name(lines)
    return best.select(F.col("image_id").alias("doc_id"), F.col("line_index").cast("long").alias("line_index"), F.round("score", 6).alias("score"))


def merge_by_conversation(spark, sf_dir):
    """Turns of a conversation merged as the images of a request are."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("body"), F.split(F.col("text"), "\n").alias("lines"), (F.length("text") / 1000.0).alias("confidence"))
    told = merge.merge_images(turns, "conv_id", "turn", ("role",), ("lines",), ("body",), "confidence")
    return told.select("conv_id", "n_images", "role", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"), F.md5("body").alias("body_md5"), F.round("confidence", 6).alias("confidence"))


def match_rates(spark, sf_dir):
    """A2, A4: counts, rates and status by order; a line is verified if it was returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("matched"), F.col("l_linestatus").alias("verified_name"))
    return verify.summary(lines, "l_orderkey").select("l_orderkey", "total", "matched", "verified", "unverified", F.round("match_rate", 6).alias("match_rate"), "status")


def exact_matches(spark, sf_dir):
    """Names with other spacing and case find their catalogue item, the first of equal names."""
    part = table(spark, sf_dir, "part")
    catalogue = part.select(F.col("p_partkey").alias("item_pos"), F.col("p_name").alias("kor_name"), F.col("p_name").alias("eng_name"), F.lit(None).cast("string").alias("alias"))
    asked = part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("query"))
    return verify.best_matches(asked, catalogue).where("score = 1.0").select("query", "item_pos", "score")


def fuzzy_matches(spark, sf_dir):
    """Perturbed names against the catalogue."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    catalogue = part.select(F.col("p_partkey").alias("item_pos"), F.col("p_name").alias("kor_name"), F.lit(None).cast("string").alias("eng_name"), F.lit(None).cast("string").alias("alias"))
    names = part.select("p_partkey", F.array(F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substring(p_name, 5)"))).alias("names"))
    candidates = verify.expand_candidates(names, "p_partkey", "names")
    return verify.match_candidates(candidates, catalogue, "p_partkey").select("p_partkey", "pos", "name", "matched", "item_pos", "score")


def section_walk(spark, sf_dir):
    """Sections of all lines, by document."""
    return walked(document_lines(spark, sf_dir))


def walked(lines: DataFrame) -> DataFrame:
    found = sections.walk(lines)
    return found.groupBy(F.col("image_id").alias("doc_id"), "section").agg(F.count("*").alias("n"))


def sectioned_documents(spark, sf_dir):
    """The whole detector; texts by section."""
    return sectioned(document_lines(spark, sf_dir))


def sectioned(lines: DataFrame) -> DataFrame:
    texts = sections.section_texts(sections.detect_sections(lines))
    return texts.select(F.col("image_id").alias("doc_id"), "section", F.size("texts").cast("long").alias("n_texts"), F.md5("text").alias("text_md5"))


def synthetic_words(spark, sf_dir) -> DataFrame:
    """Word boxes made of order lines: an order is an image, quantity and discount tell a word's place."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_linenumber") * 60.0, (F.col("l_quantity") % 7) * 18.0 + F.col("l_discount") * 40
    box = F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (50, 0), (50, 14), (0, 14))))
    return l.select(F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_linenumber").cast("int").alias("ord"), box.alias("points"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.lit(1.0) - F.col("l_tax")).alias("confidence"))


def line_clusters(spark, sf_dir):
    """Words to lines."""
    lines = layout.lines_of_words(synthetic_words(spark, sf_dir))
    return lines.select("image_id", F.col("line_index").cast("long").alias("line_index"), "text", F.col("n_blocks"), F.round("center_y", 6).alias("center_y"))


def word_boxes(spark, sf_dir):
    """Words with their boxes."""
    return layout.blocks(synthetic_words(spark, sf_dir)).select("image_id", F.col("ord").cast("long").alias("ord"), "x_min", "x_max", F.round("y_min", 6).alias("y_min"), F.round("center_y", 6).alias("center_y"), "width", F.round("height", 6).alias("height"))


def box_overlaps(spark, sf_dir):
    """Overlap of the padded boxes of neighbouring lines of an order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    b = l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).cast("int").alias("x1"), (F.col("l_linenumber") * 10).cast("int").alias("y1"), (F.col("l_quantity") * 4 + 60).cast("int").alias("x2"), (F.col("l_linenumber") * 10 + 30).cast("int").alias("y2"), F.lit(240).alias("width"), F.lit(90).alias("height"))
    b = boxes.padded(boxes.limited(b)).select("l_orderkey", "l_linenumber", F.struct("x1", "y1", "x2", "y2").alias("box"))
    after = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("box").alias("next"))
    return b.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(boxes.iou("box", "next"), 6).alias("iou"))


def suppressed_boxes(spark, sf_dir):
    """Of overlapping boxes the surest stay."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    b = l.select(F.col("l_orderkey").alias("image_index"), F.col("l_returnflag").alias("section_type"), F.lit(0).alias("x1"), (F.col("l_linenumber") * 2).cast("int").alias("y1"), F.lit(100).alias("x2"), (F.col("l_linenumber") * 2 + 40).cast("int").alias("y2"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))
    return boxes.suppress(b).groupBy("image_index", "section_type").agg(F.count("*").alias("kept"), F.max("confidence").alias("best"))


def two_source_merge(spark, sf_dir):
    """Labels as the second source of each document's language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("product_name"), F.array("source", "lang").alias("usage"))
    second = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("good")).alias("product_name"), F.array(F.col("toxic").cast("string"), F.lit("N/A")).alias("usage"), (F.col("doc_id") % 10 / 10.0).alias("confidence_product_name"), (F.col("doc_id") % 4 / 4.0).alias("confidence_usage"))
    told = merge.merge_sources(docs, second, "doc_id", ("product_name",), ("usage",))
    return told.select("doc_id", "product_name", F.array_join("usage", ",").alias("usage"), F.array_join(F.transform("merge_log", lambda m: F.concat(m["field"], F.lit(": "), m["reason"])), "; ").alias("reasons"))


def override_merge(spark, sf_dir):
    """Labelled documents overridden, lists joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.array("source").alias("links"))
    extra = table(spark, sf_dir, "labels").select("doc_id", F.lit("xx").alias("lang"), F.array(F.lit("src0"), F.lit("new")).alias("links"), (F.col("quality") == 0).alias("success"))
    return merge.override(docs, extra, "doc_id", ("lang",), ("links",)).select("doc_id", "lang", F.array_join("links", ",").alias("links"))


def lenient_json(spark, sf_dir):
    """A number under one of several keys, whole or from an item list."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("answer: "), "props").alias("raw"))
    from ..functions.text import json_object

    return e.select("event_id", lenient(json_object(F.col("raw")), ("K", "key", "k")).alias("k"))


def catalogue_items(spark, sf_dir):
    """Items of catalogue answers in each of the shapes that they come in."""
    item = F.to_json(F.struct(F.col("p_name").alias("INGR_KOR_NAME"), F.col("p_brand").alias("engName")))
    shape = F.col("p_partkey") % 4
    body = F.when(shape == 0, F.concat(F.lit('{"body":{"items":['), item, F.lit("]}}"))).when(shape == 1, F.concat(F.lit('{"response":{"body":{"items":{"item":['), item, F.lit("]}}}}"))).when(shape == 2, F.concat(F.lit('{"items":{"item":'), item, F.lit("}}"))).otherwise(F.concat(F.lit('{"items":'), item, F.lit("}")))
    return readers.catalogue_items(table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))).select("p_partkey", F.col("item_pos").cast("long").alias("item_pos"), "kor_name", "eng_name")


def request_images(spark, sf_dir):
    """Requests with one URL, several, or none that is usable."""
    p = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("http://x/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PNG?s=1").otherwise(".bin"))
    body = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.col("page_id").alias("user_id"), url.alias("image_url")))).when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.col("page_id").cast("string").alias("user_id"), F.array(url, F.lit(" "), url).alias("image_url")))).otherwise(F.lit("{oops"))
    return readers.image_items(readers.requests(p.select(body.alias("body")))).select("user_id", F.col("image_index").cast("long").alias("image_index"), "url", "file_name", "media_type")


def inline_segments(spark, sf_dir):
    """Turns cut at the labels inside them."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(routing.inline_segments(F.col("text"), PROSE_LABELS)).alias("s"))
    return told.groupBy(F.coalesce("s.section", F.lit("none")).alias("section")).agg(F.count("*").alias("n"), F.sum(F.length("s.body")).cast("long").alias("n_chars"))


def payload_projection(spark, sf_dir):
    """The flat record of each order."""
    rates = match_rates(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    told = orders.join(rates, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return told.select(F.col("o_orderkey").cast("string").alias("user_id"), value_or_unknown(F.col("o_orderpriority")).alias("product_name"), F.coalesce("verified", F.lit(0)).alias("ingredient_verified_count"), F.coalesce("total", F.lit(0)).alias("ingredient_total_count"), F.coalesce("status", F.lit("no_candidates")).alias("ingredient_api_status"))


def matching_keys(spark, sf_dir):
    """Distinct matching keys of all lines of the documents, by language. Distinct lines come first, so few rows are shuffled."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line")).distinct()
    keys = lines.select("lang", compact(F.col("line")).alias("key"), "line").groupBy("lang", "key").agg(F.count("line").alias("n"))
    return keys.groupBy("lang").agg(F.count("key").alias("n_keys"), F.sum("n").cast("long").alias("n_lines"))


def line_keys(spark, sf_dir):
    """Distinct matching keys of all lines of the documents, with and without punctuation."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line")).distinct()
    kinds = {"n_keys": compact(F.col("line")), "n_spaceless": spaceless(F.col("line")), "n_lines": F.col("line")}
    each = lines.select("lang", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()))).alias("x"))
    keys = each.select("lang", "x.kind", "x.key").distinct()
    return keys.groupBy("lang").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def glyph_texts(spark, sf_dir):
    """Texts about parts with the glyphs of recognised text."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("▶ ★"), "p_name", F.lit(" ， Ⅲ → ("), size, F.lit(" ㎕ ) ；５％ • “"), "p_brand", F.lit("” ＆ Ⅳ／２㎍\t☆"))
    return table(spark, sf_dir, "part").select("p_partkey", clean_recognised(text).alias("text"))


def distinct_variants(spark, sf_dir):
    """The first line of each order, return flag and status."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.nullif("l_returnflag", F.lit("N")).alias("variant"), F.col("l_linestatus").alias("path"))  # noqa: E741
    return layout.distinct_variants(l, "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey"))


def list_texts(spark, sf_dir):
    """Documents made ready to be split into names."""
    return made_lists(table(spark, sf_dir, "documents"))


def made_lists(docs: DataFrame) -> DataFrame:
    told = phrases.list_text(docs.select("doc_id", "text"), "text")
    return told.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def ingredient_names(spark, sf_dir):
    """Names in each document's text."""
    told = extraction.ingredient_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return told.select("doc_id", F.size("items").cast("long").alias("n_names"), F.md5(F.array_join("items", "|")).alias("names_md5"))


def amount_texts(spark, sf_dir):
    """Amounts in texts about parts."""
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Net wt "), size, F.lit(" g"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Capacity: "), size, F.lit(" x 3 ㎖"))).otherwise(F.concat(F.lit("LOT "), size, F.lit(" ml")))
    return extraction.amounts(table(spark, sf_dir, "part").select("p_partkey", text.alias("amount")), "amount")


def mended_links(spark, sf_dir):
    """Links in texts that break them."""
    text = F.concat(F.lit("see http : //"), F.regexp_replace("url", "^https?://", ""), F.lit(" , and www . site"), F.col("page_id").cast("string"), F.lit(" . com/x."))
    links = extraction.link_candidates(text)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.get(links, F.lit(0)).alias("first_link"))


def line_results(spark, sf_dir) -> DataFrame:
    """Order lines as results of a verification: a line matches if it was returned, its status is the name that was found."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), (F.col("l_returnflag") == "R").alias("matched"), F.concat(F.lit("Name "), "l_linestatus", (F.col("l_partkey") % 2).cast("string")).alias("matched_name_kr"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("ocr_name"))


def match_records(spark, sf_dir):
    """Results of each order's lines as one record."""
    told = records.match_records(line_results(spark, sf_dir), "l_orderkey")
    return told.select("l_orderkey", "total_count", "success_count", "failed_count", "normalized_count", "status", F.array_join("verified_ingredient_names", ",").alias("names"), F.array_join(F.transform("unverified_ingredients", lambda x: x["ocr_name"]), ",").alias("unverified"))


def final_of_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    merged = orders.select(
        F.col("o_orderkey").alias("user_id"), F.col("o_orderpriority").alias("product_name"), F.lit(None).cast("string").alias("capacity"), F.array("o_orderstatus", "o_orderpriority", F.lower("o_orderstatus")).alias("ingredients_raw"),
        F.array(F.lit("N/A")).alias("usage"), F.array("o_orderpriority").alias("cautions"), none.alias("effects"), none.alias("qr_codes"), none.alias("urls"), F.lit("raw").alias("raw_text"), (F.col("o_custkey") % 7 / 7.0).alias("confidence"),
    )
    validation = records.validations(records.match_records(line_results(spark, sf_dir), "l_orderkey"), "l_orderkey").withColumnRenamed("l_orderkey", "user_id")
    images = orders.select(F.col("o_orderkey").alias("user_id"), F.lit(0).alias("no"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("www.x.com/"), F.col("o_orderkey").cast("string")), F.lit("code"))).alias("codes"))
    return records.final_records(merged, validation, records.link_union(images, "user_id", "no", ("codes",)), "user_id", F.lit("2024-01-01 00:00:00"))


def flat_payloads(spark, sf_dir):
    """The flat record of each order, all 18 fields."""
    told = records.flat_payload(final_of_orders(spark, sf_dir))
    lists = ("ingredients", "usage", "cautions", "effects", "ingredients_raw", "qr_codes", "qr_urls")
    told = told.withColumn("unverified_ingredients", F.transform("unverified_ingredients", lambda x: x["ocr_name"]))
    return told.select(*(F.array_join(c, ",").alias(c) if c in (*lists, "unverified_ingredients") else F.col(c) for c in told.columns))


def stored_payloads(spark, sf_dir):
    """The nested record of each order, as JSON without its lists of structs."""
    told = records.nested_payload(final_of_orders(spark, sf_dir), "user_id")
    p = F.col("payload")
    return told.select("user_id", p["result"]["product_name"].alias("product_name"), F.array_join(p["result"]["qr_info"]["qr_codes"], ",").alias("qr_codes"), p["ingredient_api_validation"]["status"].alias("status"), p["ingredient_api_validation"]["total_checked_count"].alias("total"), F.get_json_object(F.to_json(p), "$.result.capacity").alias("capacity"))


def raw_section_texts(spark, sf_dir):
    """Sections of the documents' raw texts by the walk for raw text."""
    lines = raw_sections.raw_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return raw_sections.raw_sections(lines, "doc_id").select("doc_id", "section", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def raw_lists(spark, sf_dir):
    """The list of names that each document's raw text holds."""
    lines = raw_sections.raw_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return raw_sections.list_in_raw_text(lines, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def extracted_fields(spark, sf_dir):
    """All fields of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = records.extract_fields(docs, "doc_id", "text")
    return told.select("doc_id", "product_name", "capacity", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("ingredients_raw", "usage", "cautions", "effects", "qr_codes", "urls")))


def page_texts(spark, sf_dir):
    """Lines of an order from the top, with a blank line where the gap is wide."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.select(F.col("l_orderkey").alias("image_id"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).cast("double").alias("center_y"), F.col("l_linenumber").cast("double").alias("x_min"), F.lit(12.0).alias("height"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    told = layout.page_text(lines)
    return told.select(F.col("image_id").alias("l_orderkey"), F.md5("raw_text").alias("raw_md5"), F.replace("layout_text", F.lit("\n"), F.lit("|")).alias("layout_text"))


def projected_answers(spark, sf_dir):
    """Answers of a model in eight shapes, spoilt ones among them, onto the fixed struct."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    k = F.col("k")
    shapes = (
        F.concat(F.lit('```json\n{"product_name": " P'), k, F.lit('", "ingredients": ["a'), k, F.lit('", " b ", "a'), k, F.lit('", "N/A"], "confidence": 0.5}\n```')),
        F.concat(F.lit('Here: {"product_name": ["", "P'), k, F.lit('"], "ingredients": null, "confidence": "0.25",} Thanks.')),
        F.concat(F.lit('{"product_name": {"ko": "P'), k, F.lit('"}, "ingredients": ["a"], "confidence": 1}')),
        F.concat(F.lit('{"product_name": "none", "ingredients": "i'), k, F.lit('"}')),
        F.concat(F.lit('{"ingredients": ["a", {"name": "b'), k, F.lit('"}, 7], "confidence": "high"}')),
        F.concat(F.lit('{“product_name”: “P'), k, F.lit('”, "ingredients": [],}')),
        F.lit("Sorry, I can not read that."),
        F.lit(" "),
    )
    raw = F.element_at(F.array(*shapes), (F.col("event_id") % 8 + 1).cast("int"))
    told = e.select("event_id", raw.alias("raw")).select("event_id", projection.answers(F.col("raw"), {"product_name": "text", "ingredients": "list", "confidence": "number"}).alias("a"))
    misfits = F.array_join(F.transform("a.misfits", lambda m: F.concat(m["field"], F.lit(" "), m["expected"], F.lit(" "), m["found"])), "; ")
    return told.select("event_id", "a.success", "a.product_name", F.array_join("a.ingredients", "|").alias("ingredients"), "a.confidence", misfits.alias("misfits"), "a.error")


#: Latin letters and the syllables that stand for them, to have Hangul in pages.
LATIN, SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def repaired_pages(spark, sf_dir):
    """Pages of Hangul in two charsets, of which none is told."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.translate(F.lower("html"), LATIN, SYLLABLES), "[^가-힣 -~]", "").alias("html"))

    encoded = F.udf(lambda i, t: None if t is None else t.encode("euc-kr" if i % 2 else "utf-8"), "binary", useArrow=False)
    pages = saved(p.select("page_id", encoded("page_id", "html").alias("content")), "encoded")
    told = charsets.with_decoded(pages)
    return told.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "charset")


def stage_metrics(spark, sf_dir):
    """Rows and errors of each stage of a flow from requests to pages, as they were stored."""
    p = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("http://x/"), F.col("page_id").cast("string"))
    body = F.when(F.col("page_id") % 5 == 0, F.lit("{oops")).when(F.col("page_id") % 5 == 1, F.lit('{"user_id": 1, "image_url": " "}')).otherwise(F.to_json(F.struct(F.col("page_id").alias("user_id"), F.array(url, url, F.concat(url, F.lit("/b"))).alias("image_url"))))
    flow = stages.Stages(spark)
    requests = flow.run("requests", readers.requests(p.select(body.alias("body"))), "error")
    flow.run("images", readers.image_items(requests.where("error is null")))
    html = F.when(F.col("page_id") % 7 > 0, F.col("html"))
    flow.run("pages", readers.fetched_pages(p.select("url", html.alias("html"))), "error")
    return flow.metrics().select("position", "stage", "n_rows", "n_errors", F.col("failure").isNull().alias("done"))


def cached_lookups(spark, sf_dir):
    """Names asked in two runs and a third that asks nothing; each answer tells the run that asked for it."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    known = cache.LookupCache(spark, work_path(spark, "cache"), "name", "length int, first string")
    ask = lambda keys: keys.select("name", F.length("name").alias("length"), F.substring("name", 1, 1).alias("first"))
    known.look_up(names.where("p_partkey % 50 = 0"), ask)
    known.look_up(names, ask)
    known.compact()
    found, asked = known.look_up(names, ask)
    return found.select("name", "length", "first", F.col("version").alias("asked_in"), F.lit(asked).alias("asked_last"))


def request_sessions(spark, sf_dir):
    """Events as images of requests, streamed; a request closes when its images came or its time ran out."""
    e = table(spark, sf_dir, "events")
    index = F.get_json_object("props", "$.k").cast("int") % 6
    images = e.select(F.col("user_id").cast("string").alias("request_id"), index.alias("image_index"), (F.col("user_id") % 3 + 2).cast("int").alias("n_images"), F.col("ts").cast("timestamp").alias("at"))
    inbox, outbox, checkpoint = (work_path(spark, x) for x in ("inbox", "outbox", "stream"))
    images.write.parquet(inbox)
    told = streamed.run_sessions(spark, inbox, outbox, checkpoint, "request_id string, image_index int, n_images int, at timestamp", "2 days", "1 hour")
    return told.select("request_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), F.col("n_images").cast("long").alias("n_images"), F.col("received").cast("long").alias("received"), "outcome")


def labels(spark, sf_dir) -> DataFrame:
    """Parts are small and their labels are not: dealt anew into a fixed number of parts, which are not joined again, so that a
    table of one file is worked on by many tasks."""
    return label_documents(table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"))


def label_line_counts(spark, sf_dir):
    """P2, P3, P26, N9, N13 over label texts: every label and both kinds of noise."""
    return counts_by_label(labels(spark, sf_dir))


def label_walk(spark, sf_dir):
    """W4, W8, P4 to P24 over label texts: every section."""
    return walked(lines_of(labels(spark, sf_dir)))


def label_sections(spark, sf_dir):
    """O6, T1 to T4, J5, A3 over label texts."""
    return sectioned(lines_of(labels(spark, sf_dir)))


def label_top_lines(spark, sf_dir):
    """T1, P23 over label texts."""
    return top_lines(lines_of(labels(spark, sf_dir)))


def label_penalties(spark, sf_dir):
    """P25 over label texts."""
    return penalties_of(labels(spark, sf_dir))


def label_scores(spark, sf_dir):
    """A6, P33 over label texts."""
    return scores_of(labels(spark, sf_dir))


def label_lists(spark, sf_dir):
    """N12, N22, N27, N28, N30 to N34 over label texts: names that run together, numbers of names, stop words."""
    return made_lists(labels(spark, sf_dir))


def located_sections(spark, sf_dir):
    """Sections of an order's images under other names, some of no kind, image or size."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    name = F.element_at(F.array(*(F.lit(x) for x in ("Product", "how-to-use", "사용 시 주의사항", "qr 코드", "nonsense", "ALL_INGREDIENTS", " 내용량 "))), (F.col("l_partkey") % 7 + 1).cast("int"))
    label = F.when(F.col("l_suppkey") % 3 == 0, F.lit("warnings")).when(F.col("l_suppkey") % 3 == 1, F.lit(" "))
    x = F.col("l_quantity").cast("int")
    found = l.select("l_orderkey", F.col("l_linenumber").alias("image_index"), name.alias("section_type"), label.alias("label"), (x * 4).alias("x1"), F.lit(10).alias("y1"), (x * 4 - 60).alias("x2"), F.lit(50).alias("y2"), (F.col("l_tax") * 20).cast("string").alias("confidence"))
    images = l.where("l_linenumber <= 4").select("l_orderkey", F.col("l_linenumber").alias("image_index"), F.lit(120).alias("width"), F.lit(40).alias("height")).distinct()
    told = boxes.located(found, images, ("l_orderkey", "image_index"))
    return told.select("l_orderkey", "image_index", "section_type", "label", "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"))


def flow_of_orders(spark, sf_dir) -> flow.Outcome:
    """Orders as requests of up to four images; lines as what was read from them, some of it not to be read; parts as catalogue."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    urls = F.slice(F.array(*(F.lit(f"http://x/{i}.jpg") for i in range(4))), F.lit(1), (F.col("o_custkey") % 5).cast("int"))
    asked = readers.requests(orders.select(F.to_json(F.struct(F.col("o_orderkey").alias("user_id"), urls.alias("image_url"))).alias("body")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    fields = lines.select(
        F.col("l_orderkey").cast("string").alias("user_id"), (F.col("l_linenumber") - 1).alias("image_index"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 6 == 0, "unreadable").alias("error"), F.lit("").alias("raw_text"),
        (F.col("p_size") / 50.0).alias("confidence"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("product_name"), text.alias("capacity"),
        F.array(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Qzxwv Jkq"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))).alias("ingredients_raw"), F.array("p_type").alias("usage"), none.alias("cautions"), none.alias("effects"),
        F.array(F.concat(F.lit('"www.x.com/'), F.col("p_partkey").cast("string"), F.lit('." ')), F.lit("12345"), F.lit("02-123-4567")).alias("qr_codes"), none.alias("urls"),
    )
    catalogue = part.select(F.col("p_partkey").alias("item_pos"), F.col("p_name").alias("kor_name"), *(text.alias(c) for c in ("eng_name", "alias", "cas_no", "definition")))
    answers = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("user_id"), F.lit(True).alias("success"), F.lit("answered").alias("product_name"), F.lit("10 ml").alias("capacity"), F.array(F.lit("use")).alias("usage"), none.alias("cautions"), none.alias("effects"))
    return flow.analyse(asked, fields, catalogue, answers)


def request_flow(spark, sf_dir):
    """Every order's way through the flow: its record's figures, or the stage and error that ended it."""
    done = flow_of_orders(spark, sf_dir)
    p = F.col("result.processing_summary")
    told = done.records.select(
        "user_id", "result.product_name", "result.capacity", F.array_join("result.usage", ",").alias("usage"), p["input_image_count"].alias("n_images"), p["successful_image_analysis_count"].alias("n_analysed"), p["ingredient_raw_count"].alias("n_names"),
        p["ingredient_verified_count"].alias("n_verified"), F.round("accuracy.ingredient_match_rate", 6).alias("match_rate"), F.round("accuracy.ocr_confidence", 6).alias("confidence"), F.col("result.ingredient_api_validation.status").alias("status"),
        F.array_join("result.qr_info.urls", ",").alias("urls"),
    )
    return told.join(done.failures, "user_id", "full").withColumn("user_id", F.col("user_id").cast("long"))


def split_names(spark, sf_dir):
    """Lists of parts with odd marks, and names with labels in front."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.concat(F.lit("전성분："), "p_name", F.lit("，\t"), "p_brand", F.lit(" ㆍ 5㎖\r\n 2ｇ ; x–y  z\r"), "p_type").alias("l"), F.concat(F.lit(" (성분 : Ingredients - "), "p_name", F.lit("  2 ]，"), "p_type", F.lit("。)/")).alias("n"))
    return rows.select("p_partkey", splittable(F.col("l")).alias("list"), plain_name(F.col("n")).alias("name"))


def variant_places(spark, sf_dir):
    """The lines of each order as variants of an image, the best first."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = l.select("l_orderkey", order.alias("ord"), F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("path"), F.when(F.col("l_quantity") > 5, F.floor(F.col("l_quantity") / 10) / 10).alias("score"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("n_blocks"), F.lit(None).cast("int").alias("n_lines"), F.repeat(F.lit("x"), F.col("l_linenumber")).alias("raw_text"))
    told = layout.variant_summaries(rows, "l_orderkey")
    return told.select("l_orderkey", F.col("place").cast("long").alias("place"), "variant", "path", F.col("score").cast("double").alias("score"), F.col("n_blocks").cast("long").alias("n_blocks"), F.col("n_lines").cast("long").alias("n_lines"), F.col("text_length").cast("long").alias("text_length"))
