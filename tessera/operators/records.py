"""Records: fields of each image, merged requests, match results, and the nested and flat output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_list, safe_list, value_or_unknown
from ..functions.text import bound, with_scheme
from ..rules import RAW, UNKNOWN, RuleSet
from ..storage import saved
from . import extraction, raw_sections

FIELDS = raw_sections.NAMES
STRINGS = "array<string>"
VERIFIED = ("ocr_name", "query_name", "matched_name_kr", "matched_name_en", "cas_no", "definition", "similarity", "source")
UNVERIFIED = ("ocr_name", "query_name", "reason", "similarity")


def listed(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.array().cast(STRINGS))


def extract_fields(docs: DataFrame, by: str, raw: str = "raw_text", detected: DataFrame | None = None, rules: RuleSet = RAW) -> DataFrame:
    """One row per document: product_name, capacity, ingredients_raw, usage, cautions, effects, qr_codes, urls, and the texts they come from.

    detected: (by, section, text) of detected sections; a section that has no text there takes that of the walk over the raw
    text. Without names in the ingredients the list in the raw text is taken. What is not found is told as UNKNOWN, names as an empty list.
    docs has one row per `by`; a null or empty text gives a row with nothing in it.
    """
    lines = raw_sections.raw_lines(docs, by, raw, rules)
    fallback = raw_sections.raw_sections(lines, by, rules).withColumn("_rank", F.lit(1))
    every = fallback if detected is None else fallback.unionByName(detected.select(by, "section", "text").withColumn("_rank", F.lit(0)))
    texts = every.where("text <> ''").groupBy(by, "section").agg(F.min_by("text", "_rank").alias("text"))
    wide = saved(texts.groupBy(by).pivot("section", list(FIELDS)).agg(F.first("text")), "section-texts")
    listed_names = extraction.ingredient_candidates(wide, by, "ingredients", rules=rules)
    guessed = extraction.ingredient_candidates(raw_sections.list_in_raw_text(lines, by, rules).join(listed_names, by, "left_anti"), by, "text", rules=rules)
    parts = [
        extraction.product_names(wide, by, "product_name", rules), extraction.amounts(wide.select(by, F.col("capacity").alias("amount")), "amount", rules).select(by, "amount"),
        listed_names.unionByName(guessed).withColumnRenamed("items", "ingredients_raw"),
        *(extraction.section_sentences(wide, by, s, s, rules).withColumnRenamed("items", f"_{s}") for s in ("usage", "cautions", "effects")),
        wide.select(by, F.struct(*FIELDS).alias("raw_section_text")),
    ]
    out = reduce(lambda a, b: a.join(b, by, "left"), parts, docs.select(by, F.coalesce(raw, F.lit("")).alias("raw_text")))
    codes = clean_list(F.concat(extraction.link_candidates(F.col("raw_section_text.qr_url")), extraction.link_candidates(F.col("raw_text"))))
    out = out.withColumn("qr_codes", codes)
    return out.select(
        by, value_or_unknown(F.col("name")).alias("product_name"), value_or_unknown(F.col("amount")).alias("capacity"), listed("ingredients_raw").alias("ingredients_raw"),
        *(safe_list(F.col(f"_{s}")).alias(s) for s in ("usage", "cautions", "effects")), safe_list(F.col("qr_codes")).alias("qr_codes"),
        safe_list(F.filter("qr_codes", lambda x: x.rlike(rules.url))).alias("urls"), "raw_text", "raw_section_text",
    )


def image_outcomes(images: DataFrame, analysed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """images with success and error: an image whose analysis has a row succeeded, the others are told and do not fail the job."""
    done = analysed.select(*by, F.lit(True).alias("_done")).distinct()
    told = images.join(done, list(by), "left").withColumn("success", F.coalesce("_done", F.lit(False)))
    known = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    return told.withColumn("error", F.when(~F.col("success"), F.coalesce(known, F.lit("no result")))).drop("_done")


def link_record(qr_codes: Column, candidates: Column) -> Column:
    """struct<detected, url, urls, raw_values, status> of decoded values and of links found in texts."""
    return bound(clean_list(qr_codes), lambda codes: _clean_link_record(codes, clean_list(candidates)))


def _clean_link_record(codes: Column, candidates: Column) -> Column:
    """link_record of lists as clean_list makes them."""
    links = clean_list(F.transform(F.filter(F.array_distinct(F.concat(candidates, codes)), lambda x: x.rlike(RAW.url)), with_scheme))

    def told(codes: Column, urls: Column) -> Column:
        some = (F.size(codes) > 0) | (F.size(urls) > 0)
        return F.struct(
            some.alias("detected"), F.coalesce(F.get(urls, F.lit(0)), F.lit(UNKNOWN)).alias("url"), urls.alias("urls"), clean_list(F.concat(codes, urls)).alias("raw_values"),
            F.when(some, "detected").otherwise("not_detected").alias("status"),
        )

    return bound(links, lambda urls: told(codes, urls))


def link_union(images: DataFrame, by: str, order: str, lists: tuple[str, ...], text: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(by, qr_codes, url_candidates, record[, page_title, meta_description]) of all images of a request: values once each, in the order of images and lists.

    pages: (url, page_title, meta_description) of fetched pages; the first known title and description of the request's links are taken.
    """
    links = [extraction.link_candidates(F.col(text))] if text else []
    each = images.select(by, F.col(order).alias("no"), F.posexplode(F.concat(*(listed(c) for c in (*lists, *links)))).alias("pos", "text"))
    codes = extraction.first_of_equals(each, by, ("no", "pos")).select(by, clean_list("items").alias("qr_codes"))
    told = images.select(by).distinct().join(codes, by, "left").withColumn("qr_codes", listed("qr_codes"))
    told = told.withColumn("url_candidates", F.filter("qr_codes", lambda x: x.rlike(RAW.url))).withColumn("record", _clean_link_record(F.col("qr_codes"), F.col("url_candidates")))
    if pages is None:
        return told
    asked = told.select(by, F.posexplode("record.urls").alias("pos", "url")).join(pages.select("url", "page_title", "meta_description"), "url")
    firsts = asked.groupBy(by).agg(*(F.min_by(c, F.when(F.col(c) != "", F.col("pos"))).alias(c) for c in ("page_title", "meta_description")))
    return told.join(firsts, by, "left")


def candidate_records(rows: DataFrame, by: str, names: str) -> DataFrame:
    """(by, saved_at, candidate_count, ingredient_candidates)."""
    cleaned = rows.select(by, clean_list(F.col(names)).alias("ingredient_candidates"))
    return cleaned.select(by, now().alias("saved_at"), F.size("ingredient_candidates").cast("long").alias("candidate_count"), "ingredient_candidates")


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def matched_names(results: DataFrame, by: str, order: str) -> DataFrame:
    """(by, items): the names that were matched, once each without regard to case and spaces, in order."""
    rows = results.where("matched").select(by, order, F.trim("matched_name_kr").alias("text"))
    return extraction.first_of_equals(rows, by, (order,))


def match_records(results: DataFrame, by: str, order: str = "pos", status: str | None = None) -> DataFrame:
    """One row per request: counts, names, and the verified and unverified results as lists of structs in order.

    The lists of a request lie in one row, as its record does; counts and names are summed up before.
    """
    have = set(results.columns)
    item = lambda names: F.struct(F.col(order).alias("_o"), *(F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names))
    ordered = lambda ok, names: F.transform(
        F.sort_array(F.collect_list(F.when(ok, item(names)))), lambda x: F.struct(*(x[n].alias(n) for n in names))
    )
    told = results.groupBy(by).agg(
        F.count("*").alias("total_count"), F.count_if("matched").alias("success_count"), F.count_if(~F.col("matched")).alias("failed_count"),
        ordered(F.col("matched"), VERIFIED).alias("verified_ingredients"), ordered(~F.col("matched"), UNVERIFIED).alias("unverified_ingredients"),
    )
    named = told.join(matched_names(results, by, order), by, "left").withColumn("verified_ingredient_names", clean_list(listed("items"))).drop("items")
    kind = F.lit(status) if status else F.when(F.col("success_count") == F.col("total_count"), "success").when(F.col("success_count") > 0, "partial_success").otherwise("all_failed")
    return named.withColumns({"normalized_count": F.size("verified_ingredient_names").cast("long"), "status": kind, "saved_at": now()})


def empty_validation(kind: str = "not_run", error: str | None = None) -> dict[str, Column]:
    """What a request without a verification shows: no names, counts of 0, and why."""
    none = lambda names: F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    return {
        "status": F.lit(kind), "verified_ingredient_names": F.array().cast(STRINGS), "verified_ingredients": none(VERIFIED), "unverified_ingredients": none(UNVERIFIED), "verified_count": F.lit(0).cast("long"),
        "unverified_count": F.lit(0).cast("long"), "total_checked_count": F.lit(0).cast("long"), "error": F.lit(error).cast("string"),
    }


def validation_type() -> str:
    """The type of the block that validations makes, as DDL."""
    items = lambda names: "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    return (
        f"struct<status:string,verified_ingredient_names:{STRINGS},verified_ingredients:{items(VERIFIED)},unverified_ingredients:{items(UNVERIFIED)},"
        "verified_count:bigint,unverified_count:bigint,total_checked_count:bigint,error:string>"
    )


def validations(records: DataFrame, by: str) -> DataFrame:
    """(by, validation) of match_records: the block of a final record; verified_count counts distinct names."""
    return records.select(
        by,
        F.struct(
            "status", "verified_ingredient_names", "verified_ingredients", "unverified_ingredients", F.col("normalized_count").alias("verified_count"),
            F.col("failed_count").alias("unverified_count"), F.col("total_count").alias("total_checked_count"), F.lit(None).cast("string").alias("error"),
        ).alias("validation"),
    )


def final_records(merged: DataFrame, validation: DataFrame, links: DataFrame, by: str, analysed_at: Column | None = None) -> DataFrame:
    """(by, accuracy, success, analyzed_at, result): everything known about a request in one nested record.

    merged has a row per request with the extracted fields and, where known, layout_text, confidence, images (array of
    struct<image_path, success, error>) and n_lines, n_blocks, n_sections. A request without a verification is told as not_run.
    """
    have = set(merged.columns)
    get = lambda name, kind, default: F.coalesce(F.col(name), default).alias(name) if name in have else default.cast(kind).alias(name)
    images = "array<struct<image_path:string,success:boolean,error:string>>"
    m = merged.withColumns({
        "images": get("images", images, F.array().cast(images)), "confidence": get("confidence", "double", F.lit(0.0)), "layout_text": get("layout_text", "string", F.lit("")),
        **{c: get(c, "long", F.lit(0).cast("long")) for c in ("n_lines", "n_blocks", "n_sections")},
    })
    if "raw_section_text" not in have:
        m = m.withColumn("raw_section_text", F.struct(*(F.lit(None).cast("string").alias(c) for c in FIELDS)))
    m = m.join(validation.select(by, "validation"), by, "left").join(links.select(by, F.col("qr_codes").alias("_codes"), F.col("url_candidates").alias("_links"), F.col("record").alias("_record")), by, "left")
    none = empty_validation()
    kinds = {f.name: f.dataType for f in m.schema["validation"].dataType.fields}
    known = [F.coalesce(F.col(f"validation.{n}"), F.array().cast(kinds[n]) if kinds[n].typeName() == "array" else c).alias(n) for n, c in none.items()]
    m = m.withColumn("v", F.struct(*known))
    # Stored, as the record of a request is read more than once from here on.
    m = saved(m.withColumns({
        "_names": clean_list(F.col("v.verified_ingredient_names")), "_raw": clean_list(F.col("ingredients_raw")), "_codes": safe_list(F.concat(listed("qr_codes"), listed("_codes"), listed("_links"))),
        "_urls": safe_list(F.concat(listed("urls"), listed(F.col("_record.urls")))), **{c: safe_list(F.col(c)) for c in ("usage", "cautions", "effects")},
        **{c: value_or_unknown(F.col(c)) for c in ("product_name", "capacity")},
    }).drop("validation", "_links", "_record"), "requests")
    names, raw = F.col("_names"), F.col("_raw")
    total, verified = F.col("v.total_checked_count"), F.col("v.verified_count")
    accuracy = F.struct(
        F.col("confidence").alias("ocr_confidence"), F.coalesce(verified / F.nullif(total, F.lit(0)) * 100, F.lit(0.0)).alias("ingredient_match_rate"),
        verified.alias("ingredient_verified_count"), total.alias("ingredient_total_count"),
    )
    result = F.struct(
        "product_name", "capacity", raw.alias("ingredients_raw"), names.alias("ingredients_verified"),
        "usage", "cautions", "effects", F.struct(F.col("_codes").alias("qr_codes"), F.col("_urls").alias("urls")).alias("qr_info"),
        F.struct("raw_text", "layout_text", "raw_section_text", F.transform("images", lambda i: i["image_path"]).alias("input_image_paths")).alias("ocr_meta"), F.col("v").alias("ingredient_api_validation"),
        F.struct(
            F.size("images").cast("long").alias("input_image_count"), F.size(F.filter("images", lambda i: i["success"])).cast("long").alias("successful_image_analysis_count"), F.col("n_lines").alias("ocr_line_count"),
            F.col("n_blocks").alias("ocr_block_count"), F.col("n_sections").alias("detected_section_count"), F.size(raw).cast("long").alias("ingredient_raw_count"), verified.alias("ingredient_verified_count"), F.col("v.unverified_count").alias("ingredient_unverified_count"),
        ).alias("processing_summary"),
        F.struct(F.col("images").alias("image_analysis_success")).alias("debug_info"),
    )
    return m.select(by, accuracy.alias("accuracy"), F.lit(True).alias("success"), (analysed_at if analysed_at is not None else now()).alias("analyzed_at"), result.alias("result"))


def flat_payload(final: DataFrame, by: str = "user_id", image_url: Column | None = None) -> DataFrame:
    """The flat record that is sent on, 18 fields and, if given, image_url. Rates are rounded here and nowhere before."""
    r = lambda name: F.col(f"result.{name}")
    known = lambda c: F.filter(c, lambda x: x != UNKNOWN)
    told = final.select(
        F.col(by).alias("user_id"), F.coalesce(r("product_name"), F.lit("")).alias("product_name"), F.coalesce(r("capacity"), F.lit("")).alias("capacity"), known(r("ingredients_verified")).alias("ingredients"),
        F.coalesce(r("ocr_meta.raw_text"), F.lit("")).alias("raw_text"), *(known(r(c)).alias(c) for c in ("usage", "cautions", "effects")),
        F.round(F.coalesce("accuracy.ocr_confidence", F.lit(0.0)), 4).alias("ocr_confidence"), F.coalesce("analyzed_at", F.lit("")).alias("analyzed_at"),
        F.round(F.coalesce("accuracy.ingredient_match_rate", F.lit(0.0)), 2).alias("ingredient_match_rate"), F.coalesce("accuracy.ingredient_verified_count", F.lit(0)).cast("long").alias("ingredient_verified_count"),
        F.coalesce("accuracy.ingredient_total_count", F.lit(0)).cast("long").alias("ingredient_total_count"), known(r("ingredients_raw")).alias("ingredients_raw"),
        r("ingredient_api_validation.unverified_ingredients").alias("unverified_ingredients"), F.coalesce(r("ingredient_api_validation.status"), F.lit("unknown")).alias("ingredient_api_status"),
        known(r("qr_info.qr_codes")).alias("qr_codes"), known(r("qr_info.urls")).alias("qr_urls"), *([image_url.alias("image_url")] if image_url is not None else []),
    )
    return told


def nested_payload(final: DataFrame, by: str, include_debug: bool = False) -> DataFrame:
    """(by, payload): the nested record that is stored, without the texts it was made from unless include_debug asks for them."""
    r = lambda name: F.col(f"result.{name}").alias(name)
    v = F.col("result.ingredient_api_validation")
    block = F.struct(
        *(v[c].alias(c) for c in ("status", "verified_count", "unverified_count", "total_checked_count", "verified_ingredient_names", "unverified_ingredients"))
    )
    debug = [F.struct(r("ocr_meta"), r("processing_summary"), r("debug_info")).alias("debug")] if include_debug else []
    names = ("product_name", "capacity", "ingredients_raw", "ingredients_verified", "usage", "cautions", "effects", "qr_info")
    return final.select(by, F.struct("accuracy", "success", "analyzed_at", F.struct(*map(r, names)).alias("result"), block.alias("ingredient_api_validation"), *debug).alias("payload"))
