"""The flow of a request from its images to its record; what fails is told by request and stage, and fails nothing else."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import decoded_values
from ..rules import LABELS, RuleSet
from ..sources import readers
from . import merge, records, verify
from .stages import Stages

TEXTS, LISTS = ("product_name", "capacity"), ("ingredients_raw", "usage", "cautions", "effects", "qr_codes", "urls")
#: What answers replace where they succeeded.
ANSWERED = (*TEXTS, "usage", "cautions", "effects")


@dataclass
class Outcome:
    """records: as final_records tells them; failures (user_id, stage, error): the requests that have none; stages: counts and times."""

    records: DataFrame
    failures: DataFrame
    stages: Stages


def verified_names(merged: DataFrame, catalogue: DataFrame, by: str = "user_id", rules: RuleSet = LABELS) -> DataFrame:
    """Results of each name in ingredients_raw, in order, as match_records takes them.

    catalogue: (item_pos, kor_name, eng_name, alias, cas_no, definition), each item_pos once.
    """
    told = verify.match_candidates(verify.expand_candidates(merged, by, "ingredients_raw", rules), catalogue, by, rules)
    items = catalogue.select("item_pos", F.col("kor_name").alias("matched_name_kr"), F.col("eng_name").alias("matched_name_en"), "cas_no", "definition")
    named = told.join(items, "item_pos", "left")
    return named.select(
        by, "pos", "matched", F.col("name").alias("ocr_name"), F.col("query").alias("query_name"), "matched_name_kr", "matched_name_en", "cas_no", "definition",
        F.col("score").alias("similarity"), F.when(F.col("matched"), "catalogue").alias("source"), F.when(~F.col("matched"), "below the threshold").alias("reason"),
    )


def analyse(requests: DataFrame, fields: DataFrame, catalogue: DataFrame | None = None, answers: DataFrame | None = None, pages: DataFrame | None = None, rules: RuleSet = LABELS) -> Outcome:
    """Requests (user_id, image_urls, error), a row for each, through merge, answers, links and verification to records.

    fields: (user_id, image_index, error, raw_text, confidence, ...) with the columns of extract_fields, a row for each analysed image; an
    error makes the image a failed one, as a missing row does. Images are numbered from 0 in the order of a request's distinct URLs.
    A request with an error, or without any analysed image, fails; all others have a record. Without a catalogue names are not
    verified (status not_run); without answers (user_id, success, and ANSWERED) the merged fields stay. Empty tables give empty results.
    """
    flow, by = Stages(requests.sparkSession), "user_id"
    asked = flow.run("requests", requests.select(by, "image_urls", "error"), "error")
    items = readers.image_items(asked.where("error is null")).select(by, "image_index", F.col("url").alias("image_path"))
    read = fields.withColumn("_good", F.col("error").isNull())
    known = items.join(read.where("not _good").groupBy(by, "image_index").agg(F.min("error").alias("error")), [by, "image_index"], "left")
    images = flow.run("images", records.image_outcomes(known, read.where("_good"), (by, "image_index")), "error")
    texts = decoded_values(F.coalesce("qr_codes", F.array().cast("array<string>")))
    good = images.where("success").select(by, "image_index")
    each = flow.run("fields", read.where("_good").drop("_good", "error").join(good, [by, "image_index"], "left_semi").withColumn("qr_codes", texts))
    listed = images.groupBy(by).agg(merge.ordered(F.struct("image_path", "success", "error"), "image_index").alias("images"))
    merged = merge.merge_images(each, by, "image_index", TEXTS, LISTS, ("raw_text",), "confidence").join(listed, by)
    merged = flow.run("merged", merged)
    if answers is not None:
        merged = flow.run("answers", merge.override(merged, answers, by, ANSWERED))
    links = flow.run("links", records.link_union(each, by, "image_index", ("qr_codes",), "raw_text", pages))
    if catalogue is None:
        results = merged.select(by, F.lit(None).cast(records.validation_type()).alias("validation")).where("false")
    else:
        results = records.validations(records.match_records(flow.run("verification", verified_names(merged, catalogue, by, rules)), by), by)
    final = flow.run("records", records.final_records(merged, results, links, by))
    stage = lambda name, df: df.select(by, F.lit(name).alias("stage"), "error")
    without = asked.where("error is null").join(each.select(by), by, "left_anti").withColumn("error", F.lit("no image could be analysed"))
    failures = flow.run("failures", reduce(DataFrame.unionByName, (stage("request", asked.where("error is not null")), stage("images", without))))
    return Outcome(final, failures, flow)
