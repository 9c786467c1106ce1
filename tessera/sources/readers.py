"""Sources. What is outside of Spark, such as recognition, models or the web, comes in as a table or as an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_description, html_title

WORD_SCHEMA = "image_id string, ord int, points array<struct<x:double,y:double>>, text string, confidence double"
PAGE_SCHEMA = "input_url string, success boolean, status_code int, resolved_url string, page_title string, meta_description string, error string"
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON requests {user_id, image_url: text or list} as (user_id, image_urls)."""
    reader = spark.readStream if streaming else spark.read
    return requests(reader.text(path).withColumnRenamed("value", "body"))


def requests(bodies: DataFrame) -> DataFrame:
    """bodies with user_id, image_urls, error: a single URL becomes a list, blanks go; what is left without URLs is an error, not a failure."""
    v = F.try_parse_json("body")
    one = F.try_variant_get(v, "$.image_url", "string")
    many = F.try_variant_get(v, "$.image_url", "array<string>")
    urls = F.filter(F.transform(F.coalesce(many, F.array(one)), lambda x: F.trim(x)), lambda x: x != "")
    told = bodies.withColumns({"user_id": F.try_variant_get(v, "$.user_id", "string"), "image_urls": F.coalesce(urls, F.array().cast("array<string>"))})
    return told.withColumn("error", F.when(v.isNull(), "not JSON").when(F.size("image_urls") == 0, "no image_url"))


def image_items(reqs: DataFrame) -> DataFrame:
    """One row per distinct URL of a request, in order, with its file name and media type."""
    each = reqs.select("user_id", F.posexplode(F.array_distinct("image_urls")).alias("image_index", "url"))
    ext = F.lower(F.regexp_extract(F.split("url", "[?]")[0], r"(\.[^./]+)$", 1))
    good = F.when(ext.isin(*MEDIA_TYPES), ext).otherwise(".jpg")
    return each.withColumns({"file_name": F.concat(F.lpad((F.col("image_index") + 1).cast("string"), 2, "0"), good), "media_type": media_type(F.col("url"))})


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.split(path, "[?]")[0], r"(\.[^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext), F.lit("image/jpeg"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as bytes, with media type and data URL; other files are left out by their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(jpe?g|png|gif|webp)$")).withColumn("media_type", media_type(F.col("path")))
    return files.withColumn("data_url", F.concat(F.lit("data:"), "media_type", F.lit(";base64,"), F.base64("content")))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORD_SCHEMA).parquet(path)


def words_of_annotations(pages: DataFrame, column: str = "annotation") -> DataFrame:
    """Recognition results nested page, block, paragraph, word, symbol as words (image_id, ord, points, text, confidence)."""
    blocks = pages.select("image_id", F.explode(f"{column}.pages").alias("p")).select("image_id", F.explode("p.blocks").alias("b"))
    words = blocks.select("image_id", F.explode("b.paragraphs").alias("g")).select("image_id", F.explode("g.words").alias("w"))
    told = words.select("image_id", F.col("w.vertices").alias("points"), F.array_join(F.transform("w.symbols", lambda s: s["text"]), "").alias("text"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"))
    return told


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalogue_items(responses: DataFrame, column: str = "body") -> DataFrame:
    """responses with one row per item (item_pos, kor_name, eng_name, alias, cas_no, definition), wherever the items lie: body.items,
    response.body.items or items, as a list, an object, or wrapped in item."""
    from ..functions.text import lenient

    v = F.try_parse_json(column)
    lists, single = [], []
    for base in ("$.body.items", "$.response.body.items", "$.items"):
        for path in (f"{base}.item", base):
            lists.append(F.try_variant_get(v, path, "array<variant>"))
            single.append(F.try_variant_get(v, path, "variant"))
    items = F.coalesce(*lists, F.when(F.coalesce(*single).isNotNull(), F.array(F.coalesce(*single))), F.array().cast("array<variant>"))
    each = responses.select("*", F.posexplode(items).alias("item_pos", "item"))
    return each.select(
        "*", lenient(F.col("item"), ("INGR_KOR_NAME", "ingrKorName", "INGR_NM", "name")).alias("kor_name"), lenient(F.col("item"), ("INGR_ENG_NAME", "ingrEngName", "ENG_NM", "engName")).alias("eng_name"),
        lenient(F.col("item"), ("INGR_ALIAS", "ingrAlias", "ALIAS", "alias")).alias("alias"), lenient(F.col("item"), ("CAS_NO", "casNo", "CASNo", "CAS")).alias("cas_no"),
        lenient(F.col("item"), ("INGR_DEF", "ingrDef", "DEFINITION", "definition")).alias("definition"),
    )


def fetched_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages that are already fetched, as (input_url, success, ..., page_title, meta_description)."""
    body = F.coalesce(html, F.lit(""))
    return pages.select(
        F.col(url).alias("input_url"), (body != "").alias("success"), F.when(body != "", 200).alias("status_code"), F.col(url).alias("resolved_url"),
        html_title(body).alias("page_title"), html_description(body).alias("meta_description"), F.when(body == "", "empty").alias("error"),
    )


def call_out(df: DataFrame, fetch: Callable[[dict], dict], schema: str) -> DataFrame:
    """df's rows through a callable that answers each with a row of schema; an exception becomes the row's error. For recognition,
    models and fetches: the callable is made once in each task and rows come in batches."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append(fetch(row))
                except Exception as e:  # one row's failure is not the job's
                    out.append({"error": str(e)})
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.mapInPandas(run, schema)
