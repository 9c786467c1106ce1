"""Layout: word boxes to blocks, lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.predicates import Line
from ..functions.text import clean_text
from ..rules import LABELS, RuleSet
from ..storage import saved
from .order import kth_values, medians, with_step
from .scan import same
from .sequential import walk_sorted

LINE_SHARE, LINE_LEAST, HEIGHT_DEFAULT = 0.55, 6.0, 14.0


def blocks(words: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """Words (image_id, ord, points, text, confidence) with their boxes; words that are unsure, noise or without area go."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = words.withColumns({"text": clean_text(F.col("text")), "confidence": F.coalesce("confidence", F.lit(0.0)), "x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)})
    boxed = boxed.withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min"), "center_x": (F.col("x_min") + F.col("x_max")) / 2, "center_y": (F.col("y_min") + F.col("y_max")) / 2})
    # What is cheap to test comes first.
    return boxed.where((F.col("confidence") >= rules.min_confidence) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("text") != "")).where(~_noise_word(F.col("text")))


def _noise_word(c: Column) -> Column:
    return c.rlike(r"^[-_=~.ㆍ·,，;；:：|/\\]+$|^(.)\1{4,}$") | ~c.rlike(r"[\p{L}\p{N}]")


def number_lines(boxed: DataFrame) -> DataFrame:
    """blocks with line_index: in order of height on the page, a block opens a line if it lies further than the threshold below
    the mean of the newest one. Blocks come in ascending order, so no older line can be nearer."""
    limit = F.greatest(F.median("height").over(Window.partitionBy("image_id")) * LINE_SHARE, F.lit(LINE_LEAST))

    def step(state: list, row: tuple) -> tuple:
        y, most = row
        if not state[2] or y - state[1] / state[2] > most:
            state[:] = [state[0] + 1, 0.0, 0]
        state[1:] = [state[1] + y, state[2] + 1]
        return (state[0],)

    told = boxed.withColumn("_limit", limit)
    return walk_sorted(told, ("image_id",), ("center_y", "x_min", "ord", "text"), ("center_y", "_limit"), lambda: [-1, 0.0, 0], step, {"line_index": "int"}).drop("_limit")


def space_needed(before: Column, text: Column, gap: Column, height: Column, width: Column) -> Column:
    """Whether a space belongs between two neighbouring blocks."""
    normal = F.greatest(height * 0.35, width * 0.10, F.lit(5.0))
    small = F.greatest(height * 0.15, F.lit(3.0))
    glued = before.rlike(r"[(\[{/\-·,.:&]$") | text.rlike(r"^[)\]}/\-·,.:%]")
    unit = before.rlike(r"\d$") & text.rlike("^(ml|mL|ML|g|G|mg|kg|oz|%)")
    worded = before.rlike("[가-힣A-Za-z0-9)]$") & text.rlike("^[가-힣A-Za-z0-9(]")
    return (gap > 0) & ~glued & (unit | (gap >= normal) | ((gap >= small) & worded))


def _middle(values: Column) -> Column:
    """The middle value of a list, or the mean of the two in the middle."""
    at = lambda v, n: F.get(v, F.floor(n / 2).cast("int"))
    return bound(F.sort_array(F.filter(values, lambda x: x.isNotNull())), lambda v: (at(v, F.size(v) - 1) + at(v, F.size(v))) / 2)


def _joined(words: Column) -> Column:
    """The text of a line's words, in order, with spaces where gaps ask for them; most lines are one word."""

    def spaced(ws: Column, m: Column) -> Column:
        space = lambda before, w: space_needed(before["text"], w["text"], w["x_min"] - before["x_max"], m["h"], m["w"])
        parts = F.transform(ws, lambda w, i: F.when((i > 0) & bound(F.get(ws, i - 1), lambda before: space(before, w)), F.concat(F.lit(" "), w["text"])).otherwise(w["text"]))
        return F.array_join(parts, "")

    middles = lambda ws: F.struct(*(_middle(F.transform(ws, lambda w: w[c])).alias(n) for n, c in (("h", "height"), ("w", "width"))))
    return bound(words, lambda ws: F.when(F.size(ws) < 2, F.get(ws, F.lit(0))["text"]).otherwise(bound(middles(ws), lambda m: spaced(ws, m))))


def merge_lines(numbered: DataFrame) -> DataFrame:
    """One row per line: text with spaces where gaps ask for them, box, mean confidence. Words at one place follow one another by ord, then text.

    The words of a line lie in one row, as its text does; medians and neighbours are told there.
    """
    words = F.sort_array(F.collect_list(F.struct("x_min", "ord", "text", "x_max", "height", "width")))
    lines = numbered.groupBy("image_id", "line_index").agg(
        words.alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_blocks"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.avg("center_y").alias("center_y"),
    )
    return lines.withColumns({"text": clean_text(_joined(F.col("text"))), "height": F.col("y_max") - F.col("y_min")})


#: What lines are made of.
WORD = ("image_id", "ord", "text", "confidence", "x_min", "x_max", "y_min", "y_max", "width", "height", "center_y")


def lines_of_words(words: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """Words (image_id, ord, points, text, confidence) as lines; their points stay behind once their boxes are known."""
    return merge_lines(number_lines(blocks(words, rules).select(*WORD)))


def section_break(lines: DataFrame) -> DataFrame:
    """(image_id, threshold): 1.5 times the gap at three quarters of the sorted positive gaps, at least 1.5 median heights; 2 median heights without gaps.

    Gaps and heights are counted by value, so an image of any number of lines is dealt over tasks.
    """
    by = ("image_id",)
    stepped = saved(with_step(lines.select("image_id", "center_y", "x_min", "height"), by, "center_y", ("x_min",)), "steps")
    gaps = kth_values(stepped.where("_step > 0"), by, "_step", {"_gap": lambda n: F.least(F.floor(n * 0.75), n - 1)})
    heights = medians(stepped.where("height > 0"), by, "height")
    images = stepped.select("image_id").distinct()
    told = images.join(gaps, same(images, gaps, by), "left").select(images["image_id"], "_gap")
    told = told.join(heights, same(told, heights, by), "left").select(told["image_id"], "_gap", F.coalesce("median", F.lit(HEIGHT_DEFAULT)).alias("h"))
    return told.select("image_id", F.when(F.col("_gap").isNull(), F.col("h") * 2.0).otherwise(F.greatest(F.col("_gap") * 1.5, F.col("h") * 1.5)).alias("threshold"))


def page_text(lines: DataFrame) -> DataFrame:
    """(image_id, raw_text, layout_text): lines from the top, in layout_text with a blank line at each break. Lines at one place follow one another by text, so a break stands before all of them."""
    order = Window.partitionBy("image_id").orderBy("center_y", "x_min", "text")
    told = lines.where("text <> ''").join(section_break(lines), "image_id").withColumn("_gap", F.col("center_y") - F.lag("center_y").over(order))
    part = F.struct("center_y", "x_min", "text", F.when(F.col("_gap") > F.col("threshold"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")).alias("spaced"))
    rows = told.groupBy("image_id").agg(F.sort_array(F.collect_list(part)).alias("rows"))
    return rows.select("image_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("raw_text"), F.array_join(F.transform("rows", lambda r: r["spaced"]), "\n").alias("layout_text"))


def lines_of_text(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Raw text as lines: (image_id, line_index, text, x_min, center_y, ...) with the line number as height on the page; blank lines go."""
    each = docs.select(F.col(id_col).alias("image_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_index", "raw"))
    y = F.col("line_index").cast("double")
    boxed = each.select("image_id", "line_index", clean_text(F.col("raw")).alias("text"), F.lit(0.0).alias("x_min"), F.lit(0.0).alias("x_max"), y.alias("y_min"), y.alias("y_max"), y.alias("center_y"), F.lit(1.0).alias("height"))
    return boxed.where("text <> ''")


def quality_score(texts: DataFrame, rules: RuleSet = LABELS) -> DataFrame:
    """texts (raw_text, confidence, n_blocks, n_lines[, variant, dark]) with score: a sum of shares and bonuses less penalties, at least 0."""
    t = F.col("raw_text")
    own = Line(t, rules)
    readable = F.length(F.regexp_replace(t, r"[^가-힣A-Za-z0-9,.;:()\[\]/\-·%]", "")) / F.greatest(F.length(t), F.lit(1))
    score = F.col("confidence") + readable * 0.35 + F.least(F.col("n_blocks") * 0.003, F.lit(0.30)) + F.least(F.col("n_lines") * 0.010, F.lit(0.30)) + 0.03
    words = rules.product + rules.capacity + rules.ingredients + rules.usage + rules.cautions
    from ..functions.predicates import has_keyword

    listed = (F.regexp_count(t, F.lit(",")) >= 3) & (F.size(F.split(t, r"\s+")) >= 6) | (own.suffixes >= 2)
    broken = F.length(t) - F.length(F.translate(t, "�□■◆◇", "")) + F.regexp_count(t, F.lit("[Yy]{2,}")) + F.regexp_count(t, F.lit("[UuDdOoLlIi]{4,}"))
    for good, bonus in ((has_keyword(own.key, words), 0.20), (t.rlike(rules.amount), 0.08), (own.url, 0.05), (listed, 0.18), (F.length(F.trim(t)) < 10, -0.30), (F.col("n_lines") < 3, -0.20)):
        score = score + F.when(good, bonus).otherwise(0.0)
    if "variant" in texts.columns and "dark" in texts.columns:
        score = score + F.when(F.col("dark") & (F.col("variant") == "inverted"), 0.10).when(F.col("dark") & F.col("variant").isin("original", "readable", "ocr_enhanced", "color_clahe"), -0.05).otherwise(0.0)
        score = score + F.when(F.col("variant").isin("soft_binary", "high_contrast_binary") & (F.col("confidence") >= 0.85), 0.05).otherwise(0.0)
    score = score - F.least(broken * 0.06, F.lit(0.60))
    return texts.withColumn("score", F.when(t.isNull() | (t == ""), 0.0).otherwise(F.greatest(score, F.lit(0.0))))


def best_variant(scored: DataFrame, by: str = "image_id", order: str = "ord") -> DataFrame:
    """The row with the highest score of each image, the first of equals."""
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))).where("_r = 1").drop("_r")


def distinct_variants(variants: DataFrame, by: str = "image_id", order: str | Column = "ord", variant: str = "variant", path: str = "path") -> DataFrame:
    """The first row in `order` of each image, variant and path; a missing variant is "unknown", a missing path is empty.

    Firsts are taken before the shuffle, so an image with very many rows is no hot key.
    """
    keys = [F.col(by), F.coalesce(variant, F.lit("unknown")).alias("_variant"), F.coalesce(path, F.lit("")).alias("_path")]
    firsts = variants.groupBy(*keys).agg(F.min_by(F.struct(*variants.columns), order).alias("row"))
    return firsts.select("row.*")


def variant_summaries(scored: DataFrame, by: str = "image_id", order: str = "ord") -> DataFrame:
    """(by, place, variant, path, score, confidence, n_blocks, n_lines, text_length): the variants of each image, the best first, then by order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    told = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return told.select(by, place.alias("place"), "variant", "path", "score", zero("confidence"), zero("n_blocks"), zero("n_lines"), F.length(F.coalesce("raw_text", F.lit(""))).alias("text_length"))
