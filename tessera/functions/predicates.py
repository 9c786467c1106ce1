"""Line and token classifiers: boolean and integer Columns over a RuleSet.

`Line` holds the predicates of one text column, each built once, so that composed rules share their parts and the
recursion between the usage and the structure rule is unrolled for tokens.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import LABEL_ORDER, LABELS, RuleSet
from .arrays import compact, strip
from .tagging import key_of, word_tags, words_of
from .text import _quoted, clean_text

SEPARATORS = ",，、;；·ㆍ"
#: The list of label words of each section.
LIST_OF = {"product_name": "product", "capacity": "capacity", "ingredients": "ingredients", "usage": "usage", "cautions": "cautions", "effects": "effects", "qr_url": "links"}
TOKEN_ENDS = r"[ ,.;:：/·ㆍ\-()\[\]{}]+"


def has_keyword(key: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, compacted, in a compacted text: one pattern of literal alternatives."""
    keys = list(dict.fromkeys(k for k in map(key_of, words) if k))
    return key.rlike("|".join(_quoted(k) for k in keys)) if keys else F.lit(False)


def keyword_hits(key: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(key, F.lit(key_of(w))).cast("int")
    return hits


def separator_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, SEPARATORS, ""))


class Line:
    """Predicates of a text; `token` leaves out what cannot be true of a text without separators. With `mask`, words are looked up in it."""

    def __init__(self, text: Column, rules: RuleSet = LABELS, token: bool = False, mask: Column | None = None):
        self.text, self.rules, self.token, self.mask = F.coalesce(text, F.lit("")), rules, token, mask

    @cached_property
    def key(self) -> Column:
        return compact(self.text)

    def has(self, *names: str) -> Column:
        """Whether a word of any of these lists of the rules is in the text."""
        if self.mask is not None:
            return word_tags(self.rules).any_of(self.mask, names)
        return has_keyword(self.key, tuple(w for n in names for w in words_of(self.rules, n)))

    @cached_property
    def against(self) -> Column:
        """How many words that no ingredient list has occur."""
        return keyword_hits(self.key, self.rules.not_ingredients)

    @cached_property
    def body(self) -> Column:
        return strip(self.text)

    @cached_property
    def hangul(self) -> Column:
        return self.text.rlike("[가-힣]")

    @cached_property
    def digit(self) -> Column:
        return self.text.rlike("[0-9]")

    def finds(self, name: str, text: Column | None = None) -> Column:
        """Whether the pattern `name` of the rules matches, looked for only where it can."""
        found = (self.text if text is None else text).rlike(getattr(self.rules, name))
        needed = self.hangul if name in self.rules.need_hangul else self.digit if name in self.rules.need_digit else None
        return found if needed is None else F.when(needed, found).otherwise(F.lit(False))

    def times(self, name: str, text: Column | None = None) -> Column:
        """How often it matches."""
        found = F.regexp_count(self.text if text is None else text, F.lit(getattr(self.rules, name)))
        needed = self.hangul if name in self.rules.need_hangul else self.digit if name in self.rules.need_digit else None
        return found if needed is None else F.when(needed, found).otherwise(F.lit(0))

    @cached_property
    def url(self) -> Column:
        return self.text.rlike(self.rules.url)

    @cached_property
    def phone(self) -> Column:
        return self.finds("phone")

    @cached_property
    def amount(self) -> Column:
        return self.finds("amount") & ~self.has("not_capacity")

    @cached_property
    def meta(self) -> Column:
        return self.has("makers") | self.finds("company") | self.finds("address") | self.phone | self.finds("lot") | self.finds("date")

    @cached_property
    def orders(self) -> Column:
        return self.finds("usage_ending")

    @cached_property
    def forbids(self) -> Column:
        return self.finds("caution_ending")

    @cached_property
    def suffixes(self) -> Column:
        return self.times("suffix")

    @cached_property
    def separators(self) -> Column:
        return separator_count(self.text)

    @cached_property
    def advert(self) -> Column:
        t = self.body
        commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
        return (F.length(t) >= 8) & self.finds("advert", t) & ~self.finds("usage_ending", t) & ~self.finds("caution_ending", t) & (commas < 2) & (self.times("suffix", t) < 2)

    @cached_property
    def caution(self) -> Column:
        return (self.forbids & ~self.advert & ~self.meta) | self.has("caution_signals")

    @cached_property
    def strong_caution(self) -> Column:
        hits = self.times("caution_ending")
        numbered = self.text.rlike(r"(?<![\p{L}\p{N}_])\d+\s*[.\)]\s*[가-힣]") | self.text.rlike(r"[가-힣]\s*\)\s*[가-힣]")
        meta = self.phone | self.finds("company") | self.finds("lot")
        return (hits >= 1) & (F.length(self.body) >= 10) & ~meta & ((hits >= 2) | ((hits >= 1) & (numbered | self.has("strong_cautions"))))

    @cached_property
    def tokens(self) -> Column:
        """Structs of a token and the mask of its words, null if the line has none."""
        return F.transform(split_tokens(self.text, self.rules), lambda t: F.struct(t.alias("text"), F.lit(None).cast("bigint").alias("mask")))

    @cached_property
    def sequence(self) -> Column:
        """Enough tokens, and enough of them like names."""
        least, ratio = self.rules.sequence
        like = lambda t: token_like_name(t["text"], self.rules, None if self.mask is None else t["mask"])
        # Tokens are looked at only where there are enough of them.
        good = F.when(F.size(self.tokens) >= least, F.size(F.filter(self.tokens, like))).otherwise(0)
        return (good >= least) & (good / F.greatest(F.size(self.tokens), F.lit(1)) >= ratio)

    @cached_property
    def structure(self) -> Column:
        """Like a list of names: separators and tokens, a sequence, or suffixes. A token can have suffixes only."""
        plain = (self.suffixes >= 2) & ~self.advert & ~self.meta
        if self.token:
            return plain
        many = ((self.separators >= 2) & (F.size(self.tokens) >= 3)) | ((self.separators >= 1) & (F.size(self.tokens) >= 2))
        return many | self.sequence | plain

    @cached_property
    def usage(self) -> Column:
        t = self.body
        hangul = F.when(self.hangul, F.length(F.regexp_replace(t, "[^가-힣]", ""))).otherwise(0)
        return (F.length(t) >= 5) & (hangul >= 3) & ~self.advert & ~self.structure & ~self.forbids & (self.orders | self.has("usage_signals"))

    @cached_property
    def penalty(self) -> Column:
        polite = self.finds("polite").cast("int") * 2
        long = ((F.length(self.text) >= 45) & (self.separators == 0)).cast("int")
        return self.against + polite + long

    @cached_property
    def noise(self) -> Column:
        same = self.key.isin(*(key_of(w) for w in self.rules.noise))
        return (self.key == "") | same | self.text.rlike("소비자가|신문") | self.text.rlike(r"^[a-zA-Z]{1,3}$|^[가-힣]$|^[-_=~.ㆍ·,，;；:：|/\\]+$")

    @cached_property
    def ingredient_list(self) -> Column:
        return ~self.noise & ~self.meta & (self.penalty < 2) & ~self.url & ~self.amount & self.structure

    @cached_property
    def header(self) -> Column:
        """Short, a short label before a colon, or a link."""
        label = strip(F.regexp_extract(self.text, r"^(.{1,20})[：:]\s*(.+)", 1))
        has_colon = self.text.rlike(r"^.{1,20}[：:]\s*.+")
        return (self.text != "") & (self.url | (F.length(self.text) <= self.rules.header_length) | (has_colon & (F.length(label) <= self.rules.label_length)))

    @cached_property
    def label(self) -> Column:
        """The first section, in LABEL_ORDER, whose words a header has; null if none."""
        found = F.when(F.lit(False), F.lit(""))
        for s in LABEL_ORDER:
            found = found.when(self.has(LIST_OF[s]), F.lit(s))
        return F.when(self.header, found)

    @cached_property
    def implicit(self) -> Column:
        """The section that the content alone tells; null if none."""
        effects = F.when(self.has("effects_content"), F.lit("effects")).otherwise(F.lit("others"))
        return (
            F.when(self.text == "", F.lit(None).cast("string"))
            .when(self.url, F.lit("qr_url"))
            .when(self.strong_caution, F.lit("cautions"))
            .when(self.meta, F.lit("others"))
            .when(self.advert, effects)
            .when(self.amount, F.lit("capacity"))
            .when(self.ingredient_list, F.lit("ingredients"))
            .when(self.caution, F.lit("cautions"))
            .when(self.usage, F.lit("usage"))
        )

    def sentence(self, allow_meta: bool = False) -> Column:
        good = (F.length(self.text) >= 2) & ~self.amount & ~self.url & ~self.ingredient_list
        return good if allow_meta else good & ~self.meta

    @cached_property
    def product_name(self) -> Column:
        return (
            (self.key != "") & F.length(self.text).between(2, 80) & ~self.noise & ~self.has("ingredients", "usage", "cautions", "capacity", "makers", "links", "storage") & ~self.amount & ~self.ingredient_list
            & ~self.url & ~self.phone & (self.penalty < 2) & self.text.rlike("[가-힣A-Za-z]")
        )

    @cached_property
    def name_score(self) -> Column:
        """How like a product name a line is, by its length, script and what it is not."""
        score = F.lit(1.0) + F.when(F.length(self.text).between(3, 45), 0.4).otherwise(0.0) + F.when(self.text.rlike("[A-Za-z]"), 0.2).otherwise(0.0) + F.when(self.hangul, 0.2).otherwise(0.0)
        for against, cost in ((self.meta, 1.3), (self.amount, 1.2), (self.ingredient_list, 1.8), (self.usage, 1.4), (self.caution, 1.4), (self.url, 1.2)):
            score = score - F.when(against, cost).otherwise(0.0)
        return score

    @cached_property
    def list_score(self) -> Column:
        """How like a part of an ingredient list a line is; candidates are above 0."""
        other = self.meta | self.usage | self.caution | self.amount | self.url
        score = F.least(self.separators * 0.5, F.lit(3.0)) + F.when(F.size(self.tokens) >= 4, 1.0).otherwise(0.0) + F.when(self.sequence, 1.5).otherwise(0.0) + F.when(F.length(self.text) >= 30, 0.5).otherwise(0.0)
        return F.when(other, F.lit(-1.0)).otherwise(score)


#: Facts of a line that others are made of, in an order in which each needs only those before it.
FACTS = (
    ("hangul", "digit"), ("url", "phone", "amount", "orders", "forbids", "suffixes", "separators", "noise", "penalty"),
    ("meta", "advert", "sequence"), ("caution", "strong_caution", "structure"), ("usage", "ingredient_list"),
)


def with_facts(df: DataFrame, text: str = "text", rules: RuleSet = LABELS, cleaned: bool = False) -> tuple[DataFrame, Line]:
    """df with a column _<fact> for each of FACTS, and a Line that reads them, so that no fact is worked out twice.

    cleaned: whether the texts are as clean_text makes them, so that tokens and ends need no cleaning of their own.

    The words of all rules are found by one pass over the line's key and one over those of its tokens. A filter on what such a
    Line tells would be pushed below these columns and spelt out again: store the table first.
    """
    df = df.withColumns({"_key": compact(F.coalesce(text, F.lit(""))), "_parts": token_parts(F.coalesce(text, F.lit("")), rules, cleaned)})
    df = word_tags(rules).tagged(df.withColumn("_part_keys", F.transform("_parts", compact)), "_key", "_part_keys")
    line = Line(F.col(text), rules, mask=F.col("_mask"))
    pairs = F.zip_with("_parts", "_masks", lambda t, m: F.struct(t.alias("text"), m.alias("mask")))
    df = df.withColumn("_tokens", F.filter(pairs, lambda p: plain_token(p["text"], rules, p["mask"])))
    line.__dict__.update({"key": F.col("_key"), "against": F.col("_n_not_ingredients"), "tokens": F.col("_tokens")})
    if cleaned:
        line.__dict__["body"] = F.col(text)
    for level in FACTS:
        df = df.withColumns({f"_{name}": getattr(line, name) for name in level})
        line.__dict__.update({name: F.col(f"_{name}") for name in level})
    return df, line


def token_parts(c: Column, rules: RuleSet = LABELS, cleaned: bool = False) -> Column:
    """Parts between separators, cleaned, of an allowed length. A part of a clean text is clean but for its ends."""
    parts = F.split(c, r"[,，、;；·ㆍ/\n]+")
    if cleaned:
        parts = F.transform(parts, lambda x: F.btrim(x, F.lit(" ,.;:：/·ㆍ-()[]{}")))
    else:
        parts = F.transform(parts, lambda x: F.regexp_replace(clean_text(x), rf"^{TOKEN_ENDS}|{TOKEN_ENDS}$", ""))
    return F.filter(parts, lambda x: F.length(x).between(*rules.token_length))


def plain_token(x: Column, rules: RuleSet = LABELS, mask: Column | None = None) -> Column:
    """Neither a number, short Latin, an amount nor a link."""
    own = Line(x, rules, token=True, mask=mask)
    return ~x.rlike(r"^\d+$|^[a-zA-Z]{1,3}$") & ~own.amount & ~own.url


def split_tokens(c: Column, rules: RuleSet = LABELS) -> Column:
    """Parts between separators, cleaned, of an allowed length, and neither numbers, short Latin, amounts nor links."""
    return F.filter(token_parts(c, rules), lambda x: plain_token(x, rules))


def token_like_name(x: Column, rules: RuleSet = LABELS, mask: Column | None = None) -> Column:
    """Neither usage, caution nor a maker's note, and with a letter.

    As ~usage & ~caution & ~meta of a Line, with what those share asked once: without a maker's note, an advertisement can be
    neither usage nor a caution, but for a word that signals one.
    """
    own = Line(x, rules, token=True, mask=mask)
    said = (F.length(strip(x)) >= 5) & (F.length(F.regexp_replace(x, "[^가-힣]", "")) >= 3) & (own.orders | own.has("usage_signals")) & (own.suffixes < 2)
    running = (own.forbids | F.when(own.hangul, said).otherwise(F.lit(False))) & ~own.advert
    return x.rlike("[가-힣A-Za-z]") & ~own.has("caution_signals") & ~own.meta & ~running
