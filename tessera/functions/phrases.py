"""Rules for text in which no sections have been detected: normalisation of lists of names, and what kind of text a phrase is."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import ADVERT_END, EXPLAINS, LIST_SUFFIX, NAME_CUTS, NAME_ENDS, NAME_STARTS, RAW, REGIONS, RuleSet
from .arrays import bound, compact, replaced, strip
from .predicates import Line, has_keyword, keyword_hits
from .tagging import key_of, word_tags
from .text import ODD, even_allowed, even_spaces, until_keyword
from .text import words_removed as own_labels_removed

_ENDS = r"[ ,.;:：/·ㆍ\-()\[\]{}]+"
_UNITS = (("㎖", "ml"), ("ｍｌ", "ml"), ("ＭＬ", "ml"), ("ｇ", "g"), ("Ｇ", "g"), ("㎎", "mg"), ("㎏", "kg"))


def trimmed(c: Column, ends: str) -> Column:
    return F.regexp_replace(c, f"^{ends}|{ends}$", "")


#: What no text holds that general_text leaves as it is, besides others that it leaves as well: most texts need none of its passes.
_GENERAL_UNEVEN = ODD + r"(?<=(?U:\s)|[，、；ㆍ：（）–—−㎖ｍＭｇＧ㎎㎏])| (?: |$|[,.;:)\]\}])|^ |[,;:](?! |$)|[(\[\{] "


def general_text(c: Column) -> Column:
    """Glyphs unified, white space collapsed, spacing around separators and brackets made even; no space is put after a separator that has none."""
    out = F.translate(c, "\n\t，、；ㆍ：（）–—−", "  ,,;·:()---")
    for pattern, new in (("\\s+", " "), (r"\s*,\s*", ", "), (r"\s*;\s*", "; "), (r"\s*:\s*", ": "), (r"\s+([,.;:)\]\}])", "$1"), (r"([(\[\{])\s+", "$1")):
        out = F.regexp_replace(replaced(out, _UNITS) if pattern == "\\s+" else out, f"(?U){pattern}", new)
    return F.when(c.isNull(), "").when(c.rlike(_GENERAL_UNEVEN), strip(out)).otherwise(c)


def general_lines(c: Column) -> Column:
    """general_text of each line; blank lines go."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n")
    return F.array_join(F.filter(F.transform(lines, general_text), lambda x: x != ""), "\n")


def marks_unified(c: Column) -> Column:
    return F.when(c.rlike(f"{ODD}(?<=[，、；ㆍ：])"), F.translate(c, "，、；ㆍ：", ",,;·:")).otherwise(c)


def chemical_names(c: Column) -> Column:
    """Numbers that belong to names written as in names: 1,2- and 9ppm and PEG-8. Even spaces stay even."""
    named = c
    for pattern, new in ((r"1\s*,?\s*2\s*-\s*", "1,2-"), (r"(?i)(\d)\s*ppm", "$1ppm"), (r"(?i)(피이지|PEG)\s*-?\s*(\d+)", "$1-$2"), (r"(?i)(피피지|PPG)\s*-?\s*(\d+)", "$1-$2")):
        named = F.regexp_replace(named, f"(?U){pattern}", new)
    # Few texts hold what one of the four patterns needs.
    needed = (F.contains(c, F.lit("1")) & F.contains(c, F.lit("2")) & F.contains(c, F.lit("-"))) | c.rlike("(?i)p(?:pm|eg|pg)|피이지|피피지")
    return F.when(needed, named).otherwise(c)


def _noise_pattern(rules: RuleSet) -> str:
    """A pattern of the words, with the blank before them, that are noise, whatever signs stand between their letters, or punctuation only."""
    letter = lambda x: "[kK\u212a]" if x == "k" else f"[{x}{x.upper()}]" if x.upper() != x else x
    signs = r"[\-_:.,;/·\[\](){}]*+"
    words = "|".join(dict.fromkeys(signs.join(letter(x) for x in key_of(w)) for w in rules.noise))
    return rf"(?:^| )(?:[,.;:/·\-()\[\]{{}}]++|{signs}(?:{words}){signs})(?![^ ])"


def without_noise_words(c: Column, rules: RuleSet = RAW) -> Column:
    """Words that are noise or mere punctuation go; for texts with even spaces, which stay even, and unified marks."""
    return F.trim(F.regexp_replace(c, _noise_pattern(rules), ""))


def even_commas(c: Column) -> tuple[Column, ...]:
    """Steps: single blanks after commas and semicolons, none before them, neither at the ends; for texts with even spaces and unified marks."""
    return (
        F.regexp_replace(c, " ?, ?", ", "), F.when(F.contains(c, F.lit(", ,")), F.regexp_replace(c, ", *,+", ", ")).otherwise(c), F.when(F.contains(c, F.lit(";")), F.regexp_replace(c, " *; *", "; ")).otherwise(c),
        F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, "  +", " ")).otherwise(c), trimmed(c, "[ ,;:]+"),
    )


def places_in_turn(words: tuple[str, ...], after: bool) -> str:
    """A pattern of the places, after or before the words, at which commas are put when the words are taken in turn.

    A comma inside a later word would have cut it: a word that always holds an earlier one in its middle has no place, and one that
    an earlier word overlaps has none where it does.
    """
    out = []
    for i, w in enumerate(words):
        guards, dead = [], False
        for e in words[:i]:
            for k in range(1, len(w)):  # where the earlier word's comma would stand in w
                tail = w[:k] if after else w[k:]
                if tail.endswith(e) if after else tail.startswith(e):
                    dead = True
                elif len(tail) < len(e) and (e.endswith(tail) if after else e.startswith(tail)):
                    guards.append(f"(?<!{e}{w[k:]})" if after else f"(?!{w[:k]}{e})")
        if not dead:
            out.append((f"(?<={w})" if after else f"(?={w})") + "".join(guards))
    # The characters that the words end or begin with are asked for first: few places have one.
    edges = "".join(dict.fromkeys(w[-1] if after else w[0] for w in words))
    return (f"(?<=[{edges}])" if after else f"(?=[{edges}])") + f"(?:{'|'.join(out)})"


def comma_after_ends(c: Column) -> Column:
    """A comma after each known end of a name that runs on into the next; for texts without commas."""
    c = F.regexp_replace(c, places_in_turn(NAME_ENDS, True) + "(?=[가-힣A-Za-z0-9])", ", ")
    c = F.regexp_replace(c, r"(?i)(피이지-?\d+[A-Za-z]*)(?=[가-힣])", "$1, ")
    return F.regexp_replace(c, r"(?i)(PEG-?\d+[A-Za-z]*)(?=[A-Za-z가-힣])", "$1, ")


def comma_before_starts(c: Column) -> Column:
    """A comma before each known beginning of a name that follows on another; for texts with few commas."""
    return F.regexp_replace(c, "(?<=[가-힣a-zA-Z0-9])" + places_in_turn(NAME_STARTS, False), ", ")


def stop_words(rules: RuleSet = RAW) -> tuple[str, ...]:
    return rules.product + rules.capacity + rules.usage + rules.cautions + rules.effects + rules.links + rules.makers + rules.storage


def list_text(df: DataFrame, name: str, rules: RuleSet = RAW) -> DataFrame:
    """df with the text `name` made ready to be split into names. One column a step, so that what a step asks twice is worked out once.

    From the first step on spaces are even, which makes the others short. A filter on the result would be pushed below these columns
    and spell all steps out again: store it first."""
    c = F.col(name)
    steps = [
        F.coalesce(c, F.lit("")), *even_allowed(c), marks_unified(c), chemical_names(c), own_labels_removed(c, rules.ingredients), until_keyword(c, stop_words(rules)),
        without_noise_words(c, rules), *even_commas(c), F.when(F.contains(c, F.lit(",")), c).otherwise(comma_after_ends(c)),
        F.when(F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))) >= 3, c).otherwise(comma_before_starts(c)), *even_commas(c),
    ]
    for step in steps:
        df = df.withColumn(name, step)
    return df


def name_text(df: DataFrame, name: str, rules: RuleSet = RAW) -> DataFrame:
    """df with the text `name` cleaned as a single name."""
    c = F.col(name)
    spaced = F.when(c.rlike(ODD + r"(?<=(?U:\s))|  |^ | $"), even_spaces(c)).otherwise(c)
    for step in (marks_unified(c), chemical_names(c), spaced, own_labels_removed(c, rules.ingredients), until_keyword(c, stop_words(rules)), without_noise_words(c, rules), trimmed(c, r"[ :,.;/·\-\[\](){}]+")):
        df = df.withColumn(name, step)
    return df


class Phrase(Line):
    """Predicates of a text by the rules for raw text."""

    def __init__(self, text: Column, rules: RuleSet = RAW, mask: Column | None = None):
        super().__init__(text, rules, mask=mask)

    @cached_property
    def meta(self) -> Column:
        return self.has("makers", "meta_noise") | self.phone | F.when(self.hangul, self.text.rlike(REGIONS)).otherwise(F.lit(False))

    @cached_property
    def penalty(self) -> Column:
        """As for a line, but only commas count as separators."""
        polite = self.finds("polite").cast("int") * 2
        return self.against + polite + ((F.length(self.text) >= 45) & ~F.contains(self.text, F.lit(","))).cast("int")

    @cached_property
    def tokens(self) -> Column:
        parts = F.transform(F.split(self.text, r"[,，、;；·ㆍ/\n]+"), lambda x: trimmed(x, _ENDS))
        return F.filter(parts, lambda x: F.length(x).between(2, 50) & ~x.rlike(r"^\d+$|^[a-zA-Z]{1,3}$"))

    @cached_property
    def structure(self) -> Column:
        n = F.size(self.tokens)
        return ((self.separators >= 2) & (n >= 3)) | ((self.separators >= 1) & (n >= 2))

    @cached_property
    def noise_word(self) -> Column:
        return (self.key == "") | self.key.isin(*(key_of(w) for w in self.rules.noise)) | self.text.rlike("^[a-zA-Z]{1,4}$")

    @cached_property
    def noise(self) -> Column:
        return self.noise_word | self.text.rlike("소비자가|신문|^[가-힣]{1,2}$")

    @cached_property
    def effect_hits(self) -> Column:
        return keyword_hits(self.key, self.rules.effects_content)

    @cached_property
    def words(self) -> Column:
        """Structs of a word and the mask of the rules' words in it, null if the phrase has none."""
        return F.transform(word_parts(self.text), lambda w: F.struct(w.alias("text"), F.lit(None).cast("bigint").alias("mask")))

    def word_against(self, w: Column) -> Column:
        """Whether a word holds one that no ingredient list has."""
        if self.mask is None:
            return has_keyword(compact(w["text"]), self.rules.not_ingredients)
        return word_tags(self.rules).any_of(w["mask"], ("not_ingredients",))

    @cached_property
    def ingredient_list(self) -> Column:
        """Separators besides those within numbers, or at least five plain words, two of them with the ends of names."""
        between = F.greatest(self.separators - F.regexp_count(self.text, F.lit(r"\d\s*[,，、]\s*\d")), F.lit(0))
        plain = F.size(F.filter(self.words, lambda w: F.length(w["text"]).between(2, 40) & ~self.word_against(w) & ~w["text"].rlike(self.rules.polite)))
        # Ends of names are Hangul: other texts have none.
        named = (F.size(F.filter(self.words, lambda w: w["text"].rlike(LIST_SUFFIX))) >= 2) & ~self.text.rlike(EXPLAINS) & (plain >= 5)
        named = F.when(self.hangul, named).otherwise(F.lit(False))
        return ~self.noise & ~self.meta & (self.penalty < 2) & ~((self.effect_hits >= 2) & (self.separators == 0)) & ((between >= 2) | ((between >= 1) & (F.size(self.tokens) >= 2)) | named)

    @cached_property
    def usage(self) -> Column:
        return self.has("usage_signals") & ~self.structure

    @cached_property
    def caution(self) -> Column:
        return self.has("caution_signals")

    @cached_property
    def effects(self) -> Column:
        return ~self.url & ~self.amount & ~self.ingredient_list & ~self.meta & ~self.usage & ~self.caution & (self.effect_hits > 0)

    def sentence(self, allow_meta: bool = False) -> Column:
        good = (F.length(self.text) >= 2) & ~self.amount & ~self.url & ~self.phone & ~self.ingredient_list
        return good if allow_meta else good & ~self.meta

    @cached_property
    def candidate(self) -> Column:
        """Whether it can be one name of a list."""
        words = self.has("product", "usage", "cautions", "capacity", "makers", "links", "storage", "meta_noise")
        return F.length(self.text).between(2, 80) & ~self.noise_word & ~words & ~self.url & ~self.phone & ~self.amount & (self.penalty < 2) & self.text.rlike("[가-힣a-zA-Z]")

    @cached_property
    def product_name(self) -> Column:
        words = self.has("ingredients", "usage", "cautions", "capacity", "makers", "links", "storage")
        return F.length(self.text).between(2, 80) & ~self.noise & ~words & ~self.amount & ~self.ingredient_list & ~self.url & ~self.phone & (self.penalty < 2) & self.text.rlike("[가-힣A-Za-z]")


#: Facts of a phrase that others are made of, each level from those before it.
PHRASE_FACTS = (("hangul", "digit"), ("url", "phone", "amount", "separators", "noise_word", "penalty", "tokens"), ("meta", "noise", "structure", "caution"), ("usage", "ingredient_list"))


def word_parts(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[,，、;；·ㆍ/\s]+"), lambda w: w != "")


def tagged_phrase(df: DataFrame, text: str = "text", rules: RuleSet = RAW) -> tuple[DataFrame, Phrase]:
    """df with the words of all rules found in its texts, and a Phrase that looks them up: for a few facts that are asked once. Store the table before rows are chosen by them."""
    df = word_tags(rules).tagged(df.withColumn("_key", compact(F.coalesce(text, F.lit("")))), "_key")
    phrase = Phrase(F.col(text), rules, mask=F.col("_mask"))
    phrase.__dict__.update({"key": F.col("_key"), "against": F.col("_n_not_ingredients"), "effect_hits": F.col("_n_effects_content")})
    return df, phrase


def with_phrase_facts(df: DataFrame, text: str = "text", rules: RuleSet = RAW) -> tuple[DataFrame, Phrase]:
    """df with a column _<fact> for each of PHRASE_FACTS, and a Phrase that reads them. Store the table before rows are chosen by them.

    The words of all rules are found by one pass over the phrase's key and one over those of its words, if it has Hangul.
    """
    c = F.coalesce(text, F.lit(""))
    df = df.withColumns({"_key": compact(c), "_word_parts": F.when(c.rlike("[가-힣]"), word_parts(c)).otherwise(F.array().cast("array<string>"))})
    df = word_tags(rules).tagged(df.withColumn("_word_keys", F.transform("_word_parts", compact)), "_key", "_word_keys")
    df = df.withColumn("_words", F.zip_with("_word_parts", "_masks", lambda t, m: F.struct(t.alias("text"), m.alias("mask"))))
    phrase = Phrase(F.col(text), rules, mask=F.col("_mask"))
    phrase.__dict__.update({"key": F.col("_key"), "against": F.col("_n_not_ingredients"), "effect_hits": F.col("_n_effects_content"), "words": F.col("_words")})
    for level in PHRASE_FACTS:
        df = df.withColumns({f"_{name}": getattr(phrase, name) for name in level})
        phrase.__dict__.update({name: F.col(f"_{name}") for name in level})
    return df, phrase


def advert_cut(c: Column) -> Column:
    """A product name up to where advertising begins, if at least four characters stay; the earliest first match counts, after the start."""
    at = F.array_min(F.filter(F.array(*(F.when(c.rlike(p), F.regexp_instr(c, F.lit(p))) for p in NAME_CUTS)), lambda p: p > 1))
    head = trimmed(F.substring(c, F.lit(1), at - 1), "[ ,.-]+")
    return F.when(at.isNotNull() & (at > 3) & (F.length(head) >= 4), head).otherwise(c)


def ends_as_advert(c: Column) -> Column:
    return strip(c).rlike(ADVERT_END)


def valid_link_value(c: Column, invalid: tuple[str, ...] = ()) -> Column:
    """A link, or a text of eight characters with a letter; no numbers, phones or words in `invalid`."""
    c = strip(c)
    from ..rules import SENTINELS

    good = (F.length(c) >= 4) & ~c.isin(*SENTINELS) & ~c.rlike(r"^\d+$|^\d{2,4}-\d{3,4}-\d{4}$") & (c.rlike(RAW.url) | ((F.length(c) >= 8) & c.rlike("[a-zA-Z가-힣]")))
    return good & ~has_keyword(compact(c), invalid) if invalid else good


def clean_link_value(c: Column) -> Column:
    """Without quotes, brackets and closing punctuation at the ends; a link also without white space, and with a scheme."""
    from .text import with_scheme

    c = strip(F.translate(F.coalesce(c, F.lit("")), "\n\t", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"""(?U)^[\s"'`<>\[\](){}]+""", ""), r"""(?U)[\s"'`<>\[\](){},.;]+$""", "")
    return bound(c, lambda x: F.when(x.rlike(RAW.url), with_scheme(F.regexp_replace(x, r"(?U)\s+", ""))).otherwise(x))


def decoded_values(items: Column, invalid: tuple[str, ...] = ()) -> Column:
    """Values read from codes, cleaned, without those that are neither a link nor a text of some length; a null list is empty."""
    cleaned = F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_link_value)
    return F.filter(cleaned, lambda x: F.coalesce(valid_link_value(x, invalid), F.lit(False)))
