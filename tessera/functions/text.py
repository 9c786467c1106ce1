"""Normalisation of scalars: Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import LABELS, MISREADINGS, SENTINELS, UNKNOWN, RuleSet
from .arrays import bound, known, replaced, strip

#: Glyphs that are written as others.
GLYPHS = (
    ("\r", " "), ("\n", " "), ("\t", " "), ("，", ","), ("、", ","), ("；", ";"), ("：", ":"), ("ㆍ", "·"), ("（", "("), ("）", ")"), ("［", "["), ("］", "]"), ("【", "["), ("】", "]"),
    ("㎖", "ml"), ("ｍｌ", "ml"), ("ＭＬ", "ml"), ("ｇ", "g"), ("Ｇ", "g"), ("㎎", "mg"), ("㎏", "kg"), ("–", "-"), ("—", "-"), ("−", "-"),
)
#: Glyphs that recognised text has besides.
MORE_GLYPHS = (
    ("・", "·"), ("「", "["), ("」", "]"), ("『", "["), ("』", "]"), ("㎘", "kl"), ("㎕", "ul"), ("㎍", "ug"), ("㎤", "cm3"), ("‐", "-"), ("‑", "-"),
    ("\u201c", '"'), ("\u201d", '"'), ("\u2018", "'"), ("\u2019", "'"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("Ⅴ", "V"),
    ("▶", ""), ("▷", ""), ("◀", ""), ("◁", ""), ("→", " "), ("←", " "), ("↑", " "), ("↓", " "), ("•", "·"), ("●", "·"), ("○", " "), ("■", " "), ("□", " "), ("◆", " "), ("◇", " "),
    ("★", " "), ("☆", " "), ("✓", " "), ("✔", " "), ("０", "0"), ("１", "1"), ("２", "2"), ("３", "3"), ("４", "4"), ("５", "5"), ("６", "6"), ("７", "7"), ("８", "8"), ("９", "9"),
    ("％", "%"), ("＆", "&"), ("＋", "+"), ("／", "/"), ("＿", "_"),
)
SPACING = (
    (r"(?U)\s+", " "), (r"(?U)\s*,\s*", ", "), (r"(?U)\s*;\s*", "; "), (r"(?U)\s*:\s*", ": "), (r"(?U)\s+([,.;:)\]\}])", "$1"), (r"(?U)([(\[\{])\s+", "$1"), (r"([,;])(?=[가-힣A-Za-z0-9])", "$1 "),
)


#: What no text holds that SPACING leaves as it is, besides others that it leaves as well: one pass tells that seven are not needed.
UNEVEN = r"(?U)[^\S ]|  |^ | $|[,;:](?! )| [,.;:)\]\}]|[(\[\{] |[,;:]$"


#: White space that is not one blank: most gaps between words are, and need no replacement.
RAGGED = r"(?: \s+|[^\S ]\s*)"


def even_spaces(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return bound(c, lambda x: F.when(x.rlike(rf"(?U){RAGGED}|^ | $"), strip(F.regexp_replace(x, f"(?U){RAGGED}", " "))).otherwise(x))


def clean_text(c: Column, glyphs: tuple[tuple[str, str], ...] = GLYPHS) -> Column:
    """Glyphs unified, white space collapsed, spacing around separators and brackets made even; null becomes empty."""
    one_to_one = [(a, b) for a, b in glyphs if len(a) == len(b) == 1]
    c = F.translate(F.coalesce(c, F.lit("")), "".join(a for a, _ in one_to_one), "".join(b for _, b in one_to_one))
    c = replaced(c, [(a, b) for a, b in glyphs if not len(a) == len(b) == 1])
    # Bound to a name by a list of one element, so that what the test and the passes ask is worked out once.
    def spaced(x: Column) -> Column:
        out = x
        for pattern, new in SPACING:
            out = F.regexp_replace(out, pattern, new)
        return F.when(x.rlike(UNEVEN), strip(out)).otherwise(x)

    return F.get(F.transform(F.array(c), spaced), F.lit(0))


def clean_recognised(c: Column) -> Column:
    """clean_text of text as recognised from images, with its marks, numerals and wide digits."""
    return clean_text(c, GLYPHS + MORE_GLYPHS)


def clean_lines(c: Column) -> Column:
    """clean_text of each line; blank lines go."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), clean_text), lambda x: x != ""), "\n")


#: A character that is neither printable ASCII nor Hangul. A class of more than two ranges or marks is many times as slow, so what
#: else it has to be is asked by looking back at the few that it matches.
ODD = "[^ -~가-힣]"


def even_allowed(c: Column) -> tuple[Column, ...]:
    """Steps on a column c: characters other than Hangul, Latin letters, digits and label punctuation become spaces, white space is collapsed to single blanks, none at the ends."""
    kept = F.regexp_replace(F.regexp_replace(c, f"{ODD}(?<![·ㆍ：])", " "), r"""[!"#$&'*<=>?@\\^`{|}~]""", " ")
    return kept, F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, "  +", " ")).otherwise(c))


def confidence(c: Column) -> Column:
    """A number from 0 to 1; what is no number is 0."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def whole_number(c: Column, default: int | None = None) -> Column:
    """Rounded half to even; what is no number is the default."""
    return F.coalesce(F.bround(c.try_cast("double")).try_cast("int"), F.lit(default).cast("int"))


def amount_text(c: Column) -> Column:
    """Number and unit written together, and an even a x b."""
    c = F.regexp_replace(c, r"(?i)(\d+(?:\.\d+)?)\s*(ml|kg|mg|g|oz|매|pcs|ea|개)", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s*[xX×]\s*(?=\d)", " x "), r"\s+", " "))


def search_hint(c: Column) -> Column:
    """What a misread name is searched as: replacements in their declared order."""
    c = F.translate(F.coalesce(c, F.lit("")), "，、；ㆍ：", ",,;·:")
    c = F.regexp_replace(c, r"(?U)나이아신\s*아마이드", "나이아신아마이드")
    c = F.regexp_replace(c, r"1\s*,?\s*2\s*-\s*", "1,2-")
    c = F.regexp_replace(c, r"(?i)(\d)\s*ppm", "$1ppm")
    return strip(F.regexp_replace(replaced(c, MISREADINGS), r"(?U)\s+", " "))


def without_label(c: Column, labels: tuple[str, ...]) -> Column:
    """Leading labels with their colons, as often as they come: one anchored pattern instead of a loop."""
    spaced = "|".join(r"\s*".join(_quoted(x) for x in label if x != " ") for label in sorted(labels, key=len, reverse=True))
    return strip(F.regexp_replace(c, rf"(?iU)^(?:\s*(?:{spaced})\s*[:：]?\s*)+", ""))


def section_label_removed(c: Column, section: Column, rules: RuleSet = LABELS) -> Column:
    """The text without each label of its section, one after another."""
    out = F.when(F.lit(False), c)
    for name in ("product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url"):
        out = out.when(section == name, words_removed(c, rules.keywords(name)))
    return out.otherwise(c)


def words_removed(c: Column, words: tuple[str, ...]) -> Column:
    """Each of the words in turn, with a colon, from the beginning: one pattern of optional parts instead of a replacement a word."""
    return strip(F.regexp_replace(c, "(?iU)^" + "".join(rf"(?:\s*{_quoted(w)}\s*[:：]?\s*)?" for w in words), ""))


def _quoted(s: str) -> str:
    return "".join("\\" + x if x in r"\^$.|?*+()[]{}" else x for x in s)


def clean_query(c: Column, labels: tuple[str, ...] = ("전성분", "전 성 분", "성분", "원료", "ingredients", "ingredient")) -> Column:
    """A lookup query: no leading label, no characters but Hangul, Latin, digits and , - /, ends stripped."""
    c = F.translate(without_label(strip(F.coalesce(c, F.lit(""))), labels), "，、；ㆍ：\r\n\t", ",,;·:   ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)[^가-힣a-zA-Z0-9,\-/\s]", ""), " +", " "), ",+", ",")
    return strip(F.regexp_replace(c, r"^[ ,;:/\-]+|[ ,;:/\-]+$", ""))


#: Marks that are unified before a list of names is split, one to one, then units and line ends.
SPLIT_MARKS = (("，", ","), ("、", ","), ("；", ";"), ("ㆍ", "·"), ("：", ":"), ("\t", " "), ("ｇ", "g"), ("Ｇ", "g"), ("–", "-"), ("—", "-"), ("−", "-"))
SPLIT_UNITS = (("\r\n", "\n"), ("\r", "\n"), ("㎖", "ml"), ("ｍｌ", "ml"), ("ＭＬ", "ml"))
SPLIT_SPACING = ((r"(?U)\s*,\s*", ", "), (r"(?U)\s*;\s*", "; "), (r"(?U)\s*:\s*", ": "), (r" +", " "), (r" *\n *", "\n"))
#: Labels before a name, taken off one after the other in this order.
NAME_LABELS = ("전성분", "전 성분", "성분", "주성분", "주 성분", "ingredients", "ingredient")


def splittable(c: Column) -> Column:
    """A list of names with its marks unified and its line ends kept; null becomes empty."""
    c = F.translate(F.coalesce(c, F.lit("")), "".join(a for a, _ in SPLIT_MARKS), "".join(b for _, b in SPLIT_MARKS))
    for old, new in SPLIT_UNITS:
        c = F.replace(c, F.lit(old), F.lit(new))
    for pattern, new in SPLIT_SPACING:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def _unlabelled(label: str, x: Column) -> Column:
    return F.when(F.startswith(F.lower(x), F.lit(label)), F.btrim(F.substr(x, F.lit(len(label) + 1)), F.lit(" :-"))).otherwise(x)


def plain_name(c: Column) -> Column:
    """A name of either source before they are merged: marks at the ends and labels in front go; null becomes empty."""
    c = F.btrim(strip(F.translate(F.coalesce(c, F.lit("")), "，、；ㆍ：", ",,;·:")), F.lit(" ,.;:/·-[]{}()"))
    for label in NAME_LABELS:
        c = bound(c, partial(_unlabelled, label))
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def any_word(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, by their first characters, so that most places are told by one look."""
    by_first: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        by_first.setdefault(w[0], []).append(_quoted(w[1:]))
    branches = "|".join(f"{_quoted(k)}(?:{'|'.join(rest)})" for k, rest in by_first.items())
    return f"(?=[{''.join(_quoted(k) if k not in '-&' else chr(92) + k for k in by_first)}])(?:{branches})"


#: From so many words on, each is looked for by itself instead of by one pattern.
MANY_WORDS = 16


def _first_at(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """The place, from 1, of the earliest first occurrence, after the start, of any of the words; null if there is none."""
    longest, made = max(map(len, words)), []

    def each(text: str) -> Iterator[tuple[int, str]]:
        """The last place and the word of each occurrence, by an automaton of all words; without its library, of first ones, word by word."""
        try:
            import ahocorasick
        except ImportError:
            return iter(sorted((text.find(w) + len(w) - 1, w) for w in words if w in text))
        if not made:
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            made.append(automaton)
        return made[0].iter(text)

    def at(text: str | None) -> int | None:
        best, met = None, set()
        for end, w in each(text or ""):
            if best is not None and end - longest + 1 >= best:
                break
            if w not in met:
                met.add(w)
                start = end - len(w) + 1
                if start and (best is None or start < best):
                    best = start
        return None if best is None else best + 1

    # Rows in small batches, not in Arrow's: texts may be long.
    return F.udf(at, "int", useArrow=False)


def until_keyword(c: Column, words: tuple[str, ...]) -> Column:
    """The text before the earliest first occurrence, after the start, of any of the words. With MANY_WORDS, for no lambda."""
    lowered = tuple(dict.fromkeys(w.lower() for w in words))
    if len(lowered) >= MANY_WORDS:
        place = _first_at(lowered)(F.lower(c))
        return F.when(place.isNull(), c).otherwise(strip(F.substring(c, F.lit(1), place - 1)))
    pattern, every = any_word(lowered), F.array(*(F.lit(w) for w in lowered))

    def least(text: Column) -> Column:
        quick = bound(F.regexp_extract(text, f"(?s)^(.+?){pattern}", 1), lambda head: F.when(head != "", F.length(head) + 1))
        # A word that the text begins with has its first occurrence there, and does not count later on.
        exact = F.array_min(F.filter(F.transform(every, lambda w: F.position(w, text)), lambda p: p > 1))
        return F.when(text.rlike(f"^{pattern}"), exact).otherwise(quick)

    return bound(bound(F.lower(c), least), lambda at: F.when(at.isNull(), c).otherwise(strip(F.substring(c, F.lit(1), at - 1))))


def with_scheme(c: Column) -> Column:
    """https:// before www. or a bare domain."""
    return bound(strip(c), _schemed)


def _schemed(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^https?://"), c).when(c.rlike(r"(?i)^(?:www\.|[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+(?:[/?#:].*)?$)"), F.concat(F.lit("https://"), c)).otherwise(c)


def mended_url(c: Column) -> Column:
    """Spaces within a scheme, after www and around dots and slashes go."""
    for pattern, new in ((r"(?i)h\s*t\s*t\s*p\s*(s?)\s*:\s*/\s*/\s*", "http$1://"), (r"(?i)w\s*w\s*w\s*\.\s*", "www."), (r"(?i)\s*\.\s*(com|co|kr|net|org|io|ai)(?![a-z])", ".$1"), (r"(?i)\.co\s*\.\s*kr", ".co.kr")):
        c = F.regexp_replace(c, pattern, new)
    return c


#: The entities that are unescaped.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Tags out, common entities unescaped, white space collapsed."""
    return strip(F.regexp_replace(replaced(F.regexp_replace(c, "<[^>]+>", " "), ENTITIES), r"(?U)\s+", " "))


def html_title(html: Column) -> Column:
    return html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_description(html: Column) -> Column:
    """The first that is there of: description, og:description, either with its attributes the other way round."""
    tries = []
    for name in ("description", "og:description"):
        tries += [rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]+content=["'](.*?)["']""", rf"""(?is)<meta[^>]+content=["'](.*?)["'][^>]+(?:name|property)=["']{name}["']"""]
    return F.coalesce(*(F.nullif(html_text(F.regexp_extract(html, p, 1)), F.lit("")) for p in tries), F.lit(""))


def decoded(body: Column, charsets: tuple[str, ...] = ("UTF-8",)) -> Column:
    """The first decoding without replacement characters, else the first."""
    each = [F.decode(body, c) for c in charsets]
    return F.coalesce(*(F.when(~F.contains(x, F.lit("�")), x) for x in each), each[0])


def safe_file_name(c: Column) -> Column:
    return F.translate(c, '\\/:*?"<>| ', "__________")


def json_object(c: Column) -> Column:
    """From the first { to the last }, outside of code fences; smart quotes and trailing commas are mended if it fails to parse."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.translate(inner, "“”‘’", "\"\"''"), r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(F.nullif(inner, F.lit(""))), F.try_parse_json(F.nullif(mended, F.lit(""))))


def lenient(v: Column, keys: tuple[str, ...], kind: str = "string") -> Column:
    """The first non-blank of several keys of a VARIANT object."""
    return F.coalesce(*(F.nullif(strip(F.try_variant_get(v, f"$.{k}", kind)), F.lit("")) for k in keys))


def either(first: Column, second: Column, default: str = UNKNOWN) -> Column:
    return F.coalesce(known(first), known(second), F.lit(default))


__all__ = [n for n in dir() if not n.startswith("_")] + ["SENTINELS"]
