"""Answers of models, JSON that drifts, onto a fixed struct: what does not fit is told, and nothing fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import UNKNOWN
from .arrays import strip
from .text import bound, json_object

#: What an answer says for "nothing", in small letters.
NOTHING = ("", UNKNOWN, "없음", "null", "none", "n/a", "na", "unknown")

#: The fields of an answer about a label.
ANSWER = {
    "product_name": "text", "capacity": "text", "ingredients": "list", "usage": "list", "cautions": "list", "effects": "list", "qr_codes": "list", "urls": "list",
}


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(?:" + "|".join(kinds) + ")"), F.lit(False))


def _elements(v: Column) -> Column:
    """A list's elements; anything else is a list of one; missing and null: none."""
    none = F.array().cast("array<variant>")
    return F.when(v.isNull() | _is(v, "VOID"), none).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))


def _texts(elements: Column) -> Column:
    """Plain elements as texts, ends stripped, those that say nothing left out, once each."""
    plain = F.filter(elements, lambda e: e.isNotNull() & ~_is(e, "OBJECT", "ARRAY", "VOID"))
    texts = F.transform(plain, lambda e: strip(F.try_variant_get(e, "$", "string")))
    return F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & ~F.lower(t).isin(*NOTHING)))


def _field(own: Column, name: str, kind: str) -> Column:
    """struct(value, misfit) of a field's VARIANT, each part worked out once."""
    told = lambda bad: F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(kind).alias("expected"), F.to_json(own).alias("found")))
    if kind == "number":
        return bound(F.try_variant_get(own, "$", "double"), lambda n: F.struct(n.alias("value"), told(n.isNull() & own.isNotNull() & ~_is(own, "VOID")).alias("misfit")))
    value = lambda texts: texts if kind == "list" else F.coalesce(F.get(texts, F.lit(0)), F.lit(UNKNOWN))
    return bound(_elements(own), lambda e: F.struct(bound(_texts(e), value).alias("value"), told(F.exists(e, lambda x: _is(x, "OBJECT", "ARRAY"))).alias("misfit")))


def projected(v: Column, fields: dict[str, str] = ANSWER, raw: Column | None = None) -> Column:
    """A VARIANT as struct(success, fields..., misfits, error).

    Kinds: text (the first text of a list; UNKNOWN for nothing), list (of texts, once each), number (null for nothing). misfits
    are (field, expected, found) of the fields that hold an object or a list of such, or no number; what does fit of such a
    field is kept. If v is no object, all fields are empty and error tells why; raw tells missing text from text that is not JSON.
    """
    error = F.when(F.lit(False), F.lit(""))
    if raw is not None:
        error = error.when(raw.isNull() | (F.trim(raw) == ""), "no answer")

    def told(v: Column) -> Column:
        good = _is(v, "OBJECT")

        def field(name: str, kind: str) -> Column:
            return bound(F.when(good, F.try_variant_get(v, f"$.{name}", "variant")), lambda own: _field(own, name, kind)).alias(name)

        each = [field(*x) for x in fields.items()]
        return F.struct(good.alias("success"), v.isNull().alias("missing"), *each)

    def out(r: Column) -> Column:
        misfits = F.filter(F.array(*(r[n]["misfit"] for n in fields)), lambda m: m.isNotNull())
        wrong = F.when(~r["success"], error.when(r["missing"], "no JSON object").otherwise("not an object"))
        return F.struct(r["success"].alias("success"), *(r[n]["value"].alias(n) for n in fields), misfits.alias("misfits"), wrong.alias("error"))

    return bound(bound(v, told), out)


def answers(text: Column, fields: dict[str, str] = ANSWER) -> Column:
    """projected, of the JSON object in a text: code fences, smart quotes and trailing commas do no harm."""
    return projected(json_object(F.coalesce(text, F.lit(""))), fields, text)
