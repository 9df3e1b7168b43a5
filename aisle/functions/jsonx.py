"""Reading model output: JSON objects inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of the ranked list are read one by one, so that one of another type costs no other.
RECOMMENDATION_SCHEMA = "recommended_item_ids array<string>, ranked_items array<string>"
RANKED_ITEM_SCHEMA = "item_id string, rank int, reason string, confidence double"
EXPLANATION_SCHEMA = (
    "explanations array<struct<item_id:string,explanation:string,evidence_item_ids:array<string>,"
    "evidence_fields:array<string>,confidence:double>>"
)


def extract_json(text: Column | str) -> Column:
    """The fenced object, else the span from the first to the last brace, else the whole text."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(raw)


def is_json_object(text: Column) -> Column:
    """Whether the text parses and is an object rather than a list or a plain value."""
    # the schema of the whole value is not needed for that
    opened = F.regexp_like(text, F.lit(r"\A[ \t\r\n]*\{"))
    return F.coalesce(opened & F.try_parse_json(text).isNotNull(), F.lit(False))


def is_object(value: Column) -> Column:
    """Whether a variant is an object; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def member(value: Column | str, name: str) -> Column:
    """Member of a variant object, of whatever type it is; null when absent or null."""
    own = F.col(value) if isinstance(value, str) else value
    found = F.try_variant_get(own, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


def text_of(value: Column) -> Column:
    """Any value as text: truth values as True and False, lists and objects as JSON."""
    truth = F.try_variant_get(value, "$", "boolean")
    plain = F.try_variant_get(value, "$", "string")
    is_truth = F.schema_of_variant(value) == "BOOLEAN"
    return F.when(is_truth, F.when(truth, "True").otherwise("False")).otherwise(plain)


def truthy_text(value: Column) -> Column:
    """``text_of`` with empty texts, lists and objects, zero and false as null."""
    text = text_of(value)
    kind = F.schema_of_variant(value)
    empty = (
        F.when(kind == "STRING", text == "")
        .when(kind == "BOOLEAN", text == "False")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), text.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, "$", "double") == 0)
    )
    return F.when(~F.coalesce(empty, F.lit(False)), text)


def texts_of(value: Column) -> Column:
    """Distinct trimmed texts of a list, or of a single value as a list; null entries read None."""
    kind = F.schema_of_variant(value)
    listed = F.try_variant_get(value, "$", "array<variant>")
    one = F.array(text_of(value))
    many = F.transform(listed, lambda x: F.coalesce(text_of(x), F.lit("None")))
    texts = F.when(value.isNull(), F.array().cast("array<string>")).otherwise(
        F.when(kind.startswith("ARRAY"), many).otherwise(one)
    )
    return F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""))


def number_of(value: Column) -> Column:
    """Numbers, truth values and numeric texts as a double, anything else as null."""
    text = text_of(value)
    return F.when(F.schema_of_variant(value) == "BOOLEAN", (text == "True").cast("double")).otherwise(
        F.trim(text).try_cast("double")
    )
