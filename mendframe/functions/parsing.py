"""Reading actions out of free text and writing prompts as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_ACTION = "query_analyst"
INVALID_AGENT = "__invalid__"


def strict_action(response: Column) -> Column:
    """The ``action`` of a response that is one JSON object, else the fallback action."""
    text = F.trim(response)
    whole_object = text.startswith("{") & F.try_parse_json(text).isNotNull()
    action = F.when(whole_object, F.get_json_object(text, "$.action"))
    return F.coalesce(action, F.lit(FALLBACK_ACTION))


def first_object(text: Column) -> Column:
    """First ``{...}`` span without a nested closing brace; may run over line ends."""
    return F.regexp_extract(text, r"\{[^}]+\}", 0)


def lenient_field(text: Column, field: str) -> Column:
    """A field of the first JSON object found anywhere in the text, else null."""
    span = first_object(text)
    return F.when(F.try_parse_json(span).isNotNull(), F.get_json_object(span, f"$.{field}"))


def lenient_agent(text: Column) -> Column:
    return F.coalesce(lenient_field(text, "agent"), F.lit(INVALID_AGENT))
