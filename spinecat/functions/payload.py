"""JSON payload access with the truth rules of the stored event payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as "nothing": null, false, zero, and empty strings or containers.
_NOTHING = r"^(null|false|\"\"|\[\]|\{\}|-?0+(\.0*)?([eE][+-]?\d+)?)$"


def decode(col: Column | str) -> Column:
    """Any text to a variant; what does not parse counts as an empty object."""
    return F.coalesce(F.try_parse_json(col), F.parse_json(F.lit("{}")))


def field(payload: Column, name: str) -> Column:
    """JSON text of one member, NULL when it is missing."""
    return F.to_json(F.try_variant_get(payload, f"$.{name}", "variant"))


def is_text(payload: Column, name: str) -> Column:
    return F.coalesce(field(payload, name).startswith('"'), F.lit(False))


def text(payload: Column, name: str) -> Column:
    """Value of a string member; any other type is NULL."""
    return F.when(
        is_text(payload, name), F.try_variant_get(payload, f"$.{name}", "string")
    )


def equals(payload: Column, name: str, value: str) -> Column:
    return F.coalesce(text(payload, name) == value, F.lit(False))


def counts(rendered: Column) -> Column:
    """Truth of a member's JSON text; NULL (missing) does not count."""
    return F.coalesce(~rendered.rlike(_NOTHING), F.lit(False))


def truthy(payload: Column, name: str) -> Column:
    return counts(field(payload, name))


def zero(payload: Column, name: str) -> Column:
    """Missing, null or zero-like; the text ``"0"`` is not zero."""
    return ~truthy(payload, name)


def shown_text(rendered: Column, value: Column) -> Column:
    """Display text of a member: nothing when missing, words for null and booleans."""
    return (
        F.when(rendered.isNull(), F.lit(""))
        .when(rendered.startswith('"'), value)
        .when(rendered == "null", F.lit("None"))
        .when(rendered == "true", F.lit("True"))
        .when(rendered == "false", F.lit("False"))
        .otherwise(rendered)
    )


def shown(payload: Column, name: str) -> Column:
    return shown_text(
        field(payload, name), F.try_variant_get(payload, f"$.{name}", "string")
    )
