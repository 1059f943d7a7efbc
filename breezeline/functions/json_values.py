"""Strict reading of JSON text through VARIANT.

VARIANT extraction converts freely ("42" becomes 42), so each value's own type
is tested first and only then extracted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parsed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the VARIANT of a text that is exactly one JSON value, else NULL.

    The parser ignores what follows the first value. Wrapping the text in an
    array whose second element is the text's own digest exposes any rest.
    """
    wrapped = F.concat(F.lit("["), F.col(text), F.lit(","), F.col("_digest").cast("string"), F.lit("]"))
    alone = F.try_variant_get("_pair", "$[1]", "bigint") == F.col("_digest")
    return (
        rows.withColumn("_digest", F.xxhash64(text))
        .withColumn("_pair", F.try_parse_json(wrapped))
        .withColumn(name, F.when(alone, F.try_variant_get("_pair", "$[0]", "variant")))
        .drop("_pair", "_digest")
    )


def computed_once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept and the given columns, each value computed a single time.

    A filter on a plain computed column is moved below it by copying the whole
    expression, so every JSON path in it would parse again. Passing the values
    through a one-element array stops that.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*keep, F.inline(F.array(made)))


def members(value: Column, names: Sequence[str]) -> Column:
    """Struct of the named members as VARIANTs; NULL unless value is an object."""
    fields = ", ".join(f"`{n}` variant" for n in names)
    return F.try_variant_get(value, "$", f"struct<{fields}>")


def elements(value: Column) -> Column:
    """Array of VARIANT elements; NULL unless value is an array."""
    return F.try_variant_get(value, "$", "array<variant>")


ABSENT = "VOID"


def kind(value: Column) -> Column:
    """Type name of a VARIANT; ABSENT when it is missing or JSON null."""
    return F.coalesce(F.schema_of_variant(value), F.lit(ABSENT))


def kind_if_present(value: Column) -> Column:
    """Type name of a VARIANT; NULL when missing, ABSENT only for JSON null."""
    return F.schema_of_variant(value)


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text_or_empty(value: Column) -> Column:
    """A text value; empty for anything else (which is then not written out)."""
    return F.when(kind(value) == "STRING", text_of(value)).otherwise("")


def double_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def long_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "bigint")


def int_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "int")


def accepts_text(kind: Column) -> Column:
    return kind.isin("STRING", ABSENT)


def accepts_whole(kind: Column) -> Column:
    """Absent, or an integer literal that fits a long."""
    return kind.isin("BIGINT", ABSENT)


def accepts_double(kind: Column, value: Column) -> Column:
    """Absent, or a number within the range of a double."""
    number = F.left(kind, F.lit(3)).isin("BIG", "DEC", "DOU", ABSENT[:3])
    return number & F.coalesce(F.abs(double_of(value)) < F.lit(float("inf")), F.lit(True))


def is_shape(parsed: Column, value: Column) -> Column:
    """Read as an object or array, or absent."""
    return parsed.isNotNull() | (kind(value) == ABSENT)
