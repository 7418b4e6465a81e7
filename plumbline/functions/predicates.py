"""Name and value predicates: each takes a Column and returns a boolean Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V


def _named(pattern: str):
    def predicate(name: Column) -> Column:
        return F.lower(name).rlike(pattern)
    return predicate


def key_like(name: Column) -> Column:
    """Ends in an id or key word; case matters, so ``paid`` is not a key and ``orderId`` is."""
    return name.rlike(V.KEY_NAME)


model_key_like = _named(V.MODEL_KEY_SUFFIX)
date_like = _named(V.DATE_NAME)
number_prefix = _named(V.NUMBER_PREFIX)
sensitive_name = _named(V.SENSITIVE_NAME)
boolean_like = _named(V.BOOLEAN_NAME)
free_text_name = _named(V.FREE_TEXT_NAME)
guid_name = _named(V.GUID_NAME)
timestamp_name = _named(V.TIMESTAMP_NAME)
date_table_name = _named(V.DATE_TABLE_NAME)


def number_like(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(V.NUMBER_NAME) & ~low.rlike(V.NUMBER_NAME_EXCEPT)


def created_column(name: Column) -> Column:
    return F.lower(name).isin(*V.CREATED_NAMES)


def updated_column(name: Column) -> Column:
    return F.lower(name).isin(*V.UPDATED_NAMES)


def audit_column(name: Column) -> Column:
    return created_column(name) | updated_column(name)


def bad_identifier(name: Column) -> Column:
    return name.rlike(V.BAD_IDENTIFIER)


def layer(name: Column) -> Column:
    """bronze, silver or gold by the first class with a word in the name, else null."""
    low = F.lower(name)
    picks = [F.when(low.rlike("|".join(words)), F.lit(label)) for label, words in V.LAYER_WORDS]
    return F.coalesce(*picks)


def user_schema(schema: Column) -> Column:
    return ~schema.isin(*V.SYSTEM_SCHEMAS)


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def whole_word_size(value: Column) -> Column:
    """Human-readable size of a byte count, for the few rows of a report."""
    units = ((V.GB * 1024, "TB"), (V.GB, "GB"), (V.MB, "MB"), (1024, "KB"))
    shown = [F.when(value >= size, F.concat(F.format_number(value / size, 1), F.lit(f" {unit}")))
             for size, unit in units]
    return F.coalesce(*shown, F.concat(F.format_number(value, 0), F.lit(" B")))
