"""Tables, columns and stars named by the SQL texts of a query log.

A text-level reading for screening logs in bulk: it over-approximates columns, so a
verdict is at most stricter than the query deserves. Queries that really run are held
by role views (``operators.governed``), which do not depend on this.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import bind

_NAME = r"[a-z_][a-z0-9_]*(?:[.][a-z_][a-z0-9_]*)*"
_ALIASED = rf"{_NAME}(?:\s+(?:as\s+)?[a-z_][a-z0-9_]*)?"
NOISE = r"(?s)'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/"
FROM_LIST = rf"\bfrom\s+({_ALIASED}(?:\s*,\s*{_ALIASED})*)"
JOINED = rf"\bjoin\s+({_NAME})"
TOKEN = r"[a-z_][a-z0-9_]*"
SELECT_STAR = r"(?:\bselect|\bdistinct|\ball|,)\s*[*]|[.]\s*[*]"


def clean_sql(query: Column) -> Column:
    """Lower case, without comments, string literals and identifier quotes."""
    return F.lower(F.regexp_replace(F.regexp_replace(query, NOISE, " "), r'["`]', ""))


def _unparseable(clean: Column) -> Column:
    opened = F.length(clean) - F.length(F.replace(clean, F.lit("("), F.lit("")))
    closed = F.length(clean) - F.length(F.replace(clean, F.lit(")"), F.lit("")))
    return (opened != closed) | F.contains(clean, F.lit("'")) | F.contains(clean, F.lit("/*"))


def sql_references(query: Column) -> Column:
    """``struct<tables,columns,star>``, names lower-cased and sorted. A text without a
    table or with open parentheses, quotes or comments refers to ``__UNPARSEABLE__``."""

    def read(clean: Column) -> Column:
        listed = F.flatten(
            F.transform(F.regexp_extract_all(clean, F.lit(FROM_LIST), F.lit(1)), lambda part: F.split(part, ","))
        )
        named = F.concat(
            F.transform(listed, lambda item: F.regexp_extract(item, _NAME, 0)),
            F.regexp_extract_all(clean, F.lit(JOINED), F.lit(1)),
        )
        tables = F.array_sort(F.array_distinct(F.transform(named, lambda n: F.substring_index(n, ".", -1))))
        return F.struct(
            F.when(_unparseable(clean) | (F.size(tables) == 0), F.array(F.lit(fixed.UNPARSEABLE)))
            .otherwise(tables).alias("tables"),
            F.array_sort(F.array_distinct(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)))).alias("columns"),
            F.rlike(clean, F.lit(SELECT_STAR)).alias("star"),
        )

    return bind(clean_sql(query), read)


def is_select(query: Column) -> Column:
    return F.rlike(query, F.lit(r"^\s*(?i:select)"))
