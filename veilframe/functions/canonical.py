"""Canonical JSON text of rows: sorted keys, ``", "`` and ``": "`` separators, nulls
kept, numbers in shortest form. PII offsets in results refer to this text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import fixed_values as fixed
from veilframe.functions.hashing import sql_string


def json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


# The per-column texts are SQL: one expression string per row is much cheaper to build
# than a column object per key and separator.


def _string_sql(value: str) -> str:
    wrapped = f"to_json(named_struct('v', {value}))"
    return f"substr({wrapped}, 6, length({wrapped}) - 6)"


def _float_sql(value: str) -> str:
    """Plain notation between 1e-4 and 1e16, else the form ``1.5e+20``."""
    shown = f"cast({value} as string)"
    power = f"cast(regexp_extract({shown}, 'E(-?[0-9]+)$', 1) as int)"
    mantissa = f"regexp_replace(regexp_extract({shown}, '^-?([0-9.]+)E', 1), '[.]0$', '')"
    digits = f"replace({mantissa}, '.', '')"
    sign = f"if({value} < 0, '-', '')"
    whole = f"substr(rpad({digits}, {power} + 1, '0'), 1, {power} + 1)"
    fraction = f"if(length({digits}) > {power} + 1, substr({digits}, {power} + 2), '0')"
    exponent = f"if({power} < 0, 'e-', 'e+') || lpad(cast(abs({power}) as string), greatest(2, length(cast(abs({power}) as string))), '0')"
    return (
        f"case when not contains({shown}, 'E') then {shown} "
        f"when {power} between 0 and 15 then {sign} || {whole} || '.' || {fraction} "
        f"when {power} = -4 then {sign} || '0.000' || {digits} "
        f"else {sign} || {mantissa} || {exponent} end"
    )


def value_sql(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL text of the JSON form of the SQL expression ``value``."""
    if isinstance(dtype, T.StructType):
        body = object_sql({f.name: (f"{value}.`{f.name}`", f.dataType) for f in dtype.fields}, depth)
    elif isinstance(dtype, T.ArrayType):
        item = f"x{depth}"
        body = f"'[' || array_join(transform({value}, {item} -> {value_sql(item, dtype.elementType, depth + 1)}), ', ') || ']'"
    elif isinstance(dtype, (T.BooleanType, T.IntegralType)):
        body = f"cast({value} as string)"
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        body = _float_sql(value)
    elif isinstance(dtype, T.BinaryType):
        body = _string_sql(f"decode({value}, 'UTF-8')")
    elif isinstance(dtype, T.MapType):
        body = f"to_json({value})"
    elif isinstance(dtype, T.NullType):
        return "'null'"
    else:
        body = _string_sql(f"cast({value} as string)")
    return f"if({value} is null, 'null', {body})"


def object_sql(fields: dict[str, tuple[str, T.DataType]], depth: int = 0) -> str:
    parts = []
    for i, name in enumerate(sorted(fields)):
        value, dtype = fields[name]
        key = name.replace("\\", "\\\\").replace('"', '\\"')
        parts += [sql_string(f'{", " if i else "{"}"{key}": '), value_sql(value, dtype, depth)]
    return "concat(" + ", ".join(parts or ["'{'"]) + ", '}')"


def row_json(schema: T.StructType, drop: tuple[str, ...] = (), source: dict[str, str] | None = None) -> Column:
    """Canonical JSON object of the top-level columns of a frame. ``source`` names the
    columns that hold a field under another name."""
    source = source or {}
    return F.expr(
        object_sql({f.name: (f"`{source.get(f.name, f.name)}`", f.dataType) for f in schema.fields if f.name not in drop})
    )


def error_json(message: Column) -> Column:
    return F.concat(F.lit('{"error": '), json_string(message), F.lit("}"))


def truncate(text: Column, max_chars: int) -> Column:
    """Cut a text over ``max_chars`` characters and mark the cut."""
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(fixed.TRUNCATED))
    ).otherwise(text)
