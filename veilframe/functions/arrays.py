"""Array helpers shared by the span functions: bind, scan and explode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fold that grows one array copies it at every step. Folding CHUNK elements at a
# time and flattening the chunks keeps that cost near linear for span-rich texts.
CHUNK = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and let ``body`` use it several times."""
    return F.get(F.transform(F.array(value), body), 0)


def empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def chunk_starts(items: Column) -> Column:
    """1-based first positions of the chunks; callers exclude the empty array."""
    return F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))


def scan(
    items: Column,
    start: Column,
    advance: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    out_type: str,
) -> Column:
    """Left-to-right scan of a non-empty array with a scalar state.

    ``emit(state, item)`` gives the (zero or more) outputs of an item from the
    state before it, ``advance(state, item)`` the state after it.
    """

    def within(acc: Column, item: Column) -> Column:
        return F.struct(
            advance(acc["state"], item).alias("state"),
            F.concat(acc["out"], emit(acc["state"], item)).alias("out"),
        )

    def across(acc: Column, first: Column) -> Column:
        part = F.aggregate(
            F.slice(items, first, F.lit(CHUNK)),
            F.struct(acc["state"].alias("state"), empty(out_type).alias("out")),
            within,
        )
        return bind(
            part,
            lambda p: F.struct(
                p["state"].alias("state"),
                F.concat(acc["out"], F.array(p["out"])).alias("out"),
            ),
        )

    zero = F.struct(start.alias("state"), empty(f"array<{out_type}>").alias("out"))
    return F.flatten(F.aggregate(chunk_starts(items), zero, across)["out"])


def explode_rows(df: DataFrame, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element. Outer explode plus a filter on the element, because an
    inner explode makes the optimizer evaluate ``items`` a second time in a filter."""
    if position is None:
        out = df.select("*", F.explode_outer(items).alias(name))
    else:
        out = df.select("*", F.posexplode_outer(items).alias(position, name))
    return out.filter(F.col(name).isNotNull())
