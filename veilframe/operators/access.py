"""Role-based access control over request tables and column sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import bind, empty
from veilframe.functions.hashing import literal_map
from veilframe.functions.references import sql_references

_NAMES = "array<string>"


@dataclass(frozen=True)
class AccessRules:
    """What each role may use. A role or table without a column entry sees every column."""

    tools: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: fixed.ROLE_TOOLS)
    tables: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: fixed.ROLE_TABLES)
    columns: Mapping[str, Mapping[str, tuple[str, ...]]] = field(default_factory=lambda: fixed.ROLE_COLUMNS)
    restricted: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: fixed.RESTRICTED_COLUMNS)
    api_restricted: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: fixed.ROLE_API_RESTRICTED)

    def allowed(self, role: str, table: str) -> tuple[str, ...]:
        return tuple(self.columns.get(role, {}).get(table, ()))

    def hidden(self, role: str, table: str, columns: Iterable[str]) -> tuple[str, ...]:
        """Columns of a table that the role may not see: all that its list, if it has one, does
        not name."""
        allowed = self.allowed(role, table)
        return tuple(c for c in columns if allowed and c not in allowed)


def _map_of(values: Mapping[str, tuple[str, ...]]) -> Column:
    return literal_map(values) if values else F.create_map().cast("map<string,array<string>>")


def _lookup(values: Mapping[str, tuple[str, ...]], key: Column) -> Column:
    return F.coalesce(F.try_element_at(_map_of(values), key), empty(_NAMES))


def _pair_key(role: Column, table: Column) -> Column:
    return F.concat(role, F.lit("|"), table)


def _pairs(values: Mapping[str, Mapping[str, tuple[str, ...]]]) -> dict[str, tuple[str, ...]]:
    return {f"{role}|{table}": tuple(cols) for role, per in values.items() for table, cols in per.items()}


def allowed_columns(rules: AccessRules, role: Column, table: Column) -> Column:
    return _lookup(_pairs(rules.columns), _pair_key(role, table))


def restricted_columns(rules: AccessRules, role: Column, table: Column) -> Column:
    """All restricted columns of the table minus the allowed ones; none without an entry."""
    return bind(
        allowed_columns(rules, role, table),
        lambda allowed: F.when(F.size(allowed) == 0, empty(_NAMES)).otherwise(
            F.array_except(_lookup(rules.restricted, table), allowed)
        ),
    )


def filter_columns(rules: AccessRules, role: Column, table: Column, columns: Column) -> Column:
    """Columns the role may see in one table: an intersection, or all without an entry.
    An unknown role sees none."""
    known = F.coalesce(F.try_element_at(_map_of(rules.tools), role).isNotNull(), F.lit(False))
    return bind(
        allowed_columns(rules, role, table),
        lambda allowed: F.when(~known, empty(_NAMES))
        .when(F.size(allowed) == 0, columns)
        .otherwise(F.array_intersect(columns, allowed)),
    )


def visible_columns(rules: AccessRules, role: Column, tables: Column, columns: Column) -> Column:
    """Output columns over several tables: kept if any of the tables allows it."""
    return F.aggregate(
        tables,
        empty(_NAMES),
        lambda seen, table: F.array_union(seen, filter_columns(rules, role, table, columns)),
    )


def tool_reason(rules: AccessRules, role: Column, tool: Column, family: bool = True) -> Column:
    """Why a role may not use a tool, or null. With ``family`` a permission for
    ``customer_api`` covers its lookup and search forms."""
    asked = F.when(tool.isin(*fixed.API_TOOLS), "customer_api").otherwise(tool) if family else tool
    tools = F.try_element_at(_map_of(rules.tools), role)
    listed = F.concat(F.lit("{'"), F.array_join(F.array_sort(tools), "', '"), F.lit("'}"))
    return (
        F.when(tools.isNull(), F.concat(F.lit("Unknown role: "), role))
        .when(
            ~F.array_contains(tools, asked),
            F.concat(
                F.lit("Role '"), role, F.lit("' does not have access to tool '"), tool,
                F.lit("'. Allowed tools: "), F.when(F.size(tools) == 0, "none").otherwise(listed),
            ),
        )
    )


def table_reason(rules: AccessRules, role: Column, tables: Column) -> Column:
    """First referenced table (by name) outside the role's set. An empty set does not restrict."""
    allowed = _lookup(rules.tables, role)
    denied = F.filter(tables, lambda t: (F.size(allowed) > 0) & ~F.array_contains(allowed, t))
    return F.when(
        F.size(denied) > 0,
        F.concat(
            F.lit("Table '"), F.array_min(denied), F.lit("' is not accessible for role '"), role, F.lit("'")
        ),
    )


def column_reason(rules: AccessRules, role: Column, tables: Column, columns: Column, star: Column) -> Column:
    """First named column that is restricted for the role on a referenced table. A
    selected ``*`` lifts the check, as the output drops such columns; COUNT(*) does not."""
    denied = F.flatten(
        F.transform(
            tables,
            lambda t: F.transform(
                F.array_intersect(restricted_columns(rules, role, t), columns),
                lambda c: F.concat(
                    F.lit("Column '"), c, F.lit("' in table '"), t,
                    F.lit("' is restricted for role '"), role, F.lit("'"),
                ),
            ),
        )
    )
    return F.when(~star, F.array_min(denied))


def requested_fields(fields: Column) -> Column:
    """Comma-separated field list -> trimmed names."""
    return F.when(fields.isNull(), empty(_NAMES)).otherwise(
        F.transform(F.split(fields, ","), lambda f: F.btrim(f, F.lit(" \t\n\r\f\v")))
    )


def field_reason(rules: AccessRules, role: Column, fields: Column) -> Column:
    """First requested API field that is restricted for the role."""
    restricted = _lookup(rules.api_restricted, role)
    hits = F.filter(fields, lambda f: F.array_contains(restricted, F.lower(f)))
    return F.when(
        F.size(hits) > 0,
        F.concat(F.lit("Field '"), F.get(hits, 0), F.lit("' is restricted for role '"), role, F.lit("'")),
    )


def rbac_reason(
    role: Column,
    tool: Column,
    query: Column | None = None,
    fields: Column | None = None,
    rules: AccessRules = AccessRules(),
    family: bool = True,
) -> Column:
    """First failing check, cheapest first (tool, tables, columns, fields); null = granted."""
    reasons = [tool_reason(rules, role, tool, family)]
    if query is not None:
        by_sql = bind(
            sql_references(query),
            lambda r: F.coalesce(
                table_reason(rules, role, r["tables"]),
                column_reason(rules, role, r["tables"], r["columns"], r["star"]),
            ),
        )
        reasons.append(F.when((tool == "sql_query") & query.isNotNull(), by_sql))
    if fields is not None:
        reasons.append(
            F.when(tool.isin(*fixed.API_TOOLS), field_reason(rules, role, requested_fields(fields)))
        )
    return F.coalesce(*reasons)


def denial_text(role: Column, tool: Column, reason: Column) -> Column:
    return F.concat(F.lit("RBAC denied: role="), role, F.lit(", tool="), tool, F.lit(" — "), reason)
