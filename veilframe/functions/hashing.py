"""Hashes, deterministic ids and role-to-policy lookups as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed


def sha256_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sha256_short(text: Column, length: int = 8, salt: str = "") -> Column:
    """Pseudonym of a value. Eight hex digits collide near 77 000 distinct values and
    are guessable unsalted; raise ``length`` or set ``salt`` where that matters."""
    salted = F.concat(F.lit(salt), text) if salt else text
    return F.substring(F.sha2(salted, 256), 1, length)


def uuid_from(*parts: Column) -> Column:
    """UUID-shaped id of the parts: a retried task writes the same id again."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.regexp_replace(
        F.substring(digest, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def sql_string(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def literal_map(values: Mapping[str, str | tuple[str, ...] | dict[str, str]]) -> Column:
    """A foldable map literal for lookups in small rule tables (no join needed)."""

    def literal(value) -> str:
        if isinstance(value, dict):
            return "named_struct(" + ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in value.items()) + ")"
        if isinstance(value, (tuple, list)):
            return "cast(array(" + ", ".join(map(sql_string, value)) + ") as array<string>)"
        return sql_string(value)

    return F.expr("map(" + ", ".join(f"{sql_string(k)}, {literal(v)}" for k, v in values.items()) + ")")


def policy_mode(role: Column) -> Column:
    return F.when(role == "compliance_officer", "strict").otherwise("permissive")


def policy_for_mode(mode: Column) -> Column:
    return F.when(mode == "strict", "strict_financial").otherwise("permissive_analyst")


def policy_for_role(role: Column) -> Column:
    return F.try_element_at(literal_map(fixed.ROLE_POLICY), role)


def audit_action(action: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.AUDIT_ACTION), action), F.lit("allow"))


def actor(role: Column, user_id: Column, session_id: Column) -> Column:
    return F.struct(role.alias("role"), user_id.alias("user_id"), session_id.alias("session_id"))
