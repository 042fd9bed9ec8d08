"""A seeded banking data set of any size.

Values come from hashes of the row id, so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed

_LAST = ("Smith", "Jones", "Garcia", "Chen", "Okafor", "Novak", "Rossi", "Larsen", "Silva", "Dubois")
_STREETS = ("Maple", "Oak", "Cedar", "Hill", "Lake", "Park", "Elm", "Mill")
_COMPANIES = ("Harbor Foods", "Northline Energy", "Bluebird Travel", "Stonegate Insurance", "Riverside Clinic")


def _hash(key: Column, salt: str, seed: int) -> Column:
    return F.xxhash64(key, F.lit(salt), F.lit(seed))


def _number(key: Column, salt: str, seed: int, low: int, high: int) -> Column:
    return F.lit(low) + F.pmod(_hash(key, salt, seed), F.lit(high - low + 1))


def _pick(values, key: Column, salt: str, seed: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(_hash(key, salt, seed), F.lit(len(values))).cast("int"))


def _digits(key: Column, salt: str, seed: int, n: int) -> Column:
    return F.lpad(_number(key, salt, seed, 10 ** (n - 1), 10**n - 1).cast("string"), n, "0")


def _phone(key: Column, seed: int) -> Column:
    return F.concat_ws("-", _digits(key, "p1", seed, 3), _digits(key, "p2", seed, 3), _digits(key, "p3", seed, 4))


def _children(parents: DataFrame, key: str, most: int, seed: int, stride: int) -> DataFrame:
    """One to ``most`` children per parent, with dense-enough unique ids."""
    n = _number(F.col(key), f"n-{most}", seed, 1, most).cast("int")
    rows = parents.select(F.col(key), F.explode(F.sequence(F.lit(1), n)).alias("_i"))
    return rows.withColumn("id", (F.col(key) - 1) * stride + F.col("_i"))


def customers(spark: SparkSession, count: int = 100, seed: int = 42) -> DataFrame:
    rows = spark.range(1, count + 1)
    i = F.col("id")
    first, last = _pick(fixed.FIRST_NAMES, i, "first", seed), _pick(_LAST, i, "last", seed)
    birth = F.date_sub(F.lit("2006-01-01").cast("date"), _number(i, "dob", seed, 0, 67 * 365).cast("int"))
    return rows.select(
        "id", first.alias("first_name"), last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), i.cast("string"), F.lit("@example.com")).alias("email"),
        _phone(i, seed).alias("phone"),
        F.concat_ws(" ", _number(i, "no", seed, 1, 9999).cast("string"), _pick(_STREETS, i, "street", seed), _pick(fixed.STREET_TYPES, i, "type", seed)).alias("address"),
        F.concat_ws("-", _digits(i, "s1", seed, 3), _digits(i, "s2", seed, 2), _digits(i, "s3", seed, 4)).alias("ssn"),
        birth.cast("string").alias("date_of_birth"),
    )


def accounts(owners: DataFrame, seed: int = 42) -> DataFrame:
    """One to three accounts per customer."""
    rows = _children(owners.select(F.col("id").alias("customer_id")), "customer_id", 3, seed, 3)
    i = F.col("id")
    return rows.select(
        "id", "customer_id",
        F.concat_ws("-", _digits(i, "a1", seed, 4), _digits(i, "a2", seed, 4), _digits(i, "a3", seed, 4)).alias("account_number"),
        _pick(fixed.ACCOUNT_TYPES, i, "kind", seed).alias("account_type"),
        (_number(i, "balance", seed, 10_000, 50_000_000) / 100.0).alias("balance"),
        F.date_sub(F.lit("2026-01-01").cast("date"), _number(i, "opened", seed, 0, 3650).cast("int")).cast("string").alias("opened_date"),
    )


def transactions(of: DataFrame, seed: int = 42) -> DataFrame:
    """One to five transactions per account, a fifth of them with personal data in the text."""
    rows = _children(of.select(F.col("id").alias("account_id")), "account_id", 5, seed, 5)
    i = F.col("id")
    when = F.timestamp_seconds(F.lit(1735689600) + _number(i, "when", seed, 0, 365 * 86400))
    return rows.select(
        "id", "account_id",
        (_number(i, "amount", seed, -1_000_000, 5_000_000) / 100.0).alias("amount"),
        F.when(F.pmod(_hash(i, "edge", seed), F.lit(5)) == 0, _pick(fixed.PII_DESCRIPTIONS, i, "pii", seed))
        .otherwise(_pick(fixed.NEUTRAL_DESCRIPTIONS, i, "text", seed)).alias("description"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        _pick(_COMPANIES, i, "company", seed).alias("counterparty"),
    )


def advisors(spark: SparkSession, count: int = 20, seed: int = 42) -> DataFrame:
    i = F.col("id")
    first = _pick(fixed.FIRST_NAMES, i, "af", seed)
    return spark.range(1, count + 1).select(
        "id", F.concat_ws(" ", first, _pick(_LAST, i, "al", seed)).alias("name"),
        F.concat(F.lower(first), i.cast("string"), F.lit("@advice.example")).alias("email"),
        _phone(i, seed + 1).alias("phone"), _pick(fixed.REGIONS, i, "region", seed).alias("region"),
    )


def bank(spark: SparkSession, count: int = 100, advisor_count: int = 20, seed: int = 42) -> dict[str, DataFrame]:
    people = customers(spark, count, seed)
    held = accounts(people, seed)
    return {
        "customers": people, "accounts": held, "transactions": transactions(held, seed),
        "advisors": advisors(spark, advisor_count, seed),
    }
