"""Bulk customer lookup (customer with nested accounts) and customer search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.arrays import bind, explode_rows
from veilframe.functions.canonical import error_json, row_json, truncate
from veilframe.operators.access import AccessRules
from veilframe.sources.storage import durable

SEARCH_LIMIT = 100
SEARCH_DEFAULT = 10
# switches the plan only: a frame of so many ids or searches is broadcast, a larger one joined
_SALTS = 16
_BROADCAST_ROWS = 20_000
_BROADCAST_GRAMS = 1_000_000
# lengths of the substrings by which searches are joined to customers
_SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def drop_restricted(df: DataFrame, restricted: tuple[str, ...], nested: str | None = None) -> DataFrame:
    """Drop restricted keys from records and from the structs of a nested array."""
    out = df.drop(*restricted)
    if nested and nested in out.columns:
        fields = [f.name for f in out.schema[nested].dataType.elementType.fields if f.name in restricted]
        if fields:
            out = out.withColumn(nested, F.transform(nested, lambda a: a.dropFields(*fields)))
    return out


def nested_lookup(
    ids: DataFrame,
    customers: DataFrame,
    accounts: DataFrame,
    page_size: int = 1000,
) -> DataFrame:
    """Customers with their accounts nested: ``(customer_id, page, customer, accounts, error)``.

    A customer with up to ``page_size`` accounts gives one row, page 0. One with more
    gives several, the accounts dealt to pages by a hash of their id, so that no task
    ever holds all accounts of a customer with very many of them. Counts ids first, which
    runs a job: the accounts of few ids are kept by a broadcast, before anything is counted.
    """
    wanted = ids.select(F.col("customer_id")).distinct()
    if _at_most(wanted, _BROADCAST_ROWS):
        accounts = accounts.join(F.broadcast(wanted), "customer_id", "left_semi").select(*accounts.columns)
    # counted before any join, so that counts are reduced before they are shuffled
    sizes = (
        accounts.groupBy("customer_id").agg(F.ceil(F.count("*") / page_size).cast("int").alias("pages"))
        .join(wanted, "customer_id")
    )
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    # the explicit repartition lets adaptive execution split a large customer in the join
    paged = (
        accounts.select("customer_id", F.struct(*[F.col(c) for c in accounts.columns]).alias("account"))
        .join(sizes, "customer_id")
        .withColumn("page", F.pmod(F.xxhash64("account.id"), F.col("pages")).cast("int"))
        .repartition("customer_id", "page")
        .groupBy("customer_id", "page")
        .agg(F.array_sort(F.collect_list("account"), by_id).alias("accounts"))
    )
    record = customers.select(
        F.col("id").alias("customer_id"), F.struct(*[F.col(c) for c in customers.columns]).alias("customer")
    )
    found = wanted.join(record, "customer_id", "left").join(paged, "customer_id", "left")
    no_accounts = F.array().cast(T.ArrayType(accounts.select(F.struct("*").alias("a")).schema["a"].dataType))
    return found.select(
        "customer_id",
        F.coalesce("page", F.lit(0)).alias("page"),
        "customer",
        F.when(F.col("customer").isNotNull(), F.coalesce("accounts", no_accounts)).alias("accounts"),
        F.when(F.col("customer").isNull(), _not_found(F.col("customer_id"))).alias("error"),
    )


def _at_most(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def _not_found(customer_id: Column) -> Column:
    return F.concat(
        F.lit('API error: 404 - {"detail":"Customer '), customer_id.cast("string"), F.lit(' not found"}')
    )


def _wrong_limit(limit: Column) -> Column:
    """The refusal of a search limit below 1 or above 100."""
    low = limit < 1
    return F.concat(
        F.lit('API error: 422 - {"detail":[{"type":"'), F.when(low, "greater_than_equal").otherwise("less_than_equal"),
        F.lit('","loc":["query","limit"],"msg":"Input should be '), F.when(low, "greater").otherwise("less"),
        F.lit(" than or equal to "), F.when(low, "1").otherwise(str(SEARCH_LIMIT)), F.lit('","input":"'), limit.cast("string"),
        F.lit('","ctx":{"'), F.when(low, 'ge":1').otherwise(f'le":{SEARCH_LIMIT}'), F.lit("}}]}"),
    )


def _by_role(rules: AccessRules, role: Column, build) -> Column:
    """``build(restricted)`` under the fields restricted for the role of the row."""
    out = None
    for name, fields in rules.api_restricted.items():
        branch = build(tuple(fields))
        out = F.when(role == name, branch) if out is None else out.when(role == name, branch)
    full = build(())
    return full if out is None else out.otherwise(full)


def lookup_outputs(
    calls: DataFrame,
    customers: DataFrame,
    accounts: DataFrame,
    max_chars: int,
    rules: AccessRules = AccessRules(),
) -> DataFrame:
    """``(role, call_key, output, error)`` per distinct (role, customer id in ``call_key``).

    Accounts come in id order. Those that cannot show before the cut at ``max_chars`` are
    dropped by a ranking filter that Spark applies before the shuffle, so a customer with a
    large share of all accounts does not meet in one task. Counts ids first, which runs a job.
    """
    shortest = len(", ".join(f'"{c}": 0' for c in accounts.columns if c not in {f for r in rules.api_restricted.values() for f in r})) + 4
    keep = max_chars // shortest + 2
    wanted = calls.select("role", "call_key", F.col("call_key").try_cast("long").alias("customer_id")).distinct()
    ids = wanted.select("customer_id").filter("customer_id is not null").distinct()
    few = _at_most(ids, _BROADCAST_ROWS)
    # few ids: keep their accounts first, by a broadcast of checked size. Many ids: rank
    # first. Either way the ranking filter runs ahead of the only shuffle of accounts.
    held = accounts.join(F.broadcast(ids), "customer_id", "left_semi") if few else accounts
    first = held.withColumn(
        "_n", F.row_number().over(Window.partitionBy("customer_id").orderBy("id"))
    ).filter(F.col("_n") <= keep)
    first = first if few else first.join(ids.hint("merge"), "customer_id")
    roles = {"": (), **rules.api_restricted}
    texts = first.groupBy("customer_id").agg(
        *[
            F.array_sort(F.collect_list(F.struct("_n", row_json(accounts.schema, tuple(hidden)).alias("j")))).alias(f"_a_{name}")
            for name, hidden in roles.items()
        ]
    )
    record = customers.withColumnRenamed("id", "customer_id")
    def output(hidden: tuple[str, ...]) -> Column:
        column = next(f"_a_{n}" for n, h in roles.items() if tuple(h) == hidden)
        listed = F.coalesce(F.array_join(F.transform(column, lambda a: a["j"]), ", "), F.lit(""))
        return F.concat(F.lit('{"accounts": ['), listed, F.lit('], "customer": '), row_json(customers.schema, hidden, {"id": "customer_id"}), F.lit("}"))

    present = F.col("_found").isNotNull()
    joined = wanted.join(record.withColumn("_found", F.lit(True)), "customer_id", "left")
    # result texts are wider than any estimate of them: never broadcast
    joined = joined.join(texts.hint("merge"), "customer_id", "left")
    return joined.select(
        "role",
        "call_key",
        F.when(present, truncate(_by_role(rules, F.col("role"), output), max_chars))
        .otherwise(truncate(error_json(_not_found(F.col("customer_id"))), max_chars)).alias("output"),
        F.when(F.col("call_key").isNull(), "ValueError: customer_id is required for customer_lookup").alias("error"),
    )


RESULT_ROWS = ("role", "call_key", "page", "position", "row_json", "error")


def lookup_rows(
    calls: DataFrame, customers: DataFrame, accounts: DataFrame, rules: AccessRules = AccessRules(), page_size: int = 1000,
) -> DataFrame:
    """``RESULT_ROWS`` of lookups: the customer at position -1 of page 0, then every account at its
    id. Accounts come from the pages of ``nested_lookup``, so a customer's are never together."""
    wanted = calls.select("role", "call_key", F.col("call_key").try_cast("long").alias("customer_id")).distinct()
    pages = nested_lookup(wanted.select("customer_id").filter("customer_id is not null"), customers, accounts, page_size)
    missing = F.when(F.col("call_key").isNull(), "ValueError: customer_id is required for customer_lookup")

    def text(name: str, schema: T.StructType) -> Column:
        names = {f.name: f"{name}`.`{f.name}" for f in schema.fields}
        return _by_role(rules, F.col("role"), lambda hidden: row_json(schema, hidden, names))

    record = customers.select(F.col("id").alias("customer_id"), F.struct(*[F.col(c) for c in customers.columns]).alias("customer"))
    people = wanted.join(record.hint("merge"), "customer_id", "left").select(
        "role", "call_key", F.lit(0).alias("page"), F.lit(-1).cast("long").alias("position"),
        F.when(F.col("customer").isNotNull(), text("customer", customers.schema))
        .when(missing.isNull(), error_json(_not_found(F.col("customer_id")))).alias("row_json"),
        missing.alias("error"),
    )
    held = wanted.join(pages.filter("customer is not null").select("customer_id", "page", "accounts").hint("merge"), "customer_id").select(
        "role", "call_key", "page", F.explode("accounts").alias("account")
    )
    return people.unionByName(
        held.select(
            "role", "call_key", "page", F.col("account.id").cast("long").alias("position"),
            text("account", accounts.schema).alias("row_json"), F.lit(None).cast("string").alias("error"),
        )
    )


def search_rows(calls: DataFrame, customers: DataFrame, rules: AccessRules = AccessRules()) -> DataFrame:
    """``RESULT_ROWS`` of searches: a row per hit; one with the refusal for a search that is refused."""
    asked = calls.select("role", "call_key", F.col("call_key").alias("search_key"), "name", "email", "limit").distinct()
    none = F.lit(None).cast("string")
    found = search_customers(asked.select("search_key", "name", "email", "limit"), customers)
    hits = found.join(asked.select("role", "call_key", "search_key").hint("merge"), "search_key").select(
        "role", "call_key", F.lit(0).alias("page"), F.col("position").cast("long").alias("position"),
        _by_role(rules, F.col("role"), lambda hidden: row_json(customers.schema, hidden)).alias("row_json"), none.alias("error"),
    )
    refused = asked.select(
        "role", "call_key", F.lit(0).alias("page"), F.lit(0).cast("long").alias("position"), _refusal().alias("row_json"), none.alias("error")
    ).filter("row_json is not null")
    return hits.unionByName(refused)


def ascii_lower(text: Column) -> Column:
    """Case folding of LIKE: ASCII letters only."""
    return F.translate(text, _UPPER, _LOWER)


def _grams(text: Column, size: Column, kind: str) -> Column:
    """Hashes of the distinct substrings of a length; none for a shorter text."""
    return F.when(
        F.length(text) >= size,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.xxhash64(F.lit(kind), F.substr(text, i, size)))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _candidates(criteria: DataFrame, people: DataFrame, names: list[str], few: bool) -> DataFrame:
    """``criteria`` ``(_name, _email)`` beside the people that hold the rarest substring of theirs."""

    def size(term: str) -> Column:
        return F.try_element_at(F.filter(F.array(*map(F.lit, _SIZES)), lambda n: n <= F.length(term)), F.lit(-1))

    def probe(term: str, kind: str) -> Column:
        return F.when(F.col(term).isNotNull(), _grams(F.col(term), size(term), kind)).otherwise(F.array().cast("array<bigint>"))

    probes = explode_rows(criteria, F.concat(probe("_name", "n"), probe("_email", "e")), "_gram")
    sizes = criteria.agg(F.collect_set(size("_name")), F.collect_set(size("_email"))).first()

    def tagged(text: str, kind: str, lengths: list[int]) -> list[Column]:
        return [_grams(F.coalesce(F.col(text), F.lit("")), F.lit(n), kind) for n in lengths]

    every = F.array_distinct(
        F.concat(
            F.array().cast("array<bigint>"), *[c for n in names for c in tagged(n, "n", sizes[0])], *tagged("_mail", "e", sizes[1])
        )
    )

    def grams_of(some: DataFrame, wanted: DataFrame, broadcast: bool) -> DataFrame:
        rows = explode_rows(some.withColumn("_all", every), F.col("_all"), "_gram").drop("_all")
        return rows.join(F.broadcast(wanted), "_gram", "left_semi") if broadcast else rows

    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")
    # how common a substring is only steers the choice of the probe, so a slice will do
    used = probes.select("_gram").distinct()
    small = few or _at_most(used, _BROADCAST_GRAMS)
    slice_ = grams_of(people.filter(salt == 0), used, small).select("_gram")
    counts = (slice_ if small else slice_.join(used.hint("merge"), "_gram", "left_semi")).groupBy("_gram").count()
    rarest = (
        probes.join(counts, "_gram", "left")
        .groupBy("_name", "_email")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.col("_gram").alias("g"))).alias("_best"))
        .select("_name", "_email", F.col("_best.g").alias("_gram"))
    )
    held = grams_of(people, rarest.select("_gram").distinct(), small)
    if few:
        return held.join(F.broadcast(rarest), "_gram")
    salted = rarest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return held.withColumn("_salt", salt).join(salted.hint("merge"), ["_gram", "_salt"])


def search_customers(
    searches: DataFrame,
    customers: DataFrame,
    name_columns: tuple[str, ...] = ("first_name", "last_name"),
    email_column: str = "email",
) -> DataFrame:
    """Customers per search, in id order, up to the limit of the search.

    ``searches(search_key, name, email, limit)``: a customer matches if one of the name
    columns contains ``name`` and the e-mail contains ``email`` (absent criteria hold;
    ASCII case is ignored, no wildcards). A limit outside 1..100 finds nothing here;
    ``search_outputs`` refuses it.

    A containment match becomes an equi-join: each search probes with the rarest of the
    substrings of its name and e-mail, as long as one of ``_SIZES`` allows, and only customers
    holding that substring are compared. Searches that differ in their key or limit only
    are compared once. A set of searches of checked size is broadcast; of a larger one only
    the substrings are, as long as they are few enough, and what holds one is joined by
    shuffle with salted probes, since a substring can occur in any share of the
    customers. Returns ``(search_key, position, <customer columns>)``. Searches are stored
    and counted first, which runs jobs.
    """
    asked = durable(
        searches.select(
            "search_key",
            F.nullif(ascii_lower(F.col("name")), F.lit("")).alias("_name"),
            F.nullif(ascii_lower(F.col("email")), F.lit("")).alias("_email"),
            F.coalesce(F.col("limit"), F.lit(SEARCH_DEFAULT)).alias("_limit"),
        ).filter(F.col("_limit").between(1, SEARCH_LIMIT)).distinct(),
        "searches",
    )
    few = _at_most(asked, _BROADCAST_ROWS)
    criteria = asked.filter(F.coalesce("_name", "_email").isNotNull()).select("_name", "_email").distinct()
    names = [f"_n{i}" for i in range(len(name_columns))]
    people = customers.select(
        "id",
        *[ascii_lower(F.col(c)).alias(n) for c, n in zip(name_columns, names)],
        ascii_lower(F.col(email_column)).alias("_mail"),
    )

    candidates = _candidates(criteria, people, names, few)
    named = F.lit(False)
    for n in names:
        named = named | F.coalesce(F.contains(F.col(n), F.col("_name")), F.lit(False))
    matches = F.coalesce(F.col("_name").isNull() | named, F.lit(False)) & F.coalesce(
        F.col("_email").isNull() | F.contains(F.col("_mail"), F.col("_email")), F.lit(False)
    )
    first = (
        candidates.filter(matches)
        .select("_email", "_name", "id")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_email", "_name").orderBy("id")))
        .filter(F.col("_rank") <= SEARCH_LIMIT)
    )
    # what a key asks for under several limits is numbered together
    most = F.max("_limit").over(Window.partitionBy("search_key"))
    keyed = asked.withColumn("_most", most).withColumnsRenamed({"_name": "_of_name", "_email": "_of_email"})
    same = F.col("_name").eqNullSafe(F.col("_of_name")) & F.col("_email").eqNullSafe(F.col("_of_email"))
    ranked = (
        first.join(keyed.hint("merge"), same & (F.col("_rank") <= F.col("_most")))
        .select("search_key", "id", "_limit")
        .withColumn("position", F.row_number().over(Window.partitionBy("search_key").orderBy("id")))
        .filter(F.col("position") <= F.col("_limit"))
        .drop("_limit")
    )
    return ranked.join(customers, "id").select("search_key", "position", *customers.columns)


def search_outputs(
    calls: DataFrame, customers: DataFrame, max_chars: int, rules: AccessRules = AccessRules()
) -> DataFrame:
    """``(role, call_key, output, error)`` per distinct (role, search). A search returns at
    most a hundred customers, so its text is built from a bounded group."""
    asked = calls.select("role", "call_key", F.col("call_key").alias("search_key"), "name", "email", "limit").distinct()
    found = search_customers(asked.select("search_key", "name", "email", "limit"), customers)
    roles = {"": (), **rules.api_restricted}
    texts = found.groupBy("search_key").agg(
        F.count("*").alias("_count"),
        *[
            F.array_sort(F.collect_list(F.struct("position", row_json(customers.schema, tuple(h)).alias("j")))).alias(f"_r_{n}")
            for n, h in roles.items()
        ],
    )

    def output(hidden: tuple[str, ...]) -> Column:
        column = next(f"_r_{n}" for n, h in roles.items() if tuple(h) == hidden)
        listed = F.coalesce(F.array_join(F.transform(column, lambda r: r["j"]), ", "), F.lit(""))
        count = F.coalesce(F.col("_count"), F.lit(0)).cast("string")
        return F.concat(F.lit('{"count": '), count, F.lit(', "results": ['), listed, F.lit("]}"))

    return asked.join(texts.hint("merge"), "search_key", "left").select(
        "role", "call_key",
        truncate(F.coalesce(_refusal(), _by_role(rules, F.col("role"), output)), max_chars).alias("output"),
        F.lit(None).cast("string").alias("error"),
    )


def _refusal() -> Column:
    """The text for a search with a wrong limit or without any criterion, null for others."""
    missing = F.coalesce(F.col("name"), F.lit("")).eqNullSafe("") & F.coalesce(F.col("email"), F.lit("")).eqNullSafe("")
    refused = F.lit('API error: 400 - {"detail":"At least one search parameter (name or email) is required"}')
    wrong = ~F.coalesce(F.col("limit"), F.lit(SEARCH_DEFAULT)).between(1, SEARCH_LIMIT)
    return F.when(wrong, error_json(_wrong_limit(F.col("limit")))).when(missing, error_json(refused))
