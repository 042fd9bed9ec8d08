"""SQL under a role: views with the permitted tables and columns in a session of its own.

Catalyst parses and analyses the query, and both plans are judged: a role calls functions of
the permitted groups only and reads its own views only. A column outside a role's list stays
nameable in its view but is a typed NULL there and is dropped from results, so no expression
over it can leak. Building results runs jobs: one for each distinct text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import count, islice

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.canonical import row_json, truncate
from veilframe.operators import templates
from veilframe.operators.access import AccessRules
from veilframe.sources.storage import durable, exists, new_path

Tables = Mapping[str, Callable[[SparkSession], DataFrame]]
OUTPUT_SCHEMA = "role string, call_key string, output string, error string"
ROWS_SCHEMA = "role string, call_key string, position long, row_json string, error string"

# what roles may call, by Spark's own grouping of its functions; calls into the JVM, files, session
# values, generators and user functions are in none of these groups
_FUNCTION_GROUPS = frozenset(
    f"{kind}_funcs" for kind in (
        "agg", "array", "bitwise", "collection", "conditional", "conversion", "datetime", "hash", "json", "lambda",
        "map", "math", "predicate", "string", "struct", "window",
    )
)
_LEAVES = frozenset(("OneRowRelation", "LocalRelation", "CTERelationRef"))
_REFUSED_NODES = frozenset(("Generate", "ScriptTransformation"))
_REFUSED = "The query uses a function or source that is not available to roles"
_REFUSED_CONDITION = "The query filters or joins on a column that is not available to the role"
_WORKERS = 8
#: Texts of a part in which a shape that fails as a whole is tried again.
_BATCH = 8192


def role_session(
    spark: SparkSession, tables: Tables, role: str, rules: AccessRules = AccessRules()
) -> SparkSession:
    """A session that holds only the role's views."""
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in rules.tables.get(role, ()):
        if name not in tables:
            continue
        df = tables[name](session)
        hidden = rules.hidden(role, name, df.columns)
        df.select(
            *[
                F.lit(None).cast(f.dataType).alias(f.name) if f.name in hidden else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        ).createOrReplaceTempView(name)
    return session


def _hidden_columns(session: SparkSession, rules: AccessRules, role: str) -> dict[str, set[str]]:
    """Columns hidden in each of the role's views, in lower case."""
    views = {t: session.table(t).columns for t in rules.tables.get(role, ()) if session.catalog.tableExists(t)}
    return {t.lower(): {c.lower() for c in rules.hidden(role, t, columns)} for t, columns in views.items()}


def _nodes(tree) -> Iterator[dict]:
    """All nodes of a plan given as JSON, in order, subqueries included."""
    if isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)
    elif isinstance(tree, dict):
        yield tree
        for part in tree.values():
            yield from _nodes(part)


def _kind(node: dict) -> str:
    return str(node.get("class", "")).rsplit(".", 1)[-1]


def _outside_views(nodes: list) -> Iterator[dict]:
    """Plan nodes without what stands below a view: that is the role's own and trusted."""
    at = 0

    def skip(i: int) -> int:
        end = i + 1
        for _ in range(nodes[i]["num-children"]):
            end = skip(end)
        return end

    while at < len(nodes):
        yield nodes[at]
        for value in nodes[at].values():
            for inner in _plans_in(value):
                yield from _outside_views(inner)
        at = skip(at) if _kind(nodes[at]) == "View" else at + 1


def _plans_in(value) -> Iterator[list]:
    """Trees of nodes inside the fields of a node: its expressions and the plans of subqueries."""
    if isinstance(value, list):
        if value and isinstance(value[0], dict) and "num-children" in value[0]:
            yield value
        else:
            for part in value:
                yield from _plans_in(part)


def _check_text(session: SparkSession, query: str) -> None:
    """Refuse functions outside the permitted groups, qualified relations and table functions,
    as the parser sees them: quoting, comments and case make no difference."""
    jvm = session._jvm
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    plan = json.loads(session._jsparkSession.sessionState().sqlParser().parsePlan(query).toJSON())
    for node in _nodes(plan):
        kind = _kind(node)
        if kind == "UnresolvedFunction":
            name = str(node.get("nameParts", "")).strip("[]")
            info = builtin.lookupFunction(identifier(name))
            if not info.isDefined() or info.get().getGroup() not in _FUNCTION_GROUPS:
                raise ValueError(_REFUSED)
        elif kind == "UnresolvedRelation" and "," in str(node.get("multipartIdentifier", "")):
            raise ValueError(_REFUSED)
        elif kind == "UnresolvedTableValuedFunction":
            raise ValueError(_REFUSED)


def _check_plan(df: DataFrame) -> None:
    """Refuse analysed plans that read anything but the role's views."""
    for node in _outside_views(json.loads(df._jdf.queryExecution().analyzed().toJSON())):
        kind = _kind(node)
        plan_node = ".expressions." not in str(node.get("class", ""))
        if kind in _REFUSED_NODES or (plan_node and node.get("num-children") == 0 and kind not in _LEAVES | {"View"}):
            raise ValueError(_REFUSED)


def _ids(expression: list) -> set[int]:
    """Ids of the attributes that a flat expression tree reads; plans of subqueries not included."""
    return {n["exprId"]["id"] for n in expression if _kind(n) == "AttributeReference"}


def _view_columns(nodes: list, hidden: Mapping[str, set[str]]) -> set[int]:
    """Ids of the hidden columns that the role's views give out: by table, not by name alone."""
    found = set()
    for at, node in enumerate(nodes):
        if _kind(node) == "View":
            names = hidden.get(node["desc"]["identifier"]["table"].lower(), set())
            child = nodes[at + 1]
            for expression in child.get("projectList") or child.get("output") or []:
                top = expression[0]
                if top.get("name", "").lower() in names:
                    found.add(top["exprId"]["id"])
        for value in node.values():
            for inner in _plans_in(value):
                found |= _view_columns(inner, hidden)
    return found


class Lineage:
    """Where the columns of an analysed query come from, by expression id.

    ``bare``: ids that are a hidden column itself, under whatever alias; ``derived``: those and all
    that is computed from one."""

    def __init__(self, df: DataFrame, hidden: Mapping[str, set[str]]):
        nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
        self.nodes = list(_outside_views(nodes))
        self.bare = _view_columns(nodes, hidden)
        self.derived = set(self.bare)
        trees = [e for n in self.nodes for v in n.values() for e in _plans_in(v)]
        known = -1
        while known != len(self.bare) + len(self.derived):
            known = len(self.bare) + len(self.derived)
            for tree in trees:
                if _kind(tree[0]) != "Alias":
                    continue
                own, used = tree[0]["exprId"]["id"], _ids(tree[1:])
                if used & self.derived:
                    self.derived.add(own)
                if used & self.bare and len(tree) == 2:
                    self.bare.add(own)

    def conditions(self) -> set[int]:
        """Ids from hidden columns that a filter or join condition reads."""
        read = set()
        for node in self.nodes:
            if _kind(node) in ("Filter", "Join"):
                for tree in _plans_in(node.get("condition") or []):
                    read |= _ids(tree) & self.derived
        return read


def governed_query(
    session: SparkSession, query: str, role: str, rules: AccessRules = AccessRules(),
    hidden: Mapping[str, set[str]] | None = None, refuse_conditions: bool = False,
) -> DataFrame:
    """Run one SELECT in a role session; columns the role may not see are dropped from the result.

    A result column goes if it is a hidden one by lineage and still has its name; an alias of it
    stays, as NULL, and a column that only shares the name stays. ``refuse_conditions`` refuses
    a query that filters or joins on something computed from a hidden column; without it such a
    condition meets NULLs."""
    if not query.strip().upper().startswith("SELECT"):
        raise ValueError("Only SELECT queries are allowed. Got: " + query[:50])
    _check_text(session, query)
    df = session.sql(query)
    _check_plan(df)
    hidden = _hidden_columns(session, rules, role) if hidden is None else hidden
    if not any(hidden.values()):
        return df
    lineage = Lineage(df, hidden)
    if refuse_conditions and lineage.conditions():
        raise ValueError(_REFUSED_CONDITION)
    names = set().union(*hidden.values())
    output = df._jdf.queryExecution().analyzed().output()
    ids = [output.apply(i).exprId().id() for i in range(output.size())]
    shown = [i for i, c in enumerate(df.columns) if c.lower() not in names or ids[i] not in lineage.bare]
    if len(shown) == len(df.columns):
        return df
    # by position: a result may hold a name twice
    return _numbered(df).select(*[f"_{i}" for i in shown]).toDF(*[df.columns[i] for i in shown])


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def table_schema(spark: SparkSession, tables: Tables, role: str, rules: AccessRules = AccessRules()) -> DataFrame:
    """``(table, position, column, type)`` of the views of a role, without hidden columns."""
    rows = []
    for name in sorted(t for t in rules.tables.get(role, ()) if t in tables):
        df = tables[name](spark)
        hidden = rules.hidden(role, name, df.columns)
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields) if f.name not in hidden]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def _all_rows(df: DataFrame, role: str, query: str, most: int | None) -> DataFrame:
    """Result rows as JSON, in order of ``position``. Of columns with one name the last counts, as
    in any JSON object."""
    last = {f.name: i for i, f in enumerate(df.schema.fields)}
    shown = T.StructType([df.schema.fields[i] for i in last.values()])
    rows = _numbered(df if most is None else df.limit(most))
    return rows.select(
        F.lit(role).alias("role"), F.lit(query).alias("call_key"), F.monotonically_increasing_id().alias("position"),
        row_json(shown, source={name: f"_{i}" for name, i in last.items()}).alias("row_json"), F.lit(None).cast("string").alias("error"),
    )


def row_texts(calls: DataFrame, rows: DataFrame, max_chars: int) -> DataFrame:
    """``(role, call_key, output, error)`` per distinct call: its rows as one JSON text, cut at
    ``max_chars``. A row takes at least four characters of the text, so rows past ``max_chars / 4``
    cannot show. Rows are counted by task first; of a large result only the tasks that hold its
    first rows are read for the text."""
    keep = max_chars // 4 + 2
    task, place = F.shiftright("position", 33), F.col("position").bitwiseAND((1 << 33) - 1)
    good = rows.filter("error is null").select("role", "call_key", task.alias("task"), place.alias("place"), "row_json")
    earlier = Window.partitionBy("role", "call_key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        good.groupBy("role", "call_key", "task").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("before") < keep).drop("n")
    )
    shown = good.filter(F.col("place") < keep).join(first, ["role", "call_key", "task"]).withColumn("n", F.col("before") + F.col("place"))
    listed = shown.filter(F.col("n") < keep).groupBy("role", "call_key").agg(
        F.array_sort(F.collect_list(F.struct("n", F.substring("row_json", 1, max_chars + 1).alias("j")))).alias("listed")
    )
    errors = rows.filter("error is not null").select("role", "call_key", "error")
    text = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("listed", lambda r: r["j"]), ", "), F.lit("")), F.lit("]"))
    return (
        calls.select("role", "call_key").distinct().join(listed.hint("merge"), ["role", "call_key"], "left")
        .join(errors.hint("merge"), ["role", "call_key"], "left")
        .select("role", "call_key", F.when(F.col("error").isNull(), truncate(text, max_chars)).alias("output"), "error")
    )


def _describe(problem: Exception) -> str:
    if isinstance(problem, ValueError):
        return f"ValueError: {problem}"
    condition = problem.getCondition() if isinstance(problem, PySparkException) else None
    if condition is None:  # a failed task: the condition stands in the message
        found = re.search(r"\[([A-Z][A-Z0-9_]*(?:\.[A-Z0-9_]+)*)\]", str(problem))
        condition = found.group(1) if found else "INTERNAL_ERROR"
    return f"{type(problem).__name__}: {condition}"


def _shaped(calls: DataFrame) -> DataFrame:
    """Distinct texts ``(role, call_key, shape, values, number)``; no shape if values cannot be told."""

    def tell(batches):
        for batch in batches:
            found = [templates.shape_of(text or "") for text in batch.column(1).to_pylist()]
            shapes = pa.array([f and f[0].dumps() for f in found], pa.string())
            values = pa.array([f and [str(v) for v in f[1]] for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, shapes, values], ["role", "call_key", "shape", "values"])

    texts = calls.select("role", "call_key").distinct()
    told = texts.mapInArrow(tell, "role string, call_key string, shape string, values array<string>")
    return told.withColumn("number", F.monotonically_increasing_id())


def _per_query(
    calls: DataFrame, tables: Tables, rules: AccessRules, schema: str, build: Callable[..., DataFrame], most: int | None
) -> DataFrame:
    """Run every distinct (role, text) once and write its result on its own, a bounded number at
    a time; texts that differ in values only are one query (``templates``). A text that fails, when
    it is planned or when it runs, becomes one error row and costs no other its result. Only shapes, with
    one text each, and texts that run alone reach the driver, streamed; the values of a shape are a stored
    table, and results are written by tasks, so neither their number nor their size is limited."""
    spark = calls.sparkSession
    sessions: dict[str, tuple[SparkSession, dict[str, set[str]]]] = {}
    path, failed, numbers = new_path(spark, "query-results"), [], count()

    def run(number: int, role: str, query: str) -> str | None:
        session, hidden = sessions[role]
        try:
            df = governed_query(session, query, role, rules, hidden)
            build(df, role, query).write.parquet(f"{path}/query={number}")
        except (ValueError, PySparkException, Py4JJavaError) as problem:
            return _describe(problem)
        return None

    def together(role: str, shape_text: str, example: str, texts: Callable[[SparkSession], DataFrame], size: int) -> list[Column]:
        """All texts of one shape as one query; conditions for the texts that have to run one by one."""
        shape = templates.Shape.loads(shape_text)
        session = role_session(spark, tables, role, rules)
        if not templates.runs_together(session, example, shape):
            return [F.lit(True)]

        def succeeds(part: Column) -> bool:
            values = [F.get("values", i).cast("string" if kind == "s" else "long").alias(f"{templates.VALUE}{i}") for i, kind in enumerate(shape.kinds)]
            texts(session).filter(part).select(F.col("number").alias(templates.CALL), *values).createOrReplaceTempView(templates.VALUES)
            keys = texts(spark).filter(part).select(F.col("number").alias(templates.CALL), "call_key")
            try:
                df = governed_query(session, shape.text(), role, rules, sessions[role][1])
                _rows_of_calls(df, role, keys, most).write.parquet(f"{path}/query={next(numbers)}")
            except (ValueError, PySparkException, Py4JJavaError):
                return False
            return True

        if succeeds(F.lit(True)):
            return []
        # a text that fails costs those of its part only
        parts = -(-size // _BATCH)
        if parts == 1:
            return [F.lit(True)]
        split = [F.pmod(F.xxhash64("number"), F.lit(parts)) == i for i in range(parts)]
        return [part for part in split if not succeeds(part)]

    def one_by_one(texts: DataFrame) -> None:
        nonlocal failed
        rows = texts.select("role", "call_key").toLocalIterator()
        while some := list(islice(rows, 64 * _WORKERS)):
            know({r.role for r in some})
            jobs = [(r.role, r.call_key, pool.submit(run, next(numbers), r.role, r.call_key)) for r in some]
            failed += [(role, text, None, None, error) for role, text, job in jobs if (error := job.result()) is not None]

    def know(roles: set[str]) -> None:
        for role in roles - set(sessions):
            session = role_session(spark, tables, role, rules)
            sessions[role] = (session, _hidden_columns(session, rules, role))

    shaped = durable(_shaped(calls), "query-texts")
    shapes = shaped.filter("shape is not null").groupBy("role", "shape").agg(F.count("*").alias("count"), F.min("call_key").alias("example"))
    shapes = durable(shapes.filter(F.col("count") >= templates.LEAST).withColumn("key", F.sha2(F.concat_ws("|", "role", "shape"), 256)), "query-shapes")
    by_shape = new_path(spark, "query-values")
    held = shaped.join(shapes.select("role", "shape", "key"), ["role", "shape"]).select("role", "call_key", "number", "values", "key")
    held.repartition("key", F.pmod("number", F.lit(_WORKERS))).write.partitionBy("key").parquet(by_shape)

    def texts_of(key: str) -> Callable[[SparkSession], DataFrame]:
        return lambda session: session.read.schema(held.drop("key").schema).parquet(f"{by_shape}/key={key}")

    with ThreadPoolExecutor(_WORKERS) as pool:
        one_by_one(shaped.join(shapes.select("role", "shape"), ["role", "shape"], "left_anti"))
        found = shapes.toLocalIterator()
        while some := list(islice(found, 64 * _WORKERS)):
            know({r.role for r in some})
            jobs = [(texts_of(r["key"]), pool.submit(together, r["role"], r["shape"], r["example"], texts_of(r["key"]), r["count"])) for r in some]
            for texts, job in jobs:
                for part in job.result():
                    one_by_one(texts(spark).filter(part))
    errors = spark.createDataFrame(failed, schema)
    if not exists(spark, path):  # none has succeeded
        return errors
    return spark.read.schema(schema).parquet(path).select(*errors.columns).unionByName(errors)


def _rows_of_calls(df: DataFrame, role: str, keys: DataFrame, most: int | None) -> DataFrame:
    """``ROWS_SCHEMA`` from a result for many texts, each row with the number of its text. Positions
    count the rows of a text within a task, as they would if it had run alone."""
    own = [i for i, c in enumerate(df.columns) if c != templates.CALL and not c.startswith(templates.VALUE)]
    last = {df.columns[i]: i for i in own}
    shown = T.StructType([df.schema.fields[i] for i in last.values()])
    number = _numbered(df)
    call = F.col(f"_{df.columns.index(templates.CALL)}")
    rows = number.select(call.alias(templates.CALL), row_json(shown, source={name: f"_{i}" for name, i in last.items()}).alias("row_json"))

    def count(batches):
        task, seen = TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            places = []
            for call in batch.column(0).to_pylist():
                place = seen.get(call, 0)
                seen[call] = place + 1
                places.append(task | place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [templates.CALL, "row_json", "position"])

    placed = rows.mapInArrow(count, f"{templates.CALL} long, row_json string, position long")
    if most is not None:
        placed = placed.filter(F.col("position").bitwiseAND((1 << 33) - 1) < most)
    return placed.join(keys, templates.CALL).select(
        F.lit(role).alias("role"), "call_key", "position", "row_json", F.lit(None).cast("string").alias("error")
    )


def query_outputs(
    calls: DataFrame, tables: Tables, max_chars: int, rules: AccessRules = AccessRules()
) -> DataFrame:
    """``(role, call_key, output, error)``: one text per distinct (role, query). No more rows are
    computed than the text can show."""
    return row_texts(calls, query_rows(calls, tables, rules, max_chars // 4 + 2), max_chars)


def query_rows(
    calls: DataFrame, tables: Tables, rules: AccessRules = AccessRules(), most: int | None = None
) -> DataFrame:
    """``(role, call_key, position, row_json, error)``: one row per result row, distributed and
    stored; the first ``most`` rows only if that is given."""
    return _per_query(calls, tables, rules, ROWS_SCHEMA, lambda df, role, query: _all_rows(df, role, query, most), most)
