"""SQL texts that differ in compared values only, run as one query over a table of the values.

A log of requests holds few shapes of queries and very many values. Texts of one shape, a selection
from tables under conditions that compare a column with a value, become one text over the same
tables and a view of the values, one row a text. At least one comparison is an equality, so Catalyst
plans a hash join by it, and the cost is that of one query, whatever the number of texts. The text
is judged like any other. Every other shape (groups, order, limits, sub-queries, values elsewhere)
is left to be run on its own, as is a shape that fails in one."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Texts of one shape from which they are run together.
LEAST = 8
CALL, VALUE, VALUES = "_call_no", "_value_", "_values"
_LITERAL = re.compile(r"'(?:[^']|'')*'|\b\d+\b")
_OTHER = re.compile(r"[`\"\\]|--|/\*|\b\d+\.|\.\d|\$|:|;")
_COMPARES = {"EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"}
_SOURCES = {"SubqueryAlias", "UnresolvedRelation", "Join"}
_COLUMNS = {"UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "Alias"}
_JOINS = {"EqualTo", "And", "UnresolvedAttribute"}


@dataclass(frozen=True)
class Shape:
    """A text with its values taken out; ``kinds`` are 's' for texts and 'n' for whole numbers."""

    parts: tuple[str, ...]
    kinds: str

    def dumps(self) -> str:
        return json.dumps([self.parts, self.kinds])

    @staticmethod
    def loads(text: str) -> Shape:
        parts, kinds = json.loads(text)
        return Shape(tuple(parts), kinds)

    def text(self) -> str:
        """One query for all texts of this shape, with the number of the text beside its columns."""
        whole = self.parts[0] + "".join(f"{VALUES}.{VALUE}{i}{part}" for i, part in enumerate(self.parts[1:]))
        start, where = re.match(r"\s*SELECT\b", whole, re.I), re.search(r"\bWHERE\b", whole, re.I)
        return f"{whole[:start.end()]} {VALUES}.{CALL}, {whole[start.end():where.start()]}CROSS JOIN {VALUES} {whole[where.start():]}"


def shape_of(text: str) -> tuple[Shape, tuple] | None:
    """The shape of a text and its values, by its letters; None if values cannot be told for sure."""
    bare = _LITERAL.sub("", text)
    if _OTHER.search(_LITERAL.sub(lambda m: "" if m.group().startswith("'") else m.group(), text)) or "'" in bare or len(re.findall(r"\bWHERE\b", bare, re.I)) != 1:
        return None
    values, kinds = [], ""
    for found in _LITERAL.findall(text):
        text_value = found.startswith("'")
        if "\\" in found or (not text_value and int(found) >= 1 << 31):
            return None
        values.append(found[1:-1].replace("''", "'") if text_value else int(found))
        kinds += "s" if text_value else "n"
    return (Shape(tuple(_LITERAL.split(text)), kinds), tuple(values)) if values else None


def _kind(node: dict) -> str:
    return str(node.get("class", "")).rsplit(".", 1)[-1]


def _expressions(node: dict) -> list[list[dict]]:
    """The flat expression trees of a plan node."""
    found = []

    def look(value) -> None:
        if isinstance(value, list):
            if value and isinstance(value[0], dict) and "num-children" in value[0]:
                found.append(value)
            else:
                for part in value:
                    look(part)

    for value in node.values():
        look(value)
    return found


def runs_together(session: SparkSession, text: str, shape: Shape) -> bool:
    """Whether the parsed text is of a shape whose texts can be one query: columns of tables under one
    conjunction of comparisons, each value on one side of one."""
    nodes = json.loads(session._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())
    kinds = [_kind(n) for n in nodes]
    if kinds[:2] != ["Project", "Filter"] or not set(kinds[2:]) <= _SOURCES or "UnresolvedRelation" not in kinds:
        return False
    allowed = {0: _COLUMNS, **dict.fromkeys(range(2, len(nodes)), _JOINS)}
    if any(_kind(e) not in kinds_ for i, kinds_ in allowed.items() for tree in _expressions(nodes[i]) for e in tree):
        return False
    flat = nodes[1]["condition"]
    at = found = equal = 0

    def compared() -> bool:
        """One conjunction of comparisons, read in order."""
        nonlocal at, found, equal
        kind = _kind(flat[at])
        at += 1
        if kind == "And":
            return compared() and compared()
        sides = [_kind(e) for e in flat[at:at + 2]]
        at += 2
        if kind not in _COMPARES or sorted(sides) not in (["Literal", "UnresolvedAttribute"], ["UnresolvedAttribute"] * 2):
            return False
        found += "Literal" in sides
        equal += kind == "EqualTo" and "Literal" in sides
        return True

    return compared() and at == len(flat) and found == len(shape.kinds) and equal > 0
