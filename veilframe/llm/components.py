"""Connected components of links between integer ids, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.store import Workspace

_ROUNDS = 60


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that links lead to.

    Each round hooks every id's label to the smallest label beside it and then to that label's own
    label, so chains shrink by halves and stars settle at once. Links within one label are dropped
    as soon as they are found. Minima of a hot id are taken before the shuffle. A null end or a link
    to itself says nothing. Rounds are written, so lineage stays short."""
    pairs = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = work.table(pairs, f"{name}-links")
    labels = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    open_ = pairs
    for turn in range(_ROUNDS):
        if open_.isEmpty():
            break
        # open_: links between current labels. The larger end of each hooks to its smallest neighbour.
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("parent"))
        # Parents are smaller than roots, so this is a forest; jump twice.
        for jump in range(2):
            up = hook.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(up, "parent", "left").select("root", F.coalesce("above", "parent").alias("parent"))
        hook = work.table(hook, f"{name}-{turn}-jumped")
        moved = hook.withColumnRenamed("root", "component")
        labels = labels.join(moved, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
        if turn % 3 == 2:
            labels = work.table(labels, f"{name}-{turn}-labels")
        a, b = hook.select(F.col("root").alias("a"), F.col("parent").alias("x")), hook.select(F.col("root").alias("b"), F.col("parent").alias("y"))
        open_ = work.table(
            open_.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-{turn}-open")
    else:
        raise RuntimeError("links have not settled")
    return labels
