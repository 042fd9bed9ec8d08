"""Model output to spans: token scores, BIOES labels, span decoding over token tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import bind, explode_rows

BIOES_LABELS = ("O",) + tuple(f"{p}-{c}" for c in fixed.CATEGORIES for p in ("B", "I", "E", "S"))
_WORD = "array<struct<word:string,t_start:int,t_end:int>>"


def parse_label(label: Column) -> Column:
    """``struct<prefix,category>``; anything malformed or unknown is ``(O, null)``."""

    prefix, category = F.substring(label, 1, 1), F.substr(label, F.lit(3))
    valid = (F.substring(label, 2, 1) == "-") & prefix.isin(*fixed.BIOES_PREFIXES) & category.isin(*fixed.CATEGORIES)
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(F.when(valid, prefix).otherwise("O").alias("prefix"), F.when(valid, category).alias("category"))


def score_tokens(df: DataFrame, logits: str, labels: tuple[str, ...] = BIOES_LABELS) -> DataFrame:
    """Label of the largest logit (``O`` beyond the label list) and its softmax probability."""
    names = F.array(*[F.lit(x) for x in labels])
    best = bind(
        F.struct(F.col(logits).alias("l"), F.array_max(logits).alias("top")),
        lambda v: F.struct(
            F.coalesce(F.get(names, (F.array_position(v["l"], v["top"]) - 1).cast("int")), F.lit("O")).alias("label"),
            (1.0 / F.aggregate(v["l"], F.lit(0.0), lambda acc, x: acc + F.exp(x - v["top"]))).alias("prob"),
        ),
    )
    return df.withColumn("_best", best).select("*", "_best.label", "_best.prob").drop("_best")


def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words of texts with their offsets, counted over whole batches."""
    for texts in batches:
        listed = pc.split_pattern(texts, " ")
        starts, words = np.asarray(listed.offsets), listed.flatten()
        widths = np.asarray(pc.utf8_length(words)).astype(np.int64) + 1
        ends = np.cumsum(widths)
        before = np.concatenate([[0], ends])[starts[:-1] - starts[0]]
        counts = np.diff(starts)
        end = ends - 1 - np.repeat(before, counts)
        first = end - widths + 1
        fields = [words.cast(pa.string()), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))]
        rows = pa.StructArray.from_arrays(fields, ["word", "t_start", "t_end"])
        yield pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), rows, mask=texts.is_null())


def split_words(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Token table of space-separated words: ``(doc, text, idx, word, t_start, t_end)``."""
    words = F.arrow_udf(_words, _WORD)
    rows = explode_rows(df.select(doc, text, words(F.col(text)).alias("_words")), F.col("_words"), "_w", "_i")
    return rows.select(doc, text, F.col("_i").cast("long").alias("idx"), "_w.*")


def decode_bioes(
    tokens: DataFrame, doc: str, idx: str, label: str, start: str, end: str, prob: str
) -> DataFrame:
    """Spans of a token table: ``(doc, category, start, end, confidence)``.

    A span is one S token, or a B token with the I tokens of its category after it up
    to the first E. A broken run ends before the break; orphan I and E tokens are
    skipped. A span is dropped if its first or last token has no offsets or if its
    first token has the offsets (0, 0) of a special token. Confidence is the mean.

    ``idx`` counts the tokens of a document without gaps. Only labelled tokens are
    shuffled: a jump in ``idx`` stands for the unlabelled ones between them. One shuffle
    and one sort serve the window and the grouping. A document is one model input and
    so has a bounded token count (the model reads up to 128 000).
    """
    order = Window.partitionBy(doc).orderBy(idx)
    parsed = parse_label(F.col(label))
    tagged = tokens.select(
        doc, idx, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(prob).alias("_p"),
        parsed["prefix"].alias("_prefix"), parsed["category"].alias("_category"),
    ).filter(F.col("_category").isNotNull() & (F.col("_prefix") != "O"))
    before = {c: F.lag(c).over(order) for c in (idx, "_prefix", "_category")}
    opens = (
        F.col("_prefix").isin("S", "B")
        | before[idx].isNull()
        | (before[idx] != F.col(idx) - 1)
        | before["_prefix"].isin("S", "E")
        | (before["_category"] != F.col("_category"))
    )
    islands = tagged.withColumn("_open", F.when(opens, 1).otherwise(0)).withColumn(
        "_island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    # numbers only, so that islands are grouped without another sort
    names = F.array(*map(F.lit, fixed.CATEGORIES))
    starts = F.when(F.col("_prefix").isin("S", "B"), F.array_position(names, F.col("_category")).cast("int")).otherwise(0)
    return (
        islands.withColumn("_code", starts)
        .groupBy(doc, "_island")
        .agg(
            F.min_by("_code", idx).alias("_code"), F.min_by("_s", idx).alias("_first_s"), F.min_by("_e", idx).alias("_first_e"),
            F.max_by("_e", idx).alias("_last_e"), F.avg("_p").alias("confidence"),
        )
        .filter(F.col("_code") > 0)
        .filter(F.col("_first_s").isNotNull() & F.col("_first_e").isNotNull() & F.col("_last_e").isNotNull())
        .filter(~((F.col("_first_s") == 0) & (F.col("_first_e") == 0)))
        .select(
            doc, F.get(names, F.col("_code") - 1).alias("category"), F.col("_first_s").alias("start"),
            F.col("_last_e").alias("end"), "confidence",
        )
    )


def with_span_text(spans: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Add ``span_text``, the slice of the document."""
    others = [c for c in spans.columns if c != doc]
    listed = spans.groupBy(doc).agg(F.collect_list(F.struct(*others)).alias("_spans"))

    def shown(s: Column) -> Column:
        length = F.greatest(s["end"] - s["start"], F.lit(0)).cast("int")
        return s.withField("span_text", F.substr(F.col(text), (s["start"] + 1).cast("int"), length))

    # a text meets all of its spans at once: it is not copied to each of them
    rows = listed.join(docs.select(doc, text), doc).select(doc, F.transform("_spans", shown).alias("_spans"))
    return explode_rows(rows, F.col("_spans"), "_s").select(doc, "_s.*")
