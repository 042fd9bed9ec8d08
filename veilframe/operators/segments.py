"""Detection in texts longer than one row should hold: scanned in segments, with the same spans.

A text is cut only where no detector can match across: before the last of six lower-case words with
single spaces between them. E-mails and links hold no space; numbers and dates hold no letters; an
address ends at the latest with the fourth word behind its number; names begin with a capital. So
every match, and every choice among matches that overlap, lies inside one segment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import detect
from veilframe.plans.corpus import span_rows

#: Characters after which the next seam is looked for.
SEGMENT = 1 << 20
_LOWER = "[a-zß-öø-ÿ]+"
_SEAM = re.compile(rf"{_LOWER}(?: {_LOWER}){{4}}(?= {_LOWER})")


def seams(text: str, most: int) -> list[int]:
    """Where segments begin, and the end of the text. A segment is longer than ``most`` where the
    text offers no seam."""
    cuts = [0]
    while len(text) - cuts[-1] > most:
        found = _SEAM.search(text, cuts[-1] + most)
        if found is None:
            break
        cuts.append(found.end())
    return [*cuts, len(text)]


def segments(df: DataFrame, *keys: str, text: str = "text", most: int = SEGMENT) -> DataFrame:
    """``(keys, seq, at, segment)``: the parts of each text with the offset at which they begin. Texts up
    to ``most`` characters pass through as they are; a null text is one null segment."""
    long = F.coalesce(F.length(text) > most, F.lit(False))
    short = df.filter(~long).select(*keys, F.lit(0).alias("seq"), F.lit(0).cast("long").alias("at"), F.col(text).alias("segment"))
    rows = df.filter(long).select(*keys, F.col(text).alias("segment"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def cut(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                value = batch.column(batch.num_columns - 1)[row].as_py()
                places = seams(value, most)
                for seq, (a, z) in enumerate(zip(places, places[1:])):
                    one = [batch.column(i).slice(row, 1) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*one, pa.array([seq], pa.int32()), pa.array([a], pa.int64()), pa.array([value[a:z]], pa.string())], [*keys, "seq", "at", "segment"]
                    )

    # segments are dealt anew, so one long text is scanned by many tasks
    parts = rows.mapInArrow(cut, f"{kinds}, seq int, at long, segment string").repartition(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.col("seq")))
    return short.unionByName(parts)


def detect_long(df: DataFrame, *keys: str, text: str = "text", most: int = SEGMENT, detector: Callable[[Column], Column] = detect) -> DataFrame:
    """``(keys, category, start, end, text, confidence)``: the spans of ``detect``, one a row, offsets in
    the whole text. No row holds a text and all of its spans."""
    found = segments(df, *keys, text=text, most=most).withColumn("detections", detector(F.col("segment")))
    return span_rows(found, *keys, "at").select(
        *keys, "category", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), "text", "confidence"
    )
