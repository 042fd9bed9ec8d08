"""A token-classification model in place of the rules: text -> token table -> spans.

``model_detector`` gives the spans of a text as a column, so masking and the gateway take a model
as they take the rules. ``detect_with_model`` gives a table of spans instead, which can be stored
once and joined to the texts by id wherever they are masked (``stored_detections``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.spans import SPAN_TYPE
from veilframe.operators.tokens import BIOES_LABELS, decode_bioes, score_tokens

# texts -> per text a list of (start, end, logits) in reading order
Predict = Callable[[list[str]], list[list[tuple[int, int, list[float]]]]]
BATCH = 64
BATCH_CHARS = 1 << 18
BATCH_TOKENS = 1 << 13
# models that this worker process has loaded, by detector
_loaded: dict[str, Predict] = {}


def _labels(logits: list, names: tuple[str, ...]) -> tuple[list[int], list[str], list[float]]:
    """Places of the tokens whose largest logit is a label other than ``O`` (as any beyond the names is),
    those labels and their probabilities."""
    scores = np.asarray(logits, dtype=float)
    best = scores.argmax(1)
    marked = np.flatnonzero(np.array([n != "O" for n in names])[np.minimum(best, len(names) - 1)] & (best < len(names)))
    some = scores[marked]
    probs = 1.0 / np.exp(some - some.max(1, keepdims=True)).sum(1) if len(marked) else np.empty(0)
    return marked.tolist(), [names[i] for i in best[marked].tolist()], probs.tolist()


def bioes_spans(tokens: list[tuple], names: tuple[str, ...] = BIOES_LABELS) -> list[tuple[str, int, int, float]]:
    """``(category, start, end, confidence)`` of one text's tokens, by the rules of ``decode_bioes``."""
    if not tokens:
        return []
    places, labels, probs = _labels([t[2] for t in tokens], names)
    out, run = [], None  # run: category and the first and last of its labelled tokens

    def close() -> None:
        category, first, last = run
        start, end = tokens[places[first]][:2], tokens[places[last]][:2]
        if None not in (start[0], start[1], end[1]) and start != (0, 0):
            out.append((category, start[0], end[1], float(np.mean(probs[first:last + 1]))))

    for i, label in enumerate(labels):
        prefix, category = label[:1], label[2:]
        if label[1:2] != "-" or prefix not in "BIES" or category not in fixed.CATEGORIES:
            prefix, category = "O", None
        if run is not None and places[i] == places[run[2]] + 1 and prefix in ("I", "E") and category == run[0]:
            run = (category, run[1], i)
            if prefix == "E":
                close()
                run = None
            continue
        if run is not None:
            close()
            run = None
        if prefix in ("S", "B"):
            run = (category, i, i)
            if prefix == "S":
                close()
                run = None
    if run is not None:
        close()
    return sorted(out, key=lambda s: s[1])


def model_detector(load: Callable[[], Predict], labels: tuple[str, ...] = BIOES_LABELS, batch: int = BATCH) -> Callable[[Column], Column]:
    """A detector for ``redact_corpus``, ``Context`` and the streams. ``load`` runs once per worker
    process; texts come in Arrow batches and go to the model ``batch`` at a time. Null and blank
    texts have no spans and are not sent to it. Spans that overlap an earlier one are dropped, as
    masking wants them apart."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from veilframe.operators import model

        if name not in model._loaded:
            model._loaded[name] = load()
        predict = model._loaded[name]
        for column in batches:
            texts = column.to_pylist()
            spans: list[list] = [[] for _ in texts]
            filled = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(filled), batch):
                some = filled[at:at + batch]
                for i, tokens in zip(some, predict([texts[i] for i in some])):
                    last = 0
                    for category, start, end, confidence in bioes_spans(tokens, labels):
                        if start >= last and end > start:
                            spans[i].append({"category": category, "start": start, "end": end, "text": texts[i][start:end], "confidence": confidence})
                            last = end
            yield pa.array(spans, _ARROW_SPANS)

    detect = F.arrow_udf(run, SPAN_TYPE)
    return lambda text: detect(text)


_ARROW_SPANS = pa.list_(pa.struct([
    ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()),
]))


def stored_detections(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``detections`` from a table of spans ``(key, category, start, end, confidence)``, as stored by
    ``detect_with_model``; rows without spans have none. Only spans are shuffled with the texts,
    nothing is detected again. A text has a bounded number of spans, as its tokens are bounded."""
    span = F.struct("start", "end", "category", "confidence")
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("_spans"))

    def shown(s: Column) -> Column:
        return F.struct(
            s["category"].alias("category"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
            F.substr(F.col(text), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("text"), s["confidence"].alias("confidence"),
        )

    joined = df.join(listed, key, "left")
    none = F.array().cast(SPAN_TYPE)
    return joined.withColumn("detections", F.coalesce(F.transform("_spans", shown), none)).drop("_spans")


def token_table(df: DataFrame, doc: str, text: str, load: Callable[[], Predict]) -> DataFrame:
    """``(doc, idx, t_start, t_end, logits)``. ``load`` runs once per task and returns the
    model; texts arrive in Arrow batches, go to it in groups of bounded size, and rows leave
    as they come. Blank texts are not sent to it."""
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at, end in _groups(texts):
                yield from _token_batches(doc, keys.slice(at, end - at), predict(texts[at:end]))

    texts = df.select(doc, text).filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return texts.mapInArrow(run, f"{doc} {kind}, idx long, t_start int, t_end int, logits array<double>")


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that go to the model together: at most ``BATCH``, and of several not more than
    ``BATCH_CHARS`` characters, since every token comes back with a vector."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and (i - at == BATCH or size + len(text) > BATCH_CHARS):
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _token_batches(doc: str, keys: pa.Array, results: list) -> Iterator[pa.RecordBatch]:
    """Rows of the token table, ``BATCH_TOKENS`` at a time."""
    for key, tokens in zip(range(len(keys)), results):
        for at in range(0, len(tokens), BATCH_TOKENS):
            starts, ends, logits = zip(*tokens[at:at + BATCH_TOKENS])
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array([key] * n, pa.int64())), pa.array(range(at, at + n), pa.int64()),
                    pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), _vectors(logits),
                ],
                [doc, "idx", "t_start", "t_end", "logits"],
            )


def _vectors(logits: tuple) -> pa.Array:
    """Vectors as Arrow lists, whatever their lengths."""
    offsets = np.cumsum([0, *map(len, logits)], dtype=np.int32)
    flat = np.concatenate([np.asarray(v, dtype=float) for v in logits]) if len(set(map(len, logits))) > 1 else np.asarray(logits, dtype=float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def detect_with_model(
    df: DataFrame, doc: str, text: str, load: Callable[[], Predict], labels: tuple[str, ...] = BIOES_LABELS
) -> DataFrame:
    """Spans ``(doc, category, start, end, confidence)`` found by a model."""
    scored = score_tokens(token_table(df, doc, text, load), "logits", labels)
    return decode_bioes(scored, doc, "idx", "label", "t_start", "t_end", "prob")
