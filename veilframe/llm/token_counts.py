"""Token counts of a sentencepiece model without encoding documents.

A text is cut at the places no piece of the model can span: before each run of blanks, and
around line feeds. Each distinct pre-token of the corpus is encoded once. A document's count is
the sum over its pre-tokens of frequency times count, so no ids are ever made for documents."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.counting import HEAD, Head, piece_counts, rare_pieces
from veilframe.llm.store import Workspace
from veilframe.llm.text import Texts, blocks, run_ids, slice_hashes

_MARK = "▁"  # the model's sign for a blank; in a text it counts as one


@functools.cache
def _model(path: str):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    rule = spec.normalizer_spec
    if (spec.trainer_spec.model_type, rule.name, rule.remove_extra_whitespaces) != (2, "identity", False) or not rule.add_dummy_prefix:
        raise ValueError("only byte-pair models that keep texts as they are can be cut at blanks")
    if any(_MARK in p.piece.lstrip(_MARK) or ("\n" in p.piece and len(p.piece) > 1) for p in spec.pieces):
        raise ValueError("a piece of this model goes over a blank or a line feed")
    rule.add_dummy_prefix = False  # pretokens() puts that blank in
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def pretokens(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as the model sees them, start and end byte of each pre-token, each text's first."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lead = np.where(pc.binary_length(column).to_numpy(zero_copy_only=False) > 0, " ", "")
    filled = pc.binary_join_element_wise(pa.array(lead, pa.large_string()), column, pa.scalar("", pa.large_string()))
    texts = Texts(pc.replace_substring(filled, _MARK, " "))
    blank, feed = texts.data == 0x20, texts.data == 0x0A
    before, _ = texts.marks(blank)
    start = feed | (blank & before)
    start[1:] |= feed[:-1]
    start[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(texts.data))[:len(starts)]
    return texts, starts, ends, np.searchsorted(starts, texts.offsets)


def _count(model: str, pieces: pa.Array) -> list[int]:
    encoder = _model(model)
    return [len(x) for x in encoder.encode(pieces.to_pylist(), num_threads=1)] if len(pieces) else []


def token_counts(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", limit: int = 4096, head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per id: UTF-8 bytes and tokens of the whole text,
    without begin, end or added tokens; over_limit: n_tokens > limit.

    A null text counts as empty and has no token. Rows that share an id (null is an id) are parts
    of one document: their counts add up. Other columns are not read. An empty table gives none.
    `head` bounds the broadcast lookup; rarer pre-tokens are joined by a shuffle."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            yield pa.record_batch({"piece": batch.column(0), "n": batch.column(1), "tokens": pa.array(_count(model, batch.column(0)), pa.int64())})

    with Workspace(spark, "token-counts") as work:
        distinct = work.table(piece_counts(docs, "text", pretokens).mapInArrow(count, "piece string, n long, tokens long"), "pretokens")
        frequent = spark.sparkContext.broadcast(Head(distinct, "tokens", head))

        def add(batches):
            known = frequent.value
            for batch, _ in blocks(batches, "text"):
                texts, starts, ends, first = pretokens(batch.column(1))
                hashes = slice_hashes(texts.data, starts, ends)
                here, at = known.find(hashes)
                tokens = np.where(here, known.values[at] if len(known.values) else 0, 0)
                sums = np.concatenate([[0], np.cumsum(tokens)])
                yield pa.record_batch({
                    "id": batch.column(0),
                    "n_bytes": pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    "n_tokens": pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()),
                    "rare": rare_pieces(texts, starts, ends, hashes, run_ids(first), ~here),
                })

        kind = docs.schema["id"].dataType.simpleString()
        counted = work.table(docs.mapInArrow(add, f"id {kind}, n_bytes long, n_tokens long, rare array<struct<piece: string, n: long>>"), "documents")
        rare = (
            counted.select("id", F.explode("rare").alias("r")).select("id", "r.piece", "r.n")
            .join(distinct.select("piece", "tokens"), "piece")
            .groupBy("id").agg(F.sum(F.col("n") * F.col("tokens")).alias("n_tokens"))
            .select("id", F.lit(0).cast("long").alias("n_bytes"), "n_tokens")
        )
        total = counted.select("id", "n_bytes", "n_tokens").unionByName(rare).groupBy("id").agg(
            F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        result = work.keep(total.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
        frequent.unpersist()
        return result
