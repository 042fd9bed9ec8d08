"""Registered queries: detection, scan summaries, token spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.functions.arrays import explode_rows
from veilframe.functions.spans import detect, detect_category, safe_spans
from veilframe.operators import model, tokens
from veilframe.plans import corpus
from veilframe.sources.storage import durable, spread

QUERIES, ORACLES = {}, {}


def _one_category(category: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = fixtures.documents(spark, sf)
        rows = docs.select("doc_id", detect_category(F.col("text"), category).alias("detections"))
        return corpus.span_rows(rows, "doc_id").select(
            "doc_id", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
            F.col("text").alias("span_text"),
        )

    return run


for _c in fixed.CATEGORIES:
    QUERIES[f"detect_{_c}"] = _one_category(_c)
    ORACLES[f"detect_{_c}"] = (
        f"WITH {S.documents_cte()}, {S.matches('src', (_c,))} "
        "SELECT k AS doc_id, category, s AS span_start, s + n AS span_end, span_text FROM placed"
    )


def detect_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.detect_corpus(fixtures.documents(spark, sf))
    return corpus.span_rows(rows, "doc_id").select(
        "doc_id", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.col("text").alias("span_text"), "confidence",
    )


QUERIES["detect_documents"] = detect_documents
ORACLES["detect_documents"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT k AS doc_id, category, s AS span_start, "
    "e AS span_end, span_text, CAST(0.95 AS DOUBLE) AS confidence FROM spans"
)


def _detect_in(table, keys: tuple[str, ...], text: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = corpus.detect_corpus(table(spark, sf), text)
        return corpus.span_rows(rows, *keys).select(
            *keys, "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
            F.sha2("text", 256).alias("span_hash"),
        )

    return run


QUERIES["detect_pages"] = _detect_in(fixtures.pages, ("page_id",), "html")
ORACLES["detect_pages"] = (
    f"WITH RECURSIVE src AS (SELECT page_id AS k, html AS text FROM ({fixtures.PAGES}) p), {S.spans('src')} SELECT k AS page_id, "
    "category, s AS span_start, e AS span_end, sha256(span_text) AS span_hash FROM spans"
)
QUERIES["detect_conversations"] = _detect_in(fixtures.conversations, ("conv_id", "turn"), "text")
ORACLES["detect_conversations"] = (
    f"WITH RECURSIVE src AS (SELECT conv_id * 100000 + turn AS k, text FROM ({fixtures.CONVERSATIONS}) c), {S.spans('src')} "
    "SELECT k // 100000 AS conv_id, k % 100000 AS turn, category, s AS span_start, e AS span_end, "
    "sha256(span_text) AS span_hash FROM spans"
)


def transaction_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.bank(sf)["transactions"](spark)
    texts = rows.groupBy("description").agg(F.count("*").alias("rows"))
    found = corpus.detect_corpus(texts, "description")
    return (
        explode_rows(found.select("rows", "detections"), F.col("detections"), "d")
        .groupBy(F.col("d.category").alias("category"), F.col("d.text").alias("span_text"))
        .agg(F.sum("rows").alias("occurrences"))
    )


QUERIES["detect_transaction_descriptions"] = transaction_spans
ORACLES["detect_transaction_descriptions"] = (
    f"WITH RECURSIVE transactions AS ({fixtures.TRANSACTIONS}), src AS (SELECT row_number() OVER () AS k, description AS text, n AS rows "
    f"FROM (SELECT description, count(*) AS n FROM transactions GROUP BY 1) d), {S.spans('src')} "
    "SELECT category, span_text, CAST(sum(rows) AS BIGINT) AS occurrences FROM spans JOIN src USING (k) GROUP BY 1, 2"
)


def spans_above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.documents(spark, sf)
    out = docs.select("doc_id", F.lit(0.7).alias("t"), detect(F.col("text")).alias("d"))
    return out.select(
        "doc_id",
        F.size(F.filter("d", lambda s: s["confidence"] >= F.col("t"))).alias("kept"),
        F.size(F.filter("d", lambda s: s["confidence"] >= 0.99)).alias("kept_at_099"),
    )


QUERIES["spans_above_threshold"] = spans_above_threshold
ORACLES["spans_above_threshold"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT d.doc_id, count(s.k) AS kept, 0 AS kept_at_099 "
    "FROM docs d LEFT JOIN spans s ON s.k = d.doc_id GROUP BY d.doc_id"
)


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.summarize_corpus(fixtures.documents(spark, sf))
    return out.select(
        "doc_id", "scan.has_pii", "scan.confidence",
        F.array_join("scan.detected_types", ",").alias("detected_types"),
        F.size("scan.detections").alias("n_detections"),
    )


QUERIES["scan_summary"] = scan_summary
ORACLES["scan_summary"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT d.doc_id, count(s.k) > 0 AS has_pii, "
    "CASE WHEN count(s.k) > 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence, "
    "coalesce(string_agg(DISTINCT s.category, ',' ORDER BY s.category), '') AS detected_types, count(s.k) AS n_detections "
    "FROM docs d LEFT JOIN spans s ON s.k = d.doc_id GROUP BY d.doc_id"
)


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.span_rows(corpus.detect_corpus(fixtures.documents(spark, sf)), "doc_id", "source")
    return rows.groupBy("source", "category").agg(
        F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents")
    )


QUERIES["category_counts"] = category_counts
ORACLES["category_counts"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT d.source, s.category, count(*) AS spans, "
    "count(DISTINCT s.k) AS documents FROM spans s JOIN docs d ON d.doc_id = s.k GROUP BY 1, 2"
)


def audit_safe_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.detect_corpus(fixtures.documents(spark, sf))
    rows = docs.select("doc_id", safe_spans(F.col("detections")).alias("detections"))
    return corpus.span_rows(rows, "doc_id").select(
        "doc_id", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.col("text").alias("safe_text"),
    )


QUERIES["audit_safe_spans"] = audit_safe_spans
ORACLES["audit_safe_spans"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT k AS doc_id, category, s AS span_start, "
    "e AS span_end, '[' || category || ']' AS safe_text FROM spans"
)


def spans_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Spans numbered by descending start, the order in which policies visit them."""
    docs = corpus.detect_corpus(fixtures.documents(spark, sf))
    rows = explode_rows(docs.select("doc_id", "detections"), F.reverse("detections"), "s", "visit")
    return rows.select("doc_id", "visit", "s.category", F.col("s.start").alias("span_start"))


QUERIES["spans_in_visit_order"] = spans_sorted
ORACLES["spans_in_visit_order"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT k AS doc_id, "
    "row_number() OVER (PARTITION BY k ORDER BY s DESC) - 1 AS visit, category, s AS span_start FROM spans"
)

# --- token tables --------------------------------------------------------------
# words of the documents with labels, offsets and probabilities fixed by position
_TAGS = (
    "CASE h % 19 WHEN 0 THEN 'B-private_person' WHEN 1 THEN 'I-private_person' WHEN 2 THEN 'I-private_person' "
    "WHEN 3 THEN 'E-private_person' WHEN 4 THEN 'S-private_email' WHEN 5 THEN 'B-secret' WHEN 6 THEN 'E-secret' "
    "WHEN 7 THEN 'I-secret' WHEN 8 THEN 'B-unknown_category' WHEN 9 THEN 'GARBAGE' WHEN 10 THEN '' "
    "WHEN 11 THEN 'X-secret' WHEN 12 THEN 'E-private_person' WHEN 13 THEN 'B-private_person' ELSE 'O' END"
)
_HASH = "(idx * 7 + doc_id * 13 + idx * idx) % 10007"
TOKENS = (
    f"SELECT doc_id, idx, {_TAGS} AS label, CASE WHEN h % 29 = 0 THEN NULL WHEN h % 31 = 0 THEN 0 ELSE t_start END AS tok_start, "
    "CASE WHEN h % 29 = 0 THEN NULL WHEN h % 31 = 0 THEN 0 ELSE t_end END AS tok_end, CAST(50 + h % 50 AS DOUBLE) / 100 AS prob, text "
    f"FROM (SELECT *, {_HASH} AS h FROM words) w"
)
_WORDS_SQL = (
    "words AS (SELECT doc_id, text, idx, CAST(ending - length(w) AS BIGINT) AS t_start, CAST(ending AS BIGINT) AS t_end "
    "FROM (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS ending FROM "
    "(SELECT doc_id, text, unnest(ws) AS w, unnest(range(0, len(ws))) AS idx FROM "
    "(SELECT doc_id, text, string_split(text, ' ') AS ws FROM documents) d) e) f)"
)


def token_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(fixtures.source(spark, sf, "documents")).select("doc_id", "text")
    words = tokens.split_words(docs, "doc_id", "text")
    return spark.sql(TOKENS.replace("FROM words", "FROM {words}"), words=words)


def bioes_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = token_table(spark, sf)
    parsed = tokens.parse_label(F.col("label"))
    return t.groupBy("label", parsed["prefix"].alias("prefix"), parsed["category"].alias("category")).agg(
        F.count("*").alias("tokens")
    )


QUERIES["bioes_labels"] = bioes_labels
_PARSED = (
    "CASE WHEN regexp_matches(label, '^[BIES]-(" + "|".join(fixed.CATEGORIES) + ")$') THEN substr(label, 1, 1) ELSE 'O' END AS prefix, "
    "CASE WHEN regexp_matches(label, '^[BIES]-(" + "|".join(fixed.CATEGORIES) + ")$') THEN substr(label, 3) END AS category"
)
ORACLES["bioes_labels"] = (
    f"WITH {_WORDS_SQL}, tokens AS ({TOKENS}) SELECT label, {_PARSED}, count(*) AS tokens FROM tokens GROUP BY 1, 2, 3"
)


def bioes_spans(spark: SparkSession, sf: str) -> DataFrame:
    stored = durable(token_table(spark, sf).drop("text"), "tokens")
    spans = tokens.decode_bioes(stored, "doc_id", "idx", "label", "tok_start", "tok_end", "prob")
    docs = fixtures.source(spark, sf, "documents").select("doc_id", "text")
    return tokens.with_span_text(spans, docs, "doc_id", "text").select(
        "doc_id", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        "span_text", F.round("confidence", 6).alias("confidence"),
    )


QUERIES["bioes_spans"] = bioes_spans
# sequential reading, one token at a time: state = open span of the document
ORACLES["bioes_spans"] = (
    f"WITH {_WORDS_SQL}, tokens AS (SELECT *, {_PARSED} FROM ({TOKENS}) t), "
    "tagged AS (SELECT *, lag(prefix) OVER w AS p_prefix, lag(category) OVER w AS p_category FROM tokens "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), "
    "starts AS (SELECT *, sum(CASE WHEN prefix IN ('S', 'B', 'O') OR p_prefix IS NULL OR p_prefix IN ('S', 'E', 'O') "
    "OR category IS DISTINCT FROM p_category THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM tagged), "
    "grouped AS (SELECT doc_id, island, arg_min(prefix, idx) AS first_prefix, min(category) AS category, "
    "min(idx) AS i0, max(idx) AS i1, avg(prob) AS confidence FROM starts GROUP BY 1, 2), "
    "ends AS (SELECT g.doc_id, g.category, a.tok_start AS s, a.tok_end AS first_end, b.tok_end AS e, g.confidence, a.text "
    "FROM grouped g JOIN starts a ON a.doc_id = g.doc_id AND a.idx = g.i0 JOIN starts b ON b.doc_id = g.doc_id AND b.idx = g.i1 "
    "WHERE g.first_prefix IN ('S', 'B')) "
    "SELECT doc_id, category, s AS span_start, e AS span_end, CASE WHEN e > s THEN substr(text, s + 1, e - s) ELSE '' END AS span_text, "
    "round(confidence, 6) AS confidence FROM ends WHERE s IS NOT NULL AND e IS NOT NULL AND NOT (s = 0 AND first_end = 0)"
)


def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Argmax label and softmax probability over a vector of logits per row."""
    vectors = fixtures.source(spark, sf, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double"))
    scored = tokens.score_tokens(vectors.select("vec_id", logits.alias("logits")), "logits", tokens.BIOES_LABELS)
    return scored.select("vec_id", "label", F.round("prob", 6).alias("prob"))


QUERIES["token_scores"] = token_scores
_LABELS = "[" + ", ".join(S.text(x) for x in tokens.BIOES_LABELS) + "]"
ORACLES["token_scores"] = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings), "
    "m AS (SELECT *, list_max(l) AS top FROM v) "
    f"SELECT vec_id, coalesce({_LABELS}[list_position(l, top)], 'O') AS label, "
    "round(1.0 / list_sum(list_transform(l, lambda x: exp(x - top))), 6) AS prob FROM m"
)


# --- a model instead of the rules: words with marks get high scores ----------------------
# (label, pattern of the word): the first that matches counts
_MODEL_RULES = (
    ("S-private_email", r"^[^@ ]+@[^@ ]+$"), ("S-secret", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("S-private_url", r"^https?://"),
    ("B-private_person", r"^Alice$"), ("E-private_person", r"^Smith$"), ("S-private_date", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
)


def _load_model():
    import re

    # all patterns begin at the start of the word, so that alternatives are tried in their order
    known = re.compile("|".join(f"({pattern})" for _, pattern in _MODEL_RULES))
    size = len(tokens.BIOES_LABELS)
    marks = [0] + [tokens.BIOES_LABELS.index(label) for label, _ in _MODEL_RULES]
    vectors = [[8.0 if i == label else 0.0 for i in range(size)] for label in marks]

    def predict(texts):
        out = []
        for text in texts:
            at, row = 0, []
            for word in text.split(" "):
                end, found = at + len(word), known.match(word)
                row.append((at, end, vectors[found.lastindex if found else 0]))
                at = end + 1
            out.append(row)
        return out

    return predict


def _masked_by_model(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.size("detections").alias("n_spans"), F.col("decision.action").alias("verdict"),
        F.array_join("decision.categories", ",").alias("categories"), F.sha2("decision.sanitized_text", 256).alias("masked_text_hash"),
    )


def mask_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Documents masked by what a model finds in them, as a column of the plan."""
    out = corpus.redact_corpus(
        fixtures.documents(spark, sf), "strict_financial", "outbound", request_id=F.col("doc_id").cast("string"), threshold=fixed.PII_THRESHOLD,
        detector=model.model_detector(_load_model),
    )
    return _masked_by_model(out)


def mask_by_stored_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stored table of the model's spans, joined to the documents by id."""
    docs = fixtures.documents(spark, sf)
    spans = durable(model.detect_with_model(docs, "doc_id", "text", _load_model), "spans")
    found = model.stored_detections(docs, "doc_id", "text", spans.filter(F.col("confidence") >= fixed.PII_THRESHOLD))
    return _masked_by_model(corpus.mask_corpus(found, "strict_financial", "outbound", request_id=F.col("doc_id").cast("string")))


QUERIES["mask_by_model"] = mask_by_model
QUERIES["mask_by_stored_spans"] = mask_by_stored_spans
_MODEL_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(word, {S.text(p)}) THEN '{label}'" for label, p in _MODEL_RULES) + " ELSE 'O' END"
ORACLES["mask_by_model"] = ORACLES["mask_by_stored_spans"] = (
    f"WITH {S.documents_cte()}, {S.rules_cte()}, {_WORDS_SQL.replace('FROM documents', 'FROM docs')}, "
    f"said AS (SELECT *, {_MODEL_LABEL} AS label FROM (SELECT *, substr(text, t_start + 1, t_end - t_start) AS word FROM words) w), "
    "beside AS (SELECT *, lead(label) OVER w AS next_label, lead(t_end) OVER w AS next_end FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), "
    "spans AS (SELECT doc_id AS k, text, substr(label, 3) AS category, t_start AS s, e, substr(text, t_start + 1, e - t_start) AS span_text FROM "
    "(SELECT *, CASE WHEN label = 'B-private_person' AND next_label = 'E-private_person' THEN next_end ELSE t_end END AS e FROM beside "
    "WHERE label LIKE 'S-%' OR label LIKE 'B-%') b WHERE e > t_start AND NOT (t_start = 0 AND t_end = 0)), "
    f"{S.judged('outbound', S.text('strict_financial'))} "
    f"SELECT d.doc_id, coalesce(v.n_spans, 0) AS n_spans, {S.decision_action()} AS verdict, "
    "CASE WHEN v.blocked THEN '' ELSE coalesce(v.categories, '') END AS categories, "
    "CASE WHEN coalesce(v.blocked, false) THEN NULL ELSE sha256(coalesce(m.mutated, d.text)) END AS masked_text_hash "
    "FROM docs d LEFT JOIN verdicts v ON v.k = d.doc_id LEFT JOIN spliced m ON m.k = d.doc_id"
)
