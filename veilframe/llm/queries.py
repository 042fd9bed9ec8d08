"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.embedding_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.language_model import score_texts

    return score_texts(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.toxicity import score_toxicity

    return score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.decontamination import benchmark_matches

    return benchmark_matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.quality import score_quality

    return score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.substring_dedup import repeated_passages

    return repeated_passages(_documents(spark, sf_dir)).drop("text_hash", "spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.jaccard_join import similar_sets

    return similar_sets(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.wavelet import store_and_read

    return store_and_read(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.filter_audit import filter_audit

    return filter_audit(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.best_fit_packing import best_fit

    packed = best_fit(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


_FUNCTIONS = (
    op1_embedding_dedup, op2_token_counts, op3_language_model, op4_toxicity, op5_benchmark_decontamination, op6_substring_dedup, op7_quality, op8_wavelet_shards, op9_jaccard_join, op10_mixture_packing,
    op11_filter_audit, op12_embedding_whitening, op13_best_fit_packing,
)
QUERIES = {q.__name__: q for q in _FUNCTIONS}
_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENTS = """walk(id, other) AS (SELECT id, id FROM nodes UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.other),
 component AS (SELECT id, min(other) AS component_id FROM walk GROUP BY id)"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 nodes AS (SELECT id FROM v),
 good AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.93), {_COMPONENTS}
 SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
 starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
 windows AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win FROM starts),
 again AS (SELECT doc_id, i FROM windows JOIN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1) r USING (win)),
 gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS places FROM again GROUP BY doc_id)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda p: places IS NULL OR NOT list_contains(places, p)), lambda p: words[p]), ' ')) AS kept_sha256
 FROM w LEFT JOIN gone USING (doc_id)""",
    "op9_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
 nodes AS (SELECT id FROM w),
 shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
 sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
 shared AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {_COMPONENTS}
 SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM component LEFT JOIN sizes USING (id)""",
    "op11_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
 cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
 letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 steps AS (SELECT o, s, o[s] AS own, o[1:s - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
 hit AS (SELECT part, o, s, own, n, good, toxic, contains(fails, own) AS fails_own, length(translate(fails, earlier, '')) < length(fails) AS gone, fails = own AS alone
  FROM cells, steps),
 sums AS (SELECT part, o, s, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_own), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND fails_own), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails_own), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0) AS toxic_lost
  FROM hit GROUP BY part, o, s, own)
 SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums""",
}
