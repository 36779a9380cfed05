"""The op<N> queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm import ann, bestfit, decontam, gbdt, html_extract, langid, packing, pii, rollup, simhash
from rulespark.llm.common import crc_fold, materialize, scratch, table


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_matrices(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts as a first load, revised to token counts; a second load by mistake, deleted again;
    retries of two batches, and a compaction between. What stays is each document's tokens, once."""
    docs = table(spark, sf_dir, "documents")
    words, tokens = rollup.count_words(docs), materialize(rollup.count_tokens(docs), "token-counts")
    totals = rollup.TokenRollup(spark, scratch(spark, "token-rollup"))
    totals.commit("load-1", rollup.inserts(words))
    totals.commit("load-2", rollup.inserts(tokens))
    totals.commit("revise-1", rollup.revisions(words, tokens))
    totals.compact("until-revision")
    totals.commit("revise-1", rollup.revisions(words, tokens))
    totals.commit("undo-2", rollup.deletes(tokens))
    totals.commit("load-1", rollup.inserts(words))
    return totals.totals()


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def _fold_is(doc_id: str, folds: int, fold: int):
    return F.coalesce(crc_fold(F.col(doc_id), folds) == fold, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _fold_is("doc_id", 3, 1)
    model = langid.fit(docs, ~held_out)
    found = langid.predict(docs.select("doc_id", "text"), model, ("lang_pred", "score", "ambiguous"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = """
WITH doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
item_starts AS (
  SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS a
  FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, a, array_to_string(w[a:a + n - 1], ' ') AS g FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
doc_starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, sizes WHERE len(w) >= n),
grams AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM doc_starts),
pairs AS (SELECT r, p, n, item_id, a FROM grams JOIN windows USING (n, g)),
hits AS (SELECT DISTINCT r, p, n, item_id FROM pairs),
runs AS (
  SELECT r, p, n, item_id, a, p - row_number() OVER (PARTITION BY r, item_id, p - a ORDER BY p) AS k FROM pairs),
matches AS (
  SELECT r, min(p) - 1 AS spot, count(*) + n - 1 AS words, item_id FROM runs GROUP BY r, item_id, p - a, k, n),
longest AS (
  SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, spot, item_id) = 1),
covered AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
met AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(words, 0) AS BIGINT) AS longest_match,
  CAST(coalesce(spot, -1) AS BIGINT) AS longest_at, CAST(item_id AS BIGINT) AS longest_item
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN met USING (r) LEFT JOIN longest USING (r)
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _fold_is("doc_id", 5, 0)
    found = gbdt.quality(docs.select("doc_id", "text"), labels.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: f
        for name, f in sorted(globals().items())
        if name.startswith("op") and name[2].isdigit()
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_benchmark_decontamination": OP7_SQL}
