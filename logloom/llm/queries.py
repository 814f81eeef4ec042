"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, html_text, langid, media, mixing, neardup, quality, secret_scan, token_counts, topk
from logloom.llm.common import durable, remove, shared_folder, table

#: Where the ranks of the tokenizer are; the installed package has the file on every machine.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = topk.Params()
    rows = topk.quantised(table(spark, sf_dir, "embeddings"), p)
    return topk.search(rows, rows.where("vec_id % 50 = 0"), p)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


#: Target shares of tokens by language; what they leave goes to other languages. Sources and topics are flattened by the default power.
MIXTURE = mixing.Params(targets={"lang": {"en": 0.35, "de": 0.2, "es": 0.2, "fr": 0.2}}, budget=0.5)


def op4_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"), MIXTURE)


def op5_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-rollups-{uuid.uuid4().hex}"
    store = token_counts.Rollup(spark, path)
    batches = token_counts.change_log(table(spark, sf_dir, "documents"))
    for k, batch in enumerate(batches):
        store.apply(k, batch)
    for k, batch in enumerate(batches):  # delivered again: adds nothing
        store.apply(k, batch)
    found = durable(store.totals(), 1)
    remove(spark, path)
    return found


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op10_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mtree_topk,
        op2_importance_resampling,
        op3_setsketch_neardup,
        op4_raked_mixing,
        op5_kneser_ney_langid,
        op6_tree_bpe,
        op7_delta_rollups,
        op8_text_density,
        op9_mpeg_audio,
        op10_structural_secrets,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_mtree_topk": """
        WITH fine AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, unnest(q) AS v, unnest(range(len(q))) AS i FROM fine
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.v * b.v) AS BIGINT) AS score
            FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0
            GROUP BY 1, 2
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op3_setsketch_neardup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
        ), both_ways AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r
        )
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
        FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
    """,
    "op7_delta_rollups": r"""
        WITH live AS (
            SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                   CASE WHEN doc_id % 2 = 0 THEN 'words-2' ELSE 'words-1' END AS tokenizer,
                   CASE WHEN text IS NULL THEN 0
                        WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]+'))
                        ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS tokens
            FROM documents WHERE doc_id % 10 <> 3
        )
        SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM live GROUP BY ALL
    """,
}
