"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.ann import search
from rasterweave.llm.exact_dedup import exact_dedup
from rasterweave.llm.mixing import mix_sources
from rasterweave.llm.near_join import near_components
from rasterweave.llm.packing import pack_documents
from rasterweave.llm.pseudonyms import private_values, session_key
from rasterweave.llm.quality import fit_quality, score_quality
from rasterweave.llm.spans import remove_repeats
from rasterweave.llm.token_store import read_tokens, token_folder, write_tokens
from rasterweave.llm.tokens import WORD_BPE, tokenizer_path
from rasterweave.llm.toxicity import fit_toxicity, score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(_documents(spark, sf_dir), token_folder(spark), tokenizer_path(WORD_BPE), end_id=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_values(_documents(spark, sf_dir), session_key(spark))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=1, max_tokens=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_files, op3_feistel_pseudonyms, op4_vector_packing, op5_additive_quantisation, op6_toxicity_chain, op7_ngram_jaccard, op8_quality_trees, op9_sentence_spans, op10_source_mixing)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op7_ngram_jaccard": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        k AS MATERIALIZED (SELECT ws, min(doc_id) AS t FROM w GROUP BY ws),
        s AS MATERIALIZED (SELECT t, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct([ws[i:i + 4] for i in range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM k),
        n AS MATERIALIZED (SELECT t, count(*) AS n FROM s GROUP BY t),
        h AS MATERIALIZED (SELECT t, dense_rank() OVER (ORDER BY g) AS g FROM s),
        m AS MATERIALIZED (SELECT h.t, n.n, h.g FROM h JOIN n USING (t) WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
        c AS (SELECT a.t AS a, b.t AS b, count(*) AS k, any_value(a.n) AS x, any_value(b.n) AS y FROM m a JOIN m b ON a.g = b.g AND a.t < b.t AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY a.t, b.t),
        l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * k >= 75 * (x + y - k)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT t, t AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.t),
        f AS (SELECT t, min(root) AS root FROM r GROUP BY t)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN len(w.ws) = 0 THEN w.doc_id ELSE f.root END AS component_id
        FROM w JOIN k USING (ws) JOIN f USING (t) LEFT JOIN n USING (t)""",
    "op10_source_mixing": r"""
        WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        u AS (SELECT *, (('0x' || substr(md5('7:' || doc_id || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM z),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
        s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
        s2 AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3::DOUBLE AS most FROM s1),
        s3 AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
                      sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s2),
        s4 AS (SELECT *, given + most / weight * open_weight <= total AS full_ FROM s3),
        s5 AS (SELECT source, source_size, CASE WHEN full_ THEN most ELSE (total - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER ()) * weight / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS target FROM s4),
        s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM s5),
        s7 AS (SELECT *, floor(due + 1e-9::DOUBLE) AS whole, greatest(0, due - floor(due + 1e-9::DOUBLE)) AS p FROM s6),
        s8 AS (SELECT *, greatest(0, target - whole * source_size) AS open_words FROM s7),
        r AS (SELECT u.*, s.source_size, s.target, s.whole, s.open_words, CASE WHEN p > 1e-9 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM u JOIN s8 s ON u.source IS NOT DISTINCT FROM s.source),
        c AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= open_words AS chosen FROM r),
        g AS (SELECT *, open_words - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
        k AS (SELECT *, NOT chosen AND rank IS NOT NULL AND size > 0 AND abs(size - gap) < gap AS fits FROM g),
        f AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), doc_id, size) = 1 AS closes FROM k)
        SELECT doc_id, size, source_size, target, ((whole + CASE WHEN chosen OR closes THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM f""",
}
