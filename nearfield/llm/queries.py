"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import pii
from nearfield.llm.chat import VOCABULARY, digest_chat, format_chat, load_ranks
from nearfield.llm.common import read
from nearfield.llm.embedding_dedup import embedding_dedup
from nearfield.llm.exact_dedup import exact_dedup
from nearfield.llm.mixing import mix
from nearfield.llm.packing import pack
from nearfield.llm.quality import classify
from nearfield.llm.simhash import simhash_components
from nearfield.llm.substring_dedup import substring_dedup
from nearfield.llm.url_filter import filter_urls


#: The conversation that the query adds, of control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PLANTED, turns.schema))
    ranks = load_ranks(spark, VOCABULARY)
    return digest_chat(format_chat(turns, ranks), ranks).drop("n_tokens", "n_loss_tokens")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_format, op3_url_filter, op4_exact_dedup, op5_simhash, op6_pii, op7_embedding_dedup, op8_quality, op9_mixing, op10_packing)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f AS (SELECT *, len(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) + CASE role
                WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 17
                     + len(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) END AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
               CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op3_url_filter": r"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        v AS (SELECT *, CASE
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h)
        SELECT page_id, host, path, rule, CASE
                WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN md5(host || path) LIKE '0%' THEN 'block' ELSE 'allow' END AS verdict FROM v""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op7_embedding_dedup": """
        WITH RECURSIVE d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        v AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM d
              WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        r(u, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.r = l.u),
        c AS (SELECT u, min(r) AS component_id FROM r GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN n ON vec_id = n.u JOIN c ON vec_id = c.u""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source),
        w AS (SELECT *, CAST([3, 1, 2][(source_rank - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap,
                     sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT *, (SELECT arg_min(level, (cap / w, source_rank)) FROM l WHERE level * w <= cap) AS fill FROM l),
        t AS (SELECT source, source_size, source_rank, total, CASE WHEN fill IS NULL THEN cap ELSE least(cap, fill * w) END AS target FROM f),
        q AS (SELECT d.doc_id, d.key, d.size, t.*, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT q.*, p, CAST(source_size * p + upto AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS v(p) WHERE size > 0 AND target > 0),
        c AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, source_rank, p, key, doc_id ROWS UNBOUNDED PRECEDING) <= total AS fits FROM e),
        k AS (SELECT doc_id, count(*) FILTER (fits) AS passes FROM c GROUP BY doc_id)
        SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(passes, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)""",
}
