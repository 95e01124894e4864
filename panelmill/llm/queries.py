"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, line_dedup, ngram_join, packing, quality, secrets, sentence_pieces, spelling, topk, toxicity, warc, whitening
from .common import table


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what decoding makes of them."""
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return sentence_pieces.with_decoded(coded)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.write_and_read(table(spark, sf_dir, "pages"))
    return found.where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.identifier_dictionary(docs)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_pieces, op2_packing, op3_line_dedup, op4_top_k, op5_warc, op6_exact_dedup, op7_html_extract, op8_ngram_join, op9_toxicity,
        op10_quality, op11_spelling, op12_whitening, op13_secrets,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> keep THEN keep END AS refers_to
        FROM q""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op8_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (
            SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ')
                ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS gram
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
        both_ AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * same >= 90 * (p.size + q.size - same)),
        reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION
            SELECT reach.node, CASE WHEN links.x = reach.other THEN links.y ELSE links.x END
            FROM reach JOIN links ON links.x = reach.other OR links.y = reach.other)
        SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, r.component_id
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id""",
}
