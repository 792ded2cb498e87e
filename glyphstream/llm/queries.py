"""Queries of this subpackage and the SQL that DuckDB runs for those that SQL can express."""

from __future__ import annotations

from glyphstream.llm.ann import op10_vantage_point_search
from glyphstream.llm.decontam import op5_decontamination
from glyphstream.llm.html_extract import op6_html_extraction
from glyphstream.llm.langid import op3_language_id
from glyphstream.llm.lm_scoring import op1_lm_scoring
from glyphstream.llm.packing import op8_bin_completion_packing
from glyphstream.llm.secrets import op7_secret_scan
from glyphstream.llm.simhash import op2_simhash_dedup
from glyphstream.llm.toxicity import op4_toxicity
from glyphstream.llm.warc import op9_warc_segments

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_simhash_dedup, op3_language_id, op4_toxicity, op5_decontamination, op6_html_extraction, op7_secret_scan, op8_bin_completion_packing, op9_warc_segments, op10_vantage_point_search)}

ORACLE_SQL = {
    "op9_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM f""",
    "op10_vantage_point_search": """
        WITH v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id,
                          list_inner_product(q.e, c.e) / (sqrt(list_inner_product(c.e, c.e)) * sqrt(list_inner_product(q.e, q.e))) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
             r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
