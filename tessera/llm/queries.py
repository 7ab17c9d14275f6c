"""The queries of this package for __spark_entry__.py, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, chat, langid, licences, media, ngram_join, packing, pages, pieces, pii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_sentencepiece_sampling": pieces.op2_sentencepiece_sampling,
    "op3_inverted_multi_index": ann.op3_inverted_multi_index,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_pii_sanitisation": pii.op5_pii_sanitisation,
    "op6_media_columns": media.op6_media_columns,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_language_id": langid.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_html_extraction": pages.op10_html_extraction,
}

#: All pairs that share a shingle, and what they reach: exact, and meant for small tables only.
_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i : i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""

ORACLE_SQL: dict[str, str] = {"op7_ngram_jaccard_join": _NGRAM_JOIN}
