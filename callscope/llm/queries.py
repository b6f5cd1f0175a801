"""The operators over their whole tables, as the driver runs them, and their SQL where SQL can say it."""

from __future__ import annotations

from .ann import neighbours
from .common import WORDS_SQL, table
from .decontaminate import K, WINDOW, decontaminate
from .edit_counts import edited_counts
from .jaccard_join import THRESHOLD, jaccard_join
from .language_id import identify
from .license_scan import license_scan
from .lm_score import lm_score
from .mixing import mix
from .token_output import token_output
from .url_rules import url_rules

_RUN = K + WINDOW - 1

OP3_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT DISTINCT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {_RUN}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {_RUN - 1})) AS i FROM w)),
b AS (SELECT item_id, j, array_to_string(w[j + 1:j + {_RUN}], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - {_RUN - 1})) AS j FROM v)),
h AS (SELECT DISTINCT doc_id, item_id, i, j FROM d JOIN b USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM h)
SELECT doc_id, item_id, CAST(min(i) AS BIGINT) AS doc_word, CAST(min(j) AS BIGINT) AS item_word, CAST(count(*) + {_RUN - 1} AS BIGINT) AS n_words
FROM r GROUP BY doc_id, item_id, i - j, run
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS gs FROM w),
d AS (SELECT *, row_number() OVER (ORDER BY doc_id, gs) AS k FROM (SELECT doc_id, CASE WHEN len(gs) > 0 THEN gs END AS gs FROM e)),
g AS (SELECT k, unnest(gs) AS g FROM d),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
h AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM c JOIN (SELECT k, len(gs) AS n FROM d) x ON x.k = a JOIN (SELECT k, len(gs) AS n FROM d) y ON y.k = b WHERE shared >= {THRESHOLD} * (x.n + y.n - shared) - 1e-9),
p AS (FROM h UNION ALL SELECT b, a, same FROM h),
r AS (SELECT k, k AS top FROM d UNION SELECT p.a, r.top FROM r JOIN p ON p.b = r.k),
m AS (SELECT k, min(top) AS top FROM r GROUP BY 1),
s AS (SELECT a AS k, count(*) AS links, min(b) FILTER (same) AS twin FROM p GROUP BY 1)
SELECT d.doc_id, t.doc_id AS class_id, least(d.doc_id, coalesce(u.doc_id, d.doc_id)) AS set_id, CAST(coalesce(s.links, 0) AS BIGINT) AS links
FROM d JOIN m ON m.k = d.k JOIN d t ON t.k = m.top LEFT JOIN s ON s.k = d.k LEFT JOIN d u ON u.k = s.twin
"""


def _documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_output": _documents(token_output),
    "op2_language_id": _documents(identify),
    "op3_decontaminate": lambda spark, sf_dir: decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op4_neighbours": lambda spark, sf_dir: neighbours(table(spark, sf_dir, "embeddings")),
    "op5_url_rules": lambda spark, sf_dir: url_rules(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    "op6_mix_sources": _documents(mix),
    "op7_license_scan": _documents(license_scan),
    "op8_jaccard_join": _documents(jaccard_join),
    "op9_lm_score": _documents(lm_score),
    "op10_edit_counts": _documents(edited_counts),
}

SQL = {"op3_decontaminate": OP3_SQL, "op8_jaccard_join": OP8_SQL}
