"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from preflight.llm.context_tree import op12_context_tree
from preflight.llm.decontaminate import op9_decontaminate
from preflight.llm.language import op2_language
from preflight.llm.line_dedup import OP3_SQL, op3_line_dedup
from preflight.llm.minhash import OP4_SQL, op4_near_duplicates
from preflight.llm.neighbours import op10_nearest
from preflight.llm.packing import op7_packing
from preflight.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from preflight.llm.suffix_dedup import op1_suffix_dedup
from preflight.llm.token_alignment import op13_token_alignment
from preflight.llm.token_count import op8_token_count
from preflight.llm.toxicity import op5_toxicity
from preflight.llm.url_filter import op6_sql, op6_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language": op2_language,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_token_count": op8_token_count,
    "op9_decontaminate": op9_decontaminate,
    "op10_nearest": op10_nearest,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_context_tree": op12_context_tree,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, s, n, w[s:s + n - 1] AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

ORACLE_SQL = {
    "op3_line_dedup": OP3_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op6_url_filter": op6_sql(),
    "op9_decontaminate": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
}
