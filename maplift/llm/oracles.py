"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from maplift.llm.registry import LLM_ORACLE

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def space_words(col: str = "text", lower: bool = True) -> str:
    return SPACE_WORDS.format(_LOWER.format(col) if lower else f"coalesce({col}, '')")


def alnum_words(col: str = "text") -> str:
    return ALNUM_WORDS.format(_LOWER.format(col))


LLM_ORACLE["op1_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {space_words()} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
      FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, t.b FROM reach r JOIN both_ways t ON r.c = t.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""

LLM_ORACLE["op2_decontaminate"] = f"""
WITH bw AS (SELECT item_id, {alnum_words()} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
       FROM bw, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, {alnum_words()} AS w FROM documents),
pos AS (SELECT doc_id, sizes.n, i, array_to_string(w[i:i + sizes.n - 1], ' ') AS t
        FROM dw, (SELECT DISTINCT n FROM iw) sizes, unnest(range(1, len(w) - sizes.n + 2)) u(i)),
m AS (SELECT pos.doc_id, pos.i, pos.n, iw.item_id FROM pos JOIN iw ON pos.n = iw.n AND pos.t = iw.t),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) u(k) GROUP BY 1),
item AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM m GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_ESCAPED = r"""regexp_replace(replace({0}, '\', '\\'), '([<\[])(s>|/s>|TURN |INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')"""

LLM_ORACLE["op5_chat_format"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length('[TURN ' || replace({_ESCAPED.format('role')}, ']', '\]') || ']' || chr(10) || {_ESCAPED.format('text')} || '</s>') AS n,
             row_number() OVER w AS k, max(k0) OVER (PARTITION BY conv_id) AS last
      FROM (SELECT *, row_number() OVER w AS k0 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, 3 + sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR k = last), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

LLM_ORACLE["op6_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {space_words(lower=False)} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM d, unnest(range(1, len(w) - 48)) u(i)),
low AS (SELECT t, min(doc_id) AS low FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, k FROM win JOIN low USING (t), unnest(range(i, i + 50)) u(k) WHERE doc_id > low),
word AS (SELECT doc_id, k, w[k] AS x FROM d, unnest(range(1, len(w) + 1)) u(k)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

LLM_ORACLE["op12_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
