"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from suitelens.llm.chat_format import OTHER, TEMPLATE, marks


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', _SPACED)} AS w FROM documents),
  windows AS (SELECT r, doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS k
              FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
  ranked AS (SELECT r, s, doc_id, first_value(doc_id) OVER o AS d1, first_value(s) OVER o AS s1
             FROM windows WINDOW o AS (PARTITION BY k ORDER BY doc_id, s)),
  gone AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM ranked WHERE doc_id > d1 OR (doc_id = d1 AND s > s1)),
  words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
  removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)"""

OP3 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v AS q JOIN v AS c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  windows AS (SELECT r, doc_id, s, substr(h, 2 * s + 1, 100) AS k
              FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
  least AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k HAVING count(*) > 1),
  gone AS (SELECT r, s FROM windows JOIN least USING (k) WHERE doc_id > f),
  marked AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 50, true)::INT AS new FROM gone),
  numbered AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM marked),
  spans AS (SELECT r, min(s) AS a, max(s) + 50 AS z FROM numbered GROUP BY r, g),
  gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM spans),
  kept AS (SELECT r, count(*) AS n, sum(z - a) AS bytes, max(z) AS last, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS t
           FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_lower('text'), _ALNUM)} AS w FROM documents),
  b AS (SELECT item_id, {_words(_lower('text'), _ALNUM)} AS w FROM benchmark),
  asked AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
  windows AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
              FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM asked) ON len(w) >= n)),
  hits AS (SELECT r, n, s, item_id FROM windows JOIN asked USING (n, k)),
  hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + n)) FROM hits) GROUP BY r),
  items AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_lower('text'), _SPACED)} AS w FROM documents),
  shingles AS (SELECT DISTINCT r, array_to_string(list_slice(w, s, s + 4), ' ') AS k
               FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
  sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
  common AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM shingles AS a JOIN shingles AS b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2),
  links AS (SELECT x, y FROM common JOIN sizes AS u ON u.r = x JOIN sizes AS v ON v.r = y WHERE 100 * i >= 75 * (u.n + v.n - i)),
  both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
  reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, y FROM reach JOIN both_ways ON x = t),
  least AS (SELECT reach.r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d JOIN least USING (r) LEFT JOIN sizes USING (r)"""


def _escaped() -> str:
    out = r"replace(text, '\', '\\')"
    for m in marks():
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return out


def _mark_chars() -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(m['open'] + m['close'])}" for r, m in TEMPLATE.items())
    return f"CASE role {known} ELSE {sum(map(len, OTHER.values()))} + length({_escaped().replace('text', 'role', 1)}) END"


OP9 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
          sum(length({_escaped()}) + {_mark_chars()}) AS chars, string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text) AS roles
        FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars, regexp_full_match(roles, '(system,)?(user,assistant,)+') AS valid
FROM c"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_lower('text'), _TERM)} AS ts FROM documents),
  docs AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
  total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM docs),
  tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
  weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term),
  asked AS (SELECT DISTINCT item_id, unnest({_words(_lower('text'), _TERM)}) AS term FROM benchmark),
  scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
             FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""

ORACLES = {"op2_suffix_trees": OP2, "op3_top_products": OP3, "op5_prefix_doubling": OP5, "op7_decontaminate": OP7, "op8_shingle_join": OP8,
           "op9_chat_format": OP9, "op11_fp_tree_search": OP11}
