"""Reference SQL (DuckDB) for evaluation, partitioned search, endpoints and caches."""

from __future__ import annotations

from storyloom.plans import params as P
from storyloom.plans.oracle import CENTROIDS, accounting_sql, articles_cte, hits_ctes, with_
from storyloom.plans.oracle_generation import GROUND, PARSE, REPLIES

TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def toks(x: str) -> str:
    return TOKENS.format(x=x)


SAMPLES = f"""
cbx AS (SELECT h.topic_id, list(substr(coalesce(nullif(a.full_text, ''), a.headline, ''), 1, {P.CONTEXT_CHARS}) ORDER BY h.rank) AS contexts
        FROM hits h JOIN articles a ON a.id = h.id GROUP BY h.topic_id),
smp AS (SELECT b.item_id AS topic_id, b.text AS user_input, coalesce(f.summary, '') AS response,
               CASE WHEN coalesce(len(cbx.contexts), 0) > 0 THEN cbx.contexts ELSE [''] END AS retrieved_contexts,
               b.text AS reference
        FROM benchmark b LEFT JOIN final f ON f.topic_id = b.item_id LEFT JOIN cbx ON cbx.topic_id = b.item_id)"""

METRICS = rf"""
claims AS (SELECT topic_id, unnest(regexp_extract_all(response, '\[(\d+)\]', 1)) AS c FROM smp),
cl2 AS (SELECT c.topic_id, coalesce(ltrim(c.c, '0') <> '' AND (length(ltrim(c.c, '0')) < length(CAST(ns.n_sources AS VARCHAR))
               OR (length(ltrim(c.c, '0')) = length(CAST(ns.n_sources AS VARCHAR)) AND ltrim(c.c, '0') <= CAST(ns.n_sources AS VARCHAR))), false) AS supported
        FROM claims c LEFT JOIN ns ON ns.topic_id = c.topic_id),
faith AS (SELECT topic_id, avg(CAST(supported AS DOUBLE)) AS faithfulness FROM cl2 GROUP BY topic_id),
qtok AS (SELECT topic_id, unnest({toks('response')}) AS term FROM smp),
qtf AS (SELECT topic_id, term, count(*) AS tf FROM qtok GROUP BY topic_id, term),
qn AS (SELECT topic_id, sum(tf * tf) AS ss FROM qtf GROUP BY topic_id),
utok AS (SELECT topic_id, unnest({toks('user_input')}) AS term FROM smp),
utf AS (SELECT topic_id, term, count(*) AS tf FROM utok GROUP BY topic_id, term),
un AS (SELECT topic_id, sum(tf * tf) AS ss FROM utf GROUP BY topic_id),
qd AS (SELECT q.topic_id, sum(q.tf * u.tf) AS dot FROM qtf q JOIN utf u ON q.topic_id = u.topic_id AND q.term = u.term GROUP BY q.topic_id),
relv AS (SELECT s.topic_id, coalesce(CAST(qd.dot AS DOUBLE) / sqrt(CAST(qn.ss AS DOUBLE) * CAST(un.ss AS DOUBLE)), 0.0) AS answer_relevancy
         FROM smp s LEFT JOIN qd ON qd.topic_id = s.topic_id LEFT JOIN qn ON qn.topic_id = s.topic_id LEFT JOIN un ON un.topic_id = s.topic_id),
cv AS (SELECT topic_id, rank, CAST(similarity_score >= 0.3 AS DOUBLE) AS u FROM hits),
cp0 AS (SELECT *, sum(u) OVER w / count(*) OVER w AS p FROM cv
        WINDOW w AS (PARTITION BY topic_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cp AS (SELECT topic_id, CASE WHEN sum(u) > 0 THEN sum(p * u) / sum(u) ELSE 0.0 END AS context_precision FROM cp0 GROUP BY topic_id),
st AS (SELECT topic_id, unnest(ss) AS statement, unnest(generate_series(0, len(ss) - 1)) AS statement_id
       FROM (SELECT topic_id, list_filter(list_transform(string_split(reference, '. '), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
                                          lambda s: s <> '') AS ss FROM smp)),
cx AS (SELECT h.topic_id, coalesce(nullif(a.full_text, ''), a.headline, '') AS ctx FROM hits h JOIN articles a ON a.id = h.id),
att AS (SELECT DISTINCT st.topic_id, st.statement_id FROM st JOIN cx ON cx.topic_id = st.topic_id AND strpos(cx.ctx, st.statement) > 0),
cr AS (SELECT st.topic_id, avg(CASE WHEN att.topic_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS context_recall
       FROM st LEFT JOIN att ON att.topic_id = st.topic_id AND att.statement_id = st.statement_id GROUP BY st.topic_id),
perq AS (SELECT s.topic_id, s.user_input, faith.faithfulness, relv.answer_relevancy, cp.context_precision, cr.context_recall
         FROM smp s LEFT JOIN faith ON faith.topic_id = s.topic_id LEFT JOIN relv ON relv.topic_id = s.topic_id
         LEFT JOIN cp ON cp.topic_id = s.topic_id LEFT JOIN cr ON cr.topic_id = s.topic_id)"""

PAGES = r"""
pg AS (SELECT page_id AS collection_id, url,
              regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1) AS protocol,
              regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host,
              list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '') AS segs,
              list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '') AS kvs,
              regexp_extract(url, '#(.*)$', 1) AS fragment
       FROM pages),
ep AS (SELECT collection_id, CASE WHEN len(segs) >= 3 THEN '0.0.0' ELSE '0.0' END AS endpoint_path,
              'Page ' || CAST(collection_id AS VARCHAR) AS name,
              coalesce(segs[1], 'root') || CASE WHEN len(segs) >= 3 THEN ' > deep' ELSE '' END AS category,
              CASE WHEN fragment <> '' THEN 'POST' ELSE 'GET' END AS method,
              CASE WHEN fragment <> '' THEN url ELSE protocol || '://' || host || '/' || array_to_string(segs, '/') END AS url,
              CASE WHEN fragment <> '' THEN '' ELSE 'Fetch ' || url END AS description,
              CASE WHEN fragment <> '' THEN [] ELSE list_transform(kvs, lambda kv: {'key': split_part(kv, '=', 1),
                   'description': split_part(kv, '=', 2), 'disabled': split_part(kv, '=', 1) = 'ref'}) END AS params,
              fragment <> '' AS plain,
              'page ' || CAST(collection_id AS VARCHAR) AS var_desc
       FROM pg)"""


CHUNK_TEXT = """array_to_string(list_concat(
         ['Endpoint: ' || name, 'Category: ' || category, 'Method: ' || method, 'URL: ' || url],
         CASE WHEN description <> '' THEN [chr(10) || 'Description: ' || description] ELSE [] END,
         CASE WHEN plain THEN [] ELSE [chr(10) || 'Path Variables:', '  - page (string): ' || var_desc] END,
         CASE WHEN len(params) > 0 THEN list_concat([chr(10) || 'Query Parameters:'],
              list_transform(list_filter(params, lambda p: NOT p.disabled), lambda p: '  - ' || p.key || ': ' || p.description)) ELSE [] END,
         CASE WHEN plain THEN [chr(10) || 'Response Examples:', '  - ok (HTTP 200)'] ELSE [] END), chr(10))"""

DOC_HITS = f""",
ck AS (SELECT CAST(collection_id AS VARCHAR) || ':' || endpoint_path || ':0' AS id, name AS endpoint_name, category, method, url, {CHUNK_TEXT} AS text FROM ep),
asked AS (SELECT page_id AS topic_id, url AS topic FROM pages WHERE page_id % {P.SEARCH_STEP} = 0),
ctf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks('text')}) AS term FROM ck) GROUP BY id, term),
cn AS (SELECT id, sum(tf * tf) AS ss FROM ctf GROUP BY id),
qtf AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, unnest({toks('topic')}) AS term FROM asked) GROUP BY topic_id, term),
qn AS (SELECT topic_id, sum(tf * tf) AS ss FROM qtf GROUP BY topic_id),
dots AS (SELECT q.topic_id, c.id, sum(q.tf * c.tf) AS dot FROM qtf q JOIN ctf c ON q.term = c.term GROUP BY q.topic_id, c.id),
sc AS (SELECT a.topic_id, ck.*, coalesce(CAST(d.dot AS DOUBLE) / sqrt(CAST(cn.ss AS DOUBLE) * CAST(qn.ss AS DOUBLE)), 0.0) AS s
       FROM asked a CROSS JOIN ck LEFT JOIN dots d ON d.topic_id = a.topic_id AND d.id = ck.id LEFT JOIN cn ON cn.id = ck.id LEFT JOIN qn ON qn.topic_id = a.topic_id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, id) AS rank FROM sc) WHERE rank <= {P.DOC_SEARCH_K})"""

# The stand-in generator: right at once, right when told, or never (by the topic's length).
TOLD = """
final AS (SELECT item_id AS topic_id, CASE length(text) % 3 WHEN 0 THEN 1 ELSE 2 END AS attempt, length(text) % 3 <> 2 AS grounded,
                 CASE WHEN length(text) % 3 <> 2 THEN 'Sources [1] and [' || CAST(n AS VARCHAR) || '] tell of it.'
                      ELSE 'Source [' || CAST(n + 1 AS VARCHAR) || '] tells of it.' END AS summary, n
          FROM benchmark, (SELECT least({k}, count(*)) AS n FROM articles))"""


def hashed(name: str, key: str, text: str, table: str) -> str:
    """Counts with signs by dimension, their norm, and unit vectors as lists."""
    return f"""
{name}_t AS (SELECT {key} AS k, md5(term) AS h FROM (SELECT {key}, unnest({toks(text)}) AS term FROM {table})),
{name}_c AS (SELECT k, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {P.HASHED_DIM} AS d, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS c FROM {name}_t GROUP BY k, d),
{name}_n AS (SELECT k, sqrt(CAST(sum(c * c) AS DOUBLE)) AS norm FROM {name}_c GROUP BY k),
{name}_v AS (SELECT a.k, list(coalesce(c.c / nullif(n.norm, 0), 0.0) ORDER BY s.d) AS v
             FROM (SELECT DISTINCT {key} AS k FROM {table}) a CROSS JOIN (SELECT unnest(generate_series(0, {P.HASHED_DIM - 1})) AS d) s
             LEFT JOIN {name}_c c ON c.k = a.k AND c.d = s.d LEFT JOIN {name}_n n ON n.k = a.k GROUP BY a.k)"""


def more_sql() -> dict[str, str]:
    ev = hits_ctes(P.EVAL_K) + [REPLIES, PARSE, GROUND, SAMPLES]
    return {
        "vector_self_topk": f"""
SELECT anchor_id, rank, id, round(s, 6) AS similarity_score FROM (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
  FROM embeddings a JOIN embeddings e ON a.vec_id % {P.SEARCH_STEP} = 0 AND a.vec_id <> e.vec_id) WHERE rank <= {P.DENSE_K}""",
        "ivf_recall": f"""
SELECT count(*) AS n_queries, CAST(sum(least({P.DENSE_K}, (SELECT count(*) FROM embeddings))) AS BIGINT) AS n_exact, true AS enough_found
FROM embeddings WHERE vec_id % {P.SEARCH_STEP} = 0""",
        "label_similarity": """
SELECT CAST(a.label AS BIGINT) AS topic_id, count(*) AS n_pairs, round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS max_similarity, round(min(s), 6) AS min_similarity
FROM (SELECT a.label, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) a GROUP BY a.label""",
        "doc_search": with_(PAGES) + DOC_HITS + f"""
SELECT topic_id, rank, round(s, 6) AS similarity_score, endpoint_name, false AS fresh
FROM found""",
        "readable_hits": with_(PAGES) + DOC_HITS + f"""
SELECT topic_id, rank, chr(10) || repeat('=', 80) || chr(10) || 'Rank: ' || CAST(rank AS VARCHAR) || chr(10) || 'Similarity Score: ' || printf('%.4f', s) || chr(10)
       || 'Endpoint: ' || endpoint_name || chr(10) || 'Category: ' || category || chr(10) || 'Method: ' || method || chr(10) || 'URL: ' || url || chr(10) || chr(10) || text
       || CASE WHEN rank = max(rank) OVER (PARTITION BY topic_id) THEN chr(10) || chr(10) || repeat('=', 80) ELSE '' END AS block
FROM found""",
        "missing_ids": with_(*[c.replace("CAST(d.doc_id AS VARCHAR) AS id", "CASE d.doc_id % 3 WHEN 1 THEN '0' WHEN 2 THEN CAST(d.doc_id AS VARCHAR) END AS id") for c in articles_cte()]) + """
SELECT id, headline, date FROM articles""",
        "short_labels": """
SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS label,
       greatest(0.0, least(1.0, CAST(n_chars AS DOUBLE) / 1000.0 - 0.5)) AS share FROM documents""",
        "encode_documents": with_(*articles_cte(), hashed("a", "id", "full_text", "articles")) + """
SELECT k AS id, len(list_filter(v, lambda x: x <> 0)) AS n_used, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1,
       CASE WHEN len(list_filter(v, lambda x: x <> 0)) > 0 THEN list_position(v, list_max(v)) - 1 END AS top_dimension FROM a_v""",
        "dense_story": with_(*articles_cte(), hashed("a", "id", "full_text", "articles"), hashed("t", "item_id", "text", "benchmark")) + f"""
SELECT topic_id, rank, id, round(s, 6) AS similarity_score FROM (
  SELECT t.k AS topic_id, a.k AS id, list_dot_product(t.v, a.v) AS s, row_number() OVER (PARTITION BY t.k ORDER BY list_dot_product(t.v, a.v) DESC, a.k) AS rank
  FROM t_v t, a_v a) WHERE rank <= {P.DENSE_K}""",
        "encoder_hook": with_(*articles_cte()) + """
SELECT id, length(full_text) AS n_chars, length(full_text) - length(replace(full_text, 'e', '')) AS n_e FROM articles""",
        "article_raw": with_(*articles_cte()) + """
SELECT a.id, a.headline, d.n_chars, d.lang AS meta_lang, d.source AS meta_source FROM articles a JOIN documents d ON a.id = CAST(d.doc_id AS VARCHAR)""",
        "feed_accounting": accounting_sql(),
        "generate_loop": with_(*articles_cte(), TOLD.format(k=P.LOOP_K)) + """
SELECT topic_id, CAST(attempt AS BIGINT) AS attempt, grounded, summary, n AS n_sources, CAST(1 AS BIGINT) AS n_timeline FROM final""",
        "evaluation_run": with_(*hits_ctes(P.EVAL_K), TOLD.format(k=P.EVAL_K), "ns AS (SELECT topic_id, count(*) AS n_sources FROM hits GROUP BY topic_id)", SAMPLES, METRICS) + """
SELECT user_input, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy,
       round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM perq""",
        "eval_samples": with_(*ev) + """
SELECT topic_id, user_input, response, len(retrieved_contexts) AS n_contexts,
       array_to_string(retrieved_contexts, chr(10) || '||' || chr(10)) AS contexts, reference FROM smp""",
        "eval_metrics": with_(*ev, METRICS) + """
SELECT topic_id, user_input, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy,
       round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM perq""",
        "eval_aggregate": with_(*ev, METRICS) + """
SELECT count(*) AS num_samples, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy), 6) AS answer_relevancy,
       round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM perq""",
        "ivf_topk": with_(CENTROIDS, f"""
asg AS (SELECT id, embedding, list_id FROM (
          SELECT e.id, e.embedding, c.list_id,
                 row_number() OVER (PARTITION BY e.id ORDER BY list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) DESC, c.list_id) AS r
          FROM emb e, cent c) WHERE r = 1),
probes AS (SELECT topic_id, qv, list_id FROM (
          SELECT q.list_id AS topic_id, q.centroid AS qv, c.list_id,
                 row_number() OVER (PARTITION BY q.list_id ORDER BY list_dot_product(q.centroid, c.centroid) DESC, c.list_id) AS r
          FROM cent q, cent c) WHERE r <= {P.IVF_NPROBE}),
cand AS (SELECT p.topic_id, a.id, list_dot_product(p.qv, CAST(a.embedding AS DOUBLE[])) AS s FROM probes p JOIN asg a ON a.list_id = p.list_id)""") + f"""
SELECT topic_id, rank, id, round(s, 6) AS similarity_score
FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, id) AS rank FROM cand) WHERE rank <= {P.DENSE_K}""",
        "endpoint_rows": with_(PAGES) + """
SELECT collection_id, endpoint_path, name, category, method, url, description, len(params) AS n_parameters,
       array_to_string(list_transform(params, lambda p: p.key || '=' || p.description || ':' || CAST(p.disabled AS VARCHAR)), ',') AS parameters,
       CASE WHEN plain THEN '' ELSE 'page:string' END AS path_variables,
       CASE WHEN plain THEN 'ok:200:OK' ELSE '' END AS responses
FROM ep""",
        "endpoint_chunks": with_(PAGES) + """
SELECT collection_id, endpoint_path, CAST(0 AS BIGINT) AS part,
       """ + CHUNK_TEXT + """ AS text,
       name AS endpoint_name, category, method, url
FROM ep""",
        "incremental_embed": with_(*articles_cte()) + f""",
k AS (SELECT id, full_text, date, md5('{P.MODEL_NAME}' || '|' || full_text) AS key FROM articles),
r1 AS (SELECT DISTINCT key FROM k WHERE substr(date, 1, 7) = '2024-01'),
dk AS (SELECT DISTINCT key, full_text FROM k),
tk AS (SELECT key, unnest({toks('full_text')}) AS term FROM dk),
tfq AS (SELECT key, term, count(*) AS c FROM tk GROUP BY key, term),
kv AS (SELECT key, count(*) AS n_terms, sum(c * c) AS sumsq FROM tfq GROUP BY key)
SELECT k.id, k.key, coalesce(kv.n_terms, 0) AS n_terms, CAST(coalesce(kv.sumsq, 0) AS BIGINT) AS sumsq,
       CAST(CASE WHEN r1.key IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS round
FROM k LEFT JOIN kv ON kv.key = k.key LEFT JOIN r1 ON r1.key = k.key""".replace("\nWITH", "WITH"),
        "answer_reuse": with_(*hits_ctes(P.DOC_SEARCH_K)) + f""",
cv AS (SELECT CAST(count(*) AS VARCHAR) || '-' || CAST(coalesce(sum(CAST('0x' || substr(md5(id || chr(31) || full_text), 1, 12) AS BIGINT)), 0) AS VARCHAR) AS version FROM articles),
tk AS (SELECT item_id AS topic_id, md5(text || '|' || '{P.DOC_SEARCH_K}' || '|' || '{P.MODEL_NAME}' || '|' || version) AS key,
              upper(substr(text, 1, 1)) BETWEEN 'A' AND 'M' AS first_batch FROM benchmark, cv),
firstkeys AS (SELECT DISTINCT key FROM tk WHERE first_batch)
SELECT tk.topic_id, tk.key, h.rank, h.id, round(h.similarity_score, 6) AS similarity_score,
       CASE WHEN f.key IS NOT NULL THEN 'store' ELSE 'fresh' END AS served_from
FROM tk JOIN hits h ON h.topic_id = tk.topic_id LEFT JOIN firstkeys f ON f.key = tk.key""",
        "vector_stats": """
SELECT b.total_vectors, b.embedding_dim, b.labels, a.n_vectors, a.n_items, a.items_without_vector, a.vectors_without_item, a.bad_dimension
FROM (SELECT count(v.id) AS n_vectors, count(i.id) AS n_items,
             count(*) FILTER (WHERE v.id IS NULL) AS items_without_vector,
             count(*) FILTER (WHERE i.id IS NULL) AS vectors_without_item,
             count(*) FILTER (WHERE v.id IS NOT NULL AND v.d <> 64) AS bad_dimension
      FROM (SELECT vec_id AS id, len(embedding) AS d FROM embeddings) v
      FULL OUTER JOIN (SELECT doc_id AS id FROM documents) i ON v.id = i.id) a,
     (SELECT count(*) AS total_vectors, max(len(embedding)) AS embedding_dim, count(DISTINCT label) AS labels FROM embeddings) b""",
        "article_validation": with_(*articles_cte()) + """
SELECT count(*) FILTER (WHERE headline <> '' AND content <> '') AS valid,
       count(*) FILTER (WHERE NOT (headline <> '' AND content <> '')) AS quarantined FROM articles""",
    }
