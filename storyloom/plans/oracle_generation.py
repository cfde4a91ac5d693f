"""Reference SQL (DuckDB) for the generation/grounding queries."""

from __future__ import annotations

from storyloom.plans import params as P
from storyloom.plans.oracle import SUMMARY, hits_ctes, reason_sql, with_

NL = "chr(10)"

REPLIES = f"""
hstat AS (SELECT topic_id, count(*) AS n, arg_min(id, rank) AS id1, arg_max(id, CASE WHEN rank <= 2 THEN rank END) AS id2
          FROM hits GROUP BY topic_id),
tt AS (SELECT b.item_id AS topic_id, coalesce(h.n, 0) AS n, coalesce(h.id1, 'none') AS id1, coalesce(h.id2, 'none') AS id2
       FROM benchmark b LEFT JOIN hstat h ON h.topic_id = b.item_id),
rv AS (SELECT *, '[{{"id": "' || id1 || '", "why_it_matters": "first report"}}, {{"id": "' || id2 || '", "why_it_matters": "follow-up"}}]' AS tlv FROM tt),
rv2 AS (SELECT *, '{{"summary": "Coverage of the topic [1] and its follow-up [2].", "timeline": ' || tlv || '}}' AS valid FROM rv),
replies AS (
  SELECT topic_id, CAST(a AS BIGINT) AS attempt,
         CASE topic_id % 15
           WHEN 0 THEN valid
           WHEN 1 THEN 'The object follows.' || {NL} || '```json' || {NL} || valid || {NL} || '```' || {NL} || 'End of reply'
           WHEN 2 THEN 'Notes {{rough draft}} and now the result: ' || valid || ' (final version)'
           WHEN 3 THEN CASE WHEN a = 1 THEN '{{"summary": "Claim [1] and [0] and [' || CAST(n + 1 AS VARCHAR) || '].", "timeline": ' || tlv || '}}' ELSE valid END
           WHEN 4 THEN '{{"summary": "Nobody is quoted in this text.", "timeline": ' || tlv || '}}'
           WHEN 5 THEN '{{"summary": "Cited [1].", "timeline": [{{"id": "' || id1 || '", "why_it_matters": "ok"}}, {{"id": "fake-' || CAST(topic_id AS VARCHAR) || '", "why_it_matters": "made up"}}]}}'
           WHEN 6 THEN '{{"summary": "Big [99999999999999999999] claim [1].", "timeline": ' || tlv || '}}'
           WHEN 7 THEN CASE WHEN a = 1 THEN 'busy, please ask later' ELSE valid END
           WHEN 8 THEN ''
           WHEN 9 THEN valid || ' trailing words'
           WHEN 10 THEN '[' || valid || ']'
           WHEN 11 THEN '{{"summary": "Numbers [1].", "timeline": [{{"id": ' || CASE WHEN regexp_full_match(id1, '[0-9]+') THEN id1 ELSE '"' || id1 || '"' END || ', "why_it_matters": "numeric id"}}]}}'
           -- Replies with a repeated key or a NaN: the plain object that they stand for.
           WHEN 12 THEN '{{"summary": "Repeated key [1].", "timeline": ' || tlv || '}}'
           WHEN 13 THEN '{{"summary": "Not a number [1].", "timeline": ' || tlv || '}}'
           ELSE '{{"summary": "Long [' || repeat('9', 40) || '] claim [01].", "timeline": ' || tlv || '}}'
         END AS reply
  FROM rv2, (VALUES (1), (2)) v(a))"""

FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"

PARSE = f"""
cand AS (SELECT topic_id, attempt,
                CASE WHEN regexp_extract(coalesce(reply, ''), '{FENCE}', 1) <> ''
                     THEN regexp_extract(coalesce(reply, ''), '{FENCE}', 1) ELSE coalesce(reply, '') END AS c
         FROM replies),
chars AS (SELECT topic_id, attempt, c, unnest(string_split(c, '')) AS ch, unnest(generate_series(1, length(c))) AS p
          FROM cand WHERE NOT coalesce(json_valid(c), false) AND contains(c, '{{')),
br AS (SELECT *, sum(CASE WHEN ch = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY topic_id, attempt ORDER BY p
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d
       FROM chars WHERE ch = '{{' OR ch = '}}'),
lv AS (SELECT *, CASE WHEN ch = '{{' THEN d ELSE d + 1 END AS lvl FROM br),
sp AS (SELECT topic_id, attempt, c, ch, p, lead(ch) OVER w AS nch, lead(p) OVER w AS np FROM lv
       WINDOW w AS (PARTITION BY topic_id, attempt, lvl ORDER BY p)),
found AS (SELECT topic_id, attempt, arg_min(substr(c, p, np - p + 1), p) AS obj FROM sp
          WHERE ch = '{{' AND nch = '}}' AND coalesce(json_valid(substr(c, p, np - p + 1)), false) GROUP BY topic_id, attempt),
parsed0 AS (SELECT x.topic_id, x.attempt,
                   CASE WHEN coalesce(json_valid(x.c), false) THEN (CASE WHEN json_type(x.c) = 'OBJECT' THEN x.c END) ELSE f.obj END AS json_text
            FROM cand x LEFT JOIN found f ON f.topic_id = x.topic_id AND f.attempt = x.attempt),
pj AS (SELECT topic_id, attempt, json_text, json_text IS NOT NULL AS parsed,
              coalesce(json_extract_string(json_text, '$.summary'), '') AS summary,
              coalesce(json_extract(json_text, '$.timeline[*]'), []::JSON[]) AS tl
       FROM parsed0)"""

GROUND = r"""
ns AS (SELECT topic_id, count(*) AS n_sources FROM hits GROUP BY topic_id),
ent AS (SELECT topic_id, attempt, unnest(tl) AS e, unnest(generate_series(0, len(tl) - 1)) AS entry_pos FROM pj),
ent2 AS (SELECT topic_id, attempt, entry_pos, json_extract_string(e, '$.id') AS id,
                json_extract_string(e, '$.why_it_matters') AS why_it_matters FROM ent),
badtl AS (SELECT e.topic_id, e.attempt, count(*) AS n_bad_timeline FROM ent2 e
          LEFT JOIN hits h ON h.topic_id = e.topic_id AND h.id = e.id WHERE h.id IS NULL GROUP BY e.topic_id, e.attempt),
g0 AS (SELECT p.*, coalesce(ns.n_sources, 0) AS n_sources, coalesce(b.n_bad_timeline, 0) AS n_bad_timeline,
              list_distinct(list_transform(regexp_extract_all(p.summary, '\[(\d+)\]', 1),
                                           lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS cited
       FROM pj p LEFT JOIN ns ON ns.topic_id = p.topic_id
       LEFT JOIN badtl b ON b.topic_id = p.topic_id AND b.attempt = p.attempt),
g1 AS (SELECT *, list_transform(list_sort(list_transform(
          list_filter(cited, lambda c: c = '0' OR length(c) > length(CAST(n_sources AS VARCHAR))
                                       OR (length(c) = length(CAST(n_sources AS VARCHAR)) AND c > CAST(n_sources AS VARCHAR))),
          lambda c: {'digits': length(c), 'c': c})), lambda x: x.c) AS bad FROM g0),
g2 AS (SELECT *, list_filter([
          CASE WHEN len(bad) > 0 THEN 'The summary cites non-existent source numbers ['
               || array_to_string(bad, ', ') || ']; only [1]..['
               || CAST(n_sources AS VARCHAR) || '] exist.' END,
          CASE WHEN n_sources > 0 AND len(cited) = 0 THEN 'The summary contains no [n] citations; cite the sources you used.' END,
          CASE WHEN n_bad_timeline > 0 THEN CAST(n_bad_timeline AS VARCHAR)
               || ' timeline entries reference ids that are not among the retrieved sources; only use the exact id values shown.' END],
          lambda x: x IS NOT NULL) AS problems FROM g1),
report AS (SELECT topic_id, attempt, summary, n_sources, len(cited) AS n_cited,
                  CASE WHEN len(bad) > 0 THEN '[' || array_to_string(bad, ', ') || ']' ELSE '' END AS bad_citations,
                  n_bad_timeline, len(problems) = 0 AS grounded,
                  array_to_string(list_transform(problems, lambda q: '- ' || q), chr(10)) AS feedback
           FROM g2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grounded DESC,
                                  CASE WHEN grounded THEN attempt ELSE -attempt END) AS r
                        FROM report WHERE attempt <= {max_attempts}) WHERE r = 1),
final AS (SELECT b.item_id AS topic_id,
                 CASE WHEN ns.topic_id IS NULL THEN 1 ELSE best.attempt END AS attempt,
                 CASE WHEN ns.topic_id IS NULL THEN 'No source articles were retrieved for ''' || b.text || '''.'
                      ELSE coalesce(best.summary, '') END AS summary,
                 CASE WHEN ns.topic_id IS NULL THEN true ELSE best.grounded END AS grounded
          FROM benchmark b LEFT JOIN ns ON ns.topic_id = b.item_id LEFT JOIN best ON best.topic_id = b.item_id),
ctl AS (SELECT e.topic_id, e.entry_pos, e.id, e.why_it_matters FROM ent2 e
        JOIN best ON best.topic_id = e.topic_id AND best.attempt = e.attempt
        WHERE EXISTS (SELECT 1 FROM hits h WHERE h.topic_id = e.topic_id AND h.id = e.id))""".replace("{max_attempts}", str(P.MAX_ATTEMPTS))


def generation_sql() -> dict[str, str]:
    base = hits_ctes() + [REPLIES, PARSE]
    full = base + [GROUND]
    return {
        "reply_json": with_(*base) + """
SELECT topic_id, attempt, parsed, summary, len(tl) AS n_timeline,
       array_to_string(list_transform(tl, lambda e: json_extract_string(e, '$.id')), ',') AS timeline_ids FROM pj""",
        "grounding_report": with_(*full) + """
SELECT topic_id, attempt, n_sources, n_cited, bad_citations, n_bad_timeline, grounded, feedback FROM report""",
        "best_attempt": with_(*full) + "SELECT * FROM final",
        "clean_timeline": with_(*full) + "SELECT * FROM ctl",
        "context_blocks": with_(*hits_ctes()) + f"""
SELECT h.topic_id, count(*) AS n_sources,
       string_agg('[' || CAST(h.rank AS VARCHAR) || '] (id=' || h.id || ', date=' || a.date || ', source=' || a.source || ')' || chr(10)
                  || substr(coalesce(nullif(a.full_text, ''), a.headline, ''), 1, {P.CONTEXT_CHARS}), chr(10) || chr(10) ORDER BY h.rank) AS context_block
FROM hits h JOIN articles a ON a.id = h.id GROUP BY h.topic_id""",
        "generation_mode": with_(*full, SUMMARY) + """
SELECT s.topic_id, CASE WHEN coalesce(f.summary, '') <> '' THEN 'rag_vllm' ELSE 'heuristic' END AS generation_mode,
       CASE WHEN s.article_count > 0 AND coalesce(f.summary, '') <> '' THEN f.summary ELSE s.summary END AS narrative_summary
FROM summary s LEFT JOIN final f ON f.topic_id = s.topic_id""",
        "timeline_reasons": with_(*full) + f""",
gen AS (SELECT topic_id FROM final WHERE coalesce(summary, '') <> ''),
rs AS (SELECT c.topic_id, c.id, arg_max(c.why_it_matters, c.entry_pos) AS generated FROM ctl c
       WHERE c.topic_id IN (SELECT topic_id FROM gen) AND coalesce(c.why_it_matters, '') <> '' GROUP BY c.topic_id, c.id)
SELECT t.topic_id, t.pos, t.id, coalesce(rs.generated, {reason_sql(P.AS_OF)}) AS why_it_matters
FROM ta t LEFT JOIN rs ON rs.topic_id = t.topic_id AND rs.id = t.id""".replace("\nWITH", "WITH"),
    }
