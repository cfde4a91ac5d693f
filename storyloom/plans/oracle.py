"""Reference SQL (DuckDB dialect) for every registered query.

Each statement recomputes the query from the raw tables with plain SQL, independently of
the Spark code path, so a Spark result can be checked against it.  Shared steps are
written once as CTE fragments and stitched together with ``with_``.
"""

from __future__ import annotations

from storyloom.plans import params as P


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ shared fragments
RAW = r"""
raw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         string_split(d.text, chr(10))[1] AS title,
         CASE WHEN len(string_split(d.text, chr(10))) > 1
              THEN array_to_string(string_split(d.text, chr(10))[2:], chr(10)) ELSE '' END AS content,
         strftime(e.ts + to_days(CAST(d.doc_id % 90 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%f') AS published_at,
         d.source AS source,
         CAST(l.quality * 10 AS VARCHAR) AS source_rating,
         d.lang AS contentType
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)"""

# Date ladder: cut at '+', then '.', try the five layouts in order, else keep the raw text.
DATE_PARTS = r"""
dparts AS (
  SELECT r.*,
         split_part(split_part(published_at, '+', 1), '.', 1) AS cl,
         regexp_extract(split_part(split_part(published_at, '+', 1), '.', 1), '^(.*?)(Z|-(\d\d):?([0-5]\d))$', 1) AS zbody,
         regexp_extract(split_part(split_part(published_at, '+', 1), '.', 1), '^(.*?)(Z|-(\d\d):?([0-5]\d))$', 2) AS zone,
         regexp_extract(split_part(split_part(published_at, '+', 1), '.', 1), '^(.*?)(Z|-(\d\d):?([0-5]\d))$', 3) AS zh,
         regexp_extract(split_part(split_part(published_at, '+', 1), '.', 1), '^(.*?)(Z|-(\d\d):?([0-5]\d))$', 4) AS zm
  FROM raw r)"""

ARTICLES = r"""
articles AS (
  SELECT coalesce(CASE WHEN nullif(id, '') <> '0' THEN nullif(id, '') END, substr(md5(coalesce(title, '') || chr(31) || coalesce(content, '') || chr(31) || coalesce(published_at, '') || chr(31)), 1, 16)) AS id,
         regexp_replace(coalesce(nullif(title, ''), ''), '^\s+|\s+$', '', 'g') AS headline,
         regexp_replace(coalesce(nullif(content, ''), ''), '^\s+|\s+$', '', 'g') AS content,
         regexp_replace(coalesce(nullif(title, ''), '') || '. ' || coalesce(nullif(content, ''), ''), '^\s+|\s+$', '', 'g') AS full_text,
         CASE WHEN nullif(published_at, '') IS NULL THEN ''
              WHEN try_strptime(cl, '%Y-%m-%dT%H:%M:%S') IS NOT NULL THEN strftime(try_strptime(cl, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S')
              WHEN zone <> '' AND try_strptime(zbody, '%Y-%m-%dT%H:%M:%S') IS NOT NULL
                THEN strftime(try_strptime(zbody, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S')
                     || CASE WHEN zone = 'Z' OR (zh = '00' AND zm = '00') THEN '+00:00' ELSE '-' || zh || ':' || zm END
              WHEN try_strptime(cl, '%Y-%m-%d') IS NOT NULL THEN strftime(try_strptime(cl, '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S')
              WHEN try_strptime(cl, '%d-%m-%Y') IS NOT NULL THEN strftime(try_strptime(cl, '%d-%m-%Y'), '%Y-%m-%dT%H:%M:%S')
              WHEN try_strptime(cl, '%Y/%m/%d') IS NOT NULL THEN strftime(try_strptime(cl, '%Y/%m/%d'), '%Y-%m-%dT%H:%M:%S')
              ELSE published_at END AS date,
         coalesce(nullif(source, ''), 'Unknown') AS source,
         coalesce(nullif(TRY_CAST(source_rating AS DOUBLE), 0), 0.0) AS source_rating,
         '' AS url, '' AS author,
         coalesce(contentType, 'General') AS category
  FROM dparts
  WHERE coalesce(nullif(TRY_CAST(source_rating AS DOUBLE), 0), 0.0) >= {min_rating}
    AND length(regexp_replace(coalesce(nullif(title, ''), ''), '^\s+|\s+$', '', 'g')) >= 10)"""


def articles_cte(min_rating: float = P.MIN_RATING) -> list[str]:
    return [RAW, DATE_PARTS, ARTICLES.replace("{min_rating}", repr(float(min_rating)))]


TITLE_CASE = r"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\p{{L}}+|[^\p{{L}}]+)'), lambda w: upper(w[1]) || w[2:]), '')"


def title_case(x: str) -> str:
    return TITLE_CASE.format(x=x)


def url_source(url: str) -> str:
    host = f"replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', '')"
    return f"nullif({title_case(f'split_part({host}, {chr(39)}.{chr(39)}, 1)')}, '')"


# Dense vectors: unit mean vector per label.
CENTROIDS = r"""
emb AS (SELECT vec_id AS id, embedding, label FROM embeddings),
unn AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM emb),
dims AS (SELECT CAST(label AS BIGINT) AS list_id, i, avg(CAST(x AS DOUBLE)) AS m FROM unn GROUP BY label, i),
cent0 AS (SELECT list_id, list(m ORDER BY i) AS c FROM dims GROUP BY list_id),
cent AS (SELECT list_id, CASE WHEN sqrt(list_sum(list_transform(c, lambda y: y * y))) > 0
                              THEN list_transform(c, lambda y: y / sqrt(list_sum(list_transform(c, lambda z: z * z)))) ELSE c END AS centroid
         FROM cent0)"""


def dense_topk_sql(k: int) -> str:
    return with_(CENTROIDS, f"""
scored AS (SELECT c.list_id AS topic_id, e.id, list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) AS s FROM cent c, emb e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, id ASC) AS rank FROM scored)""") + f"""
SELECT topic_id, rank, id, round(s, 6) AS similarity_score FROM ranked WHERE rank <= {k}"""


def accounting_sql() -> str:
    return with_(RAW) + f"""
SELECT count(*) AS total_read,
       count(*) FILTER (WHERE coalesce(nullif(TRY_CAST(source_rating AS DOUBLE), 0), 0.0) >= {P.ACCOUNTING_MIN_RATING}) AS rating_passed,
       count(*) FILTER (WHERE coalesce(nullif(TRY_CAST(source_rating AS DOUBLE), 0), 0.0) >= {P.ACCOUNTING_MIN_RATING}
                          AND length(regexp_replace(coalesce(nullif(title, ''), ''), '^\\s+|\\s+$', '', 'g')) >= 10) AS kept
FROM raw"""


def oracle_sql() -> dict[str, str]:
    arts = with_(*articles_cte())
    return {
        "vector_topk": dense_topk_sql(P.DENSE_K),
        "clean_articles": arts + """
SELECT id, headline, content, full_text, date, url, source, round(source_rating, 6) AS source_rating, author, category
FROM articles""",
        "load_accounting": accounting_sql(),
        "article_stats": arts + """
SELECT count(*) AS total_articles, count(DISTINCT source) AS sources,
       min(nullif(date, '')) AS earliest_date, max(nullif(date, '')) AS latest_date,
       round(avg(length(content)), 6) AS avg_content_length
FROM articles""",
        "source_from_url": f"""
SELECT page_id, url, coalesce({url_source('url')}, 'Unknown') AS source FROM pages""",
    } | storyline_sql() | _generation()


def _generation() -> dict[str, str]:
    from storyloom.plans.oracle_generation import generation_sql
    from storyloom.plans.oracle_more import more_sql
    return generation_sql() | more_sql()


# ------------------------------------------------------------------ text search + storylines
def hits_ctes(k: int = P.STORY_K) -> list[str]:
    return articles_cte() + [rf"""
dtok AS (SELECT id, unnest(regexp_extract_all(lower(full_text), '[\p{{L}}\p{{N}}]+')) AS term FROM articles),
dtf AS (SELECT id, term, count(*) AS tf FROM dtok GROUP BY id, term),
dn AS (SELECT id, sum(tf * tf) AS ss FROM dtf GROUP BY id),
ttok AS (SELECT item_id AS topic_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
ttf AS (SELECT topic_id, term, count(*) AS tf FROM ttok GROUP BY topic_id, term),
tn AS (SELECT topic_id, sum(tf * tf) AS ss FROM ttf GROUP BY topic_id),
dots AS (SELECT t.topic_id, d.id, sum(d.tf * t.tf) AS dot FROM dtf d JOIN ttf t ON d.term = t.term GROUP BY t.topic_id, d.id),
scored AS (SELECT b.item_id AS topic_id, a.id,
                  coalesce(CAST(x.dot AS DOUBLE) / sqrt(CAST(dn.ss AS DOUBLE) * CAST(tn.ss AS DOUBLE)), 0.0) AS similarity_score
           FROM benchmark b CROSS JOIN articles a LEFT JOIN dots x ON x.topic_id = b.item_id AND x.id = a.id
           LEFT JOIN dn ON dn.id = a.id LEFT JOIN tn ON tn.topic_id = b.item_id),
hits AS (SELECT topic_id, id, similarity_score,
                row_number() OVER (PARTITION BY topic_id ORDER BY similarity_score DESC, id ASC) AS rank
         FROM scored QUALIFY rank <= {k}),
ta AS (SELECT h.topic_id, h.rank, h.id, h.similarity_score, a.headline, a.full_text, a.date, a.url, a.source, a.source_rating,
              row_number() OVER (PARTITION BY h.topic_id ORDER BY a.date, h.rank) AS pos
       FROM hits h JOIN articles a ON a.id = h.id)"""]


def _any_contains(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


ESC = ["crisis", "urgent", "breaking", "critical", "emergency"]
EVENT = ["announce", "launch", "break", "reveal", "confirm", "declare"]
CONTRA = [("increase", "decrease"), ("rise", "fall"), ("approve", "reject"), ("success", "failure")]
WORSE = ["crisis", "escalate", "worsen", "intensify"]
CONCERN = ["concern", "issue", "problem"]

WORDS = "list_filter(string_split_regex({h}, '\\s+'), lambda x: x <> '')"


def words(h: str) -> str:
    return WORDS.format(h=h)


def reason_sql(as_of: str) -> str:
    return f"""CASE WHEN len(list_filter([
    CASE WHEN similarity_score > 0.7 THEN 'highly relevant to topic' END,
    CASE WHEN source_rating > 9 THEN 'from trusted source' END,
    CASE WHEN date <> '' AND date_diff('day', TRY_CAST(substr(date, 1, 10) AS DATE), DATE '{as_of}') < 7 THEN 'recent development' END,
    CASE WHEN {_any_contains('lower(headline)', EVENT)} THEN 'marks significant event' END], lambda x: x IS NOT NULL)) > 0
  THEN 'Important because it ' || array_to_string(list_filter([
    CASE WHEN similarity_score > 0.7 THEN 'highly relevant to topic' END,
    CASE WHEN source_rating > 9 THEN 'from trusted source' END,
    CASE WHEN date <> '' AND date_diff('day', TRY_CAST(substr(date, 1, 10) AS DATE), DATE '{as_of}') < 7 THEN 'recent development' END,
    CASE WHEN {_any_contains('lower(headline)', EVENT)} THEN 'marks significant event' END], lambda x: x IS NOT NULL), ', ') || '.'
  ELSE 'Provides context for the narrative.' END"""


STATS = f"""
stats AS (
  SELECT topic_id, count(*) AS article_count, count(DISTINCT source) AS source_count,
         substr(min(nullif(date, '')), 1, 10) AS first_date, substr(max(nullif(date, '')), 1, 10) AS last_date,
         CASE WHEN count(*) < 3 THEN 'Coverage is limited but consistent.'
              WHEN sum(CASE WHEN pos > n - ceil(n / 3.0) AND esc THEN 1 ELSE 0 END) > sum(CASE WHEN pos <= floor(n / 3.0) AND esc THEN 1 ELSE 0 END)
                THEN 'The narrative shows escalating intensity over time.'
              WHEN sum(CASE WHEN pos > n - ceil(n / 3.0) AND esc THEN 1 ELSE 0 END) < sum(CASE WHEN pos <= floor(n / 3.0) AND esc THEN 1 ELSE 0 END)
                THEN 'Coverage intensity has decreased over the timeline.'
              ELSE 'The story maintains consistent coverage throughout the period.' END AS narrative_arc
  FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n, {_any_contains('lower(headline)', ESC)} AS esc FROM ta)
  GROUP BY topic_id)"""

PEAK = """
mcount AS (SELECT topic_id, substr(date, 1, 7) AS month, count(*) AS month_count FROM ta WHERE date <> '' GROUP BY topic_id, substr(date, 1, 7)),
peak AS (SELECT topic_id, month AS peak_month, month_count AS peak_count
         FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS months,
                      row_number() OVER (PARTITION BY topic_id ORDER BY month_count DESC, month) AS r FROM mcount)
         WHERE r = 1 AND months > 1)"""

SOURCES = """
scount AS (SELECT topic_id, source, count(*) AS source_articles, min(pos) AS first_pos FROM ta GROUP BY topic_id, source),
topsrc AS (SELECT topic_id, source_rank, source, source_articles
           FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY source_articles DESC, first_pos) AS source_rank FROM scount)
           WHERE source_rank <= 3)"""

KEYWORDS = f"""
kwords AS (SELECT topic_id, pos, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS wpos
           FROM (SELECT topic_id, pos, {words('headline')} AS ws FROM ta)),
kcount AS (SELECT topic_id, lower(w) AS word, count(*) AS word_count, min(pos * 1000000 + wpos) AS first_seen
           FROM kwords WHERE length(w) > 4 AND regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') GROUP BY topic_id, lower(w)),
kc AS (SELECT topic_id, word_rank, word, word_count
       FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY word_count DESC, first_seen) AS word_rank FROM kcount)
       WHERE word_rank <= 20)"""

EVENTS = f"""
evitems AS (SELECT topic_id, list({{'pos': pos, 'words': list_distinct(list_transform({words('headline')}, lambda x: lower(x))), 'headline': headline}} ORDER BY pos) AS items
            FROM ta GROUP BY topic_id),
events AS (SELECT topic_id, list_reduce(items, lambda acc, x:
              CASE WHEN len(acc.events) < 8 AND len(list_filter(x.words, lambda w: NOT list_contains(acc.seen, w))) > 3
                   THEN {{'seen': list_distinct(list_concat(acc.seen, x.words)), 'events': list_append(acc.events, substr(x.headline, 1, 80))}}
                   ELSE acc END,
              {{'seen': []::VARCHAR[], 'events': []::VARCHAR[]}}).events AS key_events
           FROM evitems)"""


def _contra(a: str, b: str) -> str:
    return "(" + " OR ".join(f"(contains({a}, '{x}') AND contains({b}, '{y}')) OR (contains({a}, '{y}') AND contains({b}, '{x}'))" for x, y in CONTRA) + ")"


EDGES = f"""
aw AS (SELECT topic_id, pos, id, date, lower(headline) AS hl,
              list_distinct(list_transform(list_filter({words('headline')}, lambda x: length(x) > 4), lambda x: lower(x))) AS lw FROM ta),
pr AS (SELECT a.topic_id, a.id AS source, b.id AS target, a.date AS da, b.date AS db, a.hl AS ha, b.hl AS hb,
              len(list_intersect(a.lw, b.lw)) AS common
       FROM aw a JOIN aw b ON a.topic_id = b.topic_id AND a.pos < b.pos),
rel AS (SELECT *, CASE WHEN da <> '' AND db <> '' AND da < db AND common >= 3 THEN 'builds_on'
                       WHEN {_contra('ha', 'hb')} THEN 'contradicts'
                       WHEN common >= 2 AND common < 4 THEN 'adds_context'
                       WHEN {_any_contains('hb', WORSE)} AND {_any_contains('ha', CONCERN)} THEN 'escalates'
                       WHEN common >= 4 THEN 'builds_on' END AS relation FROM pr),
edges AS (SELECT topic_id, source, target, relation,
                 CAST(CASE relation WHEN 'builds_on' THEN 0.9 WHEN 'contradicts' THEN 0.7 WHEN 'adds_context' THEN 0.6
                                    WHEN 'escalates' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS weight
          FROM rel WHERE relation IS NOT NULL)"""

CLUSTERS = KEYWORDS + f""",
aws AS (SELECT topic_id, pos, id, list_distinct(list_transform({words('headline')}, lambda x: lower(x))) AS ws FROM ta),
aw1 AS (SELECT topic_id, pos, unnest(ws) AS word FROM aws),
ak0 AS (SELECT aw1.topic_id, aw1.pos, list({{'r': kc.word_rank, 'w': kc.word}} ORDER BY kc.word_rank) AS kw
        FROM aw1 JOIN kc ON kc.topic_id = aw1.topic_id AND kc.word = aw1.word GROUP BY aw1.topic_id, aw1.pos),
ak AS (SELECT t.topic_id, t.pos, t.id, coalesce(ak0.kw, []::STRUCT(r BIGINT, w VARCHAR)[]) AS kw
       FROM ta t LEFT JOIN ak0 ON ak0.topic_id = t.topic_id AND ak0.pos = t.pos),
citems AS (SELECT topic_id, count(*) AS n, list({{'id': id, 'kw': kw}} ORDER BY pos) AS items FROM ak GROUP BY topic_id),
cfold AS (SELECT topic_id, n, list_reduce(items, lambda acc, x:
            CASE WHEN coalesce(list_max(list_transform(acc, lambda c: len(list_intersect(c.kw, x.kw)))), 0) >= 2
                  AND list_position(list_transform(acc, lambda c: len(list_intersect(c.kw, x.kw))),
                                    list_max(list_transform(acc, lambda c: len(list_intersect(c.kw, x.kw))))) > 1
                 THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda c2: len(list_intersect(c2.kw, x.kw))),
                                                                                    list_max(list_transform(acc, lambda c3: len(list_intersect(c3.kw, x.kw)))))
                                                            THEN {{'ids': list_append(c.ids, x.id), 'kw': list_distinct(list_concat(c.kw, x.kw))}}
                                                            ELSE c END)
                 ELSE list_append(acc, {{'ids': [x.id], 'kw': x.kw}}) END,
            []::STRUCT(ids VARCHAR[], kw STRUCT(r BIGINT, w VARCHAR)[])[]) AS clusters
          FROM citems),
clusters AS (
  SELECT topic_id, cluster_id - 1 AS cluster_id,
         coalesce(nullif({title_case("array_to_string(list_transform(list_sort(c.kw)[1:3], lambda s: s.w), ' ')")}, ''), 'General') AS theme,
         len(c.ids) AS article_count, array_to_string(c.ids, ',') AS articles,
         array_to_string(list_transform(list_sort(c.kw)[1:5], lambda s: s.w), ',') AS key_terms
  FROM (SELECT topic_id, unnest(clusters) AS c, unnest(generate_series(1, len(clusters))) AS cluster_id FROM cfold WHERE n >= 2)
  UNION ALL
  SELECT b.item_id AS topic_id, 0 AS cluster_id, 'General Coverage' AS theme, coalesce(ci.n, 0) AS article_count,
         coalesce(array_to_string(list_transform(ci.items, lambda x: x.id), ','), '') AS articles, NULL AS key_terms
  FROM benchmark b LEFT JOIN citems ci ON ci.topic_id = b.item_id WHERE coalesce(ci.n, 0) < 2)"""

SUMMARY = STATS + "," + PEAK + "," + SOURCES + "," + EVENTS + """,
srcstr AS (SELECT topic_id, string_agg(source || ' (' || CAST(source_articles AS VARCHAR) || ' articles)', ', ' ORDER BY source_rank) AS sources_txt
           FROM topsrc GROUP BY topic_id),
summary AS (
  SELECT b.item_id AS topic_id,
         CASE WHEN coalesce(s.article_count, 0) = 0 THEN 'No relevant articles found for topic: ' || b.text
         ELSE concat_ws(' ',
           'Analysis of ' || CAST(s.article_count AS VARCHAR) || ' articles covering ''' || b.text || ''' from ' || CAST(s.source_count AS VARCHAR) || ' sources.',
           CASE WHEN s.first_date IS NOT NULL THEN 'Coverage spans from ' || s.first_date || ' to ' || s.last_date || '.' END,
           CASE WHEN len(e.key_events) > 0 THEN 'Key developments include: ' || array_to_string(e.key_events[1:5], '; ') || '.' END,
           CASE WHEN p.peak_month IS NOT NULL THEN 'Coverage peaked in ' || p.peak_month || ' with ' || CAST(p.peak_count AS VARCHAR) || ' articles.' END,
           CASE WHEN st.sources_txt IS NOT NULL THEN 'Most active sources: ' || st.sources_txt || '.' END,
           s.narrative_arc) END AS summary,
         coalesce(s.article_count, 0) AS article_count
  FROM benchmark b LEFT JOIN stats s ON s.topic_id = b.item_id LEFT JOIN events e ON e.topic_id = b.item_id
  LEFT JOIN peak p ON p.topic_id = b.item_id LEFT JOIN srcstr st ON st.topic_id = b.item_id)"""


def storyline_sql() -> dict[str, str]:
    h = hits_ctes()
    return {
        "text_cosine_topk": with_(*h) + "SELECT topic_id, rank, id, round(similarity_score, 6) AS similarity_score FROM hits",
        "text_threshold": with_(*h) + f"SELECT topic_id, rank, id, round(similarity_score, 6) AS similarity_score FROM hits WHERE similarity_score >= {P.THRESHOLD}",
        "timeline": with_(*h) + f"SELECT topic_id, pos, id, date, headline, url, source, {reason_sql(P.AS_OF)} AS why_it_matters FROM ta",
        "top_sources": with_(*h, SOURCES) + "SELECT * FROM topsrc",
        "peak_month": with_(*h, PEAK) + "SELECT * FROM peak",
        "narrative_arc": with_(*h, STATS) + "SELECT * FROM stats",
        "keyword_counts": with_(*h, KEYWORDS) + "SELECT * FROM kc",
        "relation_edges": with_(*h, EDGES) + "SELECT * FROM edges",
        "graph_counts": with_(*h, EDGES) + """
SELECT b.item_id AS topic_id, coalesce(n.c, 0) AS node_count, coalesce(e.c, 0) AS edge_count FROM benchmark b
LEFT JOIN (SELECT topic_id, count(*) AS c FROM ta GROUP BY topic_id) n ON n.topic_id = b.item_id
LEFT JOIN (SELECT topic_id, count(*) AS c FROM edges GROUP BY topic_id) e ON e.topic_id = b.item_id""",
        "key_events": with_(*h, EVENTS) + """
SELECT topic_id, event_pos, event FROM (SELECT topic_id, unnest(key_events) AS event, unnest(generate_series(1, len(key_events))) AS event_pos FROM events)""",
        "keyword_clusters": with_(*h, CLUSTERS) + "SELECT * FROM clusters",
        "summary_text": with_(*h, SUMMARY) + "SELECT topic_id, summary FROM summary",
        "storyline_files": with_(*h, SUMMARY) + """
SELECT b.item_id AS topic_id, 'heuristic' AS generation_mode, sm.summary AS narrative_summary, coalesce(n.c, 0) AS timeline_count
FROM benchmark b JOIN summary sm ON sm.topic_id = b.item_id LEFT JOIN (SELECT topic_id, count(*) AS c FROM ta GROUP BY topic_id) n ON n.topic_id = b.item_id""",
        "storyline_docs": with_(*h, SUMMARY, EDGES, CLUSTERS) + """
SELECT b.item_id AS topic_id, 'heuristic' AS generation_mode, sm.summary AS narrative_summary,
       coalesce(n.c, 0) AS timeline_count, cl.c AS cluster_count, coalesce(n.c, 0) AS node_count, coalesce(e.c, 0) AS edge_count,
       f.headline AS first_headline, cl.themes AS themes
FROM benchmark b
JOIN summary sm ON sm.topic_id = b.item_id
LEFT JOIN (SELECT topic_id, count(*) AS c FROM ta GROUP BY topic_id) n ON n.topic_id = b.item_id
LEFT JOIN (SELECT topic_id, count(*) AS c FROM edges GROUP BY topic_id) e ON e.topic_id = b.item_id
LEFT JOIN (SELECT topic_id, headline FROM ta WHERE pos = 1) f ON f.topic_id = b.item_id
LEFT JOIN (SELECT topic_id, count(*) AS c, string_agg(theme, '|' ORDER BY cluster_id) AS themes FROM clusters GROUP BY topic_id) cl ON cl.topic_id = b.item_id""",
        "section_pack": f"""
WITH packed AS (
  SELECT doc_id,
         CASE WHEN length(text) <= {P.CHUNK_MAX_CHARS} THEN [text]
              ELSE (SELECT CASE WHEN len(r.cur) > 0 THEN list_append(r.out, array_to_string(r.cur, chr(10))) ELSE r.out END
                    FROM (SELECT list_reduce(string_split(text, chr(10)), lambda acc, s:
                            CASE WHEN acc.len + length(s) > {P.CHUNK_MAX_CHARS} AND len(acc.cur) > 0
                                 THEN {{'out': list_append(acc.out, array_to_string(acc.cur, chr(10))), 'cur': [s], 'len': length(s)}}
                                 ELSE {{'out': acc.out, 'cur': list_append(acc.cur, s), 'len': acc.len + length(s) + 1}} END,
                            {{'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'len': 0::BIGINT}}) AS r)) END AS parts
  FROM documents)
SELECT doc_id, part - 1 AS part, part_text, length(part_text) AS part_len
FROM (SELECT doc_id, unnest(parts) AS part_text, unnest(generate_series(1, len(parts))) AS part FROM packed)""",
        "vector_neighbors": with_(CENTROIDS, f"""
scored AS (SELECT c.list_id AS topic_id, e.id, list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) AS s FROM cent c, emb e),
anchors AS (SELECT DISTINCT id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, id) AS r FROM scored) WHERE r = 1),
nb AS (SELECT a.id AS anchor_id, e.id, list_dot_product(CAST(ae.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
       FROM anchors a JOIN emb ae ON ae.id = a.id JOIN emb e ON e.id <> a.id)""") + f"""
SELECT anchor_id, rank, id, round(s, 6) AS similarity_score
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS rank FROM nb) WHERE rank <= {P.DENSE_K}""",
        "vector_similarity_pairs": with_(CENTROIDS, f"""
scored AS (SELECT c.list_id AS topic_id, e.id, list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) AS s FROM cent c, emb e),
top AS (SELECT topic_id, id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, id) AS r FROM scored) WHERE r <= {P.DENSE_K})""") + """
SELECT a.topic_id, a.id AS id1, b.id AS id2,
       round(list_dot_product(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[])), 6) AS similarity
FROM top a JOIN top b ON a.topic_id = b.topic_id AND a.id < b.id
JOIN emb ea ON ea.id = a.id JOIN emb eb ON eb.id = b.id""",
    }
