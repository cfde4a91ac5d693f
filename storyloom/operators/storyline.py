"""Per-topic storyline analytics over retrieved articles, for many topics at once.

Input ``topic_articles``: one row per (topic_id, hit) with the article columns
(``id, headline, full_text, date, url, source, source_rating``) plus ``rank`` and
``similarity_score`` from the search.  Every topic holds at most k rows (the search
cut), so per-topic arrays and folds are bounded by k, never by the data size.

Order inside a topic is chronological: ``pos`` = row_number by (date, rank); an empty
date sorts first and retrieval rank keeps equal dates stable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import contains_any, py_words, title_case
from storyloom.functions.vectors import let as _let

# Fixed values (word lists, phrases and weights of the storyline rules).
ESCALATION_WORDS = ["crisis", "urgent", "breaking", "critical", "emergency"]
EVENT_WORDS = ["announce", "launch", "break", "reveal", "confirm", "declare"]
CONTRADICTION_PAIRS = [("increase", "decrease"), ("rise", "fall"), ("approve", "reject"), ("success", "failure")]
WORSENING_WORDS = ["crisis", "escalate", "worsen", "intensify"]
CONCERN_WORDS = ["concern", "issue", "problem"]
EDGE_WEIGHTS = {"builds_on": 0.9, "contradicts": 0.7, "adds_context": 0.6, "escalates": 0.8}
DEFAULT_EDGE_WEIGHT = 0.5
MAX_KEY_EVENTS = 8
SHOWN_KEY_EVENTS = 5
KEY_EVENT_CHARS = 80
TOP_KEYWORDS = 20
TOP_SOURCES = 3
ARC_LIMITED = "Coverage is limited but consistent."
ARC_UP = "The narrative shows escalating intensity over time."
ARC_DOWN = "Coverage intensity has decreased over the timeline."
ARC_FLAT = "The story maintains consistent coverage throughout the period."
NO_REASON = "Provides context for the narrative."
REASON_HIGH, REASON_TRUSTED, REASON_RECENT, REASON_EVENT = "highly relevant to topic", "from trusted source", "recent development", "marks significant event"
REASON_START = "Important because it "
SAY_COUNTS = "Analysis of {articles} articles covering '{topic}' from {sources} sources."
SAY_SPAN = "Coverage spans from {first} to {last}."
SAY_EVENTS = "Key developments include: {events}."
SAY_PEAK = "Coverage peaked in {month} with {count} articles."
SAY_SOURCES = "Most active sources: {sources}."
SAY_SOURCE = "{source} ({count} articles)"
SAY_NOTHING = "No relevant articles found for topic: {topic}"
ONE_CLUSTER, ANY_THEME = "General Coverage", "General"
MODE_GENERATED = "rag_vllm"     # generation_mode labels of a storyline document
MODE_HEURISTIC = "heuristic"


def topic_articles(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """J1 + W1: hits joined to article fields, with chronological ``pos`` (1-based).

    One row per hit.  Hits with ``row_key`` (see ``clean.row_key``) find their own article
    among those with equal ids; of articles equal in all columns a hit takes one.
    """
    from storyloom.operators.clean import row_key
    from storyloom.operators.search import checked_broadcast

    cols = ["id", "headline", "full_text", "date", "url", "source", "source_rating"]
    on = ["id", "row_key"] if "row_key" in hits.columns else ["id"]
    own = [row_key().alias("row_key")] if "row_key" in hits.columns else []
    # The hit list holds at most k rows per topic; it is broadcast after a size check,
    # so the article table is only scanned, never shuffled, for this join.
    kept = ["raw"] if "raw" in articles.columns else []
    ta = articles.select(*cols, *kept, *own).join(checked_broadcast(hits), on, "inner").drop("row_key")
    w = Window.partitionBy("topic_id").orderBy(F.col("date").asc(), F.col("rank").asc())
    ta = ta.select("*", F.dense_rank().over(w).alias("pos"), F.lag("rank").over(w).eqNullSafe(F.col("rank")).alias("repeat"))
    return ta.where("not repeat").drop("repeat")


def _lower_words(headline: Column) -> Column:
    return F.array_distinct(F.transform(py_words(headline), lambda w: F.lower(w)))


def _long_words(headline: Column) -> Column:
    """Distinct lower-cased words longer than 4 characters (relation rules)."""
    return F.array_distinct(F.transform(F.filter(py_words(headline), lambda w: F.length(w) > 4), lambda w: F.lower(w)))


# ---------------------------------------------------------------- P22 / N2
def importance_reason(as_of: str) -> Column:
    """Heuristic "why it matters" for an article row.  ``as_of`` (``yyyy-MM-dd``) is the
    reference day for recency, so results do not depend on the clock."""
    d = F.try_to_date(F.substring(F.col("date"), 1, 10), "yyyy-MM-dd")
    age = F.datediff(F.to_date(F.lit(as_of)), d)
    reasons = F.array_compact(F.array(
        F.when(F.col("similarity_score") > 0.7, F.lit(REASON_HIGH)),
        F.when(F.col("source_rating") > 9, F.lit(REASON_TRUSTED)),
        F.when((F.col("date") != "") & (age < 7), F.lit(REASON_RECENT)),
        F.when(contains_any(F.lower(F.col("headline")), EVENT_WORDS), F.lit(REASON_EVENT)),
    ))
    return F.when(F.size(reasons) > 0, F.concat(F.lit(REASON_START), F.array_join(reasons, ", "), F.lit("."))) \
        .otherwise(F.lit(NO_REASON))


def timeline(ta: DataFrame, as_of: str, reasons: DataFrame | None = None) -> DataFrame:
    """Timeline rows ``(topic_id, pos, id, date, headline, url, source, why_it_matters)``.

    ``reasons`` (``topic_id, id, entry_pos, why_it_matters``) are generated reasons; the
    last non-empty one per id wins, otherwise the heuristic reason is used (J3).
    """
    out = ta.withColumn("heuristic", importance_reason(as_of))
    if reasons is not None:
        r = (reasons.filter(F.coalesce(F.col("why_it_matters"), F.lit("")) != "")
                    .groupBy("topic_id", "id")
                    .agg(F.max_by("why_it_matters", "entry_pos").alias("generated")))
        out = out.join(r, ["topic_id", "id"], "left")
    else:
        out = out.withColumn("generated", F.lit(None).cast("string"))
    return out.select("topic_id", "pos", "id", "date", "headline", "url", "source",
                      F.coalesce("generated", "heuristic").alias("why_it_matters"))


# ---------------------------------------------------------------- a topic's articles in one row
def topic_rows(ta: DataFrame, *fields: str, **more: Column) -> DataFrame:
    """``(topic_id, items)``: a topic's articles in time order, with the given fields.

    The analyses below are expressions over such a row, so that all of them need one
    grouping of the (at most k) articles of each topic.
    """
    named = [F.col(c) for c in fields] + [c.alias(name) for name, c in more.items()]
    return ta.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("pos", *named))).alias("items"))


def _of(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def _counted(values: Column) -> Column:
    """Distinct values as (minus their count, place of the first, value), most frequent first.

    Equal values stand together once sorted, so a value's count is the length of its run.
    """
    def runs(pairs):
        def told(starts):
            return F.sort_array(F.transform(starts, lambda at, j: _let(F.get(pairs, at), lambda x: F.struct(
                (at - F.coalesce(F.get(starts, j + 1), F.size(pairs))).alias("less"), x["place"].alias("place"), x["value"].alias("value")))))
        new = F.transform(pairs, lambda x, i: F.when((i == 0) | (x["value"] != F.get(pairs, i - 1)["value"]), i))
        return _let(F.filter(new, lambda i: i.isNotNull()), told)
    return _let(F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("place")))), runs)


def _say(template: str, **values: Column) -> Column:
    """``template`` with columns filled in; null where one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else values[p].cast("string") for k, p in enumerate(parts) if k % 2 or p])


# ---------------------------------------------------------------- A1 A2 A3 A4 W3
def _stats(items: Column) -> Column:
    n = F.size(items)
    loud = F.transform(items, lambda x: contains_any(F.lower(x["headline"]), ESCALATION_WORDS))
    first = F.size(F.filter(loud, lambda x, i: x & (i < F.floor(n / 3))))
    last = F.size(F.filter(loud, lambda x, i: x & (i >= n - F.ceil(n / 3))))
    arc = (F.when(n < 3, F.lit(ARC_LIMITED)).when(last > first, F.lit(ARC_UP))
             .when(last < first, F.lit(ARC_DOWN)).otherwise(F.lit(ARC_FLAT)))
    dated = F.filter(_of(items, "date"), lambda d: d != "")
    return F.struct(n.cast("long").alias("article_count"),
                    F.size(F.array_distinct(F.filter(_of(items, "source"), lambda s: s.isNotNull()))).cast("long").alias("source_count"),
                    F.substring(F.array_min(dated), 1, 10).alias("first_date"), F.substring(F.array_max(dated), 1, 10).alias("last_date"),
                    arc.alias("narrative_arc"))


def topic_stats(ta: DataFrame) -> DataFrame:
    """A1/A2/W3 per topic: counts, date span and narrative-arc sentence."""
    return topic_rows(ta, "headline", "date", "source").select("topic_id", _stats(F.col("items")).alias("s")).select("topic_id", "s.*")


def _peak(items: Column) -> Column:
    months = F.sort_array(F.transform(F.filter(_of(items, "date"), lambda d: d != ""), lambda d: F.substring(d, 1, 7)))
    counted = _counted(months)  # in order of months, so the earliest wins a tie
    top = F.get(counted, F.lit(0))
    return F.when(F.size(counted) > 1, F.struct(top["value"].alias("peak_month"), (-top["less"]).cast("long").alias("peak_count")))


def peak_month(ta: DataFrame) -> DataFrame:
    """A3: busiest month per topic, only for topics covering more than one month;
    ties go to the earliest month."""
    found = topic_rows(ta, "date").select("topic_id", _peak(F.col("items")).alias("p"))
    return found.where("p IS NOT NULL").select("topic_id", "p.*")


def _sources(items: Column, n: int) -> Column:
    counted = F.slice(_counted(F.filter(_of(items, "source"), lambda s: s.isNotNull())), 1, n)
    return F.transform(counted, lambda c, i: F.struct((i + 1).alias("source_rank"), c["value"].alias("source"), (-c["less"]).cast("long").alias("source_articles")))


def top_sources(ta: DataFrame, n: int = TOP_SOURCES) -> DataFrame:
    """A4: most frequent sources per topic; ties go to the source seen first in time order."""
    return topic_rows(ta, "source").select("topic_id", F.inline(_sources(F.col("items"), n)))


# ---------------------------------------------------------------- A5
def _candidates(headline: Column) -> Column:
    """Words of a headline that can be keywords: longer than 4 characters, letters and digits only."""
    fit = F.filter(py_words(headline), lambda w: (F.length(w) > 4) & w.rlike(r"^[\p{L}\p{N}]+$"))
    return F.transform(fit, lambda w: F.lower(w))


def _keywords(items: Column, n: int = TOP_KEYWORDS) -> Column:
    counted = F.slice(_counted(F.flatten(_of(items, "candidates"))), 1, n)
    return F.transform(counted, lambda c, i: F.struct((i + 1).alias("word_rank"), c["value"].alias("word"), (-c["less"]).cast("long").alias("word_count")))


def keyword_counts(ta: DataFrame, n: int = TOP_KEYWORDS) -> DataFrame:
    """A5: headline keywords (longer than 4 characters, letters/digits only) per topic,
    top ``n`` by count; ties go to the word seen first."""
    rows = topic_rows(ta, candidates=_candidates(F.col("headline")))
    return rows.select("topic_id", F.inline(_keywords(F.col("items"), n)))


# ---------------------------------------------------------------- F1
def _events(items: Column) -> Column:
    init = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("events"))

    def step(acc, x):
        fresh = F.size(F.array_except(x["words"], acc["seen"])) > 3
        taken = F.struct(F.array_union(acc["seen"], x["words"]).alias("seen"),
                         F.concat(acc["events"], F.array(F.substring(x["headline"], 1, KEY_EVENT_CHARS))).alias("events"))
        return F.when((F.size(acc["events"]) < MAX_KEY_EVENTS) & fresh, taken).otherwise(acc)

    return F.aggregate(items, init, step)["events"]


def key_events(ta: DataFrame) -> DataFrame:
    """F1 per topic: ``key_events ARRAY<STRING>`` — walking headlines in time order, a
    headline is taken when it brings more than 3 unseen words; at most 8, 80 characters each."""
    rows = topic_rows(ta, "headline", words=_lower_words(F.col("headline")))
    return rows.select("topic_id", _events(F.col("items")).alias("key_events"))


# ---------------------------------------------------------------- F2 / N3 / A10
CLUSTERS = "array<struct<cluster_id:int,theme:string,article_count:int,articles:array<string>,key_terms:array<string>>>"


def _clusters(items: Column, keywords: Column, allow_first_cluster: bool) -> Column:
    """The clusters of a topic with two articles or more."""
    ctype = "array<struct<ids:array<string>,kw:array<struct<r:int,w:string>>>>"
    min_best = 1 if allow_first_cluster else 2
    named = F.transform(keywords, lambda k: F.struct(k["word_rank"].alias("r"), k["word"].alias("w")))

    def step(acc, x):
        # Bind the overlap list and the best position once per step ("let" via a
        # one-element transform); referencing them inside the per-cluster lambda would
        # otherwise re-evaluate them for every cluster.
        def with_overlaps(ov):
            def with_best(b):
                joins = F.coalesce((b["ov"] >= 2) & (b["pos"] >= min_best), F.lit(False))
                grown = F.transform(acc, lambda c, i: F.when(i + 1 == b["pos"], F.struct(
                    F.concat(c["ids"], F.array(x["id"])).alias("ids"),
                    F.array_union(c["kw"], x["kw"]).alias("kw"))).otherwise(c))
                opened = F.concat(acc, F.array(F.struct(F.array(x["id"]).alias("ids"), x["kw"].alias("kw"))))
                return F.when(joins, grown).otherwise(opened)
            best = F.struct(F.array_max(ov).alias("ov"), F.array_position(ov, F.array_max(ov)).cast("int").alias("pos"))
            return _let(best, with_best)
        return _let(F.transform(acc, lambda c: F.size(F.array_intersect(c["kw"], x["kw"]))), with_overlaps)

    def marked(kw):  # each article's words that are keywords, in order of rank
        return F.transform(items, lambda x: F.struct(x["id"].alias("id"), F.filter(kw, lambda k: F.array_contains(x["words"], k["w"])).alias("kw")))

    folded = F.aggregate(_let(named, marked), F.array().cast(ctype), step)

    def told(c, i):
        words = F.transform(F.sort_array(c["kw"]), lambda k: k["w"])
        theme = F.coalesce(F.nullif(title_case(F.array_join(F.slice(words, 1, 3), " ")), F.lit("")), F.lit(ANY_THEME))
        return F.struct(i.alias("cluster_id"), theme.alias("theme"), F.size(c["ids"]).alias("article_count"), c["ids"].alias("articles"), F.slice(words, 1, 5).alias("key_terms"))

    return F.transform(folded, told).cast(CLUSTERS)


def _clusters_or_one(items: Column, keywords: Column, allow_first_cluster: bool = False) -> Column:
    n = F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))
    ids = F.coalesce(_of(items, "id"), F.array().cast("array<string>"))
    one = F.array(F.struct(F.lit(0).alias("cluster_id"), F.lit(ONE_CLUSTER).alias("theme"), n.alias("article_count"), ids.alias("articles"), F.lit(None).cast("array<string>").alias("key_terms")))
    return F.when(n >= 2, _clusters(items, keywords, allow_first_cluster)).otherwise(one.cast(CLUSTERS))


def keyword_clusters(topics: DataFrame, ta: DataFrame, allow_first_cluster: bool = False) -> DataFrame:
    """Greedy keyword clusters per topic.

    Walking articles in time order, an article joins the first cluster with the largest
    keyword overlap when that overlap is at least 2, else opens a new cluster; cluster
    keywords are the members' words that are among the topic's top-20 keywords.  As in
    the behaviour being matched, the first cluster never gains members unless
    ``allow_first_cluster``.  Topics with fewer than 2 articles get one
    ``General Coverage`` cluster without key terms.  Keywords are ordered by their
    keyword rank (count, then first seen).
    """
    headline = F.col("headline")
    rows = topic_rows(ta, "id", words=_lower_words(headline), candidates=_candidates(headline))
    rows = topics.select("topic_id").join(rows, "topic_id", "left").withColumn("keywords", _keywords(F.col("items")))
    return rows.select("topic_id", F.inline(_clusters_or_one(F.col("items"), F.col("keywords"), allow_first_cluster)))


# ---------------------------------------------------------------- N4 / A9
def graph_nodes(ta: DataFrame) -> DataFrame:
    return ta.select("topic_id", "id", "headline", "date", "source", (F.col("pos") - 1).alias("index"))


def _relation_fields(headline: Column) -> dict[str, Column]:
    """What the relation rules read of a headline: long words, antonyms as bits, concern and worsening."""
    low = F.lower(headline)
    bits = lambda side: sum((F.when(low.contains(pair[side]), F.lit(1 << i)).otherwise(F.lit(0)) for i, pair in enumerate(CONTRADICTION_PAIRS)), F.lit(0))
    return {"long": _long_words(headline), "one": bits(0), "other": bits(1), "concern": contains_any(low, CONCERN_WORDS), "worse": contains_any(low, WORSENING_WORDS)}


def _edges(items: Column) -> Column:
    weight = lambda relation: F.coalesce(*[F.when(relation == name, F.lit(w)) for name, w in EDGE_WEIGHTS.items()], F.lit(DEFAULT_EDGE_WEIGHT))

    def edge(a, b):
        def by_common(common):
            contra = (a["one"].bitwiseAND(b["other"]) + a["other"].bitwiseAND(b["one"])) != 0
            relation = (F.when((a["date"] != "") & (b["date"] != "") & (a["date"] < b["date"]) & (common >= 3), F.lit("builds_on"))
                         .when(contra, F.lit("contradicts"))
                         .when((common >= 2) & (common < 4), F.lit("adds_context"))
                         .when(b["worse"] & a["concern"], F.lit("escalates"))
                         .when(common >= 4, F.lit("builds_on")))
            return _let(relation, lambda r: F.struct(a["pos"].alias("pa"), b["pos"].alias("pb"), a["id"].alias("source"), b["id"].alias("target"), r.alias("relation"), weight(r).alias("weight")))
        return _let(F.size(F.array_intersect(a["long"], b["long"])), by_common)

    pairs = F.transform(items, lambda a, i: F.filter(F.transform(F.slice(items, i + 2, F.size(items)), lambda b: edge(a, b)), lambda e: e["relation"].isNotNull()))
    return F.flatten(pairs)


def relation_edges(ta: DataFrame) -> DataFrame:
    """N5/N6 edges ``(topic_id, source, target, relation, weight)`` for ordered pairs
    (earlier ``pos`` first) of one topic, at most k articles.

    Rules, the first that holds: dated and earlier with >= 3 shared words -> builds_on;
    antonyms -> contradicts; 2-3 shared -> adds_context; concern then worsening ->
    escalates; >= 4 -> builds_on.
    """
    rows = topic_rows(ta, "id", "date", **_relation_fields(F.col("headline")))
    return rows.select("topic_id", F.inline(_edges(F.col("items"))))


def graph_counts(topics: DataFrame, ta: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per topic (0 for topics without hits)."""
    nodes = ta.groupBy("topic_id").agg(F.count(F.lit(1)).alias("node_count"))
    ecount = edges.groupBy("topic_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return (topics.select("topic_id").join(nodes, "topic_id", "left").join(ecount, "topic_id", "left")
                  .select("topic_id", F.coalesce("node_count", F.lit(0)).alias("node_count"),
                          F.coalesce("edge_count", F.lit(0)).alias("edge_count")))


# ---------------------------------------------------------------- N1
def _summary(topic: Column, items: Column) -> Column:
    def told(st):
        events, sources, peak = F.slice(_events(items), 1, SHOWN_KEY_EVENTS), _sources(items, TOP_SOURCES), _peak(items)
        named = F.transform(sources, lambda s: _say(SAY_SOURCE, source=s["source"], count=s["source_articles"]))
        return F.concat_ws(" ",
            _say(SAY_COUNTS, articles=st["article_count"], topic=topic, sources=st["source_count"]),
            _say(SAY_SPAN, first=st["first_date"], last=st["last_date"]),
            F.when(F.size(events) > 0, _say(SAY_EVENTS, events=F.array_join(events, "; "))),
            _say(SAY_PEAK, month=peak["peak_month"], count=peak["peak_count"]),
            F.when(F.size(sources) > 0, _say(SAY_SOURCES, sources=F.array_join(named, ", "))),
            st["narrative_arc"])

    return F.when(items.isNull(), _say(SAY_NOTHING, topic=topic)).otherwise(_let(_stats(items), told))


def heuristic_summary(topics: DataFrame, ta: DataFrame) -> DataFrame:
    """Summary sentence per topic from A1-A4, F1 and W3; topics without articles
    get the fixed no-articles sentence."""
    rows = topic_rows(ta, "headline", "date", "source", words=_lower_words(F.col("headline")))
    j = topics.select("topic_id", "topic").join(rows, "topic_id", "left")
    n = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return j.select("topic_id", _summary(F.col("topic"), F.col("items")).alias("heuristic_summary"), n.alias("article_count"))


# ---------------------------------------------------------------- N7
def storyline_documents(topics: DataFrame, ta: DataFrame, as_of: str, generated: DataFrame | None = None,
                        reasons: DataFrame | None = None) -> DataFrame:
    """One nested row per topic — topic, generation_mode, narrative_summary,
    timeline, clusters and graph (nodes, edges, counts); and sources (rank, id and the whole
    article as JSON) when the articles carry ``raw``.

    ``generated`` (``topic_id, summary``) holds accepted generated summaries; a topic
    uses it when it is non-empty (``rag_vllm``), else the heuristic one.
    """
    headline = F.col("headline")
    fields = {"why_it_matters": importance_reason(as_of), "words": _lower_words(headline), "candidates": _candidates(headline), **_relation_fields(headline)}
    named = [F.col(c) for c in ("id", "headline", "date", "url", "source")] + [c.alias(name) for name, c in fields.items()]
    whole = ["raw"] if "raw" in ta.columns else []
    own = [F.sort_array(F.collect_list(F.struct("rank", "id", F.to_json("raw").alias("raw")))).alias("sources") for _ in whole]
    # The one grouping: everything below is computed inside a topic's row.
    rows = ta.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("pos", *named))).alias("items"), *own)
    j = topics.select("topic_id", "topic").join(rows, "topic_id", "left")
    generated = generated.select("topic_id", F.col("summary").alias("gen_summary")) if generated is not None else None
    j = j.join(generated, "topic_id", "left") if generated is not None else j.withColumn("gen_summary", F.lit(None).cast("string"))
    if reasons is not None:
        told = reasons.filter(F.coalesce(F.col("why_it_matters"), F.lit("")) != "").groupBy("topic_id", "id").agg(F.max_by("why_it_matters", "entry_pos").alias("told"))
        j = j.join(told.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "told"))).alias("told")), "topic_id", "left")
    items = F.col("items")
    why = lambda x: F.coalesce(F.try_element_at("told", x["id"]), x["why_it_matters"]) if reasons is not None else x["why_it_matters"]
    timeline_ = F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), x["date"].alias("date"), x["headline"].alias("headline"), x["url"].alias("url"), x["source"].alias("source"), why(x).alias("why_it_matters")))
    nodes = F.transform(items, lambda x: F.struct((x["pos"] - 1).alias("index"), x["id"].alias("id"), x["headline"].alias("headline"), x["date"].alias("date"), x["source"].alias("source")))
    told = j.select("topic_id", "topic", "gen_summary", "items", *[F.col("sources") for _ in whole],
                    _summary(F.col("topic"), items).alias("heuristic_summary"), timeline_.alias("timeline"), nodes.alias("nodes"),
                    _edges(items).alias("edges"), _keywords(items).alias("keywords"))
    kinds = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    none = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
    use_gen = F.coalesce(F.col("gen_summary"), F.lit("")) != ""
    summary = F.when(items.isNotNull() & use_gen, F.col("gen_summary")).otherwise(F.col("heuristic_summary"))
    return told.select(
        "topic_id", "topic", F.when(use_gen, F.lit(MODE_GENERATED)).otherwise(F.lit(MODE_HEURISTIC)).alias("generation_mode"),
        summary.alias("narrative_summary"), none("timeline").alias("timeline"),
        _clusters_or_one(items, F.col("keywords")).alias("clusters"),
        F.struct(none("nodes").alias("nodes"), none("edges").alias("edges"), F.size(none("nodes")).alias("node_count"), F.size(none("edges")).alias("edge_count")).alias("graph"),
        *[none("sources").alias("sources") for _ in whole],
    )
