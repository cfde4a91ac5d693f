"""Document fingerprints: SpotSigs.

A signature is a common word (the anchor) followed by the next content words of the text;
the fingerprint of a text is the set of its signatures.  Fingerprints are compared by
Jaccard; near-duplicate search partitions the sets by length and prunes by the prefix
and length bounds of the threshold.

Words are runs of letters and digits, lower-cased.  Where more than ``GAP`` content words
follow without an anchor (tables, lists, code, other languages), and throughout a text
without a complete chain, each run of ``RUN`` following content words is a signature, too;
so an edited word changes the few signatures around it.  A text with neither has one, the
hash of its words (so empty and null texts share one).  All expressions are Spark's own.  Repeated rows and ties of doc_id are ordered by the text's
hash; null ids come last.  Very long texts have as many signatures as anchors.  An empty
table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.vectors import let
from storyloom.llm.common import materialize, utf8_size
from storyloom.llm.components import connected_components

# Common words of English, German, French and Spanish.
ANCHORS = ["a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it",
           "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "what", "which", "will", "with", "you",
           "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "einer", "er", "es", "ich", "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "war", "zu",
           "au", "aux", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "ne", "ou", "pas", "pour", "que", "qui", "sur", "un", "une",
           "al", "como", "con", "del", "el", "los", "las", "lo", "más", "no", "para", "pero", "por", "se", "su", "una", "y"]
CHAIN = 2
GAP, RUN = 64, 3
THRESHOLD = 0.8
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 20_000


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 64-bit signatures of a text.

    The j-th anchor (from 0) at word i has i - j content words before it, which gives its
    chain's place in the list of content words: one linear pass.  These places also
    bound the stretches without an anchor.
    """
    def of_words(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(*anchors))
        spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(*anchors))

        def chains(parts: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                at = s["i"] - j
                return F.when(at + chain <= F.size(parts["c"]), F.xxhash64(s["w"], *[F.get(parts["c"], at + k) for k in range(chain)]))
            n = F.size(parts["c"])
            ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(parts["s"], lambda s, j: s["i"] - j), F.array(n))))

            def with_runs(x: Column) -> Column:
                def of_stretch(a: Column, k: Column) -> Column:
                    z = F.get(x["ends"], k + 1)
                    last = F.least(z - 1, n - RUN)
                    runs = F.transform(F.sequence(a, last), lambda p: F.xxhash64(F.lit(1), *[F.get(parts["c"], p + q) for q in range(RUN)]))
                    return F.when(((z - a > GAP) | (F.size(x["found"]) == 0)) & (last >= a), runs).otherwise(F.array().cast("array<bigint>"))
                return F.concat(x["found"], F.flatten(F.transform(x["ends"], of_stretch)))

            found = F.filter(F.transform(parts["s"], one), lambda x: x.isNotNull())
            return let(F.struct(found.alias("found"), ends.alias("ends")), with_runs)

        found = let(F.struct(content.alias("c"), spots.alias("s")), chains)
        whole = F.array(F.xxhash64(F.lit(0), F.array_join(words, " ")))
        return let(found, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(whole))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, of_words)


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two fingerprints."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return let(common, lambda c: c / (F.size(a) + F.size(b) - c))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), signatures(F.col(text)).alias("signatures"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (a hash of the fingerprint), n_links (other classes at least ``threshold``
    alike) and component (smallest class reachable) of every row.

    Equal fingerprints form a class.  Two classes that are alike share a signature among
    the first ``n - ceil(threshold * n) + 1`` of either, rarest first, and their lengths lie
    in the same or neighbouring length partitions (each ends at its start / threshold).
    """
    rows = materialize(fingerprints(docs, text, key).withColumn("class_id", F.xxhash64("signatures")))
    classes = rows.groupBy("class_id").agg(F.first("signatures").alias("signatures")).withColumn("n", F.size("signatures"))
    step = -math.log(threshold)
    items = classes.select("class_id", "n", F.explode("signatures").alias("signature"))
    counts = items.groupBy("signature").agg(F.count(F.lit(1)).alias("seen"))
    ordered = items.join(counts, "signature").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "signature"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    heads = materialize(ordered.select("class_id", "n", part.alias("part"), F.explode(prefix).alias("x")).where("x.seen > 1").select("class_id", "n", "part", F.col("x.signature").alias("signature")))
    left = heads.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "part", "signature")
    right = heads.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "signature")
    alike = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    pairs = left.join(right, ["part", "signature"]).where("a <> b").where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("class_id", "signatures")
    checked = (pairs.join(sets.withColumnsRenamed({"class_id": "a", "signatures": "s_a"}), "a").join(sets.withColumnsRenamed({"class_id": "b", "signatures": "s_b"}), "b")
               .where(likeness(F.col("s_a"), F.col("s_b")) >= threshold).select("a", "b"))
    checked = materialize(checked)
    degree = checked.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected_components(checked).select(F.col("node").alias("class_id"), F.col("root").alias("component"))
    return (rows.select("doc_id", "class_id").join(degree, "class_id", "left").join(roots, "class_id", "left")
            .select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id").alias("component")))


# ------------------------------------------------------------------ neighbours in id order
def _bucketed(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket``: ranges of doc_id of about ``bucket_bytes`` of text.

    The range borders are approximate quantiles of all ids; only they reach the driver.
    """
    total = docs.agg(F.sum(utf8_size("text")).alias("b")).first()["b"] or 0
    n = min(math.ceil(total / bucket_bytes), MAX_BUCKETS)  # beyond, the buckets grow; their sort spills
    borders = []
    if n > 1:
        probs = [k / n for k in range(1, n)]
        found = docs.agg(F.percentile_approx("doc_id", probs, max(10000, 10 * n)).alias("q")).first()["q"] or []
        borders = sorted({float(x) for x in found})
    if not borders:
        return docs.withColumn("bucket", F.lit(0))
    place = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    split = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="place", outputCol="range")
    return split.transform(place).withColumn("bucket", F.col("range").cast("int")).drop("place", "range")


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, **further: Column) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) and ``further`` columns with ``next``: a struct of the row
    that follows in descending doc_id; after the last comes the first.

    Rows meet their neighbours in a bucket of ids (one shuffle, of the texts alone; the
    further columns are made behind it).  The first row of each bucket is also sent, as a
    guest, to the end of the bucket before it.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("back"), F.xxhash64("text").alias("tie"))
    columns = [*docs.columns, *further]
    rows = _bucketed(docs, bucket_bytes).withColumn("place", order)
    heads = rows.select("bucket", "place").groupBy("bucket").agg(F.min("place").alias("head"))
    # Buckets in reading order go down; the head of one follows the last row of the one above.
    up = Window.orderBy("bucket")
    heads = heads.select("bucket", "head", F.coalesce(F.lead("bucket").over(up), F.min("bucket").over(Window.partitionBy())).alias("host"))
    heads = materialize(heads)  # one row per bucket; small, so Spark broadcasts it by its size
    rows = rows.join(heads, "bucket")
    rows = rows.withColumn("guest", F.explode(F.when(F.col("place") == F.col("head"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("bucket", F.when(F.col("guest") == 1, F.col("host")).otherwise(F.col("bucket"))).drop("head", "host")
    rows = rows.repartition("bucket").withColumns(further)
    following = F.lead(F.struct(*[F.col(f"`{c}`") for c in columns])).over(Window.partitionBy("bucket").orderBy("guest", "place"))
    return rows.withColumn("next", following).where("guest = 0").select(*[F.col(f"`{c}`") for c in columns], "next")


def edited_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprint of each text, of its edited form (the last third replaced by the start of the
    next document) and their likeness, and the likeness to the next document."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, bucket_bytes, own=signatures(F.col("text")))
    third = F.floor(F.length("text") / 3).cast("int")
    cut = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("next.own").alias("other"),
                      F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third)).alias("edited"))
    cut = cut.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other", signatures(F.col("edited")).alias("changed"))
    return cut.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))
