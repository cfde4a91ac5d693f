"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the documents are ordered by
that key (buckets of equal key ranges, sorted inside), prefix sums of the sizes are
computed in two steps (inside a bucket, over the buckets), and the source is cut where
its prefix sum reaches the budget.  Budgets above a source's size repeat it: whole epochs
first, the rest by the cut.

Sources are ordered by code point, null last, and weigh 1, 2, 3 in turn.  Targets share
the total of all sizes by weight; none exceeds ``max_epochs`` times its source's size, and
the excess is shared among the others by weight.

The document at the cut is taken when that brings the sum nearer to the budget.  Null
texts have size 0; documents of size 0 come as often as their place in the order says.
Keys of different rows tie by doc_id and size.  Repeated rows (equal id and text) share their key; the cut goes between them, and which of
them are taken is open.  Very long texts only count their words.  An empty table gives an
empty table; further columns are carried through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD_CLASS, free_name, materialize

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20240
#: A source's key space is cut into 2 ** BUCKET_BITS equal ranges.
BUCKET_BITS = 12


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    With the sources ordered by size per weight, the full ones (at their cap) come first,
    so running sums give the shares without a loop.  One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.select("*", F.sum("source_size").over(whole).cast("double").alias("total"), F.sum("weight").over(whole).alias("all_weights"),
                 F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double").alias("size_before"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    # What a unit of weight gets if all sources before this one are full.
    left, weight_left = F.col("total") - max_epochs * F.col("size_before"), F.col("all_weights") - F.col("weight_before")
    open_here = F.col("weight") * left <= max_epochs * F.col("source_size") * weight_left
    s = s.select("source", "source_size", "weight", left.alias("left"), weight_left.alias("weight_left"), open_here.alias("open"),
                 F.row_number().over(order).alias("pos"))
    level = F.min(F.when(F.col("open"), F.struct("pos", "left", "weight_left"))).over(whole)
    s = s.withColumn("level", level)
    share = F.col("weight") * F.col("level.left") / F.col("level.weight_left")
    is_open = F.col("level").isNotNull() & (F.col("pos") >= F.col("level.pos"))
    return s.select("source", "source_size", F.when(is_open, share).otherwise(max_epochs * F.col("source_size").cast("double")).alias("target"))


def _random_key(text: str, key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def _keyed(docs: DataFrame, text: str, key: str, source: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), _random_key(text, key, seed).alias("key"))


def plan(narrow: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How often each document is taken: rows of ``narrow`` plus source_size, target, epochs, copies.

    ``narrow`` has doc_id, source, size, key.  Only these rows are shuffled, once, by
    (source, bucket); bucket totals and source totals are small aggregates.
    """
    rows = narrow.withColumn("bucket", F.shiftright("key", 64 - BUCKET_BITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    previous = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(previous), F.lit(0)).alias("offset"))
    offsets = (offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
               .select(F.col("o.source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset", "source_size", "target"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    # The middle of the document decides, so the cut is as near to the budget as whole documents allow.
    again = F.col("offset") + F.col("inside") + F.col("size") / 2 < budget
    return (rows.withColumn("epochs", epochs)
            .select("doc_id", "source", "size", "key", "source_size", "target", "epochs", (F.col("epochs") + again.cast("long")).alias("copies")))


def mix_report(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = SEED,
               weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every document."""
    found = plan(materialize(_keyed(docs, text, key, source, seed)), weights, max_epochs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = SEED,
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, columns of ``docs``.

    A source is cut at one key, so the copies of a row follow from its own key and one row
    of its source (epochs, the last key taken once more, and how many of its rows are); only
    rows with that very key are numbered, other texts are not shuffled.
    """
    found = materialize(plan(materialize(_keyed(docs, text, key, source, seed)), weights, max_epochs))
    again = F.when(F.col("copies") > F.col("epochs"), F.col("key"))
    cuts = found.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(again).alias("cut"))
    at_cut = found.where("copies > epochs").groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).alias("a")
    cuts = cuts.alias("c").join(at_cut, F.col("c.source").eqNullSafe(F.col("a.source")) & (F.col("c.cut") == F.col("a.key")), "left")
    cuts = materialize(cuts.select("c.source", "epochs", "cut", F.coalesce("a.n", F.lit(0)).alias("rows_at_cut")))
    names = docs.columns
    own_source, own_key, copies = (free_name([*names, *cuts.columns], n) for n in ("mix_source", "mix_key", "mix_copies"))
    rows = docs.select("*", F.col(f"`{source}`").alias(own_source), _random_key(text, key, seed).alias(own_key))
    limits = cuts.select(F.struct("source", "epochs", "cut", "rows_at_cut").alias(copies))
    # One row per source: Spark broadcasts it while its size allows.
    rows = rows.join(limits, F.col(own_source).eqNullSafe(F.col(copies)["source"]))
    at_cut = F.col(own_key).eqNullSafe(F.col(copies)["cut"])
    times = lambda more: F.explode(F.array_repeat(F.lit(1), F.col(copies)["epochs"].cast("int") + more.cast("int")))
    plain = rows.where(~at_cut).withColumn(copies, times(F.coalesce(F.col(own_key) < F.col(copies)["cut"], F.lit(False))))
    numbered = rows.where(at_cut).withColumn(own_key, F.row_number().over(Window.partitionBy(own_source).orderBy(own_key)))
    cut = numbered.withColumn(copies, times(F.col(own_key) <= F.col(copies)["rows_at_cut"]))
    return plain.unionByName(cut).select(*[F.col(f"`{c}`") for c in names])
