"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash.  Pass
two shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` on the bucket's slots) and
lays the buckets end to end, which is a uniformly random order of all records.  Equal
runs of that order are the shards, so their row counts differ by one at most (law
``rows``).

The slots of a bucket are dealt to its records in the order of a second hash, so reruns
agree; records that tie there are equal in id and text.  Null texts count 1 byte like
empty ones; a very long text is a record like others; records that repeat in id and text
are kept each; an empty table gives an empty table; all columns are carried through, and the
new columns get underscores in front where their names are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyloom.llm.common import free_name, utf8_size

SEED = 5
N_SHARDS = 16
#: Records of a bucket fit into a task's memory.
BUCKET_BYTES = 32 << 20
#: Buckets of a task, together.
TASK_BYTES = 8 * BUCKET_BYTES
LAW = "rows"


def shard(docs: DataFrame, n_shards: int = N_SHARDS, text: str = "text", key: str = "doc_id",
          seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard (int, from 0) and slot (long, gapless from 0 in its shard).

    Records are shuffled once, by bucket, into at least one task for ``TASK_BYTES``; the
    join with the buckets' permutations (four bytes a record) keeps that partitioning.  One
    row of counts reaches the driver.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(utf8_size(text) + 1).alias("bytes")).first()
    n, n_buckets = total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    names = docs.columns
    bucket_name, rank_name, place = (free_name(names, x) for x in ("shard_bucket", "shard_rank", "shard_place"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(n_buckets)).cast("int")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total["bytes"] or 0) / TASK_BYTES))
    rows = docs.withColumn(bucket_name, bucket).repartition(tasks, bucket_name)

    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("int").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one small row per bucket
    counts = counts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # shuffle() draws anew for each row of a partition, so rows and partitions are fixed first.
    dealt = counts.repartition(tasks, "bucket").sortWithinPartitions("bucket").select(
        "bucket", "offset", F.shuffle(F.sequence(F.lit(0), F.col("size") - 1), seed).alias("slots"))

    order = Window.partitionBy(bucket_name).orderBy(F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`"), F.col(f"`{text}`")), F.col(f"`{key}`"))
    rows = rows.withColumn(rank_name, F.row_number().over(order))
    joined = rows.join(dealt.select(F.struct("bucket", "offset", "slots").alias(place), F.col("bucket").alias("shard_key_")), F.col(bucket_name) == F.col("shard_key_"))
    at = F.col(place)["offset"] + F.element_at(F.col(place)["slots"], F.col(rank_name))
    joined = joined.select(*[F.col(f"`{c}`") for c in names], at.alias(place))
    least, longer = divmod(n, n_shards)
    border = longer * (least + 1)  # the first shards hold one record more
    p = F.col(place)
    rest = max(least, 1)
    shard_col = F.when(p < border, F.floor(p / (least + 1))).otherwise(longer + F.floor((p - border) / rest)).cast("int")
    slot_col = F.when(p < border, F.pmod(p, F.lit(least + 1))).otherwise(F.pmod(p - border, F.lit(rest))).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in names], shard_col.alias(free_name(names, "shard")), slot_col.alias(free_name(names, "slot")))


def write_shards(sharded: DataFrame, folder: str, n_columns: int) -> None:
    """Write ``folder/shard=I``; a bucket's records stay in the task that shuffled them.

    ``n_columns`` is the number of columns before shard and slot.
    """
    shard_name, slot = sharded.columns[n_columns], sharded.columns[n_columns + 1]
    sharded.sortWithinPartitions(shard_name, slot).write.partitionBy(shard_name).parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The records of ``write_shards``, in the columns of ``schema`` (those of ``shard``)."""
    return spark.read.schema(schema).parquet(folder).select(*[F.col(f"`{f.name}`") for f in schema.fields])


def digest(sharded: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    shard_name, slot = sharded.columns[-2:]
    return sharded.select(F.col(key).alias("doc_id"), (utf8_size(text) + 1).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
                          F.lit(LAW).alias("law"), F.col(shard_name).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
