"""Operator 1, sharding: a two-pass external shuffle.

Pass one reads the records, deals each to a shard by rendezvous hashing of its key and sums the
bytes of each shard, which gives the number of memory-sized buckets a shard needs. Pass two
scatters the records of a shard over its buckets by a second seeded hash of the whole record
identity, each bucket to a partition that its number alone decides, puts the buckets of a partition
and the records of a bucket into an order that depends on their content alone, applies Spark's
Fisher-Yates shuffle, seeded by the partition, and numbers the result. So content, seed and
parameters decide every slot; the layout of the input and the session's settings don't.

Law ``key``: the key and the number of shards alone decide the shard. With one more shard a record
either stays or goes to the new shard, since rendezvous weights of the old shards do not change.

Sizes: the largest unit held by a task is one bucket (``bucket_bytes`` on average, whatever the
number of records); equal texts under different keys scatter like any other records. Records that
are equal in key and text share a bucket up to ``REPEATS`` of them; beyond, they are counted, and
scattered by the number of the copy.

Edge cases: a null key is a key of its own; a null text counts no bytes; an empty table gives an
empty result; other columns pass through, but ``shard``, ``slot`` and ``grown_shard`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BUCKET_BYTES = 8 << 20
#: Buckets are dealt over as many partitions, or one each where there are fewer.
PARTITIONS = 10_000
REPEATS = 1000
#: Buckets whose first slots are broadcast.
MOST_OFFSETS = 1_000_000
RESERVED = ("shard", "slot", "grown_shard", "__identity", "__copy", "__bucket", "__part")


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded weight for this key."""
    weights = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"] if shards > 1 else F.lit(0)


def _comparable(df: DataFrame) -> bool:
    return all(not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema)


def _numbered_copies(base: DataFrame, cols: list[str]) -> DataFrame:
    """``base`` with ``__copy``: 0, but for records that occur very often the number of the copy."""
    once = base.withColumn("__copy", F.lit(0).cast("long"))
    if not _comparable(base):
        return once
    many = materialize(base.groupBy("__identity").count().filter(F.col("count") > REPEATS).select("__identity"), "shard-repeats")
    if many.isEmpty():
        return once
    few = base.join(many, "__identity", "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    # Equal rows are added up before they are shuffled.
    counted = base.join(many, "__identity", "left_semi").groupBy("__identity", *cols).count()
    copies = counted.select("__identity", *cols, F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("__copy"))
    return few.select("__identity", *cols, "__copy").unionByName(copies)


def shard_documents(df: DataFrame, shards: int = 16, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` int, ``slot`` long (gapless from 0 in each shard) and ``grown_shard`` int."""
    cols = [c for c in df.columns if c not in RESERVED]
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(1)
    base = df.select(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)).alias("__identity"), *cols)
    base = _numbered_copies(base, cols).withColumn("shard", rendezvous(F.col(key), shards, seed))

    # Pass one: at most ``shards`` rows reach the driver.
    totals = {r[0]: r[1] for r in base.groupBy("shard").agg(F.sum(size.cast("long"))).collect()}
    first, bucket = 0, F.lit(0)
    for s, total in sorted(totals.items()):
        n = max(1, -(-total // bucket_bytes))
        bucket = F.when(F.col("shard") == s, F.pmod(F.xxhash64(F.lit(seed + 2), "__identity", "__copy"), F.lit(n)) + first).otherwise(bucket)
        first += n
    partitions = max(1, min(first, PARTITIONS))
    placed = base.withColumn("__bucket", bucket.cast("long"))

    counts = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    # One row of two longs a bucket, and the number of buckets is known; beyond, records are shuffled to meet them.
    offsets = F.broadcast(offsets) if first <= MOST_OFFSETS else offsets

    record = F.struct("__identity", *[F.col(c) for c in cols])
    dealt = placed.withColumn("__part", (F.col("__bucket") % partitions).cast("int")).repartitionById(partitions, F.col("__part"))
    filled = dealt.groupBy("__part", "shard", "__bucket").agg(F.collect_list(record).alias("__all"))
    ordered = filled.sortWithinPartitions("__bucket")
    by_hash = lambda a, b: F.when(a["__identity"] < b["__identity"], -1).when(a["__identity"] > b["__identity"], 1).otherwise(0)
    kept = F.sort_array("__all") if _comparable(base) else F.array_sort("__all", by_hash)
    shuffled = ordered.select("shard", "__bucket", F.posexplode(F.shuffle(kept, seed)).alias("__pos", "__r")).join(offsets, "__bucket")
    out = shuffled.select(*[F.col("__r")[c].alias(c) for c in cols], F.col("shard").cast("int").alias("shard"), (F.col("__from") + F.col("__pos")).cast("long").alias("slot"))
    return out.withColumn("grown_shard", rendezvous(F.col(key), shards + 1, seed).cast("int"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; within a file the records stand in slot order, bucket by bucket."""
    sharded.write.partitionBy("shard").parquet(path)
