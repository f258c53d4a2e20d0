"""Operator 13, target-distribution importance resampling: streaming CRC ring.

Documents are drawn so that their word n-grams come nearer to those of a target table. Features are all
runs of 1 to ``ngram`` words; a feature's bucket is the CRC-32 of its bytes modulo the buckets.

One scan of a document keeps a ring of zlib states, one for each of the last ``ngram`` words that a
feature can start at. A new word extends every state by a space and the word and starts one of its
own; the states are the features' checksums, so no n-gram is ever put together, and each word costs
``ngram`` steps whatever the text. The buckets of a document are written once, as small integers, into
the shared folder, and both later passes read those instead of the texts.

1. Counts by bucket: one array a task, added up by bucket. ``buckets`` rows, however large the corpus.
2. A bucket's gain is the logarithm of its share in the target over that in the documents, both with one
   added to each bucket. ``buckets`` integers go to the tasks.
3. A document's weight is the floored mean of its features' gains; Gumbel noise from the digest of seed
   and key is added, and the highest scores are drawn, which draws without replacement by weight.
4. Ranks: keys and scores are sorted by ranges and written; the sizes of the ranges, one row each, give
   every row its place. Nothing is sorted in one task. Rows that tie in all of score and key are told
   apart by their place in the written table, so no value can be a hot range.

Edge cases: a null text has no words; a document without features has the weight 0; a null key is hashed
as an empty string, and among equal scores comes first; repeated rows score alike and have ranks of
their own; an empty target leaves gains that favour buckets that are rare among documents; an empty
table gives no rows; of other columns only those in ``carry`` come along, and none may be named like an
output. A text of any length is taken in blocks that end at a separator.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release, ship, text_slices
from .textsplit import blocks

NGRAM = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of a text that are in work at a time.
BLOCK = 1 << 20

#: A-Z in lower case; separators as spaces; digits, a-z and all bytes from 128 on as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

ADDED = ("n_words", "n_features", "weight", "score", "rank")


def words(raw: bytes) -> Iterator[bytes]:
    for block in blocks(raw.translate(_FOLD), b" ", BLOCK):
        yield from block.split()


def ring(found: Iterable[bytes], ngram: int) -> Iterator[int]:
    """Checksums of all runs of 1 to ``ngram`` words, as each word comes."""
    crc = zlib.crc32
    states: list[int] = []
    for word in found:
        tail = b" " + word
        states = [crc(tail, s) for s in states[-(ngram - 1) :]] if ngram > 1 else []
        states.append(crc(word))
        yield from states


def text_buckets(raw: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    n = 0

    def counted() -> Iterator[bytes]:
        nonlocal n
        for word in words(raw):
            n += 1
            yield word

    found = np.fromiter(ring(counted(), ngram), np.uint32) % np.uint32(buckets)
    return n, found.astype(_kind(buckets))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(df: DataFrame, carry: list[str], text: str, ngram: int, buckets: int) -> DataFrame:
    """``carry`` with n_words, n_features and buckets (binary) of each text."""
    ship(df.sparkSession)
    kept = df.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in carry])
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("__buckets", T.BinaryType())]
    schema = T.StructType([*kept.schema.fields[1:], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, ends in text_slices(batch.column(0), most=4096):
                rows = batch.slice(a, b - a)
                data = raw.tobytes()
                found = [text_buckets(data[x:y], ngram, buckets) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                new = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array([f.tobytes() for _, f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *new], schema.names)

    return kept.mapInArrow(run, schema)


def bucket_counts(found: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket, and how many features are in it; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", name])

    return found.select("__buckets").mapInArrow(run, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: a thousand times the logarithm of the target's share over the documents', floored. One row for every bucket."""
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(documents, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    # ``buckets`` rows, a parameter: one window over them gives the totals.
    whole = Window.partitionBy(F.lit(0))
    sums = both.withColumn("__s", F.sum("s").over(whole)).withColumn("__t", F.sum("t").over(whole))
    times = lambda one, total: (F.col(one) + 1).cast("double") * (F.col(total) + buckets).cast("double")
    share = times("t", "__s") / times("s", "__t")
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """Floored noise, in thousandths, from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _weights(gains: np.ndarray, buckets: int):
    def weigh(found: pa.Array) -> pa.Array:
        sums = []
        for raw in found:
            at = np.frombuffer(raw.as_buffer(), _kind(buckets))
            sums.append(int(gains[at].sum()) // len(at) if len(at) else 0)
        return pa.array(sums, pa.int64())

    return F.arrow_udf(weigh, "long")


def importance_resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``carry`` (the key, unless others are named) with n_words, n_features, weight, score and rank.

    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn and have a rank from 1;
    the rank of all others is null.
    """
    carry = [key] if carry is None else carry
    clash = [c for c in carry if c in ADDED or c.startswith("__")]
    if clash:
        raise ValueError(f"columns named like an output: {clash}")
    scratch = Scratch()
    found = scratch.keep(features(df.withColumn("__key", F.col(f"`{key}`")), ["__key", *carry], text, ngram, buckets), "resampling-buckets")
    wanted = features(target, [], text, ngram, buckets)
    gains = np.zeros(buckets, np.int64)
    # Bounded by the number of buckets, a parameter, and so is what goes to each task.
    for r in bucket_gains(bucket_counts(found, buckets, "s"), bucket_counts(wanted, buckets, "t"), buckets).collect():
        gains[r["bucket"]] = r["gain"]

    scored = found.withColumn("weight", _weights(gains, buckets)(F.col("__buckets"))).drop("__buckets").withColumn("__id", F.monotonically_increasing_id())
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("__key"), seed)).withColumn("__in", F.col("n_words") >= least_words)
    order = [F.desc("__in"), F.desc("score"), F.asc_nulls_first("__key"), F.asc("__id")]
    # The place of a row in its range: the low 33 bits of this id; the range: the bits above.
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.keep(ranged.withColumn("__range", F.shiftright("__at", 33)).drop("__id"), "resampling-ranges")
    release(found)
    scratch.tables.remove(found)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"), F.count_if("__in").alias("__n_in"))
    # One row for each range of the shuffle, as few as its partitions.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), F.expr(f"({percent} * sum(__n_in) over ()) div 100").alias("__drawn"))
    rank = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(F.broadcast(bases), "__range")
    return out.select(*carry, "n_words", "n_features", "weight", "score", F.when(F.col("__in") & (rank <= F.col("__drawn")), rank).alias("rank"))
