"""Operator 10, packing: concatenate and cut.

Pass one tokenizes each document once, adds the end id, keeps a running total of tokens within
each input partition and writes ids and totals into the shared folder. A prefix sum over the
partition totals (one row a partition) gives every document its place in one endless sequence of
ids. Pass two cuts that sequence into windows of ``length`` ids; a document that crosses a window's
end gives one boundary record (a piece) for each window that it touches. No row is shuffled, so no
source, key or long document can be hot; only the last sequence needs padding.

Ids are those of ``tokenizers`` with the JSON file of the vocabulary's name and
``add_special_tokens=False``: its added tokens are taken out of a text first, and what lies between
them is encoded piece by piece.

Edge cases: a null or empty text is the end id alone; a text longer than a window spans several;
repeated rows are packed each for itself; an empty table gives no pieces; other columns are not
carried along, so their names cannot clash.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, text_slices
from .textsplit import PieceCache

LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"

_caches: dict[str, Encoder] = {}


def rank_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def load_added(vocabulary: str) -> dict[str, int]:
    """The added tokens of the JSON file of the same name, and their ids."""
    with open(rank_path(os.path.splitext(vocabulary)[0] + ".json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd:
        raise ValueError(f"added tokens with flags that are not supported: {odd}")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Ids of texts: added tokens by name, the parts between them by the rank file."""

    def __init__(self, cache: PieceCache, added: dict[str, int]):
        self.cache = cache
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        # Like the library: the leftmost, and there the longest, wins.
        listed = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, listed)) + ")") if listed else None

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        has = np.zeros(len(texts), bool)
        for name in self.added:
            has |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        if not has.any():
            return self.cache.encode_texts(texts)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~has)
        for i, ids in zip(plain, self.cache.encode_texts(texts.take(pa.array(plain))), strict=True):
            out[i] = ids
        for i in np.flatnonzero(has):
            parts = self.cut.split(texts[int(i)].as_py())
            between = iter(self.cache.encode_texts(pa.array(parts[::2], pa.string())))
            out[i] = b"".join([self.added[p] if k % 2 else next(between) for k, p in enumerate(parts)])
        return out


def _little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers; faster than numpy for a few of them."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def _cache(vocabulary: str) -> Encoder:
    """The tokenizer's ids: the rank file holds the ids of the JSON file of the same name, without its added tokens."""
    if vocabulary not in _caches:
        import public_tokenizers
        import tiktoken

        enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(rank_path(vocabulary)), special_tokens={})
        one = enc.encode_ordinary
        _caches[vocabulary] = Encoder(PieceCache(lambda pieces: [_little(one(p)) for p in pieces]), load_added(vocabulary))
    return _caches[vocabulary]


def _tokenizer(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, done, end = _cache(vocabulary), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b, _, _ in text_slices(texts):
                ids = [x + end for x in cache.encode_texts(texts[a:b])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                before = done + np.cumsum(n) - n
                done += int(n.sum())
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(before), pa.array(n), pa.array(ids, pa.binary())], ["__key", "__before", "__n", "__ids"])

    return run


def pack_documents(df: DataFrame, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    tokens = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(_tokenizer(vocabulary, end_id), f"__key {kind}, __before long, __n long, __ids binary")
    tokens = materialize(tokens.withColumn("__part", F.spark_partition_id()), "packing-tokens")

    totals = tokens.groupBy("__part").agg(F.sum("__n").alias("__total"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))

    at = F.col("__base") + F.col("__before")
    # One row of two longs for each partition that was read: 16 MB for a million partitions.
    placed = tokens.join(F.broadcast(offsets), "__part").withColumn("__at", at)
    first, last = F.expr(f"__at div {length}"), F.expr(f"(__at + __n - 1) div {length}")

    def piece(k):
        start = F.greatest(k * length, F.col("__at"))
        end = F.least((k + 1) * length, F.col("__at") + F.col("__n"))
        # Ids are cut before pieces become rows, so that no row but the document's own holds all of them.
        cut = F.substring("__ids", ((start - F.col("__at")) * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.struct((start - F.col("__at")).alias("start"), (end - start).alias("length"), k.alias("sequence_id"), (start - k * length).alias("offset"), cut.alias("ids"))

    pieces = placed.select("__key", "__n", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select(F.col("__key").alias(key), "p.start", "p.length", F.col("__n").alias("doc_tokens"), "p.sequence_id", "p.offset", "p.ids")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row a sequence: its ids, padded to ``length`` unless their number is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"), F.sum("length").alias("used"))
    padded = F.rpad("ids", length * 4, F.lit(int(pad_id).to_bytes(4, "little")))
    power = F.bit_count("used") == 1
    return joined.select("sequence_id", "used", F.when(power, F.col("ids")).otherwise(padded).alias("ids"))
