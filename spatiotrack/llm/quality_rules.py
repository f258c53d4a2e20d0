"""Operator 3, quality rules: n-gram perplexity under a modified Kneser-Ney model.

Texts are dealt by their digest into chunks of about ``CHUNK_BYTES``, whatever the layout of the
input; equal texts meet in one chunk and count once, so that copies do not teach the model their own
wording. Counting: a window of ``ORDER`` bytes slides over each chunk's whole texts, and Spark adds up
the different n-grams of all chunks, language by language; none is left out. Model: discounts,
continuation counts, back-off weights and probabilities of all orders are Spark aggregations and
joins over written tables. Scoring: the different n-grams of a chunk are joined with the model and
meet the chunk's texts again, so no task holds more than a chunk and its n-grams. As every text is
counted, every n-gram of a text is in the model.

Verdict: each language has a lower and an upper band of nats a byte (the logarithm of perplexity)
around the median of its different texts, ``LOWER`` and ``UPPER`` robust deviations away, and wider
for short texts, whose average varies more. A document outside of its band, or that fails the base rules, goes.

Base rules: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT`` per cent of the words in
eight-word windows that occur twice or more.

Edge cases: a null text is empty and fails the base rules; a null language is a language of its
own; a text shorter than the order has no perplexity and no verdict from it; repeated rows get equal results; an empty table gives no rows;
extra columns pass through, but the names in ``FEATURES`` and ``ADDED`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Prefix, as_array, materialize, mix64, release, row_of, ship, text_slices, windows, word_spans

ORDER = 5
#: Text that is counted and scored together.
CHUNK_BYTES = 24 << 20
MIN_WORDS = 20
MAX_REPEAT = 30
#: Chosen on the labelled documents of the 0.1 scale that pass the base rules: 0.4 per cent of those
#: with label 1 fall outside of these bands, 40 per cent of those with label 0 do.
LOWER = 3.0
UPPER = 2.4
#: Nats to which quartiles are told apart.
GRAIN = 1e-5
SHORT_BYTES = 1500.0
LEAST_DEVIATION = 0.02
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = ("nats", "base_failed", "kept")
#: The name of the language of rows that have none; no language code looks like it.
NO_LANGUAGE = "\0"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, over arrays of whole slices of texts."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in FEATURES}
    for _, _, raw, offsets in text_slices(texts):
        starts, ends, counts = word_spans(raw, offsets)
        rolling = Prefix(raw)
        out["n_words"].append(counts)

        def per_row(flags: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

        inside = np.zeros(len(raw) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        out["word_chars"].append(per_row(inside & ((raw & 0xC0) != 0x80)))
        out["n_symbols"].append(per_row(_SYMBOL[raw]))

        cuts = np.flatnonzero(raw == 10)
        first = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
        first = first[first < len(raw)]
        last = np.searchsorted(cuts, first)
        stop = np.append(cuts, len(raw))[last]
        row = np.searchsorted(offsets, first, "right") - 1
        stop = np.minimum(stop, offsets[row + 1])
        worded = np.searchsorted(starts, stop) > np.searchsorted(starts, first)
        first, stop, row = first[worded], stop[worded], row[worded]
        keys = mix64(rolling.spans(first, stop) + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        _, kept = np.unique(keys, return_index=True)
        n = len(offsets) - 1
        out["n_dup_lines"].append(np.bincount(row, minlength=n) - np.bincount(row[kept], minlength=n))

        value, at, rows = windows(rolling.spans(starts, ends), counts, 8)
        keys = mix64(value + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = np.zeros(len(keys), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:].copy() if len(same) > 1 else False
        again = np.zeros(len(keys), bool)
        again[order] = same
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + 8, -1)
        covered = np.cumsum(covered[:-1]) > 0
        out["n_repeat_words"].append(np.bincount(row_of(counts)[covered], minlength=n))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of bytes inside rows, as integers, and how many each row has."""
    counts = np.maximum(np.diff(offsets) - order + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    n = len(raw) - order + 1
    value = np.zeros(n, np.uint64)
    for k in range(order):
        value = value << np.uint64(8) | raw[k : k + n].astype(np.uint64)
    rows = row_of(np.diff(offsets))
    return value[rows[:n] == rows[order - 1 :]], counts


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose language and digest a task has not had yet: copies do not pile up in one chunk. Texts are compressed."""
    seen: set[tuple] = set()
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        kept = []
        for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("same").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                kept.append(i)
        rows = batch.take(pa.array(kept, pa.int64()))
        for a in range(0, len(rows), 256):
            some = rows.slice(a, 256)
            texts = pa.array([pack((t or "").encode()) for t in some.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], texts], some.schema.names)


def _different(chunk: pa.Table) -> Iterator[tuple[str, pa.Array, pa.Array]]:
    """The languages of a chunk, with digests and texts, every different text once."""
    rows: dict[str, dict[bytes, int]] = {}
    for i, (lang, same) in enumerate(zip(chunk["lang"].to_pylist(), chunk["same"].to_pylist(), strict=True)):
        rows.setdefault(lang, {}).setdefault(same, i)
    packed, same, unpack = chunk["text"], as_array(chunk["same"]), zstandard.ZstdDecompressor().decompress
    for lang, found in rows.items():
        at = list(found.values())
        yield lang, same.take(pa.array(at, pa.int64())), pa.array([unpack(packed[i].as_py()).decode() for i in at], pa.string())


COUNTED = "chunk long, lang string, gram long, n long"


def _counter(order: int):
    def run(chunk: pa.Table) -> pa.Table:
        out = []
        for lang, _, texts in _different(chunk):
            parts = [np.unique(grams(raw, offsets, order)[0], return_counts=True) for _, _, raw, offsets in text_slices(texts)]
            keys = np.concatenate([k for k, _ in parts])
            k, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(k)).astype(np.int64)
            number = chunk["chunk"][0].as_py()
            out.append(pa.table({"chunk": pa.array(np.full(len(k), number), pa.int64()), "lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k.astype(np.int64)), "n": pa.array(n)}))
        return pa.concat_tables(out)

    return run


class HashArrays:
    """Values by key, in arrays sorted by a 64-bit hash, with a directory of the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mix64(keys.astype(np.uint64))
        by = np.argsort(hashed)
        self.hashes, self.values = hashed[by], values[by].astype(np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        lead = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, and which keys are absent."""
        if not len(self.hashes):
            return np.full(len(keys), missing, np.float32), np.ones(len(keys), bool)
        hashed = mix64(keys)
        lead = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        last = len(self.hashes) - 1
        wrong = np.flatnonzero((self.hashes[np.minimum(at, last)] != hashed) | (at >= end))
        absent = []
        while len(wrong):
            over = at[wrong] + 1 >= end[wrong]
            absent.append(wrong[over])
            wrong = wrong[~over]
            at[wrong] += 1
            wrong = wrong[self.hashes[at[wrong]] != hashed[wrong]]
        gone = np.zeros(len(keys), bool)
        if absent:
            gone[np.concatenate(absent)] = True
        value = self.values[np.minimum(at, last)]
        value[gone] = missing
        return value, gone


class KneserNey:
    """Interpolated modified Kneser-Ney over byte n-grams of one language, in memory.

    What ``language_models`` computes in Spark for any number of n-grams, for a small table.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        by = np.argsort(keys)
        tables = {order: (keys[by].astype(np.uint64), counts[by])}
        for n in range(order - 1, 0, -1):
            tables[n] = np.unique(tables[n + 1][0] & np.uint64((1 << 8 * n) - 1), return_counts=True)
        self.grams, self.weights = {}, {}
        below_keys, below = None, None
        for n in range(1, order + 1):
            k, c = tables[n]
            n1, n2, n3, n4 = (int((c == i).sum()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = np.array([0.0, 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)])
            d[1:] = np.clip(d[1:], [0.1, 0.1, 0.1], [0.95, 1.95, 2.95])
            off = d[np.minimum(c, 3)]
            context, where = np.unique(k >> np.uint64(8), return_inverse=True)
            total = np.bincount(where, weights=c)
            gamma = np.bincount(where, weights=off) / total
            lower = 1 / 256 if below is None else below[np.searchsorted(below_keys, k & np.uint64((1 << 8 * (n - 1)) - 1))]
            p = (c - off) / total[where] + gamma[where] * lower
            below_keys, below = k, p
            self.grams[n] = HashArrays(k, np.log(p))
            self.weights[n] = HashArrays(context, np.log(gamma))

    def log_probability(self, keys: np.ndarray, n: int | None = None) -> np.ndarray:
        n = self.order if n is None else n
        if not n:
            return np.full(len(keys), -np.log(256), np.float32)
        value, gone = self.grams[n].find(keys, 0.0)
        if gone.any():
            some = keys[gone]
            weight, _ = self.weights[n].find(some >> np.uint64(8), 0.0)
            value[gone] = weight + self.log_probability(some & np.uint64((1 << 8 * (n - 1)) - 1), n - 1)
        return value


def dealt(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """chunk, lang, same (digest) and text of the rows of ``df``; a chunk is named by the digest alone."""
    size = df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = df.select(language(lang).alias("lang"), digest(text).alias("same"), F.col(text).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("same"), F.lit(chunks)).cast("long").alias("chunk"), "lang", "same", "text")
    return rows.mapInArrow(_unseen, "chunk long, lang string, same binary, text binary")


def language(lang: str):
    return F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """chunk, lang, gram, n: the n-grams of the different texts of each chunk."""
    return materialize(texts.groupBy("chunk").applyInArrow(_counter(order), COUNTED), "ngram-chunks")


def language_models(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, value: natural logarithm of the probability of every n-gram that was counted."""
    tables = {order: materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("c")), "ngram-counts")}
    for n in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        tables[n] = materialize(tables[n + 1].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c")), "ngram-continuations")
    below = longest = None
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
        one = F.lit(1)
        y = F.when(n1 > 0, n1 / F.greatest(n1 + 2 * n2, one)).otherwise(0.5)
        clip = lambda d, high: F.greatest(F.lit(0.1), F.least(F.lit(high), d))
        counts = tables[n].groupBy("lang").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        discounts = counts.select(
            "lang",
            clip(1 - 2 * y * n2 / F.greatest(n1, one), 0.95).alias("d1"),
            clip(2 - 3 * y * n3 / F.greatest(n2, one), 1.95).alias("d2"),
            clip(3 - 4 * y * n4 / F.greatest(n3, one), 2.95).alias("d3"),
        )
        # A context is followed by 256 different bytes at most.
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        c, d1, d2, d3 = F.col("c"), F.col("d1"), F.col("d2"), F.col("d3")
        within = tables[n].select(
            "lang", "gram", "c", F.sum("c").over(context).alias("total"),
            *[F.sum((c == i).cast("long")).over(context).alias(f"k{i}") for i in (1, 2)], F.sum((c > 2).cast("long")).over(context).alias("k3"),
        )
        rows = within.join(discounts, "lang")
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        gamma = (d1 * F.col("k1") + d2 * F.col("k2") + d3 * F.col("k3")) / F.col("total")
        rows = rows.select("lang", "gram", ((c - off) / F.col("total")).alias("own"), gamma.alias("gamma"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("short"))
        if below is None:
            below = rows.select("lang", "gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("short"), F.col("p").alias("lower"))
            below = rows.join(lower, ["lang", "short"]).select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        made = materialize(below, "ngram-models")
        release(tables[n], *([] if longest is None else [longest]))
        below = longest = made
    return below.select("lang", "gram", F.log("p").cast("float").alias("value"))


SCORED = "lang string, same binary, " + ", ".join(f"{k} long" for k in FEATURES) + ", nats double"


def _scorer(order: int):
    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        out = [pa.table({"lang": pa.array([], pa.string()), "same": pa.array([], pa.binary()), **{k: pa.array([], pa.int64()) for k in FEATURES}, "nats": pa.array([], pa.float64())})]
        names = known["lang"].combine_chunks().dictionary_encode() if len(known) else pa.array([], pa.string()).dictionary_encode()
        names = as_array(names)
        code, listed = names.indices.to_numpy(), names.dictionary.to_pylist()
        gram, value = known["gram"].to_numpy(), known["value"].to_numpy()
        for lang, same, texts in _different(chunk):
            mask = code == listed.index(lang) if lang in listed else np.zeros(len(gram), bool)
            keys, values = gram[mask], value[mask]
            by = np.argsort(keys)
            keys, values = keys[by], values[by]
            features, nats = text_features(texts), []
            for _, _, raw, offsets in text_slices(texts):
                found, counts = grams(raw, offsets, order)
                each = -values[np.searchsorted(keys, found.astype(np.int64))].astype(np.float64) if len(found) else np.zeros(0)
                ends = np.cumsum(counts)
                sums = np.array([each[e - c : e].sum() for e, c in zip(ends, counts, strict=True)])
                with np.errstate(invalid="ignore", divide="ignore"):
                    nats.append(sums / counts)
            nats = np.concatenate(nats)
            columns = {k: pa.array(features[k].astype(np.int64)) for k in FEATURES}
            out.append(pa.table({"lang": pa.array([lang] * len(same), pa.string()), "same": same.cast(pa.binary()), **columns, "nats": pa.array(nats, mask=~np.isfinite(nats))}))
        return pa.concat_tables(out)

    return run


def score_texts(texts: DataFrame, counted: DataFrame, models: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, same, the base features and ``nats``, the mean negative log-probability of a byte: a row for each different text."""
    values = counted.select("chunk", "lang", "gram").join(models, ["lang", "gram"])
    return materialize(texts.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_scorer(order), SCORED), "quality-texts")


def bands(scored: DataFrame, identity: str, lang: str = "lang") -> DataFrame:
    """Middle and robust deviation of each language, every different text counted once.

    Quartiles are exact to ``GRAIN`` nats: texts are counted by value, so a language has some ten thousand
    rows however many texts it has, and the same quartiles in any layout.
    """
    texts = scored.filter(F.col("nats").isNotNull() & (F.col("n_words") >= MIN_WORDS)).select(F.col(lang).alias("__lang"), identity, "nats").dropDuplicates(["__lang", identity])
    counts = texts.groupBy("__lang", F.round(F.col("nats") / GRAIN).cast("long").alias("__value")).agg(F.count("*").alias("__n"))
    so_far, whole = Window.partitionBy("__lang").orderBy("__value"), Window.partitionBy("__lang")
    placed = counts.withColumn("__up_to", F.sum("__n").over(so_far)).withColumn("__all", F.sum("__n").over(whole))
    at = lambda share: F.min(F.when(F.col("__up_to") >= share * F.col("__all"), F.col("__value"))) * GRAIN
    return placed.groupBy("__lang").agg(at(0.5).alias("__middle"), F.greatest((at(0.75) - at(0.25)) / 1.349, F.lit(LEAST_DEVIATION)).alias("__deviation"))


def judge(scored: DataFrame, text_bytes: str, identity: str, lang: str = "lang", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """``scored`` with ``base_failed`` and ``kept``."""
    # Written, so that its size is known when the join is planned: texts are not shuffled by language.
    limits = materialize(bands(scored, identity, lang), "quality-bands")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    room = F.col("__deviation") * F.sqrt(1 + SHORT_BYTES / F.greatest(F.col(text_bytes), F.lit(1)))
    inside = F.coalesce(F.col("nats").between(F.col("__middle") - lower * room, F.col("__middle") + upper * room), F.lit(True))
    joined = scored.join(limits, F.col(lang).eqNullSafe(F.col("__lang")), "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside).drop("__lang", "__middle", "__deviation")


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with features, perplexity and verdict."""
    ship(df.sparkSession)
    texts = dealt(df, text, lang)
    counted = count_grams(texts)
    models = language_models(counted)
    scored = score_texts(texts, counted, models)
    release(counted)
    keep = [c for c in (carry if carry is not None else df.columns) if c not in (*FEATURES, *ADDED)]
    marked = df.withColumn("__bytes", F.octet_length(F.coalesce(F.col(text), F.lit("")))).withColumn("__same", digest(text)).withColumn("__known", language(lang))
    marked = marked.select(*dict.fromkeys([*keep, lang, "__bytes", "__same", "__known"]))
    scored = scored.withColumnsRenamed({"lang": "__known", "same": "__same"})
    judged = judge(materialize(marked.join(scored, ["__known", "__same"]), "quality-scores"), "__bytes", "__same", lang)
    return judged.select(*keep, *FEATURES, *ADDED)
