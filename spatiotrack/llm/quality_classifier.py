"""Operator 6, quality classifier: a byte-level convolutional network in numpy.

The first layer's filters look at ``WIDTH`` bytes; as a byte is one of 256 symbols, a filter is a
table of weights for each place and byte, and a convolution is a sum of table rows. A document is
covered by chunks of ``CHUNK`` bytes that overlap by half. Each filter is rectified and max-pooled
over a chunk; the chunk maxima are averaged and maximised over the whole document, and a logistic
unit combines both into one probability. Tables and unit are learned together by Adam.

Training data: at most ``SAMPLE`` labelled rows of each label, the first by a seeded hash of the
id, never those whose crc32(doc_id) mod 3 is 1, and no more rows than hold ``SAMPLE_BYTES`` of text
together; these bounds are all that reaches the driver. Training reads their whole texts, as scoring
does. Responses are held for blocks of a text only; what follows the longest text is its bytes.

Edge cases: a null text is empty; empty texts get the score of a document without any filter's
response; without labelled rows every score is 0.5; rows with a null label or id teach nothing;
repeated ids teach once; equal texts get equal scores; extra columns pass through, but ``score`` is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_array, ship, text_slices

WIDTH = 5
FILTERS = 16
CHUNK = 512
HALF = CHUNK // 2
SAMPLE = 1500
SAMPLE_BYTES = 64 << 20
EPOCHS = 8
BATCH = 32
#: Bytes of padded text for which responses are held at a time.
BLOCK_BYTES = 1 << 18


@dataclass
class Network:
    tables: np.ndarray  # place, byte, filter
    bias: np.ndarray
    weights: np.ndarray  # of means, then of maxima
    offset: float


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-chunks of each text, at least one, with room for the padding behind its end; first of each."""
    halves = np.maximum(-(-(np.diff(offsets) + WIDTH - 1) // HALF), 1)
    return halves, np.cumsum(halves) - halves


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with every text at the start of a half-chunk, which of them are text, halves, first half."""
    halves, first = _layout(offsets)
    lengths = np.diff(offsets)
    total = int(halves.sum()) * HALF
    data, real = np.zeros(total + WIDTH, np.uint8), np.zeros(total, bool)
    for a, to, n in zip(offsets[:-1].tolist(), (first * HALF).tolist(), lengths.tolist(), strict=True):
        data[to : to + n] = raw[a : a + n]
        real[to : to + n] = True
    return data, real, halves, first


def _responses(net: Network, data: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Rectified responses (half-chunk, place in it, filter)."""
    n = len(real)
    out = net.tables[0][data[:n]]
    for k in range(1, WIDTH):
        out += net.tables[k][data[k : n + k]]
    out += net.bias
    np.maximum(out, 0, out=out)
    out[~real] = 0
    return out.reshape(-1, HALF, len(net.bias))


def _tops(net: Network, data: np.ndarray, real: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response (half-chunk, filter), and where it is; block by block."""
    tops, where = [], []
    for a in range(0, len(real), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(real))
        response = _responses(net, data[a : b + WIDTH], real[a:b])
        if places:
            at = response.argmax(axis=1)
            where.append(at)
            tops.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :])
        else:
            tops.append(response.max(axis=1))
    return np.concatenate(tops), np.concatenate(where) if places else None


def _chunks(halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First half of each chunk, its second half (the same for a text of one half), and its text."""
    counts = np.maximum(halves - 1, 1)
    text = np.repeat(np.arange(len(halves)), counts)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return start, np.minimum(start + 1, (first + halves - 1)[text]), text


def _pool(top: np.ndarray, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over its chunks, for each text, of the halves' maxima ``top``."""
    start, second, _ = _chunks(halves, first)
    chunk = np.maximum(top[start], top[second])
    counts = np.maximum(halves - 1, 1)
    at = np.cumsum(counts) - counts
    return np.concatenate([np.add.reduceat(chunk, at) / counts[:, None], np.maximum.reduceat(chunk, at)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def predict(net: Network, texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, raw, offsets in text_slices(texts, 1 << 20):
        data, real, halves, first = _padded(raw, offsets)
        pooled = _pool(_tops(net, data, real)[0], halves, first)
        out.append(_sigmoid(pooled.astype(np.float64) @ net.weights + net.offset))
    return np.concatenate(out)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if not len(texts):
        net.weights[:] = 0
        return net
    shapes = [net.tables.shape, net.bias.shape, net.weights.shape, ()]
    first_moment, second_moment = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            raw = np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
            data, real, halves, first = _padded(raw, offsets)
            top, where = _tops(net, data, real, places=True)
            start, second, text = _chunks(halves, first)
            left = top[start] >= top[second]
            chunk = np.where(left, top[start], top[second])
            half = np.where(left, start[:, None], second[:, None])
            pooled = _pool(top, halves, first)
            error = (_sigmoid(pooled @ net.weights + net.offset) - labels[chosen]) * balance[chosen] / len(chosen)
            counts = np.maximum(halves - 1, 1)
            highest = pooled[text, FILTERS:] == chunk
            ties = np.add.reduceat(highest.astype(float), np.cumsum(counts) - counts)[text]
            grad = error[text, None] * (net.weights[:FILTERS] / counts[text, None] + net.weights[FILTERS:] * highest / ties)
            grad[chunk <= 0] = 0
            place = half * HALF + where[half, np.arange(FILTERS)]
            d_tables = np.zeros(shapes[0])
            column = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                np.add.at(d_tables[k], (data[place + k], column), grad)
            grads = [d_tables + 1e-6 * net.tables, grad.sum(axis=0), pooled.T @ error + 1e-4 * net.weights, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first_moment[i] = 0.9 * first_moment[i] + 0.1 * g
                second_moment[i] = 0.999 * second_moment[i] + 0.001 * g * g
                move = rate * (first_moment[i] / (1 - 0.9**step)) / (np.sqrt(second_moment[i] / (1 - 0.999**step)) + 1e-8)
                if i == 0:
                    net.tables -= move.astype(np.float32)
                elif i == 1:
                    net.bias -= move.astype(np.float32)
                elif i == 2:
                    net.weights -= move
                else:
                    net.offset -= float(move)
    return net


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_classifier(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 11) -> Network:
    """Learn from at most ``sample`` rows of each label, and ``sample_bytes`` of text; a text of over an eighth of that is left out, so that it cannot take the place of all others."""
    ship(df.sparkSession)
    usable = labels.filter(~held_out(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("__label"))
    chosen = None
    for value in (0, 1):
        some = usable.filter(F.col("__label") == value).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = [(r[0], r[1]) for r in chosen.collect()]
    if not ids:
        return train([], np.zeros(0), seed)
    spark = df.sparkSession
    small = F.broadcast(spark.createDataFrame(ids, chosen.schema))  # 2 * sample rows at most
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(key, text).join(small, key).groupBy(key, "__label").agg(F.min(raw).alias("__raw")).filter(F.octet_length("__raw") <= sample_bytes // 8)
    # A window over 2 * sample rows at most.
    so_far = F.sum(F.octet_length("__raw").cast("long")).over(Window.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    got = rows.withColumn("__bytes", so_far).filter(F.col("__bytes") <= sample_bytes).orderBy(key).select("__raw", "__label").toArrow()
    return train([bytes(x) for x in got.column("__raw").to_pylist()], got.column("__label").to_numpy().astype(float), seed)


def score_documents(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``df`` with ``score`` double."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)
    made = F.arrow_udf(lambda texts: pa.array(predict(shared.value, as_array(texts))), "double")
    return df.withColumn("score", made(F.col(text)))
