"""Operator 4, MinHash near-dedup: BagMinHash signatures of weighted word shingles.

A text is the bag of its runs of ``SHINGLE`` words; a shingle's weight is the number of times it
occurs. BagMinHash: an element of weight w owns a hierarchy of dyadic weight intervals [0, 1),
[1, 2), [2, 4), [4, 8) ... Each interval carries a Poisson process whose rate is its length and whose
random numbers depend on the element and the interval only. A point descends from its interval to one
unit cell and counts if that cell lies below w; it hits one of the signature's registers, and each
register keeps its earliest point. Two texts agree in a register with a probability equal to their
weighted Jaccard similarity. Processes stop at a horizon that fills all registers with high
probability, and go on for texts where it didn't.

Steps:

1. Texts are nodes (named by their digest); equal texts are one node, combined before any shuffle.
2. Signatures are cut into bands; a band's value names a bucket, and the smallest node of a bucket
   is its hub. Each node is paired with the least of its hubs: n nodes give at most n pairs. Pairs
   are verified by their exact multiset overlap, and links joined into components.
3. Members left outside of the component of one of their hubs are verified against that hub.
4. In buckets that still hold several components, neighbours in a random order are verified, round
   after round while that finds links: most of what belongs together is joined by few pairs. Large
   buckets are split into parts, so that no task orders a whole one; step 5 sees what parts hide.
5. Members still outside are joined with the other members of mixed buckets on their rarest shingles
   (a prefix filter, which no pair of sufficient similarity escapes), and verified likewise. So each
   pair of a bucket is linked, in one component already, verified or impossible.

Every step is a join or an aggregation on nodes or buckets; components are found by alternating
star contraction with written tables in between.

Edge cases: a null text counts as empty; all empty texts are one class; texts of one to four words
have one shingle, all their words; a null doc_id is a row of its class like any other, and the
class id (the least doc_id of the class) is null only if all of them are; classes of unlike texts
with the same least doc_id have the same class id, and stay apart in ``deduplicate``; repeated rows
share a class; an empty table gives no rows; extra columns are ignored, or kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Prefix, Scratch, as_array, materialize, mix64, row_of, ship, text_slices, word_spans

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 7
BANDS = 30
#: Expected number of empty registers of a text at its first horizon: exp(-SLACK).
SLACK = 4.0
#: Texts that are signed together: each has some thousand points, however short it is.
SIGNED_TEXTS = 256
#: Rounds of neighbour pairs before the exact last step, which finds whatever they leave.
TURNS = 1
#: Members of a bucket that are put into one random order; a larger bucket is split at random into parts of this size.
ORDERED = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, in order, and the number of shingles of each text."""
    starts, ends, counts = word_spans(raw, offsets)
    words = Prefix(raw).spans(starts, ends)
    rows = row_of(counts)
    first = np.cumsum(counts) - counts
    size = np.minimum(counts, width)
    # A short text is one shingle; otherwise there is one for each word with enough words behind it.
    at = np.flatnonzero(np.arange(len(words)) - first[rows] <= counts[rows] - size[rows]) if len(words) else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        here = np.where(k < size[rows[at]], padded[at + k], np.uint64(0)) if len(at) else value
        value = value * _STEP + here
    return mix64(value + size[rows[at]].astype(np.uint64)), np.bincount(rows[at], minlength=len(counts))


def _bag(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements (row, hash) and weights."""
    value, counts = shingles(raw, offsets)
    key = row_of(counts).astype(np.uint64) << np.uint64(40) | value >> np.uint64(24)
    key, weight = np.unique(key, return_counts=True)
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), weight


def _arrivals(seed: np.ndarray, number: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the points ``number`` and following of each process, and their waiting times."""
    steps = np.arange(number + 1, number + many + 1, dtype=np.uint64) * _STEP
    value = mix64(seed[:, None] + steps[None, :])
    return value, -np.log((value >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


def signatures(raw: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Signature of each text (rows x registers); texts without words have zeros."""
    rows, element, weight = _bag(raw, offsets)
    n = len(offsets) - 1
    total = np.bincount(rows, weights=weight, minlength=n)
    out = np.zeros((n, registers), np.uint64)
    # Processes: interval 0 is [0, 1), interval j is [2**(j-1), 2**j).
    parts = []
    level = 0
    alive = np.arange(len(rows))
    while len(alive):
        start = 0 if level == 0 else 1 << (level - 1)
        length = 1 if level == 0 else start
        parts.append((rows[alive], mix64(mix64(element[alive] + np.uint64(1)) + np.uint64(level * int(_STEP) % (1 << 64))), np.full(len(alive), start), np.full(len(alive), length), weight[alive]))
        level += 1
        alive = alive[weight[alive] > (1 << (level - 1))]
    if not parts:
        return out
    p_row, p_seed, p_start, p_length, p_weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(n)
    horizon[todo] = registers * (np.log(registers) + SLACK) / total[todo]
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        at = np.flatnonzero(wanted[p_row])
        time, number, many = np.zeros(len(at)), 0, 1
        found_key, found_time, found_hash = [], [], []
        while len(at):
            value, wait = _arrivals(p_seed[at], number, many)
            wait /= p_length[at][:, None]
            wait[:, 0] += time
            times = np.cumsum(wait, axis=1)
            inside = times <= horizon[p_row[at]][:, None]
            which, step = np.nonzero(inside)
            hashes = value[which, step]
            index = at[which]
            cell = p_start[index] + (mix64(hashes + np.uint64(7)) % p_length[index].astype(np.uint64)).astype(np.int64)
            counts = cell < p_weight[index]
            index, hashes = index[counts], hashes[counts]
            register = (mix64(hashes + np.uint64(13)) % np.uint64(registers)).astype(np.int64)
            found_key.append(p_row[index] * registers + register)
            found_time.append(times[which, step][counts])
            found_hash.append(hashes)
            going = inside[:, -1]
            at, time = at[going], times[going, -1]
            number, many = number + many, min(64, 1 if number < 1 else 2 * many)
        key, when, hashes = np.concatenate(found_key), np.concatenate(found_time), np.concatenate(found_hash)
        order = np.argsort(-when)
        flat = np.zeros(n * registers, np.uint64)
        flat[key[order]] = hashes[order] | np.uint64(1)  # of equal registers the last one stays: the earliest point
        made = flat.reshape(n, registers)
        full = (made[todo] != 0).all(axis=1)
        out[todo[full]] = made[todo[full]]
        todo = todo[~full]
        horizon[todo] *= 2
    return out


def band_values(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit bucket name for each band."""
    value = np.zeros((len(sig), bands), np.uint64)
    parts = sig[:, : rows * bands].reshape(len(sig), bands, rows)
    for k in range(rows):
        value = mix64(value * _STEP + parts[:, :, k])
    return (value + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def _band_udf(rows: int, bands: int):
    def make(texts: pa.Array) -> pa.Array:
        out, sizes = [np.zeros(0, np.int64)], [0]
        for _, _, raw, offsets in text_slices(texts, 1 << 20, SIGNED_TEXTS):
            sig = signatures(raw, offsets, rows * bands)
            some = (sig != 0).any(axis=1)
            out.append(band_values(sig[some], rows, bands).ravel())
            sizes += (some * bands).tolist()
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(out)))

    return F.arrow_udf(make, "array<bigint>")


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, from whole multisets."""
    left, right = as_array(left), as_array(right)
    out = np.zeros(len(left))
    at = 0
    for a, b, raw, offsets in text_slices(left, 1 << 20):
        for c, d, other, other_offsets in text_slices(right[a:b], 1 << 20):
            lo, hi = offsets[c], offsets[d]
            bags = []
            for r, o in ((raw[lo:hi], offsets[c : d + 1] - lo), (other, other_offsets)):
                value, counts = shingles(r, o)
                key = mix64(value + row_of(counts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                key, first, weight = np.unique(key, return_index=True, return_counts=True)
                bags.append((key, row_of(counts)[first], weight, counts))
            (k1, r1, w1, n1), (k2, _, w2, n2) = bags
            _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
            both = np.bincount(r1[i], weights=np.minimum(w1[i], w2[j]), minlength=d - c)
            union = n1 + n2 - both
            out[a + c : a + d] = np.divide(both, union, out=np.zeros(d - c), where=union > 0)
        at = b
    return out


def _shingle_udf():
    def make(texts: pa.Array) -> pa.Array:
        out, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, raw, offsets in text_slices(texts, 1 << 20):
            value, counts = shingles(raw, offsets)
            out.append(value)
            sizes.append(counts)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))

    return F.arrow_udf(make, "array<bigint>")


def _overlap_udf():
    return F.arrow_udf(lambda a, b: pa.array(overlap(a, b)), "double")


def components(edges: DataFrame, name: str = "components", keep=materialize) -> DataFrame:
    """(node, root): the least node of each component, for every node of ``edges`` (columns u, v).

    Alternates large-star and small-star steps until each component is a star around its least node;
    a written table of no more files than twice the cores ends each round.
    """
    files = 2 * edges.sparkSession.sparkContext.defaultParallelism
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = keep(now.coalesce(files), name)
    while True:
        ends = now.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
        met = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if not met.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first()[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = keep(small.filter("u <> v").distinct().coalesce(files), name)


def _verify(pairs: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """Pairs (u, v) with their similarity; ``texts`` has a row (node, body) for each node in them."""
    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("body").alias("left")), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("body").alias("right")), "v")
    return keep(two.select("u", "v", _overlap_udf()(F.col("left"), F.col("right")).alias("similarity")), "dedup-verified")


def _links(verified: DataFrame, similarity: float) -> DataFrame:
    return verified.filter(F.col("similarity") >= similarity).select("u", "v")


def _placed(spokes: DataFrame, joined: DataFrame) -> DataFrame:
    """Bucket members with the components of themselves and of their hub."""
    rows = spokes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hubs = joined.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    return rows.join(hubs, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub")).select("bucket", "held", "node", "root", "hub", "hub_root")


def _mixed(spokes: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    placed = _placed(spokes, joined)
    return placed.join(placed.filter("root <> hub_root").select("bucket").distinct(), "bucket", "left_semi")


def _rare_pairs(loose: DataFrame, around: DataFrame, texts: DataFrame, similarity: float, keep) -> DataFrame:
    """Pairs (u, v) of a loose node and one around it in another component that can be similar enough.

    Shingles are ordered from the rarest. With similarity s, two texts of n <= m shingles share at
    least s / (1 + s) (n + m) of them; so one of the first m - ceil(s m) + 1 of the larger is among
    the first n - ceil(2 s / (1 + s) n) + 1 of the smaller (prefix filter), and from the first shared
    one on, both must hold that many (positional filter). No link escapes either.
    """
    spread = texts.join(around, "node", "left_semi").select("node", F.explode(_shingle_udf()(F.col("body"))).alias("h"))
    counted = keep(spread.groupBy("node", "h").agg(F.count(F.lit(1)).alias("w")), "dedup-shingles")
    common = counted.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("node").orderBy("df", "h")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(common, "h").withColumn("n", F.sum("w").over(Window.partitionBy("node"))).withColumn("at", F.sum("w").over(so_far) - F.col("w")).withColumn("back", F.lag("h").over(order))
    room = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9)
    rare = ranked.filter(F.col("at") <= room(similarity)).select("node", "h", "n", "at", "back", (F.col("at") <= room(2 * similarity / (1 + similarity))).alias("short"))
    rare = keep(rare.join(around, "node"), "dedup-rare")
    left = rare.join(loose.select("node"), "node", "left_semi").select("h", *[F.col(c).alias(f"a_{c}") for c in ("node", "root", "n", "at", "back", "short")])
    right = rare.select("h", *[F.col(c).alias(f"b_{c}") for c in ("node", "root", "n", "at", "back", "short")])
    # Two texts that also share the shingle before this one meet there already.
    again = F.coalesce(F.col("a_back") == F.col("b_back"), F.lit(False))
    apart = (F.col("a_root") != F.col("b_root")) & ~again & (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9)
    met = left.filter("a_short").join(right, "h").filter(apart & (F.col("a_n") <= F.col("b_n")))
    met = met.unionByName(left.join(right.filter("b_short"), "h").filter(apart & (F.col("a_n") > F.col("b_n"))))
    pairs = met.groupBy("a_node", "b_node", "a_n", "b_n").agg(F.min("a_at").alias("i"), F.min("b_at").alias("j"))
    shared = similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-9
    pairs = pairs.filter(F.least(F.col("a_n") - F.col("i"), F.col("b_n") - F.col("j")) >= shared)
    return pairs.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v")).distinct()


def node_name(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """A row for each row of ``df``: key, ``node`` binary (the text's digest), ``class_id`` and ``root``.

    ``root``, the least node of the class, names it; ``class_id`` is a label that classes can share.
    """
    ship(df.sparkSession)
    scratch = Scratch()
    keep = scratch.keep
    docs = df.select(F.col(key).alias("__key"), node_name(text).alias("node"), F.col(text).alias("body"))
    signed = materialize(docs.select("__key", "node", _band_udf(rows, bands)(F.col("body")).alias("bands")), "dedup-signatures")
    nodes = signed.groupBy("node").agg(F.min("__key").alias("rep"), F.first("bands").alias("bands"))
    nodes = keep(nodes, "dedup-nodes")

    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("__last"), F.count(F.lit(1)).alias("held")).filter("hub <> __last").drop("__last")
    members = keep(spread.join(buckets, "bucket"), "dedup-members")

    linked = members.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    wanted = nodes.join(linked, "node", "left_semi").select("node", F.col("rep").alias("__key"))
    # Only one row of each group of equal texts is fetched; keys and digests spread the rows evenly.
    same = docs["node"] == wanted["node"]
    texts = docs.join(wanted, same & docs["__key"].eqNullSafe(wanted["__key"])).select(docs["node"], docs["__key"], docs["body"])
    texts = keep(texts.groupBy("node", "__key").agg(F.first("body").alias("body")).select("node", "body"), "dedup-texts")

    # One pair for each node first: most buckets then lie inside one component and need no more.
    spokes = members.filter("node <> hub")
    pairs = spokes.groupBy(F.col("node").alias("u")).agg(F.min("hub").alias("v"))
    first = _verify(pairs, texts, keep)
    links = _links(first, similarity)
    joined = components(links, keep=keep)

    # Members outside of their hub's component, against that hub.
    outside = _placed(spokes, joined).filter("root <> hub_root").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    second = _verify(outside.join(first, ["u", "v"], "left_anti"), texts, keep)
    links = keep(links.unionByName(_links(second, similarity)), "dedup-links")
    joined = components(links, keep=keep)

    # Mixed buckets: neighbours in a random order of each bucket, as long as that joins components.
    known = first.unionByName(second)
    for turn in range(TURNS):
        placed = keep(_mixed(spokes, joined), "dedup-mixed")
        part = F.pmod(F.xxhash64(F.lit(turn), "node", F.lit("part")), F.ceil(F.col("held") / ORDERED))
        order = Window.partitionBy("bucket", part).orderBy(F.xxhash64(F.lit(turn), "bucket", "node"))
        beside = [F.struct(F.lag("node", k).over(order).alias("v"), F.lag("root", k).over(order).alias("v_root")) for k in (1, 2)]
        pairs = placed.select("node", "root", F.array(*beside).alias("n")).select("node", "root", F.inline("n"))
        pairs = pairs.filter("root <> v_root").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()
        tried = _verify(pairs.join(known, ["u", "v"], "left_anti"), texts, keep)
        found = _links(tried, similarity)
        if not found.limit(1).count():
            break
        known = known.unionByName(tried)
        links = keep(links.unionByName(found), "dedup-links")
        joined = components(links, keep=keep)

    # What is still mixed: an exact join on rare shingles finds every link that is left.
    placed = keep(_mixed(spokes, joined), "dedup-mixed")
    whole = placed.select("bucket", "node", "root").unionByName(placed.select("bucket", F.col("hub").alias("node"), F.col("hub_root").alias("root")).distinct())
    # A link between components has an end outside of the bucket's largest one.
    sizes = whole.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    loose = whole.join(largest, "bucket").filter("root <> largest").select("node", "root").distinct()
    more = _rare_pairs(loose, whole.select("node", "root").distinct(), texts, similarity, keep)
    third = _verify(more.join(known, ["u", "v"], "left_anti"), texts, keep)
    all_links = links.unionByName(_links(third, similarity))
    found = materialize(nodes.select("node", "rep").join(components(all_links, keep=keep), "node", "left").withColumn("root", F.coalesce("root", "node")), "dedup-classes")
    scratch.clear()
    named = found.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = found.join(named, "root").select("node", "class_id", "root")
    return signed.select("__key", "node").join(classes, "node").select(F.col("__key").alias(key), "node", "class_id", "root")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``df`` for each class: the one with the least key, all columns kept."""
    found = near_duplicates(df, key, text, **how)
    kept = found.filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("root", "class_id").agg(F.min("node").alias("__node"))
    kept = kept.select(F.col("class_id").alias("__key"), "__node")
    rows = df.withColumn("__name", node_name(text))
    same = rows.join(kept, (F.col("__name") == F.col("__node")) & F.col(key).eqNullSafe(F.col("__key")))
    row = F.struct(*[F.col(c) for c in df.columns])
    # Of rows that are equal in key and text, the least in the other columns, where those can be compared.
    comparable = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema)
    once = same.groupBy("__name", "__key").agg((F.min(row) if comparable else F.first(row)).alias("__row"))
    return once.select("__row.*")
