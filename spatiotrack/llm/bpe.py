"""Operator 9, byte-level BPE encoding and decoding: corpus-level merge replay.

Every different piece of the whole corpus is encoded once, by Spark, in these steps:

1. Rows are taken in slices of about ``SLICE_BYTES`` of text. A slice's different pieces (cut where
   the public pattern always cuts, see ``textsplit``) are dealt by their stem into lists.
2. The lists of all slices meet by stem, so that equal pieces of the whole corpus are in one place.
   There they are cut by the public pattern into words, and all different words are merged together:
   their bytes form one long list of tokens with links to the neighbours inside a word; an inverted
   index leads from a merge (by its rank) to all positions where its pair stands; the ranks come in
   order, and applying a merge touches the two neighbours of each position only and enters their new
   pairs into the index. If a merge opens a pair of lower rank than its own, the order inside that
   word matters, and that word is encoded on its own.
3. Each list goes back to its slice with the ids of its pieces, and meets the slice's rows, which
   travel as compressed blocks; ids are then looked up and joined.

A slice and a group of lists are all that a task holds, however large a source or a group of copies
is; equal pieces of a slice are combined before anything is shuffled. Nothing is broadcast or
collected. Should a repeated task deal its rows otherwise, a piece without ids is encoded on the spot.

Edge cases: a null text is empty and has no ids; any bytes can be encoded, since all 256 single
bytes are in the vocabulary; repeated texts give equal ids; extra columns pass through, but ``ids``
is replaced, and so cannot be the text; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_array, ship
from .packing import load_ranks, rank_path
from .textsplit import PieceCache, split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

BLOCK = 512
#: Text whose pieces are looked up together.
SLICE_BYTES = 14 << 20
#: Text in one block of rows.
ROW_BYTES = 4 << 20
#: Bytes of different pieces that are merged together, as far as groups of stems go.
REPLAY_BYTES = 4 << 20


class MergeReplay:
    """Rank-ordered merging of many words at once.

    ``rank`` holds the merge that is open at each position, so the index of a block of ranks is one
    selection and one sort; pairs that open inside the current block are added as they arise.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for whole, m in ranks.items():
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i]), ranks.get(whole[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = m
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[int(k)] for k in self.keys], np.int32)

    def open(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or -1."""
        key = left.astype(np.int64) << 20 | right
        at = self.keys.searchsorted(key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def single(self, word: bytes) -> list[int]:
        """One word, the lowest rank first and the leftmost of equals."""
        t = [int(self.byte[b]) for b in word]
        while True:
            best = min(((m, i) for i in range(len(t) - 1) if (m := self.pairs.get(t[i] << 20 | t[i + 1], -1)) >= 0), default=None)
            if best is None:
                return t
            m, i = best
            t[i : i + 2] = [m]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's ids start and end among them."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        lengths[whole >= 0] = 1
        starts = np.concatenate([[0], np.cumsum(lengths)])
        tok = np.empty(starts[-1], np.int32)
        split = np.flatnonzero(whole < 0)
        tok[starts[:-1][whole >= 0]] = whole[whole >= 0]
        if len(split):
            inside = np.ones(len(tok), bool)
            inside[starts[:-1][whole >= 0]] = False
            tok[inside] = self.byte[np.frombuffer(b"".join([words[k] for k in split]), np.uint8)]
            self._replay(tok, starts, split, words)
        alive = tok >= 0
        return tok[alive], np.concatenate([[0], np.cumsum(alive)])[starts]

    def _replay(self, tok: np.ndarray, starts: np.ndarray, split: np.ndarray, words: list[bytes]) -> None:
        n = len(tok)
        left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        left[starts[:-1][np.diff(starts) > 0]] = -1
        right[starts[1:][np.diff(starts) > 0] - 1] = -1
        rank = np.full(n, -1, np.int32)
        at = np.flatnonzero(right >= 0)
        rank[at] = self.open(tok[at], tok[at + 1])
        live = at
        odd: list[np.ndarray] = []
        last, edges = int(self.merged.max(initial=-1)), [*range(0, 4 * BLOCK, BLOCK // 4)]
        edges += [*range(4 * BLOCK, last + 1, BLOCK), max(last, 4 * BLOCK) + 1]
        for number, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if number % 8 == 0:
                live = live[tok[live] >= 0]
            now = rank[live]
            chosen = (now >= low) & (now < high)
            places = live[chosen]
            if not len(places):
                continue
            order = np.argsort(now[chosen], kind="stable")
            places, now = places[order], now[chosen][order]
            first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
            index = {int(now[a]): places[a:b] for a, b in zip(first, [*first[1:], len(now)], strict=True)}
            late: dict[int, list[int]] = {}
            heap = list(index)
            while heap:
                m = heapq.heappop(heap)
                p, added = index.pop(m, None), late.pop(m, None)
                if added:
                    p = np.unique(np.array(added) if p is None else np.concatenate([p, added]))
                if p is None:
                    continue
                p = p[rank[p] == m]
                if not len(p):
                    continue
                if (rank[right[p]] == m).any():
                    # Pairs that share a token, as in a run of equal characters: one at a time, from the left.
                    rounds = [np.array([x], p.dtype) for x in np.sort(p)]
                else:
                    rounds = [p]
                for p in rounds:
                    if len(rounds) > 1 and rank[p[0]] != m:
                        continue
                    q = right[p]
                    r = right[q]
                    more = r >= 0
                    pr, rr = p[more], r[more]
                    twin = rank[rr] == m
                    if twin.any():
                        between = self.open(np.full(int(twin.sum()), m, np.int32), tok[rr[twin]])
                        odd.append(pr[twin][(between >= 0) & (between < m)])
                    tok[p], tok[q] = m, -1
                    right[p] = r
                    rank[q] = -1
                    rank[p] = -1
                    left[rr] = pr
                    pl = p[left[p] >= 0]
                    ll = left[pl]
                    changed = np.concatenate([pr, ll])
                    new = self.open(tok[changed], tok[np.concatenate([rr, pl])])
                    rank[changed] = new
                    soon = (new >= 0) & (new < high)
                    if soon.any():
                        for place, k in zip(changed[soon].tolist(), new[soon].tolist(), strict=True):
                            if k < m:
                                odd.append(np.array([place]))
                            if k in late:
                                late[k].append(place)
                            else:
                                late[k] = [place]
                                heapq.heappush(heap, k)
        if odd and len(places := np.unique(np.concatenate(odd))):
            # A merge opened a lower rank: inside that word the order of single steps matters.
            for k in np.unique(starts.searchsorted(places, "right") - 1):
                ids = self.single(words[k])
                tok[starts[k] : starts[k + 1]] = -1
                tok[starts[k] : starts[k] + len(ids)] = ids


_made: dict[str, PieceCache] = {}
_bytes: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _codec(path: str) -> PieceCache:
    """Encoder of pieces; only the tasks that merge make one."""
    if path not in _made:
        import public_tokenizers
        import regex

        replay, words = MergeReplay(load_ranks(path)), regex.compile(public_tokenizers.PATTERN)

        def encode(pieces: list[str]) -> list[bytes]:
            cut = [words.findall(p) for p in pieces]
            different = list({w for ws in cut for w in ws})
            ids, ends = replay.encode([w.encode() for w in different])
            raw, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
            coded = {w: raw[a:b] for w, a, b in zip(different, ends[:-1], ends[1:], strict=True)}
            return [coded[ws[0]] if len(ws) == 1 else b"".join([coded[w] for w in ws]) for ws in cut]

        _made[path] = PieceCache(encode)
    return _made[path]


def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in order of id, and where each id's bytes start."""
    if path not in _bytes:
        ranks = load_ranks(path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            lengths[i] = len(b)
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        _bytes[path] = np.frombuffer(b"".join(b for b, _ in by_id), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    return _bytes[path]


#: A list of pieces (kind 0, without or with ids) or a block of rows (kind 1) of a slice.
LISTS = "slice long, kind int, stem int, pieces binary, heads array<string>, ids binary"
_STEM = " \t\n.,;:!?\"'()[]"


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"slice": pa.int64(), "kind": pa.int32(), "stem": pa.int32(), "pieces": pa.binary(), "heads": pa.list_(pa.string()), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds))


def _sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with the number of their slice, which depends on the rows of the input's partition alone, not on its batches.

    The last column holds the partition's number and is left out.
    """
    done = 0
    for batch in batches:
        if not len(batch):
            continue
        task = batch.column(batch.num_columns - 1)[0].as_py() << 32
        batch = batch.select(range(batch.num_columns - 1))
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = done + np.cumsum(sizes) - sizes
        done += int(sizes.sum())
        number = before // limit
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield task | int(number[a]), batch.slice(a, b - a)


def _listed(stems: int, limit: int):
    """Step 1: the different pieces of each slice, by stem."""

    def lists(number: int, spaced: set[str], heads: set[str]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, list]] = {}
        for k, found in enumerate((spaced, heads)):
            for p in found:
                stem = zlib.crc32(p.strip(_STEM).encode()) % stems
                if stem not in by:
                    by[stem] = [], []
                by[stem][k].append(p)
        pack = zstandard.ZstdCompressor(level=3).compress
        pieces = [pack("".join([" " + p for p in sorted(x)]).encode()) for x, _ in by.values()]
        n = len(by)
        yield _rows(slice=[number] * n, kind=[0] * n, stem=list(by), pieces=pieces, heads=[x for _, x in by.values()], ids=[None] * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spaced, heads = -1, set(), set()
        for number, rows in _sliced(batches, 0, limit):
            if number != now and now >= 0:
                yield from lists(now, spaced, heads)
                spaced, heads = set(), set()
            now = number
            for a in range(0, len(rows), 256):
                for t in rows.column(0)[a : a + 256].to_pylist():
                    parts = split(t or "")
                    heads.add(parts[0])
                    spaced.update(parts[1:])
        if now >= 0:
            yield from lists(now, spaced, heads)

    return run


def _unpacked(raw: bytes) -> list[str]:
    """The pieces of a list: a text of its own, which splits where they were joined."""
    return split(zstandard.ZstdDecompressor().decompress(raw).decode())[1:]


def _replayed(path: str):
    """Step 2: lists with the ids of their pieces, first those with a space in front, then the heads."""

    def coded(lists: list[tuple], encode) -> pa.RecordBatch:
        spaced = [_unpacked(x[2]) for x in lists]
        different = list(set().union(*spaced))
        heads = list(set().union(*[x[3] for x in lists]))
        ids = encode([" " + p for p in different] + heads)
        of, of_head = dict(zip(different, ids, strict=False)), dict(zip(heads, ids[len(different) :], strict=True))
        pack, out = zstandard.ZstdCompressor(level=3).compress, []
        for found, (_, _, _, first) in zip(spaced, lists, strict=True):
            each = [of[p] for p in found] + [of_head[p] for p in first]
            lengths = np.array([len(x) // 4 for x in each], "<u4").tobytes()
            out.append(pack(lengths + b"".join(each)))
        n = len(lists)
        return _rows(slice=[x[0] for x in lists], kind=[0] * n, stem=[x[1] for x in lists], pieces=[x[2] for x in lists], heads=[x[3] for x in lists], ids=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, last = _codec(path).encode, [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("slice", "stem", "pieces", "heads")]
            for row in zip(*columns, strict=True):
                if row[1] != last and size > REPLAY_BYTES:
                    yield coded(held, encode)
                    held, size = [], 0
                last = row[1]
                held.append(row)
                size += 3 * len(row[2])
        if held:
            yield coded(held, encode)

    return run


def _blocks_of_rows(text: int, limit: int):
    """Whole rows of each slice, as compressed Arrow streams of about ``ROW_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for number, rows in _sliced(batches, text, limit):
            a = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(rows.column(text)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes.astype(np.int64))
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROW_BYTES, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=how) as out:
                    out.write_batch(rows.slice(a, b - a))
                yield _rows(slice=[number], kind=[1], stem=[0], pieces=[None], heads=[None], ids=[sink.getvalue().to_pybytes()])
                a = b

    return run


def _joined(path: str, text: int, names: list[str], decode: bool):
    """Step 3: the rows of each slice with their ids, and what these decode to; its lists come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                number, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if number != now:
                    now, cache = number, PieceCache(lambda pieces: _codec(path).encode(pieces), remember=None)
                if kind == 0:
                    spaced, heads = _unpacked(batch.column(3)[i].as_py()), batch.column(4)[i].as_py()
                    raw = unpack.decompress(batch.column(5)[i].as_py())
                    n = len(spaced) + len(heads)
                    ends = (4 * (n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))]))).tolist()
                    each = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    cache.spaced.update(zip(spaced, each, strict=False))
                    cache.plain.update(zip(heads, each[len(spaced) :], strict=True))
                    continue
                for rows in pa.ipc.open_stream(pa.py_buffer(batch.column(5)[i].as_py())):
                    parts = [b"", *cache.look_up(as_array(rows.column(text)))]
                    offsets = np.cumsum([len(x) // 4 for x in parts]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                    yield pa.RecordBatch.from_arrays([*rows.columns, ids, *([decoded(path, ids)] if decode else [])], names)

    return run


def decoded(path: str, ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids; a null list has none."""
    blob, ends = _tokens(path)
    ids = as_array(ids)
    out = []
    for a in range(0, len(ids), 256):
        some = ids[a : a + 256]
        flat, n = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        lengths = ends[flat + 1] - ends[flat]
        to = np.concatenate([[0], np.cumsum(lengths)])
        raw = blob[np.repeat(ends[flat] - to[:-1], lengths) + np.arange(to[-1])].tobytes()
        cuts = to[np.concatenate([[0], np.cumsum(n)])]
        out += [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.array(out, pa.binary())


def encode_documents(df: DataFrame, text: str = "text", path: str | None = None, slice_bytes: int = SLICE_BYTES, decode_to: str | None = None) -> DataFrame:
    """``df`` with ``ids`` array<int>, and with the bytes that these decode to in column ``decode_to`` if it is given.

    Decoding in the same pass spares a second set of Python workers.
    """
    ship(df.sparkSession)
    path = path or rank_path(VOCABULARY)
    stems = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("ids", decode_to)])
    at, part = kept.columns.index(text), F.spark_partition_id().cast("long").alias("__part")
    lists = kept.select(text, part).mapInArrow(_listed(stems, slice_bytes), LISTS)
    coded = lists.repartition("stem").sortWithinPartitions("stem").mapInArrow(_replayed(path), LISTS)
    blocks = kept.select("*", part).mapInArrow(_blocks_of_rows(at, slice_bytes), LISTS)
    met = coded.unionByName(blocks).repartition("slice").sortWithinPartitions("slice", "kind")
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decode_to, T.BinaryType())] if decode_to else [])]
    schema = T.StructType([*kept.schema.fields, *made])
    return met.mapInArrow(_joined(path, at, schema.names, bool(decode_to)), schema)


def decode_ids(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the decoded bytes in column ``to``; a null list decodes to no bytes."""
    ship(df.sparkSession)
    path = path or rank_path(VOCABULARY)
    return df.withColumn(to, F.arrow_udf(lambda x: decoded(path, x), "binary")(F.col(ids)))
