"""Operator 11, BPE encoding and decoding: contiguous rank arrays.

Texts are those of a tokenizer file with word ends (lower case, white space dropped). A text is cut at
white space into pieces, a piece into words as the file says. Each short word is merged in two
contiguous arrays: the tokens that start at its part boundaries, and the merge rank of every
neighbouring pair. The least rank (the leftmost of equals) is looked for, the boundary inside that pair
is deleted from both arrays, and the ranks of its two neighbours are looked up anew, until no pair
merges. Scanning is quadratic, so a word of more than ``SHORT`` characters keeps its ranks in a heap
instead, which gives the same ids.

A word is merged once as long as the worker remembers it, and so is a piece. Rows are taken as they
come, without a shuffle: no source, key or group of copies can be hot, and a lost task is repeated
alone. A text of any length is taken in blocks that end at a space.

Normalising and cutting pieces that are not plain ASCII is left to the file's own normalizer and
pre-tokenizer; strings of added tokens in a text are their ids, as the file wants it.

Edge cases: a null or empty text, or one of white space alone, has no ids and decodes to the empty text;
repeated rows give equal ids; extra columns pass through, but ``ids`` and the column to decode to are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_slices
from .packing import rank_path
from .textsplit import LONGEST, REMEMBERED, blocks

VOCABULARY = "word_bpe_49k.json"

#: Words of at most so many characters are merged in rank arrays.
SHORT = 96
#: Characters of a text, or ids, that are in work at a time.
BLOCK = 1 << 20
_NONE = 1 << 60


class Merger:
    """Ids of single words by the merges of a tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.inner = {c: i for c, i in vocab.items() if len(c) == 1}
        self.final = {c: vocab[c + suffix] for c in self.inner if c + suffix in vocab}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank[vocab[a] << 32 | vocab[b]] = k

    def parts(self, word: str) -> list[int]:
        """The tokens of the single characters; those that the vocabulary lacks are left out."""
        found = [self.inner[c] for c in word[:-1] if c in self.inner]
        if word[-1] in self.final:
            found.append(self.final[word[-1]])
        return found

    def encode(self, word: str) -> list[int]:
        parts = self.parts(word)
        return self.scan(parts) if len(parts) <= SHORT else self.queue(parts)

    def scan(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def queue(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(k, i) for i in range(n - 1) if (k := rank(parts[i] << 32 | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] << 32 | parts[j], _NONE) != k:
                continue
            parts[i], parts[j] = merged[k], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (k := rank(parts[a] << 32 | parts[after[a]], _NONE)) < _NONE:
                    heapq.heappush(heap, (k, a))
        return [p for p in parts if p >= 0]


class WordEncoder:
    """Ids of texts, and texts of ids, by one tokenizer file."""

    #: The file's word pattern for pieces of printable ASCII in lower case.
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"] or made["decoder"]:
            raise ValueError(f"{path} is not a plain BPE with word ends")
        odd = [t["content"] for t in made["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]]
        if odd:
            raise ValueError(f"added tokens with flags that are not supported: {odd}")
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        # Like the library: the leftmost, and there the longest, wins.
        listed = sorted(self.added, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, listed)) + ")") if listed else None
        by_id = {i: s for s, i in [*model["vocab"].items(), *self.added.items()]}
        self.strings = [by_id.get(i) for i in range(max(by_id) + 1)]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = np.array(self.merger.encode(word), "<u4").tobytes()
            if len(word) <= LONGEST:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _between(self, piece: str) -> bytes:
        """A piece without added tokens."""
        if piece.isascii() and piece.isprintable():
            return b"".join([self.word(w) for w in self.plain.findall(piece.lower())])
        return b"".join([self.word(w) for w, _ in self.cut(self.normalize(piece))])

    def piece(self, piece: str) -> bytes:
        if self.names is None or self.names.search(piece) is None:
            ids = self._between(piece)
        else:
            ids = b"".join([np.array([self.added[p]], "<u4").tobytes() if k % 2 else self._between(p) for k, p in enumerate(self.names.split(piece))])
        if len(piece) <= LONGEST:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out = []
        for block in blocks(text, " ", BLOCK):
            known = self.pieces.get
            out.append(b"".join([ids if (ids := known(p)) is not None else self.piece(p) for p in block.replace("\n", " ").split(" ")]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder; unknown ids are left out."""
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for a in range(0, len(all_ids), BLOCK):
            some = [self.strings[i] for i in all_ids[a : a + BLOCK].tolist() if i < len(self.strings)]
            out.append(" ".join([s for s in some if s is not None]))
        return " ".join(out)


_made: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]


def encode_words(df: DataFrame, text: str = "text", path: str | None = None, decode_to: str | None = None) -> DataFrame:
    """``df`` with ``ids`` binary (little-endian unsigned 32-bit), and with the text that these decode to in column ``decode_to`` if it is given."""
    ship(df.sparkSession)
    path = path or rank_path(VOCABULARY)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("ids", decode_to)])
    at = kept.columns.index(text)
    made = [T.StructField("ids", T.BinaryType()), *([T.StructField(decode_to, T.StringType())] if decode_to else [])]
    schema = T.StructType([*kept.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for a, b, _, _ in text_slices(batch.column(at), most=4096):
                rows = batch.slice(a, b - a)
                ids = [encoder.encode(t or "") for t in rows.column(at).to_pylist()]
                texts = [pa.array([encoder.decode(x) for x in ids], pa.string())] if decode_to else []
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary()), *texts], schema.names)

    return kept.mapInArrow(run, schema)


def decode_words(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of the ids in column ``to``; null ids give the empty text."""
    ship(df.sparkSession)
    path = path or rank_path(VOCABULARY)
    return df.withColumn(to, F.arrow_udf(lambda x: pa.array([_encoder(path).decode(v or b"") for v in x.to_pylist()], pa.string()), "string")(F.col(ids)))
