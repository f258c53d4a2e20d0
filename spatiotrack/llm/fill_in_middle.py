"""Operator 12, fill-in-the-middle transformation: Aho-Corasick event scan.

A text is a row of units: a run of ASCII letters, or any other single character. Two cuts, in units,
make it a prefix, a middle and a suffix, which are put together in another order behind sentinels.

One automaton runs over the text once and finds events alone: the characters at which the class changes
(its words are all pairs of a letter and another ASCII character, in either order) and the sentinels.
Every character outside ASCII is one ``?`` for the scan, so positions stay. Between two events the class
is the same, so the units of a gap need no look at its characters: one for letters, its length for
others. The prefix sums of these counts, one for each event, are enough to find where any unit starts.

Cuts and form come from the digest of seed and key, so they depend on nothing else, whatever task a row
is in. No row is shuffled. ``restore`` is built of column functions.

Edge cases: a null text is empty, and its form plain; so is the form of a text that holds a sentinel; a
null key counts as an empty string; repeated rows give equal results; a text of any length is scanned
whole, events one at a time; extra columns pass through, those named like an output are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CHANGE, _SENTINEL = 0, 1
_automata: dict[tuple, ahocorasick.Automaton] = {}


def automaton(sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> ahocorasick.Automaton:
    """Matches the sentinels, and every change between a letter and another character of ASCII."""
    if sentinels not in _automata:
        made = ahocorasick.Automaton()
        for a in map(chr, range(128)):
            for b in map(chr, range(128)):
                if (a in string.ascii_letters) != (b in string.ascii_letters):
                    made.add_word(a + b, _CHANGE)
        for s in sentinels:
            made.add_word(s, _SENTINEL)
        made.make_automaton()
        _automata[sentinels] = made
    return _automata[sentinels]


class Units:
    """Where the units of a text start, from its events."""

    def __init__(self, text: str, sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)):
        self.length, self.sentinel = len(text), False
        seen = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        changes = np.fromiter(self._changes(automaton(sentinels).iter(seen)), np.int64)
        self.starts = np.concatenate([[0], changes])
        gaps = np.diff(self.starts, append=self.length)
        letters = (np.arange(len(gaps)) % 2 == 0) == (seen[:1] in string.ascii_letters)
        units = np.where(letters, np.minimum(gaps, 1), gaps)
        self.before = np.cumsum(units) - units
        self.n = int(units.sum())

    def _changes(self, events: Iterator[tuple[int, int]]) -> Iterator[int]:
        for end, kind in events:
            if kind == _CHANGE:
                yield end
            else:
                self.sentinel = True

    def start(self, unit: int) -> int:
        """The character at which a unit starts; the length of the text for the one after the last."""
        if unit >= self.n:
            return self.length
        gap = int(np.searchsorted(self.before, unit, "right")) - 1
        return int(self.starts[gap] + unit - self.before[gap])


def _hashes(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]


ADDED = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``df`` with n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and output.

    ``percent`` of the texts are cut, ``spm_percent`` of these with the suffix in front.
    """
    ship(df.sparkSession)
    names = [c for c, _ in ADDED]
    if text in names:
        raise ValueError(f"the text cannot be in a column named {text}")
    hashes = _hashes(key, seed)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    at, width = kept.columns.index(text), len(kept.columns)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in ADDED]])

    def one(t: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        units = Units(t)
        n = units.n
        if not t or units.sentinel or h3 % 100 >= percent:
            return n, "plain", None, None, t
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.start(first), units.start(last)
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}{MIDDLE}{t[a:b]}"
        return n, "psm", a, b - a, f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}{MIDDLE}{t[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch.column(at), most=4096):
                rows = batch.slice(a, b - a)
                made = [one(t or "", *h) for t, *h in zip(*[rows.column(k).to_pylist() for k in (at, *range(width, width + 4))], strict=True)]
                new = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], *new], schema.names)

    # Digests come from the key's column as it was given, also where it is replaced.
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], *hashes).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; a part never holds a sentinel, so each stands where it was put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))), F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
