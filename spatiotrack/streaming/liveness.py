"""Which receivers are alive, from a stream of scanner dumps: a row whenever one goes quiet, comes back or leaves.

A dump tells when each scanner last heard anything, on a clock of its source's own. Ages count from the
newest stamp of the dump that anchored them, and grow with the time of the calls. A dump anchors
anew unless its newest stamp lies in the minute up to the last anchor's: then nobody heard anything
since, and ages must grow on; a stamp further back is a clock that was reset.

State is kept by source: the anchor, and age and last told status of its scanners. A receiver that falls
silent is told by a timer of event time, or by the next dump if that comes first; either gives the same
row, stamped with the moment at which the age passed the limit, so results do not depend on how the
stream is cut into batches. Dumps at or before the last one of their source are dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import DEFAULTS, Settings

OUT = "source string, scanner string, at double, online boolean"
NAMES = ["source", "scanner", "at", "online"]

#: A newest stamp up to so many seconds behind the anchor's is a dump in which nobody heard anything.
STALLED_S = 60.0


class Liveness:
    """The state of one source."""

    def __init__(self, limit: float, text: str | None = None):
        self.limit = limit
        self.newest, self.anchor, self.ages, self.told, self.last = json.loads(text) if text else (None, None, {}, {}, None)

    def dump(self) -> str:
        return json.dumps([self.newest, self.anchor, self.ages, self.told, self.last])

    def _quiet_at(self, scanner: str) -> float:
        return self.anchor + self.limit - self.ages[scanner]

    def quiet(self, until: float) -> Iterator[tuple[str, float, bool]]:
        """Scanners whose age passed the limit before ``until``."""
        for scanner in sorted(k for k, online in self.told.items() if online):
            if self._quiet_at(scanner) < until:
                self.told[scanner] = False
                yield scanner, self._quiet_at(scanner), False

    def next_quiet(self) -> float | None:
        return min((self._quiet_at(k) for k, online in self.told.items() if online), default=None)

    def take(self, at: float, newest: float, seen: dict[str, float | None]) -> Iterator[tuple[str, float, bool | None]]:
        """Changes up to and by a dump; ``seen``: each scanner's stamp. A scanner that is not in it leaves (null)."""
        if self.last is not None and at <= self.last:
            return
        self.last = at
        yield from self.quiet(at)
        if self.newest is not None and self.newest - STALLED_S < newest <= self.newest:
            return
        self.newest, self.anchor = newest, at
        self.ages = {k: math.inf if stamp is None else newest - stamp for k, stamp in seen.items()}
        for scanner in sorted({*self.told, *self.ages}):
            online = self.ages[scanner] <= self.limit if scanner in self.ages else None
            if scanner not in self.told or self.told[scanner] != online:
                yield scanner, at, online
        self.told = {k: age <= self.limit for k, age in self.ages.items()}


def _dumps(rows: pd.DataFrame) -> Iterator[tuple[float, float, dict]]:
    """Time, newest stamp and scanners' stamps of each dump of sorted rows."""
    for at, one in rows.groupby("at", sort=True):
        stamps = one["last_seen"]
        own = one[one["scanner"].notna()]
        seen = own.groupby("scanner")["last_seen"].max()
        yield float(at), max(0.0, float(stamps.max())) if stamps.notna().any() else 0.0, {k: None if pd.isna(v) else float(v) for k, v in seen.items()}


def _frame(source, changes: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(source, *c) for c in changes], columns=NAMES).astype({"online": "boolean", "at": "float64"})


def liveness_stream(dumps: DataFrame, s: Settings = DEFAULTS, late: str = "30 seconds") -> DataFrame:
    """Changes (source, scanner, at, online) of a stream of dump rows (source, ts, scanner, last_seen).

    A row of ``dumps`` is a device of one dump, a dump all rows of one source and moment; ``scanner`` is null for devices that
    are none. ``online`` is null when a scanner is no longer listed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Liveness(s.offline_s, state.get[0] if state.exists else None)
        changes: list[tuple] = []
        if state.hasTimedOut:
            changes += live.quiet(state.getCurrentWatermarkMs() / 1000)
        else:
            for at, newest, seen in _dumps(pd.concat(list(batches))):
                changes += live.take(at, newest, seen)
        state.update((live.dump(),))
        soon = live.next_quiet()
        if soon is not None:
            state.setTimeoutTimestamp(max(math.floor(soon * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield _frame(key[0], changes)

    rows = dumps.select(F.col("source").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "scanner", F.col("last_seen").cast("double").alias("last_seen"))
    rows = rows.withColumn("at", F.col("ts").cast("double")).withWatermark("ts", late)
    return rows.groupBy("source").applyInPandasWithState(run, OUT, "live string", "append", GroupStateTimeout.EventTimeTimeout)


def liveness_changes(dumps: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The same of a table of dump rows, up to the last dump of each source; one ordered pass a source that carries its state along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, live, held = None, None, None
        for b in batches:
            rows = b if held is None else pd.concat([held, b])
            # The last dump may go on in the next batch.
            tail = (rows["source"] == rows["source"].iloc[-1]) & (rows["at"] == rows["at"].iloc[-1])
            held, ready = rows[tail], rows[~tail]
            for key, own in ready.groupby("source", sort=False):
                if key != source:
                    source, live = key, Liveness(s.offline_s)
                yield _frame(key, [c for d in _dumps(own) for c in live.take(*d)])
        if held is not None and len(held):
            if held["source"].iloc[0] != source:
                source, live = held["source"].iloc[0], Liveness(s.offline_s)
            yield _frame(source, [c for d in _dumps(held) for c in live.take(*d)])

    rows = dumps.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("ts").cast("timestamp").cast("double").alias("at"), "scanner", F.col("last_seen").cast("double").alias("last_seen"))
    return rows.repartition("source").sortWithinPartitions("source", "at").mapInPandas(run, OUT)
