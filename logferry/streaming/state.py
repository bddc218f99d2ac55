"""Offsets per file as keyed streaming state that expires when a file is not seen for a while."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logferry import settings as S

OUTPUT = "component string, fingerprint string, path string, from_off bigint, to_off bigint"


class OffsetTracker(StatefulProcessor):
    """Turns sightings of files (path, length) into byte ranges that have not been handed out yet."""

    def __init__(self, idle: dt.timedelta = S.IDLE_LIMIT):
        self._idle_ms = idle // dt.timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._offset = handle.getValueState("offset", "position bigint", ttlDurationMs=self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = int(self._offset.get()[0]) if self._offset.exists() else 0
        length, path = known, None
        for pdf in rows:
            top = pdf["length"].idxmax()
            if pdf["length"][top] >= length:
                length, path = int(pdf["length"][top]), pdf["path"][top]
        self._offset.update((length,))
        if path is not None and length > known:
            yield pd.DataFrame(
                {"component": [key[0]], "fingerprint": [key[1]], "path": [path], "from_off": [known], "to_off": [length]}
            )

    def close(self) -> None:
        pass


def track_offsets(sightings: DataFrame, idle: dt.timedelta = S.IDLE_LIMIT) -> DataFrame:
    """Streaming sightings (component, fingerprint, path, length) to new byte ranges.

    Needs the RocksDB state store provider.
    """
    return sightings.groupBy("component", "fingerprint").transformWithStateInPandas(
        statefulProcessor=OffsetTracker(idle), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )
