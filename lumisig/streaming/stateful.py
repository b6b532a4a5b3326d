"""The state of each key kept by the stream itself: for downstream consumers of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_by_key(events: DataFrame) -> DataFrame:
    """(key, seq, op, value) whenever a key's newest event changes, of a stream (key long, seq long, op int, value double).

    The state of a key is one row. Events that come late or twice do nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.getOption
        newest = tuple(seen) if seen else None
        for b in batches:
            top = b.loc[b["seq"].idxmax()]
            if newest is None or top["seq"] > newest[0]:
                newest = int(top["seq"]), int(top["op"]), None if pd.isna(top["value"]) else float(top["value"])
        if newest is not None and (not seen or newest[0] != seen[0]):
            state.update(newest)
            yield pd.DataFrame({"key": [key[0]], "seq": [newest[0]], "op": [newest[1]], "value": [newest[2]]})

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long, op int, value double", "seq long, op int, value double", "update", GroupStateTimeout.NoTimeout)
