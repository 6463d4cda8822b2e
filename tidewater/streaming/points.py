"""An addition for streams: the change and spike flags of points as they arrive, with the last points of each entity
held as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity long, event_id long, ts timestamp, value double, rolling_mean double, delta double, spike boolean"
STATE = "recent array<double>"


def rolling_points(stream: DataFrame, scale: float, window: int = 3, limit: float = 2.0) -> DataFrame:
    """stream: entity, event_id, ts, value. Each point with the mean of the last `window` points of its entity, its change
    from the one before in units of scale, and whether either is beyond the limit. State is window numbers an entity."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for p in parts:
            rows = []
            for r in p.sort_values(["ts", "event_id"]).itertuples():
                before = recent[-1] if recent else None
                recent = [*recent, float(r.value)][-window:]
                mean = sum(recent) / len(recent)
                delta = 0.0 if before is None else (r.value - before) / scale
                rows.append((key[0], r.event_id, r.ts, r.value, mean, delta, abs(delta) > limit or abs(r.value - mean) / scale > limit))
            yield pd.DataFrame(rows, columns=["entity", "event_id", "ts", "value", "rolling_mean", "delta", "spike"])
        state.update((recent,))

    return stream.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
