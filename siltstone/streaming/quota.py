"""Running quota and breaker state of each key in a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, queue_pos long, outcome string"


def quota_stream(stream: DataFrame, quota: int, breaker: int) -> DataFrame:
    """(key, queue_pos, outcome) of a stream of (key, queue_pos, result).

    A key takes results until it has had `quota` matches; `breaker` failures in a row stop it for good. The state of a
    key is three numbers, whatever its rows.
    """

    def step(key, batches, state: GroupState):
        had, streak, stopped = state.get if state.exists else (0, 0, False)
        for pdf in batches:
            rows = pdf.sort_values("queue_pos")
            out = []
            for result in rows["result"]:
                if stopped:
                    out.append("archive_error_circuit_breaker")
                elif had >= quota:
                    out.append("month_quota_met")
                else:
                    had += result == "china_match"
                    streak = streak + 1 if result == "failed" else 0
                    stopped = streak >= breaker
                    out.append(result)
            yield pd.DataFrame({"key": key[0], "queue_pos": rows["queue_pos"].to_numpy(), "outcome": out})
        state.update((int(had), int(streak), bool(stopped)))

    return stream.groupBy("key").applyInPandasWithState(step, OUT, "had int, streak int, stopped boolean", "append", GroupStateTimeout.NoTimeout)
