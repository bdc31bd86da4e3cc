"""Streaming forms: pages into an index as they arrive, and login failures as they happen."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..config import EngineConfig
from ..operators.embedding import Embedder, embedded
from ..plans.ingest import chunked

LOCKS = "user_id long, event_id long, ts timestamp, failures int, locked_until timestamp"
#: A user's state: failures in a row, and attempts (microseconds, id, success) that the watermark hasn't passed.
WAITING = "failures int, at array<long>, event_id array<long>, success array<boolean>"


def ingest(pages: DataFrame, path: str, checkpoint: str, embedder: Embedder, config: EngineConfig = EngineConfig(), **trigger) -> StreamingQuery:
    """Appends the chunks of each batch of whole documents (document, page, text) to Parquet at path, once even if a batch is repeated."""

    def batch(df: DataFrame, number: int) -> None:
        embedded(chunked(df, config), embedder, text="embedding_text").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _count(lock_after: int, lock_minutes: int) -> Callable:
    """Goes through a user's attempts in order of event time, as far as the watermark has passed them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, *waiting = state.get if state.exists else (0, [], [], [])
        columns = [list(x) for x in waiting]
        for b in [] if state.hasTimedOut else batches:
            for to, values in zip(columns, (b["ts"].astype("datetime64[us]").astype("int64"), b["event_id"], b["success"]), strict=True):
                to.extend(values.tolist())
        seen = state.getCurrentWatermarkMs()
        rows = sorted(zip(*columns, strict=True))
        n = bisect_right(rows, seen, key=lambda r: r[0] // 1000)
        out = []
        for at, event_id, success in rows[:n]:
            failures = 0 if success else failures + 1
            if not success:
                until = at + lock_minutes * 60_000_000 if failures >= lock_after else None
                out.append((key[0], event_id, at, failures, until))
        if failures or rows[n:]:
            state.update((failures, *map(list, zip(*rows[n:], strict=True))) if rows[n:] else (failures, [], [], []))
            if rows[n:]:
                state.setTimeoutTimestamp(max(rows[n][0] // 1000, seen + 1))
        elif state.exists:
            state.remove()  # a user without failures needs no state
        if out:  # a table for each user costs more than going through their attempts: none without rows, typed at once
            users, ids, at, counts, until = zip(*out, strict=True)
            times = lambda x: np.array(x, "datetime64[us]")
            yield pd.DataFrame({"user_id": users, "event_id": ids, "ts": times(at), "failures": np.array(counts, "int32"), "locked_until": times(until)})

    return run


def lockouts(attempts: DataFrame, config: EngineConfig = EngineConfig(), *, late: str = "1 hour") -> DataFrame:
    """store.lockouts() of a stream of attempts (user_id, ts, event_id, success), whose rows may come late and in any order.

    An attempt counts once the watermark, `late` behind the newest attempt, has passed it: until then it waits in its user's
    state, and a timer wakes the user up when none of their rows come. Rows that are later than that are dropped by
    the engine. State is the waiting rows and one number; users without failures in a row have none.
    """
    rows = attempts.select("user_id", "ts", "event_id", "success").where("user_id is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(_count(config.lock_after, config.lock_minutes), LOCKS, WAITING, "append", "EventTimeTimeout")
