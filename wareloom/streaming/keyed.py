"""State per key that outlives batches: hosts that refuse, and keys that are tried again until they are done.

State stands in RocksDB with a time to live; timers let go what waits. Keys are dealt to BUCKETS groups, each with one
value that has the state of its keys: what calls to the store and frames of few rows cost goes by buckets, not by keys. A
bucket's rows of one batch are taken by key in the order of their time and number and worked through as whole columns;
their number is bounded by the source's rate (``maxFilesPerTrigger`` and the like), not here.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Refusals in a row after which a host isn't asked, days that a host's state is kept.
THRESHOLD, DAYS = 5, 30
#: Fixed value: seconds between two requests to a host.
DELAY = 2.0
#: Fixed value: the way to ask that every host is asked by first, which needn't be remembered.
FIRST_RUNG = "A1"
#: Groups of keys with one value of state each; a stream keeps the number that it has begun with.
BUCKETS = 4096
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOSTS = "host string, id long, ts long, verdict string, starts_at long, streak long, longest long, rung string"
TRIES = "key string, id long, attempt int"


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, which these need, and end when there is nothing new: timers
    that are due are looked at in the next batch that has rows."""
    own = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streaks(refused: np.ndarray, cleared: np.ndarray, streak: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked, streak after) of each attempt in order: a host is asked unless it has refused ``threshold`` times in a row
    since the last row that clears it; what isn't asked changes nothing."""
    n, at = len(refused), 0
    asked, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    stops = [*np.flatnonzero(cleared).tolist(), n]
    for stop in stops:
        if at < stop and streak < threshold:
            part = refused[at:stop]
            place = np.arange(len(part))
            answered = np.maximum.accumulate(np.where(part, -1, place))
            own = np.where(answered >= 0, place - answered, place + 1 + streak)
            full = np.flatnonzero(own >= threshold)
            end = int(full[0]) + 1 if len(full) else len(part)
            asked[at : at + end], after[at : at + end] = True, own[:end]
            at, streak = at + end, int(own[end - 1])
        after[at:stop] = streak
        at, streak = stop + 1, 0
    return asked, after


def starts(ts: np.ndarray, free_at: int, delay: int) -> np.ndarray:
    """When each request starts: not before it comes, nor before the host is free, nor within ``delay`` of the last."""
    if not len(ts):
        return ts
    waited = np.arange(len(ts)) * delay
    slack = ts - waited
    slack[0] = max(slack[0], free_at)
    return np.maximum.accumulate(slack) + waited


def _bucketed(rows: DataFrame, key: str, buckets: int):
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("_bucket")


def _in_order(rows: Iterator, key: str):
    """A bucket's rows by key, time and number, and where each key's rows begin."""
    import pandas as pd

    frames = list(rows)
    frame = (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values([key, "ts", "id"], kind="stable", ignore_index=True)
    keys = frame[key].to_numpy(dtype=object)
    return frame, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


class _Kept:
    """The state of a bucket's keys: a list of plain values by key."""

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None = None):
        self.value = handle.getValueState("kept", "keys string", ttl)

    def read(self) -> dict[str, list]:
        return json.loads(self.value.get()[0]) if self.value.exists() else {}

    def write(self, kept: dict[str, list]) -> None:
        self.value.update((json.dumps(kept, separators=(",", ":")),))


class Hosts(StatefulProcessor):
    """Of each host streak, longest, rung, when it is free, when it was last heard of, what waits (id, ts) and until when."""

    def __init__(self, threshold: int, delay: float, days: float, cool_ms: int | None):
        self.threshold, self.delay, self.ttl, self.cool_ms = threshold, int(delay * 1e6), int(days * 86_400_000), cool_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = _Kept(handle, self.ttl)

    def _alive(self, now: int) -> dict[str, list]:
        return {host: s for host, s in self.kept.read().items() if s[4] + self.ttl > now}

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frame, begins = _in_order(rows, "host")
        now = timerValues.getCurrentProcessingTimeInMs()
        kept, timers = self._alive(now), set()
        n = len(frame)
        host, kind, ways = (frame[c].to_numpy(dtype=object) for c in ("host", "kind", "rung"))
        ids, ts = frame["id"].to_numpy(np.int64), frame["ts"].to_numpy(np.int64)
        refused, cleared, answered = kind == "refused", kind == "clear", kind == "answered"
        asked, after, most, start, named = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(n, object)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
            streak, longest, rung, free_at, _, parked, due = kept.get(host[a], [0, 0, None, 0, now, [], None])
            asked[a:b], after[a:b] = streaks(refused[a:b], cleared[a:b], streak, self.threshold)
            most[a:b] = np.maximum.accumulate(np.maximum(after[a:b], longest))
            own = a + np.flatnonzero(asked[a:b])
            start[own] = starts(ts[own], free_at, self.delay)
            # the way that the last answer came by, until the host is cleared
            place = np.arange(a, b)
            last = np.maximum.accumulate(np.where(asked[a:b] & answered[a:b], place, -1))
            clear = np.maximum.accumulate(np.where(cleared[a:b], place, -1))
            named[a:b] = [(None if ways[x] == FIRST_RUNG else ways[x]) if x > c else None if c >= 0 else rung for x, c in zip(last.tolist(), clear.tolist(), strict=True)]
            if self.cool_ms is not None:
                if clear[-1] >= 0:
                    parked, due = [], None
                waits = max(a, int(clear[-1])) + np.flatnonzero(~(asked | cleared)[max(a, int(clear[-1])) : b])
                parked = parked + [(int(i), int(t)) for i, t in zip(ids[waits], ts[waits], strict=True)]
                if parked and due is None:
                    due = now + self.cool_ms
                    timers.add(due)
            free_at = int(start[own[-1]]) + self.delay if len(own) else free_at
            kept[host[a]] = [int(after[b - 1]), int(most[b - 1]), named[b - 1], free_at, now, parked, due]
        for due in timers:
            self.handle.registerTimer(due)
        self.kept.write(kept)
        yield pd.DataFrame({
            "host": host, "id": ids, "ts": ts, "verdict": np.where(cleared, "clear", np.where(asked, "go", "fast_fail")),
            "starts_at": pd.arrays.IntegerArray(start, ~asked), "streak": after, "longest": most, "rung": pd.Series(named, dtype=object),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        kept = self._alive(now)
        for host, (_, longest, rung, free_at, _, parked, due) in kept.items():
            if due is None or due > now:
                continue
            waited = sorted((t, i) for i, t in parked)
            begin = starts(np.array([t for t, _ in waited], dtype=np.int64), free_at, self.delay).tolist()
            kept[host] = [0, longest, rung, begin[-1] + self.delay, now, [], None]
            out += [(host, i, t, "retry", at, 0, longest, rung) for (t, i), at in zip(waited, begin, strict=True)]
        self.kept.write(kept)
        names = ["host", "id", "ts", "verdict", "starts_at", "streak", "longest", "rung"]
        yield pd.DataFrame({c: pd.Series([row[k] for row in out], dtype=object if c in ("host", "verdict", "rung") else "int64") for k, c in enumerate(names)})

    def close(self) -> None:
        pass


def ask_hosts(
    attempts: DataFrame, threshold: int = THRESHOLD, delay: float = DELAY, days: float = DAYS, cool_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """``attempts`` (host, id long, ts long in microseconds, kind, rung) as HOSTS, in update mode, each row once.

    ``kind`` is refused, answered (``rung`` says by which way) or clear. A row's verdict is go, with the time at which it
    starts (``starts``), fast_fail once its host has refused ``threshold`` times in a row, or clear; streak, longest and
    rung are the host's after it. A host's state goes after ``days`` without news. With ``cool_ms`` rows that failed fast
    wait; that long after the first of them they come again as retry, and the host is asked again. Rows of later batches
    count after those of earlier ones, whatever their time. Rows without a host, time or number don't count.
    """
    kept = attempts.where("host is not null and ts is not null and id is not null and kind in ('refused', 'answered', 'clear')")
    grouped = _bucketed(kept.select("host", "id", "ts", "kind", "rung"), "host", buckets)
    return grouped.transformWithStateInPandas(Hosts(threshold, delay, days, cool_ms), HOSTS, "Update", "ProcessingTime")


class Tries(StatefulProcessor):
    """Of each key whether it is done, whether it is under way, and its tries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        frame, begins = _in_order(rows, "key")
        kept, keys = self.kept.read(), frame["key"].to_numpy(dtype=object)
        sizes, ends = np.diff([*begins, len(frame)]), np.append(begins[1:], len(frame)) - 1
        before = np.array([kept.get(k, (0, 0, 0)) for k in keys[begins]], dtype=np.int64)
        done, running, tries = np.repeat(before, sizes, axis=0).T
        kind = frame["kind"].to_numpy()
        asks, fails, dones = kind == "request", kind == "failed", kind == "done"

        def so_far(flags: np.ndarray) -> np.ndarray:
            total = np.cumsum(flags)
            return total - np.repeat(total[begins] - flags[begins], sizes)

        # requests since the last failure; the first of them passes unless one was running before
        number, first = np.cumsum(asks), np.zeros(len(frame), dtype=bool)
        first[begins] = True
        base = np.maximum.accumulate(np.where(fails, number, np.where(first, number - asks, 0)))
        nth = number - base + np.where(so_far(fails) == 0, running, 0)
        passes = asks & (nth == 1) & (so_far(dones) == 0) & (done == 0)
        attempt = tries + so_far(passes)
        over = (done[ends] > 0) | (so_far(dones)[ends] > 0)
        kept.update(zip(keys[begins], zip(over.astype(int).tolist(), (nth[ends] > 0).astype(int).tolist(), attempt[ends].tolist())))
        self.kept.write(kept)
        yield frame.loc[passes, ["key", "id"]].assign(attempt=attempt[passes].astype(np.int32))

    def close(self) -> None:
        pass


def let_through(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of ``events`` (key, id long, ts long, kind) the requests to work on, as TRIES in update mode.

    ``kind`` is request, failed or done. A request passes unless its key is done or another of its requests is under way;
    a failed key is let through again, with the number of its attempt. So what may come more than once is done once, and
    what failed isn't lost. Rows without a key, time or number don't count.
    """
    kept = events.where("key is not null and ts is not null and id is not null and kind in ('request', 'failed', 'done')")
    return _bucketed(kept.select("key", "id", "ts", "kind"), "key", buckets).transformWithStateInPandas(Tries(), TRIES, "Update", "None")


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now into ``path``, a folder per batch; a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with stateful(updates.sparkSession):
        return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of_hosts(rows: DataFrame) -> DataFrame:
    """(host, streak, longest, refusing, rung, next_allowed): each host's state, of what ``ask_hosts`` has put out."""
    last = F.max_by(F.struct("streak", "longest", "rung"), F.struct("ts", "id")).alias("x")
    per = rows.groupBy("host").agg(last, (F.max("starts_at") + int(DELAY * 1e6)).alias("next_allowed"))
    return per.select("host", "x.streak", "x.longest", (F.col("x.streak") >= THRESHOLD).alias("refusing"), "x.rung", "next_allowed")
