"""Live provider health: latency score, failure streak, cooldown with expiry.

The fold of a provider's attempts is a record that merges: two records of consecutive stretches make
the record of both.  Attempts are dealt by provider and stretch of time, so a busy provider's attempts
meet in many tasks; a group holds many stretches as arrays and reduces them together.  The state never
sees single attempts as Python objects.

Without a delay every micro-batch is folded as it comes: its stretches become records, and the state
merges them in order of time.  With a delay the stream runs on event time: a stretch stays open, as
packed attempts, until the watermark has passed its end; then the provider's timer sorts, reduces and merges it.
The result does not depend on how attempts are spread over files and micro-batches, and equals the
batch form over all stretches that the watermark has passed.  A second timer ends a cooldown.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..functions.errors import error_class

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STRETCH = 60  # seconds of event time whose attempts meet in one group
DEALT = 1024  # groups that share the stretches of all providers in a micro-batch
ATTEMPT = np.dtype([("seconds", "<f8"), ("attempt_no", "<i8"), ("latency", "<f8"), ("code", "<i2")])  # code 0: success, else an error class from 1
STATUS_OF = {"auth_failure": "dead", "quota_rate_limit": "cooldown", "token_limit": "cooldown", "timeout": "degraded", "provider_5xx": "degraded"}

RECORD = (
    "success_count BIGINT, failure_count BIGINT, streak BIGINT, broken BOOLEAN, power DOUBLE, weighted DOUBLE, seed DOUBLE, timed BOOLEAN, "
    "last_error STRING, status STRING, last_failed BOOLEAN, last_seconds DOUBLE"
)
HEALTH = (
    "success_count BIGINT, failure_count BIGINT, consecutive_failures BIGINT, latency_score DOUBLE, last_error_type STRING, "
    "health_status STRING, cooldown_until DOUBLE, last_ts DOUBLE, on_cooldown BOOLEAN, changes BIGINT"
)


class Record(NamedTuple):
    """What a stretch of attempts does to a provider's health."""

    success_count: int = 0
    failure_count: int = 0
    streak: int = 0  # failures at the end
    broken: bool = False  # a success stands before them
    power: float = 1.0  # what is left of the score before the stretch
    weighted: float = 0.0  # what the stretch adds to it
    seed: float = 0.0  # its first latency
    timed: bool = False
    last_error: str = ""
    status: str = ""  # last status it sets, if any
    last_failed: bool = False
    last_seconds: float = 0.0


def reduced_each(attempts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Groups that occur, ascending, and the fields of their records; attempts in any order, all groups in one pass."""
    order = np.lexsort((attempts["attempt_no"], attempts["seconds"], group))
    a, group = attempts[order], group[order]
    n = len(a)
    at = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    ends = starts + sizes - 1
    code, latency = a["code"], a["latency"]
    classes = ["", *V.ERROR_CLASSES]
    good, timed = code == 0, latency > 0
    # Successes and these classes set the status; the last of them counts.
    sets = np.isin(code, [0, *[classes.index(c) for c in STATUS_OF]])
    last_good, last_set = (np.maximum.reduceat(np.where(which, at, -1), starts) for which in (good, sets))
    first_timed = np.minimum.reduceat(np.where(timed, at, n), starts)
    successes, times = np.add.reduceat(good.astype(np.int64), starts), np.add.reduceat(timed.astype(np.int64), starts)
    seen = np.cumsum(timed)
    weights = V.LATENCY_KEEP ** (np.repeat(seen[ends], sizes) - seen)
    names, statuses = np.array(classes, object), np.array([STATUS_OF.get(c, "healthy") for c in classes], object)
    return group[starts], {
        "success_count": successes, "failure_count": sizes - successes, "streak": np.where(last_good >= 0, ends - last_good, sizes), "broken": last_good >= 0,
        "power": V.LATENCY_KEEP**times, "weighted": V.LATENCY_NEW * np.add.reduceat(np.where(timed, latency * weights, 0.0), starts),
        "seed": np.where(times > 0, latency[np.minimum(first_timed, n - 1)], 0.0), "timed": times > 0,
        "last_error": names[code[ends]], "status": np.where(last_set >= 0, statuses[code[np.maximum(last_set, 0)]], ""),
        "last_failed": code[ends] != 0, "last_seconds": a["seconds"][ends],
    }


def reduced(attempts: np.ndarray) -> Record:
    """The record of attempts of one provider, in any order."""
    _, fields = reduced_each(attempts, np.zeros(len(attempts), np.int64))
    return Record(**{name: values.tolist()[0] for name, values in fields.items()})


def merged(a: Record, b: Record) -> Record:
    """The record of two stretches, ``b`` right after ``a``."""
    return Record(
        a.success_count + b.success_count, a.failure_count + b.failure_count, b.streak if b.broken else a.streak + b.streak, a.broken or b.broken,
        a.power * b.power, a.weighted * b.power + b.weighted, a.seed if a.timed else b.seed, a.timed or b.timed,
        b.last_error, b.status or a.status, b.last_failed, b.last_seconds,
    )


class HealthProcessor(StatefulProcessor):
    """One record of state per provider; with event time also the attempts of its open stretches, packed."""

    def __init__(self, keys: list[str], cooldown_seconds: int, event_time: bool, stretch: int = STRETCH):
        self.keys, self.cooldown_seconds, self.event_time, self.stretch = keys, cooldown_seconds, event_time, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD + ", changes BIGINT")
        if self.event_time:
            self.open = handle.getListState("open", "attempts BINARY")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        if self.event_time:
            # One value and one timer per provider and micro-batch; stretches are told apart when a timer reads them.
            earliest = None
            for frame in rows:
                packed = b"".join(frame["attempts"])
                self.open.appendValue((packed,))
                end = int(self._ends(np.frombuffer(packed, ATTEMPT)).min())
                earliest = end if earliest is None else min(earliest, end)
            if earliest is not None:
                self.handle.registerTimer(earliest)
            return
        found = [(r.until, Record(*r[1:])) for frame in rows for r in frame[["until", *Record._fields]].itertuples(index=False, name="Row")]
        record, changes = self._load()
        for _, more in sorted(found, key=lambda f: f[0]):
            record = more if record is None else merged(record, more)
        yield self._row(key, record, changes + 1, record.last_failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, expired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        record, changes = self._load()
        attempts = np.frombuffer(b"".join(bytes(v[0]) for v in self.open.get()), ATTEMPT)
        ends = self._ends(attempts)
        due = ends <= now
        if due.any():
            # Every stretch that the watermark has passed, in one row.
            if due.all():
                self.open.clear()
            else:
                self.open.put([(attempts[~due].tobytes(),)])
                self.handle.registerTimer(int(ends[~due].min()))
            more = reduced(attempts[due])
            record = more if record is None else merged(record, more)
            until = self._until(record)
            if until * 1000 > now:
                self.handle.registerTimer(int(np.ceil(until * 1000)))
            yield self._row(key, record, changes + 1, until * 1000 > now)
        elif record is not None and record.last_failed and int(np.ceil(self._until(record) * 1000)) == expired:
            yield self._row(key, record, changes + 1, False)

    def _ends(self, attempts: np.ndarray) -> np.ndarray:
        """Ends of the attempts' stretches, in milliseconds."""
        return ((np.floor(attempts["seconds"] / self.stretch) + 1) * self.stretch * 1000).astype(np.int64)

    def _load(self) -> tuple[Record | None, int]:
        held = self.record.get()
        return (Record(*held[:-1]), held[-1]) if held else (None, 0)

    def _until(self, record: Record) -> float:
        return record.last_seconds + self.cooldown_seconds if record.last_failed else 0.0

    def _row(self, key, record: Record, changes: int, on_cooldown: bool):
        import pandas as pd

        self.record.update((*record, changes))
        row = {
            **dict(zip(self.keys, key)), "success_count": record.success_count, "failure_count": record.failure_count, "consecutive_failures": record.streak,
            "latency_score": record.power * record.seed + record.weighted if record.timed else 0.0, "last_error_type": record.last_error,
            "health_status": record.status or "healthy", "cooldown_until": self._until(record), "last_ts": record.last_seconds, "on_cooldown": on_cooldown, "changes": changes,
        }
        return pd.DataFrame([row])

    def close(self) -> None:
        pass


def live_health(
    attempts: DataFrame, cooldown_seconds: int = V.COOLDOWN_SECONDS, delay: str | None = None, keys: list[str] | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """Stream of attempts (keys, ts, attempt_no, status, error_type, latency_ms) -> health updates.

    Rows come in order of ``changes`` for each key, at most one for a micro-batch's attempts.  With ``delay`` (an interval) attempts count once
    the watermark, the newest stretch's end less the delay, has passed the end of their stretch; later ones
    are dropped, and the end of a cooldown is a row of its own.  Needs the RocksDB state store.
    """
    keys = keys or ["provider"]
    classes = F.array(*[F.lit(c) for c in V.ERROR_CLASSES])
    code = F.when(F.col("status") == "failed", F.array_position(classes, error_class(F.col("error_type")))).otherwise(0)
    seconds = F.col("ts").cast("double")
    timed = attempts.filter(F.col("status").isin("success", "failed")).select(
        *keys, F.timestamp_seconds((F.floor(seconds / stretch) + 1) * stretch).alias("until"), seconds.alias("seconds"), "attempt_no",
        F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)).alias("latency"), code.cast("smallint").alias("code"),
    )
    fields = attempts.select(*keys).schema
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def arrays(frame) -> np.ndarray:
        out = np.zeros(len(frame), ATTEMPT)
        for name in ATTEMPT.names:
            out[name] = frame[name].to_numpy()
        return out

    def grouped(frame) -> tuple[np.ndarray, object]:
        """Number of each row's provider and stretch, and these by number."""
        group = frame.groupby([*keys, "until"], dropna=False, sort=False).ngroup().to_numpy()
        firsts = np.unique(group, return_index=True)[1]
        return group, frame[[*keys, "until"]].iloc[firsts].reset_index(drop=True)

    def packed(frame):
        group, out = grouped(frame)
        order = np.argsort(group, kind="stable")
        cuts = np.r_[np.searchsorted(group[order], np.arange(len(out))), len(frame)]
        data = arrays(frame)[order]
        return out.assign(attempts=[data[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])])

    def folded(frame):
        group, out = grouped(frame)
        return out.assign(**reduced_each(arrays(frame), group)[1])

    # Providers and stretches meet in a bounded number of groups, each worked on as arrays: a call per stretch costs more than its attempts.
    dealt = timed.groupBy(F.pmod(F.xxhash64(*keys, "until"), F.lit(DEALT)))
    if delay is None:
        met = dealt.applyInPandas(folded, f"{named}, until timestamp, {RECORD}")
    else:
        met = dealt.applyInPandas(packed, f"{named}, until timestamp, attempts binary").withWatermark("until", delay)
    return met.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=HealthProcessor(keys, cooldown_seconds, delay is not None, stretch), outputStructType=f"{named}, {HEALTH}", outputMode="Update",
        timeMode="None" if delay is None else "EventTime",
    )


def save_health(updates: DataFrame, out: str, checkpoint: str):
    """Start writing updates, each micro-batch in its own folder: a batch that runs again writes the same one."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_health(updates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest state of each key from the written updates."""
    keys = keys or ["provider"]
    names = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*names), "changes").alias("_s")).select(*keys, "_s.*")
