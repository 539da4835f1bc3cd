"""Structured Streaming jobs; each has a batch twin with the same rows once all input is in."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window


def with_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """`ts` as a timestamp with a watermark; rows later than `late` behind it are dropped by stateful steps."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def alerts_once(events: DataFrame) -> DataFrame:
    """One alert per key while it is pending; logins and errors never collapse."""
    e = with_time(events)
    one = e.where("event_type not in ('signup', 'error')").withColumn("key", F.concat_ws(":", "event_type", F.col("user_id") % 10)).dropDuplicatesWithinWatermark(["key"])
    return one.unionByName(e.where("event_type in ('signup', 'error')").withColumn("key", F.lit(None).cast("string")))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    return with_time(events).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return with_time(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once_per_key(actions: DataFrame) -> DataFrame:
    return with_time(actions).where("decision = 'execute'").dropDuplicatesWithinWatermark(["idempotency_key"])


def _admit(times: list[float], t: float, width: float, most: int) -> tuple[list[float], bool]:
    """A hit is admitted when fewer than `most` admitted ones lie in the last `width` seconds."""
    times = [x for x in times if t - x < width]
    return (times + [t], True) if len(times) < most else (times, False)


def rate_limit(hits: DataFrame, width: float = 60.0, most: int = 10) -> DataFrame:
    """host, event_id, admitted; refused hits do not count. Batch twin, one host a group in time order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        times, out = [], []
        for r in f.sort_values(["ts", "event_id"]).itertuples(index=False):
            times, ok = _admit(times, r.ts.timestamp(), width, most)
            out.append((r.host, r.event_id, ok))
        return pd.DataFrame(out, columns=["host", "event_id", "admitted"])

    return hits.groupBy("host").applyInPandas(run, "host string, event_id long, admitted boolean")


def stateful(keyed, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """A grouped stream through a processor. Its state lives in RocksDB, on disk beside the executor and in the checkpoint, so it
    may outgrow memory; that store is what the session's later stateful queries use, too."""
    keyed._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)


class RateLimiter(StatefulProcessor):
    """A host's admitted times are a list; a timer lets them go when the watermark has passed the last one's window."""

    def __init__(self, width: float, most: int):
        self.width, self.most = width, most

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t double")

    def handleInputRows(self, key, rows, timerValues):
        times, out = [t for (t,) in self.times.get()] if self.times.exists() else [], []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            times, ok = _admit(times, r.ts.timestamp(), self.width, self.most)
            out.append((key[0], r.event_id, ok))
        self.times.put([(t,) for t in times])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(int((max(times) + self.width) * 1000))
        yield pd.DataFrame(out, columns=["host", "event_id", "admitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        yield pd.DataFrame({"host": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "admitted": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def rate_limit_stream(hits: DataFrame, width: float = 60.0, most: int = 10, late: str = "10 minutes") -> DataFrame:
    """The same as a stream; hits later than `late` are dropped."""
    return stateful(hits.withWatermark("ts", late).groupBy("host"), RateLimiter(width, most), "host string, event_id long, admitted boolean", "EventTime")


class Streaks(StatefulProcessor):
    """A user's failures since the last success are one value."""

    def __init__(self, at: int):
        self.at = at

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n, out = (self.run.get()[0] if self.run.exists() else 0), []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            n = 0 if r.success else n + 1
            if n:
                out.append((key[0], r.seq, n, n >= self.at))
        self.run.update((n,))
        yield pd.DataFrame(out, columns=["username", "seq", "streak", "alert"])

    def close(self) -> None:
        pass


def login_streaks_stream(logins: DataFrame, at: int = 5) -> DataFrame:
    """username, seq, streak of failures since the last success, alert from `at` on."""
    return stateful(logins.groupBy("username"), Streaks(at), "username string, seq long, streak long, alert boolean")


class PendingAlerts(StatefulProcessor):
    """A user's pending alerts are a map from event type to their count and first time; a timer an alert sends it."""

    def __init__(self, pending_ms: int):
        self.pending_ms = pending_ms

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getMapState("open", "event_type string", "n long, first long")

    def handleInputRows(self, key, rows, timerValues):
        for r in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            at = int(r.ts.timestamp() * 1000)
            n, first = self.open.getValue((r.event_type,)) if self.open.containsKey((r.event_type,)) else (0, at)
            self.open.updateValue((r.event_type,), (n + 1, first))
            if not n:
                self.handle.registerTimer(at + self.pending_ms)
        yield self._sent([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs() - self.pending_ms
        out = [(key[0], t, n, pd.Timestamp(first, unit="ms")) for (t,), (n, first) in list(self.open.iterator()) if first <= due]
        for _, t, _, _ in out:
            self.open.removeKey((t,))
        yield self._sent(out)

    @staticmethod
    def _sent(rows):
        f = pd.DataFrame(rows, columns=["user_id", "event_type", "n", "first"])
        return f.astype({"user_id": "int64", "n": "int64", "first": "datetime64[ns]"})

    def close(self) -> None:
        pass


def pending_alerts_stream(events: DataFrame, pending: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """user_id, event_type, n, first: one alert for all events of a type within `pending` seconds of the first one, sent once the
    watermark passes that; types of a user never collapse."""
    return stateful(events.withWatermark("ts", late).groupBy("user_id"), PendingAlerts(int(pending * 1000)), "user_id long, event_type string, n long, first timestamp", "EventTime")


def _chain(f: pd.DataFrame, prev: str) -> tuple[list[tuple], str]:
    out = []
    for r in f.sort_values("seq", kind="stable").itertuples(index=False):
        h = hashlib.sha256(f"{prev}{r.seq}|{r.event_type}".encode()).hexdigest()
        out.append((r.tenant_id, r.seq, prev, h))
        prev = h
    return out, prev


_CHAIN = "tenant_id string, seq long, prev_hash string, hash string"


def audit_chain(events: DataFrame) -> DataFrame:
    """tenant_id, seq, prev_hash, hash: a chain per tenant, 64 zeros before the first event. Batch twin."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_chain(f, "0" * 64)[0], columns=["tenant_id", "seq", "prev_hash", "hash"])

    return events.groupBy("tenant_id").applyInPandas(run, _CHAIN)


_GENESIS = "0" * 64


def audit_log(events: DataFrame) -> DataFrame:
    """The rows of `audit_chain` as a log stores them: with the event's type and its number n in the tenant's chain, from 1."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq", kind="stable")
        out = pd.DataFrame(_chain(f, _GENESIS)[0], columns=["tenant_id", "seq", "prev_hash", "hash"])
        return out.assign(n=range(1, len(f) + 1), event_type=f["event_type"].to_numpy())

    return events.groupBy("tenant_id").applyInPandas(run, f"{_CHAIN}, n long, event_type string")


def verify_page(page: DataFrame, log: DataFrame) -> DataFrame:
    """tenant_id, seq, gap, linked, intact of some rows of an `audit_log`, each against the row before it in the whole log.

    The predecessor is joined by its number in the tenant's chain, not taken from the page, so a page of one event type or one
    actor is verified as it would be within the log. gap: the predecessor is missing; linked: the stored previous hash is its
    stored hash (or the genesis hash of a first row); intact: the stored hash is that of the row."""
    before = log.select("tenant_id", (F.col("n") + 1).alias("n"), F.col("hash").alias("before"))
    p = page.join(before, ["tenant_id", "n"], "left")
    linked = F.col("prev_hash") == F.when(F.col("n") == 1, F.lit(_GENESIS)).otherwise(F.coalesce("before", F.lit("")))
    intact = F.col("hash") == F.sha2(F.concat("prev_hash", F.col("seq").cast("string"), F.lit("|"), "event_type"), 256)
    return p.select("tenant_id", "seq", ((F.col("n") > 1) & F.col("before").isNull()).alias("gap"), linked.alias("linked"), intact.alias("intact"))


def verify_chain(log: DataFrame) -> DataFrame:
    """tenant_id, seq, gap, broken_link, hash_mismatch, problem (those that hold, or 'ok') for every row of an `audit_log`.

    gap: the row before in the tenant's chain is missing, told by n, as seq runs over all tenants; broken_link: the
    stored previous hash is not the hash of the last row that is there; hash_mismatch: the row does not give its own hash.
    Rows cut off at the end of a chain leave no mark in it.
    """
    w = Window.partitionBy("tenant_id").orderBy("n", "seq")
    own = F.sha2(F.concat("prev_hash", F.col("seq").cast("string"), F.lit("|"), F.coalesce("event_type", F.lit("None"))), 256)
    tests = {
        "gap": F.col("n") - F.lag("n", 1, 0).over(w) != 1,
        "broken_link": ~F.col("prev_hash").eqNullSafe(F.lag("hash", 1, _GENESIS).over(w)),
        "hash_mismatch": ~F.col("hash").eqNullSafe(own),
    }
    found = F.array_compact(F.array(*[F.when(F.col(k), k) for k in tests]))
    problem = F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("ok")
    return log.select("tenant_id", "seq", *[c.alias(k) for k, c in tests.items()]).withColumn("problem", problem)


class Chain(StatefulProcessor):
    """A tenant's last hash is one value."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues):
        out, last = _chain(pd.concat(list(rows)), self.last.get()[0] if self.last.exists() else _GENESIS)
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["tenant_id", "seq", "prev_hash", "hash"])

    def close(self) -> None:
        pass


def audit_chain_stream(events: DataFrame) -> DataFrame:
    """The same as a stream; a tenant's last hash is its state."""
    return stateful(events.groupBy("tenant_id"), Chain(), _CHAIN)


class Expiry(StatefulProcessor):
    """A grant's end is one value, and a timer at it; a later end takes its place, a grant that was sent stays sent."""

    def init(self, handle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "ms long, sent boolean")

    def handleInputRows(self, key, rows, timerValues):
        until = int(max(f["valid_until"].max() for f in rows).timestamp() * 1000)
        known, sent = self.until.get() if self.until.exists() else (None, False)
        if not sent and (known is None or until > known):
            if known is not None:
                self.handle.deleteTimer(known)
            self.until.update((until, False))
            self.handle.registerTimer(until)
        yield self._sent([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        self.until.update((until, True))
        yield self._sent([(key[0], pd.Timestamp(until, unit="ms"))])

    @staticmethod
    def _sent(rows):
        return pd.DataFrame(rows, columns=["grant_id", "expired_at"]).astype({"grant_id": "int64", "expired_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def expired_grants_stream(grants: DataFrame) -> DataFrame:
    """grant_id, expired_at once the watermark passes valid_until; each grant once."""
    return stateful(grants.withWatermark("ts", "0 seconds").groupBy("grant_id"), Expiry(), "grant_id long, expired_at timestamp", "EventTime")


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Appends new files once; a rerun with the same checkpoint adds nothing."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
