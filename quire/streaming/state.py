"""State by key: token buckets, idle eviction and entries that are read once.

Each rule is one pure function of (state, time). The batch forms fold a key's events in the order of
time; the streaming forms keep the same state with ``transformWithStateInPandas``, event time and
timers, so that a stream of one batch gives what the batch form gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Requests at once, requests a second, idle seconds until a bucket goes, life of an entry in seconds.
BURST, RATE, IDLE, LIFE = 6.0, 0.2, 600, 300


def _micros(x) -> Column:
    """Microseconds of a time, with or without a zone; a time without one is read as UTC by a session in UTC."""
    return F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))


def step(tokens: float | None, last: float | None, now: float, burst: float = BURST, rate: float = RATE) -> tuple[float, bool]:
    """Tokens after a request, and whether it is allowed. A new key has all its tokens; denied requests move time too."""
    tokens = burst if tokens is None else min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def limited(requests: DataFrame, key: str = "key", ts: str = "ts", order: str = "seq", burst: float = BURST, rate: float = RATE) -> DataFrame:
    """(key, seq, allowed, tokens): a fold over each key's requests in time.

    Requests stream past by key and time; what is held is the bucket at hand, however many requests a key has.
    """
    t = (_micros(ts) / 1e6).alias("t")
    rows = requests.select(key, F.col(order).cast("long").alias(order), t)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        held = tokens = last = None
        started = False
        for batch in batches:
            allowed, left = [], []
            for k, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or k != held:
                    held, tokens, last, started = k, None, now, True
                tokens, ok = step(tokens, last, now, burst, rate)
                last = now
                allowed.append(ok)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], [key, order, "allowed", "tokens"])

    dealt = rows.repartition(key).sortWithinPartitions(key, "t", order)
    return dealt.mapInArrow(run, f"`{key}` {kind}, `{order}` long, allowed boolean, tokens double")


def idle(requests: DataFrame, now, key: str = "key", ts: str = "ts", seconds: int = IDLE) -> DataFrame:
    """(key, last): keys whose last request is ``seconds`` old at ``now`` or older: their buckets go."""
    return requests.groupBy(key).agg(F.max(ts).alias("last")).where(_micros(now) - _micros("last") >= seconds * 1_000_000)


def read_once(puts: DataFrame, gets: DataFrame, key: str = "token", ts: str = "ts", life: int = LIFE) -> DataFrame:
    """(token, seq, found): reads (token, seq, ts) of entries put (token, ts): the first after a put, within its life, finds it.

    An entry that is put again is new.
    """
    both = puts.select(key, F.col(ts).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind")).unionByName(gets.select(key, F.col(ts).alias("ts"), F.col("seq").cast("long").alias("seq"), F.lit(1).alias("kind")))
    order = Window.partitionBy(key).orderBy("ts", "kind", "seq")
    put = F.last(F.when(F.col("kind") == 0, F.col("ts")), True).over(order)
    nth = F.sum("kind").over(Window.partitionBy(key, "put").orderBy("ts", "kind", "seq"))
    rows = both.withColumn("put", put).withColumn("nth", nth)
    found = F.col("put").isNotNull() & (F.col("nth") == 1) & (_micros("ts") - _micros("put") < life * 1_000_000)
    return rows.where("kind = 1").select(key, "seq", F.coalesce(found, F.lit(False)).alias("found"))


class TokenBucket(StatefulProcessor):
    """Requests (key, ts, seq) to (key, seq, allowed, tokens); a bucket goes when it has been idle for IDLE seconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (None, None)
        tokens, last = known[0], known[1]
        requests = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for ts, seq in zip(requests["ts"], requests["seq"], strict=True):
            now = ts.timestamp()
            tokens, allowed = step(tokens, last, now)
            last = now
            out.append((key[0], int(seq), allowed, tokens))
        self.state.update((float(tokens), float(last)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((last + IDLE) * 1000))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "tokens"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"key": [], "seq": [], "allowed": [], "tokens": []})

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame) -> DataFrame:
    """The streaming form of ``limited`` on a stream (key, ts, seq); state is dropped by event time."""
    timed = requests.withWatermark("ts", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=TokenBucket(), outputStructType="key string, seq long, allowed boolean, tokens double", outputMode="Append", timeMode="EventTime")


class OneShot(StatefulProcessor):
    """Puts and gets (token, ts, seq, kind: put or get) to (token, seq, found); an entry goes when it is read or LIFE seconds old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", "put double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        put = self.state.get()[0] if self.state.exists() else None
        both = pd.concat(list(rows))
        both = both.assign(late=both["kind"] == "get").sort_values(["ts", "late", "seq"])
        out = []
        for ts, seq, kind in zip(both["ts"], both["seq"], both["kind"], strict=True):
            now = ts.timestamp()
            if kind == "put":
                put = now
            else:
                out.append((key[0], int(seq), put is not None and now - put < LIFE))
                put = None
        for timer in list(self.handle.listTimers()):  # an earlier entry's must not end a later one
            self.handle.deleteTimer(timer)
        if put is None:
            self.state.clear()
        else:
            self.state.update((float(put),))
            self.handle.registerTimer(int((put + LIFE) * 1000))
        yield pd.DataFrame(out, columns=["token", "seq", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"token": [], "seq": [], "found": []})

    def close(self) -> None:
        pass


def read_once_stream(traffic: DataFrame) -> DataFrame:
    timed = traffic.withWatermark("ts", "0 seconds")
    return timed.groupBy("token").transformWithStateInPandas(statefulProcessor=OneShot(), outputStructType="token string, seq long, found boolean", outputMode="Append", timeMode="EventTime")
