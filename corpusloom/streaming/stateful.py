"""Jobs, answer streams and rate limits in keyed state: what the batch forms in ``jobs`` give, as rows arrive.

Rows may come late and more than once.  Each key holds its rows until the watermark has passed them and then takes
them in the order of their time and id, so a stream gives exactly what a batch over the same rows gives, as far as the
watermark has come; a row later than the watermark allows is dropped by Spark.  State ends with the rows it needs: a
key keeps its rows ahead of the watermark and one small value.

Every processor needs the RocksDB state store, which ``start`` sets for its own query alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .jobs import parsed_lines, status_of

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends ``stream`` to the Parquet table at ``path`` and ends when all there is has been taken."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_STORE, before)


class InOrder(StatefulProcessor):
    """Holds a key's rows by (time in microseconds, id) and hands those that the watermark has passed to ``step`` in order.

    ``step(own, at, id, row)`` gives the new value and rows to emit, ``wake(own, now)`` the same when the watermark has come
    to ``now`` and all rows before it are taken, ``alarm(own)`` the time that ``wake`` wants to be called at, if any.
    """

    value = "status string, at long"
    held = "row string"

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at long, id long", self.held)
        self.own = handle.getValueState("own", self.value)

    def close(self) -> None:
        pass

    def frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            for at, i, row in pdf[["at", "id", "row"]].itertuples(index=False):
                self.rows.updateValue((int(at), int(i)), (row,))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(k), v[0]) for k, v in self.rows.iterator())
        due = [x for x in held if x[0][0] <= now]
        own, out = (tuple(self.own.get()) if self.own.exists() else None), []
        for (at, i), row in due:
            own, more = self.step(own, at, i, row)
            out += more
            self.rows.removeKey((at, i))
        own, more = self.wake(own, now)
        out += more
        if own is None:
            self.own.clear()
        else:
            self.own.update(own)
        ahead = [k[0] for k, _ in held[len(due) :][:1]]
        alarm = self.alarm(own)
        for at in (*ahead, *([alarm] if alarm is not None and alarm > now else [])):
            self.handle.registerTimer(-(-at // 1000))
        return self.frame([(*key, *x) for x in out])

    def step(self, own, at: int, i: int, row: str):
        raise NotImplementedError

    def wake(self, own, now: int):
        return own, []

    def alarm(self, own) -> int | None:
        return None


HISTORY = "user_id long, event_id long, at long, status string, accepted boolean"


class Jobs(InOrder):
    """A job runs, completes or fails by its events, and fails by itself when it runs and is silent for ``timeout``."""

    columns = ["user_id", "event_id", "at", "status", "accepted"]

    def __init__(self, timeout: int):
        self.timeout = timeout

    def wake(self, own, now):
        if own and own[0] == "running" and now - own[1] > self.timeout:
            at = own[1] + self.timeout
            return ("failed", at), [(None, at, "failed", None)]
        return own, []

    def step(self, own, at, i, row):
        own, out = self.wake(own, at)
        return (row, at), [*out, (i, at, row, own is None or own[0] != "running")]

    def alarm(self, own):
        return own[1] + self.timeout + 1000 if own and own[0] == "running" else None


def _timed(events: DataFrame, late: str, by: str, row) -> DataFrame:
    return events.withWatermark("ts", late).select(by, "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), row.alias("row"))


def _long(seconds: int) -> int:
    return seconds * 1_000_000


def job_history_stream(events: DataFrame, timeout_s: int, late: str = "2 hours") -> DataFrame:
    """user_id, event_id, at (microseconds), status, accepted of each event, and a failed row (no event) for each timeout."""
    return _timed(events, late, "user_id", status_of(F.col("event_type"))).groupBy("user_id").transformWithStateInPandas(Jobs(_long(timeout_s)), HISTORY, "Append", "EventTime")


def job_history(events: DataFrame, timeout_s: int) -> DataFrame:
    """The same of a table, when time has gone on beyond the last timeout."""
    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("at"), status_of(F.col("event_type")).alias("status")).dropDuplicates(["user_id", "at", "event_id"])
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    limit = F.lit(_long(timeout_s))
    before = F.lag(F.struct("status", "at")).over(w)
    rows = rows.withColumns({"_b": before, "_next": F.lead("at").over(w)})
    runs = (F.col("_b.status") == "running") & (F.col("at") - F.col("_b.at") <= limit)
    own = rows.select("user_id", "event_id", "at", "status", (~F.coalesce(runs, F.lit(False))).alias("accepted"))
    silent = rows.where((F.col("status") == "running") & (F.col("_next").isNull() | (F.col("_next") - F.col("at") > limit)))
    return own.unionByName(silent.select("user_id", F.lit(None).cast("long").alias("event_id"), (F.col("at") + limit).alias("at"), F.lit("failed").alias("status"), F.lit(None).cast("boolean").alias("accepted")))


LIMITED = "user_id long, event_id long, at long, allowed boolean"


class Limiter(InOrder):
    """The first ``limit`` rows of a client in each window are let in; the count of a window ends with it."""

    value = "window long, n long"
    columns = ["user_id", "event_id", "at", "allowed"]

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def step(self, own, at, i, row):
        window = at // self.width
        n = own[1] + 1 if own and own[0] == window else 1
        return (window, n), [(i, at, n <= self.limit)]

    def wake(self, own, now):
        return (own, []) if own and own[0] >= now // self.width else (None, [])


def limited_stream(events: DataFrame, limit: int, width_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """user_id, event_id, at, allowed: the batch ``jobs.limited`` as events arrive."""
    return _timed(events, late, "user_id", F.lit("")).groupBy("user_id").transformWithStateInPandas(Limiter(limit, _long(width_s)), LIMITED, "Append", "EventTime")


MESSAGES = "request_id long, seq long, type string, token string"
HEAD = ["status:loading_index", "status:embedding", "status:ranking", "sources", "status:generating"]


class Answers(StatefulProcessor):
    """A request's lines in the order of their numbers: statuses before the first token, tokens as they come, done.

    A line is held until all before it are there; lines behind the one that is done, and repeated ones, are left out.
    """

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "seq long", "token string, done boolean")
        self.own = handle.getValueState("own", "next long, sent long, over boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ahead, sent, over = self.own.get() if self.own.exists() else (0, 0, False)
        if over:
            return
        new: dict[int, tuple] = {}
        for pdf in rows:
            for seq, token, done in pdf[["seq", "token", "done"]].itertuples(index=False):
                if seq >= ahead:
                    new.setdefault(int(seq), (None if pd.isna(token) else token, bool(done)))
        out = []
        while not over:
            if self.rows.containsKey((ahead,)):  # the first that came stands
                got = tuple(self.rows.getValue((ahead,)))
                self.rows.removeKey((ahead,))
                new.pop(ahead, None)
            elif ahead in new:
                got = new.pop(ahead)
            else:
                break
            ahead += 1
            if got[0]:
                out += [(i, t, None) for i, t in enumerate(HEAD)] if not sent else []
                out.append((len(HEAD) + sent, "token", got[0]))
                sent += 1
            over = bool(got[1])
        if over:
            self.rows.clear()
            out += [(len(HEAD) + sent, "done", None)] if sent else []
        for seq, line in ({} if over else new).items():
            if not self.rows.containsKey((seq,)):
                self.rows.updateValue((seq,), line)
        self.own.update((ahead, sent, over))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=["request_id", "seq", "type", "token"])


def answer_stream(lines: DataFrame) -> DataFrame:
    """request_id, seq, type, token: what a client is sent, as the lines (request_id, seq from 0, line) of its answer arrive."""
    return parsed_lines(lines).groupBy("request_id").transformWithStateInPandas(Answers(), MESSAGES, "Append", "None")
