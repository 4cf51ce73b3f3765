"""Streaming runs over event files that end when all files are read: keyed state with timers, and joins of two streams.

Each function takes streams and gives a stream; ``finish`` runs one to the end of
its input and reads what it wrote. State, progress and output lie in the shared
folder, so a run that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.plans.scratch import new_path, stored

VISITS = "user_id long, start long, last long, n long, total double"


def stream_of(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream over the Parquet files at ``path``, at most ``files`` of them in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def in_order(events: DataFrame, parts: int, by: str = "ts") -> str:
    """``events`` cut into ``parts`` stretches of ``by`` that arrive one after another, as files of one folder; the folder."""
    spark = events.sparkSession
    dated = events.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id())
    held = stored(dated, "event-parts")
    path = new_path(spark, "event-files")
    for i in range(parts):
        held.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def finish(stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` until its input ends, and read the rows that it wrote."""
    spark = stream.sparkSession
    out, progress = new_path(spark, name), new_path(spark, f"{name}-progress")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Groups of users that share a state and a timer.
GROUPS = 256


class Visits(StatefulProcessor):
    """Visits of the users of a group: a visit ends ``gap`` seconds after its last event, told by a timer on event time.

    State is one open visit for each user, whatever the number of events. Events of a
    batch come in any order, so they are ordered first; a visit that they close is
    given out at once, one that stays open when the group's timer has passed its end.
    A group's users are taken together, for each call and each timer costs a message
    between Python and Spark.
    """

    gap = 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "known boolean, user_id long, start long, last long, n long, total double")

    def _held(self):
        import pandas as pd

        kinds = {"known": bool, "user_id": "int64", "start": "int64", "last": "int64", "n": "int64", "total": float}
        return pd.DataFrame([tuple(r) for r in self.open.get()] if self.open.exists() else [], columns=list(kinds)).astype(kinds)

    def _keep(self, visits) -> None:
        if not len(visits):
            return self.open.clear()
        self.open.put(list(visits.itertuples(index=False, name=None)))
        self.handle.registerTimer(int(visits["last"].min()) // 1000 + self.gap * 1000)

    def _given(self, visits):
        made = visits[["user_id", "start", "last", "n", "total"]].astype({"user_id": "Int64"})
        made["user_id"] = made["user_id"].where(visits["known"])
        return made

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        import numpy as np
        import pandas as pd

        found = pd.concat(list(rows))
        events = pd.DataFrame({"known": found["known"], "user_id": found["user_id"], "start": found["t"], "last": found["t"], "n": 1, "total": found["value"].astype(float), "event_id": found["event_id"], "event": True})
        every = pd.concat([self._held().assign(event_id=0, event=False), events]).sort_values(["known", "user_id", "event", "start", "event_id"], ignore_index=True)
        user, known, start, last = (every[c].to_numpy() for c in ("user_id", "known", "start", "last"))
        other = np.append(True, (user[1:] != user[:-1]) | (known[1:] != known[:-1]))
        firsts = np.flatnonzero(other | np.append(True, start[1:] - last[:-1] >= self.gap * 1_000_000))
        ends = np.append(firsts[1:], len(every)) - 1
        of = np.repeat(np.arange(len(firsts)), ends - firsts + 1)
        # Added in order, an open visit's total first.
        sums = {"n": np.add.reduceat(every["n"].to_numpy(), firsts), "total": np.bincount(of, weights=every["total"].to_numpy())}
        visits = pd.DataFrame({"known": known[firsts], "user_id": user[firsts], "start": start[firsts], "last": last[ends], **sums})
        stays = np.append(other, True)[ends + 1]
        self._keep(visits[stays])
        if not stays.all():
            yield self._given(visits[~stays])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:
        visits = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = (visits["last"] // 1000 + self.gap * 1000 <= now).to_numpy(bool)
        if over.any():
            self._keep(visits[~over])
            yield self._given(visits[over])

    def close(self) -> None:
        pass


def visits(events: DataFrame, gap: int = 3600, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(user_id, start, last, n, total) of visits that are over when the stream ends; times are microseconds.

    Needs a state store that keeps timers: ``rocks_state`` sets it.
    """
    made = type("Visits", (Visits,), {"gap": gap})
    user = F.col("user_id")
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group")
    timed = events.select(group, user.isNotNull().alias("known"), F.coalesce(user, F.lit(0)).cast("long").alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    keyed = timed.withWatermark("ts", late).groupBy("group")
    return keyed.transformWithStateInPandas(made(), VISITS, outputMode="Append", timeMode="EventTime")


def rocks_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tags_near(stats: DataFrame, tags: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(stat_id, tag_id, user_id) of statistics and tags of one user whose times are at most ``within`` apart; rows later than ``late`` are dropped.

    The watermarks of both streams and the bound on times let Spark drop rows that
    can meet no more, so the state holds a span of time and not the stream.
    """
    s = stats.select(F.col("event_id").alias("stat_id"), "user_id", F.col("ts").cast("timestamp").alias("s_ts")).withWatermark("s_ts", late)
    t = tags.select(F.col("event_id").alias("tag_id"), F.col("user_id").alias("t_user"), F.col("ts").cast("timestamp").alias("t_ts")).withWatermark("t_ts", late)
    near = F.expr(f"user_id = t_user AND t_ts BETWEEN s_ts - INTERVAL {within} AND s_ts + INTERVAL {within}")
    return s.join(t, near).select("stat_id", "tag_id", "user_id")
