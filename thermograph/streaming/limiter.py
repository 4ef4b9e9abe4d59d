"""Attempt limiter and job-state folding, as streams and as batches."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from thermograph.session import cut_lineage

# Window seconds; logins per address, logins per address and
# user, other actions per address.
WINDOW_S, LOGIN_ADDRESS, LOGIN_USER, OTHER_ADDRESS = 300.0, 30, 5, 10
OUTPUT = "event_id bigint, action string, address string, username string, ts double, allowed boolean, retry_after int"


class Limits:
    def __init__(self, window: float = WINDOW_S, login_address: int = LOGIN_ADDRESS, login_user: int = LOGIN_USER, other: int = OTHER_ADDRESS):
        self.window, self.login_address, self.login_user, self.other = window, login_address, login_user, other


def _step(counters: dict, keys: list[tuple], now: float, window: float) -> tuple[bool, int]:
    """Charge all keys or none; ``counters`` maps key -> (count, expiry).

    The wait is that of the first full limit in the order of ``keys``.
    """
    for key, limit in keys:
        count, expires = counters.get(key, (0, 0.0))
        if expires > now and count >= limit:
            return False, max(1, int(expires - now + 1))
    for key, _ in keys:
        count, expires = counters.get(key, (0, 0.0))
        counters[key] = (count + 1, expires) if expires > now else (1, now + window)
    return True, 0


def _keys(action: str, user: str, limits: Limits) -> list[tuple]:
    if action == "login":
        return [(("a",), limits.login_address), (("u", user), limits.login_user)]
    return [(("a",), limits.other)]


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def attempt_input(events: DataFrame) -> DataFrame:
    """Conform to event_id, action, address, username, ts (epoch seconds)."""
    return events.select("event_id", "action", F.col("address").cast("string").alias("address"), F.col("username").cast("string").alias("username"), _seconds(F.col("ts")).alias("ts"))


KEY = ["action", "address"]


def _last_mark(e: DataFrame, mark: Column, name: str) -> DataFrame:
    """Adds the latest mark up to each row of its (action, address), by tiles and one small row per tile."""
    inside = W.partitionBy(*KEY, "_tile").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("_mark", mark)
    tiles = e.groupBy(*KEY, "_tile").agg(F.max("_mark").alias("_m"))
    tiles = tiles.select(*KEY, "_tile", F.max("_m").over(W.partitionBy(*KEY).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)).alias("_open"))
    out = e.withColumn("_own", F.max("_mark").over(inside)).join(tiles, [*KEY, "_tile"])
    return out.withColumn(name, F.coalesce("_own", "_open")).drop("_mark", "_own", "_open")


def _first_from(at: DataFrame, wait: float) -> DataFrame:
    """Of every time of (action, address, ts): the first time that is ``wait`` later or more, as ``next``; none where there is none."""
    tile = F.floor(F.col("at") / (wait * 16))
    rows = at.select(*KEY, (F.col("ts") + wait).alias("at"), F.col("ts").alias("ask")).unionByName(at.select(*KEY, F.col("ts").alias("at"), F.lit(None).cast("double").alias("ask"))).withColumn("_t", tile)
    time = F.when(F.col("ask").isNull(), F.col("at"))
    tiles = rows.groupBy(*KEY, "_t").agg(F.min(time).alias("_m"))
    tiles = tiles.select(*KEY, "_t", F.min("_m").over(W.partitionBy(*KEY).orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    # Backwards in time, as a frame that only loses rows is evaluated anew for each of them. Of equal times the asking row comes last.
    ahead = W.partitionBy(*KEY, "_t").orderBy(F.desc("at"), F.col("ask").isNull().desc()).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_n", F.min(time).over(ahead)).filter("ask IS NOT NULL").join(tiles, [*KEY, "_t"])
    return out.select(*KEY, F.col("ask").alias("ts"), F.coalesce("_n", "_later").alias("next")).filter("next IS NOT NULL")


def window_starts(times: DataFrame, heads: DataFrame, wait: float) -> DataFrame:
    """(action, address, ts) at which a window begins: the heads, and on from each start the first time that is ``wait`` later.

    The pointers double each round, so rounds grow with the logarithm of the
    windows in an uninterrupted run.
    """
    jump = cut_lineage(_first_from(times, wait))
    starts = cut_lineage(heads.select(*KEY, "ts").distinct())
    while True:
        more = starts.join(jump, [*KEY, "ts"]).select(*KEY, F.col("next").alias("ts")).distinct().join(starts, [*KEY, "ts"], "left_anti")
        more = cut_lineage(more)
        if more.isEmpty():
            return starts
        starts = cut_lineage(starts.unionByName(more))
        far = jump.select(*KEY, F.col("ts").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(far, [*KEY, "next"]).select(*KEY, "ts", F.col("far").alias("next")))


def limit_attempts(events: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Batch form over (action, address), ordered by time and event id.

    Windows last a fixed time from their first counted attempt, so a pause of
    a whole window clears every counter and splits an address into independent
    runs. Where one limit holds (all actions but login), the next window starts
    at the first attempt after the last one has passed: starts are found by
    pointer doubling, and each window admits its first attempts. Logins have
    two limits that depend on each other: runs too short to reach either are
    all admitted, and only the others are walked, in batches and with a handful
    of counters. Event ids are unique within an address and time.
    """
    lim = limits or Limits()
    # The cut search works in coarse time tiles, so a busy address needs no
    # single-task sort: a tile boundary is a cut when the gap across it is.
    e = attempt_input(events).withColumn("_tile", F.floor(F.col("ts") / (lim.window * 64)))
    inside = W.partitionBy(*KEY, "_tile").orderBy("ts", "event_id")
    tiles = e.groupBy(*KEY, "_tile").agg(F.max("ts").alias("_last"))
    tiles = tiles.select(*KEY, "_tile", F.max("_last").over(W.partitionBy(*KEY).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    e = e.withColumn("_prev", F.lag("ts").over(inside)).join(tiles, [*KEY, "_tile"])
    prev = F.coalesce("_prev", "_before")
    e = e.withColumn("_cut", F.when(prev.isNull() | (F.col("ts") - prev >= lim.window), F.col("ts"))).drop("_prev", "_before")
    e = cut_lineage(_last_mark(e, F.col("_cut"), "_run"))
    login = F.col("action") == "login"
    return _one_limit(e.filter(~login), lim).unionByName(_two_limits(e.filter(login), lim))


def _one_limit(e: DataFrame, lim: Limits) -> DataFrame:
    starts = window_starts(e.select(*KEY, "ts").distinct(), e.filter("_cut IS NOT NULL"), lim.window)
    e = e.join(starts.withColumn("_starts", F.col("ts")), [*KEY, "ts"], "left")
    e = cut_lineage(_last_mark(e, F.col("_starts"), "_start"))
    order = W.partitionBy(*KEY, "_start").orderBy("ts", "event_id")
    last = e.select(*KEY, "_start", "ts", "event_id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= lim.other)
    last = last.groupBy(*KEY, "_start").agg(F.max(F.struct("ts", "event_id")).alias("_last"))
    out = e.join(last, [*KEY, "_start"]).withColumn("allowed", F.struct("ts", "event_id") <= F.col("_last"))
    wait = F.greatest(F.lit(1), F.floor(F.col("_start") + lim.window - F.col("ts") + 1).cast("int"))
    return out.select("event_id", *KEY, "username", "ts", "allowed", F.when(F.col("allowed"), F.lit(0)).otherwise(wait).alias("retry_after"))


def _two_limits(e: DataFrame, lim: Limits) -> DataFrame:
    run = [*KEY, "_run"]
    users = e.groupBy(*run, "username").agg(F.count(F.lit(1)).alias("n"))
    full = users.groupBy(*run).agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter((F.col("n") > lim.login_address) | (F.col("most") > lim.login_user)).select(*run)
    # sorted partitions let one pass over the batches follow each run
    runs = e.join(full, run, "left_semi").select("event_id", *KEY, "username", "ts", "_run").repartition(*run).sortWithinPartitions(*run, "ts", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counters = None, {}
        for pdf in batches:
            allowed, retry = [], []
            for action, address, user, ts, run in zip(pdf.action, pdf.address, pdf.username, pdf.ts, pdf._run):
                if (action, address, run) != current:
                    current, counters = (action, address, run), {}
                ok, wait = _step(counters, _keys(action, user, lim), ts, lim.window)
                allowed.append(ok)
                retry.append(wait)
            yield pdf.drop(columns="_run").assign(allowed=allowed, retry_after=retry)[["event_id", "action", "address", "username", "ts", "allowed", "retry_after"]]

    free = e.join(full, run, "left_anti").select("event_id", *KEY, "username", "ts", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    return runs.mapInPandas(walk, OUTPUT).unionByName(free)


class AttemptLimiter(StatefulProcessor):
    """Stream form: one address counter and a map of user counters per key."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.address = handle.getValueState("address", "count int, expires double")
        self.users = handle.getMapState("users", "username string", "count int, expires double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        counters = {}
        if self.address.exists():
            counters[("a",)] = tuple(self.address.get())
        for user in batch.username.unique():
            if self.users.containsKey((user,)):
                counters[("u", user)] = tuple(self.users.getValue((user,)))
        out = [_step(counters, _keys(a, u, self.limits), t, self.limits.window) for a, u, t in zip(batch.action, batch.username, batch.ts)]
        for k, (count, expires) in counters.items():
            if k == ("a",):
                self.address.update((int(count), float(expires)))
            else:
                self.users.updateValue((k[1],), (int(count), float(expires)))
        # expired counters go when the newest event has passed them
        newest = float(batch.ts.max())
        for user, (count, expires) in [(u[0], tuple(v)) for u, v in self.users.iterator()]:
            if expires <= newest:
                self.users.removeKey((user,))
        batch["allowed"] = [o[0] for o in out]
        batch["retry_after"] = [o[1] for o in out]
        yield batch[["event_id", "action", "address", "username", "ts", "allowed", "retry_after"]]

    def close(self) -> None:
        pass


def limit_attempts_stream(events: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Streaming limiter; needs the RocksDB state store provider."""
    return attempt_input(events).groupBy("action", "address").transformWithStateInPandas(
        statefulProcessor=AttemptLimiter(limits), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def job_state_fold(created: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Latest value of each field per created job; unknown jobs are ignored.

    A null field leaves the earlier value. ``updates``: job_id, ts, pos and
    the fields.
    """
    order = F.struct("ts", "pos")
    u = updates.groupBy("job_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_u_{f}") for f in fields])
    j = created.join(u, "job_id", "left")
    return j.select(*[c for c in created.columns if c not in fields], *[F.coalesce(F.col(f"_u_{f}"), F.col(f)) .alias(f) if f in created.columns else F.col(f"_u_{f}").alias(f) for f in fields])


def job_state_stream(updates: DataFrame, fields: list[str]) -> DataFrame:
    """Running latest value of each field per job, in update mode."""
    order = F.struct("ts", "pos")
    return updates.groupBy("job_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])
