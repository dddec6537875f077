"""Field cost entries, running costs, sensor windows, approval states and overrun alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from girder.functions.exprs import safe_div
from girder.plans.operations import cost_alert_tier


def read_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    name: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream, optionally only those matching ``name``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def unique_entries(entries: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Entries without repeats of a key that arrive within ``delay`` of each other."""
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def running_costs(entries: DataFrame) -> DataFrame:
    """Cost so far per project and category; update mode sends only what changed."""
    return entries.groupBy("project_id", "category").agg(
        F.sum("amount_kpy").alias("amount_kpy"), F.count("*").alias("entries")
    )


def sensor_windows(
    readings: DataFrame,
    time: str,
    value: str,
    by: str,
    size: str,
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Count, sum and extremes per sensor and time window, tumbling or sliding.

    A window is final when the watermark passes its end; later rows are dropped.
    """
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        readings.withWatermark(time, delay)
        .groupBy(span.alias("w"), by)
        .agg(
            F.count("*").alias("readings"),
            F.sum(value).alias("total"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "readings", "total", "lowest", "highest")
    )


# The way of a foreseen cost entry to a booked one.
NEXT_STATE = {None: "現場入力", "現場入力": "承認", "承認": "確定"}

TRANSITIONS = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("requested", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("is_legal", T.BooleanType()),
    ]
)


def approval_states(requests: DataFrame) -> DataFrame:
    """Each request with the entry's state after it and whether it was allowed.

    ``requests`` has record_id, event_id, ts and requested. A request for
    anything but the next state is reported and leaves the state as it is. All
    rows of a record in a micro-batch are put in time order together; bound the
    micro-batch by files or bytes per trigger where one record has very many.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        # The rows come in Arrow batches of any size, in no order.
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        states, legal = [], []
        for wanted in rows["requested"]:
            allowed = NEXT_STATE.get(current) == wanted
            current = wanted if allowed else current
            states.append(current)
            legal.append(allowed)
        yield pd.DataFrame(
            {
                "record_id": key[0],
                "event_id": rows["event_id"].to_numpy(),
                "requested": rows["requested"].to_numpy(),
                "state": states,
                "is_legal": legal,
            }
        )
        if current is not None:
            state.update((current,))

    return requests.groupBy("record_id").applyInPandasWithState(
        step,
        outputStructType=TRANSITIONS,
        stateStructType="state string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


class _OrderedApprovals(StatefulProcessor):
    """Requests of one record wait until the watermark has passed them and are then judged by time.

    State of a record: where it stands, the requests that still wait, and the
    time its timer is set to. What has been judged is not kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "state string")
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, requested string")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, at: int) -> None:
        """The record's one timer, moved forward or back."""
        if self.timer.exists():
            before = self.timer.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = self.timer.get()[0] if self.timer.exists() else None
        for part in rows:  # Arrow batches; each goes to the state store as it comes
            if not len(part):
                continue
            times = pd.to_datetime(part["ts"])
            at = [t.to_pydatetime() for t in times]
            self.waiting.appendList(list(zip(at, part["event_id"].tolist(), part["requested"].tolist(), strict=True)))
            least = int(times.min().timestamp() * 1000)
            first = least if first is None else min(first, least)
        if first is not None:
            self._set_timer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for ts, event_id, requested in self.waiting.get():
            at = int(ts.timestamp() * 1000)
            (due if at < passed else later).append((ts, event_id, requested))
        self.timer.clear()
        if later:
            self.waiting.put(later)
            # A request at the watermark itself waits for the next one.
            self._set_timer(max(min(int(ts.timestamp() * 1000) for ts, _, _ in later), passed + 1))
        else:
            self.waiting.clear()
        current = self.current.get()[0] if self.current.exists() else None
        out = []
        for _, event_id, requested in sorted(due, key=lambda r: r[:2]):
            allowed = NEXT_STATE.get(current) == requested
            current = requested if allowed else current
            out.append((key[0], event_id, requested, current, allowed))
        if current is not None:
            self.current.update((current,))
        if out:
            yield pd.DataFrame(out, columns=TRANSITIONS.names)

    def close(self) -> None:
        pass


def approvals_in_order(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each request with the entry's state after it, in the order of event time whatever the batches.

    As :func:`approval_states`, but a request is judged only when the watermark,
    ``delay`` behind the latest one seen, has passed it: one that comes late by
    less than that still takes its place, a later one is dropped. The state
    store holds where each record stands and its requests of the last
    ``delay``, not its history. Ties of time go by event_id. ``ts`` is a
    timestamp; requests without record_id or ts do nothing. Start it inside
    :func:`girder.streaming.sinks.state_in_rocksdb`.
    """
    timed = requests.filter("record_id is not null and ts is not null").withWatermark("ts", delay)
    return timed.groupBy("record_id").transformWithStateInPandas(
        statefulProcessor=_OrderedApprovals(), outputStructType=TRANSITIONS, outputMode="append", timeMode="eventTime"
    )


def overrun_totals(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """Cost so far with the newest contract and target of every project, from two streams.

    ``entries`` has project_id and amount_kpy; ``projects`` is a stream of
    versions: project_id, contract_amount_kpy, target_cost_rate and changed_at.
    Both are stacked and grouped once: state of a project is one sum and its
    newest version, so a changed target reaches the alert without a new cost
    entry, and no batch reads the project table. Versions of one time go by the
    larger contract, then target.
    """
    version = F.struct("changed_at", "contract_amount_kpy", "target_cost_rate")
    rows = entries.select("project_id", "amount_kpy").unionByName(
        projects.select("project_id", version.alias("version")), allowMissingColumns=True
    )
    sums = rows.groupBy("project_id").agg(
        F.coalesce(F.sum("amount_kpy"), F.lit(0)).alias("total_cost_kpy"), F.max("version").alias("version")
    )
    return sums.select("project_id", "total_cost_kpy", "version.contract_amount_kpy", "version.target_cost_rate")


def rated_overruns(totals: DataFrame) -> DataFrame:
    """Alert tier of rows that carry their contract and target; a project without either has none."""
    rated = totals.withColumn("cost_rate", safe_div("total_cost_kpy", "contract_amount_kpy") * 100)
    return rated.select(
        "project_id", "total_cost_kpy", "target_cost_rate", "cost_rate",
        cost_alert_tier("cost_rate", "target_cost_rate", F.lit(None)).alias("alert_level"),
    )


def total_costs(entries: DataFrame) -> DataFrame:
    return entries.groupBy("project_id").agg(F.sum("amount_kpy").alias("total_cost_kpy"))


def overrun_alerts(totals: DataFrame, projects: DataFrame) -> DataFrame:
    """Alert tier of the projects whose cost total changed, against the project table."""
    rate = safe_div("total_cost_kpy", "contract_amount_kpy") * 100
    return (
        totals.join(projects.select("project_id", "contract_amount_kpy", "target_cost_rate"), "project_id")
        .withColumn("cost_rate", rate)
        .select(
            "project_id",
            "total_cost_kpy",
            "cost_rate",
            cost_alert_tier("cost_rate", "target_cost_rate", F.lit(None)).alias("alert_level"),
        )
    )
