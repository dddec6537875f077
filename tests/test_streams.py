import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog.streams import approval_states_by_event_time
from girder.streaming import entries, sinks, snapshots

SCHEMA = "event_id long, ts timestamp, record_id long, requested string, amount_kpy long"


def at(minute, day=1):
    return dt.datetime(2024, 1, day, 0, 0) + dt.timedelta(minutes=minute)


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return entries.read_files(spark, f"{folder}/*", schema)


def test_repeats_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, [(1, at(0), 1, "x", 5), (1, at(1), 1, "x", 5), (2, at(2), 1, "x", 7)], folder, "a")
    stream = entries.unique_entries(source(spark, folder), "event_id", "ts")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    sinks.run_append(stream, out, progress)
    write(spark, [(2, at(3), 1, "x", 7), (3, at(4), 1, "x", 9)], folder, "b")
    sinks.run_append(entries.unique_entries(source(spark, folder), "event_id", "ts"), out, progress)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        w = entries.sensor_windows(source(spark, folder), "ts", "amount_kpy", "record_id", "10 minutes")
        sinks.run_append(w, out, progress)

    write(spark, [(1, at(1), 1, "x", 5), (2, at(60), 1, "x", 7)], folder, "a")
    run()
    write(spark, [(3, at(2), 1, "x", 100), (4, at(55), 1, "x", 1), (5, at(120), 1, "x", 0)], folder, "b")
    run()
    got = {r.window_start.minute + 60 * r.window_start.hour: r.total for r in spark.read.parquet(out).collect()}
    assert got == {0: 5, 50: 1, 60: 7}


def test_states_survive_between_batches(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        requests = source(spark, folder).select("record_id", "event_id", "ts", "requested")
        sinks.run_append(entries.approval_states(requests), out, progress)

    write(spark, [(1, at(0), 1, "現場入力", 0), (2, at(1), 1, "確定", 0), (3, at(2), 2, "承認", 0)], folder, "a")
    run()
    write(spark, [(5, at(9), 1, "確定", 0), (4, at(5), 1, "承認", 0)], folder, "b")
    run()
    got = {r.event_id: (r.state, r.is_legal) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("現場入力", True), 2: ("現場入力", False), 3: (None, False), 4: ("承認", True), 5: ("確定", True)}


def test_states_do_not_depend_on_arrow_batches(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    write(spark, [(3, at(9), 1, "確定", 0), (2, at(5), 1, "承認", 0), (1, at(0), 1, "現場入力", 0)], folder, "a")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        requests = source(spark, folder).select("record_id", "event_id", "ts", "requested")
        sinks.run_append(entries.approval_states(requests), out, progress)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.event_id: (r.state, r.is_legal) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("現場入力", True), 2: ("承認", True), 3: ("確定", True)}


def test_change_table_holds_the_latest_total(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    projects = spark.createDataFrame([(1, 100, 80.0)], "project_id long, contract_amount_kpy long, target_cost_rate double")

    def run():
        totals = entries.total_costs(source(spark, folder).withColumnRenamed("record_id", "project_id"))
        sinks.run_changes(totals, out, progress, shape=lambda b: entries.overrun_alerts(b, projects))

    write(spark, [(1, at(0), 1, "x", 78), (2, at(0), 9, "x", 1)], folder, "a")
    run()
    write(spark, [(3, at(1), 1, "x", 8)], folder, "b")
    run()
    changes = spark.read.parquet(out)
    assert changes.count() == 2
    assert [(r.total_cost_kpy, r.alert_level) for r in sinks.latest(changes, ["project_id"]).collect()] == [(86, "緊急")]


REQUESTS = [
    (1, at(0), 1, "現場入力"), (2, at(9), 1, "確定"), (3, at(5), 1, "承認"), (4, at(5), 2, "承認"), (5, at(5), 2, "現場入力"),
    (6, at(12), 1, "確定"), (7, at(14), 2, "承認"), (8, at(12), 2, "承認"), (9, at(30), 3, "現場入力"), (10, at(100), 9, "承認"),
]


def judged(rows):
    """Every record's requests in time order, but those that the watermark has not passed."""
    passed = max(r[1] for r in rows) - dt.timedelta(minutes=60)
    current, out = {}, {}
    for event, ts, record, requested in sorted(rows, key=lambda r: (r[1], r[0])):
        legal = entries.NEXT_STATE.get(current.get(record)) == requested
        if legal:
            current[record] = requested
        if ts < passed:
            out[event] = (current.get(record), legal)
    return out


@pytest.mark.parametrize("batches", [[range(10)], [[i] for i in range(10)], [[5, 1], [8, 2, 0], [3, 4, 7, 6], [9]], [[7, 6, 5, 4, 3, 2, 1, 0, 8], [9]]])
def test_approvals_do_not_depend_on_batches(spark, tmp_path, batches):
    """Requests that come late, or all at once, are judged in the order of their time."""
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i, batch in enumerate(batches):
        write(spark, [(*REQUESTS[k], 0) for k in batch], folder, f"f{i}")
        requests = source(spark, folder).select("record_id", "event_id", "ts", "requested")
        sinks.run_append(entries.approvals_in_order(requests, "60 minutes"), out, progress)
    got = {r.event_id: (r.state, r.is_legal) for r in spark.read.parquet(out).collect()}
    assert got == judged(REQUESTS)
    assert got[2] == ("確定", True) and got[6] == ("確定", False) and 10 not in got


def test_event_time_approvals_run_in_a_session_with_sparks_own_state_store(spark, sf):
    """The session's store keeps one kind of state per key; the query brings the one it needs and puts the setting back."""
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(sinks.STATE_STORE)
    spark.conf.set(sinks.STATE_STORE, own)
    try:
        assert approval_states_by_event_time(spark, sf).count() > 0
        assert spark.conf.get(sinks.STATE_STORE) == own
    finally:
        spark.conf.set(sinks.STATE_STORE, before)


VERSIONS = "project_id long, contract_amount_kpy long, target_cost_rate double, changed_at timestamp"


def test_alerts_follow_changed_projects(spark, tmp_path):
    """A new target or contract changes the tier without a cost entry, and the order of arrival does not matter."""
    costs, projects, out, progress = (str(tmp_path / n) for n in ("costs", "projects", "out", "progress"))
    table = snapshots.SnapshotTable(spark, out, ["project_id"], buckets=2)

    def run(entered=(), changed=()):
        for rows, schema, folder in ((entered, SCHEMA, costs), (changed, VERSIONS, projects)):
            spark.createDataFrame(list(rows), schema).write.mode("append").parquet(f"{folder}/a")
        versions = entries.read_files(spark, f"{projects}/*", spark.createDataFrame([], VERSIONS).schema)
        totals = entries.overrun_totals(source(spark, costs).withColumnRenamed("record_id", "project_id"), versions)
        snapshots.run_merges(totals, table, progress, shape=entries.rated_overruns)
        return {r.project_id: (r.total_cost_kpy, r.alert_level) for r in table.read().collect()}

    assert run([(1, at(0), 1, "x", 78)], [(1, 100, 80.0, at(0))]) == {1: (78, "注意")}
    assert run(changed=[(1, 100, 75.0, at(1))]) == {1: (78, "警告")}
    assert run(changed=[(1, 200, 75.0, at(2))]) == {1: (78, None)}
    assert run(changed=[(1, 50, 10.0, at(1, day=1))])[1] == (78, None)  # an older version that comes late
    assert run([(2, at(9), 1, "x", 90), (3, at(9), 2, "x", 5)]) == {1: (168, "緊急"), 2: (5, None)}
    assert run(changed=[(2, 0, 80.0, at(0)), (3, 10, 80.0, at(0))]) == {1: (168, "緊急"), 2: (5, None), 3: (0, None)}


def numbered(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, at long")


def test_snapshot_merges_by_key(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert table.read().collect() == [] and table.version() is None
    want = {}
    for batch in range(5):
        rows = [(k, f"{batch}", batch) for k in range(batch, 20, batch + 1)] + ([(None, "none", batch)] if batch == 2 else [])
        want |= {k: v for k, v, _ in rows}
        assert table.merge(numbered(spark, rows), batch).number == batch + 1
        assert {r.k: r.v for r in table.read().collect()} == want
    # A batch that runs again changes nothing, whatever it brings.
    assert table.merge(numbered(spark, [(1, "again", 9)]), 4).number == 5
    assert {r.k: r.v for r in table.read().collect()} == want
    assert {r.k for r in table.read(1).collect()} == set(range(20))


def test_snapshot_takes_the_newest_of_a_key(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    table.merge(numbered(spark, [(1, "b", 5), (1, "a", 2), (2, None, 1)]), 0, newest=F.col("at"))
    table.merge(numbered(spark, [(1, "late", 4), (2, "c", 1)]), 1, newest=F.col("at"))
    assert {r.k: r.v for r in table.read().collect()} == {1: "b", 2: "c"}
    table.merge(numbered(spark, []), 2)
    assert table.version().number == 3 and table.read().count() == 2


def test_a_reader_keeps_its_version(spark, tmp_path):
    """A frame read before merges and expiry sees the version it was made from, or is told; never a mixture."""
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=3)
    table.merge(numbered(spark, [(k, "old", 0) for k in range(50)]), 0)
    before = table.read()
    table.merge(numbered(spark, [(k, "new", 1) for k in range(0, 50, 2)]), 1)
    table.expire(keep=2)
    assert {r.v for r in before.collect()} == {"old"} and before.count() == 50
    assert table.read().groupBy("v").count().orderBy("v").collect() == [("new", 25), ("old", 25)]
    table.merge(numbered(spark, [(99, "more", 2)]), 2)
    table.expire(keep=1)
    assert table.versions() == [3] and table.read().count() == 51
    named = {f.split("/")[1] for f in table.version().folders.values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == named


def test_a_failed_merge_leaves_no_trace(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    table.merge(numbered(spark, [(1, "a", 0)]), 0)
    publish = table._publish
    table._publish = lambda version: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        table.merge(numbered(spark, [(1, "b", 1)]), 1)
    table._publish = publish
    assert [r.v for r in table.read().collect()] == ["a"]
    table.merge(numbered(spark, [(1, "b", 1)]), 1)
    assert [r.v for r in table.read().collect()] == ["b"]
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(table.version())
    table.expire(keep=1)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_running_costs_equal_the_batch_result(spark, tmp_path, sf):
    from catalog import streams

    streamed = streams.streamed_running_costs(spark, sf)
    from girder.sources import standins as src

    batch = src.cost_records(spark, sf, ("project_id", "category", "amount_kpy")).groupBy("project_id", "category").agg(
        F.sum("amount_kpy").alias("amount_kpy"), F.count("*").alias("entries")
    )
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()
