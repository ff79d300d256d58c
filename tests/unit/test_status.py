"""States of documents under ingest: a failing, a late, a repeated and a stuck file, across restarts."""

import datetime
import time

from lectern.streaming import status

AT = datetime.datetime(2024, 1, 1)


def test_states_across_restarts(spark, tmp_path):
    events, out, checkpoint = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/cp"
    told = status.Progress()
    spark.streams.addListener(told)

    def run(*rows):
        made = [(d, e, x, AT + datetime.timedelta(minutes=m)) for d, e, x, m in rows]
        spark.createDataFrame(made, "doc_id string, event string, error string, at timestamp").coalesce(1).write.mode("append").parquet(events)
        status.follow(spark, events, out, checkpoint, stuck_after=3.0).awaitTermination()
        return {r.doc_id: (r.state, r.error, r.attempts) for r in status.current(spark, out).collect()}

    try:
        first = run(("good", "started", None, 0), ("good", "done", None, 1), ("bad", "failed", "no text", 2), ("bad", "started", None, 0), ("lost", "started", None, 0), ("late", "done", None, 5), ("odd", "unheard of", None, 0))
        assert first == {"good": ("completed", None, 1), "bad": ("failed", "no text", 1), "lost": ("processing", None, 1), "late": ("completed", None, 0)}
        time.sleep(4)
        # the late start changes nothing, repeated events change nothing, a file that comes again is processed again; the timer outlived the query
        second = run(("late", "started", None, 4), ("good", "done", None, 1), ("bad", "started", None, 7), ("bad", "done", None, 8))
        assert second == {"good": ("completed", None, 1), "bad": ("completed", None, 2), "lost": ("stuck", None, 1), "late": ("completed", None, 0)}
        third = run(("lost", "done", None, 9))
        assert third["lost"] == ("completed", None, 1)
        assert {r.state: r.n for r in status.counts(status.current(spark, out)).collect()} == {"completed": 4}
        deadline = time.time() + 20
        while sum(r[2] for r in told.reports) < 12 and time.time() < deadline:
            time.sleep(0.2)
        assert sum(r[2] for r in told.reports) == 12 and set(told.ended.values()) == {None}
    finally:
        spark.streams.removeListener(told)
        spark.conf.unset(status.STORE[0])
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
