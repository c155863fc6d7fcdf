"""X4 batch sessions: same sessions whatever the partitioning, with one
user holding most of the log (sessions then span partition boundaries)."""

import datetime as dt

from cadenza.operators.sessions import sessions


def _rows():
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for i in range(600):            # hot user: gaps of 10 min, a 45 min gap every 50 events
        t0 += dt.timedelta(minutes=45 if i % 50 == 0 and i else 10)
        rows.append((1, t0, eid))
        eid += 1
    for u in range(2, 6):           # small users, one event each or two close ones
        rows.append((u, dt.datetime(2024, 1, 1, 12), eid))
        rows.append((u, dt.datetime(2024, 1, 1, 12, 29), eid + 1))
        eid += 2
    return rows


def _collect(df):
    return sorted((r.user_id, r.session_start, r.session_end, r.n_events) for r in df.collect())


def test_sessions_independent_of_partitioning(spark):
    ev = spark.createDataFrame(_rows(), "user_id long, ts timestamp, event_id long")
    one = _collect(sessions(ev, num_partitions=1))
    for n in (7, 64):
        assert _collect(sessions(ev, num_partitions=n)) == one
    hot = [s for s in one if s[0] == 1]
    assert len(hot) == 12 and all(s[3] == 50 for s in hot)
    assert [s[3] for s in one if s[0] == 2] == [2]
