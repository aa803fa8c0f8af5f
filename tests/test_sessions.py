import random
from datetime import datetime, timedelta, timezone

import pytest

from attesta.operators.sessions import chunked, session_bounds, sessionize

SCHEMA = "id long, at_ts timestamp, tool string, session string, duration_ms int, key string, chunk string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(rows, gap=1800):
    calls = {}
    for id_, at, tool, session, ms, *_ in rows:
        name = (session or "").strip().lower()
        if name and at is not None:
            end = int((at - T0).total_seconds() * 1_000_000 + 0.5)
            calls.setdefault(name, {})[id_] = (end - max(ms or 0, 0) * 1000, end, tool or "")
    out = set()
    for name, own in calls.items():
        order = sorted((s, i, e, t) for i, (s, e, t) in own.items())
        stretch, reach = [], None
        for call in order:
            if reach is not None and call[0] > reach + gap * 1_000_000:
                out.add(close(name, stretch))
                stretch = []
            reach = call[2] if reach is None else max(reach, call[2])
            stretch.append(call)
        out.add(close(name, stretch))
    return out


def close(name, stretch):
    tools = {}
    for *_, t in stretch:
        tools[t] = tools.get(t, 0) + 1
    listed = ",".join(sorted(f"{t}={n}" for t, n in tools.items()))
    return name, min((s, i) for s, i, _, _ in stretch)[1], max((e, i) for _, i, e, _ in stretch)[1], len(stretch), listed


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        session = rnd.choice(["a", "A ", "\tb", "hot", "hot", "hot", None, "  ", "c\n"])
        at = T0 + timedelta(seconds=rnd.choice([0, 1800, 3600, rnd.randrange(400_000)]))
        rows.append((i, at, rnd.choice(["ask", "tell", None]), session, rnd.choice([None, -5, 0, 1500, 1_800_000, 90_000_000]), "x", "y"))
    rows += rows[:40]  # delivered twice
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = {(r.session, r.first_id, r.last_id, r.calls, r.tools) for r in sessionize(df, chunk_seconds=7200).collect()}
    assert got == want
    assert {tuple(r) for r in session_bounds(df, chunk_seconds=3600).collect()} == {w[:3] for w in want}
    assert {tuple(r) for r in session_bounds(df, chunk_seconds=200_000, dense=7).collect()} == {w[:3] for w in want}


def test_gap_of_exactly_the_limit_does_not_split(spark):
    rows = [(1, T0, "t", "s", 0, "", ""), (2, T0 + timedelta(seconds=1800), "t", "s", 0, "", ""), (3, T0 + timedelta(seconds=3600, microseconds=1), "t", "s", 0, "", "")]
    got = sorted(tuple(r) for r in session_bounds(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("s", 1, 2), ("s", 3, 3)]


def test_a_long_call_bridges_chunks(spark):
    rows = [(1, T0 + timedelta(hours=40), "t", "s", 40 * 3_600_000, "", ""), (2, T0 + timedelta(hours=20), "t", "s", 0, "", ""), (3, T0 + timedelta(hours=41), "t", "s", 0, "", "")]
    got = sorted((r.first_id, r.last_id, r.calls) for r in sessionize(spark.createDataFrame(rows, SCHEMA), chunk_seconds=3600).collect())
    assert got == [(1, 1, 2), (3, 3, 1)]


def test_empty_and_all_null(spark):
    assert sessionize(spark.createDataFrame([], SCHEMA)).count() == 0
    assert session_bounds(spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)).count() == 0


def test_dense_chunks_are_cut(spark):
    rows = [("k", i, i * 1_000_000) for i in range(3000)] + [("k", 9000, 10**12), ("l", 1, 5)]
    found = chunked(spark.createDataFrame(rows, "key string, id long, start_us long"), 3_600_000_000, 100).groupBy("key", "chunk").count().collect()
    assert max(r["count"] for r in found) <= 130 and sum(r["count"] for r in found) == 3002
