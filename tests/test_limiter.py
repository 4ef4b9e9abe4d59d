"""Attempt limiter: batch, stream and a plain loop agree."""

import random

from thermograph.streaming.limiter import Limits, job_state_stream, limit_attempts, limit_attempts_stream

LIM = Limits(window=300.0, login_address=6, login_user=3, other=4)


def events():
    rng, t, out = random.Random(5), 0.0, []
    for i in range(400):
        t += rng.choice([0.5, 5, 20, 20, 400])
        out.append((i, t, rng.choice(["login", "login", "register"]), rng.choice(["a", "b"]), rng.choice(["u", "v", "w"])))
    return out


def loop(rows):
    state, res = {}, {}
    for i, t, action, addr, user in rows:
        keys = [((action, addr), 6), ((action, addr, user), 3)] if action == "login" else [((action, addr), 4)]
        full = [state[k][1] for k, n in keys if k in state and state[k][1] > t and state[k][0] >= n]
        if full:
            res[i] = (False, max(1, int(full[0] - t + 1)))
            continue
        for k, _ in keys:
            state[k] = (state[k][0] + 1, state[k][1]) if k in state and state[k][1] > t else (1, t + 300.0)
        res[i] = (True, 0)
    return res


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, s double, action string, address string, username string").selectExpr(
        "event_id", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS ts", "action", "address", "username")


def test_batch_matches_loop(spark):
    rows = events()
    got = {r.event_id: (r.allowed, r.retry_after) for r in limit_attempts(frame(spark, rows), LIM).collect()}
    assert got == loop(rows)


def test_stream_matches_batch(spark, tmp_path):
    rows = events()
    src = str(tmp_path / "in")
    for part in (rows[:150], rows[150:280], rows[280:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp, action string, address string, username string").option("maxFilesPerTrigger", 1).parquet(src)
    q = limit_attempts_stream(stream, LIM).writeStream.format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.table("lim").collect()}
    assert got == loop(rows)


def test_job_state_stream(spark, tmp_path):
    src = str(tmp_path / "jobs")
    spark.createDataFrame([(1, 1, 1, "queued", 0), (1, 2, 2, None, 50), (1, 3, 3, "done", None)], "job_id long, ts long, pos long, status string, progress int").write.parquet(src)
    q = job_state_stream(spark.readStream.schema("job_id long, ts long, pos long, status string, progress int").parquet(src), ["status", "progress"]).writeStream.format("memory").queryName("jobs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("jobs").first()) == (1, "done", 50)


def test_one_hot_address(spark):
    """One address without a pause: window starts by pointers, and logins that reach no limit unwalked."""
    rng, t, rows = random.Random(8), 0.0, []
    for i in range(900):
        t += rng.choice([0.25, 1, 30, 120])
        rows.append((i, t, rng.choice(["register", "register", "login"]), "hot", f"u{i % 400}"))
    roomy = Limits(window=300.0, login_address=10**6, login_user=10**6, other=4)
    got = {r.event_id: (r.allowed, r.retry_after) for r in limit_attempts(frame(spark, rows), roomy).collect()}
    want = loop([r for r in rows if r[2] == "register"])
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == (True, 0) for k, v in got.items() if k not in want) and len(got) == len(rows)
