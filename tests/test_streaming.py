from __future__ import annotations

from datetime import datetime, timedelta

from chronoweave.streaming import sessions

START = datetime(2024, 1, 1)


def run(spark, tmp_path, make):
    got = []
    rows = [(i, START + timedelta(hours=h), u, "view", float(i), "{}") for i, (u, h) in enumerate([(1, 0), (1, 2), (1, 9), (2, 1), (1, 0.5), (3, 200), (3, 400)])]
    for k, part in enumerate((rows[:4], [*rows[4:], rows[0]])):
        spark.createDataFrame(part, sessions.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = make(sessions.read_events(spark, str(tmp_path / "in"), 1))
    sessions.write(stream, str(tmp_path / "checkpoint"), lambda df, _: got.extend(df.collect())).awaitTermination()
    return got


def test_sessions_close_with_the_watermark(spark, tmp_path):
    got = run(spark, tmp_path, lambda e: sessions.sessions(sessions.first_seen(e)))
    first = sorted((r["user_id"], r["n"]) for r in got if r["user_id"] < 3)
    assert first == [(1, 1), (1, 3), (2, 1)]


def test_daily_windows(spark, tmp_path):
    got = run(spark, tmp_path, sessions.daily)
    assert sum(r["n"] for r in got if r["day"] == START) == 6
