"""Ledgers and windows, on batches and as streams that end."""

import datetime
import json
import os

from sievework.streaming import ledgers, windows

T0 = datetime.datetime(2024, 1, 1)
at = lambda s: T0 + datetime.timedelta(seconds=s)


def run(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    order = 1_700_000_000 + len(list(folder.iterdir()))  # streams take files by their time
    os.utime(folder / name, (order, order))


def test_batch_ledger(spark):
    make = lambda schema, *data: spark.createDataFrame(list(data), schema)
    items = make("request_id string, batch_id string, custom_id string", ("a", "1", "a"), ("b", "1", "b"), ("c", "1", "c"), ("d", "2", "d"), ("e", "3", "e"), ("f", "4", "f"), ("g", "9", "g"))
    batches = make("batch_id string, state string, reason string", ("1", "ended", ""), ("2", "expired", ""), ("3", "not_found", ""), ("4", "failed", "quota"))
    results = make("batch_id string, custom_id string, outcome string, reason string, content string", ("1", "a", "succeeded", "", "yes"), ("1", "b", "errored", "", None))
    got = {r["request_id"]: (r["outcome"], r["reason"], r["content"]) for r in ledgers.classify_items(items, batches, results).collect()}
    assert got == {"a": ("answered", None, "yes"), "b": ("failed", "errored", None), "c": ("failed", "missing from results", None), "d": ("failed", "expired", None), "e": ("failed", "batch reference not found", None), "f": ("failed", "batch failed: quota", None), "g": ("failed", "expired", None)}
    recorded = make("batch_id string, request_id string, key string", ("1", "a", "k"), ("2", "d", "old"), ("3", "z", "gone"))
    assert sorted(tuple(r) for r in ledgers.resume_checks(recorded, make("request_id string, key string", ("a", "k"), ("d", "new"))).collect()) == [("1", "resume"), ("2", "abandon"), ("3", "resume")]


def test_mailbox(spark, tmp_path):
    put(tmp_path / "in", "1.json", {"request_id": "a", "content": "first", "ts": "2024-01-01T00:00:00"}, {"request_id": "zz", "content": "not asked", "ts": "2024-01-01T00:00:00"}, "no json")
    put(tmp_path / "in", "2.json", {"request_id": "b", "content": "other", "ts": "2024-01-01T00:00:02"})
    requests = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "request_id string, question string")
    stream = ledgers.answered(requests, ledgers.first_answers(ledgers.answers(spark, str(tmp_path / "in"))))
    got = run(spark, stream.select("request_id", "content"), tmp_path, "mailbox")
    assert sorted(got) == [("a", "first"), ("b", "other")]
    batch = spark.createDataFrame([("a", "x", at(0)), ("a", "y", at(1))], ledgers.ANSWER)
    assert ledgers.first_answers(batch).count() == 1


def test_expiry(spark, tmp_path):
    row = lambda r, k, s, c=None: {"request_id": r, "kind": k, "content": c, "ts": at(s).isoformat()}
    put(tmp_path / "ev", "1.json", row("a", "submitted", 0), row("b", "submitted", 1))
    put(tmp_path / "ev", "2.json", row("a", "answered", 20, "yes"))
    put(tmp_path / "ev", "3.json", row("c", "submitted", 500))
    put(tmp_path / "ev", "4.json", row("d", "submitted", 501))
    schema = "request_id string, kind string, content string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev"))
    got = run(spark, ledgers.expiring(stream, 60), tmp_path, "expiry")
    assert sorted(got, key=repr) == [("a", "answered", None, "yes"), ("b", "failed", "expired", None)]


def test_sessions_and_windows(spark, tmp_path):
    seen = [(i, u, at(s)) for i, (u, s) in enumerate([(1, 0), (1, 10), (1, 100), (2, 5), (3, 900)])]
    batch = spark.createDataFrame(seen, "event_id int, user_id int, ts timestamp")
    want = sorted((r["user_id"], r["began"], r["events"]) for r in ledgers.silent_sessions(batch, 30).collect())
    assert want == [(1, at(0), 2), (1, at(100), 1), (2, at(5), 1), (3, at(900), 1)]
    for i, u, t in seen:
        put(tmp_path / "s", f"{i}.json", {"event_id": i, "user_id": u, "ts": t.isoformat(), "event_type": "x", "value": 1.5})
    stream = spark.readStream.schema("event_id int, user_id int, ts timestamp, event_type string, value double").json(str(tmp_path / "s"))
    got = run(spark, ledgers.silent_sessions(stream, 30).select("user_id", "began", "events"), tmp_path, "sessions")
    assert sorted(got) == want[:3]  # the last run may still go on
    usage = run(spark, windows.usage_windows(stream, "1 minute"), tmp_path, "usage", "complete")
    assert sorted((r[0], r[2], r[3]) for r in usage) == [(at(0), 3, 4.5), (at(60), 1, 1.5), (at(900), 1, 1.5)]


def test_gaps(spark):
    events = spark.createDataFrame([(1, 7, at(0)), (2, 7, at(40)), (3, 7, at(50))], "event_id int, user_id int, ts timestamp")
    assert [tuple(r) for r in windows.silences(events, 30).collect()] == [(7, 1, 40)]
