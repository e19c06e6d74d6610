import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import events

GOOD = {"version": 3, "buildTool": "maven", "successful": True, "finishedAt": 1_000, "captureScope": "task_output", "failureMessagesBase64": [], "diagnosticsBase64": [base64.b64encode(b"x").decode()], "project": "p"}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None), ({"extra": 1}, "unknown field"), ({"version": 2}, "version"), ({"buildTool": "ant"}, "tool"), ({"successful": None}, "missing field"), ({"captureScope": "x"}, "scope"),
        ({"failureMessagesBase64": [""] * 51}, "too many messages"), ({"diagnosticsBase64": ["%%%"]}, "base64"), ({"finishedAt": 10**13}, "in the future"), ({"captureScope": None}, None),
    ],
)
def test_events_are_checked(spark, change, problem):
    raw = spark.createDataFrame([(json.dumps(GOOD | change),)], "value string")
    assert events.checked_events(raw, F.lit(10**12)).first().problem == problem


def test_broken_events(spark):
    raw = spark.createDataFrame([("nonsense",), ("[1]",), (None,)], "value string")
    assert {r.problem for r in events.checked_events(raw).collect()} == {"not an object"}


def test_stream_takes_the_latest_and_drops_late_ones(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    cases = {"a": GOOD, "b": GOOD | {"finishedAt": 2_000, "successful": False}, "c": GOOD | {"project": "q", "finishedAt": 5}, "d": GOOD | {"project": "r"}, "e": GOOD | {"project": "r", "version": 1, "finishedAt": 9_000}}
    for name, event in cases.items():
        (spool / f"{name}.json").write_text(json.dumps(event))
    newest = spark.createDataFrame([("q", 6), ("r", 7)], "project string, at long")
    seen = []
    act = lambda df, n: seen.extend((r.project, r.decision, r.finishedAt) for r in df.collect())
    for _ in range(2):
        events.consume_events(spark, str(spool), str(tmp_path / "cp"), act, newest_input_ms=newest).awaitTermination(60)
    assert sorted(seen) == [("p", "failed", 2_000), ("q", "dropped", 5), ("r", "refresh", 1_000)]


def test_debounce(spark):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([("p", at(0), 1), ("p", at(1), 2), ("p", at(2.5), 3), ("p", at(9), 4), ("q", at(1), 7)], "project string, at timestamp, revision int")
    assert sorted((r.project, r.revision, r.changes) for r in events.debounced(rows).collect()) == [("p", 3, 3), ("p", 4, 1), ("q", 7, 1)]


def test_debounce_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    schema = "project string, at timestamp, revision int"
    spark.createDataFrame([("p", at(0), 1), ("p", at(1), 2), ("p", at(60), 3)], schema).coalesce(1).write.parquet(str(src))
    stream = events.debounced(spark.readStream.schema(schema).parquet(str(src)), watermark="1 second")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.project, r.revision, r.changes) for r in spark.table("bursts").collect()] == [("p", 2, 2)]
