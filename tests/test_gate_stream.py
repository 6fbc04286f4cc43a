"""Gates as a stream against the batch replay, for several cuts into micro-batches and after a restart."""

import datetime
import random

import pytest

from quillspark.operators import workflow
from quillspark.streaming import gates

SCHEMA = "ws long, stage long, kind string, ts timestamp, event_id long"
START = datetime.datetime(2024, 1, 1)


def log(seed, n=120):
    rng = random.Random(seed)
    at = START
    rows = []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([0, 0, 30, 600]))  # ties in time
        rows.append((rng.randrange(3), rng.randrange(4), rng.choice(["open", "approve", "approve", "reject", "reset", "other"]), at, i))
    return rows


def add(spark, folder, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def states(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cuts", [[], [1, 2, 50], [40, 80]])
def test_stream_equals_batch_in_any_order_and_after_a_restart(spark, tmp_path, cuts):
    rows = log(len(cuts))
    random.Random(7).shuffle(rows)
    folder, parts = tmp_path / "log", [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    done = []
    for i, part in enumerate(parts):
        add(spark, folder, part, i)
        done += part
        if i in (0, len(parts) - 1):  # stopped after the first batch, and started again for the others
            got = gates.replayed(spark, stream(spark, folder), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
            assert states(got) == states(workflow.gate_states(spark.createDataFrame(done, SCHEMA)).select("ws", "stage", "gate", "since"))


def test_silence_is_told_once_and_taken_back(spark, tmp_path):
    minutes = lambda m: START + datetime.timedelta(minutes=m)
    batches = [[(1, 0, "open", minutes(0), 0), (2, 0, "open", minutes(1), 1)], [(2, 0, "approve", minutes(60), 2)], [(2, 0, "open", minutes(61), 3)], [(1, 0, "approve", minutes(70), 4)], [(2, 1, "open", minutes(200), 5)], [(2, 1, "open", minutes(201), 6)]]
    for i, rows in enumerate(batches):
        add(spark, tmp_path / "log", rows, i)
        gates.replayed(spark, stream(spark, tmp_path / "log"), str(tmp_path / "checkpoint"), str(tmp_path / "out"), silence=datetime.timedelta(minutes=30), late="1 minute")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.ws, r.since) for r in got.where("gate = 'silent'").collect()) == [(1, 0), (1, 4)]  # the other one's events move the time on
