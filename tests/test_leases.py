"""Leases as a stream: late, repeated and shuffled files give what the whole table gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import leases

START = 1_700_000_000


@pytest.fixture(scope="module")
def events():
    pick = random.Random(4)
    rows = []
    for job in range(25):
        t = START + pick.randrange(600)
        for _ in range(pick.randint(1, 12)):
            rows.append((f"j{job}", t, pick.choice(["claim", "claim", "beat", "beat", "finish", "fail", "cancel", "queue"] if pick.random() < 0.3 else ["claim", "beat", "fail"]), pick.choice(["a", "a", "b"])))
            t += pick.choice([0, 5, 60, 200, 400])
    rows += [("last", START + 20_000, "queue", "a"), ("last", START + 40_000, "queue", "a")]
    return rows


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame(rows, "job string, s long, what string, writer string").select("job", F.timestamp_seconds("s").alias("at"), "what", "writer")


def test_the_machine():
    run = lambda due, upto, **k: leases.advance(leases.NEW, [(1000 * t, w, o) for t, w, o in due], 1000 * upto, **k)
    state, seen = run([(0, "claim", "a"), (200, "beat", "a"), (100, "finish", "b")], 499)
    assert state[0] == "running" and [x[1] for x in seen] == ["running"]  # another's finish is refused, the beat prolongs
    state, seen = run([(0, "claim", "a")], 10_000)
    assert [(t // 1000, k) for t, k, *_ in seen] == [(0, "running"), (300, "waiting"), (302, "queued")]
    state, seen = run([(0, "claim", "a"), (1, "fail", "a"), (2, "claim", "b"), (3, "claim", "b"), (4, "fail", "b"), (20, "claim", "c"), (21, "fail", "c"), (50, "claim", "d")], 99)
    assert state[:3] == ("dead", "c", 3) and [k for _, k, *_ in seen] == ["running", "waiting", "queued", "running", "waiting", "queued", "running", "dead"]
    state, _ = run([(0, "claim", "a"), (5, "cancel", None), (6, "finish", "a")], 9)
    assert state[0] == "cancelled"


def test_stream_tells_what_the_table_tells(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    want = sorted(map(tuple, leases.history(frame(spark, events)).collect()), key=key)
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    pick = random.Random(9)
    body, tail = events[:-2], events[-2:]
    pick.shuffle(body)
    parts = [body[:90], body[60:], body[:30], tail[:1], tail[1:]]  # shuffled, overlapping, some twice; the last two move the watermark
    for n, part in enumerate(parts):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"job": j, "s": s, "what": w, "writer": o}) for j, s, w, o in part))
        stream = spark.readStream.schema("job string, s long, what string, writer string").json(source).select("job", F.timestamp_seconds("s").alias("at"), "what", "writer")
        query = leases.transitions(stream, late="2 hours").writeStream.format("parquet").option("checkpointLocation", check).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
    got = sorted(map(tuple, spark.read.schema(leases.TRANSITIONS).parquet(out).collect()), key=key)
    assert got == want and len(got) > 40


def test_silent_jobs(spark, tmp_path):
    starts = [("a", START), ("b", START), ("c", START + 10), ("z", START + 9_000)]
    beats = [("a", START + 100), ("b", START + 400), ("z", START + 9_001)]
    table = lambda rows: spark.createDataFrame(rows, "job string, s long").select("job", F.timestamp_seconds("s").alias("at"))
    want = {("b", START), ("c", START + 10)}
    read = lambda df: sorted((r.job, int(r.at.timestamp())) for r in df.collect())
    assert set(read(leases.silent_jobs(table(starts), table(beats)))) == want
    for name, files in (("s", [starts[2:3], starts[:2] + starts[3:]]), ("b", [beats[1:], beats[:1]])):
        (tmp_path / name).mkdir()
        for n, rows in enumerate(files):
            (tmp_path / name / f"{n}.json").write_text("\n".join(json.dumps({"job": j, "s": s}) for j, s in rows))
    stream = lambda name: spark.readStream.schema("job string, s long").json(str(tmp_path / name)).select("job", F.timestamp_seconds("s").alias("at"))
    out = str(tmp_path / "out")
    for more in (None, "later"):
        if more:  # the watermark moves past the interval
            for name in "sb":
                (tmp_path / name / "9.json").write_text(json.dumps({"job": "end", "s": START + 90_000}))
        leases.silent_jobs(stream("s"), stream("b")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(availableNow=True).start().awaitTermination(240)
    assert [x for x in read(spark.read.schema("job string, at timestamp").parquet(out)) if x[0] != "end"] == sorted(want)
