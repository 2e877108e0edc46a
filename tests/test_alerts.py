"""Alerts: paths that contain each other, and bursts."""

import datetime
import random

from pyspark.sql import functions as F

from tautline.streaming import watch


def test_paths_meet_when_either_contains_the_other(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab/") for _ in range(rnd.randrange(1, 14)))
    linked = [(f"u{k}", word()) for k in range(60)] + [("same", "src/main/a.java"), ("long", "repo/src/main/a.java.bak"), ("tail", ".java"), ("none", ""), ("null", None), ("é", "é/ü")]
    files = [word() for _ in range(60)] + ["src/main/a.java", "x/é/üy", "", ".links/a.link", "a"]
    changes = spark.createDataFrame([(k, f, "modify") for k, f in enumerate(files)] + [(999, "src/main/a.java", "remove")], "event_id long, file string, event_type string")
    df = watch.watch_alerts(changes, spark.createDataFrame(linked, "uuid string, file string"))
    want = sorted((k, f, u) for k, f in enumerate(files) if f and ".links/" not in f for u, x in linked if x and (x in f or f in x))
    assert sorted(tuple(r) for r in df.collect()) == want and {u for _, _, u in want} >= {"same", "long", "tail", "é"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bursts_collapse_within_the_delay(spark, tmp_path):
    at = lambda minute: datetime.datetime(2026, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)
    schema = "event_id long, file string, event_type string, ts timestamp"
    batches = [[(1, "a.txt", "modify", at(0)), (2, "b.txt", "modify", at(1))], [(3, "a.txt", "modify", at(4)), (4, "b.txt", "remove", at(5))], [(5, "c.txt", "modify", at(40))], [(6, "a.txt", "modify", at(41)), (7, "a.txt", "modify", at(42))]]
    linked = spark.createDataFrame([("1", "a.txt"), ("2", "a.txt"), ("3", "b.txt"), ("4", "c.txt")], "uuid string, file string")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        watch.run_available(watch.watch_alerts(stream, linked, dedup_delay="10 minutes"), f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
    got = sorted((r.event_id, r.uuid) for r in spark.read.parquet(f"{tmp_path}/rows").select("event_id", "uuid").filter(F.col("uuid").isNotNull()).collect())
    assert [(min(k, 6), u) for k, u in got] == [(1, "1"), (1, "2"), (2, "3"), (5, "4"), (6, "1"), (6, "2")]
