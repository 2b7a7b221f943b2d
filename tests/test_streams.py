"""Streams against their batch twins, state that ends, sinks that may be written twice, broken files, and guards within a run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veritally import expectations as E
from veritally.operators import events as batch
from veritally.operators import metrics
from veritally.sources import readers, writers
from veritally.streaming import events as stream

EVENT = "run long, sec long, event_id long, seconds double, refused boolean"


def outcomes(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))


def test_twins_over_several_batches(spark, tmp_path):
    rows = [(i % 3, i, i, float(5 if i % 30 < 27 else 100), i % 5 > 0) for i in range(120)]
    df = outcomes(spark, rows)
    for k in range(3):  # a file, and a batch, for each part of the time
        df.where(F.col("sec").between(40 * k, 40 * k + 39)).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, s, b, cols in (
        ("twin_burns", stream.burns(source), batch.burns(df), ["run", "event_id", "slowest"]),
        ("twin_backoffs", stream.backoffs(source), batch.backoffs(df), ["run", "event_id", "consecutive", "sleep_s"]),
    ):
        q = s.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_state_ends_with_its_run(spark, tmp_path):
    """Twenty runs of an hour each, one after the other: with state for two hours no more than a few are held, and a run that pauses begins anew."""
    folder = str(tmp_path / "in")
    rows = [(r, 3600 * r + 60 * k, 100 * r + k, 5.0, True) for r in range(20) for k in range(4)] + [(0, 3600 * 19 + 1800 + k, 5000 + k, 5.0, True) for k in range(4)]
    for r in range(21):
        part = rows[4 * r : 4 * r + 4]
        outcomes(spark, part).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(outcomes(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    found = stream.burns(source, last=8, late="1 minute", idle_ms=2 * 3600 * 1000)
    q = found.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert 0 < max(held) <= 24 and held[-1] <= 24  # a few runs with a value and a timer each, not twenty runs'
    assert spark.table("ended").count() == 0  # run 0's first four outcomes were forgotten
    assert batch.burns(outcomes(spark, rows)).count() == 1


def test_one_stream_to_two_sinks(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "event_id long, sec long, event string"
    batches = [[(1, 0, "done"), (2, 1, "refused"), (1, 0, "done")], [(2, 1, "refused"), (3, 7200, "done")], [(4, 10, "done"), (5, 7300, None), (3, 7200, "done")]]
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    for rows in batches:  # the last batch has an event that is two hours late
        frame(rows).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(frame(rows).schema).parquet(folder)
        q = stream.routed(source, str(tmp_path / "results"), str(tmp_path / "refusals"), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    ids = lambda name: sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / name)).select("event_id").collect())
    assert (ids("results"), ids("refusals")) == ([1, 3, 5], [2])


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "task string, at int, outcome string")
    table = lambda: {tuple(r) for r in writers.latest(spark, path, "task", "at").collect()}
    with pytest.raises(ValueError):
        table()
    assert writers.write_batch(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), (None, 1, "n")), path, 0)
    assert writers.write_batch(rows(("a", 0, "later batch"), ("c", 1, None)), path, 1)
    want = {("a", 0, "later batch"), ("b", 1, "x"), ("c", 1, None), (None, 1, "n")}
    assert table() == want
    assert writers.write_batch(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), (None, 1, "n")), path, 0)  # replayed
    assert table() == want
    writers.compact(spark, path, "task", "at")
    assert table() == want and sorted(p for p in os.listdir(path) if not p.startswith(("_", "."))) == ["base-1"]
    assert not writers.write_batch(rows(("a", 9, "replayed")), path, 1) and table() == want
    assert writers.write_batch(rows(("b", 5, "z")), path, 2) and table() == want - {("b", 1, "x")} | {("b", 5, "z")}
    writers.compact(spark, path, "task", "at")
    writers.compact(spark, path, "task", "at")
    assert len(table()) == 4


def test_a_stream_upserts_across_restarts(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(3):
        spark.createDataFrame([("a", k), (f"t{k}", k)], "task string, at int").coalesce(1).write.mode("append").json(folder)
        for _ in range(2):
            q = writers.upsert(spark.readStream.schema("task string, at int").json(folder), path, str(tmp_path / "c"))
            q.processAllAvailable()
            q.stop()
    assert {tuple(r) for r in writers.latest(spark, path, "task", "at").collect()} == {("a", 2), ("t0", 0), ("t1", 1), ("t2", 2)}


def test_broken_files_are_told(spark, tmp_path):
    whole = {"instance_id": "a", "completed": True, "control": {"passed": True}, "rows": [{"operator": "x", "verdict": "CLEAN"}]}
    texts = {"a": json.dumps(whole, indent=1), "cut": json.dumps(whole)[:40], "empty": "", "blank": " \n", "list": "[1]", "bare": "3", "none": json.dumps({"completed": True}), "kind": json.dumps({"instance_id": "k", "completed": "maybe"})}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "b.json.partial").write_text("{")
    records, broken = readers.checked_records(spark, str(tmp_path))
    assert [(r["file"].rsplit("/", 1)[1], r["instance_id"], r["rows"][0]["verdict"]) for r in records.collect()] == [("a.json", "a", "CLEAN")]
    told = {r["file"].rsplit("/", 1)[1].split(".")[0]: r["broken"] for r in broken.collect()}
    assert told == {"cut": "no JSON object", "empty": "empty", "blank": "empty", "list": "no JSON object", "bare": "no JSON object", "none": "no instance_id", "kind": "no JSON object"}
    assert readers.complete(records).count() == 1


def test_guards_fire_from_the_run_they_watch(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    rows = spark.range(50).select(seen("id").alias("x"))
    watch = E.Watch(small=F.col("x") < 49, known=F.col("x").isNotNull())
    assert len(watch.on(rows).collect()) == 50
    with pytest.raises(E.ExpectationError, match="small"):
        watch.settle()
    assert made.value == 50  # one run made the rows and the guard's counts
    watch = E.Watch(known=F.col("x").isNotNull())
    watch.on(rows).write.format("noop").mode("overwrite").save()
    assert watch.settle() == {"rows": 50, "known": 0}
    ids = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    for corpus, fires in ((ids.where("instance_id = 'a'"), True), (ids, False)):
        out, watch = E.watched_ids(ids, corpus)
        assert out.count() == 2
        if fires:
            with pytest.raises(E.ExpectationError, match="known_ids"):
                watch.settle()
        else:
            watch.settle()


def test_sensitivity_of_a_rate(spark):
    tasks = [(f"t{i}", "r" + str(i % 3) if i else None, i % 2 == 0, i != 5) for i in range(12)]
    records = spark.createDataFrame(tasks, "instance_id string, repo string, multi_target boolean, control_passed boolean")
    rows = spark.createDataFrame([(t, op, v) for i, (t, *_) in enumerate(tasks) for op, v in (("x", "WITNESS" if i % 4 == 0 else "CLEAN"), ("y", "REFUSED"))], "instance_id string, operator string, verdict string")
    got = {(r["operator"], r["subset"], r["grouping"], r["value"]): (r["judged_tasks"], r["witness_tasks"], r["median"]) for r in metrics.sensitivity(records, rows, {"repo": F.col("repo"), "many": F.col("multi_target")}).collect()}
    for op, judged in (("x", [i for i in range(12) if i != 5]), ("y", [])):
        wit = lambda some: sum(i % 4 == 0 for i in some)
        assert got[op, "all", None, None] == (len(judged), wit(judged), None)
        for grouping, of in (("repo", lambda i: f"r{i % 3}" if i else "null"), ("many", lambda i: str(i % 2 == 0).lower())):
            values = {of(i) for i in range(12) if i != 5}
            parts = {v: [i for i in judged if of(i) == v] for v in values}
            shares = sorted(wit(p) / len(p) for p in parts.values() if p)
            mid = None if not shares else (shares[len(shares) // 2] + shares[(len(shares) - 1) // 2]) / 2
            for v, p in parts.items():
                assert got[op, "only", grouping, v] == (len(p), wit(p), mid)
                assert got[op, "without", grouping, v][:2] == (len(judged) - len(p), wit(judged) - wit(p))
