import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritally import expectations as E
from veritally.functions import expressions as X
from veritally.operators import compare, judge, metrics
from veritally.plans import report
from veritally.sources import readers, writers


@pytest.mark.parametrize(
    "k, n, low, high",
    [(28, 126, 0.1585, 0.3024), (0, 13, 0.0, 0.2281), (34, 234, 0.1059, 0.1962), (19, 96, 0.1305, 0.2886), (9, 30, 0.1666, 0.4788), (0, 0, None, None)],
)
def test_wilson(spark, k, n, low, high):
    lo, hi = X.wilson(F.lit(k), F.lit(n))
    got = spark.range(1).select(lo, hi).first()
    assert tuple(got) == (low, high)


def facts(spark, *tasks):
    """tasks: (id, control passed, [(operator, verdict, loud)])"""
    records = spark.createDataFrame([(i, "r", False, 1, ok) for i, ok, _ in tasks], "instance_id string, repo string, multi_target boolean, n_targets int, control_passed boolean")
    rows = [(i, *r, "o", None) for i, _, rs in tasks for r in rs]
    return records, spark.createDataFrame(rows, "instance_id string, operator string, verdict string, loud_failure boolean, observable string, witness_side string")


def test_failed_control_is_no_denominator(spark):
    r, v = facts(spark, ("a", True, [("x", "CLEAN", True)]), ("b", False, [("x", "CLEAN", True)]))
    assert metrics.witness_rate(r, v).first()["judged_tasks"] == 1


def test_task_counts_once_and_operators_stay_apart(spark):
    r, v = facts(spark, ("a", True, [("x", "WITNESS", True), ("x", "WITNESS", True), ("y", "UNVALIDATED", False)]))
    got = {x["operator"]: (x["witness_tasks"], x["judged_tasks"], x["rate"]) for x in metrics.witness_rate(r, v).collect()}
    assert got == {"x": (1, 1, 1.0), "y": (0, 0, None)}


def test_loud_and_silent_by_row(spark):
    r, v = facts(spark, ("a", True, [("x", "WITNESS", True), ("y", "CLEAN", False)]))
    got = {x["part"]: (x["judged"], x["witnesses"], x["operators"]) for x in metrics.loud_silent(r, v).collect()}
    assert got == {"loud": (1, 1, "x"), "silent": (1, 0, "y")}


@pytest.mark.parametrize("operator", [None, "", 0, [], {}])
def test_rate_needs_an_operator(spark, operator):
    r, v = facts(spark, ("a", True, [("x", "CLEAN", True)]))
    with pytest.raises(ValueError):
        metrics.witness_rate_of(r, v, operator)


def test_guards_fire(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    with pytest.raises(E.ExpectationError):
        E.known_ids(ids, ids.where("instance_id = 'a'"))
    with pytest.raises(E.ExpectationError):
        E.no_burn(ids)
    for bad in ({"rate": 0.4}, [{"x": {"rate": 0.1, "operator": ""}}]):
        with pytest.raises(E.ExpectationError):
            E.rate_has_operator(bad)
    E.rate_has_operator({"rate": None, "y": [{"rate": 1.0, "operator": "x"}]})
    for args in (([], ["t"], []), (["u"], ["t"], []), (["t"], ["t"], ["t"])):
        with pytest.raises(E.ExpectationError):
            E.overlay_in_scope(*args)
    for pin in (None, "0" * 64):
        with pytest.raises(E.ExpectationError):
            E.pinned("text", pin)
    for args in ((1, 2, 0), (2, 2, 2)):
        with pytest.raises(E.ExpectationError):
            E.complete_digest(*args)
    for bad, args in ((E.within_cost, (2.0, 1.0)), (E.within_cost, (float("nan"), 1.0)), (E.enough_controlled, (39,))):
        with pytest.raises(E.ExpectationError):
            bad(*args)
    calls = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "arm string, task int, digest string")
    with pytest.raises(E.ExpectationError):
        E.payloads_constant(calls)
    with pytest.raises(PySparkException, match="positive"):
        E.expect(spark.range(3), F.col("id") > 0, "ids are positive").collect()
    for text in ("a", "aa b aa"):
        with pytest.raises(PySparkException):
            spark.range(1).select(X.replace_once(F.lit(text), F.lit("aa"), F.lit("c"))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(X.rename_word(F.lit("foo foo2"), "foo", "foo2")).collect()


def test_rename_word(spark):
    assert spark.range(1).select(X.rename_word(F.lit("foo + xfoo"), "foo", "foo__r")).first()[0] == "foo__r + xfoo"


def test_single_score_spread(spark):
    calls = spark.createDataFrame([("a", 1, 4), ("a", 2, 1), ("a", 2, 3)], "arm string, task int, score int")
    got = {r["task"]: (r["range"], r["stdev"]) for r in judge.spread(calls, 2).collect()}
    assert got[1] == (None, 0.0) and got[2][0] == 2


def test_reward_is_not_vacuous_and_keeps_all_failures(spark):
    rows = [("r", "p2p", f"t{i:02}", None if i else "PASSED") for i in range(14)]
    got = compare.grade(spark.createDataFrame(rows, "run string, list string, test_id string, status string"), ["run"]).first()
    assert got["reward"] == 0.0
    assert compare.failing(spark.createDataFrame(rows, "run string, list string, test_id string, status string"), ["run"]).count() == 13


def test_records_round_trip_and_report(spark, tmp_path):
    record = {
        "instance_id": "a__b-1", "repo": "a/b", "n_targets": 1, "multi_target": False, "completed": True, "on_prime_hub": None,
        "control": {"passed": True, "reason": "ok"}, "witnesses": [],
        "rows": [{"operator": "symbol_rename", "verdict": "REFUSED", "loud_failure": True}, {"operator": "message_reword", "verdict": "NOT_APPLICABLE"}],
    }
    (tmp_path / "a.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "b.json.partial").write_text("{")
    recs = readers.records(spark, str(tmp_path))
    assert recs.count() == readers.complete(recs).count() == 1 and readers.witness_tasks(recs).count() == 0
    out = report.build(recs)
    assert out["n_records"] == out["n_controlled"] == 1
    assert {r["operator"]: r["rate"] for r in out["by_operator_rate"]} == {"symbol_rename": None, "message_reword": None}
    writers.write_report(recs.select("instance_id", "completed"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == {"completed": True, "instance_id": "a__b-1"}
    writers.write_ids(recs.select("instance_id"), str(tmp_path / "ids"), ("one", "two"))
    assert [r[0] for r in readers.ids(spark, str(tmp_path / "ids")).collect()] == ["a__b-1"]


def test_source_tree(spark, tmp_path):
    for name in ("src/m.py", "src/test_m.py", "tests/x.py", ".hidden/y.py", "setup.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\ny = 2\n")
    assert [tuple(r) for r in readers.source_tree(spark, str(tmp_path)).collect()] == [("src/m.py", "x = 1\ny = 2\n")]


def test_event_log_is_appended_and_read(spark, tmp_path):
    from veritally.streaming import events as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"t": 1.5, "event": "start", "instance_id": "a"}\n{"t": 2.5, "event": "done", "seconds": 1.0}\n')
    for _ in range(2):  # a restart adds nothing
        q = stream.append_events(stream.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    assert [r["event"] for r in readers.events(spark, str(tmp_path / "out")).orderBy("t").collect()] == ["start", "done"]


def test_record_sinks_and_listings(spark, tmp_path):
    """Readers and sinks round-trip: records, eligibility lists, corpora with encoded lists, JSON lines, overlays by task."""
    recs = [{"instance_id": f"a__b-{i}", "repo": "a/b" if i % 2 else "c/d", "completed": i != 3, "control": {"passed": True}, "rows": [{"operator": "x", "verdict": "CLEAN"}]} for i in range(6)]
    for r in recs:
        (tmp_path / f"{r['instance_id']}.json").write_text(json.dumps(r, indent=1))
    loaded = readers.records(spark, str(tmp_path))
    writers.write_records(loaded, str(tmp_path / "sink"))
    back = spark.read.text(str(tmp_path / "sink")).select(F.from_json("value", "instance_id string, completed boolean").alias("x"), "repo").select("x.*", "repo")
    assert sorted(map(tuple, back.collect())) == sorted((r["instance_id"], r["completed"], r["repo"]) for r in recs)
    listing = spark.createDataFrame([("b", False), ("c", True), ("a", True)], "instance_id string, eligible boolean")
    writers.write_jsonl(listing, str(tmp_path / "eligible"), "instance_id")
    assert [r["instance_id"] for r in readers.eligible(spark, str(tmp_path / "eligible")).orderBy("instance_id").collect()] == ["a", "c"]
    with pytest.raises(PySparkException):
        readers.eligible(spark, str(tmp_path / "none"))
    corpus = spark.createDataFrame([("a", '["t1", "t2"]', ["p"])], "instance_id string, FAIL_TO_PASS string, PASS_TO_PASS array<string>")
    corpus.write.parquet(str(tmp_path / "corpus"))
    assert tuple(readers.corpus(spark, str(tmp_path / "corpus")).first()) == ("a", ["t1", "t2"], ["p"])
    writers.write_partitioned(spark.createDataFrame([("t1", "m"), ("t2", "n")], "task string, mutant string"), str(tmp_path / "overlays"), "task")
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "overlays")).select("task", "mutant").collect())) == [("t1", "m"), ("t2", "n")]


def test_finished_rows_are_appended_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "task string, n int").write.json(str(tmp_path / "in"))
    for _ in range(2):
        q = writers.append_rows(spark.readStream.schema("task string, n int").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r["task"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_judge_answers_say_why(spark):
    rows = [("", "empty response"), ("none", "no JSON object in response"), ('"score": 5', "no JSON object; a bare score field was present (5)"), ('{"score": ', "no JSON object; a bare score field was present (5)"), ('{"score": true}', "score is not an integer"), ('{"score": 11}', "score out of range"), ("{x}", "json decode error"), ('{"score": 3}', None)]
    rows[3] = ('{"a" }', "json decode error")
    df = spark.createDataFrame(rows, "text string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", X.judge_answer(F.col("text"))["error"].alias("got")).collect())


def test_payload_digest_is_that_of_sorted_json(spark):
    import hashlib

    from veritally.operators import verdicts

    payload = {"model": "m", "messages": [{"role": "user", "content": 'é "q" \n\\'}], "n": 3, "none": None}
    cols = {"n": F.lit(3), "model": F.lit("m"), "none": F.lit(None).cast("string"), "messages": [{"content": F.lit('é "q" \n\\'), "role": F.lit("user")}]}
    got = spark.range(1).select(X.sorted_json(cols).alias("j"), X.payload_digest(cols).alias("h")).first()
    want = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    assert (got["j"], got["h"]) == (want, hashlib.sha256(want.encode()).hexdigest())
    spec = spark.createDataFrame([("a", "r", "1", "c", ["x.py"], ["f"], ["p"])], "instance_id string, repo string, version string, base_commit string, targets array<string>, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>")
    assert verdicts.task_spec(spec).first()["multi_target"] is False


def test_lattice_needs_a_finite_reward(spark):
    rows = [(x,) for x in (None, float("nan"), float("inf"), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "reward double").select("*", *(F.lit(v).alias(c) for c, v in {"control": 1.0, "anchored": True, "refused": False, "observable": True, "valid": True}.items()))
    assert [r[0] for r in df.select(compare.verdict_of()).collect()] == ["UNVALIDATED"] * 3 + ["WITNESS", "CLEAN"]


def test_a_small_tree_s_digest_is_that_of_its_listing(spark):
    """What hashing each named path in order gives; no digest for an absent tree or an unsound order."""
    import hashlib

    own = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("t", 2, "a.py", "x = 1"), ("t", 1, "b.py", ""), ("t", 3, "gone.py", None), ("absent", 1, "a.py", None), ("tie", 1, "a.py", "x"), ("tie", 1, "b.py", "y"), ("unplaced", None, "a.py", "x")]
    kinds = "task string, position int, path string, text string"
    digest = lambda some: {r["task"]: r["digest"] for r in compare.small_tree_digest(spark.createDataFrame(some, kinds), ["task"]).collect()}
    listing = f"{own('')}  b.py\n{own('x = 1')}  a.py\nMISSING gone.py"
    assert digest(rows) == {"t": own(listing), "absent": None, "tie": None, "unplaced": None}
    changed = [("t", 2, "a.py", "x = 2"), *rows[1:3]]
    lost = [rows[0], rows[1], ("t", 3, "gone.py", "here")]
    assert len({digest(rows[:3])["t"], digest(changed)["t"], digest(lost)["t"], digest(rows[:2])["t"]}) == 4


def test_a_record_without_its_task_stops_the_job(spark):
    """Whatever is asked of the result; tasks twice in the corpus, and columns of one name on both sides."""
    corpus = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], "instance_id string, size int, note string")
    recs = spark.createDataFrame([("a", "own"), ("b", "own"), ("a", "other")], "instance_id string, note string")
    got = compare.with_corpus(recs, corpus)
    assert got.columns == ["instance_id", "note", "size"]
    assert sorted(tuple(r) for r in got.collect()) == [("a", "other", 1), ("a", "own", 1), ("b", "own", 2), ("b", "own", 3)]
    for lost in ("gone", None):
        bad = compare.with_corpus(recs.union(spark.createDataFrame([(lost, "n")], recs.schema)), corpus)
        for run in (bad.collect, bad.count, bad.select("instance_id").collect, bad.groupBy("note").count().collect):
            with pytest.raises(Exception, match=f"the corpus lacks {lost or 'a null id'}"):
                run()
    assert compare.with_corpus(recs.limit(0), corpus.limit(0)).count() == 0
