"""S9/S10 commits, U1 over several runs, and reports of unreadable records."""
import json
import os
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moleval.operators import predict as P
from moleval.sources import commits as C
from moleval.sources import tables as SRC
from moleval.streaming.runner import scratch_path

SCHEMA = "a int, b string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_a_repeated_batch_is_no_second_copy(spark):
    path = scratch_path(spark, "log")
    assert C.read_batches(spark, path, SCHEMA).count() == 0
    assert C.append_batch(rows(spark, (1, "x")), path, "k1") and C.append_batch(rows(spark, (2, None)), path, "k/2")
    assert not C.append_batch(rows(spark, (1, "x")), path, "k1")
    assert sorted(r.a for r in C.read_batches(spark, path, SCHEMA).collect()) == [1, 2]


def test_a_write_that_fails_in_between_is_not_seen(spark, monkeypatch):
    path = scratch_path(spark, "log")
    C.append_batch(rows(spark, (1, "x")), path, "k1")
    bad = rows(spark, (2, "y")).withColumn("a", F.assert_true(F.lit(False)).cast("int"))
    with pytest.raises(Exception):
        C.append_batch(bad, path, "k2")
    # killed behind the data and before the manifest
    monkeypatch.setattr(C.Folder, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        C.append_batch(rows(spark, (3, "z")), path, "k3")
    monkeypatch.undo()
    assert [r.a for r in C.read_batches(spark, path, SCHEMA).collect()] == [1]
    assert C.append_batch(rows(spark, (3, "z")), path, "k3") and C.read_batches(spark, path, SCHEMA).count() == 2


def test_two_writers_of_one_key_leave_one_copy(spark):
    path = scratch_path(spark, "log")
    threads = [threading.Thread(target=C.append_batch, args=(rows(spark, (1, "x"), (2, "y")), path, "same")) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert C.read_batches(spark, path, SCHEMA).count() == 2


def test_two_writers_do_not_both_build(spark):
    path, calls, got = scratch_path(spark, "once"), [], []

    def build():
        calls.append(1)
        time.sleep(1)
        return spark.range(5)

    threads = [threading.Thread(target=lambda: got.append(C.materialize_once(spark, path, build, poll_s=0.1).count())) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [5, 5, 5] and len(calls) == 1


def test_build_that_fails_or_dies_and_a_changed_source(spark, tmp_path):
    path = scratch_path(spark, "once")
    with pytest.raises(RuntimeError):
        C.materialize_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("no")))
    # a dead writer's claim and half a table
    spark.range(9).write.parquet(f"{path}/data/half")
    C.Folder(spark, path).put(C.CLAIM, "")
    os.utime(f"{path.removeprefix('file:')}/{C.CLAIM}", (1, 1))
    src = f"{tmp_path}/src"
    spark.range(3).write.parquet(src)
    build = lambda: spark.read.parquet(src)
    assert C.materialize_once(spark, path, build, source=C.source_fingerprint(spark, src), stale_s=60).count() == 3
    assert C.materialize_once(spark, path, lambda: 1 / 0, source=C.source_fingerprint(spark, src)).count() == 3
    spark.range(3, 7).write.mode("append").parquet(src)
    assert C.materialize_once(spark, path, build, source=C.source_fingerprint(spark, src)).count() == 7


def asked_log(folder):
    return [x for f in os.listdir(folder) for x in json.load(open(f"{folder}/{f}"))]


def test_predictor_that_dies_halfway_is_asked_once_per_row(spark, tmp_path):
    """Every call leaves a file of the inputs that it answered; the first run ends in the middle."""
    log, path = str(tmp_path), scratch_path(spark, "answers")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(400)] + [(None, "n"), (7, "t7")], "id int, t string")

    def run(limit):
        def predict(s):
            if limit is not None and sum(len(json.load(open(f"{log}/{f}"))) for f in os.listdir(log)) >= limit:
                os._exit(1)                                     # the worker is gone, and the job with it
            with open(f"{log}/{time.time_ns()}-{os.getpid()}", "w") as f:
                json.dump(s.tolist(), f)
            return s.str.len().astype(float)
        return P.resume_predictions(df, predict, "t", "m", path, "id", steps=8)

    with pytest.raises(Exception):
        run(200)
    before = C.read_batches(spark, path, P.ANSWERS).count()
    assert 0 < before < 401
    log = str(tmp_path / "second")
    os.mkdir(log)
    ok, failed = run(None)
    assert ok.count() == 402 and failed.count() == 0 and all(r.pred == len(r.t) for r in ok.collect())
    assert len(asked_log(log)) == 401 - before                  # what the first run committed is not asked again
    log = str(tmp_path / "third")
    os.mkdir(log)
    run(None)
    assert asked_log(log) == []


def test_rows_that_fail_are_reported_and_the_others_answered(spark):
    df = spark.createDataFrame([(i, "bad" if i % 10 == 3 else f"t{i}") for i in range(60)], "id int, t string")
    path = scratch_path(spark, "answers")

    def fussy(s):
        if (s == "bad").any():
            raise ValueError("no answer")
        return s.str.len().where(s != "t5")                     # an answer that is no number is an answer

    ok, failed = P.resume_predictions(df, fussy, "t", "m", path, "id", steps=3, max_tries=2)
    assert ok.count() == 54 and {r.id for r in ok.where("pred IS NULL").collect()} == {5}
    assert {(r.id, r.error) for r in failed.collect()} == {(i, "ValueError: no answer") for i in range(3, 60, 10)}
    ok, failed = P.resume_predictions(df, lambda s: s.str.len(), "t", "m", path, "id", steps=3)
    assert ok.count() == 60 and failed.count() == 0
    assert P.resume_predictions(df, lambda s: s.str.len(), "t", "other", path, "id")[0].count() == 60


def test_asking_is_spread_over_tasks(spark, tmp_path):
    """Small rows can be dear to ask: they are not put into one task for their few bytes."""
    log = str(tmp_path)

    def predict(s):
        from pyspark import TaskContext
        open(f"{log}/{TaskContext.get().partitionId()}", "w").close()
        return s.str.len()

    df = spark.range(400).select("id", F.col("id").cast("string").alias("t"))
    ok, failed = P.resume_predictions(df, predict, "t", "m", scratch_path(spark, "answers"), "id", steps=1)
    assert ok.count() == 400 and failed.count() == 0
    assert len(os.listdir(log)) >= 4


def test_answers_of_any_shape():
    """Lists, arrays, one answer for all, texts of numbers and missing ones; halves are asked with their own labels."""
    s = pd.Series(["a", "bb", "ccc", "bad", None])

    def refuse(give):
        def f(part):
            if (part == "bad").any():
                raise ValueError("no")
            return give(part)
        return P._asked(f, s, 1)

    bad = (None, 1, "ValueError: no")
    n = [1.0, 2.0, 3.0, None, None]
    want = [bad if i == 3 else (n[i], 1, None) for i in range(5)]
    assert refuse(lambda p: p.str.len()) == want
    assert refuse(lambda p: [None if t is None else len(t) for t in p]) == want
    assert refuse(lambda p: p.str.len().to_numpy()) == want
    assert refuse(lambda p: p.str.len().map(str)) == want
    assert refuse(lambda p: 7) == [bad if i == 3 else (7.0, 1, None) for i in range(5)]
    assert all(r[0] is None and r[2] for r in P._asked(lambda p: [1.0] * 9, s, 1))


def test_lines_that_do_not_fit_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,t\n1,2.5,ab\n2,zz,cd\n3\n\n4,1,"e,f"\n5,1,a,b\n6,,\n')
    (tmp_path / "b.csv").write_text("id,x,t\nseven,1,x\n8,NaN,y\n")
    good, bad = SRC.read_csv_checked(spark, str(tmp_path), "id int, x double, t string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5, "ab"), (4, 1.0, "e,f"), (6, None, None), (8, None, "y")]
    assert sorted((os.path.basename(r.file), r.text) for r in bad.collect()) == [("a.csv", "2,zz,cd"), ("a.csv", "3"), ("a.csv", "5,1,a,b"), ("b.csv", "seven,1,x")]
    assert good.select("t").count() == 4 and bad.select("file").count() == 4     # whatever columns are asked for


def test_bodies_that_do_not_fit_are_reported(spark):
    body = lambda *p: json.dumps({"PropertyTable": {"Properties": list(p)}})
    rows = [("1", 200, body({"CID": 1, "TPSA": 2.5}, {"CID": 2})), ("2", 200, "{not json"), ("3", 200, json.dumps({"Fault": 1})), ("4", 404, "gone"),
            ("5", 200, body({"CID": "five"})), ("6", 200, None), ("7", 200, body())]
    good, bad = SRC.parse_property_responses_checked(spark.createDataFrame(rows, "cid_list string, status int, body string"))
    assert sorted(r.CID for r in good.collect()) == [1, 2]
    assert sorted((r.cid_list, r.reason) for r in bad.collect()) == [("2", "unreadable"), ("3", "no property table"), ("5", "unreadable"), ("6", "unreadable")]
    assert bad.where("cid_list = '2'").first().text == "{not json"
