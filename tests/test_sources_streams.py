import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from moleval.operators import curate as C
from moleval.operators import ordered as O
from moleval.operators import predict as P
from moleval.sources import sinks as SK
from moleval.sources import tables as SRC
from moleval.streaming.curate import curate_stream
from moleval.streaming.dedup import recent_dedup_stream
from moleval.streaming.route import route_examples
from moleval.streaming.runner import run_available_now, scratch_path


def prop_body(records):
    return json.dumps({"PropertyTable": {"Properties": records}})


def responses(spark):
    rows = [
        (0, "1,2", 200, prop_body([
            {"CID": 1, "CanonicalSMILES": "CCO", "ExactMass": "46.04", "TPSA": 20.2,
             "HBondDonorCount": 1, "HBondAcceptorCount": 1},
            {"CID": 2, "ExactMass": "12"}])),
        (1, "3,4", 503, "{}"),
        (2, "5,6", 200, prop_body([
            {"CID": 5, "CanonicalSMILES": "CCCl", "ExactMass": "abc", "HBondDonorCount": 0,
             "HBondAcceptorCount": 0},
            {"CID": 6, "CanonicalSMILES": "NCCO", "ExactMass": "abc", "HBondDonorCount": 2,
             "HBondAcceptorCount": 11},
            {"CID": 7, "CanonicalSMILES": "OCCN", "ExactMass": "n/a", "HBondDonorCount": 2,
             "HBondAcceptorCount": 2}])),
    ]
    return spark.createDataFrame(rows, "chunk long, cid_list string, status int, body string")


def test_parse_and_failed(spark):
    r = responses(spark)
    recs = SRC.parse_property_responses(r)
    assert sorted(x["CID"] for x in recs.collect()) == [1, 2, 5, 6, 7]
    assert [(x["cid_list"], x["status"]) for x in SRC.failed_requests(r).collect()] == [("3,4", 503)]


def test_curate_plan(spark):
    got = sorted(x["CID"] for x in C.curate(responses(spark)).collect())
    assert got == [1, 7]          # 2: no SMILES, 5: chlorine, 6: acceptors > 10; bad mass kept
    tagged = C.curate(responses(spark), tagger=lambda d: d.withColumn("groups", F.when(F.col("CID") == 7, F.array(F.lit("g"))))).collect()
    assert [x["CID"] for x in tagged] == [7]         # a record without groups was rejected by tagging


def test_unfinished_write_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert SK.materialize_once(spark, path, lambda: spark.range(3)).count() == 3
    assert SK.materialize_once(spark, path, lambda: spark.range(9)).count() == 3


def test_prediction_files_by_uri(spark, tmp_path):
    spark.createDataFrame([("CC", 1.0, 2.0)], "smiles string, calculated double, m_pred double").write.option("header", True).csv(f"{tmp_path}/m_predictions.csv")
    got = SRC.read_prediction_set(spark, f"file:{tmp_path}", ["m", "absent"]).collect()
    assert [(x["model"], x["pred"]) for x in got] == [("m", 2.0)]


def test_max_id_scan(spark):
    def page(ids):
        return json.dumps({"PC_Compounds": [{"id": {"id": {"cid": i}}} for i in ids]})
    rows = [(0, 200, page([10, 12])), (1, 200, page([15])), (2, 200, "{}"), (3, 200, page([99]))]
    df = spark.createDataFrame(rows, "chunk long, status int, body string")
    r = C.max_id_scan(df, start=11).first()
    assert (r["max_id"], r["n_checked"]) == (15, 3)
    r = C.max_id_scan(df, start=100).first()
    assert r["max_id"] == 100


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        SRC.require_columns(df, ["a", "b"])


def test_read_programs(spark):
    d = tempfile.mkdtemp()
    prog = {"prog.predictor": {"lm": None, "traces": [], "train": [],
                               "demos": [{"augmented": True, "question": "CCO", "answer": "20.23"},
                                         {"augmented": True, "question": "CN", "answer": "26.02"}],
                               "signature": {"instructions": "Predict.", "fields": [
                                   {"prefix": "Question:", "description": "smiles"}]}}}
    with open(os.path.join(d, "p.json"), "w") as f:
        json.dump(prog, f, indent=2)
    with open(os.path.join(d, "empty.json"), "w") as f:
        json.dump({"prog.predictor": {"demos": [], "signature": {"instructions": "x", "fields": []}}}, f)
    rows = SRC.read_programs(spark, d).collect()
    demos = [r for r in rows if r["program"].endswith("p.json")]
    assert [(r["demo_no"], r["question"]) for r in sorted(demos, key=lambda r: r["demo_no"])] == \
        [(0, "CCO"), (1, "CN")]
    assert len([r for r in rows if r["program"].endswith("empty.json")]) == 1


def test_sinks(spark):
    base = scratch_path(spark, "sinks")
    SK.ensure_table(spark, f"{base}/log", "Question string, Answer string")
    SK.ensure_table(spark, f"{base}/log", "Question string, Answer string")
    SK.append_log(spark.createDataFrame([("q", "a")], "Question string, Answer string"), f"{base}/log")
    SK.append_log(spark.createDataFrame([("q2", "a2")], "Question string, Answer string"), f"{base}/log")
    assert spark.read.parquet(f"{base}/log").count() == 2
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert SK.materialize_once(spark, f"{base}/m", build).count() == 3
    assert SK.materialize_once(spark, f"{base}/m", build).count() == 3
    assert len(calls) == 1


def _events_stream(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)


def test_stream_dedup_equals_batch(spark):
    s = _events_stream(spark).select("user_id", "event_id", "ts", F.bround("value", 1).alias("key"))
    sink = run_available_now(recent_dedup_stream(s, "user_id", ["ts", "event_id"], "key", keep=["event_id"]),
                             scratch_path(spark, "t-dedup"))
    st = {(r["event_id"], r["outcome"]) for r in spark.read.parquet(sink).collect()}
    b = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "user_id", "event_id", "ts", F.bround("value", 1).alias("key"))
    bt = {(r["event_id"], r["outcome"]) for r in
          O.recent_dedup(b, "user_id", ["ts", "event_id"], "key", keep=["event_id"]).collect()}
    assert st == bt and sum(1 for _, o in st if o == "accepted") == 992


def test_stream_route_and_curate(spark):
    s = _events_stream(spark).select("user_id", "event_id", "ts", F.floor("value").alias("k"),
                                     (F.col("value") - 50).alias("err"))
    d = recent_dedup_stream(s, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"])
    acc, rej = scratch_path(spark, "acc"), scratch_path(spark, "rej")
    route_examples(d, acc, rej, scratch_path(spark, "ck")).awaitTermination()
    n_acc, n_rej = spark.read.parquet(acc).count(), spark.read.parquet(rej).count()
    assert n_acc > 0 and n_rej > 0 and n_acc + n_rej <= 1000
    landing = scratch_path(spark, "landing")
    responses(spark).write.json(landing)
    sink = run_available_now(curate_stream(spark, landing), scratch_path(spark, "cur"))
    assert sorted(r["CID"] for r in spark.read.parquet(sink).collect()) == [1, 7]


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    p = P.with_predictions(df, lambda s: s.fillna("").str.len(), "t", "len", keep=["id"]).orderBy("id").collect()
    assert [(r["model"], r["id"], r["pred"]) for r in p] == [("len", 1, 3.0), ("len", 2, 0.0)]
    d = P.with_descriptor(df, lambda s: s.str.len(), "t", "n").orderBy("id").collect()
    assert [r["n"] for r in d] == [3.0, 0.0]


def test_stream_dedup_state_across_micro_batches(spark):
    """Three files cut by time, one file per trigger: the per-key state carried
    between micro-batches gives the same outcome as the batch operator."""
    import time as _time
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "user_id", "event_id", "ts", F.bround("value", 1).alias("key"))
    landing = scratch_path(spark, "multi")
    ordered = ev.orderBy("ts", "event_id").withColumn("rank", F.monotonically_increasing_id())
    ts_bounds = ordered.approxQuantile("rank", [0.33, 0.66], 0.0)
    cuts = [F.col("rank") <= ts_bounds[0],
            (F.col("rank") > ts_bounds[0]) & (F.col("rank") <= ts_bounds[1]),
            F.col("rank") > ts_bounds[1]]
    base = _time.time() - 100
    for i, cond in enumerate(cuts):
        path = f"{landing}/part{i}"
        ordered.where(cond).drop("rank").coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (base + 10 * i, base + 10 * i))
    schema = ev.schema
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(landing))
    sink = run_available_now(recent_dedup_stream(s, "user_id", ["ts", "event_id"], "key", keep=["event_id"]),
                             scratch_path(spark, "multi-out"))
    got = {(r["event_id"], r["outcome"]) for r in spark.read.parquet(sink).collect()}
    want = {(r["event_id"], r["outcome"]) for r in
            O.recent_dedup(ev, "user_id", ["ts", "event_id"], "key", keep=["event_id"]).collect()}
    assert got == want
